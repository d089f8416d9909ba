"""Operators over DataFrames: curation, similarity, coverage, policies, summaries, statistics, pools, splits and audits."""
