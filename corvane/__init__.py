"""Corvane: evaluation-data and training-corpus analytics expressed as Spark DataFrame operators."""
