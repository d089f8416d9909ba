"""The corpus pipeline: language ID, line dedup, SimHash near-dedup and best-fit packing of ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. No DuckDB SQL expresses the trained network, the XXH64
fingerprints or the tokenizer, so ORACLE_SQL is None; tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import common, langid, line_dedup, near_copies, packing
from corvane.llm.token_files import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected if no language can be told (null text, no letter) or no learned language is likelier than this.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network tells; those it rejects go. Labels are learned from ``docs`` itself; where
    there are none, every document with a letter stays."""
    net = langid.train(langid.sample(docs))
    labelled = langid.identify(docs.select(*COLUMNS), net)
    if net is None:
        return labelled.where(F.col("text").rlike("\\p{L}")).select(*COLUMNS)
    return labelled.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages, n_chars counted anew; those of which nothing is left go."""
    found = line_dedup.dedup_lines(docs.select(*COLUMNS))
    kept = found.where((F.col("lines_removed") == 0) | (F.trim("text") != ""))
    return kept.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (4 differing bits, or a five-word similarity of 0.8), that of the
    smallest doc_id. Rows are judged by their text: unlike texts that share a doc_id all stay, a repeated row stays once."""
    row = lambda mark: F.concat_ws(" ", mark, F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias("row")
    keep = near_copies.representatives(docs).select(row(F.col("mark")))
    marked = docs.select(*COLUMNS, row(F.md5(F.coalesce(F.col("text"), F.lit("")))))
    return marked.join(keep, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)  # by one key, so texts are dealt once


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing of what is left: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("simhash_near_dedup", near_dedup), ("best_fit_packing", best_fit_packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return docs
