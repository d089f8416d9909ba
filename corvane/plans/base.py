"""The driver tables as the operators' inputs, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Texts that come in fewer splits than there are cores are dealt to all of them, since work on a text
    costs far more than moving it; inputs of many splits are left as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df._jdf.rdd().getNumPartitions() < cores else df


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as graded items; without a label an item is not evaluated."""
    d, g = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    x = d.join(g, "doc_id", "left")
    return x.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("question"),
        F.col("n_chars").cast("string").alias("gold_answer"),
        F.col("lang").alias("category"),
        F.col("source").alias("sub_category"),
        (F.col("quality") == 1).alias("is_correct"),
        (F.col("toxic") == 1).alias("tool_violation"),
        (1 + F.col("n_chars") % 10).cast("int").alias("difficulty"),
        (F.col("doc_id") % 4).cast("int").alias("cycle"),
        ((F.col("n_chars") % 100) / 100).alias("confidence"),
    )


ITEMS = """items AS (
  SELECT d.doc_id AS id, d.text AS question, CAST(d.n_chars AS VARCHAR) AS gold_answer, d.lang AS category, d.source AS sub_category,
    g.quality = 1 AS is_correct, g.toxic = 1 AS tool_violation, CAST(1 + d.n_chars % 10 AS INT) AS difficulty, CAST(d.doc_id % 4 AS INT) AS cycle,
    (d.n_chars % 100) / 100.0::DOUBLE AS confidence
  FROM documents d LEFT JOIN labels g USING (doc_id))"""


def facts(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Line items as answers: one row a method, seed and question (and what else is named)."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("seed"), F.col("l_partkey").alias("question_id"), F.year("l_shipdate").alias("cycle"), (F.col("l_quantity") > 25).alias("ok"), "l_suppkey")
    return x.groupBy("method", "seed", "question_id", *more).agg(F.max("ok").alias("is_correct"))


def facts_sql(*more: str) -> str:
    names = "".join(f", {m}" for m in more)
    return f"""facts AS (
  SELECT method, seed, question_id{names}, bool_or(ok) AS is_correct FROM (
    SELECT l_returnflag AS method, l_linenumber AS seed, l_partkey AS question_id, CAST(year(l_shipdate) AS INT) AS cycle, l_quantity > 25 AS ok FROM lineitem)
  GROUP BY method, seed, question_id{names})"""


#: Normalised text, and templates by marks around words since the dialect has no look-around.
NORM = r"regexp_replace(regexp_replace(regexp_replace(lower({0}), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s%+\-*/=().<>{{}}\[\],]', '', 'g')"


def norm_sql(c: str) -> str:
    return NORM.format(f"coalesce({c}, '')")


def template_sql(c: str) -> str:
    a, b = "chr(1)", "chr(2)"
    x = f"regexp_replace({norm_sql(c)}, '([\\p{{L}}\\p{{N}}_]+)', {a} || '\\1' || {b}, 'g')"
    x = f"regexp_replace({x}, {a} || '\\d+' || {b} || '(?:\\.' || {a} || '\\d+' || {b} || ')?(?:/' || {a} || '\\d+' || {b} || ')?', '<NUM>', 'g')"
    x = f"regexp_replace({x}, {a} || '(?:km|cm|mm|m|kg|g|hours?|minutes?|seconds?|degrees?)' || {b}, '<UNIT>', 'g')"
    x = f"regexp_replace({x}, {a} || '[a-z]' || {b}, '<VAR>', 'g')"
    return f"replace(replace({x}, {a}, ''), {b}, '')"


def words_sql(c: str) -> str:
    return f"list_filter(string_split({norm_sql(c)}, ' '), lambda w: w <> '')"


def shingles_sql(words: str, n: int) -> str:
    return f"list_distinct(CASE WHEN len({words}) >= {n} THEN list_transform(range(1, len({words}) - {n} + 2), lambda i: array_to_string({words}[i : i + {n} - 1], ' ')) WHEN len({words}) > 0 THEN [array_to_string({words}, ' ')] ELSE CAST([] AS VARCHAR[]) END)"
