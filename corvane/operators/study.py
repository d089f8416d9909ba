"""Study matrices, their registry, retention between runs and regrading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import wilson
from .common import require_none


def matrix(spark: SparkSession, **axes: list) -> DataFrame:
    """All combinations of a few short lists, with a study_id of their hash."""
    rows = spark.range(1)
    for name, values in axes.items():
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return rows.drop("id").withColumn("study_id", F.substring(F.sha2(F.concat_ws("|", *[F.col(a).cast("string") for a in axes]), 256), 1, 16))


def same_in_cell(df: DataFrame, cell: list[str], columns: list[str]) -> DataFrame:
    """Cells in which some column that must be equal has several values."""
    x = df.groupBy(*cell).agg(*[F.countDistinct(c).alias(c) for c in columns])
    return x.where(reduce(lambda a, b: a | b, [F.col(c) > 1 for c in columns]))


def seed_sets(df: DataFrame, keys: list[str], seed: str) -> DataFrame:
    """(keys, seeds): the sorted seeds of each group; a fair study has one such set."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(seed)), ",").alias("seeds"))


def merge_registry(planned: DataFrame, existing: DataFrame, identity: list[str]) -> DataFrame:
    """Planned studies with the status of existing ones; a changed identity is an error and a running one is partial."""
    e = existing.select("study_id", F.col("status").alias("_status"), *[F.col(c).alias(f"_e_{c}") for c in identity])
    x = planned.join(e, "study_id", "full_outer")
    drift = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in identity])
    require_none(x.where(F.col("_status").isNotNull() & F.col(identity[0]).isNotNull() & drift).select("study_id"), "studies whose identity changed")
    return x.withColumn("status", F.when(F.col("_status").isNull(), "pending").when(F.col("_status") == "running", "partial").otherwise(F.col("_status"))).drop("_status", *[f"_e_{c}" for c in identity])


def retention(before: DataFrame, after: DataFrame, item: str, correct: str, dimension: str) -> DataFrame:
    """By dimension: items known before, forgotten, gained, without a later outcome, and the interval of forgetting. A
    missing later outcome is unknown, not forgotten."""
    x = before.select(item, dimension, F.col(correct).alias("_b")).join(after.select(item, F.col(correct).alias("_a")), item, "left")
    agg = x.groupBy(dimension).agg(
        F.sum((F.col("_b") & F.col("_a").isNotNull()).cast("long")).alias("known"),
        F.sum(F.coalesce(F.col("_b") & ~F.col("_a"), F.lit(False)).cast("long")).alias("forgotten"),
        F.sum(F.coalesce(~F.col("_b") & F.col("_a"), F.lit(False)).cast("long")).alias("gained"),
        F.sum(F.col("_a").isNull().cast("long")).alias("unknown"),
    )
    ci = wilson(F.col("forgotten"), F.col("known"))
    return agg.withColumns({"rate": F.try_divide("forgotten", "known"), "ci_low": ci["low"], "ci_high": ci["high"]})


def regrade(df: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(transition, n, ids): how verdicts changed, with the ids in order."""
    t = F.when(F.col(old) & F.col(new), "still_correct").when(F.col(old), "became_incorrect").when(F.col(new), "became_correct").otherwise("still_incorrect")
    return df.withColumn("transition", t).groupBy("transition").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(key)).alias("ids"))
