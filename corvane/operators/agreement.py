"""Agreement and attribution metrics over reviewed items, all weighted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite_double


def gold_label(adjudicated: str, one: str, two: str):
    """The adjudicated label, else the one both reviewers gave, else empty."""
    a = F.trim(F.coalesce(F.col(adjudicated), F.lit("")))
    agreed = F.when(F.trim(F.col(one)) == F.trim(F.col(two)), F.trim(F.col(one)))
    return F.when(a != "", a).otherwise(F.coalesce(agreed, F.lit("")))


def sample_weight(c: str):
    w = finite_double(F.col(c))
    return F.when(w > 0, w).otherwise(1.0)


def confusion(df: DataFrame, actual: str, predicted: str, weight: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.sum(weight).alias("weight"))


def label_scores(df: DataFrame, actual: str, predicted: str, weight: str) -> DataFrame:
    """Precision, recall and F1 of each label on either side; 0 where undefined."""
    c = confusion(df, actual, predicted, weight)
    given = c.groupBy(F.col("actual").alias("label")).agg(F.sum("weight").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("weight")).otherwise(0.0)).alias("hits"))
    said = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("weight").alias("said"))
    x = given.join(said, "label", "full_outer").na.fill(0.0, ["support", "hits", "said"])
    p, r = F.coalesce(F.try_divide("hits", "said"), F.lit(0.0)), F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    return x.select("label", "support", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def cohen_kappa(df: DataFrame, one: str, two: str, weight: str) -> DataFrame:
    """One row: n, weighted agreement, expected agreement and kappa over pairs with both labels; kappa is 1 where chance
    alone agrees fully and null without pairs."""
    x = df.where((F.trim(F.coalesce(one, F.lit(""))) != "") & (F.trim(F.coalesce(two, F.lit(""))) != ""))
    total = x.agg(F.count("*").alias("n"), F.sum(weight).alias("w"), F.sum(F.when(F.col(one) == F.col(two), F.col(weight)).otherwise(0.0)).alias("same"))
    a = x.groupBy(F.col(one).alias("label")).agg(F.sum(weight).alias("a"))
    b = x.groupBy(F.col(two).alias("label")).agg(F.sum(weight).alias("b"))
    chance = a.join(b, "label").agg(F.sum(F.col("a") * F.col("b")).alias("c"))
    y = total.crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("w"), F.coalesce(F.col("c"), F.lit(0.0)) / (F.col("w") * F.col("w"))
    return y.select("n", po.alias("observed"), pe.alias("expected"), F.when(F.col("n") == 0, None).when(F.abs(1 - pe) < 1e-12, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def selective(df: DataFrame, correct: str, confidence: str, review: str, evidence: str, weight: str, high: float = 0.8) -> DataFrame:
    """One row of weighted shares: accuracy, coverage without review and accuracy there, evidence coverage, Brier score,
    accuracy at high confidence."""
    w, ok = F.col(weight), F.col(correct).cast("double")
    part = lambda cond: (F.sum(F.when(cond, w).otherwise(0.0)), F.sum(F.when(cond, w * ok).otherwise(0.0)))
    kept, kept_ok = part(~F.col(review))
    sure, sure_ok = part(F.col(confidence) >= high)
    return df.agg(
        F.count("*").alias("n"),
        (F.sum(w * ok) / F.sum(w)).alias("accuracy"),
        (kept / F.sum(w)).alias("selective_coverage"),
        F.try_divide(kept_ok, kept).alias("selective_accuracy"),
        (F.sum(F.when(F.col(evidence), w).otherwise(0.0)) / F.sum(w)).alias("evidence_coverage"),
        (F.sum(w * F.pow(F.col(confidence) - ok, F.lit(2.0))) / F.sum(w)).alias("brier"),
        F.try_divide(sure_ok, sure).alias("high_confidence_accuracy"),
    )


def gates(metrics: DataFrame, least: dict[str, float]) -> DataFrame:
    """Adds a boolean for each metric's least value and whether all pass."""
    x = metrics.withColumns({f"{k}_ok": F.coalesce(F.col(k) >= v, F.lit(False)) for k, v in least.items()})
    passed = F.lit(True)
    for k in least:
        passed = passed & F.col(f"{k}_ok")
    return x.withColumn("accepted", passed)


def review_merge(system: DataFrame, one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """Three files of the same items joined by id; any id that one of them lacks is an error."""
    from .common import require_none

    x = system.withColumn("_s", F.lit(True)).join(one.withColumn("_1", F.lit(True)), key, "full_outer").join(two.withColumn("_2", F.lit(True)), key, "full_outer")
    require_none(x.where("_s IS NULL OR _1 IS NULL OR _2 IS NULL").select(key), "ids differ between the files")
    return x.drop("_s", "_1", "_2")
