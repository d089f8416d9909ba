"""Coverage of a taxonomy and weighted Beta posteriors of its groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import beta_mean_variance


def coverage_metrics(rows: DataFrame, groups: DataFrame, keys: list[str], quota: str | int = 20) -> DataFrame:
    """One row: raw and effective coverage, normalised entropy, Jensen-Shannon divergence to uniform, coefficient of
    variation and the ratio of the largest to the smallest non-empty group. Rows of unknown groups are ignored."""
    need = F.col(quota) if isinstance(quota, str) else F.lit(quota)
    counts = groups.join(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left").select(F.coalesce("n", F.lit(0)).alias("n"), need.alias("need"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("groups"))
    p = F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0)
    u = 1.0 / F.col("groups")
    x = counts.crossJoin(F.broadcast(total)).withColumns({"p": p, "u": u}).withColumn("m", (F.col("p") + F.col("u")) / 2)  # one row
    part = lambda a: F.when(F.col(a) > 0, F.col(a) * F.log(F.col(a) / F.col("m"))).otherwise(0.0)
    out = x.agg(
        F.sum("n").cast("long").alias("total"),
        F.avg((F.col("n") > 0).cast("double")).alias("raw_coverage"),
        F.avg((F.col("n") >= F.col("need")).cast("double")).alias("effective_coverage"),
        F.when(F.max("groups") <= 1, 1.0).when(F.max("total") == 0, 0.0).otherwise(-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0)) / F.log(F.max("groups").cast("double"))).alias("normalized_entropy"),
        (0.5 * F.sum(part("p") + part("u"))).alias("js_divergence"),
        F.when(F.avg("n") > 0, F.stddev_pop("n") / F.avg("n")).otherwise(0.0).alias("coefficient_of_variation"),
        F.try_divide(F.max(F.when(F.col("n") > 0, F.col("n"))), F.min(F.when(F.col("n") > 0, F.col("n")))).alias("max_min_ratio"),
    )
    return out


def beta_posterior(rows: DataFrame, keys: list[str], correct: Column, weight: Column) -> DataFrame:
    """By group: alpha, beta, posterior mean and variance, the number of observations and their weight."""
    w = rows.withColumns({"_w": weight, "_c": correct})
    agg = w.groupBy(*keys).agg(
        (1 + F.sum(F.when(F.col("_c"), F.col("_w")).otherwise(0.0))).alias("alpha"),
        (1 + F.sum(F.when(~F.col("_c"), F.col("_w")).otherwise(0.0))).alias("beta"),
        F.count("*").alias("raw_count"),
        F.sum("_w").alias("weight"),
    )
    mean, variance = beta_mean_variance(F.col("alpha"), F.col("beta"))
    return agg.withColumns({"posterior_mean": mean, "posterior_variance": variance})


def error_weights(rows: DataFrame, groups: DataFrame, keys: list[str], correct: Column, weight: Column, floor: float = 0.05) -> DataFrame:
    """By group of the taxonomy the posterior mean and the weight floor + 1 - mean; groups without rows have mean 1/2."""
    post = beta_posterior(rows, keys, correct, weight).select(*keys, "posterior_mean", "raw_count")
    return groups.join(post, keys, "left").withColumns({"posterior_mean": F.coalesce("posterior_mean", F.lit(0.5)), "raw_count": F.coalesce("raw_count", F.lit(0))}).withColumn("error_weight", floor + 1 - F.col("posterior_mean"))


def latest(rows: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """The value of each group's last row."""
    return rows.groupBy(*keys).agg(F.max_by(value, position).alias(value))
