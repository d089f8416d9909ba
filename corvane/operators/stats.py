"""Paired tests, corrections, intervals, bootstraps and learning curves."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.numeric import log_binomial_tail, t_critical


def summarize(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sample deviation (0 of one value), extremes and the Student-t 95 % interval; null values are skipped."""
    x = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("minimum"), F.max(value).alias("maximum"))
    half = F.when(F.col("n") > 1, t_critical(F.col("n") - 1) * F.col("std") / F.sqrt("n")).otherwise(0.0)
    return x.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})


def paired(facts: DataFrame, cell: list[str], method: str, item: str, correct: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(cell, left_method, right_method, item, left, right) of items that both methods answered."""
    wanted = facts.sparkSession.createDataFrame(pairs, "left_method string, right_method string")
    a = facts.select(*cell, F.col(method).alias("left_method"), item, F.col(correct).alias("left"))
    b = facts.select(*cell, F.col(method).alias("right_method"), item, F.col(correct).alias("right"))
    return a.join(F.broadcast(wanted), "left_method").join(b, [*cell, item, "right_method"])


def unpaired(facts: DataFrame, cell: list[str], method: str, item: str, left: str, right: str) -> DataFrame:
    """Items that only one of two methods has in a cell; a fair comparison has none."""
    one = facts.where(F.col(method) == left).select(*cell, item)
    two = facts.where(F.col(method) == right).select(*cell, item)
    return one.exceptAll(two).withColumn("only", F.lit(left)).unionByName(two.exceptAll(one).withColumn("only", F.lit(right)))


@F.pandas_udf(DoubleType())
def exact_tail(b: pd.Series, c: pd.Series) -> pd.Series:
    """Two-sided exact McNemar p of discordant counts, in log space."""
    return pd.Series([1.0 if x + y == 0 else min(1.0, 2 * math.exp(log_binomial_tail(int(x + y), int(min(x, y))))) for x, y in zip(b, c, strict=True)])


def mcnemar(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """By comparison: discordant counts, risk difference, matched odds ratio and exact p."""
    only = lambda a, b: F.sum((F.col(a) & ~F.col(b)).cast("long"))
    x = pairs.groupBy(*keys).agg(F.count("*").alias("n"), only("left", "right").alias("left_only"), only("right", "left").alias("right_only"))
    return x.withColumns({"risk_difference": (F.col("right_only") - F.col("left_only")) / F.col("n"), "odds_ratio": (F.col("right_only") + 0.5) / (F.col("left_only") + 0.5), "p_value": exact_tail("left_only", "right_only")})


def fisher(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    """Fisher's combination of p values: the survival of chi square with twice as many degrees of freedom, in closed form."""
    x = df.groupBy(*keys).agg(F.count("*").cast("int").alias("k"), (-F.sum(F.log(F.greatest(F.col(p), F.lit(1e-300))))).alias("half"))
    series = F.aggregate(F.sequence(F.lit(1), F.col("k")), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("l")), lambda a, i: F.struct((a["s"] + F.exp(a["l"] - F.col("half"))).alias("s"), (a["l"] + F.log(F.col("half")) - F.log(i.cast("double"))).alias("l")), lambda a: a["s"])
    return x.withColumn("combined_p", F.when(F.col("half") <= 0, 1.0).otherwise(F.least(F.lit(1.0), series))).select(*keys, "k", "combined_p")


def holm(df: DataFrame, p: str, order: list[str], within: list[str] | None = None) -> DataFrame:
    """Adds ``holm_p``: the step-down correction, a running maximum of (m - rank) p. A family of comparisons is small."""
    keys = within or []
    w = W.partitionBy(*keys).orderBy(p, *order)
    step = F.least(F.lit(1.0), (F.count("*").over(W.partitionBy(*keys)) - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("_s", step).withColumn("holm_p", F.max("_s").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_s")


def percentile_interval(effects: list[float]) -> tuple[float, float]:
    s, n = sorted(effects), len(effects)
    return s[int(0.025 * (n - 1))], s[int(0.975 * (n - 1))]


def paired_bootstrap(pairs: DataFrame, keys: list[str], item: str, iterations: int = 2000, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean difference over resampled items, each comparison in a task of its own. Only counts
    of the three differences matter, so a resample is a multinomial draw and its size doesn't grow with the items."""
    diff = F.col("right").cast("int") - F.col("left").cast("int")
    counts = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.sum((diff == 1).cast("long")).alias("up"), F.sum((diff == -1).cast("long")).alias("down"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for x in it:
            low, high = [], []
            for n, up, down in zip(x.n, x.up, x.down, strict=True):
                draws = np.random.default_rng([seed, n, up, down]).multinomial(n, [up / n, down / n, max(0.0, 1 - up / n - down / n)], iterations)
                a, b = percentile_interval(((draws[:, 0] - draws[:, 1]) / n).tolist())
                low.append(a)
                high.append(b)
            yield x[keys].assign(effect=(x.up - x.down) / x.n, ci_low=low, ci_high=high)

    names = [f"{f.name} {f.dataType.simpleString()}" for f in counts.select(*keys).schema]
    return counts.mapInPandas(run, ", ".join([*names, "effect double", "ci_low double", "ci_high double"]))


def cluster_bootstrap(pairs: DataFrame, keys: list[str], cluster: str, iterations: int = 2000, seed: int = 42) -> DataFrame:
    """Two-stage bootstrap: clusters are drawn, then items in each. Cluster counts suffice, one small group a comparison."""
    diff = F.col("right").cast("int") - F.col("left").cast("int")
    counts = pairs.groupBy(*keys, cluster).agg(F.count("*").alias("n"), F.sum((diff == 1).cast("long")).alias("up"), F.sum((diff == -1).cast("long")).alias("down"))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        x = x.sort_values(cluster, kind="stable")
        rng = random.Random(seed)
        gen = np.random.default_rng(seed)
        effects = []
        rows = list(zip(x.n.tolist(), x.up.tolist(), x.down.tolist(), strict=True))
        for _ in range(iterations):
            total = size = 0
            for _ in rows:
                n, up, down = rows[rng.randrange(len(rows))]
                u, d, _ = gen.multinomial(n, [up / n, down / n, max(0.0, 1 - up / n - down / n)])
                total, size = total + int(u) - int(d), size + n
            effects.append(total / size)
        low, high = percentile_interval(effects)
        return x[keys].head(1).assign(effect=(x.up.sum() - x.down.sum()) / x.n.sum(), ci_low=low, ci_high=high)

    names = [f"{f.name} {f.dataType.simpleString()}" for f in counts.select(*keys).schema]
    return counts.groupBy(*keys).applyInPandas(run, ", ".join([*names, "effect double", "ci_low double", "ci_high double"]))


def curve_area(points: DataFrame, keys: list[str], cycle: str, value: str) -> DataFrame:
    """Area under a learning curve by trapezoids, over its length; a single cycle has its value."""
    w = W.partitionBy(*keys).orderBy(cycle)
    x = points.withColumns({"_v": F.lag(value).over(w), "_c": F.lag(cycle).over(w)})
    x = x.groupBy(*keys).agg(F.sum((F.col(value) + F.col("_v")) / 2 * (F.col(cycle) - F.col("_c"))).alias("_a"), (F.max(cycle) - F.min(cycle)).alias("_l"), F.max_by(value, cycle).alias("_last"))
    return x.select(*keys, F.when(F.col("_l") > 0, F.col("_a") / F.col("_l")).otherwise(F.col("_last")).alias("auc"))


def forgetting(facts: DataFrame, keys: list[str], item: str, cycle: str, correct: str) -> DataFrame:
    """Share of items right in the first cycle that are wrong or absent in the last one of their keys."""
    w = W.partitionBy(*keys)
    x = facts.withColumns({"_a": F.min(cycle).over(w), "_b": F.max(cycle).over(w)})
    before = x.where((F.col(cycle) == F.col("_a")) & F.col(correct)).select(*keys, item)
    after = x.where(F.col(cycle) == F.col("_b")).groupBy(*keys, item).agg(F.max(F.col(correct).cast("int")).alias("_now"))
    return before.join(after, [*keys, item], "left").groupBy(*keys).agg(F.count("*").alias("known_before"), F.sum((F.coalesce("_now", F.lit(0)) == 0).cast("long")).alias("forgotten")).withColumn("forgetting_rate", F.col("forgotten") / F.col("known_before"))


def final_rows(df: DataFrame, keys: list[str], cycle: str) -> DataFrame:
    return df.withColumn("_m", F.max(cycle).over(W.partitionBy(*keys))).where(F.col(cycle) == F.col("_m")).drop("_m")


def average_rank(value: str, within: list[str] | None = None) -> Column:
    """Ranks with ties averaged."""
    keys = within or []
    return F.rank().over(W.partitionBy(*keys).orderBy(value)) + (F.count("*").over(W.partitionBy(*keys, value)) - 1) / 2


def spearman(df: DataFrame, a: str, b: str, within: list[str]) -> DataFrame:
    """Rank correlation by group; null of fewer than two rows or without variation."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    x = x.withColumn("_a", average_rank(a, within)).withColumn("_b", average_rank(b, within))
    sd = (F.stddev_pop("_a") > 0) & (F.stddev_pop("_b") > 0)
    return x.groupBy(*within).agg(F.count("*").alias("n"), F.when((F.count("*") > 1) & sd, F.corr("_a", "_b")).alias("spearman"))


def two_level(facts: DataFrame, keys: list[str], seed: str, correct: str) -> DataFrame:
    """Accuracy of each seed, then the summary over seeds, with the seeds."""
    by_seed = facts.groupBy(*keys, seed).agg(F.avg(F.col(correct).cast("double")).alias("accuracy"), F.count("*").alias("questions"))
    out = summarize(by_seed, keys, "accuracy")
    seeds = by_seed.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(seed)), ",").alias("seeds"), F.min("questions").alias("questions"))
    return out.join(seeds, keys)


def delta_to_base(df: DataFrame, keys: list[str], method: str, base: str, value: str) -> DataFrame:
    """Difference of each method's value to that of the base method in the same keys; null without one."""
    b = df.where(F.col(method) == base).select(*keys, F.col(value).alias("base_value"))
    return df.join(b, keys, "left").withColumn("delta", F.col(value) - F.col("base_value"))
