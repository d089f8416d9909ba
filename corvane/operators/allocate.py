"""Apportionment of a budget and the policies that plan the next round."""

from __future__ import annotations

import hashlib
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import difficulty as D


def largest_remainder(df: DataFrame, total: Column | int, weight: str, order: list[str], within: list[str] | None = None) -> DataFrame:
    """Adds ``allocated``: whole shares of ``total`` by ``weight``, the rest by largest fraction, ties in ``order``. With
    ``within`` each of its groups has a total of its own. Without weight nothing is allocated."""
    keys = within or []
    share = W.partitionBy(*keys)
    total = F.lit(total) if isinstance(total, int) else total
    exact = F.when(F.sum(weight).over(share) > 0, total * F.col(weight) / F.sum(weight).over(share)).otherwise(0.0)
    x = df.withColumns({"_exact": exact, "_total": total}).withColumn("_floor", F.floor(F.round("_exact", 9)).cast("long"))
    x = x.withColumns({"_rest": F.col("_total") - F.sum("_floor").over(share), "_fraction": F.round(F.col("_exact") - F.col("_floor"), 9), "_any": F.sum(weight).over(share) > 0})
    rank = F.row_number().over(share.orderBy(F.desc("_fraction"), *order))
    return x.withColumn("allocated", F.when(F.col("_any"), F.col("_floor") + (rank <= F.col("_rest")).cast("long")).otherwise(0).cast("long")).drop("_exact", "_floor", "_rest", "_fraction", "_total", "_any")


def chunked(df: DataFrame, count: str, most: int) -> DataFrame:
    """Rows of at most ``most``: chunk (from 0) and chunk_count; rows with nothing to do vanish."""
    n = F.ceil(F.col(count) / most).cast("int")
    x = df.where(F.col(count) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    return x.withColumn("chunk_count", F.least(F.lit(most).cast("long"), F.col(count) - F.col("chunk") * most))


@dataclass(frozen=True)
class Budget:
    """A number of questions in equal iterations and cycles."""

    questions: int
    iterations: int = 1
    cycles: int = 1

    def __post_init__(self):
        if min(self.questions, self.iterations, self.cycles) < 1 or self.questions % (self.iterations * self.cycles):
            raise ValueError("a budget must be positive and divide evenly")

    @classmethod
    def parse(cls, value: int | dict) -> Budget:
        return cls(value) if isinstance(value, int) else cls(**value)

    @property
    def per_iteration(self) -> int:
        return self.questions // (self.iterations * self.cycles)


def policy_seed(*parts: object) -> int:
    """A 64-bit seed of any parts."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "big")


def uniform_plan(groups: DataFrame, total: int, keys: list[str], most: int = 50, difficulty: int = 4) -> DataFrame:
    x = largest_remainder(groups.withColumn("_w", F.lit(1.0)), total, "_w", keys).drop("_w")
    return chunked(x, "allocated", most).select(*keys, "chunk", F.col("chunk_count").alias("question_count"), F.lit(difficulty).alias("difficulty"), F.lit("uniform").alias("generation_source"))


def random_plan(groups: DataFrame, total: int, keys: list[str], seed: int, low: int = 2, high: int = 6) -> DataFrame:
    """Each question's group is drawn, and one difficulty for each group. The taxonomy is a small dimension."""
    rows = [tuple(r[k] for k in keys) for r in groups.select(*keys).orderBy(*keys).collect()]
    rng = random.Random(policy_seed("random", seed))
    drawn: dict[tuple, int] = {}
    for _ in range(total):
        g = rng.choice(rows)
        drawn[g] = drawn.get(g, 0) + 1
    out = [(*g, n, rng.randint(low, high), "random") for g, n in sorted(drawn.items())]
    return groups.sparkSession.createDataFrame(out, groups.select(*keys).schema.simpleString()[7:-1] + ", question_count long, difficulty int, generation_source string") if out else empty_plan(groups, keys)


def empty_plan(groups: DataFrame, keys: list[str]) -> DataFrame:
    return groups.select(*keys, F.lit(0).cast("long").alias("question_count"), F.lit(0).alias("difficulty"), F.lit("none").alias("generation_source")).limit(0)


def error_plan(weights: DataFrame, total: int, keys: list[str], most: int = 50, difficulty: str = "difficulty") -> DataFrame:
    """By error weight; uniform if no group has been observed."""
    seen = W.partitionBy()
    x = weights.withColumn("_w", F.when(F.max("raw_count").over(seen) > 0, F.col("error_weight")).otherwise(1.0))
    x = largest_remainder(x, total, "_w", keys)
    return chunked(x, "allocated", most).select(*keys, "chunk", F.col("chunk_count").alias("question_count"), F.col(difficulty).alias("difficulty"), F.lit("error").alias("generation_source"))


def adaptive_plan(state: DataFrame, total: int, keys: list[str], overall_accuracy: float | None, evaluated: int, pool: DataFrame | None = None, iteration: int = 3, most: int = 50) -> DataFrame:
    """The full policy. ``state`` has, for each group, posterior_mean, posterior_variance, weight, raw_count, quota,
    base_weight and difficulty. From the third iteration on and with a pool the budget is split 45 / 40 / 15 over boundary,
    pool and coverage, else all goes to coverage."""
    priority = D.adaptive_priority(F.col("posterior_mean"), F.col("posterior_variance"), F.col("raw_count"), F.col("quota"))
    step = D.next_difficulty(F.col("difficulty"), D.difficulty_step(F.col("posterior_mean"), F.col("weight")), D.global_step(F.lit(overall_accuracy).cast("double"), F.lit(evaluated)))
    x = state.withColumns({"priority": priority, "next_difficulty": step}).withColumn("_w", F.greatest(F.lit(1e-9), F.col("priority") * F.col("base_weight")))
    split = iteration >= 3 and pool is not None
    sources = (("boundary", 0.45), ("hard_pool", 0.40), ("coverage", 0.15)) if split else (("coverage", 1.0),)
    from .curation import remainder_shares

    budget = remainder_shares(total, list(sources))
    parts = None
    for name, _ in sources:
        chosen = x.join(pool.select(*keys).distinct(), keys, "left_semi") if name == "hard_pool" else x
        part = largest_remainder(chosen, budget[name], "_w", keys).withColumn("generation_source", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    return chunked(parts, "allocated", most).select(*keys, "generation_source", "chunk", F.col("chunk_count").alias("question_count"), F.col("next_difficulty").alias("difficulty"), F.col("priority").alias("priority_score"))


def plan_status(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """By group the planned, made and missing questions and the status."""
    p, d = plan.groupBy(*keys).agg(F.sum("question_count").alias("planned")), done.groupBy(*keys).agg(F.count("*").alias("made"))
    x = p.join(d, keys, "left").withColumn("made", F.coalesce("made", F.lit(0)))
    missing = F.greatest(F.lit(0), F.col("planned") - F.col("made"))
    return x.withColumns({"missing": missing, "status": F.when(missing == 0, "satisfied").when(F.col("made") > 0, "partial").otherwise("unsatisfied")})
