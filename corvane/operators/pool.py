"""The pool of hard samples: keyed merge, lifecycle and what to test again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.difficulty import sample_grade


def merge(pool: DataFrame, rows: DataFrame, key: str = "unique_key") -> DataFrame:
    """Full outer merge: new wrong rows are added as active, seen ones get their occurrences and last cycle
    raised and are active again. A row
    of the same cycle and iteration as the pool's last sight is the same delivery and changes nothing."""
    new = rows.groupBy(key).agg(F.max(F.struct("cycle", "iteration")).alias("_at"), F.max_by(F.struct("category", "sub_category", "grade"), F.struct("cycle", "iteration")).alias("_r"))
    old = pool.select(key, *[F.col(c).alias(f"_o_{c}") for c in pool.columns if c != key])
    x = old.join(new, key, "full_outer")
    fresh = F.col("_at").isNotNull() & (F.col("_o_occurrences").isNull() | (F.struct(F.col("_o_last_seen_cycle").alias("cycle"), F.col("_o_last_iteration").alias("iteration")) < F.col("_at")))
    pick = lambda new, old: F.when(fresh, new).otherwise(F.col(old))
    return x.select(
        key,
        pick(F.col("_r.category"), "_o_category").alias("category"),
        pick(F.col("_r.sub_category"), "_o_sub_category").alias("sub_category"),
        pick(F.col("_r.grade"), "_o_grade").alias("grade"),
        pick(F.lit("active"), "_o_state").alias("state"),
        pick(F.lit(0), "_o_streak").alias("streak"),
        pick(F.col("_at.cycle"), "_o_last_seen_cycle").alias("last_seen_cycle"),
        pick(F.col("_at.iteration"), "_o_last_iteration").alias("last_iteration"),
        (F.coalesce("_o_occurrences", F.lit(0)) + fresh.cast("int")).alias("occurrences"),
        F.coalesce("_o_failures", F.lit(0)).alias("failures"),
    )


def next_state(state: Column, streak: Column, outcome: Column, age: Column, master: int = 2, stale: int = 2, retire: int = 4) -> Column:
    """struct<state, streak> after one test or none: right answers make a streak that masters, a wrong one starts again;
    unseen samples grow stale, and old mastered or stale ones retire."""
    streak = F.when(outcome.isNull(), streak).when(outcome, streak + 1).otherwise(0)
    tested = F.when(outcome & (streak >= master), "mastered").when(outcome, state).otherwise("active")
    waited = F.when((age >= stale) & ~state.isin("mastered", "retired"), "stale").otherwise(state)
    now = F.when(outcome.isNull(), waited).otherwise(tested)
    return F.struct(F.when((age >= retire) & now.isin("mastered", "stale"), "retired").otherwise(now).alias("state"), streak.cast("int").alias("streak"))


def apply_outcomes(pool: DataFrame, outcomes: DataFrame, current: int, key: str = "unique_key") -> DataFrame:
    """The pool after the outcomes (key, is_correct) of a cycle; the last of repeated ones would be ambiguous, so any wrong
    one counts."""
    o = outcomes.groupBy(key).agg(F.min("is_correct").alias("_ok"))
    x = pool.join(o, key, "left")
    n = next_state(F.col("state"), F.col("streak"), F.col("_ok"), F.lit(current) - F.col("last_seen_cycle"))
    x = x.withColumn("_n", n).withColumn("failures", F.col("failures") + F.coalesce((~F.col("_ok")).cast("int"), F.lit(0)))
    return x.withColumns({"state": F.col("_n.state"), "streak": F.col("_n.streak")}).drop("_n", "_ok")


def retest(pool: DataFrame, k: int, current: int, decay: float = 0.5, key: str = "unique_key") -> DataFrame:
    """The k eligible samples of highest priority: recent, confident, frequent and failed by several models."""
    age = F.greatest(F.lit(0), F.lit(current) - F.col("last_seen_cycle"))
    score = F.exp(-decay * age) * (1 + F.coalesce("confidence", F.lit(0.0)) + F.log1p("occurrences") + 0.25 * F.col("failures"))
    ready = pool.where((F.col("grade") == "train_eligible") & F.col("state").isin("active", "stale"))
    return ready.withColumn("retest_priority", score).orderBy(F.desc("retest_priority"), F.desc(key)).limit(k)


def export(pool: DataFrame, key: str = "unique_key", position: str = "last_seen_cycle") -> DataFrame:
    """Eligible active samples, the last row of a key, in its order."""
    from .summary import last_by_key

    ready = pool.where((F.coalesce("grade", F.lit("train_eligible")) == "train_eligible") & (F.col("state") == "active"))
    return last_by_key(ready, [key], position).orderBy(key)


def managed(pool: DataFrame, attempts: DataFrame, key: str = "unique_key") -> DataFrame:
    """The pool after one iteration's graded attempts (key, category, sub_category, cycle, iteration, is_correct): wrong ones are
    graded by their group's accuracy over all attempts and merged."""
    groups = attempts.groupBy("category", "sub_category").agg(F.avg(F.col("is_correct").cast("double")).alias("accuracy"))
    wrong = attempts.where(~F.col("is_correct")).join(F.broadcast(groups) if groups.count() <= 10_000 else groups, ["category", "sub_category"])
    return merge(pool, wrong.withColumn("grade", sample_grade(F.col("accuracy"))), key)


def variant_context(pool: DataFrame, n: int = 12, key: str = "unique_key") -> DataFrame:
    """The ``n`` samples of each group to make variants of, and their place: eligible active ones, deterministically verified
    first, then by confidence, occurrences and the last sight; the smaller key of equals."""
    ready = pool.where((F.col("grade") == "train_eligible") & (F.col("state") == "active"))
    order = [(F.coalesce("verification", F.lit("")) == "deterministic").desc(), F.coalesce("confidence", F.lit(0.0)).desc(), F.coalesce("occurrences", F.lit(1)).desc(), F.coalesce("last_seen_cycle", F.lit(0)).desc(), F.coalesce("last_iteration", F.lit(0)).desc(), F.col(key)]
    return ready.withColumn("place", F.row_number().over(W.partitionBy("category", "sub_category").orderBy(*order))).where(F.col("place") <= n)


def history_lines(pool: DataFrame, key: str = "unique_key") -> DataFrame:
    """(sub_category, line) of each eligible active sample, as a prompt shows it."""
    ready = pool.where((F.col("grade") == "train_eligible") & (F.col("state") == "active"))
    group = F.coalesce("sub_category", F.lit("Unknown"))
    # The wording of a line.
    line = F.concat(F.lit("- hard_sample_id: "), F.substring(key, 1, 16), F.lit(" | difficulty: "), F.coalesce(F.col("difficulty").cast("string"), F.lit("5")), F.lit(" | structural_pattern: "), group, F.lit(" problem | observed_failure: "), F.when(F.size("error_tags") > 0, F.array_join("error_tags", ",")).otherwise("concept_confusion"), F.lit(" | variation_requirements: change values, wording, and structure"))
    return ready.select(group.alias("sub_category"), line.alias("line"))
