"""Accuracy summaries by any grouping sets, manifests and simple rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def accuracy_rows(df: DataFrame, fields: list[str], correct: str = "is_correct") -> DataFrame:
    """n and accuracy by any fields."""
    return df.groupBy(*fields).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def accuracy_sets(df: DataFrame, sets: list[list[str]], correct: str = "is_correct") -> DataFrame:
    """total, correct and accuracy for each of several groupings in one pass; a column that is not in a row's grouping is
    null there, and ``level`` tells the groupings apart."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    names = {frozenset(s): "+".join(s) or "all" for s in sets}
    x = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.count("*").alias("total"), F.sum(F.coalesce(F.col(correct), F.lit(False)).cast("long")).alias("correct"), *[F.grouping(c).alias(f"_g_{c}") for c in columns])
    level = None
    for s, name in names.items():
        case = F.lit(True)
        for c in columns:
            case = case & (F.col(f"_g_{c}") == (0 if c in s else 1))
        level = F.when(case, name) if level is None else level.when(case, name)
    return x.select(level.alias("level"), *columns, "total", "correct", F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)).alias("accuracy"))


def weakest(df: DataFrame, keys: list[str], k: int = 10, correct: str = "is_correct") -> DataFrame:
    """The k groups of least accuracy, larger ones first, then by name."""
    return accuracy_rows(df.where(F.col(correct).isNotNull()), keys, correct).orderBy("accuracy", F.desc("n"), *keys).limit(k)


def group_accuracy(df: DataFrame, keys: list[str], correct: str = "is_correct") -> DataFrame:
    """Every row with its group's accuracy; groups without evaluated rows have 0."""
    w = W.partitionBy(*keys)
    return df.withColumn("group_accuracy", F.coalesce(F.avg(F.col(correct).cast("double")).over(w), F.lit(0.0)))


def reason_counts(df: DataFrame, reasons: str) -> DataFrame:
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def summary_lines(df: DataFrame, keys: list[str], correct: str = "is_correct") -> DataFrame:
    """One text line a group, its name and accuracy."""
    x = accuracy_rows(df, keys, correct)
    return x.select(F.format_string("%s: %.3f (%d)", F.concat_ws(" || ", *keys), F.coalesce("accuracy", F.lit(0.0)), F.col("n")).alias("line"))


def sum_maps(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Entry-wise sums of a map column: (keys, key, n)."""
    return df.select(*keys, F.explode(column).alias("key", "value")).groupBy(*keys, "key").agg(F.sum("value").alias("n"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and of ``old`` those whose key is not in it."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def last_by_key(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Of equal keys the last row."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("_r")).select(*keys, *[F.col(f"_r.{c}") for c in rest])


def valid_prefix(df: DataFrame, group: list[str], position: str, valid: Column) -> DataFrame:
    """Rows before the first invalid one of their group."""
    w = W.partitionBy(*group)
    return df.withColumn("_bad", F.min(F.when(~valid, F.col(position))).over(w)).where(F.col("_bad").isNull() | (F.col(position) < F.col("_bad"))).drop("_bad")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats included."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def missing_pairs(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(observed.select(*keys).distinct(), keys, "left_anti")


def new_texts(candidates: DataFrame, seen: DataFrame, text: Column, seen_text: Column, position: str) -> DataFrame:
    """Candidates whose text was not seen before, the first of equal ones."""
    fresh = candidates.withColumn("_t", text).join(seen.select(seen_text.alias("_t")).distinct(), "_t", "left_anti")
    return fresh.withColumn("_n", F.row_number().over(W.partitionBy("_t").orderBy(position))).where("_n = 1").drop("_n", "_t")


def with_fallback(plan: DataFrame, pool: DataFrame, fine: str, coarse: str, k: int, order: list[Column]) -> DataFrame:
    """For each plan row up to k pool rows of its fine key, or of its coarse key where the fine one has none."""
    by = lambda key: pool.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_n") <= k)
    have = pool.select(F.col(fine).alias("_f")).distinct().withColumn("_has", F.lit(True))
    p = plan.join(have, plan[fine] == have["_f"], "left").drop("_f")
    rest = [c for c in pool.columns if c not in (fine, coarse)]
    near = p.where("_has").drop("_has").join(by(fine).select(fine, *rest, "_n"), fine).withColumn("matched_on", F.lit(fine))
    far = p.where("_has IS NULL").drop("_has").join(by(coarse).select(coarse, *rest, "_n"), coarse).withColumn("matched_on", F.lit(coarse))
    return near.unionByName(far).withColumnRenamed("_n", "rank")
