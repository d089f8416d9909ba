"""Sampling, splitting and budgets of training rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def stable_rank(seed: int | str, value: Column) -> Column:
    """A hash that orders rows alike on every machine."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), value.cast("string")), 256)


def fold(value: Column, k: int) -> Column:
    """Deterministic fold of the JSON-quoted id."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit('"'), value.cast("string"), F.lit('"')), 256), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")


def first_per_bucket(df: DataFrame, bucket: list[str], n: int, order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*bucket).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def round_robin(df: DataFrame, stratum: list[str], order: Column, k: int) -> DataFrame:
    """k rows, one of each stratum in turn, rarer strata first, with inverse-probability weights."""
    w = W.partitionBy(*stratum)
    x = df.withColumns({"_turn": F.row_number().over(w.orderBy(order)), "_size": F.count("*").over(w)})
    chosen = x.orderBy("_turn", "_size", *stratum).limit(k)
    taken = F.count("*").over(w)
    y = chosen.withColumn("selection_probability", taken / F.col("_size"))
    return y.withColumn("sample_weight", 1 / F.col("selection_probability")).drop("_turn", "_size")


def _cost(counts: list[dict], size: dict, split: int, fractions: list[float], totals: dict, n: int) -> float:
    cost = 0.0
    for k, f in enumerate(fractions):
        target = f * n
        c = counts[k]["_n"] + (size["_n"] if k == split else 0)
        cost += ((c - target) / max(target, 1)) ** 2
        for key, total in totals.items():
            cur = counts[k].get(key, 0) + (size.get(key, 0) if k == split else 0)
            cost += 0.04 * ((cur - f * total) / max(f * total, 1)) ** 2
    return cost


def cluster_split(df: DataFrame, cluster: str, balance: list[str], seed: int = 42, splits=SPLITS) -> DataFrame:
    """Adds ``split`` so that a cluster is in one split only and sizes and ``balance`` columns are near the fractions.

    The greedy assignment needs clusters in order, so it runs over cluster counts in one task of bounded size: one row a
    cluster and balance value, not the rows themselves. Fewer than three clusters are an error."""
    import hashlib

    sizes = df.groupBy(cluster).agg(F.count("*").alias("n"))
    parts = None
    for b in balance:
        p = df.groupBy(cluster, F.concat(F.lit(f"{b}="), F.coalesce(F.col(b).cast("string"), F.lit(""))).alias("key")).agg(F.count("*").alias("n"))
        parts = p if parts is None else parts.unionByName(p)
    rows = sizes.select(cluster, F.lit("_n").alias("key"), "n")
    rows = rows.unionByName(parts) if parts is not None else rows
    names, fractions = [s for s, _ in splits], [f for _, f in splits]

    def run(x: pd.DataFrame) -> pd.DataFrame:
        by: dict = {}
        totals: dict = {}
        for c, key, n in zip(x[cluster], x["key"], x["n"], strict=True):
            by.setdefault(c, {})[key] = int(n)
            totals[key] = totals.get(key, 0) + int(n)
        n = totals.pop("_n")
        if len(by) < len(names):
            raise ValueError("fewer clusters than splits")
        digest = lambda *p: hashlib.sha256("|".join(map(str, p)).encode()).hexdigest()
        order = sorted(by, key=lambda c: (-by[c]["_n"], digest(seed, c)))
        counts: list[dict] = [{"_n": 0} for _ in names]
        out = []
        for left, c in zip(range(len(order), 0, -1), order, strict=True):
            empty = [k for k in range(len(names)) if not counts[k]["_n"]]
            choice = empty if len(empty) == left else range(len(names))
            best = min(choice, key=lambda k: (_cost(counts, by[c], k, fractions, totals, n), digest(seed, c, names[k])))
            for key, v in by[c].items():
                counts[best][key] = counts[best].get(key, 0) + v
            out.append((c, names[best]))
        return pd.DataFrame(out, columns=[cluster, "split"])

    kind = rows.schema[cluster].dataType.simpleString()
    assigned = rows.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(run, f"{cluster} {kind}, split string")
    return df.join(assigned, cluster)


def split_overlap(df: DataFrame, cluster: str, split: str = "split") -> DataFrame:
    """Clusters that are in several splits."""
    return df.groupBy(cluster).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def split_manifest(df: DataFrame, dimensions: list[str], split: str = "split") -> DataFrame:
    """(split, dimension, value, n) for every dimension."""
    x = df.select(split, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("e"))
    return x.groupBy(split, "e.dimension", "e.value").agg(F.count("*").alias("n"))


def token_budget(df: DataFrame, stratum: list[str], order: Column, tokens: str, budget: int) -> DataFrame:
    """Rows in turn over the strata while the budget lasts; one that would overflow is left out and the next one tried.
    Rows that can't fit are dropped at once, and the skipping pass streams (order, tokens) pairs in one sorted task."""
    w = W.partitionBy(*stratum)
    x = df.where(F.col(tokens) <= budget).withColumns({"_turn": F.row_number().over(w.orderBy(order)), "_size": F.count("*").over(w)})

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used = 0
        for part in it:
            keep = []
            for t in part[tokens]:
                fits = used + t <= budget
                used += t if fits else 0
                keep.append(fits)
            yield part[keep]

    ordered = x.repartition(1).sortWithinPartitions("_turn", "_size", *stratum)
    return ordered.mapInPandas(run, ordered.schema).drop("_turn", "_size")


def ratio_train(df: DataFrame, correct: str, order: Column, share: float) -> DataFrame:
    """The largest part of ``df`` whose share of correct rows is ``share``."""
    from math import gcd

    n = {r[0]: r[1] for r in df.groupBy(correct).count().collect()}
    a = round(share * 1000)
    g = gcd(a, 1000)
    a, b = a // g, 1000 // g
    blocks = min(n.get(True, 0) // a if a else 10**18, n.get(False, 0) // (b - a) if b > a else 10**18)
    want = F.when(F.col(correct), blocks * a).otherwise(blocks * (b - a))
    return df.withColumn("_n", F.row_number().over(W.partitionBy(correct).orderBy(order))).where(F.col("_n") <= want).drop("_n")


def diverse(df: DataFrame, bucket: list[str], key: str, features: list[str], template: str, n: int, per_template: int = 2) -> DataFrame:
    """n rows of each bucket, those first that bring most unseen feature values; at most ``per_template`` of a template.
    Buckets are the groups of a taxonomy and run side by side."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(key, kind="stable").reset_index(drop=True)
        seen: set = set()
        used: dict = {}
        left = list(range(len(x)))
        cols = {f: x[f].tolist() for f in features}
        tpl = x[template].tolist()
        chosen = []
        while left and len(chosen) < n:
            left = [i for i in left if used.get(tpl[i], 0) < per_template]
            if not left:
                break
            best = min(left, key=lambda i: (-sum((f, cols[f][i]) not in seen for f in features), i))
            chosen.append(best)
            left.remove(best)
            seen |= {(f, cols[f][best]) for f in features}
            used[tpl[best]] = used.get(tpl[best], 0) + 1
        return x.iloc[chosen]

    return df.groupBy(*bucket).applyInPandas(run, df.schema)
