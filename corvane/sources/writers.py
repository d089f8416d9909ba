"""Sinks. Spark's commit protocol makes a folder appear whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def publish(df: DataFrame, path: str, key: str) -> dict:
    """Writes an immutable JSON set; an existing one is an error. Returns its manifest: rows and a hash of all of them."""
    df.write.mode("errorifexists").json(path)
    return manifest(df, key)


def manifest(df: DataFrame, key: str) -> dict:
    """Row count and an order-independent digest: the hash of the sum of row hashes, so that no row order is needed."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    r = df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("keys"), F.sum(row).alias("h")).first()
    import hashlib

    return {"rows": r["n"], "keys": r["keys"], "sha256": hashlib.sha256(f"{r['n']}|{r['h']}".encode()).hexdigest()}


def alpaca(df: DataFrame, path: str) -> None:
    """Three fields a line; metadata is left out."""
    df.select("instruction", "input", "output").write.mode("errorifexists").json(path)


def splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("errorifexists").partitionBy(split).json(path)


def tables(frames: dict[str, DataFrame], path: str) -> None:
    """Small result tables, a CSV folder each."""
    for name, df in frames.items():
        df.coalesce(1).write.mode("overwrite").csv(f"{path}/{name}", header=True)


def blinded(df: DataFrame, path: str, key: str, hidden: list[str], reviewers: tuple[str, ...] = ("one", "two"), seed: int = 42) -> None:
    """A packet for each reviewer in an order of its own, without the hidden columns, which go to a sealed folder."""
    for who in reviewers:
        order = F.sha2(F.concat_ws("|", F.lit(f"{seed}:{who}"), F.col(key).cast("string")), 256)
        df.drop(*hidden).orderBy(order).coalesce(1).write.mode("errorifexists").csv(f"{path}/{who}", header=True)
    df.select(key, *hidden).write.mode("errorifexists").json(f"{path}/sealed")


def by_cycle(df: DataFrame, path: str, cycle: int, iteration: int) -> None:
    """Rows of one iteration; delivering it again replaces it and nothing else."""
    out = df.withColumns({"cycle_id": F.lit(cycle), "iteration_id": F.lit(iteration)})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cycle_id", "iteration_id").parquet(path)
