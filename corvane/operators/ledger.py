"""The budget ledger as an event table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(events: DataFrame, keys: list[str], section: str, tokens: str, cost_rate: float | None = None) -> DataFrame:
    """By run and section: events, tokens, largest single event, and the cost where a rate per million is known. Events
    with a repeated event_id count once."""
    once = events.dropDuplicates(["event_id"])
    x = once.groupBy(*keys, section).agg(F.count("*").alias("events"), F.sum(tokens).alias("tokens"), F.max(tokens).alias("peak_tokens"))
    cost = F.col("tokens") / 1e6 * cost_rate if cost_rate is not None else F.lit(None).cast("double")
    return x.withColumn("cost", cost)


def efficiency(totals: DataFrame, gain: str, tokens: str, hours: str) -> DataFrame:
    """Gain per thousand tokens and per hour, and what the cost figures are worth."""
    return totals.withColumns({"gain_per_1k_tokens": F.try_divide(F.col(gain), F.col(tokens) / 1000), "gain_per_hour": F.try_divide(F.col(gain), F.col(hours))})


def cost_quality(exact: str, estimated: str):
    """exact, estimated, mixed or no_token_calls by the numbers of measured and estimated calls."""
    e, s = F.coalesce(F.col(exact), F.lit(0)), F.coalesce(F.col(estimated), F.lit(0))
    return F.when((e == 0) & (s == 0), "no_token_calls").when(s == 0, "exact").when(e == 0, "estimated").otherwise("mixed")


def capped(events: DataFrame, keys: list[str], order: list[str], tokens: str, cap: int) -> DataFrame:
    """Reservation against a hard cap: an event is admitted while its tokens and those of the admitted ones before it stay
    within, so a refused event blocks no later one that still fits. Adds running_tokens (the admitted so far, null: none
    asked for) and admitted. What was admitted decides what comes next, so a key's events are read in order by one task, a
    batch at a time, with one number as state."""
    names = events.columns
    at = [names.index(k) for k in keys]
    kind = events.withColumns({"running_tokens": F.lit(0).cast("long"), "admitted": F.lit(True)}).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = None, 0
        for batch in batches:
            mine = zip(*[batch.column(i).to_pylist() for i in at], strict=True) if at else [()] * batch.num_rows
            sums, fits = [], []
            for key, t in zip(mine, batch.column(names.index(tokens)).to_pylist(), strict=True):
                if key != now:
                    now, used = key, 0
                fits.append(used + (t or 0) <= cap)
                used += (t or 0) if fits[-1] else 0
                sums.append(used)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64()), pa.array(fits, pa.bool_())], [*names, "running_tokens", "admitted"])

    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return events.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kind)
