"""Event streams: windows with watermarks, idempotent ledgers, the lifecycle of hard samples, cooldowns and budget caps.

Each function takes a streaming (or static) DataFrame and returns one; ``finished`` runs a stream over what is there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.common import shared_folder

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, schema: str = EVENTS, kind: str = "parquet", files_per_batch: int = 1_000, glob: str | None = None) -> DataFrame:
    r = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


def finished(stream: DataFrame, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all available input and returns the rows of its result table, from files in the shared folder: the
    last batch's in complete mode, else those of all batches. Each batch writes a folder named by its number, so a batch that is
    delivered twice leaves one copy; nothing is gathered on the driver."""
    spark = stream.sparkSession
    top = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    written: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/{number:09d}")
        written.append(number)

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint or f"{top}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    wanted = sorted(set(written))[-1:] if mode == "complete" else sorted(set(written))
    if not wanted:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{top}/{number:09d}" for number in wanted])


def tumbling(events: DataFrame, size: str, keys: list[str], late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sliding(events: DataFrame, size: str, slide: str, keys: list[str], late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("window_start"), *keys, "n", "mean")


def sessions(events: DataFrame, gap: str, keys: list[str], late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n", "total")


def once(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Repeated deliveries within the watermark count once."""
    x = events.withWatermark("ts", late)
    return x.dropDuplicatesWithinWatermark(keys) if events.isStreaming else x.dropDuplicates(keys)


def ledger(events: DataFrame, keys: list[str], tokens, late: str = "60 days") -> DataFrame:
    """Running totals of an idempotent ledger; a repeated event_id counts once while it comes within ``late``, so the state
    holds the keys' totals and the ids of that time only."""
    x = once(events, ["event_id"], late).withColumn("_t", tokens)
    return x.groupBy(*keys).agg(F.count("*").alias("events"), F.sum("_t").alias("tokens"), F.max("_t").alias("peak_tokens"))


def daily_weighted(events: DataFrame, keys: list[str], decay: float, last_day: str) -> DataFrame:
    """Counts of daily windows, decayed by their age in days."""
    x = events.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), *keys).agg(F.count("*").alias("n"))
    age = F.datediff(F.to_date(F.lit(last_day)), F.to_date("window.start"))
    return x.select(F.to_date("window.start").alias("day"), *keys, "n", (F.col("n") * F.exp(-decay * age)).alias("weighted"))


def _sorted(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    x = pd.concat(list(parts), ignore_index=True)
    return x.sort_values(["ts", "event_id"], kind="stable")


def lifecycle(outcomes: DataFrame, key: str, master: int = 2) -> DataFrame:
    """(key, state, streak, failures, tests) after each batch, of outcomes (key, ts, event_id, is_correct): right answers
    in a row master a sample, a wrong one makes it active again. Deliveries at or before the last one seen are ignored."""

    def run(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, failures, tests, at, last = state.get if state.exists else (0, 0, 0, pd.Timestamp(0).value, -1)
        for ts, event, ok in _sorted(parts)[["ts", "event_id", "is_correct"]].itertuples(index=False):
            if (ts.value, event) <= (at, last):
                continue
            at, last, tests = ts.value, event, tests + 1
            streak, failures = (streak + 1, failures) if ok else (0, failures + 1)
        state.update((int(streak), int(failures), int(tests), int(at), int(last)))
        yield pd.DataFrame({key: [k[0]], "state": ["mastered" if streak >= master else "active"], "streak": [streak], "failures": [failures], "tests": [tests]})

    kind = outcomes.schema[key].dataType.simpleString()
    return outcomes.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, state string, streak long, failures long, tests long", "streak long, failures long, tests long, at long, last long", "update", GroupStateTimeout.NoTimeout)


def cooldown(results: DataFrame, key: str, misses: int = 3, rounds: int = 2) -> DataFrame:
    """(key, event_id, blocked) for each round of a group: after ``misses`` fruitless rounds in a row it is blocked for the
    next ``rounds``. Deliveries at or before the last one seen are ignored, so a repeated one counts once."""

    def run(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        missed, wait, at, last = state.get if state.exists else (0, 0, pd.Timestamp(0).value, -1)
        out = []
        for ts, event, fruitful in _sorted(parts)[["ts", "event_id", "fruitful"]].itertuples(index=False):
            if (ts.value, event) <= (at, last):
                continue
            at, last = ts.value, event
            out.append((k[0], event, wait > 0))
            if wait > 0:
                wait -= 1
                continue
            missed = 0 if fruitful else missed + 1
            if missed >= misses:
                missed, wait = 0, rounds
        state.update((int(missed), int(wait), int(at), int(last)))
        yield pd.DataFrame(out, columns=[key, "event_id", "blocked"])

    kind = results.schema[key].dataType.simpleString()
    return results.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id long, blocked boolean", "missed long, wait long, at long, last long", "append", GroupStateTimeout.NoTimeout)


def budget_cap(calls: DataFrame, key: str, tokens: str, cap: int) -> DataFrame:
    """(key, event_id, admitted, used): a call is admitted while its tokens still fit under the cap. Deliveries at or
    before the last one seen are ignored, so a repeated one counts once."""

    def run(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, at, last = state.get if state.exists else (0, pd.Timestamp(0).value, -1)
        out = []
        for ts, event, t in _sorted(parts)[["ts", "event_id", tokens]].itertuples(index=False):
            if (ts.value, event) <= (at, last):
                continue
            at, last = ts.value, event
            fits = used + t <= cap
            used += int(t) if fits else 0
            out.append((k[0], event, fits, used))
        state.update((int(used), int(at), int(last)))
        yield pd.DataFrame(out, columns=[key, "event_id", "admitted", "used"])

    kind = calls.schema[key].dataType.simpleString()
    return calls.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id long, admitted boolean, used long", "used long, at long, last long", "append", GroupStateTimeout.NoTimeout)


def upsert_sink(stream: DataFrame, path: str, checkpoint: str):
    """A stream that writes each batch to the folder ``batch=N`` of its number, so that a batch delivered twice leaves one copy and
    no batch touches what another wrote; ``upserted`` reads the result."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key that ``upsert_sink`` wrote: of the latest batch, and there by ``order``."""
    x = spark.read.parquet(path)
    names = [n for n in x.columns if n != "batch"]
    last = x.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct("batch", *order)).alias("_last"))
    return last.select("_last.*")
