"""What the operators of this subpackage share: tables, the shared scratch folder, Arrow batches and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker looks at in one go; larger Arrow batches are cut into such slices.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch between the JVM and a worker; a row is never cut.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Documents that come in fewer splits than there are cores are dealt to all of them, since work on a
    text costs far more than moving it; inputs of many splits are left as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df._jdf.rdd().getNumPartitions() < cores else df


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where it is unset and the
    master is local, since no other machine could read it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's Arrow batches are held to ``BATCH_BYTES``: rows are whole texts, and the default of 64 MB
    a batch, buffered on both sides of the pipe, would fill an executor."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    if conf.get(key) != f"{BATCH_BYTES}b":
        conf.set(key, f"{BATCH_BYTES}b")
    return df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def staged(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: later plans restart from files that any
    executor can read, so a lost executor never repeats what stands above, and lineage is cut."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the strings of ``column`` in each piece hold at most ``limit`` bytes (or are one row)."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end
    pa.default_memory_pool().release_unused()


def strings(column: pa.Array) -> pa.Array:
    """The column as large strings, null as the empty string, with buffers of its own rows only: some Arrow kernels go
    wrong where the first offset isn't 0."""
    import numpy as np
    import pyarrow.compute as pc

    full = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = full.buffers()
    at = np.frombuffer(ends, np.int64)[full.offset : full.offset + len(full) + 1]
    if not len(at) or data is None:
        return pa.array([""] * len(full), pa.large_string())
    return pa.Array.from_buffers(pa.large_string(), len(full), [None, pa.py_buffer(at - at[0]), data.slice(int(at[0]), int(at[-1] - at[0]))])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: any orderable type) by alternating large-star and small-star
    rounds (Kiveris et al. 2014). Returns (id, root) with root the smallest id reachable, one row per id in
    an edge. Each round is two aggregations with map-side combine and two joins that AQE splits where a hub is
    hot; nothing is collected but one count and checksum a round, and lineage is cut by writing each round."""
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*").alias("n"), F.expr("sum(cast(xxhash64(u, v) % 1000000007 AS decimal(38)))").alias("h")).first()
        if state["n"] == 0 or before == (state["n"], state["h"]):
            break
        before = (state["n"], state["h"])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e")).select("e.u", F.col("e.m").alias("v"))
        after = staged(small.where("u <> v").distinct(), "edges")
        discard(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    stars = now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("id"), "root").distinct())
