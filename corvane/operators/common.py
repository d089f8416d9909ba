"""Lineage cuts and assertions that operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of its own only where none is set and the master
    is local."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc._jsc.sc().getCheckpointDir().get()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder, so that iterations keep short plans and survive lost executors."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def staged(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table of the shared folder, written once and read by all that follows."""
    at = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def require_none(df: DataFrame, message: str) -> None:
    """Raises if ``df`` has rows, naming a few."""
    if rows := df.limit(3).collect():
        raise ValueError(f"{message}: {[r.asDict() for r in rows]}")


def present(values: Column) -> Column:
    """The non-null entries of an array."""
    return F.filter(values, lambda x: x.isNotNull())


def reasons(*cases: tuple[Column, str]) -> Column:
    """All codes whose condition holds, in order; a null condition does not hold."""
    return present(F.array(*[F.when(c, F.lit(code)) for c, code in cases]))
