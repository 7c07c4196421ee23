"""Tables in the folder that the driver and all executors share: what several parts of a plan read is computed once, and lost executors cost no recomputation."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine if driver and executors are one process, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="docmill-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores by its keys, for what costs far more time a row than its bytes tell: readers and adaptive execution share out work by bytes alone, so a
    small file, or one that compresses well, would be one task's. A table stored behind it is read by as many tasks again."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


#: The paths made within scratch(), if one is open.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_place(spark: SparkSession, tag: str) -> str:
    """A path of its own for a table or for files in the shared folder."""
    path = f"{shared_folder(spark)}/docmill/{tag}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was stored within: nothing built there may be read later but what is stored by then at a path made before."""
    token = _MADE.set([])
    try:
        yield
    finally:
        made = _MADE.get()
        _MADE.reset(token)
        discard(spark, *made)


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """df, written as Parquet to path and read back. The files of its shuffles go with the end of the write: else they stay until the driver's garbage is
    collected, and the disk holds those of all steps at once."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back, so lost executors cost no recomputation."""
    return stored_at(df, new_place(df.sparkSession, tag))
