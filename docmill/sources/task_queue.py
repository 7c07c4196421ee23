"""A queue of tasks as a folder of versions: each save is a new version that appears whole; a version that can't be read is set aside."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
# The statuses that a task may have.
STATUSES = ("waiting", "running", "success", "failed", "cancelled", "interrupted")
INTERRUPTED = "上次运行被中断"
SAFE_TO_RETRY = "应用在任务运行期间退出；可以安全重试。"

TASK = "task_id string, source string, operation string, output_root string, sources array<string>, context_budget long, context_ocr_enabled boolean, location string, project string, status string, progress int, attempts int, error string, output string, message string, created_at timestamp, updated_at timestamp, started_at timestamp, finished_at timestamp"
_NEEDED = ("task_id", "source", "operation", "output_root", "created_at", "updated_at")


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, path: str) -> list[str]:
    fs, at = _folder(spark, path)
    if not fs.exists(at):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith("v-"))


def save(tasks: DataFrame, path: str) -> str:
    """Writes tasks (the columns of TASK, or some of them) as the newest version of the queue at path and returns its name."""
    spark = tasks.sparkSession
    have = set(tasks.columns)
    fields = [f.split(" ", 1) for f in TASK.split(", ")]
    rows = tasks.select(F.lit(SCHEMA_VERSION).alias("schema_version"), *[F.col(n) if n in have else F.lit(None).cast(kind).alias(n) for n, kind in fields])
    version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    beside = f"{path}/.{version}"
    rows.write.option("ignoreNullFields", False).json(beside)
    fs, target = _folder(spark, f"{path}/{version}")
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), target):
        raise OSError(f"the queue could not be saved: {path}")
    return version


def load(spark: SparkSession, path: str, recover: bool = False) -> DataFrame:
    """The tasks of the newest version; none where there is no queue.

    A version with a line that is no task of this schema is renamed to corrupt-… and gives no tasks. With recover, running tasks count as interrupted, at 99
    per cent at most, and if there are any the queue is saved again.
    """
    versions = _versions(spark, path)
    empty = spark.createDataFrame([], TASK)
    if not versions:
        return empty
    rows = spark.read.schema(f"schema_version int, {TASK}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(f"{path}/{versions[-1]}")
    unfit = F.col("_bad").isNotNull() | (F.coalesce("schema_version", F.lit(0)) != SCHEMA_VERSION) | ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(True))
    for name in _NEEDED:
        unfit = unfit | F.col(name).isNull()
    if rows.select(unfit.alias("unfit"), "_bad").filter("unfit").limit(1).count():
        fs, at = _folder(spark, f"{path}/{versions[-1]}")
        fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/corrupt-{versions[-1][2:]}"))
        return empty
    tasks = rows.drop("schema_version", "_bad").withColumn("status", F.coalesce("status", F.lit("waiting"))).na.fill(0, ["progress", "attempts"])
    if not recover:
        return tasks
    stopped = recovered(tasks)
    if tasks.filter("status = 'running'").isEmpty():
        return tasks
    save(stopped, path)
    return load(spark, path)


def recovered(tasks: DataFrame) -> DataFrame:
    """What was running when the program ended counts as interrupted."""
    running = F.col("status") == "running"
    changed = {"progress": F.least("progress", F.lit(99)), "error": F.lit(SAFE_TO_RETRY), "message": F.lit(INTERRUPTED), "updated_at": F.current_timestamp(), "status": F.lit("interrupted")}
    return tasks.select(*[F.when(running, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in tasks.columns])
