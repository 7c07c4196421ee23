"""Streams: folder intake, each file once, the state of tasks from their events, and their progress from the lines of their programs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docmill.operators.tasks import progress_percent
from docmill.sources.files import DOCUMENTS, VIDEOS

STEP = 5  # per cent that progress must have grown by to be stored again
TERMINAL = ("success", "failed", "cancelled")


def watch(spark: SparkSession, path: str, schema: str, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Rows of the Parquet files that arrive below a path; a key that comes again within the time for late rows is dropped."""
    return spark.readStream.schema(schema).parquet(path).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def watch_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = DOCUMENTS + VIDEOS, late: str = "1 hour", content: bool = False, depth: str = "") -> DataFrame:
    """path, name, suffix, bytes, modified (and content) of the files of these suffixes that arrive in a folder, each once, letter case aside: a file under
    another spelling of its path is dropped while the first one's modification time is within `late` of the newest; then its state expires. depth: "/*" for
    each level of folders below path."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path + depth)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("suffix"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    rows = rows.filter(F.col("suffix").isin(*["." + x.lower().lstrip(".") for x in suffixes])).withColumn("folded", F.lower("path"))
    return rows.withWatermark("modified", late).dropDuplicatesWithinWatermark(["folded"]).drop("folded")


def _stored(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    for frame in frames:
        frame = frame.sort_values("place")
        kept = []
        for value in frame["progress"]:
            new = last is None or value < last or value >= last + STEP
            last = value if new else last
            kept.append(new)
        yield frame[kept][["place", "progress"]].assign(task_id=key[0])[["task_id", "place", "progress"]]
    if last is not None:
        state.update((int(last),))


def progress_states(lines: DataFrame) -> DataFrame:
    """task_id, place, progress: the progress of tasks that is stored, from the lines (task_id, place, line, seconds: of the whole) that their programs write.

    Lines are parsed within the row; the state of a task is the one number that was stored last, so it may write any number of lines over any number of
    batches. A batch's lines of a task are taken in the order of place.
    """
    percent = progress_percent(F.col("line"), F.col("seconds"))
    rows = lines.select("task_id", "place", percent.alias("progress")).filter("progress is not null")
    return rows.groupBy("task_id").applyInPandasWithState(_stored, "task_id long, place long, progress long", "last long", "append", GroupStateTimeout.NoTimeout)


def counts(events: DataFrame, time: str, kind: str, width: str, late: str) -> DataFrame:
    """Counts by kind in tumbling windows; a window is given out once no more late rows are waited for."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, attempts = state.get if state.exists else ("waiting", 0)
    for frame in frames:
        for event in frame.sort_values("at")["event"]:
            if event == "start" and status == "waiting":
                status, attempts = "running", attempts + 1
            elif event in TERMINAL and status == "running":
                status = event
            elif event == "restart" and status == "running":
                status = "interrupted"
            elif event == "retry" and status in ("failed", "cancelled", "interrupted"):
                status = "waiting"
    state.update((status, attempts))
    yield pd.DataFrame({"task_id": [key[0]], "status": [status], "attempts": [attempts]})


def task_states(events: DataFrame) -> DataFrame:
    """task_id, status, attempts after each batch of events (task_id, at, event); events that a state does not allow change nothing."""
    return events.groupBy("task_id").applyInPandasWithState(_step, "task_id long, status string, attempts long", "status string, attempts long", "update", GroupStateTimeout.NoTimeout)
