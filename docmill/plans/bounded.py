"""Jobs with an end: cancelled by a flag or at a deadline, with all Spark jobs that they started."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

Result = TypeVar("Result")
POLL = 0.1  # seconds between looks at the flag


class Cancelled(Exception):
    """The caller asked for the end."""


def run(spark: SparkSession, job: Callable[[], Result], seconds: float | None = None, flag: threading.Event | None = None) -> Result:
    """job() and what it returns or raises; TimeoutError past the deadline, Cancelled once the flag is set.

    The job runs in a thread of its own whose Spark jobs carry a tag; all jobs with the tag are cancelled, again and again until the thread has ended, so when
    this returns nothing of it runs. What the job writes by part_files or by Spark's own writers appears whole or not at all.
    """
    tag = f"bounded-{uuid.uuid4().hex}"
    context, out, wrong = spark.sparkContext, [], []

    def work() -> None:
        context.addJobTag(tag)
        try:
            out.append(job())
        except BaseException as e:  # handed to the caller's thread
            wrong.append(e)

    thread = InheritableThread(target=work, session=spark)
    end = None if seconds is None else time.monotonic() + seconds
    stopped: Exception | None = None
    thread.start()
    while thread.is_alive():
        thread.join(POLL)
        if stopped is None and thread.is_alive():
            if flag is not None and flag.is_set():
                stopped = Cancelled("the job was cancelled")
            elif end is not None and time.monotonic() > end:
                stopped = TimeoutError(f"the job took more than {seconds} seconds")
        if stopped is not None:
            context.cancelJobsWithTag(tag)
    if stopped is not None:
        raise stopped from (wrong[0] if wrong else None)
    if wrong:
        raise wrong[0]
    return out[0]


def stop_at(query: StreamingQuery, seconds: float | None = None, flag: threading.Event | None = None) -> bool:
    """Waits for a stream; stops it at the deadline or once the flag is set. Whether it ended by itself; its own failure is raised."""
    end = None if seconds is None else time.monotonic() + seconds
    while query.isActive:
        if query.awaitTermination(POLL):
            return True
        if (flag is not None and flag.is_set()) or (end is not None and time.monotonic() > end):
            query.stop()
            return False
    query.awaitTermination(0)
    return True
