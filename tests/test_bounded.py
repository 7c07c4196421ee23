"""Jobs and streams that are ended: by a flag, by a deadline, by themselves."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from docmill.plans import bounded
from docmill.sources import part_files


def parts(spark, udf=False):
    def slow(frames):
        for frame in frames:
            time.sleep(60)
            yield frame

    rows = spark.range(8).repartition(4)
    rows = rows.mapInPandas(slow, "id long") if udf else rows
    return part_files.parts(rows, F.col("id"), "f", 0, F.lit("x"))


def test_results_and_faults_pass(spark):
    assert bounded.run(spark, lambda: spark.range(5).count(), 120) == 5
    with pytest.raises(KeyError):
        bounded.run(spark, lambda: {}["x"])


@pytest.mark.parametrize("how", ["deadline", "flag"])
def test_an_ended_write_leaves_no_output(spark, tmp_path, how):
    flag = threading.Event()
    began = time.monotonic()
    if how == "flag":
        threading.Timer(4, flag.set).start()
    with pytest.raises(TimeoutError if how == "deadline" else bounded.Cancelled):
        bounded.run(spark, lambda: part_files.write_files(parts(spark, udf=True), f"file://{tmp_path}/out"), 4 if how == "deadline" else None, flag)
    assert time.monotonic() - began < 40 and list(tmp_path.iterdir()) == []
    assert bounded.run(spark, lambda: part_files.write_files(parts(spark), f"file://{tmp_path}/out"), 120, threading.Event()) == (8, 16)
    assert spark.range(3).count() == 3  # jobs without the tag are left alone


def test_streams(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    stream = lambda **o: spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / f"c{len(o)}")).trigger(**o or {"processingTime": "1 second"}).start()
    assert bounded.stop_at(stream(availableNow=True), 120)
    query = stream()
    assert not bounded.stop_at(query, 3) and not query.isActive
