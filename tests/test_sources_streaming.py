"""File discovery, pack reports and streams on small folders."""

import json

from pyspark.sql import functions as F

from docmill.operators.catalog import throttled
from docmill.operators.tasks import progress_percent
from docmill.sources import files
from docmill.streaming import intake


def test_discover_and_classify(spark, tmp_path):
    for name in ("a.PDF", "b/c.txt", "b/d.mp4", "e.exe"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * len(name))
    rows = files.classify(files.discover(spark, str(tmp_path), suffixes=files.DOCUMENTS + files.VIDEOS)).collect()
    assert sorted((r.name, r.suffix, r.bytes, r.workspace) for r in rows) == [("a.PDF", ".pdf", 5, "documents"), ("c.txt", ".txt", 7, "documents"), ("d.mp4", ".mp4", 7, "videos")]


def test_pack_reports(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"requested_tokens": 32000, "sources": [{"id": "1"}] * 3, "packs": [{"over_budget": True}, {"over_budget": False}]}))
    (tmp_path / "b.json").write_text("{not json")
    (tmp_path / "c.json").write_text(json.dumps({"requested_tokens": "1500", "packs": []}))
    got = {r.path[-6:]: (r.n_sources, r.n_packs, r.overflow, r.label, r.status) for r in files.read_pack_reports(spark, str(tmp_path)).collect()}
    assert got == {"a.json": (3, 2, 1, "32K context window", "over_budget"), "b.json": (0, 0, 0, "No limit", "no_limit"), "c.json": (0, 0, 0, "1,500 estimated tokens", "within_budget")}


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_streams(spark, tmp_path):
    rows = [(1, "start"), (1, "success"), (2, "start"), (2, "restart"), (2, "retry"), (2, "start"), (3, "success"), (1, "start")]
    df = spark.createDataFrame([(k, t, f"2024-01-01 00:00:{k:02d}", e) for k, (t, e) in enumerate(rows)], "id long, task_id long, at string, event string").selectExpr("id", "task_id", "cast(at as timestamp) at", "event")
    df.unionByName(df.limit(2)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = intake.watch(spark, str(tmp_path / "in"), df.schema, "id", "at")
    run(stream, "seen", "append")
    assert spark.table("seen").count() == len(rows)
    run(intake.task_states(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "states", "update")
    assert {r.task_id: (r.status, r.attempts) for r in spark.table("states").collect()} == {1: ("success", 1), 2: ("running", 2), 3: ("waiting", 0)}


def test_files_arrive_once(spark, tmp_path):
    """The same path under two spellings, in two batches, arrives once; other suffixes don't; contents come where asked for."""
    folder = tmp_path / "in"
    folder.mkdir()
    out, seen = str(tmp_path / "out"), lambda: sorted((r.name, r.bytes, bytes(r.content)) for r in spark.read.parquet(out).collect())

    def step():
        stream = intake.watch_files(spark, str(folder), suffixes=("md", ".PDF"), content=True)
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", out).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)

    (folder / "Notes.md").write_text("one")
    (folder / "b.exe").write_text("no")
    step()
    assert seen() == [("Notes.md", 3, b"one")]
    (folder / "NOTES.md").write_text("again")
    (folder / "c.pdf").write_text("new")
    step()
    assert seen() == [("Notes.md", 3, b"one"), ("c.pdf", 3, b"new")]


def test_progress_stream_equals_the_batch(spark, tmp_path):
    """Lines over three batches: what is stored is what the throttle of all of them stores."""
    rows = [(t, p, "progress=end" if p == 59 else f"out_time_us={(p * 37 + t) % 60 * 100_000}" if p % 4 else f"frame={p}") for t in range(5) for p in range(60)]
    lines = spark.createDataFrame(rows, "task_id long, place long, line string").selectExpr("*", "6D AS seconds")
    for k in range(3):
        lines.filter(f"place div 20 = {k}").coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = spark.readStream.schema("task_id long, place long, line string, seconds double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))
    run(intake.progress_states(stream), "progress", "append")
    got = sorted((r.task_id, r.place, r.progress) for r in spark.table("progress").collect())
    percent = lines.select(F.lit(0).cast("long").alias("user_id"), "task_id", "place", progress_percent(F.col("line"), F.col("seconds")).alias("progress")).filter("progress is not null")
    batch = throttled(percent.select(F.col("task_id").alias("user_id"), F.col("place").alias("task_id"), "progress")).filter("stored")
    assert got == sorted((r.user_id, r.task_id, r.progress) for r in batch.collect()) and len(got) > 50
