"""History on disk, spans from JSON, opening of sources."""

import datetime as dt

from pyspark.sql import functions as F

from docmill.operators import catalog as C


def test_history_round_trip(spark, tmp_path):
    at = dt.datetime(2024, 5, 6, 7, 8)
    rows = [("a", at, "pack", "success", "x", "o", 5, 90.0, 10, 1), ("a", at, "pack", "failed", "y", None, 7, None, None, None), ("b", at.replace(month=6), "pdf", "success", "x", "p", 1, None, None, None)]
    records = spark.createDataFrame(rows, C.RECORD)
    root = str(tmp_path / "h")
    C.write_history(records, root)
    C.write_history(records.filter("task_id = 'b'"), root)
    got = {r.task_id: r for r in C.read_history(spark, root).collect()}
    assert (got["a"].total, got["a"].success, got["a"].failed, got["a"].bytes, got["a"].sources, got["a"].outputs) == (2, 1, 1, 12, ["x", "y"], ["o"])
    assert got["b"].total == 2 and got["b"].sources == ["x"]
    assert (tmp_path / "h/year=2024/month=05").is_dir()
    used = C.usage(spark, root).collect()[0]
    assert used.files >= 3 and used.bytes > 100
    assert [r.task_id for r in C.without(records, spark.createDataFrame([("a",)], "task_id string")).collect()] == ["b"]
    assert C.entries(records.limit(0)).collect() == []


def test_spans_from_json(spark):
    rows = ['{"source_type":"page","ordinal":" 7 ","start_line":"3","end_line":"x","confidence":0.5}', "{broken", None, '{"source_type":"worksheet","label":""}']
    spans = spark.createDataFrame([(r,) for r in rows], "p string").select(C.span_of(F.col("p")).alias("s"))
    got = [(r.s.kind, r.s.label, r.s.ordinal, r.s.start_line, r.s.end_line, r.s.confidence) for r in spans.collect()]
    assert got[0] == ("page", "Document", 7, 3, 1, 0.5) and got[1] == got[2] == ("document", "Document", None, 1, 1, None)
    shown = [tuple(r.l)[:3] for r in spans.select(C.location(F.col("s")).alias("l")).collect()]
    assert shown == [("page", "PDF page 7", False), ("document", "Document level", True), ("document", "Document level", True), ("worksheet", "Document level", True)]


def test_capabilities_without_tools(spark):
    files = spark.createDataFrame([("a", ".MP4", None), ("b", None, ["ffmpeg"]), ("c", ".doc", [])], "path string, suffix string, tools array<string>")
    got = [(r.path, r.operation, r.available, r.reason) for r in C.capabilities(files).collect()]
    assert [g[1] for g in got if g[0] == "a" and g[2]] == ["rename_video", "organize_video"]
    assert ("c", "to_pdf", False, "needs winword or libreoffice") in got and not [g for g in got if g[0] == "b"]
