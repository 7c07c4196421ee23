"""Versions in order, releases passed over; disk need of roots on volumes."""

import itertools

from pyspark.sql import functions as F

from docmill.operators import disk
from docmill.operators import versions as V

ORDERED = ["0.9", "1.0.dev1", "1.0a1", "1.0-beta.2", "1.0b10", "1.0-rc.1.dev3", "1.0-rc.1", "v1.0c2", "1.0.0", "1.0+abc", "1.0+1", "1.0.post0.dev1", "1.0-1", "1.0.post2", "1.0.1", "1.2.0-rc.1", "1.2.0", "1.10", "2024.1", "1!0.1"]


def test_order(spark):
    rows = spark.createDataFrame(list(enumerate(ORDERED)), "place long, tag string")
    assert [r.tag for r in rows.repartition(3).orderBy(V.version_key(F.col("tag"))).collect()] == ORDERED
    same = [("1.0", "1.0.0"), ("v1", "1.0.0.0"), ("1.0RC1", "1.0-rc.1"), ("1.0.rev3", "1.0-3"), ("1.0a", "1.0alpha0"), (" 2.0 ", "2")]
    assert spark.createDataFrame(same, "a string, b string").filter(V.version_key(F.col("a")) == V.version_key(F.col("b"))).count() == len(same)
    bad = ["", "x", "1.", "1..2", "nightly", "1.0-rc-x", None, "9" * 30]
    assert spark.createDataFrame([(b,) for b in bad], "a string").filter(V.version_key(F.col("a")).isNotNull()).count() == 0


def test_newest(spark):
    rows = [("p", "1.2.0-rc.1", None), ("p", "v1.2.0", True), ("p", "junk", False), ("q", "1.2.0-rc.1", False), ("q", "1.2.0", False), ("r", "1.1", False), ("s", None, None)]
    got = V.newest_release(spark.createDataFrame(rows, "product string, tag string, draft boolean"), F.lit("1.1.0"))
    assert {r.product: r.tag for r in got.collect()} == {"p": "1.2.0-rc.1", "q": "1.2.0"}
    assert V.newest_release(spark.createDataFrame(rows, "product string, tag string, draft boolean"), F.lit("1.2.0")).collect() == []


def test_disk(spark, tmp_path):
    jobs = spark.createDataFrame([("a", "/x/y/z", 100, "TO_PDF"), ("a", "/x/other/", 1, "RENAME_VIDEO"), ("b", "/x/y", 10, "TO_PDF"), ("b", "/q", None, "TO_PDF"), ("c", "/x/yy", 3, "EXTRACT_AUDIO")], "batch string, root string, bytes long, operation string")
    folders = spark.createDataFrame([("/x", "v", 500), ("/x/y/", "w", 400), ("/x/other", "v", 500)], "path string, volume string, free long")
    got = {r.batch: tuple(r)[1:] for r in disk.assess(jobs, folders, 10).collect()}
    assert got == {"a": (151, 2, 400, 239, False), "b": (16, 1, 0, -26, True), "c": (2, 1, 500, 488, False)}
    made = disk.volumes(spark, [f"file://{tmp_path}", f"file://{tmp_path}/none"]).collect()
    assert [r.path for r in made] == [f"file://{tmp_path}"] and made[0].free > 0
    assert disk.assess(jobs.limit(0), folders).collect() == [] and len(list(itertools.chain(disk.FACTORS))) == 9
