"""Private paths in texts and in nested values."""

import pytest
from pyspark.sql import functions as F

from docmill.functions.text import OMITTED, private_path, redact, scrub

CASES = [
    ("see /home/ann/x.md, and", f"see {OMITTED} and"),
    ("(C:\\temp\\a) [d:/b]", f"({OMITTED}) [{OMITTED}]"),
    ('"FILE:///c:/a" \'/USERS/b\'', f'"{OMITTED}" \'{OMITTED}\''),
    ("\\\\srv\\share x", f"{OMITTED} x"),
    ("/home/ /homes/a /tmp C: c:x", "/home/ /homes/a /tmp C: c:x"),
    ("https://x/y", f"http{OMITTED}"),  # the pattern takes the s for a drive
    ("/var/tmp/a\u2003b", f"{OMITTED}\u2003b"),
]


@pytest.mark.parametrize("text, want", CASES)
def test_redact(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(private_path(F.col("t")), redact(F.col("t"))).first()
    assert tuple(row) == (want != text, want)


def test_scrub_nested(spark):
    schema = "w struct<code:string,n:int,where:array<struct<path:string>>,more:map<string,string>>"
    rows = [((("x", 1, [("/tmp/a",), (None,)], {"/tmp/k": "ok"}),),), ((("x", 2, None, None),),), (None,)]
    df = spark.createDataFrame([(r[0][0] if r[0] else None,) for r in rows], schema)
    value, changed = scrub(F.col("w"), df.schema["w"].dataType)
    got = df.select(value.alias("w"), changed.alias("c")).collect()
    assert [r.c for r in got] == [True, False, False] and got[2].w is None
    assert got[0].w.where[0].path == OMITTED and got[0].w.where[1].path is None and got[0].w.more == {"/tmp/k": "ok"} and got[1].w.n == 2
