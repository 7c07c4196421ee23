"""Every registered query against its SQL twin."""

import math
import os

import duckdb
import pytest

from docmill.operators import blocks, catalog, checks, chunks, disk, document_packages, documents, folder_packs, history, media, naming, pack_files, packs, previews, records, rules, tasks, versions  # noqa: F401
from docmill.registry import REGISTRY, query
from docmill.sources import convert, office_media, settings  # noqa: F401

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_equals_sql(spark, duck, name):
    df = REGISTRY[name].build(spark, SF)
    want = duck.sql(REGISTRY[name].sql)
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    a = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert len(a) == len(b) > 0
    assert [(x, y) for x, y in zip(a, b) if x != y][:3] == []


def test_names_are_taken_once():
    with pytest.raises(ValueError, match="already"):
        query("token_estimate")(lambda s, d: None)
