"""Context packs on hand-made sources: structural blocks, links, writing, reading back, copies."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docmill.operators import chunks, packs


def sources(spark):
    text = "# Title\n\nOne. Two `assets/x` [l](assets/a)\n\n| a | b |\n| 1 | 2 |\n\n```\n[k](assets/k)\n```\n"
    return spark.createDataFrame([(1, 1, "a.md", text), (1, 2, "b.md", "word " * 3000), (2, 1, "c.md", None)], "pack_job long, source_order long, display_name string, content string")


def test_budgets():
    assert packs.check_budget(None) is None and packs.check_budget(2000) == 1900
    with pytest.raises(ValueError):
        packs.check_budget(999)
    with pytest.raises(ValueError):
        chunks.check_limits(19, 100)


def test_pack_round_trip(spark, tmp_path):
    blocks = packs.source_blocks(sources(spark))
    packs.write_context_pack(blocks, 1000, str(tmp_path / "p"))
    assert {r.complete for r in spark.read.json(str(tmp_path / "p/integrity")).collect()} == {True}
    entries = packs.source_map(spark, str(tmp_path / "p"))
    assert entries.count() == blocks.count() and entries.filter(~F.col("verified")).isEmpty()
    pages = spark.read.parquet(str(tmp_path / "p/packs")).filter("pack_job = 1").orderBy("pack").collect()
    assert len(pages) == pages[0].n_packs > 3 and not any(p.over_budget for p in pages)
    assert pages[0].content.startswith(f"# Context Pack 1 of {len(pages)}\n\nEstimated tokens: ~{pages[0].estimated_tokens}\n")
    assert "[l](../sources/source-001/assets/a)" in pages[0].content and "`assets/x`" in pages[0].content and "[k](assets/k)" in pages[0].content
    with pytest.raises(PySparkException):
        packs.write_context_pack(blocks, 1000, str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p/packs"))
    text = packs.copy_text(p, "Copy").filter("pack_job = 1").collect()[0].text
    assert text.index("Context Pack 1 of") < text.index("Context Pack 2 of")
    with pytest.raises(PySparkException):
        packs.copy_text(p.unionAll(p), "Copy").collect()


def test_no_budget_is_one_pack(spark):
    blocks = packs.source_blocks(sources(spark))
    rows = packs.packs(blocks, packs.assign(blocks, None), None).collect()
    assert [(r.pack_job, r.pack, r.n_sources, r.over_budget) for r in rows] == [(1, 1, 2, False)]


def test_atomic_overflow_has_its_reason(spark):
    rows = spark.createDataFrame([(1, 1, "t.md", "| a |\n" * 2000)], "pack_job long, source_order long, display_name string, content string")
    blocks = packs.source_blocks(rows)
    assert [r.overflow_reason for r in packs.packs(blocks, packs.assign(blocks, 1000), 1000).collect()] == [packs.ATOMIC_REASON]


def test_chunks_of_empty_and_headed_documents(spark):
    schema = "doc_id long, blocks array<struct<content:string,label:string>>"
    rows = spark.createDataFrame([(1, None), (2, [("# T", ""), ("a " * 30, "p1"), ("## H", "p1"), ("b " * 30, "p2")])], schema)
    got = {(r.doc_id, r.chunk): r for r in chunks.chunk_rows(rows, 20, 40).collect()}
    assert got[1, 1].title == "Part 1" and got[1, 1].content == "\n" and len(got) == 3
    assert got[2, 2].title == "H" and got[2, 2].content.startswith("# T\n\n## H") and got[2, 2].labels == ["p1", "p2"]
