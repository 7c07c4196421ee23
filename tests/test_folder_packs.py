"""A folder of mixed files to packs; dense numbers; paths taken from a folder."""

import json

from pyspark.sql import functions as F

from docmill.operators import folder_packs as P
from docmill.operators.pack_files import load_source_maps
from docmill.plans.ordered import dense_numbers


def test_folder(spark, tmp_path):
    root = tmp_path / "in put"
    (root / "notes/img").mkdir(parents=True)
    picture = bytes(range(200))
    (root / "notes/img/p 1.png").write_bytes(picture)
    (root / "notes/a.md").write_text("# A\n\n### Deep\n\n![p](img/p%201.png) ![q](../../out.png) ![r](./img/../img/p%201.png)\n\nsome words")
    (root / "notes/A.MD").write_text("again")
    (root / "notes/t.csv").write_text("k,v\n1,2")
    (root / "notes/bad.docx").write_text("no archive")
    (root / "top.html").write_text("<html><body><h1>Top</h1><p>text</p></body></html>")
    (root / "top.pdf").write_bytes(b"%PDF")
    (root / "skip.exe").write_bytes(b"x")
    steps = []
    made = P.folder_to_packs(spark, f"file://{root}", f"file://{tmp_path}/out", 2000, "2024-01-01T00:00:00+00:00", lambda step, n: steps.append((step, n)))
    assert {r.path: r.error_code for r in made.failures.collect()} == {"notes/bad.docx": "conversion_failed", "top.pdf": "unsupported_suffix"}
    assert sorted((r.pack_job, r.source_order, r.path) for r in made.sources.collect()) == [(1, 1, "top.html"), (2, 1, "notes/A.MD"), (2, 2, "notes/t.csv")]
    packs = {p.name: p for p in (tmp_path / "out").iterdir()}
    assert sorted(packs) == ["A-and-1-more_AI-Context-Pack", "top_AI-Context-Pack"]
    assert [s for s, _ in steps] == ["converted", "numbered", "cleaned", "images", "assets", "packaged", "sources", "files"] and dict(steps)["converted"] == 6 and dict(steps)["sources"] == 3
    held = [p for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith(".")]
    assert len(held) == made.files and sum(p.stat().st_size for p in held) == made.bytes
    _, entries, integrity = load_source_maps(spark, f"file://{tmp_path}/out")
    assert all(r.integrity_ok for r in integrity.collect()) and entries.filter("not content_verified").count() == 0


def test_images_come_from_where_the_document_lies(spark, tmp_path):
    root = tmp_path / "in"
    (root / "d/img").mkdir(parents=True)
    (root / "d/img/p 1.png").write_bytes(b"\x01\x02")
    (root / "own.png").write_bytes(b"\x03")
    (root / "d/a.md").write_text("# A\n\n### Deep\n\n![p](img/p%201.png) ![q](../own.png) ![r](../../out.png) ![s](img/../img/p%201.png)\n\nsome more words for a text")
    P.folder_to_packs(spark, f"file://{root}", f"file://{tmp_path}/out", None, "2024-01-01T00:00:00+00:00")
    pack = next((tmp_path / "out").iterdir())
    assets = {p.name: p.read_bytes() for p in (pack / "sources/source-001/assets").iterdir() if not p.name.startswith(".")}
    assert assets == {"p-1.png": b"\x01\x02", "own.png": b"\x03", "p-1_2.png": b"\x01\x02"}
    text = (pack / "packs/001-context.md").read_text()
    assert "![p](../sources/source-001/assets/p-1.png) ![q](../sources/source-001/assets/own.png) ![r](../../out.png) ![s](../sources/source-001/assets/p-1_2.png)" in text
    warnings = json.loads((pack / "manifest.json").read_text())["sources"][0]["warnings"]
    assert {w["code"]: w["message"] for w in warnings} == {"heading_jump": "仍存在跳级标题。", "missing_image": "missing_image"}


def test_dense_numbers(spark):
    rows = [(g, k % 7, k) for g, n in (("a", 50), ("b", 1), (None, 20)) for k in range(n)]
    got = dense_numbers(spark.createDataFrame(rows, "g string, x long, y long").repartition(5), "g", ["x", "y"]).collect()
    want = {(g, x, y): k for h in ("a", "b", None) for k, (g, x, y) in enumerate(sorted((r for r in rows if r[0] == h), key=lambda r: r[1:]), start=1)}
    assert {(r.g, r.x, r.y): r.n for r in got} == want and len(got) == len(rows)


def test_paths(spark):
    cases = [("a/b", "c.png", "a/b/c.png"), ("a/b", "../c.png", "a/c.png"), ("", "./c.png", "c.png"), ("a", "../../c.png", None), ("a", "/c.png", None), ("a", "C:/c.png", None), ("a", "..", None)]
    df = spark.createDataFrame(cases, "folder string, target string, want string")
    assert [r.got for r in df.select(P._joined(F.col("folder"), F.col("target")).alias("got")).collect()] == [c[2] for c in cases]
