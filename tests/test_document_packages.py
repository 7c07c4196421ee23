"""Document packages: recognised pages, chunks and their labels, odd names, packages that are not whole; chunks against a plain loop."""

import hashlib
import json

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docmill.operators import chunks
from docmill.operators import document_packages as D
from docmill.operators.blocks import without_running_lines
from docmill.sources import part_files
from docmill.sources.part_files import whole_files, write_listed


def files(spark, rows, **options):
    schema = "doc_id long, name string, markdown string, pages array<struct<label:string,text:string,confidence:double>>, assets array<string>, tools map<string,string>"
    made = whole_files(D.package_files(spark.createDataFrame(rows, schema), "now", **options)).collect()
    return {(r.key, r.path): r.content for r in made}


def test_files(spark):
    text = "# A\n\n## \\(x\\)\n\nsome words here ![i](assets/i.png) ![j](assets/no.png)\n\n## ...\n\nmore"
    rows = [(1, "a.PDF", text, [("p 1", " seen ", 0.655)], ["assets/i.png"], {"b": "2", "a": "1"}), (2, "b.txt", None, None, None, None)]
    got = files(spark, rows, target=20, most=30)
    assert got["1", "raw.md"] == text and got["2", "raw.md"] == "" and got["2", "content.md"] == ""
    assert got["1", "content.md"].endswith("more\n\n## OCR 补充文本\n\n### p 1（平均置信度 65.5%）\n\nseen\n")
    m = json.loads(got["1", "manifest.json"])
    assert m["source"] == {"name": "a.PDF", "sha256": None, "format": ".pdf"} and list(m["tools"]) == ["a", "b"] and m["assets"] == ["assets/i.png"]
    assert m["ocr"] == {"enabled": True, "pages": [{"label": "p 1", "confidence": 0.655, "low_confidence": True}]}
    assert [s["label"] for s in m["provenance"]] == ["p 1"] and [w["code"] for w in m["warnings"] if w["code"] == "missing_image"] == ["missing_image"]
    assert [c["file"] for c in m["chunks"]] == ["chunks/001-$x$.md", "chunks/002-Part-2.md", "chunks/003-chunk-3.md", "chunks/004-OCR-补充文本.md", "chunks/005-p-1（平均置信度-65.5%）.md"]
    assert all(got["1", c["file"]].startswith("# A\n\n") for c in m["chunks"]) and [c["sources"] for c in m["chunks"]] == [[], [], [], [], ["p 1"]]
    other = json.loads(got["2", "manifest.json"])
    assert (other["chunks"], other["tools"], other["ocr"]["enabled"]) == ([], {}, False) and ("2", "chunks/001-Part-1.md") not in got
    assert {w["code"]: w["message"] for w in other["warnings"]}["empty_document"] == "转换结果为空。"


def test_packages_that_are_not_whole(spark):
    schema = "key string, name string, path string, content string"
    good = [("k", "a.md", "content.md", "text"), ("k", "a.md", "manifest.json", '{"provenance": [{"label": "x", "ordinal": "7"}, 3], "warnings": [{"code": "c"}, "no"]}')]
    r = D.read_packages(spark.createDataFrame(good, schema)).collect()[0]
    assert (r.format, r.sha256, r.warnings) == (".md", None, ['{"code":"c"}']) and [(s.source_type, s.label, s.ordinal, s.start_line) for s in r.spans] == [("document", "x", 7, 1)]
    for bad in (good[:1], [good[0], ("k", "a.md", "manifest.json", "[]")]):
        with pytest.raises(PySparkException):
            D.read_packages(spark.createDataFrame(bad, schema)).collect()


def test_labels_follow_places():
    text = "one. two.\n<m>\nthree. one."
    spans = [{"start_line": 1, "end_line": 1, "label": "a"}, {"start_line": 2, "end_line": 3, "label": "b"}]
    assert chunks.split_blocks(text, spans, 100) == [("one.", "a"), ("two.", "a"), ("<m>\nthree.", "b"), ("one.", "b")]
    assert chunks.split_blocks("# T\n\n" + "w " * 50, [], 20)[0] == ("# T", "") and all(len(c.split()) <= 19 for c, _ in chunks.split_blocks("# T\n\n" + "w " * 50, [], 20)[1:])


def test_chunks_grow_with_the_document():
    made = chunks.grouped([("w " * 10, "x")] * 20_000, 100, 150)
    assert len(made) == 2_000 and made[0][0] == "Part 1" and made[0][3] == ["x"]


def test_assets_round_trip(spark, tmp_path):
    """Images given as bytes and as files elsewhere are copied byte for byte, each once, under names of their own; the rest stays where it was."""
    big = bytes(range(256)) * 50_000
    (tmp_path / "in").mkdir()
    (tmp_path / "in/big.bin").write_bytes(big)
    text = "# T\n\n![a](img/x%201.png) ![b](<other/X 1.png>) ![a](img/x%201.png \"t\")\n\n![c](a\\b.gif) ![w](https://e.org/i.png) ![u](big.bin)"
    docs = spark.createDataFrame([(1, "a.md", text), (2, "b.md", "![u](big.bin)"), (3, "c.md", None)], "doc_id long, name string, markdown string")
    rows = [(1, "img/x 1.png", b"one\x00\xff\r\n ", None), (1, "other/X", b"two", None), (1, "big.bin", None, f"file://{tmp_path}/in/big.bin"), (2, "big.bin", b"", None), (2, "unused.png", b"no", None)]
    files = spark.createDataFrame(rows, "doc_id long, path string, content binary, uri string")
    root = f"file://{tmp_path}/out"
    listing = {(r.key, r.path): (r.bytes, r.sha256) for r in write_listed(D.package_files(docs, "now", files=files), root).collect()}
    out = tmp_path / "out"
    made = {str(p.relative_to(out)): p.read_bytes() for p in out.rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert {f"{k}/{p}": (len(made[f"{k}/{p}"]), hashlib.sha256(made[f"{k}/{p}"]).hexdigest()) for k, p in listing} == {f"{k}/{p}": v for (k, p), v in listing.items()} and len(listing) == len(made)
    assert {k: v for k, v in made.items() if "/assets/" in k} == {"1/assets/x-1.png": rows[0][2], "1/assets/X": b"two", "1/assets/big.bin": big, "2/assets/big.bin": b""}
    content = made["1/content.md"].decode()
    assert "![a](assets/x-1.png) ![b](assets/X) ![a](assets/x-1.png)" in content and "![c](a/b.gif) ![w](https://e.org/i.png) ![u](assets/big.bin)" in content
    manifest = json.loads(made["1/manifest.json"])
    assert manifest["assets"] == ["assets/X", "assets/big.bin", "assets/x-1.png"] and [w["code"] for w in manifest["warnings"]].count("missing_image") == 1
    read = {(r.key, r.path): (bytes(r.content), r.bytes) for r in D.read_assets(spark, root).collect()}
    assert read == {("1", "assets/x-1.png"): (rows[0][2], 8), ("1", "assets/X"): (b"two", 3), ("1", "assets/big.bin"): (big, len(big))}  # Spark's readers pass over empty files


def test_sheets_and_running_heads(spark):
    sheets = "## Sales\n\n| a |\n\n## Costs of 2024\n\ntext"
    paged = "".join(f"<!-- Page: {k} -->\nRunning Head {k}\n\nown text {'abcde'[k]}\n" for k in range(5))
    slides = "".join(f"<!-- Slide number: {k} -->\nsame foot\n" for k in range(2))
    got = files(spark, [(1, "s.xlsx", sheets, None, None, None), (2, "p.pdf", paged, None, None, None), (3, "d.pptx", slides, None, None, None)])
    spans = lambda k: [(s["source_type"], s["label"]) for s in json.loads(got[k, "manifest.json"])["provenance"]]
    assert spans("1") == [("worksheet", "Sales"), ("worksheet", "Costs of 2024")] and got["1", "content.md"].startswith("# 工作表：Sales\n")
    assert "Running" not in got["2", "content.md"] and got["2", "raw.md"].count("Running") == 5 and [k for k, _ in spans("2")] == ["page"] * 5
    assert got["3", "content.md"].count("same foot") == 2  # two pages are too few to tell


def test_running_lines_are_those_of_six_tenths():
    page = lambda k, *lines: "\n".join([f"<!-- Page: {k} -->", *lines])
    text = "\n".join(page(k, "head  %d" % k if k < 6 else "other", "# Same", "| t |", "x" * 161, f"body {'abcdefghij'[k]}") for k in range(10))
    got = without_running_lines("before 1\n" + text)
    assert "head" not in got and got.count("# Same") == 10 and got.count("| t |") == 10 and got.count("x" * 161) == 10 and got.startswith("before 1\n")
    assert without_running_lines(text.replace("head  5", "tail")).count("head") == 5
    assert without_running_lines("a\r\nb") == "a\r\nb" and without_running_lines("") == ""


def test_spans_are_not_copied_into_what_reads_them(spark):
    """A generator filters by the size of what it takes apart first: the marks stood in that filter once for each of their uses, two within lambdas."""
    d = D.packaged(D.cleaned_documents(spark.createDataFrame([(1, "a.pdf", "<!-- Page: 1 -->\nx\n<!-- Page: 2 -->\ny")], "doc_id long, name string, markdown string")))
    rows = d.select(F.posexplode("spans").alias("i", "s"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("工作表：(.+?)") <= 3 * 2  # twice in a filter and once as a column; each looks for it and takes its label
    assert [(r.i, r.s.start_line, r.s.end_line) for r in rows.collect()] == [(0, 1, 2), (1, 3, 4)]


def test_many_small_files_share_a_frame():
    """A frame for each file took longer than the file."""
    frame = pd.DataFrame({"key": "k", "path": [f"p{i:05}" for i in range(5000)], "section": 0, "a": 0, "b": 0, "sep": "", "exact": True, "text": [str(i) for i in range(5000)], "data": None, "uri": None})
    frames = list(part_files._whole(iter([frame]), text=True))
    assert len(frames) == 2
    assert pd.concat(frames)["content"].tolist() == frame["text"].tolist()
    long = frame.head(6).assign(text="x" * (part_files.FLUSH_BYTES // 2 + 1))
    assert [len(f) for f in part_files._whole(iter([long]), text=False)] == [2, 2, 2]


def test_documents_of_one_small_file_are_cleaned_by_all_cores(spark):
    """Few bytes were one task, of cleaning and of all that reads its result, however many documents they hold."""
    from docmill.plans.stored import stored

    cores = spark.sparkContext.defaultParallelism
    docs = spark.range(400).coalesce(1).selectExpr("id as doc_id", "concat('d', id, '.md') as name", "concat('# D\\n\\n\\n### T ', id) as markdown")
    d = stored(D.cleaned_documents(docs), "cleaned")
    files = d.selectExpr("_metadata.file_path as f").distinct().count()
    assert files >= cores
    assert {(r.doc_id, r.content) for r in d.collect()} == {(k, f"# D\n\n## T {k}\n") for k in range(400)}
    assert d.count() == 400


def test_raw_texts_are_looked_through_for_heading_jumps_alone(spark):
    """All nine rules and the images of raw texts were looked for, and all but the heading jumps were dropped."""
    raw = "# A\n\n### B\n\n| a | b |\n| 1 |\n\n![x](none.png)\n\n```\nopen"
    docs = D.packaged(D.cleaned_documents(spark.createDataFrame([(1, "a.docx", raw)], "doc_id long, name string, markdown string")))
    found = D.issues_of(docs, 90)
    assert sorted((r.code, r.line, r.tokens) for r in found.collect()) == [("heading_jump", 3, None), ("malformed_table", 6, None), ("missing_image", 8, None)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("![") == 1
