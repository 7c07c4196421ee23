"""Each stage of the pipeline against what brute force says of its own input."""

from pathlib import Path

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_minhash_dedup import brute as near_brute  # noqa: E402
from test_quality_rules import base  # noqa: E402
from test_suffix_dedup import brute as repeat_brute  # noqa: E402


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, rows = docs.columns, None
    for k, (_name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, d)
        if k < 4:
            assert out.columns == columns
            docs = corpus_pipeline.stored(out, "test")
            rows = {r.doc_id: r for r in docs.collect()}
            assert rows and set(rows) <= set(before)
        if k == 0:
            assert all(base(rows[i].text)[0] >= 50 for i in rows) and len(rows) > 0.5 * len(before)
        if k == 1:
            assert len(rows) == len(before)
        if k == 2:
            assert set(rows) == {i for i, (_, _, kept) in near_brute(list(before.items()), 5, 80).items() if kept} and len(rows) < len(before)
        if k == 3:
            want = repeat_brute(list(before.items()))
            assert {i: len(before[i].encode()) - want[i][1] for i in rows} == pytest.approx({i: len(r.text.encode()) for i, r in rows.items()}, abs=8)
            assert all(r.n_chars == len(r.text) for r in rows.values())
        if k == 4:
            packed = out.collect()
            assert {r.doc_id for r in packed} == set(before)
            size = {}
            for r in packed:
                size[r.sequence_id] = size.get(r.sequence_id, 0) + r.length
            assert max(size.values()) <= 4096


def test_missing_ids_pass(spark):
    text = " ".join(f"word{i % 90} the" for i in range(60))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(None, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (2, text, "en", "s", 1), (3, None, None, None, None)], schema)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [(False, 1), (False, 3), (True, 0)]
    assert corpus_pipeline.substring_dedup(spark, docs, "").filter("doc_id is null or doc_id = 1").count() == 2


def test_near_copies_from_80_per_cent_are_dropped(spark):
    """20 of the 196 windows of five words differ: Jaccard 176 / 216 = 0.815."""
    words = [f"w{i}" for i in range(200)]
    copy = [f"x{i}" if i in (20, 60, 100, 140) else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy))], "doc_id long, text string")
    assert near_brute([tuple(r) for r in docs.collect()], 5, 80)[2][1] == 1 and near_brute([tuple(r) for r in docs.collect()], 5)[2][1] == 2
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [1]


CLASHES = ["n_bytes", "kept_text", "spans", "_text", "kept", "score", "n_words", "lang_pred", "held_out", "component_id", "n_shingles", "row", "tokens", "id", "carried", "c", "c0", "no_text", "r", "a.b"]


def clashing(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHES)
    return spark.createDataFrame([(*r, *range(len(CLASHES))) for r in rows], schema)


def test_columns_of_any_name_pass_every_stage_unchanged(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    docs = clashing(spark, rows)
    for _name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[c] == k for r in got for k, c in enumerate(CLASHES))
    assert corpus_pipeline.best_fit(spark, docs, d).select("doc_id").distinct().count() == len({r[0] for r in rows})


def test_empty_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = clashing(spark, []).drop(*CLASHES)
    for _name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, d).collect() == []


def test_long_texts(spark):
    """Texts of a megabyte, one a copy of another but for its end, pass the stages whole."""
    d = "/root/testdata/sf0.001"
    good = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").filter("lang = 'en' and n_chars > 400").collect()}
    long = "".join(f"{t} part{k} " for k in range(40) for t in list(good.values())[k % 3 :: 3])[:1_000_000]
    docs = spark.createDataFrame([(1, long, "en", "s", 1), (2, long + " the end", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.text for r in corpus_pipeline.near_dedup(spark, docs, d).collect()] == [long]
    got = {r.doc_id: r for r in corpus_pipeline.substring_dedup(spark, docs, d).collect()}
    want = repeat_brute([(1, long), (2, long + " the end")])
    assert {i: len(r.text.encode()) for i, r in got.items()} == pytest.approx({i: len(t.encode()) - want[i][1] for i, t in ((1, long), (2, long + " the end"))}, abs=8)
    assert sum(r.length for r in corpus_pipeline.best_fit(spark, docs, d).collect()) > 200_000


def test_columns_without_an_order(spark):
    """A map and a variant column pass the stages that group repeated ids; of rows with one id the greatest stays."""
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, 3, {"k": 1}), (1, text, 3, {"k": 2}), (2, "other " + text[::-1], 4, None), (2, None, 5, {})]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, tags map<string,int>").selectExpr("*", "parse_json('{\"a\": 1}') AS v")
    kept = {r.doc_id: r for r in corpus_pipeline.near_dedup(spark, df, "").selectExpr("doc_id", "text", "tags", "to_json(v) AS v").collect()}
    assert len(kept) == 2 and kept[1].tags == {"k": 2} and kept[1].v == '{"a":1}' and kept[2].text == rows[2][1]
    cut = corpus_pipeline.substring_dedup(spark, df, "")
    assert cut.columns == df.columns and {r.doc_id for r in cut.select("doc_id", "tags").collect()} == {1, 2}


def test_tables_of_earlier_stages_are_deleted(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "docmill"
    tables = lambda: {p.name for p in folder.glob("*") if not p.name.startswith(".")}
    before = tables()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [name.rsplit("-", 1)[0] for name in tables() - before] == ["stage-best-fit-packing"]
    assert out.count() > 0
