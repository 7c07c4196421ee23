"""op3 and op4 against the tokenizers library used plainly."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from docmill.llm import _tokens, packing, token_records
from docmill.llm._tokens import tokenizer_path

TEXTS = [
    "Don't stop — the 42 cafés' naïve Σίσυφος ΣΑΣ don''t",
    "",
    None,
    " \t\n ",
    "a\x1cb\x85c d e　f",
    "é ́x İ İstanbul ﬁ",
    "<|endoftext|>mid<|endoftext|> <|startoftext|>x",
    "x" * 5000,
    "word " * 9000,
    "日本語のテキスト 中文 한국어",
    "same text", "same text",
    "It'S I'LL you're ÉCOLE ÀÉÎ÷×ß naïve(x) a-b c_d x^2 é<q>ö|<|ENDOFTEXT|> A\u030a e\u0301. n\u0303! I\u0307 ªº µ K Å ŉ ǰ ſ",
    "ÉCOLE ÀÉÎ÷×ß Straße(x) ÝÞÿ a-b c_d x^2 A\u030a. e\u0301. n\u0303! o\u0338< <\u0338 a<\u0338 I\u0307 ªº µ K Å ŉ ǰ ſ I'd've x's'S x'Ré it'll.",
    "emoji 👩‍👩‍👧 ﻿ zero​width",
]


def plain_ids(texts):
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 % 101, t, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(4), {r[0]: ids + [1] for r, ids in zip(rows, plain_ids(TEXTS))}


def test_word_coder_equals_library_when_it_forgets(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(_tokens, "WORDS_HELD", 5)
    monkeypatch.setattr(_tokens, "SLICE", 200)
    coder = _tokens.WordCoder(tokenizer_path("word_bpe_49k.json"))
    got = [ids[off[k] : off[k + 1]].tolist() for _, ids, off in coder.encode(pa.array(TEXTS)) for k in range(len(off) - 1)]
    assert got == plain_ids(TEXTS)


def test_records_round_trip(spark, docs, tmp_path):
    df, want = docs
    path = f"file://{tmp_path}/records"
    token_records.write_records(df, path, tokenizer_path("word_bpe_49k.json"), records_per_file=3)
    got = {r.doc_id: r for r in token_records.read_index(spark, path).collect()}
    assert got.keys() == want.keys()
    start = 0
    for doc in sorted(want):
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (start, len(want[doc]), crc(want[doc]))
        start += len(want[doc])
    some = spark.createDataFrame([(7,), (0,), (999,), (7,)], "doc_id long")
    assert {r.doc_id: r.ids for r in token_records.read_records(spark, path, some).collect()} == {7: want[7], 0: want[0]}


def test_damage_is_found():
    data = bytearray(token_records.frame(5, np.array([1, 2, 70000]), 4) + b"\n" + token_records.frame(-6, np.array([], int), 2) + b"\n")
    assert [(d, ids.tolist()) for d, _, _, ids in token_records.parse(bytes(data))] == [(5, [1, 2, 70000]), (-6, [])]
    for place in range(len(data)):
        bad = bytearray(data)
        bad[place] ^= 4
        with pytest.raises(ValueError, match="record"):
            list(token_records.parse(bytes(bad)))
    with pytest.raises(ValueError, match="damaged|cut off"):
        list(token_records.parse(bytes(data[:-3])))


def test_records_of_empty_and_keyless_tables(spark, tmp_path):
    df = spark.createDataFrame([(None, "z lost"), (3, "b"), (3, "c"), (None, None), (None, "a first")], "doc_id long, text string")
    token_records.write_records(df, f"file://{tmp_path}/a", tokenizer_path("word_bpe_49k.json"))
    got = sorted(token_records.read_index(spark, f"file://{tmp_path}/a").collect(), key=lambda r: r.start)
    want = [i + [1] for i in plain_ids([None, "a first", "z lost", "c"])]
    assert [r.doc_id for r in got] == [None, None, None, 3] and [r.ids_crc32 for r in got] == list(map(crc, want))
    assert [r.start for r in got] == [sum(map(len, want[:k])) for k in range(4)]
    token_records.write_records(df.limit(0), f"file://{tmp_path}/b", tokenizer_path("word_bpe_49k.json"))
    assert token_records.read_index(spark, f"file://{tmp_path}/b").count() == 0


def test_files_are_bounded_in_bytes(spark, tmp_path):
    """Books among short texts: no file of several records is larger than the bound, and every record is found at its place."""
    texts = {k: "word " * (30_000 if k % 5 == 0 else 3) for k in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    path = f"{tmp_path}/c"
    token_records.write_records(df, f"file://{path}", tokenizer_path("word_bpe_49k.json"), records_per_file=30, file_bytes=100_000)
    sizes = {f.name: f.stat().st_size for f in (tmp_path / "c" / "records").glob("part-*")}
    index = token_records.read_index(spark, f"file://{path}").collect()
    each = {f: [r.length for r in index if r.file == f] for f in sizes}
    assert len(sizes) >= 4 and all(n <= 100_000 + 30 * 17 or len(each[f]) == 1 for f, n in sizes.items())
    assert {r.doc_id: r.n_tokens for r in index} == {k: len(t.split()) + 1 for k, t in texts.items()}
    read = token_records.read_records(spark, f"file://{path}", df.select("doc_id")).collect()
    assert {r.doc_id: len(r.ids) for r in read} == {r.doc_id: r.n_tokens for r in index}


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, docs):
    df, want = docs
    rows = packing.pack(df, tokenizer_path("word_bpe_49k.json"), capacity=64).collect()
    total = sum(map(len, want.values()))
    assert check_packing(rows, 64) <= total // 64 + 3
    for doc, ids in want.items():
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        for r in own:
            assert (r.start, r.ids_crc32) == (r.piece * 64, crc(ids[r.start : r.start + 64]))
        assert [r.length for r in own] == [64] * (len(ids) // 64) + ([len(ids) % 64] if len(ids) % 64 else [])
    assert packing.pack(df.limit(0), tokenizer_path("word_bpe_49k.json")).collect() == []


def least_sequences(sizes, capacity):
    """Brute force: the least number of sequences."""
    best = len(sizes)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[k] <= capacity and bins[b] not in bins[:b]:
                go(k + 1, [*bins[:b], bins[b] + sizes[k], *bins[b + 1 :]])
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best


def test_dominance_keeps_the_optimum():
    r = np.random.default_rng(1)
    for _ in range(150):
        capacity = int(r.integers(10, 40))
        sizes = sorted(r.integers(1, capacity + 1, 9).tolist(), reverse=True)
        counts = np.bincount(sizes, minlength=capacity + 1)
        fixed = packing.reduce_by_dominance(counts, capacity)
        rest = [s for s in range(capacity, 0, -1) for _ in range(int(counts[s]))]
        used = sorted([s for n, items in fixed for s, k in items for _ in range(n * k)] + rest, reverse=True)
        assert used == sizes
        assert sum(n for n, _ in fixed) + least_sequences(rest, capacity) == least_sequences(sizes, capacity)


def test_plan_places_every_rank_once():
    r = np.random.default_rng(2)
    sizes, many = np.unique(r.lognormal(6, 1.2, 40_000).clip(1, 4096).astype(int), return_counts=True)
    histogram = dict(zip(sizes.tolist(), many.tolist()))
    plan = packing.Plan(histogram)
    size = np.repeat(list(histogram), list(histogram.values()))
    rank = np.concatenate([np.arange(n) for n in histogram.values()])
    sequence, offset = plan.place(size, rank)
    order = np.lexsort((offset, sequence))
    s, o, z = sequence[order], offset[order], size[order]
    new = np.append(True, s[1:] != s[:-1])
    assert (o[new] == 0).all() and (o[1:][~new[1:]] == (o + z)[:-1][~new[1:]]).all() and (o + z).max() <= 4096
    assert len(np.unique(s)) == plan.n_sequences <= -(-int(size.sum()) // 4096) * 1.02 + 2
