"""op1 against a plain scan of all 100-byte windows in (doc_id, start) order."""

import hashlib
import random

import numpy as np
import pytest

from docmill.llm import suffix_dedup as S


def brute(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 6)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(60) for _ in range(4)]
    texts = [prose(40) + r.choice(shared)[r.randint(0, 90) :] + prose(30) for _ in range(n)]
    texts += texts[:7] + ["a" * 350, "ab" * 200, "", None, "short", "x" * 99, "y" * 100, "y" * 100, "\0" * 260, shared[0] + "\0" + shared[1], shared[0] + "\0" + shared[1]]
    near = list(texts[3])
    for k in range(12):
        near[r.randrange(len(near))] = "#"
        texts.append("".join(near))
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts))


def result(df):
    return {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in df.collect()}


@pytest.mark.parametrize(("seed", "hot"), [(1, S.HOT_STRINGS), (2, 2)])
def test_equals_brute_force(spark, seed, hot):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(S.dedup_substrings(df, hot, texts=False)) == brute(rows)


def test_small_shards_and_merges_agree():
    r = np.random.default_rng(3)
    base = r.integers(97, 100, 400).astype(np.uint8)
    strings = [base[a : a + 130].copy() for a in r.integers(0, 200, 40)]
    for s in strings[::3]:
        s[r.integers(0, 130)] = 35
    off = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    doc, at = np.arange(40), r.integers(0, 1000, 40)
    one = S.repeated_windows((np.concatenate(strings), off), doc, at, shard=1 << 20)
    many = S.repeated_windows((np.concatenate(strings), off), doc, at, shard=300)
    seen, want = set(), []
    for s in strings:
        for k in range(31):
            w = bytes(s[k : k + 100])
            want.append(w in seen)
            seen.add(w)
    assert one.tolist() == many.tolist() == want


def test_long_text_crosses_blocks(monkeypatch):
    import pyarrow as pa

    r = np.random.default_rng(5)
    text = "".join(map(chr, r.integers(97, 123, 5000)))
    monkeypatch.setattr(S, "BLOCK", 1000)
    got = list(S.find_segments(iter([pa.record_batch([pa.array([1, 2]), pa.array([text, "q" * 50])], names=["doc_id", "text"])])))
    rows = [x for b in got for x in b.to_pylist() if x["n"] > 0]
    windows = sorted(w for x in rows for w in range(x["at"], x["at"] + x["n"]))
    assert windows == list(range(len(text) - 99))


def test_nulls_repeats_and_extra_columns(spark):
    text = "z1 " * 60
    rows = [(None, text, 1), (5, None, 2), (7, text, 3), (7, text, 4), (9, text, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = S.dedup_substrings(df).orderBy("doc_id").collect()
    assert [(x.doc_id, x.n_removed, x.kept_text) for x in got if x.doc_id != 7] == [(None, 0, text), (5, 0, ""), (9, 180, "")]
    assert [x for x in got if x.doc_id == 7][0].n_removed == brute([(7, text)])[7][1]
    assert S.dedup_substrings(df.limit(0)).collect() == []
