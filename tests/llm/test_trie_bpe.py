"""op9 against the tokenizers library."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from docmill.llm import trie_bpe
from docmill.llm._tokens import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
TEXTS = ["", None, "Hello  world\n\n\tfoo   ", "<|endoftext|>a<|endoftext|><|endoftext|>", "x" * 3000, " " * 500, "don't WE'LL 's", "日本語 кириллица עברית 👩‍👩‍👧", "a\x1cb\x85c d e　f᠎g​ h﻿", "0123456789 ½ ²³ Ⅷ ٣", "á è", "same", "same"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_random_texts(library, monkeypatch):
    r = random.Random(1)
    pool = [chr(x) for x in [*range(1, 0x180), 0x2028, 0x2029, 0x200B, 0x3000, 0x1680, 0x180E, 0xFEFF, 0x4E2D, 0x301, 0x1F600]] + list("theaonis  ") * 30
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 80))) for _ in range(4000)]
    with open("/root/testdata/sf0.001/documents.parquet", "rb") as f:
        import pyarrow.parquet as pq

        texts += [t or "" for t in pq.read_table(f).column("text").to_pylist()]
    monkeypatch.setattr(trie_bpe, "WORDS_HELD", 3000)
    coder = trie_bpe.TrieCoder(PATH)
    got = [ids for a, b in trie_bpe.slices(texts, 50_000) for ids in coder.encode_batch(texts[a:b])]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [(t, g, w) for t, g, w in zip(texts, got, want) if g != w] == []
    assert [coder.decode(g) for g in got] == [library.decode(w, skip_special_tokens=False) for w in want]


def test_random_ids_decode(library):
    r = random.Random(2)
    coder = trie_bpe.trie_coder(PATH)
    for _ in range(300):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 12))]
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_token_follows_or_not_as_the_library_says(library):
    r = random.Random(3)
    coder = trie_bpe.trie_coder(PATH)
    words = [w for w in coder.bytes_of.values() if w.isalpha()]
    ids = {w: i for i, w in coder.bytes_of.items()}
    for _ in range(20_000):
        u, t = r.choice(words), r.choice(words)
        a, b = ids[u], ids[t]
        assert coder.may_follow(a, b) == (library.encode((u + t).decode(), add_special_tokens=False).ids == [a, b])


def test_operator(spark, library):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "keyless", 2), (0, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in trie_bpe.encode_and_decode(df, PATH, digest=True).collect()}
    for doc, text, _ in rows[:-1]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (got[doc].n_tokens, got[doc].ids_sha256, got[doc].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    plain = {r.doc_id: r for r in trie_bpe.encode_and_decode(df, PATH).collect()}
    assert plain[2].decoded == TEXTS[2] and plain[1].ids == []
    assert trie_bpe.encode_and_decode(df.limit(0), PATH).collect() == []
