"""op13 against both libraries on whole texts and a brute-force count."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from docmill.llm import token_alignment as ta
from docmill.llm._tokens import tokenizer_path

PATHS = tokenizer_path(ta.A_VOCABULARY), tokenizer_path(ta.B_VOCABULARY)
TEXTS = ["", None, "Hello  world\n\n\tfoo   ", "<|endoftext|>a<|endoftext|> <s> </s> <unk> <0x41>", " leading", "  two", "tail ", "x" * 3000, " " * 500, "don't WE'LL 's", "日本語 кириллица 👩‍👩‍👧 é è", "a\x1cb\x85c d e　f g", "\n", "a\n b\t c \n d", "under▁score", "0123 ½ Ⅷ", "same text", "same text", "ﬁne ｆｕｌｌ"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PATHS[1])


def letters():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, more = {chr(b): b for b in printable}, 0
    for b in range(256):
        if b not in printable:
            table[chr(256 + more)] = b
            more += 1
    return table


LETTERS = letters()


def tokens(libraries, text):
    a, b = libraries
    if not text:
        return [], [], [], []
    e = a.encode(" " + text, add_special_tokens=False)
    ids_b = b.encode(text)
    bytes_a = [bytes(LETTERS[c] for c in t) for t in e.tokens]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, map(b.id_to_piece, ids_b))]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], [], []
    return e.ids, bytes_a, ids_b, bytes_b


def ends(parts):
    out, at = [], 0
    for p in parts:
        at += len(p)
        out.append(at)
    return out


def brute(libraries, texts):
    docs, count = [], Counter()
    for text in texts:
        a, bytes_a, b, bytes_b = tokens(libraries, text)
        at_a, at_b = dict(zip(ends(bytes_a), a)), dict(zip(ends(bytes_b), b))
        cuts = sorted(at_a.keys() & at_b.keys())
        links = [(at_a[x], at_b[x]) for x in cuts]
        count.update(links)
        groups = []
        for lo, hi in zip([0, *cuts], cuts):
            groups.append(",".join(str(i) for x, i in at_a.items() if lo < x <= hi) + "|" + ",".join(str(i) for x, i in at_b.items() if lo < x <= hi))
        docs.append((len(a), len(b), groups, links))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), ";".join(groups)) for n_a, n_b, groups, links in docs], count


def made_texts(n):
    r = random.Random(3)
    pool = [chr(x) for x in [*range(1, 0x180), 0x2028, 0x200B, 0x3000, 0x1680, 0xFEFF, 0x4E2D, 0x301, 0x1F600]] + list("theaonis  \n") * 25
    return ["".join(r.choice(pool) for _ in range(r.randint(0, 80))) for _ in range(n)]


def test_chunks_are_encoded_as_in_their_text(libraries):
    import pyarrow.parquet as pq

    texts = [t for t in TEXTS if t] + made_texts(3000) + [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist() if t]
    coder = ta.PairCoder(*PATHS)
    number, each = coder.numbers(texts)
    at = spelled = 0
    for text, n in zip(texts, each.tolist()):
        a, bytes_a, b, bytes_b = tokens(libraries, text)
        mine = number[at : at + n]
        at += n
        if coder.counts[mine, 3].any():
            assert not a, text
            continue
        if not text:
            assert n == 0
            continue
        spelled += 1
        assert coder.counts[mine, :2].sum(0).tolist() == [len(a), len(b)], text
        written = b"".join(coder.groups[k] for k in mine).decode()[:-1]
        assert [int(i) for g in written.split(";") for i in g.split("|")[0].split(",")] == a
        assert [int(i) for g in written.split(";") for i in g.split("|")[1].split(",")] == b
    assert spelled > 1000


def test_against_brute_force(spark, libraries):
    texts = TEXTS + made_texts(150) + ["the same words again and again"] * 40
    want, count = brute(libraries, texts)
    df = spark.createDataFrame([(k if k % 9 else None, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, row string").repartition(3)
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    for part in (ta.PART, 60):  # with many parts of each stripe, the counts still meet
        got = ta.align(df, *PATHS, part=part)
        assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(((k if k % 9 else None, *w) for k, w in enumerate(want)), key=str)
    encoded = ta.encode(df, *PATHS)
    assert {(r.a, r.b): r.n for r in ta.count_pairs(encoded, *ta.sizes(*PATHS), part=60).collect()} == count


def test_query_empty_and_repeats(spark, libraries, tmp_path):
    rows = [(1, "one two", "en"), (1, "one two", "de"), (2, None, None), (3, "one   three", None)]
    spark.createDataFrame(rows, "doc_id long, text string, stripe string").write.parquet(str(tmp_path / "documents.parquet"))
    want, _ = brute(libraries, [t for _, t, _ in rows])
    got = sorted(map(tuple, ta.query(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(i, *w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for (i, _, _), w in zip(rows, want)], key=str)
    none = spark.createDataFrame(rows, "doc_id long, text string, row string").filter(F.lit(False))
    assert ta.align(none, *PATHS).collect() == []


def test_long_texts(libraries):
    coder = ta.PairCoder(*PATHS)
    texts = ["ab" * 100_000, "word " * 100_000, "\n" * 50_000, "1 " * 1000]
    number, each = coder.numbers(texts)
    assert each.sum() == len(number) and coder.counts[number, 0].sum() == sum(len(tokens(libraries, t)[0]) for t in texts)
