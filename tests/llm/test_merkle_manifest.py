"""op11 against a brute-force tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from docmill.llm import merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, n_chars):
    fields = (doc[0], doc[3], doc[2], n_chars, doc[1])
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields])


def tree(nodes):
    """Root, and the proof of each leaf: (sibling or None, whether it stands left), level by level."""
    proofs, below = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        for k, own in enumerate(below):
            other = nodes[k ^ 1] if k ^ 1 < len(nodes) else None
            for x in own:
                proofs[x].append((other, k % 2 == 1))
        nodes = [h(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        below = [sum(below[k : k + 2], []) for k in range(0, len(below), 2)]
    return nodes[0], proofs


def brute(docs):
    langs = sorted({d[2] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    trees, out = {}, []
    for lang in langs:
        own = sorted((d for d in docs if d[2] == lang), key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[4])))
        trees[lang] = own, *tree([leaf(d, d[4]) for d in own])
    root, tops = tree([trees[x][1] for x in langs])
    for top, lang in zip(tops, langs):
        own, subroot, proofs = trees[lang]
        for d, proof in zip(own, proofs):
            path = proof + top
            changed = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0 and d[4] is not None
            at = leaf(d, d[4] + 1 if changed else d[4])
            for other, left in path:
                at = h(at) if other is None else h(other, at) if left else h(at, other)
            out.append((d[0], leaf(d, d[4]), subroot, root, h(*[x for x, _ in path if x]), at, at == root))
    return sorted(out, key=str)


def made(df, band=merkle_manifest.BAND):
    m = merkle_manifest.manifest(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, band)
    proof = F.sha2(F.concat_ws("", F.transform("path", lambda s: s.digest)), 256)
    folded = merkle_manifest.fold(F.coalesce("altered", "leaf"), F.col("path"))
    return sorted(map(tuple, m.select("doc_id", "leaf", "subroot", "root", proof, folded, folded == F.col("root")).collect()), key=str)


@pytest.mark.parametrize("band", [2, 10])
def test_bands_against_brute_force(spark, band):
    r = random.Random(band)
    langs = ["en"] * 40 + ["de"] * 9 + ["fr"] * 5 + ["é", "", None]
    docs = [(k, r.choice(["", None, "ünï", "x" * 50]), r.choice(langs), r.choice(["s", None]), r.choice([0, None, 7, 2**63 - 1])) for k in range(150)]
    docs += [(500, "alone", "only", "s", 1), (1, "again", "en", "s", 1), (1, "again", "en", None, 1), (None, "no id", "en", None, None), (None, None, None, None, None)]
    r.shuffle(docs)
    assert made(spark.createDataFrame(docs, SCHEMA), band) == brute(docs)


def test_small_sizes(spark):
    """Trees of 1 to 9, 16 and 17 leaves, in bands of three levels; and a single leaf alone."""
    docs = [(k * 3, str(k), f"l{n}", "s", k) for n in (*range(1, 10), 16, 17) for k in range(n)]
    assert made(spark.createDataFrame(docs, SCHEMA), 3) == brute(docs)
    assert made(spark.createDataFrame(docs[:1], SCHEMA)) == brute(docs[:1])


def test_repeats_clashing_columns_long_texts_and_empty(spark):
    docs = [(7, "same", "en", "s", 4)] * 3 + [(8, "long " * 400_000, "en", "s", 2_000_000)]
    df = spark.createDataFrame(docs, SCHEMA)
    clash = df.withColumns({c: F.lit(1) for c in ("tree", "digest", "place", "size", "level", "path", "leaf", "root", "run", "at", "stretch")})
    assert made(clash) == made(df) == brute(docs)
    assert made(df.limit(0)) == []
    nothing = merkle_manifest.manifest(df.limit(0))
    assert nothing.columns == merkle_manifest.manifest(df).columns


def test_no_text_travels(spark):
    """What is sorted and exchanged are digests: the plan of the proofs reads no text."""
    m = merkle_manifest.manifest(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert "text" not in m._jdf.queryExecution().optimizedPlan().toString()
