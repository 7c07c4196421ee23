"""op5 against brute force over all pairs of full sets."""

import random
import re
import time
from pathlib import Path

import pyarrow as pa
import pytest

from docmill.llm import minhash_dedup as M
from docmill.llm._common import stored
from docmill.llm._components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k=3, percent=85):
    sets = {d: shingles(t, k) for d, t in rows}
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    texts = [" ".join(word() for _ in range(r.randint(1, 300))) for _ in range(60)]
    for base in texts[:10]:
        for _ in range(9):
            w = base.split()
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = word()
            texts.append(r.choice([" ", "\n", "\t  "]).join(w))
    texts += ["", None, "one", "ONE", "one two", "\x0bone  two ", "É é", "é é", "a b c", "A\xa0b c", texts[3].upper(), texts[4]]
    ids = r.sample(range(-50, 1000), len(texts))
    return list(zip(ids, texts))


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize(("seed", "caps"), [(1, {}), (2, {"list_cap": 3, "cluster_cap": 700})])
def test_equals_brute_force(spark, seed, caps):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, kept int").repartition(5)
    assert result(M.near_duplicates(df, **caps)) == brute(rows)


def test_equals_brute_force_at_80(spark):
    r = random.Random(5)
    rows, n = [], 0
    for _ in range(40):  # one word replaced in n: similarities from 0.7 to 0.95
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randint(60, 260))]
        for k in range(r.randint(2, 7)):
            w = list(base)
            for at in r.sample(range(len(w)), k * len(w) // 110):
                w[at] = f"x{r.randrange(10**6)}"
            rows.append((n := n + 1, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows, 5, 80)
    assert want != brute(rows, 5, 85)
    assert result(M.near_duplicates(df, words=5, percent=80)) == want


def test_threshold_follows_the_percent(spark):
    assert (M.matches_for(85), M.matches_for(80), M.matches_for(100)) == (88, 79, 128)
    for percent in (0, 5, 101):
        with pytest.raises(ValueError):
            M.near_duplicates(spark.range(0).selectExpr("id AS doc_id", "'' AS text"), percent=percent)


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (2, "a b c d"), (2, "a b c d"), (3, None)], "doc_id long, text string")
    assert result(M.near_duplicates(df)) == {None: (2, None, True), 1: (2, 1, True), 2: (2, 1, False), 3: (0, 3, True)}
    assert M.near_duplicates(df.limit(0)).collect() == []


def test_forests_agree_with_pairs():
    import numpy as np

    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 200).astype(np.uint64)
    sets = []
    for _ in range(60):
        s = base.copy()
        at = r.choice(200, r.integers(0, 30), replace=False)
        s[at] = r.integers(0, 2**63, len(at))
        sets.append(np.unique(s))
    got = M.similar_forest(sets)
    label = list(range(60))
    for i in range(60):
        for j in range(i):
            common = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert got.tolist() == label


def test_components(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(7, 7), (500, 400)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    alone = {n for n in label if not any(n in e and e[0] != e[1] for e in edges)}
    assert got == {n: c for n, c in label.items() if n not in alone}


@pytest.mark.parametrize("cap", [1, 3, 50])
def test_lists_over_batches_of_any_size(cap):
    r = random.Random(cap)
    pairs = sorted((r.choice([-7, -1, 3, *range(100, 130)]), d) for d in r.sample(range(-200, 200), 150))
    pairs = sorted({*pairs, *((500, d) for _, d in pairs[:9]), *((501, d) for _, d in pairs[:9])})
    for step in (1, 2, 7, 1000):
        batches = [pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in pairs[i : i + step]], pa.int64()), "doc_id": pa.array([d for _, d in pairs[i : i + step]], pa.int64())}) for i in range(0, len(pairs), step)]
        got = [x for b in M._lists(iter(batches), cap) for x in b.to_pylist()]
        of_key = {k: sorted(d for x, d in pairs if x == k) for k, _ in pairs}
        named = {}
        for x in got:
            if x["hub"] is None:
                named.setdefault(x["list"], []).append(x["doc_id"])
        short = {tuple(d) for d in of_key.values() if 1 < len(d) <= cap}
        assert {tuple(sorted(set(d))) for d in named.values()} == short and len(named) == len(short)  # equal lists have one name
        assert sorted((x["hub"], x["doc_id"]) for x in got if x["hub"] is not None) == sorted((d[0], x) for d in of_key.values() if len(d) > max(cap, 1) for x in d)


def test_a_stored_table_leaves_no_shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    size = lambda: sum(p.stat().st_size for folder in manager.localDirsString() for p in Path(folder).glob("*/shuffle_*"))
    before = size()
    assert stored(spark.range(300_000).selectExpr("xxhash64(id) AS k").repartition("k"), "test").count() == 300_000
    deadline = time.time() + 10
    while (left := size() - before) > 100_000 and time.time() < deadline:  # files go a moment later
        time.sleep(0.2)
    assert left < 100_000
