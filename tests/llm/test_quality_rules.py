"""op10 against a plain Python version of every column."""

import math
import random
import re
import struct
from collections import Counter

import pytest
import regex
import xxhash

from docmill.llm import quality_rules as Q


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(grams)
    at = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(at)


def xx(data, seed=42):
    h = xxhash.xxh64_intdigest(data, seed)
    return h - (1 << 64) if h >> 63 else h


def grams(text):
    """Buckets of the tokens and of the pairs."""
    half = Q.BUCKETS // 2
    t = [xx(w.encode()) % Q.BUCKETS - half for w in regex.findall(r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\x20\x09-\x0D]+", text or "")]
    seed = lambda a: xx(struct.pack("<i", a)) % (1 << 64)
    return t, [xx(struct.pack("<i", b), seed(a)) % Q.BUCKETS - half for a, b in zip(t, t[1:])]


def verdicts(rows, trusted):
    """((score, pair_score) of each row, least of both)."""
    count = lambda ids, k: Counter(g for d, t in rows if d in ids for g in grams(t)[k])
    fold = lambda d: xx(struct.pack("<q", d)) % 2
    every = {d for d, _ in rows}

    def ratio(ids, k):
        raw, target = count(every, k), count(ids, k)
        m, n = sum(raw.values()) + Q.BUCKETS, sum(target.values())
        return lambda g: round(1000 * math.log((target[g] * m / (raw[g] + 1) + Q.PRIOR) / (n + Q.PRIOR)))

    def mean(text, k, of):
        g = grams(text)[k]
        return sum(map(of, g)) / len(g) / 1000 if g else None

    final = [ratio(trusted, k) for k in (0, 1)]
    other = {f: [ratio({d for d in trusted if fold(d) != f}, k) for k in (0, 1)] for f in (0, 1)}
    held = [[mean(t, k, other[fold(d)][k]) for d, t in rows if d in trusted and base(t)[0] >= 50] for k in (0, 1)]
    least = [sorted(h)[max(0, math.ceil(Q.BELOW * len(h)) - 1)] for h in held]
    return {d: tuple(mean(t, k, final[k]) for k in (0, 1)) for d, t in rows}, least, len(held[0])


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 3)))
    texts = [r.choice([" ", "\n", "  \t"]).join(word() for _ in range(r.randint(0, 250))) for _ in range(60)]
    texts += ["x y z " * 40, "line one\nline one\n \n \nline one", "a#b $%& |<>*", "", None, " \n\t\x0b\x0c\r", "\n\n", "a\xa0b\x85c", "w " * 30_000, "aa bb cc dd aa bb cc", "one", "one two", "a b a b a"]
    texts += [" ".join(word() + "###" for _ in range(80)) for _ in range(5)]
    return list(enumerate(texts))


def test_equals_plain_python(spark, rows):
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, n_words string").repartition(3)
    labels = spark.createDataFrame([(d, int(d < 50), int(d == 3), None) for d in range(0, 70, 1)] + [(2, 0, 0, None), (None, 1, 0, None), (5, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    want, least, n = verdicts(rows, {d for d in range(50) if d not in (2, 3)})
    assert n >= Q.LEAST_TRUSTED
    model = Q.learn(Q.measured(df), labels)
    assert model.least == (pytest.approx(least[0]), pytest.approx(least[1]))
    got = {r.doc_id: r for r in Q.quality_rules(df, labels).collect()}
    for d, t in rows:
        g, b = got[d], base(t)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == b, (d, t)
        assert g.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert (g.score, g.pair_score) == tuple(x if x is None else pytest.approx(x) for x in want[d])
        assert g.kept == (not g.base_failed and all(x >= y - 1e-9 for x, y in zip(want[d], least)))
    assert not all(g.kept for g in got.values() if not g.base_failed) and sum(g.kept for g in got.values()) > 20


def test_thresholds_do_not_depend_on_partitions(spark):
    """45,000 scores, dealt over 4, 9 and 17 partitions: the exact rank each time; ties, nulls and few rows as well."""
    r = random.Random(4)
    scores = [(round(r.gauss(0.4, 0.3), r.choice([2, 15])), r.gauss(-0.1, 0.1) if k % 50 else None) for k in range(45_000)]
    exact = [sorted(x for x in c if x is not None) for c in zip(*scores)]
    exact = [c[max(0, math.ceil(Q.BELOW * len(c)) - 1)] for c in exact]
    got = {Q.exact_least(spark.createDataFrame(scores, "score double, pair_score double").repartition(n)) for n in (4, 9, 17)}
    assert len(got) == 1
    n, least = got.pop()
    assert n == 44_100 and all(0 <= x - y < 2e-9 for x, y in zip(exact, least))
    few = spark.createDataFrame([(0.5, 0.25), (-0.5, None)], "score double, pair_score double")
    assert Q.exact_least(few) == (1, (pytest.approx(-0.5), pytest.approx(0.25)))
    assert Q.exact_least(few.limit(0)) == (0, None)


def test_least_number_of_trusted_texts_is_the_callers(spark):
    text = lambda k: " ".join(f"w{(k * 7 + i) % 90}" for i in range(60))
    df = spark.createDataFrame([(k, text(k)) for k in range(30)] + [(99, " ".join("zz#q" + str(i) for i in range(60)))], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(19)], "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="no threshold"):
        assert all(r.kept for r in Q.quality_rules(df, labels).collect())
    assert {r.doc_id for r in Q.quality_rules(df, labels, least_trusted=5).collect() if not r.kept} >= {99}


def test_no_python_in_the_plan(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plan = Q.judge(Q.measured(df), Q.NO_MODEL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_tables_and_missing_ids(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(None, "a b"), (1, "c " * 60), (1, "c d e f g h i j k l m n o p q r s t u v w x y z " * 1 + " ".join(map(str, range(60))))], "doc_id long, text string")
    assert sorted((r.n_words, r.kept) for r in Q.quality_rules(df, labels).collect()) == [(2, False), (60, False), (84, True)]
    assert Q.quality_rules(df.limit(0), labels).collect() == []


def test_no_name_clashes(spark):
    names = ["row", "id", "t", "words", "lines", "windows", "sorted", "tokens", "pairs", "c0", "fold", "b", "_", "a.b"]
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, *range(len(names)))], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    out = Q.quality_rules(df, labels)
    assert out.columns == [*df.columns, *Q.MEASURES, *Q.SCORES, "kept"] and out.first()[: len(df.columns)] == df.first()
    assert Q.kept_rows(df, labels).collect() == df.collect()


def test_very_long_text(spark):
    text = " ".join(f"w{i % 70_000}x" for i in range(300_000))
    df = spark.createDataFrame([(1, text), (2, text[: len(text) // 2] + "\n" * 1000)], "doc_id long, text string")
    got = {r.doc_id: r for r in Q.quality_rules(df, spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")).collect()}
    assert all(tuple(got[r.doc_id][c] for c in Q.MEASURES[:5]) == base(r.text) for r in df.collect())


def test_labelled_junk_is_rejected_and_clean_text_kept(spark):
    d = "/root/testdata/sf0.01"
    got = Q.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    right = sum(r.kept == (r.quality == 1) for r in got)
    assert right >= 0.98 * len(got)


@pytest.mark.parametrize("move", [r"\2\1", None], ids=["before", "inside"])
def test_symbols_are_seen_wherever_they_stand(spark, move):
    """The labelled junk again, its symbols moved from the end of the words to their front or middle: rejected all the same, and clean text stays."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    quality = {r.doc_id: r.quality for r in labels.collect()}
    moved = lambda w: re.sub(r"^(.+?)([#*$%&]{3})$", move or (lambda m: m[1][: len(m[1]) // 2] + m[2] + m[1][len(m[1]) // 2 :]), w)
    rows, odd = [], set()
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        w = (r.text or "").split()
        if quality.get(r.doc_id) == 0 and len(w) >= 50 and 2 * sum(moved(x) != x for x in w) > len(w):
            odd.add(r.doc_id)
            rows.append((r.doc_id, " ".join(map(moved, w))))
        else:
            rows.append((r.doc_id, r.text))
    got = {r.doc_id: r for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), labels).filter("not base_failed").collect()}
    assert len(odd & set(got)) > 10 and not any(got[i].kept for i in odd & set(got))
    clean = [r.kept for i, r in got.items() if quality.get(i) == 1]
    assert sum(clean) >= 0.98 * len(clean)


def test_foreign_words_with_ordinary_endings(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    clean = [t for i, t in rows if i in {r.doc_id for r in labels.filter("quality = 1 and toxic = 0").collect()} and len(t.split()) >= 50][:10]
    alien = [(10**6 + k, " ".join(w[:-2][::-1] + w[-2:] if len(w) > 3 else "q" + w for w in t.split())) for k, t in enumerate(clean)]
    got = Q.quality_rules(spark.createDataFrame(rows + alien, "doc_id long, text string"), labels).filter("doc_id >= 1000000 and not base_failed").collect()
    assert got and not any(r.kept for r in got)


def test_held_out_labels(spark):
    """Half of the labels teach, the other half judge: clean text of those stays and their junk goes."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    taught = labels.filter("crc32(cast(doc_id as string)) % 2 = 0")
    got = Q.quality_rules(docs.select("doc_id", "text"), taught).filter("not base_failed").join(labels.join(taught, "doc_id", "left_anti"), "doc_id").collect()
    good, junk = [r.kept for r in got if r.quality == 1 and r.toxic == 0], [r.kept for r in got if r.quality == 0]
    assert len(good) > 1000 and sum(good) >= 0.99 * len(good)
    assert len(junk) > 100 and sum(junk) <= 0.01 * len(junk)
