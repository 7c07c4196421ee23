"""op8 against brute force over all pairs."""

import numpy as np
import pytest

from docmill.llm import embedding_dedup as E


def brute(rows, cosine=0.93):
    ok = [(i, lab, np.array(v, float)) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    n, comp = {r[0]: 0 for r in rows if r[0] is not None}, {r[0]: r[0] for r in rows if r[0] is not None}
    links = [(a, b) for x, (a, la, va) in enumerate(ok) for b, lb, vb in ok[:x] if la == lb and va @ vb / np.linalg.norm(va) / np.linalg.norm(vb) >= cosine]
    for a, b in links:
        n[a] += 1
        n[b] += 1
    for _ in rows:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (n[i], comp[i], comp[i] == i) for i in n}


def vectors(seed):
    r = np.random.default_rng(seed)
    unit = lambda: (lambda v: v / np.linalg.norm(v))(r.standard_normal(16))
    rows, k = [], 0
    for label in (0, 1, 2):
        for _ in range(40):
            base = unit()
            for _ in range(r.integers(1, 5)):
                cos = r.choice([1.0, 0.99, 0.96, 0.935])
                noise = unit()
                noise -= noise @ base * base
                noise /= np.linalg.norm(noise)
                rows.append((k, ((cos * base + np.sqrt(1 - cos**2) * noise) * r.choice([1.0, 3.0])).astype(np.float32).tolist(), label))
                k += 1
        hot = unit().astype(np.float32).tolist()
        rows += [(k + j, hot, label) for j in range(30)]
        k += 30
    rows += [(k, None, 0), (k + 1, [0.0] * 16, 0), (k + 2, [None] + [1.0] * 15, 0), (k + 3, [float("nan")] + [1.0] * 15, 0), (k + 4, [float("inf")] * 16, 1), (k + 5, rows[0][1], None), (k + 6, [], 0)]
    r.shuffle(rows)
    return [tuple(x) for x in rows]


@pytest.mark.parametrize("block", [E.BLOCK, 7])
def test_equals_brute_force(spark, block):
    rows = vectors(1)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, kept int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_vectors(df, block=block).collect()}
    assert got == brute(rows)


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    want = int(((x @ x.T >= 0.93) & (label[:, None] == label)).sum() - len(x))
    got = sum(r.n_links for r in E.near_vectors(df).collect())
    assert 0.999 * want <= got <= want


def test_traversal_is_in_order_and_complete():
    r = np.random.default_rng(2)
    x = r.standard_normal((500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    grid = E.Grid(x, 12, 0.93, 0.99)
    one, two = (d[0] for d in grid.distances(x[:1]))
    cells = list(grid.traverse(one, two))
    sums = [one[a] + two[b] for a, b in cells]
    assert sums == sorted(sums)
    assert len(cells) == int((one[:, None] + two[None, :] <= one.min() + two.min() + grid.margin).sum())


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, [1.0, 2.0, 3.0], 1)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_vectors(df).collect()}
    assert got == {None: (0, None, True), 1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True)}
    assert E.near_vectors(df.limit(0)).collect() == []
    assert [r.n_links for r in E.near_vectors(df.filter("vec_id = 3")).collect()] == [0]


def brute_by_length(rows):
    out = {}
    for d in {len(v or ()) for _, v, _ in rows}:
        out |= brute([r for r in rows if len(r[1] or ()) == d])
    return out


def test_every_length_is_compared_with_its_own(spark):
    rows = [(i, v, lab) for i, v, lab in vectors(3)]
    rows += [(1000 + i, v[:3], lab) for i, v, lab in vectors(4)[:60] if v and len(v) == 16 and None not in v]
    rows += [(2000, [2.0], 1), (2001, [7.0], 1), (2002, [-1.0], 1), (2003, [-3.0], 1), (2004, [0.0], 1), (2005, [5.0], 2), (2006, [1.0, 1.0], 1), (2007, [2.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_vectors(df).collect()}
    assert got == brute_by_length(rows)
    assert got[2000] == (1, 2000, True) and got[2003] == (1, 2002, False) and got[2007] == (1, 2006, False)


@pytest.mark.parametrize("block", [E.BLOCK, 50])
def test_ties_at_the_least_cosine_and_a_fitted_grid(spark, block, monkeypatch):
    """Vectors of small whole numbers: many cosines lie close to 0.93 and on both sides of it, so codes leave them open; and an index with several words."""
    monkeypatch.setattr(E, "LEAST_FITTED", 50)
    monkeypatch.setattr(E, "PER_CELL", 2)
    r = np.random.default_rng(5)
    rows = [(int(k), [float(x) for x in r.integers(-3, 4, 4)], int(k % 2)) for k in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long").repartition(3)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in E.near_vectors(df, target=1.0, block=block).collect()}
    want = brute(rows)
    links = [sum(n for n, _, _ in x.values()) for x in (got, want)]
    assert 0.999 * links[1] <= links[0] <= links[1] and sum(got[i] != want[i] for i in want) <= 7


def test_codes_know_their_error():
    x = E._unit(np.random.default_rng(6).standard_normal((400, 24)) ** 3)
    codes, scale, rest = E.coded(x)
    dot, error = E.decoded(codes, scale) @ E.decoded(codes, scale).T, rest[:, None] + rest[None, :] + 3 * rest[:, None] * rest[None, :]
    assert (np.abs(dot - x @ x.T) <= error).all()
