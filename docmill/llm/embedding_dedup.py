"""Embedding near-dedup by an inverted multi-index.

Two codebooks, one for each half of a vector, span a grid of cells; every vector is indexed under its cell. A query visits cells by the multi-sequence
algorithm (the two lists of codewords, sorted by distance, are walked along a heap of sums) until the cells are farther than the nearest one by the
margin. A pair counts if either of its vectors finds the other; the margin is set so that pairs at exactly the least cosine are found with the target recall.

What travels is a code of one byte a component with the norm of what it leaves out, so a cosine of two codes has a known error. The grid works on
codes alone; a cosine of codes that is farther from the least one than its error decides by itself. The vectors of all other pairs meet once more, in
full, in the same blocks, and are verified by cosine in double precision: what is emitted for that are vectors, never pairs.

First codewords in the order of a recursive bisection are cut into runs of equal mass, more for a label with more vectors, so that a run of a label is a block of some
BLOCK vectors; a run beyond that is divided by hash, and its queries go to each part. A vector goes once to each block that it visits, and where it is
indexed it is its own query. Blocks yield counts and the edges of spanning forests.

The codebooks are fitted on at most SAMPLE vectors of a length (those with the least hashes of their id); all are indexed and all query. Equal vectors of
a label are one with a weight, and only vectors of one length are compared.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm._common import keyless_rows, runs, stored, unique_rows
from docmill.llm._components import components

KEY = "vec_id"
COSINE = 0.93
SAMPLE = 20_000  # vectors of a length that its codebooks are fitted on at most
LEAST_FITTED = 1000  # a length with fewer vectors has one cell
PER_CELL = 40  # vectors of a label that a cell has on average; sets the number of codewords
MOST_WORDS = 512  # codewords of a half at most
TARGET = 0.999  # recall of pairs at exactly the least cosine
BLOCK = 1 << 18  # indexed vectors of a block (16 MB of codes for 64 components)
CHUNK = 1024  # queries that are compared at once
SLACK = 1e-5  # of a cosine of codes, for its arithmetic
MOST_LEVEL = 9  # a label's codewords are cut into at most 2 ** MOST_LEVEL runs


class Grid:
    """Codebooks for both halves of unit vectors, the margin of the traversal, and the runs of first codewords at each level."""

    def __init__(self, sample: np.ndarray, words: int, cosine: float, target: float, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        self.books = [self._cluster(part, words, rng) for part in (sample[:, : self.half], sample[:, self.half :])]
        self.margin, self.runs = 0.0, np.zeros((MOST_LEVEL + 1, len(self.books[0])), np.int32)
        if len(self.books[0]) * len(self.books[1]) == 1:
            return
        at = sample[rng.integers(0, len(sample), 8000)]
        noise = rng.standard_normal(at.shape)
        noise -= (noise * at).sum(axis=1, keepdims=True) * at
        norm = np.linalg.norm(noise, axis=1, keepdims=True)
        other = cosine * at + np.sqrt(1 - cosine**2) * np.divide(noise, norm, out=np.zeros_like(noise), where=norm > 0)
        self.margin = float(np.quantile(np.minimum(self._gap(at, other), self._gap(other, at)), target))
        order = np.array(self._bisected(np.arange(len(self.books[0]))))
        mass = np.bincount(self.cells(sample)[0], minlength=len(order))[order]
        middle = (np.cumsum(mass) - mass / 2) / mass.sum()
        for level in range(MOST_LEVEL + 1):
            self.runs[level, order] = np.minimum((middle * 2**level).astype(int), 2**level - 1)

    @staticmethod
    def _cluster(x: np.ndarray, words: int, rng: np.random.Generator) -> np.ndarray:
        points = np.unique(x, axis=0) if x.shape[1] else x[:1]
        book = points[rng.permutation(len(points))[:words]]
        for _ in range(12):
            near = np.argmin((book**2).sum(axis=1) - 2 * x @ book.T, axis=1)
            size = np.bincount(near, minlength=len(book))
            total = np.zeros_like(book)
            np.add.at(total, near, x)
            book[size > 0] = total[size > 0] / size[size > 0][:, None]
        return book

    def _bisected(self, words: np.ndarray) -> list[int]:
        """Codewords in an order that keeps near ones together: halved along their widest direction, again and again."""
        if len(words) < 2:
            return words.tolist()
        part = self.books[0][words] - self.books[0][words].mean(axis=0)
        order = words[np.argsort(part @ np.linalg.svd(part, full_matrices=False)[2][0], kind="stable")]
        return self._bisected(order[: len(order) // 2]) + self._bisected(order[len(order) // 2 :])

    def _gap(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How much farther than its nearest cell each x finds the cell of y."""
        one, two = self.distances(x)
        c1, c2 = self.cells(y)
        rows = np.arange(len(x))
        return one[rows, c1] + two[rows, c2] - one.min(axis=1) - two.min(axis=1)

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        parts = (x[:, : self.half], x[:, self.half :])
        return [np.maximum((p**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * p @ b.T, 0) for p, b in zip(parts, self.books, strict=True)]

    def cells(self, x: np.ndarray) -> list[np.ndarray]:
        return [d.argmin(axis=1) for d in self.distances(x)]

    def visits(self, x: np.ndarray, cell: list[np.ndarray]) -> np.ndarray:
        """Whether each row of x visits each of the cells."""
        d = self.distances(x)
        return d[0][:, cell[0]] + d[1][:, cell[1]] <= (d[0].min(axis=1) + d[1].min(axis=1) + self.margin)[:, None]

    def traverse(self, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[int, int]]:
        """The multi-sequence algorithm: cells in ascending distance, for the distances of both halves, to the margin."""
        low_one, low_two = one.min(), two.min()
        most = low_one + low_two + self.margin
        a, b = np.flatnonzero(one + low_two <= most), np.flatnonzero(two + low_one <= most)  # no other codeword is in a cell so near
        a, b = a[np.argsort(one[a], kind="stable")].tolist(), b[np.argsort(two[b], kind="stable")].tolist()
        x, y = one[a].tolist(), two[b].tolist()
        heap = [(x[0] + y[0], 0, 0)]
        while heap:
            d, i, j = heapq.heappop(heap)
            if d > most:
                return
            yield a[i], b[j]
            # (i, j) is reached from (i, j - 1), and (i, 0) from (i - 1, 0): once each
            if j + 1 < len(b):
                heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
            if not j and i + 1 < len(a):
                heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))


def _trivial(d: int) -> Grid:
    return Grid(np.zeros((1, d)), 1, 1.0, 1.0)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (int8), their scales and the norms of what they leave out, of unit vectors."""
    scale = (np.abs(x).max(axis=1) / 127).astype(np.float32)
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    rest = np.linalg.norm(x - decoded(codes, scale), axis=1)
    return codes, scale, np.nextafter(rest.astype(np.float32), np.float32(1))


def decoded(codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return codes * scale.astype(np.float64)[:, None]


ROW = "label long, d int, part int, query int, vec_id long, weight long, cell int, wanted array<int>, scale float, rest float, codes binary"
_ROW_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.float32(), pa.float32(), pa.binary())
_ROW_NAMES = [f.split()[0] for f in ROW.split(", ")]


def _lengths(part: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of each length of a vector, 2000 at once."""
    sizes = part.column(column).to_numpy()
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        for k in range(0, len(rows), 2000):
            yield part.take(pa.array(rows[k : k + 2000]))


def _homes(batches: Iterator[pa.RecordBatch], grids: dict[int, Grid]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, d, weight, level, embedding) -> label, d, part: the run where each vector is indexed."""
    for batch in batches:
        for part in _lengths(batch, "d"):
            d = part.column("d")[0].as_py()
            grid = grids.get(d) or _trivial(d)
            codes, scale, _ = coded(_unit(_matrix(part.column("embedding"), part.num_rows)))
            level = np.minimum(part.column("level").to_numpy(), MOST_LEVEL)
            run = grid.runs[level, grid.cells(decoded(codes, scale))[0]]
            yield pa.RecordBatch.from_arrays([part.column("label"), part.column("d"), pa.array(run, pa.int32())], names=["label", "d", "part"])


def _posted(batches: Iterator[pa.RecordBatch], grids: dict[int, Grid]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, d, weight, level, embedding) -> a row for each run of codewords visited; query is 0 for the run where the vector is indexed."""
    for batch in batches:
        for part in _lengths(batch, "d"):
            d = part.column("d")[0].as_py()
            grid = grids.get(d) or _trivial(d)
            ids, labels, weights, levels = (part.column(c).to_pylist() for c in (KEY, "label", "weight", "level"))
            codes, scale, rest = coded(_unit(_matrix(part.column("embedding"), len(ids))))
            one, two = grid.distances(decoded(codes, scale))
            c1, c2 = one.argmin(axis=1).tolist(), two.argmin(axis=1).tolist()
            rows = []
            for i in range(len(ids)):
                run = grid.runs[min(levels[i], MOST_LEVEL)]
                own = int(run[c1[i]])
                wanted: dict[int, list[int]] = {own: []}
                for a, b in grid.traverse(one[i], two[i]):
                    wanted.setdefault(int(run[a]), []).append(a << 16 | b)
                data = codes[i].tobytes()
                rows += [(labels[i], d, p, int(p != own), ids[i], weights[i], c1[i] << 16 | c2[i], cells, scale[i], rest[i], data) for p, cells in wanted.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROW_TYPES, strict=True)], names=_ROW_NAMES)


class _Rows:
    """Vectors of one label and block: what their codes say and, in the second pass, the unit vectors themselves."""

    def __init__(self, table: pa.Table | pa.RecordBatch, order: np.ndarray | None = None):
        if order is not None:
            table = table.take(pa.array(order))
        table = pa.Table.from_batches([table]) if isinstance(table, pa.RecordBatch) else table
        self.n, self.table = table.num_rows, table
        self.ids, self.weights, self.cell = (table.column(c).to_numpy() for c in (KEY, "weight", "cell"))
        self.exact = "embedding" in table.column_names
        if self.exact:
            self.x = _unit(_matrix(table.column("embedding").combine_chunks(), self.n))
            self.codes, self.scale, self.rest = coded(self.x)
        else:
            self.scale, self.rest = (table.column(c).to_numpy().astype(np.float32) for c in ("scale", "rest"))
            self.codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int8).reshape(self.n, -1)

    def wanted(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all visits."""
        lists = self.table.column("wanted").combine_chunks()
        return np.repeat(np.arange(self.n), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()


def _verdicts(left: _Rows, q: np.ndarray, right: _Rows, a: int, b: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(linked, open) for the rows q of left against the rows a to b of right. Codes decide what they can and leave the rest open; with the unit vectors
    at hand only those are decided."""
    dot = decoded(left.codes[q], left.scale[q]).astype(np.float32) @ decoded(right.codes[a:b], right.scale[a:b]).astype(np.float32).T
    e, f = left.rest[q][:, None], right.rest[a:b][None, :]
    error = e + f + 3 * e * f + SLACK  # |x| <= 1 + e and |y| <= 1 + f for the codes' vectors
    other = left.ids[q][:, None] != right.ids[a:b]
    unsure = (np.abs(dot - cosine) < error) & other
    if not left.exact:
        return (dot >= cosine) & other & ~unsure, unsure
    linked = np.zeros(dot.shape, bool)
    i, j = np.nonzero(unsure)
    for k in range(0, len(i), 100_000):
        s = slice(k, k + 100_000)
        linked[i[s], j[s]] = np.einsum("ij,ij->i", left.x[q[i[s]]], right.x[a + j[s]]) >= cosine
    return linked, np.zeros(dot.shape, bool)


def _joined(block: _Rows, part: _Rows, grid: Grid, cosine: float) -> tuple[list, list, list]:
    """Counts (vec_id, links), forest edges, and the (vec_id, indexed) that pairs leave open, between queries and a block sorted by cell."""
    owner, cell = part.wanted()
    starts, ends = np.searchsorted(block.cell, cell, "left"), np.searchsorted(block.cell, cell, "right")
    full = ends > starts
    owner, cell, starts, ends = owner[full], cell[full], starts[full], ends[full]
    order = np.argsort(cell, kind="stable")
    counts, edges, unsure = [], [], []
    for group in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []:
        begin, end = int(starts[group[0]]), int(ends[group[0]])
        for k in range(0, len(group), CHUNK):
            for a in range(begin, end, 4 * CHUNK):
                b = min(end, a + 4 * CHUNK)
                q = owner[group[k : k + CHUNK]]
                linked, left_open = _verdicts(part, q, block, a, b, cosine)
                if left_open.any():
                    unsure.append((part.ids[q[left_open.any(axis=1)]], False))
                    unsure.append((block.ids[a:b][left_open.any(axis=0)], True))
                hit = linked.any(axis=1)
                if not hit.any():
                    continue
                q, linked = q[hit], linked[hit]
                counts.append((part.ids[q], linked @ block.weights[a:b]))
                # what is linked but would not find the query itself gets its count from here
                col = np.flatnonzero(linked.any(axis=0))
                seen = decoded(block.codes[a:b][col], block.scale[a:b][col])
                back = grid.visits(seen, [part.cell[q] >> 16, part.cell[q] & 0xFFFF]).T
                missed = linked[:, col] & ~back
                if missed.any():
                    counts.append((block.ids[a:b][col], part.weights[q] @ missed))
                # spanning forest: labels spread between the two sides until they rest
                left, right = np.arange(len(q)), np.full(len(col), len(q))
                near = linked[:, col]
                while True:
                    right = np.minimum(right, np.where(near, left[:, None], len(q)).min(axis=0))
                    spread = np.where(near, right[None, :], len(q)).min(axis=1)
                    if (spread >= left).all():
                        break
                    left = np.minimum(left, spread)
                edges.append((part.ids[q], part.ids[q][left]))
                edges.append((block.ids[a:b][col], part.ids[q][right]))
    return counts, edges, unsure


FOUND = "a long, b long, n long, label long, d int, part int, block int, indexed boolean"


def _searched(batches: Iterator[pa.RecordBatch], grids: dict[int, Grid], cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (label, d, part, block, query): index rows are held and are the first queries, other query rows stream by. Yields a, n (count),
    a, b (edge), or a and a block (a vector that a pair leaves open there)."""
    key, held, block = None, [], None

    def results(part: _Rows) -> Iterator[pa.RecordBatch]:
        counts, edges, unsure = _joined(block, part, grids.get(key[1]) or _trivial(key[1]), cosine)
        a, b, n, at, indexed = [], [], [], [], []
        for ids, count in counts:
            a.append(ids), b.append(np.full(len(ids), -1)), n.append(count), at.append(np.zeros(len(ids), bool)), indexed.append(np.zeros(len(ids), bool))
        for ids, to in edges:
            real = ids != to
            a.append(ids[real]), b.append(to[real]), n.append(np.full(len(b[-1]), -1)), at.append(np.zeros(len(b[-1]), bool)), indexed.append(at[-1])
        for side in (False, True):
            ids = [x for x, s in unsure if s is side]
            if ids:
                ids = np.unique(np.concatenate(ids))
                a.append(ids), b.append(np.full(len(ids), -1)), n.append(b[-1]), at.append(np.ones(len(ids), bool)), indexed.append(np.full(len(ids), side))
        if not a:
            return
        a, b, n, at, indexed = (np.concatenate(x) for x in (a, b, n, at, indexed))
        is_edge, is_count = ~at & (n < 0), ~at & (n >= 0)
        columns = [pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64), mask=~is_edge), pa.array(n.astype(np.int64), mask=~is_count)]
        columns += [pa.array(np.full(len(a), k), t, mask=~at) for k, t in zip(key, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(indexed, mask=~at)], names=[f.split()[0] for f in FOUND.split(", ")])

    def indexed_rows() -> Iterator[pa.RecordBatch]:
        nonlocal block
        if held and block is None:
            table = pa.Table.from_batches(held).combine_chunks()
            block = _Rows(table, np.argsort(table.column("cell").to_numpy(), kind="stable"))
            for k in range(0, block.n, 8 * CHUNK):
                yield from results(_Rows(block.table.slice(k, 8 * CHUNK)))

    for batch in batches:
        marks = [batch.column(c).to_numpy() for c in ("label", "d", "part", "block", "query")]
        cuts = np.append(np.flatnonzero(runs(*marks)), batch.num_rows)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            now = tuple(int(m[a]) for m in marks)
            if now[:4] != key:
                yield from indexed_rows()
                key, held, block = now[:4], [], None
            if not now[4]:
                held.append(batch.slice(a, b - a))
                continue
            yield from indexed_rows()
            for k in range(a, b if held else a, 8 * CHUNK):
                yield from results(_Rows(batch.slice(k, min(8 * CHUNK, b - k))))
    yield from indexed_rows()


def _fitted(same: DataFrame, cosine: float, target: float) -> dict[int, Grid]:
    """A grid for each length of at least LEAST_FITTED vectors."""
    sizes = same.groupBy("d", "label").agg(F.count("*").alias("n")).groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    sizes = sizes.filter((F.col("n") >= LEAST_FITTED) & (F.col("d") > 1)).collect()  # a row for each length
    grids = {}
    for row in sizes:
        place = F.pmod(F.xxhash64("rep"), F.lit(1 << 32))
        near = same.filter((F.col("d") == row.d) & (place <= min(1 << 32, (1 << 32) * 2 * SAMPLE // row.n)))  # some 2 * SAMPLE rows are sorted, not all
        sample = near.orderBy(place, "rep").limit(SAMPLE).select(F.col("embedding").cast("array<double>")).collect()
        sample = _unit(np.array([r[0] for r in sample], float))
        words = int(min(MOST_WORDS, len(sample) // 4, max(4, round((float(row.squares) / row.n / PER_CELL) ** 0.5))))
        grids[row.d] = Grid(sample, words, cosine, target)
    return grids


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, block: int = BLOCK, target: float = TARGET) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    Vectors are compared within a label and a length; those of length 1 by their signs. A vector that is null, empty, zero, has a null or non-finite
    component or a null label is linked with nothing. Rows that repeat a vec_id are one vector (the greatest embedding, then label); a row with a null
    vec_id is linked with nothing: component_id null, kept true. Other columns are ignored.
    """
    rows = unique_rows(embeddings, KEY, "embedding", "label")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("label").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False)) & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    good = rows.filter(usable).select(KEY, F.col("label").cast("long").alias("label"), F.size("embedding").alias("d"), "embedding")
    element = dict(good.dtypes)["embedding"]
    good = good.withColumn("embedding", F.when(F.col("d") == 1, F.transform("embedding", F.signum).cast(element)).otherwise(F.col("embedding")))
    ids = good.select(KEY, "label", "d", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    ids = stored(ids, "vector-ids")
    equal = ["label", "d", "h1", "h2"]
    reps = ids.groupBy(*equal).agg(F.min(KEY).alias("rep"), F.count("*").alias("weight"))
    per_label = reps.groupBy("label", "d").agg(F.ceil(F.log2(F.greatest(F.count("*") / block, F.lit(1.0)))).cast("int").alias("level"))
    same = good.select(F.col(KEY).alias("rep"), "embedding").join(reps.join(per_label, ["label", "d"]).select("rep", "label", "d", "weight", "level"), "rep")
    same = stored(same, "vectors")
    grids = _fitted(same, cosine, target)
    columns = [F.col("rep").alias(KEY), "label", "d", "weight", "level", "embedding"]
    posted = same.select(*columns).mapInArrow(partial(_posted, grids=grids), ROW)
    place = ["label", "d", "part"]
    sizes = same.select(*columns).mapInArrow(partial(_homes, grids=grids), "label long, d int, part int").groupBy(*place).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = stored(sizes.filter("blocks > 1"), "large-runs")
    posted = posted.join(sizes, place, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64(KEY), "blocks").cast("int"))
    dealt = posted.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("query", F.when((F.col("query") == 0) & (F.col("block") != F.col("own")), 1).otherwise(F.col("query"))).drop("blocks", "own")
    keys = [*place, "block"]
    search = lambda df: stored(df.repartition(*keys).sortWithinPartitions(*keys, "query").mapInArrow(partial(_searched, grids=grids, cosine=cosine), FOUND), "links")
    found = search(dealt)
    unsure = found.filter("block is not null").select(*keys, F.col("a").alias(KEY), "indexed").distinct()
    if not unsure.isEmpty():
        full = same.join(unsure.select(F.col(KEY).alias("rep")).distinct(), "rep", "left_semi")
        wide = ", ".join(x for x in ROW.split(", ") if x.split()[0] not in ("scale", "rest", "codes"))
        cells = full.select(*columns).mapInArrow(partial(_posted, grids=grids), ROW).select(*[x.split()[0] for x in wide.split(", ")])
        sides = unsure.groupBy(*keys, KEY).agg(F.max("indexed").alias("indexed"))
        again = cells.drop("query").join(sides, [*place, KEY]).withColumn("query", F.when(F.col("indexed"), 0).otherwise(1)).drop("indexed")
        again = again.join(full.select(F.col("rep").alias(KEY), "embedding"), KEY)
        found = found.unionByName(search(again))
    counts = found.filter("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    ties = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    of_rep = reps.select(*equal, "rep", "weight").join(counts, "rep", "left").join(ties, "rep", "left")
    none = F.lit(0).cast("long")
    of_rep = of_rep.select(*equal, (F.coalesce("n", none) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = ids.join(of_rep, equal).select(KEY, "n_links", "component_id")
    out = rows.select(KEY).join(linked, KEY, "left").select(KEY, F.coalesce("n_links", none).alias("n_links"), F.coalesce("component_id", KEY).alias("component_id"))
    lone = keyless_rows(embeddings, KEY).select(KEY, none.alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.withColumn("kept", F.col(KEY) == F.col("component_id")).unionByName(lone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_embedding_dedup: every vector of the table."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
