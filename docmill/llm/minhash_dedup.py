"""MinHash near-dedup by a signature-coordinate inverted join, confirmed on full shingle sets.

A document's signature has 128 coordinates, minima of as many hash functions over its shingle set. It is posted under (coordinate, value). Two sets with
a Jaccard similarity of 0.85 agree in 109 coordinates on average, and in fewer than the match threshold of 88 about once in a million pairs. A pair
with 88 agreeing coordinates agrees in one of the first 41 (128 - 88 + 1), so only those are posted: the prefix. Threshold and prefix follow from the
least similarity, always with that error: 79 and 50 for a similarity of 0.8. Within a list, collisions are counted
on whole signatures, and lists of the same documents are merged once. A list yields no pairs but a spanning forest of its matches: a document that
is already tied is skipped in the counting. The trees of all lists together give clusters, which no true link leaves. Each cluster then settles its
links exactly, on the full sets of 64-bit shingle hashes, again as a traversal that compares what is reached with what is not.

Documents with equal sets are one representative from the start. Lists longer than LIST_CAP are taken to be wholly tied, which only makes clusters
larger; clusters beyond CLUSTER_CAP shingles are compared block against block in tasks of their own. So no group meets in one task, and no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm._common import ID, keyless_rows, looked_up, mix64, ranges, runs, stored, unique_rows
from docmill.llm._components import components

COORDINATES = 128
MISSED = 1.1e-6  # share of links at the least similarity that may have fewer matches than the threshold
WORDS = 3  # of a shingle
PERCENT = 85  # least similarity
LIST_CAP = 50_000  # documents of a list whose collisions are counted
CLUSTER_CAP = 8_000_000  # shingles of a cluster that one task settles (64 MB)
SLICE = 2 << 20


def matches_for(percent: int) -> int:
    """The match threshold: the most coordinates that all but MISSED of the pairs with this similarity agree in."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent must be above 0 and at most 100, not {percent}")
    p, fewer, k = percent / 100, 0.0, 0
    while k < COORDINATES and (fewer := fewer + math.comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)) <= MISSED:
        k += 1
    if not k:
        raise ValueError(f"{COORDINATES} coordinates are too few for a similarity of {percent} per cent")
    return k


MATCHES = matches_for(PERCENT)  # for a pair to be retained; of so many, one is in the prefix
PREFIX = COORDINATES - MATCHES + 1

_FACTORS = (mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_A, _B, _C = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): of each text the ascending distinct 64-bit hashes of its shingles."""
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    code = split.flatten().dictionary_encode()
    of_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in code.dictionary.to_pylist()), np.uint64, len(code.dictionary))
    empty = np.fromiter((not w for w in code.dictionary.to_pylist()), bool, len(code.dictionary))
    index = np.asarray(code.indices).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(np.asarray(split.offsets)))
    real = ~empty[index] if len(index) else np.zeros(0, bool)
    h, doc = of_word[index[real]], doc[real]
    size = np.bincount(doc, minlength=len(texts))
    begin = np.cumsum(size) - size
    n = np.where(size >= words, size - words + 1, np.minimum(size, 1))
    span = np.minimum(size, words)
    at, owner, length = ranges(begin, n), np.repeat(np.arange(len(texts)), n), np.repeat(span, n)
    s = length.astype(np.uint64) * _C
    for k in range(words):
        inside = k < length
        s[inside] = mix64(s[inside] * _A + h[at[inside] + k] * _B + np.uint64(k))
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = runs(owner, s)
    s, owner = s[new], owner[new]
    return s, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])


def signatures(s: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of COORDINATES minima (uint32) for each non-empty set."""
    begin = off[:-1][np.diff(off) > 0]
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begin), COORDINATES), np.uint32)
    for k, factor in enumerate(_FACTORS):
        out[:, k] = np.minimum.reduceat(low * factor, begin) if len(begin) else 0
    return out


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    texts = texts.fill_null("").cast(pa.large_string())
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + SLICE, "right")))
        yield i, texts.slice(i, j - i)
        i = j


def _binary(rows: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _signed(batches: Iterator[pa.RecordBatch], words: int, prefix: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in _slices(batch.column(1)):
            s, off = shingle_sets(texts, words)
            n = np.diff(off)
            full = n > 0
            both = [np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)]
            keys = np.zeros((len(n), prefix), np.int64)
            marks = np.zeros((len(n), COORDINATES), np.uint8)
            if full.any():
                for k, salt in enumerate((1, 2)):
                    both[k][full] = np.add.reduceat(mix64(s * np.uint64(salt) + _A), off[:-1][full])
                rows = signatures(s, off)
                keys[full] = rows[:, :prefix].astype(np.int64) | (np.arange(prefix, dtype=np.int64) << 32)
                marks[full] = (rows >> np.uint32(24)) ^ (rows & np.uint32(255))
            arrays = [batch.column(0).slice(first, len(n)), pa.array(n), pa.array(both[0].view(np.int64)), pa.array(both[1].view(np.int64))]
            arrays += [pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * prefix, keys.ravel()), _binary(marks, np.arange(len(n) + 1) * COORDINATES)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "h1", "h2", "keys", "marks"])


_LISTS = "list long, hub long, doc_id long"


def _lists(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    """(key, doc_id), sorted by both -> the lists of two documents or more: list (a hash of its documents) and doc_id of each of its documents; of a list longer than
    cap, list null, its least document as hub, and doc_id. No more than cap documents of a list are held."""

    def rows(lists: np.ndarray | None, hubs: np.ndarray | None, docs: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(docs), pa.int64())
        return pa.RecordBatch.from_arrays([none if lists is None else pa.array(lists), none if hubs is None else pa.array(hubs), pa.array(docs)], names=["list", "hub", "doc_id"])

    def whole(key: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        starts = np.flatnonzero(runs(key))
        size = np.diff(np.append(starts, len(key)))
        h = doc.view(np.uint64)
        mark = lambda salt: np.bitwise_xor.reduceat(mix64(mix64(h + np.uint64(salt)) * _A + np.uint64(salt)), starts)
        name = mix64(mark(1) * _B + mix64(mark(2))).view(np.int64)
        of, n = np.repeat(np.arange(len(starts)), size), np.repeat(size, size)
        short, long = (n > 1) & (n <= cap), n > cap
        if short.any():
            yield rows(name[of[short]], None, doc[short])
        if long.any():
            yield rows(None, doc[starts][of[long]], doc[long])

    key, doc = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of a list that may go on
    hub, at = None, 0  # of a list that goes on and is longer than cap
    for batch in batches:
        k, d = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if hub is not None:
            same = int(np.searchsorted(k, at, "right"))
            if same:
                yield rows(None, np.full(same, hub), d[:same])
            k, d = k[same:], d[same:]
            if not len(k):
                continue
            hub = None
        key, doc = np.concatenate([key, k]), np.concatenate([doc, d])
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1], "left"))
        yield from whole(key[:last], doc[:last])
        key, doc = key[last:], doc[last:]
        if len(key) > cap:
            hub, at = int(doc[0]), int(key[0])
            yield rows(None, np.full(len(doc), hub), doc)
            key, doc = key[:0], doc[:0]
    yield from whole(key, doc)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first column, rows sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        edges = np.append(np.flatnonzero(runs(key)), len(key))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if held and held[-1].column(0)[0].as_py() != key[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def matching_forest(marks: np.ndarray, least: int = MATCHES) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the rows that agree in at least `least` places; each row reached is compared with those not reached yet."""
    left = np.arange(len(marks))
    edges = []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.concatenate([np.count_nonzero(marks[left[k : k + 4096]] == marks[at], axis=1) for k in range(0, len(left), 4096)]) >= least
            found = left[near].tolist()
            edges += [(at, f) for f in found]
            queue += found
            left = left[~near]
    return edges


def _forests(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for table in _groups(batches):
        doc = table.column("doc_id").to_numpy()
        marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(len(doc), COORDINATES)
        edges = np.array(matching_forest(marks, least), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(doc[edges[:, 0]]), pa.array(doc[edges[:, 1]])], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in _slices(batch.column(2)):
            s, off = shingle_sets(texts, words)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)), _binary(s, off * 8)], names=["cluster", "doc_id", "shingles"])


def similar_forest(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """A label for each set, equal where a path of pairs with 100 * intersection >= percent * union joins them; the label is the least index."""
    n = len(sets)
    label = np.arange(n)
    size = np.array([len(s) for s in sets], np.int64)
    if n <= 6:
        for i in range(n):
            for j in range(i):
                if label[i] != label[j]:
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * common >= percent * (size[i] + size[j] - common):
                        label[label == max(label[i], label[j])] = min(label[i], label[j])
        return label
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(size)])

    def postings(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        items = code[ranges(begin[rows], size[rows])]
        order = np.argsort(items, kind="stable")
        return np.repeat(rows, size[rows])[order], np.searchsorted(items[order], np.arange(len(values) + 1))

    left = np.ones(n, bool)
    many = n
    owner, at = postings(np.arange(n))
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            i = queue.pop()
            own = code[begin[i] : begin[i + 1]]
            common = np.bincount(owner[ranges(at[own], at[own + 1] - at[own])], minlength=n)
            found = np.flatnonzero(left & (100 * common >= percent * (size + size[i] - common)))
            left[found] = False
            label[found] = seed
            queue += found.tolist()
            now = int(left.sum())
            if now < many // 2:  # what is reached needs no posting any more
                many = now
                owner, at = postings(np.flatnonzero(left))
            if not now:
                break
    return label


def _settled(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(group, doc_id, shingles), sorted by group -> a, b: each document and the least one of its component within the group."""
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def batch_of() -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for table in _groups(batches):
        doc = table.column("doc_id").to_numpy()
        order = np.argsort(doc)
        packed = table.column("shingles").to_pylist()
        sets = [np.frombuffer(packed[i], np.uint64) for i in order]
        out.append((doc[order], doc[order][similar_forest(sets, percent)]))
        if sum(len(a) for a, _ in out) > 20_000:
            yield batch_of()
    if out:
        yield batch_of()


def near_duplicates(documents: DataFrame, words: int = WORDS, percent: int = PERCENT, list_cap: int = LIST_CAP, cluster_cap: int = CLUSTER_CAP) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    ASCII letters are lower-cased and words end at ASCII white space. A document with fewer words than a shingle has its whole sequence as the one
    shingle; one without words or with a null text has none and is linked with nothing. Rows that repeat a doc_id are one document (its greatest text); a
    row with a null doc_id is linked with nothing: component_id null, kept true. Other columns are ignored. Match threshold and
    prefix are derived from percent; one that 128 coordinates can't cover is refused.
    """
    least = matches_for(percent)
    sign = partial(_signed, words=words, prefix=COORDINATES - least + 1)
    docs = unique_rows(documents, ID, "text")
    signed = stored(docs.mapInArrow(sign, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>, marks binary"), "signed")
    full = signed.filter("n_shingles > 0")
    same = stored(full.groupBy("h1", "h2", "n_shingles").agg(F.min(ID).alias("rep")), "sets")
    reps = full.join(looked_up(same.select(F.col("rep").alias(ID))), ID, "left_semi")
    posted = reps.select(F.explode("keys").alias("key"), ID)  # exchanged once, as key and id alone
    rows = stored(posted.repartition("key").sortWithinPartitions("key", ID).mapInArrow(partial(_lists, cap=list_cap), _LISTS), "postings")
    members = rows.filter("hub is null").select("list", ID).distinct()  # equal lists are one
    listed = members.join(reps.select(ID, "marks"), ID).select("list", ID, "marks")
    edges = listed.repartition("list").sortWithinPartitions("list").mapInArrow(partial(_forests, least=least), "a long, b long")
    edges = edges.unionByName(rows.filter("hub is not null").select(F.col("hub").alias("a"), F.col(ID).alias("b")))
    clusters = stored(components(edges).join(full.select(F.col(ID).alias("node"), "n_shingles"), "node"), "clusters")
    texts = docs.join(looked_up(clusters.select("component", F.col("node").alias(ID))), ID).select("component", ID, "text")
    sets = texts.mapInArrow(partial(_sets, words=words), "cluster long, doc_id long, shingles binary")
    settled, forest = partial(_settled, percent=percent), "a long, b long"
    large = clusters.groupBy("component").agg(F.sum("n_shingles").alias("size")).filter(F.col("size") > cluster_cap)
    if large.isEmpty():
        ties = sets.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(settled, forest)
    else:
        sets = sets.join(large.select(F.col("component").alias("cluster"), "size"), "cluster", "left")
        small = sets.filter("size is null").drop("size").repartition("cluster").sortWithinPartitions("cluster").mapInArrow(settled, forest)
        blocks = sets.filter("size is not null").withColumn("blocks", F.ceil(F.col("size") * 2 / cluster_cap)).withColumn("own", F.pmod(F.xxhash64(ID), "blocks"))
        paired = blocks.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        pair = F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other"))
        ties = paired.select(pair.alias("pair"), ID, "shingles").repartition("pair").sortWithinPartitions("pair").mapInArrow(settled, forest)
        ties = components(ties).select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(small)
    rep_of = full.select(ID, "h1", "h2", "n_shingles").join(same, ["h1", "h2", "n_shingles"]).select(ID, "rep")
    linked = rep_of.join(ties.withColumnRenamed("a", "rep"), "rep", "left").select(ID, F.coalesce("b", "rep").alias("component_id"))
    out = signed.select(ID, "n_shingles").join(linked, ID, "left").withColumn("component_id", F.coalesce("component_id", ID))
    lone = keyless_rows(documents, ID, "text").mapInArrow(sign, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>, marks binary")
    lone = lone.select(ID, "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(lone).withColumn("kept", F.coalesce(F.col(ID) == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    """op5_minhash_dedup: near_duplicates over documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
