"""Suffix-array dedup: every byte covered by a 100-byte string that also starts earlier is removed.

Suffixes are sorted in shards, each with its own Burrows-Wheeler transform, and the transforms are merged by iterative interleave refinement:
the interleave (which shard the next suffix comes from) is refined by one symbol a pass, while within a shard the order never changes, so no suffix
is sorted again. A boundary between neighbours appears in the pass that tells their prefixes apart; what no boundary divides after 100 bytes is a
repeated interval. A symbol here is the eight bytes before a suffix (four in the last pass: 12 * 8 + 4 = 100), so 13 passes reach 100 bytes.

Which suffixes have to meet is settled by content. The leftmost least hash among the 69 substrings of 32 bytes of a 100-byte window is its anchor; equal
windows have equal anchors at equal places. Neighbouring windows with one anchor form a segment (some 31 windows). Segments whose anchor occurs once
cannot repeat. Equal segments are one string with a weight: all its occurrences but the first are covered. Strings with the same anchor but other
bytes around it go, whole, to one merge, which finds the windows they share.

Cost: one pass over the texts for anchors, one row a segment through a shuffle, and the texts once more by id. An anchor with more than
hot_strings different segments would be one unbounded merge; its windows are compared instead by 128-bit fingerprints in a plain aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm._common import BYTE_WORDS, ID, keyless_rows, merge_spans, mix64, ranges, runs, stored, unique_rows, utf8

WINDOW = 100  # bytes of a repeated string
GRAM = 32  # bytes of an anchor
BLOCK = 1 << 20  # bytes of text that are hashed at once
SHARD = 1 << 18  # symbols of a shard's transform
MERGE = 1 << 20  # symbols of a merge, unless one anchor has more
HOT_STRINGS = 100_000  # different segments of one anchor that a merge takes at most (about 13 MB)

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_POWERS = np.cumprod(np.full(BLOCK + WINDOW + 1, np.uint64(_BASE), np.uint64))
_INVERSE = np.cumprod(np.full(BLOCK + WINDOW + 1, np.uint64(pow(_BASE, -1, 1 << 64)), np.uint64))

SEGMENT = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int32())])
FOUND = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("anchor", pa.int64()), ("kind", pa.int8())])
COVER, ASK, ASK_HOT = 0, 1, 2


def _segments(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchor, content hash, document number, first window and number of windows of every segment of the documents in buf."""
    n, width = len(buf), WINDOW - GRAM + 1
    h, done = BYTE_WORDS[buf], 1
    while done < GRAM:
        h = (h[:-done] * _STEP) ^ (h[done:] + (h[:-done] >> np.uint64(29)))
        done *= 2
    h = mix64(h)
    low = np.uint64((1 << 21) - 1)
    least, reach = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1  # the place in the low bits: the leftmost of equal hashes wins
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    lengths = np.maximum(np.diff(off) - WINDOW + 1, 0)
    starts = ranges(off[:-1], lengths)
    place = (least[starts] & low).astype(np.int64)
    first = np.flatnonzero(runs(place))
    count = np.diff(np.append(first, len(place)))
    at = starts[first]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_WORDS[buf] * _POWERS[:n], out=sums[1:])
    content = mix64((sums[at + count + WINDOW - 1] - sums[at]) * _INVERSE[at] + count.astype(np.uint64))
    doc = np.repeat(np.arange(len(lengths)), lengths)[first]
    return h[place[first]], content, doc, at - off[doc], count


def _blocks(off: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first document, last document + 1, from byte, to byte): whole documents up to BLOCK bytes, or a piece of a longer one, with the overlap."""
    i = 0
    while i < len(off) - 1:
        if off[i + 1] - off[i] > BLOCK:
            for a in range(int(off[i]), int(off[i + 1]) - WINDOW + 1, BLOCK):
                yield i, i + 1, a, min(a + BLOCK + WINDOW - 1, int(off[i + 1]))
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK, "right")) - 1)
        while j > i + 1 and off[j] - off[j - 1] > BLOCK:
            j -= 1
        yield i, j, int(off[i]), int(off[j])
        i = j


def find_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different segment of a batch; the occurrences after the first in the batch are covered: rows with n = -bytes."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        buf, off = utf8(batch.column(1))
        parts = []
        for i, j, a, b in _blocks(off):
            if b - a >= WINDOW:
                anchor, content, doc, at, n = _segments(buf[a:b], np.array([0, b - a]) if j == i + 1 else off[i : j + 1] - a)
                parts.append((anchor.view(np.int64), content.view(np.int64), ids[i + doc], at + (a - off[i] if j == i + 1 else 0), n))
        if not parts:
            continue
        anchor, content, doc, at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, doc, content, anchor))
        anchor, content, doc, at, n = anchor[order], content[order], doc[order], at[order], n[order]
        new = runs(anchor, content)
        d, s, e = merge_spans(doc[~new], at[~new], at[~new] + n[~new] + WINDOW - 1)
        columns = [np.concatenate(x) for x in ((anchor[new], d * 31 + s), (content[new], s * 0), (doc[new], d), (at[new], s), (n[new], s - e))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SEGMENT, strict=True)], schema=SEGMENT)


def _found(doc: np.ndarray, at: np.ndarray, n: np.ndarray, anchor: np.ndarray | int, kind: np.ndarray | int) -> pa.RecordBatch:
    full = lambda x: x if isinstance(x, np.ndarray) else np.full(len(doc), x)
    return pa.RecordBatch.from_arrays([pa.array(full(c), f.type) for c, f in zip((doc, at, n, anchor, kind), FOUND, strict=True)], schema=FOUND)


def meet(batches: Iterator[pa.RecordBatch], hot_strings: int = HOT_STRINGS) -> Iterator[pa.RecordBatch]:
    """On all segments of an anchor: covered runs, and requests for the bytes of different segments that share their anchor."""
    table = pa.Table.from_batches(list(batches), SEGMENT)
    anchor, content, doc, at, n = (table.column(i).to_numpy() for i in range(5))
    if not len(anchor):
        return
    done = n < 0
    yield _found(doc[done], at[done], -n[done], 0, COVER)
    anchor, content, doc, at, n = (x[~done] for x in (anchor, content, doc, at, n))
    order = np.lexsort((at, doc, content, anchor))
    anchor, content, doc, at, n = anchor[order], content[order], doc[order], at[order], n[order]
    new = runs(anchor, content)
    yield _found(doc[~new], at[~new], n[~new] + WINDOW - 1, 0, COVER)
    anchor, doc, at, n = anchor[new], doc[new], at[new], n[new]
    if len(anchor):
        group = np.cumsum(runs(anchor)) - 1
        size = np.bincount(group)[group]
        several = size > 1
        kind = np.where(size > hot_strings, ASK_HOT, ASK)
        yield _found(doc[several], at[several], n[several], anchor[several], kind[several])


def cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, asked: array of structs at, n, anchor) -> the bytes of each segment asked for."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        buf, off = utf8(batch.column(1))
        asked = batch.column(2)
        sizes = np.diff(np.asarray(asked.offsets))
        rows = asked.flatten()
        at, n, anchor = (np.asarray(rows.field(k)) for k in ("at", "n", "anchor"))
        of = np.repeat(np.arange(len(ids)), sizes)
        for k in range(0, len(at), 50_000):
            s = slice(k, k + 50_000)
            length = n[s].astype(np.int64) + WINDOW - 1
            data = buf[ranges(off[of[s]] + at[s], length)]
            offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            strings = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(anchor[s]), pa.array(ids[of[s]]), pa.array(at[s]), strings], names=["anchor", "doc_id", "at", "bytes"])


# --- transforms ---------------------------------------------------------------------------------------------------------------------------------


class Shard:
    """Suffixes of a buffer of 0-ended strings, read in a circle, in order, and its transform for symbols of eight and of four bytes."""

    def __init__(self, data: np.ndarray):
        self.data, n = data, len(data)
        if n == 0:
            self.order = np.zeros(0, np.int64)
            return
        ring = np.concatenate([data, np.resize(data, 8)]) if n >= 8 else np.resize(data, n + 8)
        grams = np.zeros(n, np.uint64)
        for k in range(8):
            grams = (grams << np.uint64(8)) | ring[k : k + n].astype(np.uint64)
        self.grams = grams
        key, reach = grams, 8
        while True:
            order = np.argsort(key)
            rank = np.empty(n, np.uint64)
            new = runs(key[order])
            rank[order] = (np.cumsum(new) - 1).astype(np.uint64)
            if new.all() or reach >= n:
                break
            key = (rank << np.uint64(32)) | np.roll(rank, -(reach % n))
            reach *= 2
        self.order = order

    def symbols(self, width: int) -> np.ndarray:
        """The transform: for each suffix in order the width bytes before it, as a number."""
        before = self.grams[(self.order - width) % len(self.data)]
        return before >> np.uint64(64 - 8 * width)


def _stable(codes: np.ndarray) -> np.ndarray:
    """A stable argsort of uint32 codes in two radix passes of 16 bits, or in one."""
    first = np.argsort((codes & np.uint32(0xFFFF)).astype(np.uint16), kind="stable")
    high = (codes >> np.uint32(16)).astype(np.uint16)
    return first if not high.any() else first[np.argsort(high[first], kind="stable")]


def merge_transforms(shards: list[Shard], depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, block): for each place of the merged order its shard, and the number of the interval of suffixes that share depth bytes."""
    sizes = [len(s.data) for s in shards]
    z = np.repeat(np.arange(len(shards), dtype=np.uint16 if len(shards) > 255 else np.uint8), sizes)
    block = np.zeros(len(z), np.int32)
    for width, passes in ((8, depth // 8), (4, depth % 8 // 4), (1, depth % 4)):
        if not passes:
            continue
        plain = np.concatenate([s.symbols(width) for s in shards])
        codes = np.unique(plain, return_inverse=True)[1].astype(np.uint32)  # the alphabet of this merge, dense
        for _ in range(passes):
            symbol = np.empty(len(z), np.uint32)
            symbol[np.argsort(z, kind="stable")] = codes  # each shard's transform is read in its own order
            perm = _stable(symbol)
            z, block, symbol = z[perm], block[perm], symbol[perm]
            apart = np.zeros(len(z), np.int32)
            apart[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])  # the prefixes differ: their common prefix ends in this pass
            block = np.cumsum(apart, dtype=np.int32)
    return z, block


def repeated_windows(strings: list[tuple[np.ndarray, np.ndarray]], doc: np.ndarray, at: np.ndarray, shard: int = SHARD) -> np.ndarray:
    """For the strings (bytes with offsets; string i stands at doc[i], at[i]): whether each window, string by string, also occurs earlier."""
    buf, off = strings
    length = np.diff(off)
    count = length - WINDOW + 1
    shards, tags = [], []
    i = 0
    while i < len(length):
        j = max(i + 1, int(np.searchsorted(off + np.arange(len(off)), off[i] + i + shard, "right")) - 1)
        ends = off[i + 1 : j + 1] - off[i]
        data = np.insert(buf[off[i] : off[j]], ends, 0)
        window = np.full(len(data), -1, np.int64)
        own = count[i:j]
        window[ranges(off[i:j] - off[i] + np.arange(j - i), own)] = np.arange(own.sum()) + count[:i].sum()
        shards.append(Shard(data))
        tags.append(window)
        i = j
    z, block = merge_transforms(shards)
    window = np.empty(len(z), np.int64)
    window[np.argsort(z, kind="stable")] = np.concatenate([t[s.order] for t, s in zip(tags, shards, strict=True)])
    real = window >= 0
    window, block = window[real], block[real]
    owner = np.repeat(np.arange(len(length)), count)
    place = ranges(at, count)
    order = np.lexsort((place[window], doc[owner[window]], block))
    late = np.zeros(len(window), bool)
    late[window[order]] = ~runs(block[order])
    return late


def merge_shards(batches: Iterator[pa.RecordBatch], merge: int = MERGE, shard: int = SHARD) -> Iterator[pa.RecordBatch]:
    """Merges strings (anchor, doc_id, at, bytes), sorted by anchor, in groups of whole anchors; yields the covered runs."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        doc, at = table.column(1).to_numpy(), table.column(2).to_numpy()
        buf, off = utf8(table.column(3))
        buf, off = buf[off[0] : off[-1]], off - off[0]
        late = repeated_windows((buf, off), doc, at, shard)
        count = np.diff(off) - WINDOW + 1
        owner, place = np.repeat(np.arange(len(count)), count)[late], ranges(at, count)[late]
        key, s, e = merge_spans(owner, place, place + WINDOW)
        return _found(doc[key], s, e - s, 0, COVER)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        while batch.num_rows:
            anchor = batch.column(0).to_numpy()
            total = np.cumsum(np.diff(utf8(batch.column(3))[1])) + size
            over = int(np.searchsorted(total, merge))
            if over < len(anchor) or size >= merge:
                over = min(over, len(anchor) - 1) if size < merge else 0
                edge = anchor[over] if size < merge else held[-1].column(0)[-1].as_py()
                cut = over + int(np.searchsorted(-(anchor[over:] == edge).astype(np.int8), 0)) if anchor[over] == edge else over
                if cut < len(anchor):
                    held.append(batch.slice(0, cut))
                    yield solve(held)
                    held, size, batch = [], 0, batch.slice(cut)
                    continue
            held.append(batch)
            size = int(total[-1])
            break
    if held:
        yield solve(held)


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact way for hot anchors: a 128-bit fingerprint of each window."""
    for batch in batches:
        doc, at = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for d, a, data in zip(doc, at, batch.column(3).to_pylist(), strict=True):
            marks = [hashlib.blake2b(data[k : k + WINDOW], digest_size=16).digest() for k in range(len(data) - WINDOW + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), pa.array(np.full(len(marks), d)), pa.array(np.arange(len(marks)) + a)], names=["mark", "doc_id", "at"])


# --- operator -----------------------------------------------------------------------------------------------------------------------------------


def repeated_spans(docs: DataFrame, hot_strings: int = HOT_STRINGS) -> DataFrame:
    """doc_id, at, n (bytes): covered runs of docs (doc_id unique, text), not yet merged."""
    segment = "anchor long, content long, doc_id long, at long, n int"
    found = "doc_id long, at long, n int, anchor long, kind byte"
    met = docs.select(ID, "text").mapInArrow(find_segments, segment).repartition("anchor").mapInArrow(partial(meet, hot_strings=hot_strings), found)
    met = stored(met, "segments")
    asked = met.filter(F.col("kind") != COVER).groupBy(ID).agg(F.collect_list(F.struct("at", "n", "anchor", "kind")).alias("asked"))
    string = "anchor long, doc_id long, at long, bytes binary"

    def strings(kind: int) -> DataFrame:
        own = asked.select(ID, F.filter("asked", lambda x: x.kind == kind).alias("asked")).filter(F.size("asked") > 0)
        return docs.select(ID, "text").join(own, ID).select(ID, "text", "asked").mapInArrow(cut_segments, string)

    late = strings(ASK).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(merge_shards, found).select(ID, "at", "n")
    every = met.filter(F.col("kind") == COVER).select(ID, "at", "n").unionByName(late)
    if not met.filter(F.col("kind") == ASK_HOT).isEmpty():
        windows = strings(ASK_HOT).mapInArrow(fingerprints, "mark binary, doc_id long, at long")
        first = windows.groupBy("mark").agg(F.min(F.struct(ID, "at")).alias("first"))
        again = windows.join(first, "mark").filter(F.struct(ID, "at") != F.col("first"))
        every = every.unionByName(again.select(ID, "at", F.lit(WINDOW).alias("n")))
    return every


def _kept(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = utf8(batch.column(1))
        spans = batch.column(2)
        count = np.asarray(spans.value_lengths().fill_null(0))
        rows = spans.flatten()
        at, n = np.asarray(rows.field("at")).astype(np.int64), np.asarray(rows.field("n")).astype(np.int64)
        doc, s, e = merge_spans(np.repeat(np.arange(len(count)), count), at, at + n)
        first = np.searchsorted(doc, np.arange(len(count) + 1))
        out = []
        for i in range(len(count)):
            own = memoryview(buf[off[i] : off[i + 1]])
            a, b = s[first[i] : first[i + 1]], e[first[i] : first[i + 1]]
            kept = b"".join(own[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(own)], strict=True))
            removed = int((b - a).sum())
            out.append((len(own), removed, len(a), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if texts else None, [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)] if texts else None))
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        arrays = [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        arrays += batch.columns[3:]
        names += batch.schema.names[3:]
        if texts:
            arrays += [pa.array(columns[4], pa.string()), pa.array(columns[5], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            names += ["kept_text", "spans"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def dedup_substrings(documents: DataFrame, hot_strings: int = HOT_STRINGS, texts: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, the columns to carry along and, with texts, kept_text and spans (start, end in bytes).

    A null text is empty. Rows that repeat a doc_id are one document (its greatest text); a row with a null doc_id matches nothing and keeps its
    bytes. Documents under 100 bytes lose nothing. kept_text leaves out characters that a removed run has cut through. Other columns are ignored.
    """
    docs = unique_rows(documents, ID, "text", *carry)
    spans = repeated_spans(docs, hot_strings).groupBy(ID).agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    lone = keyless_rows(documents, ID, "text", *carry).withColumn("spans", F.lit(None).cast("array<struct<at:long,n:int>>"))
    rows = docs.join(spans, ID, "left").select(ID, "text", "spans", *carry).unionByName(lone.select(ID, "text", "spans", *carry))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    if texts:
        schema += ", kept_text string, spans array<struct<start:long,end:long>>"
    return rows.mapInArrow(partial(_kept, texts=texts), schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op1_suffix_dedup: the digest columns of dedup_substrings over documents."""
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
