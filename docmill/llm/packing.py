"""Best-fit packing after a Martello-Toth dominance reduction, into sequences of at most 4096 tokens.

Sizes are whole numbers from 1 to the capacity, so the instance is a histogram with a row for each size, however many documents there are. The plan is
made on it: first, sets of one or two sizes that dominate every other set with their largest member are fixed, as often as both sizes last; then
best fit, sizes descending, over runs (equal sequences with a count). The plan has some ten thousand entries at most, a bound that the capacity
sets and the corpus does not. Each piece then finds its place from its rank among pieces of its size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.llm._common import ID, keyless_rows, ranges, stored, unique_rows
from docmill.llm._tokens import tokenizer_path, word_coder
from docmill.llm.token_records import END, VOCABULARY, ids_crc32

CAPACITY = 4096

Run = tuple[int, list[tuple[int, int]]]  # how many sequences, and of what: (size, how many of it)


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> list[Run]:
    """Fixes dominating sets and takes them from counts (counts[s]: pieces of size s), largest size first.

    With a piece of size j in a sequence, r is left. {j} dominates if nothing else fits. {j, t}, t the largest that fits, dominates if t fills r, or
    no two other pieces fit, or no three do and t is at least the best pair: all that may stand beside j can change places with t.
    """
    fixed: list[Run] = []
    sizes = [s for s in range(1, capacity + 1) if counts[s]]
    for j in sizes[::-1]:
        while counts[j]:
            counts[j] -= 1  # one piece of size j looks for company among the others
            others = [s for s in sizes if s <= capacity - j and counts[s]]
            room = capacity - j
            if not others:
                counts[j] += 1
                fixed.append((int(counts[j]), [(j, 1)]) if 2 * j > capacity else (1, [(j, 1)]))
                counts[j] -= fixed[-1][0]
                continue
            least = [s for s in others[:3] for _ in range(min(3, int(counts[s])))][:3]
            t = others[-1]
            good = t == room or len(least) < 2 or least[0] + least[1] > room
            if not good and (len(least) < 3 or sum(least) > room):
                pair, low, high = 0, 0, len(others) - 1
                while low <= high:
                    both = others[low] + others[high]
                    if both > room:
                        high -= 1
                    else:
                        if low < high or counts[others[low]] > 1:
                            pair = max(pair, both)
                        low += 1
                good = t >= pair
            counts[j] += 1
            if not good:
                break
            # What is left only shrinks, so the proof holds as long as both sizes last.
            often = int(counts[j] // 2 if t == j else min(counts[j], counts[t]))
            fixed.append((often, [(j, 2)] if t == j else [(j, 1), (t, 1)]))
            counts[j] -= often
            counts[t] -= often
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[Run]:
    """Best fit, sizes descending; a piece goes where least room is left, so a sequence takes as many of a size as it can before the next does."""
    open_runs: dict[int, list[Run]] = {}
    rooms: list[int] = []

    def put(room: int, run: Run) -> None:
        if room not in open_runs:
            open_runs[room] = []
            insort(rooms, room)
        open_runs[room].append(run)

    for s in range(capacity, 0, -1):
        left = int(counts[s])
        while left:
            k = bisect_left(rooms, s)
            if k == len(rooms):
                room, run = capacity, (-(-left // (capacity // s)), [])
            else:
                room = rooms[k]
                run = open_runs[room].pop()
                if not open_runs[room]:
                    del open_runs[room], rooms[k]
            each = room // s
            full = min(run[0], left // each)
            rest = run[0] - full
            if full:
                put(room - each * s, (full, [*run[1], (s, each)]))
                left -= full * each
            if rest and 0 < left < each:
                put(room - left * s, (1, [*run[1], (s, left)]))
                left, rest = 0, rest - 1
            if rest:
                put(room, (rest, run[1]))
    return [run for runs in open_runs.values() for run in runs]


class Plan:
    """Where the pieces of each size go: entry k takes the ranks from first[k] on, per[k] of them to a sequence, from sequence base[k], place offset[k]."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        counts = np.zeros(capacity + 1, np.int64)
        for s, n in histogram.items():
            counts[s] = n
        runs = reduce_by_dominance(counts, capacity)
        self.n_fixed = sum(r[0] for r in runs)
        runs += best_fit(counts, capacity)
        taken, sequence, entries = dict.fromkeys(histogram, 0), 0, []
        for often, items in runs:
            offset = 0
            for s, per in items:
                entries.append((s, taken[s], per, sequence, offset))
                taken[s] += often * per
                offset += s * per
            sequence += often
        self.n_sequences = sequence
        table = np.array(sorted(entries), np.int64).reshape(-1, 5)
        self.size, self.first, self.per, self.base, self.offset = table.T

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence_id, offset) of pieces by their size and rank among pieces of that size."""
        k = np.searchsorted((self.size << 40) | self.first, (size << 40) | rank, "right") - 1
        over = rank - self.first[k]
        return self.base[k] + over // self.per[k], self.offset[k] + over % self.per[k] * size


PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end: int, capacity: int) -> Iterator[pa.RecordBatch]:
    coder = word_coder(path)
    part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    for batch in batches:
        doc_ids = batch.column(0).to_numpy(zero_copy_only=False) if not batch.column(0).null_count else np.array(batch.column(0).to_pylist(), object)
        for first, ids, off in coder.encode(batch.column(1)):
            n = np.diff(off) + 1
            each = -(-n // capacity)
            of = np.repeat(np.arange(len(n)), each)
            piece = ranges(np.zeros(len(n), np.int64), each)
            start = piece * capacity
            length = np.minimum(n[of] - start, capacity)
            tailed = np.insert(ids, off[1:], np.uint32(end)).astype("<u4")
            at = off[:-1][of] + of + start
            crc = [ids_crc32(tailed[a : a + k]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            # the rank of each piece among this partition's pieces of its size
            order = np.argsort(length, kind="stable")
            sizes, begin, many = np.unique(length[order], return_index=True, return_counts=True)
            nth = np.empty(len(length), np.int64)
            nth[order] = ranges(seen[sizes], many)
            seen[sizes] += many
            columns = (doc_ids[first + of], piece, start, length, crc, np.full(len(of), part), nth)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECE, strict=True)], schema=PIECE)


def _placed(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sequence, offset = plan.place(batch.column(3).to_numpy(), batch.column(5).to_numpy())
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(documents: DataFrame, vocabulary: str, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece with the end id alone. Rows that repeat a doc_id are one document (its greatest text); rows with a null doc_id
    are packed like any other. Other columns are ignored. Texts are encoded once; the pieces, a few numbers each, are stored and then placed.
    """
    docs = unique_rows(documents, ID, "text").unionByName(keyless_rows(documents, ID, "text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    pieces = stored(docs.mapInArrow(partial(_pieces, path=vocabulary, end=end, capacity=capacity), schema), "pieces")
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "part"]).select(ID, "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(partial(_placed, plan=Plan(histogram, capacity)), out)


def query(spark, sf_dir: str) -> DataFrame:
    """op4_best_fit_packing: every document of the table, packed."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(VOCABULARY))
