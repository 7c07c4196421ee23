"""Cross-tokenizer alignment: which tokens of two tokenizers end together, how often over the corpus, and how well each document's links agree with that.

Both tokenizers see a space and the text. Byte offsets at which tokens of both end cut a document into groups; the two tokens that end there are linked. A
chunk is what stands between spaces at which both tokenizers surely start anew (a space after no space and before no white space): its tokens, its groups
and its links don't depend on its neighbours, so a worker encodes each different chunk once and documents are put together from numbers.

Links of a document are summed by pair and packed by stripe, the B id modulo STRIPES. Pairs are then counted by stripe into dense blocks (B ids of the stripe by
all A ids, np.add.at); a row's maximum is the best count of its B id. Scoring deals the packed links by the same stripes, beside the counts of their stripe.
Packs of one stripe are dealt over as many parts as its links need, and the counts go to each part, so a frequent id is never one task's work; what a task
holds is one block, the packs of its part and one slice of texts. Counts by stripe (at most STRIPES rows) are the only broadcast.

Every row of documents is a document of its own, also those that repeat a doc_id or have none. A text that is null or empty, or whose tokens don't spell the space
and the text, has no tokens. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm._common import ranges, runs, stored
from docmill.llm._tokens import tokenizer_path

STRIPES = 128  # of B ids; a block has B's vocabulary / STRIPES rows of A's vocabulary columns, eight bytes each
PART = 4 << 20  # links (summed by document and pair) that a part of a stripe has at about most
PACK = 1 << 20  # links that are packed at a time, over all stripes
SLICE = 1 << 20  # code points of text that are encoded at a time
WORDS_HELD, CODES_HELD = 300_000, 32 << 20  # chunks, and code points of them, that a worker keeps; beyond that it starts anew

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"

_CHUNK = re.compile(r"(?<=[^ ]) (?=\S)").split


def _byte_of_letter() -> dict[str, int]:
    """The bytes that the letters of a byte-level vocabulary stand for: printable ones themselves, the others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class PairCoder:
    """Encodes chunks with both tokenizers and knows each chunk's groups and links."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = _byte_of_letter()
        self.bytes_a = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{path_b}: pieces reach over spaces, so chunks can't be encoded by themselves")
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(max(self.bytes_a) + 1)], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        written = [f"{i}{mark}".encode() for i in range(max(len(self.size_a), len(self.size_b))) for mark in ",|;"]
        self.written = np.frombuffer(b"".join(written), np.uint8)
        self.written_size = np.array([len(x) for x in written], np.int64)
        self.written_at = np.cumsum(self.written_size) - self.written_size
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.codes = 0
        self.groups: list[bytes] = []  # of each chunk, every group ended by ";"
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, whether its tokens don't spell it
        self.first = np.zeros(0, np.int64)  # place of its first link
        self.links = np.zeros((0, 2), np.uint32)

    def _spelled(self, chunks: list[str], of_a: list[list[int]], of_b: list[list[int]]) -> np.ndarray:
        """Whether both tokenizers' tokens spell a space and the chunk."""
        bytes_a, bytes_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        if b"".join(map(bytes_a, chain.from_iterable(of_a))) == b"".join(map(bytes_b, chain.from_iterable(of_b))) == f" {' '.join(chunks)}".encode():
            return np.ones(len(chunks), bool)
        each = zip(chunks, of_a, of_b, strict=True)
        return np.array([b"".join(map(bytes_a, a)) == b"".join(map(bytes_b, b)) == f" {c}".encode() for c, a, b in each], bool)

    def _learn(self, chunks: list[str]) -> None:
        """Encodes new chunks and lays both sequences of tokens, one chunk behind the other, over the bytes that they spell."""
        of_a = [e.ids for e in self.a.encode_batch_fast([f" {c}" for c in chunks], add_special_tokens=False)]
        of_b = self.b.encode(chunks, num_threads=1)
        spelled = self._spelled(chunks, of_a, of_b)
        for k in np.flatnonzero(~spelled).tolist():
            of_a[k] = of_b[k] = []
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (of_a, of_b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((of_a, n_a), (of_b, n_b)))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        total = int(end_a[-1]) if len(a) else 0
        ends = np.zeros((2, total + 1), bool)
        ends[0, end_a] = ends[1, end_b] = True
        last_a, last_b = ends[1, end_a], ends[0, end_b]  # tokens that end where one of the other tokenizer does
        # groups in order, in each the tokens of A and then those of B
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        written = np.concatenate([3 * a + last_a, 3 * b + 2 * last_b])[order]  # followed by "," or "|", by "," or ";"
        data = self.written[ranges(self.written_at[written], self.written_size[written])]
        # a chunk ends with its last group, so its text is as long as what its tokens are written as
        up_to = np.concatenate([[0], np.cumsum(self.written_size[3 * a])])[np.cumsum(n_a)] + np.concatenate([[0], np.cumsum(self.written_size[3 * b])])[np.cumsum(n_b)]
        data, at = data.tobytes(), [0, *up_to.tolist()]
        self.groups += [data[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
        n_links = np.diff(np.concatenate([[0], np.cumsum(last_a)])[np.concatenate([[0], np.cumsum(n_a)])])
        self.first = np.append(self.first, len(self.links) + np.cumsum(n_links) - n_links)
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_links, ~spelled], 1)])
        self.links = np.concatenate([self.links, np.stack([a[last_a], b[last_b]], 1).astype(np.uint32)])
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks)), strict=True))
        self.codes += sum(map(len, chunks))

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The chunks of all texts as numbers, and how many each text has; an empty text has none."""
        chunks = [_CHUNK(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(chunks))
        different = dict.fromkeys(flat)
        new = [c for c in different if c not in self.known]
        if len(self.known) + len(new) > WORDS_HELD or self.codes > CODES_HELD:
            self.forget()
            new = list(different)
        for k in range(0, len(new), 5000):
            self._learn(new[k : k + 5000])
        return np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat)), np.fromiter(map(len, chunks), np.int64, len(chunks))


@lru_cache(maxsize=1)
def pair_coder(path_a: str, path_b: str) -> PairCoder:
    """One coder for each worker process and pair of vocabularies."""
    return PairCoder(path_a, path_b)


def summed(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Different tuples of the keys (the first matters most), sorted, and the sum of n of each."""
    order = np.lexsort(keys[::-1])
    keys, n = [k[order] for k in keys], n[order]
    new = np.flatnonzero(runs(*keys))
    return [k[new] for k in keys], np.add.reduceat(n, new) if len(new) else n


def packed(doc: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bytes:
    """Links as one value: all documents (numbered from the pack's first row), then all A ids, B ids and counts, four bytes each."""
    return np.concatenate([x.astype("<u4") for x in (doc, a, b, n)]).tobytes()


def unpacked(links: bytes) -> np.ndarray:
    """The four rows of packed()."""
    return np.frombuffer(links, "<u4").reshape(4, -1).astype(np.int64)


#: Rows of documents have no stripe; rows of links have nothing of a document but the number of their pack's first row.
_ENCODED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, stripe int, n_packed long, links binary"
_SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("stripe", pa.int32()), ("n_packed", pa.int64()), ("links", pa.binary())])


def _pack(first: int, held: list[tuple[np.ndarray, ...]], stripes: int) -> pa.RecordBatch:
    """The links held so far as a row for each stripe; first: number of the first document they may come from."""
    row, a, b, n = (np.concatenate(x) for x in zip(*held, strict=True))
    stripe = b % stripes
    order = np.argsort(stripe, kind="stable")
    stripe, row, a, b, n = stripe[order], row[order] - first, a[order], b[order], n[order]
    new = np.flatnonzero(runs(stripe))
    ends = np.append(new[1:], len(stripe))
    values = [packed(row[x:y], a[x:y], b[x:y], n[x:y]) for x, y in zip(new.tolist(), ends.tolist(), strict=True)]
    nothing = [pa.nulls(len(new), f.type) for f in _SCHEMA]
    nothing[0], nothing[7:] = pa.array(np.full(len(new), first)), [pa.array(stripe[new], pa.int32()), pa.array(ends - new), pa.array(values, pa.binary())]
    return pa.RecordBatch.from_arrays(nothing, schema=_SCHEMA)


def _encode(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, stripes: int, digest: bool) -> Iterator[pa.RecordBatch]:
    coder = pair_coder(path_a, path_b)
    row = first = TaskContext.get().partitionId() << 40
    held: list[tuple[np.ndarray, ...]] = []
    many = 0
    for batch in batches:
        for ids, texts in _slices(batch):
            number, each = coder.numbers(texts)
            ends = np.concatenate([[0], np.cumsum(each)])
            of = np.repeat(np.arange(len(texts)), each)
            unspelled = np.zeros(len(texts), bool)
            unspelled[of[coder.counts[number, 3] > 0]] = True
            total = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(coder.counts[number, :3], 0)])
            total = np.where(unspelled[:, None], 0, np.diff(total[ends], axis=0))
            groups = []
            for k, (x, y) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                written = b"".join(map(coder.groups.__getitem__, number[x:y].tolist()))[:-1] if not unspelled[k] else b""
                groups.append((hashlib.sha256(written).hexdigest() if digest else written.decode()) if written else "")
            good = ~unspelled[of]
            (of, number), n = summed([of[good], number[good]], np.ones(int(good.sum()), np.int64))
            size = coder.counts[number, 2]
            link = coder.links[ranges(coder.first[number], size)].astype(np.int64)
            (of, a, b), n = summed([np.repeat(of, size), link[:, 0], link[:, 1]], np.repeat(n, size))
            columns = [np.arange(row, row + len(texts)), ids, total[:, 0], total[:, 1], total[:, 2], total[:, 2], groups]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=False)], *[pa.nulls(len(texts), f.type) for f in list(_SCHEMA)[7:]]], schema=_SCHEMA)
            if len(a):
                held.append((of + row, a, b, n))
                many += len(a)
            row += len(texts)
            if many >= PACK:
                yield _pack(first, held, stripes)
                first, held, many = row, [], 0
    if held:
        yield _pack(first, held, stripes)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts (nulls: empty) of some rows at a time."""
    lengths = np.cumsum(pc.utf8_length(batch.column(1).fill_null("")).to_numpy(zero_copy_only=False)) if batch.num_rows else []
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(lengths, (lengths[i - 1] if i else 0) + SLICE, "right")))
        yield batch.column(0).slice(i, j - i), [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
        i = j


def encode(documents: DataFrame, path_a: str, path_b: str, digest: bool = False, stripes: int = STRIPES) -> DataFrame:
    """Encoded documents and packed links in one stored table: texts are read once. groups: "a1,a2|b1;a3|b2,b3" or its sha256."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(partial(_encode, path_a=path_a, path_b=path_b, stripes=stripes, digest=digest), _ENCODED), "alignments")


def _by_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for links in batch.column("links"):
            _, a, b, n = unpacked(links.as_py())
            (b, a), n = summed([b, a], n)
            out.append(np.stack([b, a, n]).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("stripe"), batch.column("part"), pa.array(out, pa.binary())], names=["stripe", "part", "pairs"])


def _block(stripe: int, pairs: np.ndarray, stripes: int, size_a: int, size_b: int) -> np.ndarray:
    """Counts of a stripe: a row for each of its B ids, a column for each A id."""
    block = np.zeros((-(-(size_b - stripe) // stripes), size_a), np.int64)
    np.add.at(block, (pairs[0] // stripes, pairs[1]), pairs[2])
    return block


def _counter(stripes: int, size_a: int, size_b: int):
    def count(key, packs):
        stripe = key[0].as_py()
        pairs = np.concatenate([np.frombuffer(x.as_py(), np.int64).reshape(3, -1) for x in packs["pairs"]], 1)
        block = _block(stripe, pairs, stripes, size_a, size_b)
        at, a = np.nonzero(block)
        return pa.table({"stripe": pa.array(np.full(len(a), stripe), pa.int32()), "b": pa.array(at * stripes + stripe, pa.int64()), "a": pa.array(a, pa.int64()), "n": pa.array(block[at, a])})

    return count


def _parted(encoded: DataFrame, part: int) -> tuple[DataFrame, DataFrame]:
    """Links with the part of their stripe that they belong to, and the number of parts of each stripe."""
    links = encoded.filter("stripe is not null").select("stripe", "row", "n_packed", "links")
    parts = links.groupBy("stripe").agg(F.ceil(F.sum("n_packed") / part).cast("int").alias("parts"))
    dealt = links.join(F.broadcast(parts), "stripe").select("stripe", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), "row", "links")
    return dealt, parts


def count_pairs(encoded: DataFrame, size_a: int, size_b: int, stripes: int = STRIPES, part: int = PART) -> DataFrame:
    """How many links each pair has over all documents: stripe, b, a, n; stored."""
    dealt, _ = _parted(encoded, part)
    pairs = dealt.select("stripe", "part", "links").mapInArrow(_by_pair, "stripe int, part int, pairs binary")
    blocks = pairs.groupBy("stripe", "part").applyInArrow(_counter(stripes, size_a, size_b), "stripe int, b long, a long, n long")
    return stored(blocks.groupBy("stripe", "b", "a").agg(F.sum("n").alias("n")), "pair-counts")


def _scorer(stripes: int, size_a: int, size_b: int):
    def score(key, packs, counts):
        if not packs.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in ("row", "n_best", "count_sum")})
        block = _block(key[0].as_py(), np.stack([counts[c].to_numpy() for c in ("b", "a", "n")]), stripes, size_a, size_b)
        best = block.max(1)
        out = []
        for first, links in zip(packs["row"].to_pylist(), packs["links"], strict=True):
            doc, a, b, n = unpacked(links.as_py())
            count = block[b // stripes, a]
            new = np.flatnonzero(runs(doc))
            out.append((doc[new] + first, np.add.reduceat(n * (count == best[b // stripes]), new), np.add.reduceat(n * count, new)))
        return pa.table({k: pa.array(np.concatenate(c)) for k, c in zip(("row", "n_best", "count_sum"), zip(*out, strict=True), strict=True)})

    return score


def score_links(encoded: DataFrame, counts: DataFrame, size_a: int, size_b: int, stripes: int = STRIPES, part: int = PART) -> DataFrame:
    """Sums over parts of the links of documents: row, n_best, count_sum; a document has a row for each stripe that it has links in."""
    dealt, parts = _parted(encoded, part)
    beside = counts.join(F.broadcast(parts), "stripe").select("stripe", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "b", "a", "n")
    return dealt.groupBy("stripe", "part").cogroup(beside.groupBy("stripe", "part")).applyInArrow(_scorer(stripes, size_a, size_b), "row long, n_best long, count_sum long")


def sizes(path_a: str, path_b: str) -> tuple[int, int]:
    """Ids of both vocabularies."""
    coder = pair_coder(path_a, path_b)
    return max(coder.bytes_a) + 1, len(coder.bytes_b)


def align(documents: DataFrame, path_a: str, path_b: str, digest: bool = False, stripes: int = STRIPES, part: int = PART) -> DataFrame:
    """A row for each row of documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups."""
    encoded = encode(documents, path_a, path_b, digest, stripes)
    both = sizes(path_a, path_b)
    scores = score_links(encoded, count_pairs(encoded, *both, stripes, part), *both, stripes, part)
    docs = encoded.filter("stripe is null").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    rows = docs.unionByName(scores, allowMissingColumns=True)
    whole = [F.max(c).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")]
    return rows.groupBy("row").agg(*whole, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13_token_alignment: every document of the table under both vocabularies."""
    made = align(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(A_VOCABULARY), tokenizer_path(B_VOCABULARY), digest=True)
    return made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
