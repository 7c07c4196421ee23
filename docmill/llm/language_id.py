"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary.

For each language a unigram distribution over the pieces of a public SentencePiece vocabulary is learned by expectation maximisation. The probability of a
word is the sum over all its segmentations into pieces (the forward algorithm); a text's is the product over its words. The predicted language is the most
probable one. Words are runs of letters and marks in small letters, a leading mark for the word's start before them; a character outside the vocabulary
is a piece of its own with a small share. Each different word of a batch is scored once, for all languages at the same time.

The distributions are fitted on at most TRAIN_DOCS whole documents of a language, those with the least hash of their doc_id: a bounded, documented sample.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.llm._common import ID, keyless_rows, unique_rows
from docmill.llm._tokens import tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
TRAIN_DOCS = 1500  # of a language at most
ROUNDS = 3  # of expectation maximisation
UNKNOWN_SHARE = 1e-7  # of a character outside the vocabulary
SMOOTHING = 0.1  # added to each piece's expected count
SLICE = 2 << 20
WORDS_HELD = 200_000
WORDS_AT_ONCE = 4000  # whose edges are worked on together
LEAST_SCORE = 0.5

NO_LANGUAGE = "und"
_START = "\u2581"


class Pieces:
    """The vocabulary: pieces in small letters without inner word starts, and their prefixes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        texts = sorted({sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))})
        self.number = {p: k for k, p in enumerate(p for p in texts if p == p.lower() and _START not in p[1:])}
        self.unknown = len(self.number)
        self.known = dict.fromkeys((p[:k] for p in self.number for k in range(1, len(p))), -1) | self.number

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """word, from, to, piece of every piece in every word (from and to: places in the marked word), and the words' lengths."""
        word, begin, end, piece = [], [], [], []
        known, unknown = self.known, self.unknown
        for k, w in enumerate(words):
            w = _START + w
            for i in range(len(w)):
                for j in range(i + 1, len(w) + 1):
                    p = known.get(w[i:j])
                    if p is None:
                        if j == i + 1:
                            word.append(k), begin.append(i), end.append(j), piece.append(unknown)
                        break
                    if p >= 0 or j == i + 1:
                        word.append(k), begin.append(i), end.append(j), piece.append(p if p >= 0 else unknown)
        length = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        return np.array(word, np.int64), np.array(begin, np.int64), np.array(end, np.int64), np.array(piece, np.int64), length


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log of the sum of exp(values) over groups of rows that begin at first."""
    top = np.maximum.reduceat(values, first, axis=0)
    size = np.diff(np.append(first, len(values)))
    return top + np.log(np.add.reduceat(np.exp(values - np.repeat(top, size, axis=0)), first, axis=0))


def forward(edges: tuple[np.ndarray, ...], weight: np.ndarray, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(log sums at all places, place of each word's start) by the forward, or backward, algorithm; weight: log share of each edge, a column a language."""
    word, begin, end, _, length = edges
    at = np.concatenate([[0], np.cumsum(length + 1)])
    table = np.full((at[-1], weight.shape[1]), -np.inf)
    table[(at[:-1] + length) if backward else at[:-1]] = 0.0
    source, target = at[word] + (end if backward else begin), at[word] + (begin if backward else end)
    step = (length[word] - begin) if backward else end
    order = np.lexsort((target, step))
    cuts = np.searchsorted(step[order], np.arange(1, (int(step.max()) if len(step) else 0) + 2))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        e = order[a:b]
        if len(e):
            first = np.flatnonzero(np.append(True, target[e][1:] != target[e][:-1]))
            table[target[e][first]] = _sums(table[source[e]] + weight[e], first)
    return table, at


def word_scores(words: list[str], shares: np.ndarray, path: str) -> np.ndarray:
    """log probability of each word (rows) in each language (columns)."""
    edges = pieces(path).edges(words)
    table, at = forward(edges, shares[edges[3]])
    return table[at[1:] - 1]


def fit(words: list[str], counts: np.ndarray, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """log shares of the pieces (and of an unknown character, last) for the counted words of one language. Memory grows with their edges, at 16 bytes each;
    all else is of WORDS_AT_ONCE words."""
    vocabulary = pieces(path)
    cuts = range(0, len(words), WORDS_AT_ONCE)
    held = [tuple(e.astype(np.int32) for e in vocabulary.edges(words[k : k + WORDS_AT_ONCE])) for k in cuts]
    n = vocabulary.unknown
    shares = np.full(n + 1, 1.0 / n)
    for _ in range(rounds):
        shares[n] = UNKNOWN_SHARE
        logs, expected = np.log(shares), np.zeros(n + 1)
        for k, edges in zip(cuts, held, strict=True):
            expected += _expected(edges, logs, counts[k : k + WORDS_AT_ONCE])
        expected[n] = 0
        shares = (expected + SMOOTHING) / (expected.sum() + SMOOTHING * n)
    shares[n] = UNKNOWN_SHARE
    return np.log(shares)


def _expected(edges: tuple[np.ndarray, ...], logs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the counted words of these edges."""
    word, begin, end, piece, _ = edges
    weight = logs[piece][:, None]
    ahead, at = forward(edges, weight)
    behind, _ = forward(edges, weight, backward=True)
    whole = ahead[at[1:] - 1, 0]
    used = np.exp(ahead[at[word] + begin, 0] + weight[:, 0] + behind[at[word] + end, 0] - whole[word])
    return np.bincount(piece, weights=used * counts[word], minlength=len(logs))


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(words of all texts, distinct by code; offsets of the texts): runs of letters and marks in small letters."""
    bare = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}]+", " "), " ")
    split = pc.ascii_split_whitespace(bare)
    return split.flatten().dictionary_encode(), np.asarray(split.offsets) - split.offsets[0].as_py()


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    texts = texts.fill_null("").cast(pa.large_string())
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + SLICE, "right")))
        yield texts.slice(i, j - i)
        i = j


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> lang, word, n."""
    counts: Counter = Counter()
    for batch in batches:
        langs = batch.column(0).to_pylist()
        at = 0
        for texts in _slices(batch.column(1)):
            code, off = split_words(texts)
            index, words = np.asarray(code.indices), code.dictionary.to_pylist()
            for k in range(len(texts)):
                ids, n = np.unique(index[off[k] : off[k + 1]], return_counts=True)
                counts.update({(langs[at + k], words[i]): c for i, c in zip(ids.tolist(), n.tolist(), strict=True) if words[i]})
            at += len(texts)
    keys = list(counts)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["lang", "word", "n"])


def _fitted(table: pd.DataFrame, path: str) -> pd.DataFrame:
    table = table.sort_values("word")
    shares = fit(table["word"].tolist(), table["n"].to_numpy(), path)
    return pd.DataFrame({"lang": [table["lang"].iloc[0]], "shares": [shares.tolist()]})


class Model:
    """Languages and, for each, the log shares of all pieces: its size is set by the vocabulary and the number of languages."""

    def __init__(self, rows: list[tuple[str, list[float]]], path: str):
        rows = sorted(rows)
        self.languages, self.path = [r[0] for r in rows], path
        self.shares = np.array([r[1] for r in rows]).T if rows else np.zeros((0, 0))


def learn(labelled: DataFrame, vocabulary: str, most: int = TRAIN_DOCS) -> Model:
    """Fits on documents (doc_id, text, lang not null): of each language the `most` with the least hash of their id."""
    rows = labelled.filter("lang is not null and text is not null and doc_id is not null").select(ID, "lang")
    least = Window.partitionBy("lang").orderBy(F.xxhash64(ID), ID)
    # the ids alone are ranked, `most` of each partition first, so that no language meets in one task
    parts = rows.withColumn("part", F.pmod(F.xxhash64(ID, F.lit(1)), F.lit(64)))
    near = parts.withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(F.xxhash64(ID), ID))).filter(F.col("r") <= most)
    chosen = near.withColumn("r", F.row_number().over(least)).filter(F.col("r") <= most).select(ID)
    texts = labelled.select(ID, "lang", "text").join(chosen.distinct(), ID, "left_semi").select("lang", "text")
    words = texts.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    fitted = words.groupBy("lang").applyInPandas(partial(_fitted, path=vocabulary), "lang string, shares array<double>")
    return Model([(r.lang, r.shares) for r in fitted.collect()], vocabulary)


class Scorer:
    """Keeps the scores of words that a worker has met."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        out_lang, out_score = [], []
        names = np.array([*self.model.languages, NO_LANGUAGE], object)
        for part in _slices(texts):
            code, off = split_words(part)
            words = code.dictionary.to_pylist()
            new = [w for w in words if w not in self.known]
            if len(self.known) + len(new) > WORDS_HELD:
                self.known, self.scores, new = {}, self.scores[:0], words
            if new and self.model.languages:
                got = [word_scores(new[k : k + WORDS_AT_ONCE], self.model.shares, self.model.path) for k in range(0, len(new), WORDS_AT_ONCE)]
                got = np.concatenate(got)
                got[[k for k, w in enumerate(new) if not w]] = 0.0  # what an empty text is split into
                self.known.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
                self.scores = np.concatenate([self.scores, got])
            letters = np.asarray(pc.match_substring_regex(part, r"\p{L}"))
            best, score = np.full(len(part), len(self.model.languages)), np.zeros(len(part))
            if self.model.languages and words:
                number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[np.asarray(code.indices)]
                sums = np.zeros((len(part), len(self.model.languages)))
                full = np.diff(off) > 0
                sums[full] = np.add.reduceat(self.scores[number], off[:-1][full], axis=0)
                top = sums.max(axis=1)
                chance = 1.0 / np.exp(sums - top[:, None]).sum(axis=1)
                best[letters], score[letters] = sums.argmax(axis=1)[letters], chance[letters]
            out_lang += names[best].tolist()
            out_score += score.tolist()
        return out_lang, out_score


_scorers: dict[tuple, Scorer] = {}  # of a worker, for the tasks that it runs one after another


def scorer_of(model: Model) -> Scorer:
    """The worker's scorer of a model, with the words that its earlier tasks met; a worker holds one."""
    key = (model.path, *model.languages, hashlib.sha256(model.shares.tobytes()).digest())
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def _predicted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scorer = scorer_of(model)
    for batch in batches:
        langs, scores = scorer.predict(batch.column(batch.num_columns - 1))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score (the posterior of that language), from the text alone; no row needs another.

    A null text or one without a letter is `und` with score 0, and so is every text if no language has been learned. Columns of these names are replaced.
    """
    rows = docs.drop("lang_pred", "score")
    rows = rows.select(*[c for c in rows.columns if c != "text"], "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", lang_pred string, score double"
    return rows.mapInArrow(partial(_predicted, model=model), schema).select(*docs.drop("lang_pred", "score").columns, "lang_pred", "score")


def held_out(key: str = ID) -> Column:
    """Whether crc32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def predict_languages(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those that are not held out and have a language.

    Rows that repeat a doc_id are one document (the greatest text, then lang); rows with a null doc_id are predicted, and nothing is learned from them.
    """
    docs = unique_rows(documents, ID, "text", "lang")
    model = learn(docs.filter(~held_out()), vocabulary)
    rows = docs.select(ID, "text").unionByName(keyless_rows(documents, ID, "text"))
    return identify(rows, model).select(ID, held_out().alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_language_id: every document of the table."""
    return predict_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(VOCABULARY))
