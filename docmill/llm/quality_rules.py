"""Quality rules: base rules on every text, and a hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

An n-gram is a token or a pair of neighbouring tokens; tokens are runs of letters, marks and digits, and runs of other characters but white space, so that
symbols count wherever they stand in a word. Tokens fall into BUCKETS hash buckets and pairs, by the buckets of both, into as many of their own. Two multinomials over the
buckets are counted: one over all documents, one over those that the labels table trusts (quality 1, not toxic). A text's score is the mean over its
tokens, so normalised by length, of log(target share / raw share), and its pair_score that over its pairs. To the target PRIOR n-grams of the raw corpus
are added: an n-gram that the target lacks costs as much whether it is rare or not.

Rare tokens share buckets with others, and fewer are rare in larger corpora, so no threshold fits every corpus. Both come from the trusted documents:
each is scored by the counts of the other half of them, and the scores that all but one in a thousand reach are the least allowed. They are found
exactly, by counting scores in steps and then the one step that holds the rank in finer ones, so they don't depend on how rows are partitioned. A text
that passes the base rules is kept if it reaches both.

A text is read once: its measures and the buckets of its tokens are stored, and counting and scoring work on those. DataFrame functions only, and every
document is counted and scored.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm._common import ID, stored

BUCKETS = 1 << 16
PRIOR = 1000.0
UNIT = 1000  # a log-ratio is kept in thousandths
LEAST_TRUSTED = 20  # default of the caller's least number of trusted texts of LEAST_WORDS words; from fewer no threshold is set, with a warning
BELOW = 0.001  # share of the trusted texts that may score below the threshold
STEPS, FINE_STEPS = 10**4, 10**9  # of a score, in which ranks are found; scores lie within some 15 of 0, so 300,000 rows and then 100,000 reach the driver
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words

SPACE = " \t\n\x0b\x0c\r"
_SPACES = r"[\x20\x09-\x0D]"
_TOKEN = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Model:
    """The log-ratio of each bucket, in UNIT, of tokens and of pairs, and the least score of either (None: nothing is rejected)."""

    tokens: np.ndarray
    pairs: np.ndarray
    least: tuple[float, float] | None


NO_MODEL = Model(np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), None)


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACES + "+"))


def _fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, each computed once a row. A generator of one row ends them: a projection could be merged with what stands above it, a filter
    on the result or a lambda, and then be computed again there, even for each element of an array."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once however often it is used; it stays within the expression, so a long array is not copied into a row of its own."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _tokens(text: Column) -> Column:
    """The buckets of the tokens, less BUCKETS / 2 so that two bytes hold one."""
    found = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    return F.transform(found, lambda w: (F.pmod(F.xxhash64(w), F.lit(BUCKETS)) - BUCKETS // 2).cast("smallint"))


def _pairs(tokens: Column) -> Column:
    """The buckets of all pairs of neighbours, as _tokens gives them."""
    later = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.transform(later, lambda b, i: (F.pmod(F.xxhash64(F.get(tokens, i), b), F.lit(BUCKETS)) - BUCKETS // 2).cast("smallint"))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
SCORES = ("score", "pair_score")


def measured(docs: DataFrame, *columns: str) -> DataFrame:
    """c0, c1, ... (the named columns of docs; renamed, so that none clashes), id, MEASURES and tokens (buckets). A null text has no words.

    Three-word windows are told apart by 64-bit hashes; only texts where two hashes are equal are sorted.
    """
    df = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)], F.col(ID).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("t"))
    t = F.col("t")

    def in_windows(ordered: Column) -> Column:
        """Words in windows that stand beside an equal one."""
        again = lambda e, k: (F.coalesce(F.get(ordered, k - 1).h == e.h, F.lit(False))) | (F.coalesce(F.get(ordered, k + 1).h == e.h, F.lit(False)))
        places = F.transform(F.filter(ordered, again), lambda e: F.array(e.i, e.i + 1, e.i + 2))
        return F.size(F.array_distinct(F.flatten(places)))

    def repeated(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _once(ordered, in_windows)).otherwise(0)

    def of_words(w: Column) -> Column:
        windows = F.transform(F.slice(w, 3, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), x))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _once(windows, repeated).cast("long").alias("n_repeat_words"))

    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    doubled = _once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    df = _fixed(df, of_words=_once(_words(t), of_words), n_symbols=F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"), n_dup_lines=doubled, tokens=_tokens(t)).drop("t")
    df = df.select(*[c for c in df.columns if c != "of_words"], "of_words.*")
    return df.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def _table(values: np.ndarray) -> Column:
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<int>")  # folded into one literal


def _ratios(target: np.ndarray, raw: np.ndarray) -> list[np.ndarray]:
    """The log-ratio of each bucket, in UNIT, for tokens and for pairs (a row each of both)."""
    n, m = target.sum(axis=1, keepdims=True), raw.sum(axis=1, keepdims=True) + BUCKETS
    return list(np.rint(UNIT * np.log((target * (m / (raw + 1)) + PRIOR) / (n + PRIOR))).astype(np.int64))


def _score(grams: Column, table: Column) -> Column:
    """The mean log-ratio of n-grams; null without any."""
    total = F.aggregate(grams, F.lit(0).cast("long"), lambda a, b: a + F.get(table, b + BUCKETS // 2))
    return F.when(F.size(grams) > 0, total / (F.size(grams) * F.lit(float(UNIT))))


def _scored(df: DataFrame, tokens: Column, pairs: Column) -> DataFrame:
    """df with score and pair_score by these tables of log-ratios, without the tokens."""
    return _fixed(df, score=_score(F.col("tokens"), tokens), pair_score=_once(_pairs(F.col("tokens")), lambda p: _score(p, pairs))).drop("tokens")


def _counted(df: DataFrame, folds: int = 1) -> np.ndarray:
    """How often each bucket occurs, by fold, for tokens and for pairs; at most 2 * BUCKETS rows a fold come to the driver."""
    fold = F.col("fold") if folds > 1 else F.lit(0).alias("fold")
    of = lambda grams, kind: df.select(fold, F.explode(grams).alias("b")).groupBy("fold", "b").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    rows = of(F.col("tokens"), 0).unionByName(of(_pairs(F.col("tokens")), 1)).toArrow()
    out = np.zeros((folds, 2, BUCKETS), np.int64)
    place, kind, bucket, n = (rows.column(c).to_numpy() for c in ("fold", "kind", "b", "n"))
    out[place, kind, bucket.astype(np.int64) + BUCKETS // 2] = n
    return out


def _steps(scores: DataFrame, of: int, within: dict[str, int] | None = None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each score the steps that occur, ascending, and how often; only of rows within these coarse steps."""
    each = [F.struct(F.lit(c).alias("of"), F.col(c).alias("score")) for c in scores.columns]
    rows = scores.select(F.inline(F.array(*each))).filter("score is not null")
    if within:
        rows = rows.filter(reduce(Column.__or__, [(F.col("of") == c) & (F.floor(F.col("score") * STEPS) == k) for c, k in within.items()]))
    found = rows.groupBy("of", F.floor(F.col("score") * of).alias("step")).agg(F.count("*").alias("n")).toArrow()
    name, step, n = (found.column(c).to_numpy() for c in ("of", "step", "n"))
    out = {}
    for c in scores.columns:
        own = name == c
        order = np.argsort(step[own])
        out[c] = step[own][order], n[own][order]
    return out


def exact_least(scores: DataFrame, below: float = BELOW) -> tuple[int, tuple[float, ...] | None]:
    """How many scores the columns have (at least), and for each the value of the rank that the share `below` of them doesn't pass: the same under any partitioning."""
    coarse = _steps(scores, STEPS)
    n = min(int(c[1].sum()) for c in coarse.values())
    if not n:
        return 0, None
    place, rank = {}, {}
    for c, (step, count) in coarse.items():
        wanted = max(1, math.ceil(below * int(count.sum())))
        ends = np.cumsum(count)
        k = int(np.searchsorted(ends, wanted))
        place[c], rank[c] = int(step[k]), wanted - int(ends[k] - count[k])
    fine = _steps(scores, FINE_STEPS, place)
    # a thousandth of a step lower, so that a score on the step itself reaches it
    return n, tuple((int(step[np.searchsorted(np.cumsum(count), rank[c])]) - 0.001) / FINE_STEPS for c, (step, count) in fine.items())


def learn(texts: DataFrame, labels: DataFrame, least_trusted: int = LEAST_TRUSTED) -> Model:
    """The model for rows of measured(). labels: doc_id, quality, toxic; a document is trusted if no row objects. Without trusted ones all ratios are 0.

    With fewer than least_trusted trusted texts of LEAST_WORDS words the model has no threshold (least is None) and a warning says so.
    """
    good = (F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)
    trusted = labels.groupBy(F.col(ID).cast("long").alias("id")).agg(good.alias("good")).filter("good").select("id")
    raw = _counted(texts.select("tokens"))[0]
    # one plan at every size: nothing here has a bound that would let it be broadcast
    known = texts.select("id", "tokens", "n_words").join(trusted.hint("merge"), "id").withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int"))
    known = stored(known, "trusted-tokens")
    folds = _counted(known, 2)
    if not folds.any():
        return NO_MODEL
    of_other = [F.when(F.col("fold") == 0, _table(a)).otherwise(_table(b)) for a, b in zip(_ratios(folds[1], raw), _ratios(folds[0], raw), strict=True)]
    held_out = _scored(known.filter(F.col("n_words") >= LEAST_WORDS), *of_other)
    n, least = exact_least(stored(held_out.select(*SCORES), "trusted-scores"))
    if n < least_trusted:
        warnings.warn(f"{n} trusted texts of {LEAST_WORDS} words, {least_trusted} are asked for: no threshold is set", stacklevel=2)
        least = None
    return Model(*_ratios(folds.sum(axis=0), raw), least)


def judge(texts: DataFrame, model: Model) -> DataFrame:
    """Rows of measured() with score (null without words), pair_score (null without two tokens) and kept in place of the tokens; each row by itself."""
    df = _scored(texts, _table(model.tokens), _table(model.pairs))
    reached = [F.coalesce(c, F.lit(0.0)) >= least for c, least in zip(SCORES, model.least or (), strict=False)]
    return df.withColumn("kept", reduce(Column.__and__, reached, ~F.col("base_failed")))


def judged(documents: DataFrame, labels: DataFrame, *columns: str, least_trusted: int = LEAST_TRUSTED) -> DataFrame:
    """c0, c1, ... (the named columns of documents), MEASURES, SCORES and kept of every row."""
    texts = stored(measured(documents, *columns), "measured")
    return judge(texts, learn(texts, labels, least_trusted)).drop("id")


def kept_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that are kept, with their own columns only, whatever their names."""
    kept = judged(documents, labels, *documents.columns).filter("kept")
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(documents.columns)])


def quality_rules(documents: DataFrame, labels: DataFrame, least_trusted: int = LEAST_TRUSTED) -> DataFrame:
    """documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, pair_score and kept.

    A row is judged by its text alone, so rows with a null or repeated doc_id are rows like any other; columns of these names are replaced, and
    all others stay, whatever their names.
    """
    own = [c for c in documents.columns if c.lower() not in (*MEASURES, *SCORES, "kept")]
    rows = judged(documents, labels, *own, least_trusted=least_trusted)
    return rows.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(own)], *MEASURES, *SCORES, "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_quality_rules: every document of the table."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judged(docs, labels, ID).select(F.col("c0").alias(ID), *MEASURES, "kept", *SCORES)
