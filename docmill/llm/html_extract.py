"""HTML extraction by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative, and one linear scan finds the contiguous region with the greatest sum:
the main text. The weights are learned from labelled pages, here those that mark their main text themselves with an article or main element: a tag's
weight is the logarithm of how often it stands inside against outside, at most a small negative number. The labelled pages also say which containers
(nav, footer, div of a class, ...) hold no main text; words in those score negative, and those within the region are left out of the text. Containers
that the labelled pages don't show are judged by a short list of names; a div or section without class, id and role says nothing either way.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm._common import keyless_rows, unique_rows

#: Fixed names of HTML: elements whose content is no text, that begin a new block, that contain others, and those that by name hold no main text.
SILENT = ("script", "style", "template", "noscript", "svg", "title", "textarea", "iframe", "object", "select", "math")
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
CONTAINER = frozenset("article aside div footer form header main nav section".split())
ASIDE_TAGS = frozenset("aside button dialog footer form menu nav".split())
ASIDE_NAMES = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies disclaimer footer masthead menu navbar navigation newsletter notice notices popup promo promotion related responses share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())

LEAST_SEEN = 50  # words that a container needs on labelled pages to be judged by them
MOST_INSIDE = 0.02  # of its words; a container with a smaller share inside holds no main text
TAG_COST, TAG_FLOOR = -0.05, -3.0  # the greatest and the least weight of a tag
ASIDE_COST = -1.0  # of a word in a container without main text

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)|(?P<text>[^<]+|<)""",
    re.S,
)
_CLASS = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")

Token = tuple[str, str, str]  # kind ("open", "close", "text"), tag name or text, names of the class, id and role


def tokens(page: str) -> Iterator[Token]:
    """The tags and texts of a page; comments, declarations and the content of silent elements are passed over."""
    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        if (text := m["text"]) is not None:
            yield "text", text, ""
        elif tag := m["tag"] or m["tag2"]:
            tag = tag.lower()
            if m["close"] or m["close2"]:
                yield "close", tag, ""
                continue
            rest = m["rest"] if m["tag"] else m["rest2"]
            names = " ".join(a or b or c for _, a, b, c in _CLASS.findall(rest)).lower() if rest else ""
            yield "open", tag, names
            if tag in SILENT and not rest.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)


def key_of(tag: str, names: str) -> str:
    return f"{tag}.{names}" if names and tag in CONTAINER else tag


class Place:
    """An open container and those around it: whether one of them is an article or main element, and whether none of those around it has its key."""

    __slots__ = ("key", "around", "inside", "first", "words")

    def __init__(self, key: str, around: Place | None, first: bool):
        self.key, self.around, self.first = key, around, first
        self.inside = key.split(".")[0] in ("article", "main") or (around is not None and around.inside)
        self.words = [0, 0]  # outside and inside an article or main element


def walk(page: str) -> Iterator[tuple[str, str, str, Place | None]]:
    """(kind, key, text or tag, innermost open container) of each token; an end tag without its start closes nothing. A step costs the same at any depth."""
    places: list[Place] = []
    keys: Counter = Counter()
    tags: Counter = Counter()
    for kind, value, names in tokens(page):
        now = places[-1] if places else None
        if kind == "text":
            yield kind, "", value, now
        elif kind == "open":
            key = key_of(value, names)
            yield kind, key, value, now
            if value in CONTAINER:
                places.append(Place(key, now, not keys[key]))
                keys[key] += 1
                tags[value] += 1
        else:
            if tags[value]:
                closed = ""
                while closed != value:
                    last = places.pop()
                    closed = last.key.split(".")[0]
                    keys[last.key] -= 1
                    tags[closed] -= 1
                now = places[-1] if places else None
            yield kind, "/" + value, value, now


def count_page(page: str, counts: Counter) -> None:
    """Adds (kind, key, inside): how often a tag, or a word in a container, stands inside a page's own article or main element. Pages without: nothing."""
    if not re.search(r"<(article|main)\b", page, re.I):
        return
    met: dict[Place, None] = {}
    for kind, key, value, place in walk(page):
        inside = place is not None and place.inside
        if place is not None:
            met[place] = None
        if kind == "text":
            n = len(value.split())
            if n:
                counts["word", "", inside] += n
                if place is not None:
                    place.words[inside] += n
        else:
            counts["tag", key, inside] += 1
    for place in reversed(met):  # a container is met before those within it
        for inside, n in enumerate(place.words):
            if n and place.first:
                counts["in", place.key, bool(inside)] += n
            if n and place.around is not None:
                place.around.words[inside] += n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for page in batch.column(0):
            count_page(page.as_py() or "", counts)
    keys = list(counts)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.bool_()), pa.array([counts[k] for k in keys], pa.int64())], names=["kind", "key", "inside", "n"])


class Weights:
    """The learned weights; without labelled pages, tags cost TAG_COST and the names decide on containers."""

    def __init__(self, rows: list[tuple[str, str, bool, int]] = ()):
        counts = {(k, key, inside): n for k, key, inside, n in rows}
        seen = lambda kind, key: (counts.get((kind, key, True), 0), counts.get((kind, key, False), 0))
        of = lambda kind: sorted({key for k, key, _ in counts if k == kind})
        tags = {key: seen("tag", key) for key in of("tag")}
        all_in, all_out = sum(a for a, _ in tags.values()) + 1, sum(b for _, b in tags.values()) + 1
        self.tag = {key: max(TAG_FLOOR, min(TAG_COST, math.log((a + 0.5) / all_in) - math.log((b + 0.5) / all_out))) for key, (a, b) in tags.items()}
        self.aside: dict[str, bool] = {}
        self.by_name: dict[tuple[str, bool], bool] = {}  # verdicts by name that have been asked for
        for key in of("in"):
            a, b = seen("in", key)
            if a + b >= LEAST_SEEN and key.split(".")[0] not in ("article", "main") and key not in ("div", "section"):
                self.aside[key] = a < MOST_INSIDE * (a + b)

    def unknown(self, place: Place) -> bool:
        """Whether a container has names and nothing was learned of it: on a page with an article of its own, that judges."""
        return "." in place.key and place.key not in self.aside and place.key.split(".")[0] not in ("article", "main")

    def is_aside(self, place: Place) -> bool:
        """Whether a container holds no main text: by what was learned of it, or else by its names and, of a header, by whether it is an article's own."""
        learned = self.aside.get(place.key)
        if learned is not None:
            return learned
        at = (place.key, place.around is not None and place.around.inside)
        if at not in self.by_name:
            tag, _, names = place.key.partition(".")
            self.by_name[at] = tag in ASIDE_TAGS or bool(ASIDE_NAMES & set(_NAME.findall(names))) or (tag == "header" and not at[1])
        return self.by_name[at]


def beside_article(steps: list[tuple[str, str, str, Place | None]]) -> set[Place]:
    """The containers that stand outside the page's own article or main element, hold none, and have fewer words than these have together."""
    words: Counter = Counter()
    around: set[Place] = set()
    inner = 0
    for kind, _, value, place in steps:
        if place is not None and place.inside:
            while place is not None and place not in around:
                around.add(place)
                place = place.around
            inner += len(value.split()) if kind == "text" else 0
        elif kind == "text" and (n := len(value.split())):
            while place is not None:
                words[place] += n
                place = place.around
    return {p for p, n in words.items() if n < inner and p not in around}


def main_text(page: str, weights: Weights) -> str:
    """The text of the best region: its blocks, white space made single, joined by line feeds."""
    parts: list[tuple[str, str, bool]] = []  # kind, text or tag, whether in a container without main text
    scores: list[float] = []
    asides: dict[Place | None, bool] = {None: False}
    steps = list(walk(page))
    beside = beside_article(steps) if re.search(r"<(article|main)\b", page, re.I) else ()
    for kind, key, value, place in steps:
        if place not in asides:
            asides[place] = asides[place.around] or weights.is_aside(place) or (place in beside and weights.unknown(place))
        aside = asides[place]
        if kind == "text":
            n = len(value.split())
            scores.append(ASIDE_COST * n if aside else float(n))
        else:
            scores.append(weights.tag.get(key, TAG_COST))
        parts.append((kind, value, aside))
    best = total = 0.0
    begin = first = last = 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, first, last = total, begin, i + 1
    blocks: list[str] = [""]
    for kind, value, aside in parts[first:last]:
        if kind == "text":
            if not aside:
                blocks[-1] += value
        elif value in BLOCK:
            blocks.append("")
    return "\n".join(b for b in (" ".join(entities.unescape(b).split()) for b in blocks) if b)


def _extracted(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    weights = shared.value
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            part = batch.slice(k, 200)
            texts = [main_text(p or "", weights) for p in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def learn_weights(pages: DataFrame) -> Weights:
    """Counts over all labelled pages, both sides of a key in one row. Every tag comes to the driver, and every container that has the LEAST_SEEN words
    to be judged by: the model grows with the different keys of the pages, and Python workers get it as a broadcast file."""
    counts = pages.select("html").mapInArrow(_counted, "kind string, key string, inside boolean, n long")
    sides = counts.groupBy("kind", "key").agg(*[F.coalesce(F.sum(F.when(F.col("inside") == side, F.col("n"))), F.lit(0)).alias(c) for c, side in (("a", True), ("b", False))])
    rows = sides.filter((F.col("kind") == "tag") | ((F.col("kind") == "in") & (F.col("a") + F.col("b") >= LEAST_SEEN))).toArrow()
    return Weights([(kind, key, side, n) for kind, key, a, b in zip(*(c.to_pylist() for c in rows.columns), strict=True) for side, n in ((True, a), (False, b))])


def extract_main_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page; weights are learned from the pages themselves unless given.

    A null, empty or textless page has an empty text. Rows that repeat a page_id are one page (the greatest html, then url); rows with a null page_id
    are extracted like any other. Other columns are ignored. No shuffle but for the counts.
    """
    rows = unique_rows(pages, "page_id", "html", "url").unionByName(keyless_rows(pages, "page_id", "html", "url"))
    weights = weights or learn_weights(rows)
    return rows.select("page_id", "url", "html").mapInArrow(partial(_extracted, shared=rows.sparkSession.sparkContext.broadcast(weights)), "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    """op2_html_extract: every page of the table."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
