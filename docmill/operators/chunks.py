"""Chunks of a document: blocks grouped up to a target, a heading always first; titles and source labels. One row in, its chunks out, no shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.text import TOKEN_SQL
from docmill.operators.blocks import FLUSH_CHARS, FLUSH_ROWS, sentence_blocks, split_oversized, tokens
from docmill.registry import query, table

TARGET, MOST = 4000, 6000


def check_limits(target: int, most: int) -> None:
    if target < 20 or most < target:
        raise ValueError("a target is at least 20 tokens, the most no less than the target")


CHUNK = "doc_id long, chunk long, title string, content string, estimated_tokens long, labels array<string>"
_HEAD = re.compile(r"^(#{1,6})\s+(\S.*?)\s*$", re.DOTALL)  # a heading is a block of one line


def grouped(blocks: list[tuple[str, str]], target: int, most: int) -> list[tuple[str, str, int, list[str]]]:
    """(title, content, tokens, labels) of the chunks of (content, label): a chunk ends before a heading, before what would pass most, and before what would
    pass target unless a heading would be left at its end. The first level-1 heading heads every chunk."""
    root = next((k for k, (text, _) in enumerate(blocks) if re.match(r"#\s+", text)), None)
    lead = [] if root is None else [blocks[root][0]]
    rest = [x for k, x in enumerate(blocks) if k != root]
    prefix = tokens(lead[0]) if lead else 0
    groups: list[list[tuple[str, str]]] = []
    mine: list[tuple[str, str]] = []
    used, after_heading = prefix, False
    for text, label in rest:
        cost, heading = tokens(text), bool(re.match(r"#{1,6}\s+\S", text))
        if mine and (heading or used + cost > most or (used + cost > target and not after_heading)):
            groups.append(mine)
            mine, used = [], prefix
        mine.append((text, label))
        used, after_heading = used + cost, heading
    if mine or not groups:
        groups.append(mine)
    out = []
    for k, group in enumerate(groups, start=1):
        head = next((m for text, _ in group if (m := _HEAD.match(text))), None)
        content = "\n\n".join(lead + [text for text, _ in group]).strip() + "\n"
        out.append((head[2] if head else f"Part {k}", content, tokens(content), list(dict.fromkeys(label for _, label in group if label))))
    return out


def split_blocks(text: str, spans: list[dict], most: int) -> list[tuple[str, str]]:
    """(content, label) of the sentence blocks of a text, cut to what a chunk may hold beside the first level-1 heading.

    A block's label is that of the first span with the line in which the block is found, from where the one before it ended, else from the start.
    """
    whole = sentence_blocks(text)
    root = next((k for k, x in enumerate(whole) if re.match(r"#\s+", x)), None)
    limit = most if root is None else max(1, most - tokens(whole[root]))
    out, at, line, seen = [], 0, 1, 0
    for k, block in enumerate(whole):
        for piece in [block] if k == root else split_oversized(block, limit):
            if k == root:
                out.append((piece, ""))
                continue
            found = text.find(piece, at)
            found = text.find(piece) if found < 0 else found
            label = ""
            if found >= 0:
                at = found + len(piece)
                line = line + text.count("\n", seen, found) if found >= seen else 1 + text.count("\n", 0, found)
                seen = found
                label = next((s["label"] for s in spans if s["start_line"] <= line <= s["end_line"]), "")
            out.append((piece, label))
    return out


def _chunked(batches: Iterator[pa.RecordBatch], target: int, most: int, whole: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())]
    names = [f.split()[0] for f in CHUNK.split(", ")]
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for doc, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            blocks = split_blocks(rest[0] or "", rest[1] or [], most) if whole else [(b["content"] or "", b["label"] or "") for b in rest[0] or []]
            made = grouped(blocks, target, most)
            rows += [(doc, k, *chunk) for k, chunk in enumerate(made, start=1)]
            size += sum(len(chunk[1]) for chunk in made)
            if len(rows) >= FLUSH_ROWS or size >= FLUSH_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def chunk_rows(docs: DataFrame, target: int = TARGET, most: int = MOST) -> DataFrame:
    """doc_id, chunk, title, content, estimated_tokens, labels of (doc_id, blocks: array of (content, label)).

    A chunk's title is its first heading, else "Part n"; its labels are those of its blocks, each once, in order. A document without blocks is one empty
    chunk. Time and memory grow with a document's length.
    """
    check_limits(target, most)
    return docs.select("doc_id", "blocks").mapInArrow(partial(_chunked, target=target, most=most, whole=False), CHUNK)


def split_documents(docs: DataFrame, target: int = TARGET, most: int = MOST) -> DataFrame:
    """The chunks of (doc_id, markdown, spans): sentence blocks, oversized ones cut, labelled by their places."""
    check_limits(target, most)
    return docs.select("doc_id", "markdown", "spans").mapInArrow(partial(_chunked, target=target, most=most, whole=True), CHUNK)


def conversation_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as blocks: a title, and before every third turn a heading."""
    text = F.coalesce("text", F.lit(""))
    turn = F.struct(text.alias("content"), F.concat(F.lit("Page "), (F.col("turn") + 1).cast("string")).alias("label"))
    heading = F.struct(F.concat(F.lit("## "), F.col("role")).alias("content"), F.lit("").alias("label"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.array(heading, turn)).otherwise(F.array(turn)).alias("b"))
    b = rows.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "b"))), lambda x: x.b)).alias("b"))
    title = F.struct(F.concat(F.lit("# Talk "), F.col("conv_id").cast("string")).alias("content"), F.lit("").alias("label"))
    return b.select(F.col("conv_id").alias("doc_id"), F.concat(F.array(title), F.col("b")).alias("blocks"))


def _tokens(expression: str) -> str:
    return TOKEN_SQL.replace("coalesce(text, '')", expression)


_SQL = f"""
WITH RECURSIVE raw AS (SELECT conv_id AS doc_id, turn * 2 + 1 AS o, coalesce(text, '') AS content, 'Page ' || (turn + 1) AS label, false AS heading FROM conversations
 UNION ALL SELECT conv_id, turn * 2, '## ' || role, '', true FROM conversations WHERE turn % 3 = 0),
b AS MATERIALIZED (SELECT *, '# Talk ' || doc_id AS root, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS i, {_tokens('content')} AS tokens FROM raw),
r AS MATERIALIZED (SELECT *, {_tokens('root')} AS prefix FROM b),
p AS (SELECT doc_id, i, prefix + tokens AS used, CAST(1 AS BIGINT) AS chunk, heading AS last_heading FROM r WHERE i = 1
 UNION ALL SELECT doc_id, i, CASE WHEN flush THEN prefix + tokens ELSE used + tokens END, chunk + flush::INT, heading
 FROM (SELECT r.*, p.used, p.chunk, r.heading OR p.used + r.tokens > 300 OR (p.used + r.tokens > 120 AND NOT p.last_heading) AS flush FROM p JOIN r ON r.doc_id = p.doc_id AND r.i = p.i + 1)),
k AS (SELECT p.doc_id, p.chunk, coalesce(min_by(content, p.i) FILTER (WHERE heading), '') AS first_heading, string_agg(label, ',' ORDER BY p.i) FILTER (WHERE label <> '') AS labels,
 any_value(root) || chr(10) || chr(10) || string_agg(content, chr(10) || chr(10) ORDER BY p.i) AS joined FROM p JOIN r USING (doc_id, i) GROUP BY p.doc_id, p.chunk),
t AS (SELECT *, trim(joined) || chr(10) AS page FROM k)
SELECT doc_id, chunk, CASE WHEN first_heading = '' THEN 'Part ' || chunk ELSE substr(first_heading, 4) END AS title, sha256(page) AS sha256, {_tokens('page')} AS estimated_tokens, coalesce(labels, '') AS labels FROM t"""


@query("chunk_assignment", _SQL)
def chunk_assignment(spark: SparkSession, sf: str) -> DataFrame:
    c = chunk_rows(conversation_blocks(spark, sf), 120, 300)
    return c.select("doc_id", "chunk", "title", F.sha2("content", 256).alias("sha256"), "estimated_tokens", F.array_join("labels", ",").alias("labels"))

