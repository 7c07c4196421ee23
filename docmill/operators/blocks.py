"""Markdown as blocks: structural parse with heading context, oversized splits, cleaning, asset links. State machines over lines, in Arrow batches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.plans.stored import spread
from docmill.registry import query, table

FRAGMENT = 800  # tokens of a stable fragment

# Forms of the lines that the parse tells apart, and where a sentence ends.
_FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})(.*)$")
_OPEN = re.compile(r"\s*(`{3,}|~{3,})")
_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
_ASSET = re.compile(r"\]\((?:\./)?assets/[^)]+\)", re.IGNORECASE)
_CJK = regex.compile(r"[㐀-鿿豈-﫿]")
_WORD = regex.compile(r"[\p{L}\p{N}_][\p{L}\p{N}_'-]*")
_MARK = regex.compile(r"[^\p{L}\p{N}_\s\x1c-\x1f]")
_SENTENCE = re.compile(r"[^。！？.!?]*[。！？.!?]|[^。！？.!?]+")
_OPENS = ("```", "~~~")

# ASCII as the estimate sees it: what no word holds as spaces, and what is no punctuation.
_NO_WORD = bytes(c if chr(c).isalnum() or chr(c) in "_'-" else 32 for c in range(128)) + bytes(128)
_NO_MARK = bytes(c for c in range(128) if chr(c).isalnum() or chr(c) == "_" or chr(c).isspace())


def tokens(text: str) -> int:
    """The estimate of functions.text.token_estimate, for one string."""
    if text.isascii():
        b = text.encode()
        runs = b.translate(_NO_WORD).split()
        words = sum(1 for r in runs if r.strip(b"'-")) if b"'" in b or b"-" in b else len(runs)
        return max(1, words - (-len(b.translate(None, _NO_MARK)) // 4))
    bare = _CJK.sub("", text)
    words, marks = len(_WORD.findall(bare)), len(_MARK.findall(bare))
    return max(1, len(text) - len(bare) + words - (-marks // 4))


def pieces_of(paragraph: str) -> list[str]:
    """The sentences of a paragraph."""
    return [x for piece in _SENTENCE.findall(paragraph.strip()) if (x := piece.lstrip())]


def sentence_blocks(text: str) -> list[str]:
    """Sentences of paragraphs; fences, formulas and headings whole. A blank line, a heading or a formula ends a paragraph; what a fence follows directly is one with it."""
    out: list[str] = []
    held: list[str] = []
    fenced = formula = False

    def close(whole: bool = True) -> None:
        joined = "\n".join(held).strip()
        out.extend([joined] if whole else pieces_of(joined))
        held.clear()

    for line in text.splitlines():
        bare = line.strip()
        is_fence, is_formula = bare.startswith(_OPENS), bare == "$$" and not fenced
        if is_formula and not formula:
            close()
        if is_fence or fenced or is_formula or formula:
            held.append(line)
            ends = (is_fence and fenced) or (is_formula and formula)
            fenced, formula = fenced != is_fence, formula != (is_formula and not is_fence)
            if ends:
                close()
        elif (bare.startswith("$$") and bare.endswith("$$")) or (line.startswith("#") and _HEADING.match(line)):
            close()
            out.append(bare)
        elif bare:
            held.append(line)
        else:
            close(whole=False)
    close(whole=False)
    return [x for x in out if x]


def _has_asset(line: str) -> bool:
    return "](" in line and bool(_ASSET.search(line))


def _run(lines: list[str], start: int) -> int:
    """The line behind the fence, table, asset line or formula that starts here; start itself if none does."""
    bare = lines[start].lstrip()
    end = start + 1
    if bare.startswith(_OPENS):
        mark = _OPEN.match(lines[start])
        closing = re.compile(rf"\s*{re.escape(mark[1][0])}{{{len(mark[1])},}}\s*$")
        while end < len(lines) and not closing.match(lines[end]):
            end += 1
        return min(end + 1, len(lines))
    if bare.startswith("|"):
        while end < len(lines) and lines[end].lstrip().startswith("|"):
            end += 1
        return end
    if _has_asset(lines[start]):
        return end
    if bare == "$$":
        while end < len(lines) and lines[end].strip() != "$$":
            end += 1
        return min(end + 1, len(lines))
    return end if bare.startswith("$$") and bare.endswith("$$") else start


def parse(text: str) -> Iterator[tuple[str, int, int, bool, list[str]]]:
    """(content, first line, last line, atomic, heading context) of each block; lines count from 1, and a heading is the last of its own context."""
    lines = text.splitlines()
    context: list[str] = []

    def block(content: str, first: int, atomic: bool) -> tuple[str, int, int, bool, list[str]]:
        if heading := content.startswith("#") and _HEADING.match(content):
            del context[len(heading[1]) - 1 :]
            context.append(heading[2].strip())
        return content, first, first + content.count("\n"), atomic, list(context)

    def prose(first: int, last: int) -> Iterator[tuple[str, int, int, bool, list[str]]]:
        segment, at = "\n".join(lines[first:last]), 0
        for piece in sentence_blocks(segment) if segment else ():
            found = segment.find(piece, at)
            found = at if found < 0 else found
            yield block(piece, first + 1 + segment.count("\n", 0, found), False)
            at = found + len(piece)

    i = begin = 0
    while i < len(lines):
        end = _run(lines, i)
        heading = end == i and lines[i].startswith("#") and _HEADING.match(lines[i])
        if end == i and not heading and lines[i].strip():
            i += 1
            continue
        yield from prose(begin, i)
        if end > i:
            content = lines[i].strip() if _has_asset(lines[i]) and not lines[i].lstrip().startswith((*_OPENS, "|")) else "\n".join(lines[i:end])
            yield block(content, i + 1, True)
        elif heading:
            yield block(lines[i].strip(), i + 1, False)
        i = begin = max(end, i + 1)
    yield from prose(begin, len(lines))


#: Separators in the order in which a cut prefers them.
SEPARATORS = "。！？.;，, "


def split_oversized(text: str, limit: int) -> list[str]:
    """Pieces of at most limit tokens, each cut behind the most preferred separator in the second half of the longest prefix that fits. A text that fits, or
    that begins as a fence, table or formula, stays whole."""
    if len(text) <= limit or tokens(text) <= limit or text.startswith(("```", "~~~", "|", "$$")):
        return [text]
    pieces, rest = [], text
    while rest:
        low, high = 1, len(rest)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if tokens(rest[:middle]) <= limit else (low, middle - 1)
        at = next((k + 1 for s in SEPARATORS if (k := rest.rfind(s, 0, low + 1)) >= max(1, low // 2)), low)
        pieces.append(rest[:at].strip())
        rest = rest[at:].strip()
    return [p for p in pieces if p]


_PAGE = re.compile(r"<!--\s*(?:slide number|page)\s*:\s*\d+\s*-->", re.IGNORECASE)
_INLINE = re.compile(r"\\\((.*?)\\\)")
_NO_HEADER = ("#", "<!--", "|", "```", "~~~")
_DIGITS = re.compile(r"\d+")


def line_form(line: str) -> str:
    """A line without what changes from page to page: white space single, numbers alike."""
    return _DIGITS.sub("<num>", " ".join(line.split()))


def without_running_lines(text: str) -> str:
    """The text without lines that stand, numbers aside, on at least three pages and six tenths of all; a page begins at its marker. Headings, comments, tables,
    fences, rules and lines of over 160 characters are no running lines by themselves. A text of fewer than three pages stays as it is."""
    if text.count("<!--") < 3:
        return text
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    starts = [k for k, line in enumerate(lines) if "<!--" in line and _PAGE.fullmatch(line.strip())]
    if len(starts) < 3:
        return text
    forms = [line_form(line) for line in lines]
    pages = Counter()
    for first, end in zip(starts, [*starts[1:], len(lines)], strict=True):
        bare = ((line.strip(), form) for line, form in zip(lines[first:end], forms[first:end], strict=True))
        pages.update({form for x, form in bare if x and x != "---" and len(x) <= 160 and not x.startswith(_NO_HEADER)})
    running = {form for form, n in pages.items() if n >= 3 and 10 * n >= 6 * len(starts)}
    return "\n".join(line for line, form in zip(lines, forms, strict=True) if form not in running) if running else text


def clean(text: str) -> str:
    """Line ends made equal, blank lines single outside fences, heading levels clamped, LaTeX brackets as dollars, an open fence closed, one line end."""
    out: list[str] = []
    fence, level = "", 0
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        mark = ("```" in line or "~~~" in line) and _FENCE.match(line)
        if fence:
            out.append(line)
            if mark and mark[1][0] == fence[0] and not mark[2].strip():
                fence = ""
            continue
        if mark:
            fence = mark[1]
            out.append(line)
            continue
        if not line.strip():
            if out and out[-1]:
                out.append("")
            continue
        if heading := line.startswith("#") and _HEADING.match(line):
            level = min(len(heading[1]), level + 1)
            line = "#" * level + " " + heading[2]
        out.append(_INLINE.sub(r"$\1$", line).replace("\\[", "$$").replace("\\]", "$$") if "\\" in line else line)
    if fence:
        out.append(fence)
    return "\n".join(out).strip("\n") + "\n" if any(out) else ""


def rebase_assets(text: str, base: str) -> str:
    """Links to assets/ put below base, but not within fences or inline code."""
    out, fence = [], ""
    for line in text.split("\n"):
        mark = _FENCE.match(line)
        if mark and (not fence or (mark[1][0] == fence[0] and not mark[2].strip())):
            fence = "" if fence else mark[1]
        elif not fence:
            parts = re.split(r"(`[^`]*`)", line)
            line = "".join(p if k % 2 else re.sub(r"\]\(assets/", f"]({base}/assets/", p) for k, p in enumerate(parts))
        out.append(line)
    return "\n".join(out)


BLOCK = "block_no int, content string, start_line int, end_line int, atomic boolean, heading_context array<string>, tokens long"


FLUSH_ROWS, FLUSH_CHARS = 4096, 4_000_000  # of an outgoing batch
TEXT_ROWS = 256  # documents of an outgoing batch of lists


def _parsed(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in BLOCK.split(", ")]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.int64()]

    def batch_of(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        of, *columns = zip(*rows, strict=True)
        keys = [c.take(pa.array(of, pa.int64())) for c in batch.columns[:-1]]
        return pa.RecordBatch.from_arrays(keys + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*batch.schema.names[:-1], *names])

    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for k, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            number = 0
            for content, first, last, atomic, above in parse(text or ""):
                for piece in [content] if atomic else split_oversized(content, limit):
                    number += 1
                    rows.append((k, number, piece, first, last, atomic, above, tokens(piece)))
                    size += len(piece)
            if len(rows) >= FLUSH_ROWS or size >= FLUSH_CHARS:
                yield batch_of(batch, rows)
                rows, size = [], 0
        if rows:
            yield batch_of(batch, rows)


def structural_blocks(docs: DataFrame, limit: int = FRAGMENT, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Blocks of (keys, markdown), each with the keys of its document: a null or empty text has none; each row by itself."""
    own = docs.select(*keys, "markdown")
    schema = ", ".join(f"`{k}` {kind}" for k, kind in own.dtypes[:-1])
    return own.mapInArrow(partial(_parsed, limit=limit), f"{schema}, {BLOCK}")


def _texts(batches: Iterator[pa.RecordBatch], count: int, limit: int) -> Iterator[pa.RecordBatch]:
    def lists(column: pa.Array) -> pa.Array:
        pieces = lambda text: [piece for content, _, _, atomic, _ in parse(text or "") for piece in ([content] if atomic else split_oversized(content, limit))]
        return pa.array((pieces(text) for text in column.to_pylist()), pa.list_(pa.string()))

    for batch in batches:
        keys = batch.num_columns - count
        for at in range(0, batch.num_rows, TEXT_ROWS):
            some = batch.slice(at, TEXT_ROWS)
            yield pa.RecordBatch.from_arrays(some.columns[:keys] + [lists(c) for c in some.columns[keys:]], names=batch.schema.names)


def block_texts(docs: DataFrame, *columns: str, limit: int = FRAGMENT) -> DataFrame:
    """docs with each of these columns, a Markdown, as the list of its blocks' texts in their order: a row stays a row, so what is done with the blocks of one
    document needs no exchange."""
    rest = [c for c in docs.columns if c not in columns]
    schema = ", ".join([*(f"`{k}` {kind}" for k, kind in docs.select(*rest).dtypes), *(f"`{c}` array<string>" for c in columns)])
    return docs.select(*rest, *columns).mapInArrow(partial(_texts, count=len(columns), limit=limit), schema)


def order_documents(spark: SparkSession, sf: str, over_all: bool = False) -> DataFrame:
    """Orders as Markdown: heading, sentences, asset line, table of line items, fenced note, formula, and a line that only begins like one; over all cores, if so asked."""
    row = F.format_string("| %d | %d |", F.col("l_linenumber"), F.col("l_partkey"))
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    items = (spread(items, "l_orderkey") if over_all else items).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("row")))).alias("items"))
    body = F.array_join(F.transform("items", lambda x: x.row), "\n")
    key = F.col("l_orderkey").cast("string")
    head = F.concat(F.lit("# Order "), key, F.lit("\n\nIt has lines. They\nfollow!\nSee ![x](./Assets/p.png) here.\n\n## Lines\n\n"))
    tail = F.concat(F.lit("\n\n````\nnote. of code\n```\n  `````\n$$\nk = "), key, F.lit("\n$$\n$$ a. b $$ c\n### Last\nend"))
    return items.select(F.col("l_orderkey").alias("doc_id"), F.concat(head, body, tail).alias("markdown"))


BLOCKS_SQL = """WITH o AS (SELECT l_orderkey AS doc_id, count(*) AS n, string_agg('| ' || l_linenumber || ' | ' || l_partkey || ' |', chr(10) ORDER BY l_linenumber, '| ' || l_linenumber || ' | ' || l_partkey || ' |') AS items FROM lineitem GROUP BY l_orderkey),
b AS (SELECT doc_id, unnest([
 {'i': 1, 'content': '# Order ' || doc_id, 'a': 1, 'z': 1, 'atomic': false, 'level': 1}, {'i': 2, 'content': 'It has lines.', 'a': 3, 'z': 3, 'atomic': false, 'level': 1},
 {'i': 3, 'content': 'They' || chr(10) || 'follow!', 'a': 3, 'z': 4, 'atomic': false, 'level': 1}, {'i': 4, 'content': 'See ![x](./Assets/p.png) here.', 'a': 5, 'z': 5, 'atomic': true, 'level': 1},
 {'i': 5, 'content': '## Lines', 'a': 7, 'z': 7, 'atomic': false, 'level': 2}, {'i': 6, 'content': items, 'a': 9, 'z': 8 + n, 'atomic': true, 'level': 2},
 {'i': 7, 'content': concat_ws(chr(10), '````', 'note. of code', '```', '  `````'), 'a': 10 + n, 'z': 13 + n, 'atomic': true, 'level': 2},
 {'i': 8, 'content': concat_ws(chr(10), '$$', 'k = ' || doc_id, '$$'), 'a': 14 + n, 'z': 16 + n, 'atomic': true, 'level': 2},
 {'i': 9, 'content': '$$ a.', 'a': 17 + n, 'z': 17 + n, 'atomic': false, 'level': 2}, {'i': 10, 'content': 'b $$ c', 'a': 17 + n, 'z': 17 + n, 'atomic': false, 'level': 2},
 {'i': 11, 'content': '### Last', 'a': 18 + n, 'z': 18 + n, 'atomic': false, 'level': 3}, {'i': 12, 'content': 'end', 'a': 19 + n, 'z': 19 + n, 'atomic': false, 'level': 3}]) AS b FROM o)"""


@query("structural_blocks", BLOCKS_SQL + """
SELECT doc_id, sha256(b.content) AS content_sha256, CAST(b.a AS INT) AS start_line, CAST(b.z AS INT) AS end_line, b.atomic AS atomic, 'Order ' || doc_id || CASE b.level WHEN 1 THEN '' WHEN 2 THEN '/Lines' ELSE '/Lines/Last' END AS context FROM b""")
def blocks_of_orders(spark: SparkSession, sf: str) -> DataFrame:
    b = structural_blocks(order_documents(spark, sf))
    return b.select("doc_id", F.sha2("content", 256).alias("content_sha256"), "start_line", "end_line", "atomic", F.array_join("heading_context", "/").alias("context"))


@query("source_map_verify", """SELECT d.doc_id, l.doc_id IS NOT NULL AS listed, sha256(coalesce(text, '')) = sha256(CASE WHEN d.doc_id % 17 = 0 THEN 'changed' ELSE coalesce(text, '') END) AND l.doc_id IS NOT NULL AS verified
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def source_map_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks joined with their manifest entries: listed, and verified where the digest is the one that the manifest holds."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digest = F.sha2(F.when(F.col("doc_id") % 17 == 0, "changed").otherwise(F.col("text")), 256)
    manifest = docs.select("doc_id", digest.alias("sha")).join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    own = docs.select("doc_id", F.sha2("text", 256).alias("own"))
    return own.join(manifest, "doc_id", "left").select("doc_id", F.col("sha").isNotNull().alias("listed"), F.coalesce(F.col("sha") == F.col("own"), F.lit(False)).alias("verified"))


@query("ocr_flags", """WITH o AS (SELECT conv_id, turn, ((turn * 37 + conv_id) % 100) / 100.0::DOUBLE AS confidence FROM conversations WHERE trim(text) <> '')
SELECT conv_id, count(*) AS n_pages, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (WHERE confidence < 0.7) AS low_in_manifest, count(*) FILTER (WHERE confidence < 0.75) AS low_in_preview FROM o GROUP BY conv_id""")
def ocr_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Mean confidence of recognised pages, and how many are low by either threshold."""
    pages = table(spark, sf, "conversations").filter(F.trim("text") != "").select("conv_id", ((F.col("turn") * 37 + F.col("conv_id")) % 100 / 100.0).alias("c"))
    return pages.groupBy("conv_id").agg(F.count("*").alias("n_pages"), F.round(F.avg("c"), 6).alias("mean_confidence"), F.count_if(F.col("c") < 0.7).alias("low_in_manifest"), F.count_if(F.col("c") < 0.75).alias("low_in_preview"))
