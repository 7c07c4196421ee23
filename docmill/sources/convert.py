"""Files to Markdown by suffix, in Arrow batches: text, HTML, CSV, JSON, XML, EPUB, Word, slides, workbooks. A file that cannot be read is a row with its error.

Only the standard library is used. PDF and images need an engine: register one with `converter`; without it the row says unsupported_suffix. Office archives
are read from memory; entries are read by name alone, never extracted, so a path in an archive can lead nowhere.
"""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import partial
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docmill.plans.stored import new_place
from docmill.registry import query, table

Converter = Callable[[bytes], str]
MOST_BYTES = 512 * 1024 * 1024  # of an archive's entry: what claims more is an error, not a full executor


def decode(content: bytes) -> str:
    for bom, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(bom):
            return content.decode(name, "replace")
    return content.decode("utf-8", "replace")


def _cell(value: object) -> str:
    return re.sub(r"\s+", " ", "" if value is None else str(value)).strip().replace("|", "\\|")


def pipe_table(rows: list[list[object]]) -> str:
    """Rows as a Markdown table, the first as its head; short rows are filled up."""
    width = max((len(r) for r in rows), default=0)
    if not width:
        return ""
    full = [[_cell(c) for c in r] + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in full]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


class _Html(HTMLParser):
    SILENT = frozenset({"script", "style", "head", "noscript", "template"})
    BREAKS = frozenset({"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "ul", "ol", "blockquote", "figure", "form", "dl", "dt", "dd"})

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0
        self.links: list[tuple[str, int]] = []
        self.lists: list[list[object]] = []
        self.rows: list[list[str]] | None = None
        self.mark = 0
        self.pre = False

    def block(self) -> None:
        self.out.append("\n\n")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag in self.SILENT:
            self.silent += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in self.BREAKS:
            if tag in ("ul", "ol"):
                self.lists.append([tag, 0])
            self.block()
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] = int(str(kind[1])) + 1
            self.out.append("\n" + "  " * (len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "pre":
            self.pre = True
            self.out.append("\n\n```\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a" and a.get("href"):
            self.links.append((str(a["href"]), len(self.out)))
        elif tag == "img" and a.get("src"):
            self.out.append(f"![{a.get('alt') or ''}]({a['src']})")
        elif tag == "table":
            self.rows = []
            self.block()
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows is not None:
            self.mark = len(self.out)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif re.fullmatch("h[1-6]", tag):
            self.block()
        elif tag in self.BREAKS:
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            self.block()
        elif tag == "pre" and self.pre:
            self.pre = False
            self.out.append("\n```\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a" and self.links:
            href, at = self.links.pop()
            text = "".join(self.out[at:]).strip()
            del self.out[at:]
            self.out.append(f"[{text}]({href})" if text else "")
        elif tag in ("td", "th") and self.rows is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("".join(self.out[self.mark :]))
            del self.out[self.mark :]
        elif tag == "table" and self.rows is not None:
            self.out.append("\n\n" + pipe_table(self.rows) + "\n\n")
            self.rows = None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def html(content: bytes) -> str:
    parser = _Html()
    parser.feed(decode(content))
    parser.close()
    text = re.sub(r"[ \t]*\n[ \t]*(?=\n)", "\n", "".join(parser.out))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?m)^ (?=\S)|[ \t]+$", "", text)).strip() + "\n"


def csv_table(content: bytes) -> str:
    text = decode(content)
    csv.field_size_limit(2**31 - 1)
    return pipe_table(list(csv.reader(io.StringIO(text, newline="")))) + "\n"


def json_text(content: bytes) -> str:
    return "```json\n" + json.dumps(json.loads(decode(content)), ensure_ascii=False, indent=2) + "\n```\n"


def _xml(content: bytes) -> ET.Element:
    if re.search(rb"<!ENTITY|<!DOCTYPE[^>]*\[", content[:65536]):
        raise ValueError("entity declarations are not read")
    return ET.fromstring(content)


def _local(node: ET.Element) -> str:
    return node.tag.rsplit("}", 1)[-1] if isinstance(node.tag, str) else ""


def xml_text(content: bytes) -> str:
    """Elements as nested list items with their texts."""
    lines: list[str] = []
    stack = [(_xml(content), 0)]
    while stack:
        node, depth = stack.pop()
        text = _cell(node.text)
        lines.append("  " * depth + f"- {_local(node)}" + (f": {text}" if text else ""))
        stack.extend((child, depth + 1) for child in reversed(list(node)))
    return "\n".join(lines) + "\n"


def _entry(archive: zipfile.ZipFile, name: str) -> bytes:
    if archive.getinfo(name).file_size > MOST_BYTES:
        raise ValueError(f"{name} is over {MOST_BYTES} bytes")
    return archive.read(name)


def _attribute(node: ET.Element | None, name: str) -> str:
    return next((v for k, v in (node.attrib if node is not None else {}).items() if k.rsplit("}", 1)[-1] == name), "")


def _paragraph(node: ET.Element) -> str:
    parts = []
    for n in node.iter():
        kind = _local(n)
        parts.append(n.text or "" if kind == "t" else "\t" if kind == "tab" else "\n" if kind == "br" else "")
    return "".join(parts)


def docx(content: bytes) -> str:
    """Paragraphs, headings by style, list items and tables of a Word file, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = next(n for n in _xml(_entry(archive, "word/document.xml")) if _local(n) == "body")
    out: list[str] = []
    for node in body:
        if _local(node) == "tbl":
            rows = [[" ".join(_paragraph(p) for p in cell.iter() if _local(p) == "p") for cell in row if _local(cell) == "tc"] for row in node if _local(row) == "tr"]
            out.append(pipe_table(rows))  # type: ignore[arg-type]
        elif _local(node) == "p" and (text := _paragraph(node).strip()):
            style = _attribute(next((n for n in node.iter() if _local(n) == "pStyle"), None), "val")
            level = re.fullmatch(r"(?i)heading\s*([1-6])", style)
            item = any(_local(n) == "numPr" for n in node.iter())
            out.append("#" * int(level[1]) + " " + text if level else "# " + text if style.lower() == "title" else "- " + text if item else text)
    return "\n\n".join(out) + "\n"


def _numbered(archive: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def pptx(content: bytes) -> str:
    """Slides by number, each below its marker: titles as headings, paragraphs, tables."""
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for number, name in enumerate(_numbered(archive, r"ppt/slides/slide(\d+)\.xml"), 1):
            out.append(f"<!-- Slide number: {number} -->")
            for shape in _xml(_entry(archive, name)).iter():
                if _local(shape) == "tbl":
                    out.append(pipe_table([[" ".join(_paragraph(p) for p in c.iter() if _local(p) == "p") for c in r if _local(c) == "tc"] for r in shape if _local(r) == "tr"]))
                elif _local(shape) == "sp":
                    title = any(_local(n) == "ph" and _attribute(n, "type") in ("title", "ctrTitle") for n in shape.iter())
                    texts = [t for p in shape.iter() if _local(p) == "p" and (t := _paragraph(p).strip())]
                    out.extend(("# " if title else "") + t for t in texts)
    return "\n\n".join(out) + "\n"


def xlsx(content: bytes) -> str:
    """Sheets in the workbook's order, each a heading and a table of its cells; gaps are empty cells."""
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter() if _local(t) == "t") for item in _xml(_entry(archive, "xl/sharedStrings.xml")) if _local(item) == "si"]
        links = {_attribute(r, "Id"): _attribute(r, "Target") for r in _xml(_entry(archive, "xl/_rels/workbook.xml.rels"))}
        for sheet in (n for n in _xml(_entry(archive, "xl/workbook.xml")).iter() if _local(n) == "sheet"):
            rows: list[list[object]] = []
            target = links[_attribute(sheet, "id")]
            for row in (n for n in _xml(_entry(archive, target.lstrip("/") if target.startswith("/") else posixpath.normpath("xl/" + target))).iter() if _local(n) == "row"):
                cells: list[object] = []
                for cell in (c for c in row if _local(c) == "c"):
                    column = 0
                    for letter in re.match(r"[A-Z]*", _attribute(cell, "r"))[0]:
                        column = column * 26 + ord(letter) - 64
                    if column > 16_384:
                        raise ValueError("a column beyond the last of a sheet")
                    cells.extend([""] * (column - 1 - len(cells)))
                    kind, raw = _attribute(cell, "t"), "".join(n.text or "" for n in cell.iter() if _local(n) in ("v", "t"))
                    cells.append(shared[int(raw)] if kind == "s" and raw else raw)
                rows.append(cells)
            out.append(f"## {_attribute(sheet, 'name')}\n\n{pipe_table(rows)}".rstrip())
    return "\n\n".join(out) + "\n"


def epub(content: bytes) -> str:
    """The documents of the reading order, one after the other."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = next(_attribute(n, "full-path") for n in _xml(_entry(archive, "META-INF/container.xml")).iter() if _local(n) == "rootfile")
        book = _xml(_entry(archive, root))
        items = {_attribute(n, "id"): _attribute(n, "href") for n in book.iter() if _local(n) == "item"}
        order = [items[_attribute(n, "idref")] for n in book.iter() if _local(n) == "itemref"]
        return "\n".join(html(_entry(archive, posixpath.normpath(posixpath.join(posixpath.dirname(root), href)))) for href in order)


CONVERTERS: dict[str, Converter] = {".txt": decode, ".md": decode, ".html": html, ".htm": html, ".csv": csv_table, ".json": json_text, ".xml": xml_text, ".docx": docx, ".pptx": pptx, ".xlsx": xlsx, ".epub": epub}


def converter(suffix: str, convert: Converter) -> None:
    """Registers an engine for a suffix; a suffix that has one is an error."""
    if suffix in CONVERTERS:
        raise ValueError(f"{suffix} has a converter already")
    CONVERTERS[suffix] = convert


def _convert(batches: Iterator[pa.RecordBatch], converters: dict[str, Converter]) -> Iterator[pa.RecordBatch]:
    def batch_of(batch: pa.RecordBatch, first: int, rows: list[tuple[str | None, str | None, str | None]]) -> pa.RecordBatch:
        made = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)]
        keys = [c.slice(first, len(rows)) for c in [batch.column(0), *batch.columns[2:]]]
        return pa.RecordBatch.from_arrays([keys[0], *made, *keys[1:]], names=["path", "markdown", "error_code", "error", *batch.schema.names[2:]])

    for batch in batches:
        rows: list[tuple[str | None, str | None, str | None]] = []
        first = size = 0
        for k, (path, content) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
            suffix = posixpath.splitext(path or "")[1].lower()
            text = code = error = None
            if suffix not in converters:
                code, error = "unsupported_suffix", f"no converter for {suffix or 'a file without suffix'}"
            else:
                try:
                    text = converters[suffix](content.as_py() or b"")
                except Exception as e:  # one file must not fail the job: what is wrong with it is its row
                    code, error = "conversion_failed", f"{type(e).__name__}: {e}"
            rows.append((text, code, error))
            size += len(text or "")
            if len(rows) >= 1024 or size >= 4_000_000:
                yield batch_of(batch, first, rows)
                first, rows, size = k + 1, [], 0
        if rows:
            yield batch_of(batch, first, rows)


def to_markdown(files: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """path, markdown, error_code, error, and the keys, of (path, content, keys). Null content counts as empty, a null path as one without suffix."""
    own = files.select("path", "content", *keys)
    kinds = "".join(f", `{k}` {kind}" for k, kind in own.dtypes[2:])
    return own.mapInArrow(partial(_convert, converters=dict(CONVERTERS)), f"path string, markdown string, error_code string, error string{kinds}")


CODES = ("unsupported_suffix", "conversion_failed")


def write_observed(files: DataFrame, path: str) -> dict[str, int]:
    """Writes to_markdown(files) as Parquet and returns total, success, failed, chars and a count for each of CODES, counted in the pass that writes."""
    seen = Observation("conversion")
    good = F.col("error_code").isNull()
    counts = [F.count_if(F.col("error_code") == c).alias(c) for c in CODES]
    rows = to_markdown(files).observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(good).alias("success"), F.count_if(~good).alias("failed"), F.coalesce(F.sum(F.length("markdown")), F.lit(0)).alias("chars"), *counts)
    rows.write.parquet(path)
    return seen.get


@query("batch_rollup", """WITH f AS (SELECT c_custkey AS k, c_name AS name FROM customer), r AS (SELECT CASE WHEN k % 7 = 0 THEN 'unsupported_suffix' WHEN k % 5 = 0 THEN 'conversion_failed' END AS code, length(name) AS n FROM f)
SELECT count(*) AS total, count(*) FILTER (WHERE code IS NULL) AS success, count(code) AS failed, CAST(sum(n) FILTER (WHERE code IS NULL) AS BIGINT) AS chars, count(*) FILTER (WHERE code = 'unsupported_suffix') AS unsupported_suffix, count(*) FILTER (WHERE code = 'conversion_failed') AS conversion_failed FROM r""")
def batch_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as files, some of no known kind, some broken: the roll-up of the pass that converts and writes them."""
    k = F.col("c_custkey")
    suffix = F.when(k % 7 == 0, ".exe").when(k % 5 == 0, ".xlsx").otherwise(".txt")
    files = table(spark, sf, "customer").select(F.concat(k.cast("string"), suffix).alias("path"), F.encode("c_name", "utf-8").alias("content"))
    seen = write_observed(files, new_place(spark, "converted"))
    names = ("total", "success", "failed", "chars", *CODES)
    return spark.createDataFrame([tuple(seen[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query("html_to_markdown", """SELECT page_id, true AS converted, 'Page ' || page_id AS title, 'x & y é' AS item, CAST(length(url) AS BIGINT) AS link_chars FROM pages""")
def html_to_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Every page becomes Markdown without an error, and what was put before its text is found in it: a heading, an item of a list, a link."""
    head = F.concat(F.lit("<h1>Page "), F.col("page_id").cast("string"), F.lit("</h1><script>no()</script><ul><li>x &amp; y &eacute;</li></ul><p><a href='"), F.col("url"), F.lit("'>there</a></p>"))
    content = F.concat(F.lit("<html><body>"), head, F.regexp_replace("html", r"(?is)</?(html|body)\b[^>]*>|<!doctype[^>]*>", ""), F.lit("</body></html>"))
    pages = table(spark, sf, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode(content, "utf-8").alias("content"))
    found = lambda pattern: F.regexp_extract("markdown", pattern, 1)
    return to_markdown(pages).select(
        F.substring_index("path", ".", 1).cast("long").alias("page_id"),
        (F.col("markdown").isNotNull() & F.col("error_code").isNull() & ~F.col("markdown").contains("no()")).alias("converted"),
        found(r"(?m)^# (.*)$").alias("title"),
        found(r"(?m)^- (.*)$").alias("item"),
        F.length(found(r"\[there\]\(([^)]*)\)")).cast("long").alias("link_chars"),
    )


@query("csv_to_markdown", "SELECT n_nationkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_nationkey || ' | ' || n_name || ' |' || chr(10) AS markdown FROM nation")
def csv_to_markdown(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey").cast("string")
    files = table(spark, sf, "nation").select(F.concat(key, F.lit(".CSV")).alias("path"), F.encode(F.concat(F.lit('key,"name"\r\n'), key, F.lit(","), F.col("n_name")), "utf-8").alias("content"))
    return to_markdown(files).select(F.substring_index("path", ".", 1).cast("int").alias("n_nationkey"), "markdown")
