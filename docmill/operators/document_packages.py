"""Document packages as files: raw and cleaned Markdown, chunks, assets, notes and manifest of each document; and prepared packages read as sources."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from docmill.functions.provenance import APPENDIX, SPAN, with_spans
from docmill.functions.text import safe_component, token_estimate
from docmill.operators import rules
from docmill.operators.blocks import clean, without_running_lines
from docmill.operators.chunks import MOST, TARGET, split_documents
from docmill.operators.naming import close_collisions
from docmill.operators.pack_files import record, whole
from docmill.plans.stored import new_place, spread, stored
from docmill.registry import query, table
from docmill.sources.part_files import byte_parts, parts, whole_files, write_listed

# Names and texts that other programs and readers know.
PACKAGE, VERSION, LOW = "ai_document_package", 2, 0.7
NOTES = "# AI 资料包\n\n来源：`%s`\n\n## 从这里开始\n\n%s\n- `raw.md` 是未经清洗的 MarkItDown 原始结果，可用于核对。\n- `manifest.json` 提供机器可读的文件清单与长度信息。"
READ_CHUNKS, READ_CONTENT = "- 优先按顺序读取 `chunks/` 中的分段。", "- 读取 `content.md`。"
PAGES = "array<struct<label:string,text:string,confidence:double>>"


@F.pandas_udf(StringType())
def without_running(markdown: pd.Series) -> pd.Series:
    """blocks.without_running_lines of each text."""
    return markdown.map(lambda x: without_running_lines(x or ""))


@F.pandas_udf(StringType())
def cleaned(markdown: pd.Series) -> pd.Series:
    """blocks.clean of each text."""
    return markdown.map(lambda x: clean(x or ""))


def image_assets(docs: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, target, asset of the images of (doc_id, content) whose target is among files (doc_id, path): the name below assets/ that each different target
    gets, in the order in which the document names them; names that meet, letter case aside, are numbered."""
    refs = rules.image_references(docs.select("doc_id", F.col("content").alias("markdown"))).groupBy("doc_id", "target").agg(F.min(F.struct("line", "at")).alias("first"))
    held = refs.join(files.select("doc_id", F.col("path").alias("target")).distinct(), ["doc_id", "target"], "left_semi")
    held = held.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).cast("long"))
    names = held.select(F.col("doc_id").alias("batch"), "idx", safe_component(F.element_at(F.split("target", "/"), -1), "image").alias("name"))
    planned = close_collisions(names).select(F.col("batch").alias("doc_id"), "idx", "planned_name")
    return held.join(planned, ["doc_id", "idx"]).select("doc_id", "target", F.concat(F.lit("assets/"), F.col("planned_name")).alias("asset"))


def with_asset_links(docs: DataFrame, images: DataFrame) -> DataFrame:
    """docs whose images in content name their assets (image_assets), others with slashes for backslashes, and with these assets added to their own."""
    held = images.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("target", "asset"))).alias("_held"))  # as many as a document has images
    pattern = lambda k: F.regexp_extract_all("content", F.lit(rules.IMAGE), F.lit(k))
    named = F.when(F.col("_held").isNotNull(), F.transform(pattern(2), lambda raw: F.try_element_at("_held", rules.image_target(raw))))
    links = F.transform(pattern(2), lambda raw, i: F.concat(F.lit("!["), F.get(pattern(1), i), F.lit("]("), F.coalesce(F.get("_named", i), F.replace(raw, F.lit("\\"), F.lit("/"))), F.lit(")")))
    between = F.split("content", rules.IMAGE)
    text = F.array_join(F.zip_with(between, F.col("_links"), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    d = docs.join(held, "doc_id", "left").withColumn("_named", named).withColumn("_links", links)
    return d.withColumn("content", text).withColumn("assets", F.array_distinct(F.concat("assets", F.coalesce(F.map_values("_held"), F.array().cast("array<string>"))))).drop("_held", "_named", "_links")


def cleaned_documents(docs: DataFrame) -> DataFrame:
    """docs (doc_id, name, markdown and any of suffix, sha256, assets, tools, pages) with every column, raw and content: the Markdown without the lines that
    repeat on pages, with the rule of its suffix, cleaned. Documents are spread over all cores first."""
    have = set(docs.columns)
    rest = {
        "suffix": F.lower(F.regexp_extract("name", r"(\.[^./\\]+)$", 1)),
        "sha256": F.lit(None).cast("string"),
        "assets": F.array().cast("array<string>"),
        "tools": F.create_map().cast("map<string,string>"),
        "pages": F.array().cast(PAGES),
    }
    d = docs.select("doc_id", "name", F.coalesce("markdown", F.lit("")).alias("raw"), *[F.coalesce(name, c).alias(name) if name in have else c.alias(name) for name, c in rest.items()])
    return rules.by_suffix(spread(d, "doc_id").withColumn("markdown", without_running("raw"))).withColumn("content", cleaned("markdown")).drop("markdown")


def packaged(cleaned_docs: DataFrame) -> DataFrame:
    """cleaned_documents with recognised pages behind their content, and spans."""
    pages = F.transform("pages", lambda p: rules.recognised_section(p["label"], p["text"], p["confidence"]))
    extra = F.concat(F.regexp_replace("content", r"\s+\z", ""), F.lit(f"\n\n{APPENDIX}\n\n"), F.array_join(pages, "\n\n"), F.lit("\n"))
    return with_spans(cleaned_docs.withColumn("content", F.when(F.size("pages") > 0, extra).otherwise(F.col("content"))), "content")


def chunk_file() -> Column:
    number = F.col("chunk").cast("string")
    return F.concat(F.lit("chunks/"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0")), F.lit("-"), safe_component(F.col("title"), "chunk-"), F.when(F.regexp_replace("title", r"[\s<>:\"/\\|?*\x00-\x1f._-]", "") == "", number).otherwise(""), F.lit(".md"))


def package_files(docs: DataFrame, created_at: str, split: bool = True, target: int = TARGET, most: int = MOST, files: DataFrame | None = None) -> DataFrame:
    """Every file of the packages of docs (see packaged), as parts keyed by doc_id. Chunks are files only where there are two or more.

    files (doc_id, path as images name it, content or uri) are what documents may refer to: those that they do are copied to assets/, each once. Warnings are
    the issues of the cleaned text, and the heading jumps of the raw one that cleaning mended. Documents are cleaned once, into
    a stored table that all parts of the plan read.
    """
    d, images = cleaned_documents(docs), None
    if files is not None:
        d = stored(d, "cleaned")
        images = stored(image_assets(d, files), "images")
        d = with_asset_links(d, images)
    d = whole_package = stored(packaged(d), "packaged")
    none = d.select("doc_id", F.lit(0).alias("n"), F.array().cast("array<string>").alias("listed")).limit(0)
    chunks = listed = None
    if split:
        chunks = stored(split_documents(d.select("doc_id", F.col("content").alias("markdown"), "spans"), target, most), "chunks")
        entry = record(F.col("chunk").alias("index"), F.col("title"), F.col("estimated_tokens"), chunk_file().alias("file"), F.col("labels").alias("sources"))
        listed = chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("chunk", entry.alias("entry")))).alias("c"))
        listed = listed.filter("n > 1").select("doc_id", "n", F.transform("c", lambda x: x["entry"]).alias("listed"))
        several = chunks.join(listed.select("doc_id"), "doc_id", "left_semi")
    d = d.join(none if listed is None else listed, "doc_id", "left")
    found = issues_of(whole_package, most)
    w = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rule_no", F.coalesce("line", F.lit(0)).alias("at"), record(F.col("code"), F.col("severity"), rules.message(F.col("code"), F.col("label"), F.col("tokens"), most).alias("message"), F.col("line"), F.col("label").alias("source_label")).alias("entry")))).alias("w"))
    d = d.join(w.select("doc_id", F.transform("w", lambda x: x["entry"]).alias("warnings")), "doc_id", "left")
    objects = lambda name: F.concat(F.lit("["), F.array_join(F.coalesce(F.col(name), F.array().cast("array<string>")), ", "), F.lit("]"))
    page = lambda p: F.struct(p["label"].alias("label"), p["confidence"].alias("confidence"), (p["confidence"] < LOW).alias("low_confidence"))
    tools = F.map_from_entries(F.array_sort(F.map_entries("tools")))
    source = F.struct("name", "sha256", F.lower("suffix").alias("format"))
    head = record(F.lit(PACKAGE).alias("package_type"), F.lit(VERSION).alias("format_version"), F.lit(created_at).alias("created_at"), F.lit("enhanced").alias("mode"), source.alias("source"), tools.alias("tools"), F.lit("content.md").alias("main_markdown"), F.array_sort("assets").alias("assets"), F.col("spans").alias("provenance"), F.struct((F.size("pages") > 0).alias("enabled"), F.transform("pages", page).alias("pages")).alias("ocr"))
    manifest = F.concat(F.regexp_replace(head, r"\}\z", ""), F.lit(', "chunks": '), objects("listed"), F.lit(', "warnings": '), objects("warnings"), F.lit("}"))
    key = F.col("doc_id")
    notes = F.format_string(NOTES, "name", F.when(F.col("n") > 1, READ_CHUNKS).otherwise(READ_CONTENT))
    made = [
        parts(d, key, "raw.md", 0, F.col("raw"), exact=True),
        parts(d, key, "content.md", 0, F.col("content"), exact=True),
        parts(d, key, "README.md", 0, notes),
        parts(d, key, "manifest.json", 0, manifest),
    ]
    if chunks is not None:
        made.append(parts(several, key, chunk_file(), 0, F.col("content"), exact=True))
    if images is not None:
        named = files.join(images.withColumnRenamed("target", "path"), ["doc_id", "path"])
        made.append(byte_parts(named, key, F.col("asset"), F.col("content") if "content" in files.columns else None, F.col("uri") if "uri" in files.columns else None))
    return reduce(DataFrame.unionByName, made)


def issues_of(docs: DataFrame, most: int) -> DataFrame:
    """doc_id, rule_no, code, severity, line, label, tokens (of documents that are too long): warnings and errors of the cleaned texts of packaged docs, and the heading jumps of the raw ones that are not among them."""
    assets = docs.select("doc_id", F.explode("assets").alias("path"))

    def labelled(text: str, spans: DataFrame, codes: tuple[str, ...] | None = None) -> DataFrame:
        found = rules.issues(docs.select("doc_id", "suffix", F.col(text).alias("markdown")), assets, most, codes).filter(F.col("severity").isin("warning", "error"))
        label = F.get(F.filter("spans", lambda s: (s["start_line"] <= F.col("line")) & (s["end_line"] >= F.col("line"))), 0)["label"]
        size = token_estimate(F.col(text)) if codes is None or "oversized_document" in codes else F.lit(None).cast("long")
        rows = found.join(spans.select("doc_id", "spans", size.alias("tokens")), "doc_id")
        return rows.select("doc_id", "rule_no", "code", "severity", "line", F.coalesce(label, F.lit("")).alias("label"), F.when(F.col("code") == "oversized_document", F.col("tokens")).alias("tokens"))

    raw = labelled("raw", with_spans(docs.drop("spans"), "raw"), ("heading_jump",))
    return labelled("content", docs).unionByName(raw).distinct()


MANIFEST = "package_type string, source struct<sha256:string>, provenance array<string>, warnings array<string>"


def read_assets(spark: SparkSession, root: str) -> DataFrame:
    """key, path (assets/...), content, bytes of the assets of the packages in the folders below root, to be the assets of sources of a pack. Spark's
    readers pass over files without bytes, so an empty asset is not among them."""
    place = r"/([^/]+)/(assets/.+)$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = F.coalesce(F.try_url_decode("path"), F.col("path"))
    rows = files.select(F.regexp_extract(at, place, 1).alias("key"), F.regexp_extract(at, place, 2).alias("asset"), "content", F.col("length").alias("bytes"))
    return rows.filter("asset <> ''").select("key", F.col("asset").alias("path"), "content", "bytes")


def read_packages(files: DataFrame) -> DataFrame:
    """files (key, name, path, content) of document packages -> key, display_name, format, content, spans, warnings, sha256 of each as a source.

    A package without content.md or with a manifest that is no object is an error; spans are coerced, malformed ones stand for the document.
    """
    held = files.filter(F.col("path").isin("content.md", "manifest.json")).groupBy("key", "name").pivot("path", ["content.md", "manifest.json"]).agg(F.first("content"))
    m = F.from_json("`manifest.json`", MANIFEST)
    good = F.col("`content.md`").isNotNull() & F.col("`manifest.json`").isNotNull()
    ready = held.filter(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("Prepared source package is incomplete: "), "key")).cast("boolean"))).withColumn("m", m)
    object_ = F.col("`manifest.json`").rlike(r"^\s*\{") & F.col("m").isNotNull()
    ready = ready.filter(F.when(object_, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("Prepared source manifest is invalid: "), "key")).cast("boolean")))
    fields = "source_type string, label string, ordinal string, start_line string, end_line string, confidence string"
    typed = lambda r: F.struct(F.coalesce(r["source_type"], F.lit("document")).alias("source_type"), F.coalesce(r["label"], F.lit("源文档")).alias("label"), whole(r["ordinal"], F.lit(None).cast("long")).cast("int").alias("ordinal"), whole(r["start_line"], 1).cast("int").alias("start_line"), whole(r["end_line"], 1).cast("int").alias("end_line"), r["confidence"].try_cast("double").alias("confidence"))
    objects = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.rlike(r"^\s*\{"))
    spans = F.transform(F.transform(objects(F.col("m.provenance")), lambda x: F.from_json(x, fields)), typed).cast(f"array<{SPAN}>")
    suffix = F.lower(F.regexp_extract("name", r"(\.[^./\\]+)$", 1))
    return ready.select("key", F.col("name").alias("display_name"), suffix.alias("format"), F.col("`content.md`").alias("content"), spans.alias("spans"), objects(F.col("m.warnings")).alias("warnings"), F.nullif(F.col("m.source.sha256"), F.lit("")).alias("sha256"))


# --- queries: a customer is a document ------------------------------------------------------------------------------------------------------------


def customer_documents(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    long = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("\n## Second: part\nmore of "), k, F.lit(", twenty words "), F.repeat(F.lit("x "), 20))).otherwise("")
    text = F.concat(F.lit("# Customer "), k, F.lit("\r\n\n\n\n### Deep\n<!-- Page: 7 -->\n\ntext "), F.repeat(F.lit("y "), 20), long)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("c"), k, F.lit(".Docx")).alias("name"), text.alias("markdown"), F.sha2(k, 256).alias("sha256"))


_CUSTOMERS = r"""WITH c AS (SELECT c_custkey AS doc_id, c_custkey % 3 = 0 AS two, '# Customer ' || c_custkey AS title, 'text ' || repeat('y ', 20) AS a, 'more of ' || c_custkey || ', twenty words ' || repeat('x ', 20) AS z FROM customer),
t AS (SELECT *, title || chr(13) || repeat(chr(10), 4) || '### Deep' || chr(10) || '<!-- Page: 7 -->' || chr(10) || chr(10) || a || CASE WHEN two THEN chr(10) || '## Second: part' || chr(10) || z ELSE '' END AS raw,
 title || chr(10) || chr(10) || '## Deep' || chr(10) || '<!-- Page: 7 -->' || chr(10) || chr(10) || a || CASE WHEN two THEN chr(10) || '## Second: part' || chr(10) || z ELSE '' END || chr(10) AS content FROM c)"""


@query("package_files", _CUSTOMERS + f""", f AS (SELECT doc_id, 'raw.md' AS path, raw AS content FROM t UNION ALL SELECT doc_id, 'content.md', content FROM t
 UNION ALL SELECT doc_id, 'README.md', replace(replace(concat_ws(chr(10), '# AI 资料包', '', '来源：`c@.Docx`', '', '## 从这里开始', '', CASE WHEN two THEN '{READ_CHUNKS}' ELSE '{READ_CONTENT}' END, '- `raw.md` 是未经清洗的 MarkItDown 原始结果，可用于核对。', '- `manifest.json` 提供机器可读的文件清单与长度信息。', ''), '@', doc_id::VARCHAR), chr(13), '') FROM t
 UNION ALL SELECT doc_id, 'chunks/001-Deep.md', concat_ws(chr(10) || chr(10), title, '## Deep', '<!', '-- Page: 7 -->', trim(a)) || chr(10) FROM t WHERE two
 UNION ALL SELECT doc_id, 'chunks/002-Second_-part.md', concat_ws(chr(10) || chr(10), title, '## Second: part', trim(z)) || chr(10) FROM t WHERE two)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, path, sha256(content) AS sha256 FROM f""")
def packages(spark: SparkSession, sf: str) -> DataFrame:
    """The packages of customers: every file but the manifest."""
    files = whole_files(package_files(customer_documents(spark, sf), "2024-01-01T00:00:00+00:00", target=60, most=90))
    return files.filter("path <> 'manifest.json'").select(F.col("key").alias("doc_id"), "path", F.sha2("content", 256).alias("sha256"))


@query("prepared_sources", _CUSTOMERS + """ SELECT CAST(doc_id AS VARCHAR) AS doc_id, '.docx' AS format, sha256(content) AS content_sha256, sha256(CAST(doc_id AS VARCHAR)) AS sha256, '第 7 页:4' AS span, 'heading_jump:5:' AS warnings FROM t""")
def prepared_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Packages read back as sources: spans, warnings and digests of their manifests."""
    docs = customer_documents(spark, sf)
    files = whole_files(package_files(docs, "2024-01-01T00:00:00+00:00", split=False)).join(docs.select(F.col("doc_id").cast("string").alias("key"), "name"), "key")
    got = read_packages(files)
    span = F.get("spans", 0)
    w = F.from_json(F.get("warnings", 0), "code string, line int, source_label string")
    return got.select(F.col("key").alias("doc_id"), "format", F.sha2("content", 256).alias("content_sha256"), "sha256", F.concat(span["label"], F.lit(":"), span["start_line"].cast("string")).alias("span"), F.concat(w["code"], F.lit(":"), w["line"].cast("string"), F.lit(":"), w["source_label"]).alias("warnings"))


# --- queries: an order is a workbook or a paged text; suppliers likewise, with images -----------------------------------------------------------------------


def order_packages(rows: DataFrame, k: Column) -> DataFrame:
    """A document for each row, by its key: a workbook of two sheets, or a text of five pages with a running head; every one has images."""
    key = k.cast("string")
    book = F.concat(F.lit("## Items\n\n| a | b |\n|---|---|\n| "), key, F.lit(" | 1 |\n\n![p](img/p.bin) ![p](img/P.bin \"t\")\n\n## Notes of "), key, F.lit("\n\nend"))
    page = lambda n: F.concat(F.lit(f"<!-- Page: {n} -->\nOrder "), key, F.lit(f" page {n}\n\nText {'abcde'[n - 1]} of the order.\n\n![x](img\\p.bin) ![{'abcde'[n - 1]}](none.png)\n"))
    paged = F.concat(*[page(n) for n in range(1, 6)])
    return rows.select(k.alias("doc_id"), F.concat(F.lit("o"), key, F.when(k % 2 == 0, ".xlsx").otherwise(".pdf")).alias("name"), F.when(k % 2 == 0, book).otherwise(paged).alias("markdown"))


def order_images(rows: DataFrame, k: Column) -> DataFrame:
    """Two files of each document that differ in their bytes, and in the letter case of their names; and one that no document names."""
    bytes_ = lambda name: F.unhex(F.repeat(F.sha2(F.concat(F.lit(name), k.cast("string")), 256), 3))
    file = lambda name: F.struct(F.lit(f"img/{name}").alias("path"), bytes_(name).alias("content"))
    return rows.select(k.alias("doc_id"), F.inline(F.array(file("p.bin"), file("P.bin"), file("other.bin"))))


@query("package_spans", r"""WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT k AS doc_id, i AS place, CASE WHEN k % 2 = 0 THEN 'worksheet' ELSE 'page' END AS kind, CASE WHEN k % 2 = 1 THEN '第 ' || i || ' 页' WHEN i = 1 THEN 'Items' ELSE 'Notes of ' || k END AS label,
 CASE WHEN k % 2 = 0 THEN CASE i WHEN 1 THEN 1 ELSE 9 END ELSE 5 * (i - 1) + 1 END AS start_line, CASE WHEN k % 2 = 0 THEN CASE i WHEN 1 THEN 8 ELSE 11 END ELSE 5 * i END AS end_line
FROM o, unnest(range(1, CASE WHEN k % 2 = 0 THEN 3 ELSE 6 END)) t(i)""")
def package_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of cleaned orders: worksheets by their names, pages without their running heads."""
    d = packaged(cleaned_documents(order_packages(table(spark, sf, "orders"), F.col("o_orderkey"))))
    rows = d.select("doc_id", F.posexplode_outer("spans").alias("i", "s"))  # no document is without spans; else they would be computed again to see that
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("place"), F.col("s.source_type").alias("kind"), F.col("s.label").alias("label"), F.col("s.start_line").alias("start_line"), F.col("s.end_line").alias("end_line"))


@query("package_assets", r"""WITH o AS (SELECT s_suppkey AS k FROM supplier),
a AS (SELECT k, 'p.bin' AS name, 'assets/p.bin' AS path FROM o UNION ALL SELECT k, 'P.bin', 'assets/P_2.bin' FROM o WHERE k % 2 = 0),
b AS (SELECT k, path, unhex(repeat(sha256(name || k), 3)) AS content FROM a)
SELECT CAST(k AS VARCHAR) AS doc_id, path, CAST(octet_length(content) AS BIGINT) AS bytes, sha256(content) AS sha256,
 CASE WHEN k % 2 = 0 THEN '![p](assets/p.bin) ![p](assets/P_2.bin)' ELSE '![x](assets/p.bin) ![a](none.png)' END AS links FROM b""")
def package_assets(spark: SparkSession, sf: str) -> DataFrame:
    """Packages of suppliers written with their images and read back: the bytes of each asset, and the links of the document to it."""
    root, s, k = new_place(spark, "packages"), table(spark, sf, "supplier"), F.col("s_suppkey")
    write_listed(package_files(order_packages(s, k), "2024-01-01T00:00:00+00:00", split=False, files=order_images(s, k)), root)
    inside = lambda k: F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/(content\.md)$", k)
    texts = spark.read.text(f"{root}/*/content.md", wholetext=True).select(inside(1).alias("key"), F.regexp_extract("value", r"(?m)^(!\[.*)$", 1).alias("links"))
    read = read_assets(spark, root).join(texts, "key")
    return read.select(F.col("key").alias("doc_id"), "path", "bytes", F.sha2("content", 256).alias("sha256"), "links")
