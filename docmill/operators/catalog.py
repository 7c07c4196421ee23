"""Capabilities and presets, source locations and their opening, history records: written, scanned, searched, measured, deleted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.operators.documents import _LINES_SQL, page_lines
from docmill.operators.tasks import _TASKS_SQL, tasks
from docmill.registry import query, table

# Suffixes of each class, and what an operation needs: order, suffixes, any one of these tools, share of its input that its output may take.
MARKDOWN = (".docx", ".pptx", ".xlsx", ".pdf", ".html", ".htm", ".csv", ".json", ".xml", ".epub", ".txt", ".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp")
WORD, SLIDES = (".doc", ".docx"), (".ppt", ".pptx")
VIDEO = (".mp4", ".mov", ".mkv", ".avi", ".webm", ".m4v")
OPERATIONS = (
    ("to_markdown", 1, MARKDOWN, ("markitdown",), 1.5),
    ("to_pdf", 2, WORD, ("winword", "libreoffice"), 1.5),
    ("to_pdf", 2, SLIDES, ("powerpoint", "libreoffice"), 1.5),
    ("compress_video", 3, VIDEO, ("ffmpeg",), 0.75),
    ("extract_audio", 4, VIDEO, ("ffmpeg",), 0.5),
    ("standardize_mp4", 5, VIDEO, ("ffmpeg",), 1.25),
    ("keyframes_contact_sheet", 6, VIDEO, ("ffmpeg",), 0.5),
    ("rename_video", 7, VIDEO, (), 1.0),
    ("organize_video", 8, VIDEO, (), 1.0),
    ("document_context_pack", 9, MARKDOWN, ("markitdown",), 1.5),
)
# Preset, budget, whether images are recognised.
PRESETS = (("research_paper", 128_000, True), ("course_notes", 64_000, False), ("coding_documents", 64_000, False))


def capabilities(files: DataFrame) -> DataFrame:
    """path, operation, ordinal, available, reason of (path, suffix, tools): each operation that fits the suffix; the reason names what is missing.

    A file's operations are an expression over its own row. Null tools count as none, a null suffix as no suffix.
    """
    have = F.coalesce("tools", F.array().cast("array<string>"))
    rows = []
    for name, ordinal, suffixes, needs, _ in OPERATIONS:
        ok = F.lit(True) if not needs else F.arrays_overlap(have, F.array(*map(F.lit, needs)))
        entry = F.struct(F.lit(name).alias("operation"), F.lit(ordinal).alias("ordinal"), ok.alias("available"), F.when(ok, "").otherwise("needs " + " or ".join(needs)).alias("reason"))
        rows.append(F.when(F.lower("suffix").isin(*suffixes), entry))
    return files.select("path", F.inline(F.array_compact(F.array(*rows))))


def common(files: DataFrame, of: str) -> DataFrame:
    """of, operation, ordinal: the operations that every file of a selection has available, in the operations' order within it."""
    n = files.groupBy(of).agg(F.count("*").alias("n"))
    each = capabilities(files.withColumn("path", F.struct(of, "path"))).filter("available")
    k = each.groupBy(F.col(f"path.{of}").alias(of), "operation", "ordinal").agg(F.count("*").alias("k"))
    return k.join(n, of).filter("k = n").select(of, "operation", "ordinal")


_TOOLS_SQL = "(f.tools & 1 > 0 AND op IN ('to_markdown', 'document_context_pack')) OR (f.tools & 2 > 0 AND op = 'to_pdf')"
_FILES_SQL = """WITH f AS (SELECT doc_id, source, ['.docx', '.PPTX', '.txt', '.md'][doc_id % 4 + 1] AS suffix, doc_id % 3 + 1 AS tools FROM documents),
o AS (SELECT doc_id, source, suffix, tools, unnest(CASE WHEN suffix IN ('.docx', '.PPTX') THEN ['to_markdown', 'to_pdf', 'document_context_pack'] WHEN suffix = '.txt' THEN ['to_markdown', 'document_context_pack'] ELSE [] END) AS op FROM f)"""


def _files(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    suffix = F.element_at(F.array(*map(F.lit, (".docx", ".PPTX", ".txt", ".md"))), (d % 4 + 1).cast("int"))
    names = F.element_at(F.array(F.array(F.lit("markitdown")), F.array(F.lit("libreoffice")), F.array(F.lit("markitdown"), F.lit("libreoffice"))), (d % 3 + 1).cast("int"))
    return table(spark, sf, "documents").select(d.alias("path"), "source", suffix.alias("suffix"), names.alias("tools"))


@query("capability_matrix", _FILES_SQL + f", m AS (SELECT f.doc_id AS path, op, {_TOOLS_SQL} AS available, f.suffix FROM o AS f) SELECT path, op AS operation, available, CASE WHEN available THEN '' WHEN op <> 'to_pdf' THEN 'needs markitdown' WHEN suffix = '.docx' THEN 'needs winword or libreoffice' ELSE 'needs powerpoint or libreoffice' END AS reason FROM m")
def capability_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return capabilities(_files(spark, sf)).drop("ordinal")


@query("selection_operations", _FILES_SQL + f", n AS (SELECT doc_id % 50 AS pick, count(*) AS n FROM f GROUP BY 1), k AS (SELECT doc_id % 50 AS pick, op, count(*) AS k FROM o AS f WHERE {_TOOLS_SQL} GROUP BY 1, 2) SELECT pick, op AS operation FROM k JOIN n USING (pick) WHERE k = n UNION ALL SELECT -1, 'to_pdf'")
def selection_operations(spark: SparkSession, sf: str) -> DataFrame:
    office = spark.createDataFrame([(-1, -1, ".doc", ["libreoffice"]), (-1, -2, ".pptx", ["libreoffice", "markitdown"])], "pick long, path long, suffix string, tools array<string>")
    return common(_files(spark, sf).withColumn("pick", F.col("path") % 50).select("pick", "path", "suffix", "tools").unionByName(office), "pick").drop("ordinal")


# --- locations -----------------------------------------------------------------------------------------------------------------------------------


def location(span: Column) -> Column:
    """kind, display, fallback of a span (kind, label, ordinal, confidence): unknown kinds and those without what they need stand for the whole document."""
    kind, label = F.when(span.kind.isin("page", "slide", "worksheet", "ocr"), span.kind).otherwise("document"), F.coalesce(span.label, F.lit(""))
    whole = (kind == "document") | (kind.isin("page", "slide") & span.ordinal.isNull()) | ((kind == "worksheet") & (label == ""))
    sure = F.when(span.confidence.isNotNull(), F.format_string(" (%d%% confidence)", F.bround(span.confidence * 100, 0).cast("long"))).otherwise("")
    text = F.when(whole, "Document level").when(kind == "page", F.concat(F.lit("PDF page "), span.ordinal.cast("string"))).when(kind == "slide", F.concat(F.lit("Slide "), span.ordinal.cast("string"))).when(kind == "worksheet", F.concat(F.lit("Sheet "), label)).otherwise(F.concat(F.when(label != "", F.concat(F.lit("OCR "), label)).otherwise("OCR"), sure))
    return F.struct(kind.alias("kind"), text.alias("display"), whole.alias("fallback"), span.ordinal.alias("ordinal"))


def primary(locations: Column) -> Column:
    """The first location that is not a fallback, else the first."""
    return F.coalesce(F.get(F.filter(locations, lambda x: ~x.fallback), 0), F.get(locations, 0))


def span_of(payload: Column) -> Column:
    """A span from JSON: numbers coerced, what is missing or malformed by default (whole document, lines 1 to 1)."""
    r = F.from_json(payload, "source_type string, label string, ordinal string, start_line string, end_line string, confidence string")
    whole = lambda name, other: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(r[name], r"^\s*(\d{1,9})\s*$", 1), F.lit("")), F.lit("999999999")).cast("int"), other)
    number = F.when(r.confidence.rlike(r"^[0-9]*\.?[0-9]+$"), r.confidence.cast("double"))
    return F.struct(F.coalesce(r.source_type, F.lit("document")).alias("kind"), F.coalesce(r.label, F.lit("Document")).alias("label"), whole("ordinal", F.lit(None).cast("int")).alias("ordinal"), whole("start_line", F.lit(1)).alias("start_line"), whole("end_line", F.lit(1)).alias("end_line"), number.alias("confidence"))


@query("source_map_locations", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'PDF page ' || event_id WHEN 1 THEN 'Document level' WHEN 2 THEN 'Sheet Sales' WHEN 3 THEN 'OCR p (' || CAST(round_even((event_id % 101) / 100.0::DOUBLE * 100, 0) AS BIGINT) || '% confidence)' WHEN 4 THEN 'Slide ' || event_id ELSE 'Document level' END AS display,
 event_id % 6 IN (1, 5) AS fallback FROM events""")
def source_map_locations(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    case = F.element_at(F.array(*map(F.lit, ("page", "page", "worksheet", "ocr", "slide", "unheard of"))), (e % 6 + 1).cast("int"))
    label = F.when(e % 6 == 2, "Sales").when(e % 6 == 3, "p")
    payload = F.to_json(F.struct(case.alias("source_type"), label.alias("label"), F.when(e % 6 != 1, e).alias("ordinal"), F.when(e % 6 == 3, e % 101 / 100.0).alias("confidence")))
    rows = table(spark, sf, "events").select("event_id", location(span_of(payload)).alias("l"))
    found = rows.select("event_id", primary(F.array("l")).alias("l"))
    return found.select("event_id", "l.display", "l.fallback")


def open_target(entries: DataFrame, files: DataFrame) -> DataFrame:
    """entries (source_id, display_name, format, sha256, location) with capability, page and reason, by the files (source_id, name, sha256) of the session.

    One left join on the source; a file counts if its name is the same, letter case aside, and its digest the recorded one, if one is recorded.
    """
    f = files.select("source_id", F.col("name").alias("file_name"), F.lower("sha256").alias("file_sha"))
    e = entries.join(f, "source_id", "left")
    want = F.lower(F.trim(F.coalesce("sha256", F.lit(""))))
    reason = (
        F.when(F.col("file_name").isNull(), "no file in this session")
        .when(F.lower("file_name") != F.lower("display_name"), "another name")
        .when((want != "") & ~want.rlike("^[0-9a-f]{64}$"), "malformed digest")
        .when((want != "") & ~F.col("file_sha").eqNullSafe(want), "changed since")
    )
    page = (F.regexp_replace(F.lower("format"), r"^\.+", "") == "pdf") & (F.col("location.kind") == "page") & (F.col("location.ordinal") > 0)
    kind = F.when(reason.isNotNull(), "unavailable").when(page, "page").otherwise("document")
    return e.select(*entries.columns, kind.alias("capability"), F.when(kind == "page", F.col("location.ordinal")).alias("page"), F.coalesce(reason, F.lit("")).alias("reason"))


@query("source_open", """SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 3 = 0 OR doc_id % 11 = 0 THEN 'unavailable' WHEN doc_id % 2 = 0 THEN 'page' ELSE 'document' END AS capability,
 CASE WHEN doc_id % 7 = 0 THEN 'no file in this session' WHEN doc_id % 5 = 0 THEN 'another name' WHEN doc_id % 3 = 0 THEN 'malformed digest' WHEN doc_id % 11 = 0 THEN 'changed since' ELSE '' END AS reason FROM documents""")
def source_open(spark: SparkSession, sf: str) -> DataFrame:
    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    sha = F.when(d % 3 == 0, "short").when(d % 11 == 0, F.sha2(F.concat(text, F.lit("!")), 256)).when(d % 13 == 0, "").otherwise(F.upper(F.sha2(text, 256)))
    place = F.struct(F.lit("page").alias("kind"), F.lit(3).alias("ordinal"))
    rows = table(spark, sf, "documents").select("doc_id", d.alias("source_id"), F.concat(F.lit("Doc "), d.cast("string"), F.lit(".PDF")).alias("display_name"), F.when(d % 2 == 0, ".pdf").otherwise("txt").alias("format"), sha.alias("sha256"), place.alias("location"))
    files = table(spark, sf, "documents").filter(d % 7 != 0).select(d.alias("source_id"), F.concat(F.when(d % 5 == 0, "other ").otherwise("doc "), d.cast("string"), F.lit(".pdf")).alias("name"), F.sha2(text, 256).alias("sha256"))
    return open_target(rows, files).select("doc_id", "capability", "reason")


@query("line_labels", _LINES_SQL + " SELECT doc_id, line_no, 'Page ' || page AS label FROM lines")
def line_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Each line with the label of the span that it is in: the last marker at or above it."""
    mark = F.regexp_extract("line", r"^<!-- Page: (\d+) -->$", 1)
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    label = F.last(F.when(mark != "", F.concat(F.lit("Page "), mark)), ignorenulls=True).over(w)
    return page_lines(spark, sf).select("doc_id", "line_no", F.coalesce(label, F.lit("")).alias("label"))


@query("block_provenance", _LINES_SQL + ", z AS (SELECT doc_id, max(page) AS pages FROM lines GROUP BY doc_id) SELECT doc_id, page AS block, array_to_string(CASE WHEN page < pages THEN ['Page ' || page, 'Page ' || (page + 1)] ELSE ['Page ' || page] END, ',') AS labels FROM z JOIN (SELECT DISTINCT doc_id, page FROM lines) USING (doc_id)")
def block_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of six lines from each page's start with the labels of all spans that they overlap: a filter over the document's spans, no range join."""
    lines = page_lines(spark, sf).filter(F.col("line").rlike("^<!-- Page: [0-9]+ -->$"))
    spans = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "page"))).alias("s"))
    s = F.transform("s", lambda x, i: F.struct(x.line_no.alias("a"), F.coalesce(F.get("s", i + 1).line_no - 1, F.lit(10**9)).alias("z"), x.page.alias("page")))
    rows = spans.select("doc_id", s.alias("s")).select("doc_id", "s", F.explode("s").alias("b"))
    over = F.filter("s", lambda x: (x.a <= F.col("b.a") + 5) & (x.z >= F.col("b.a")))
    return rows.select("doc_id", F.col("b.page").alias("block"), F.array_join(F.transform(over, lambda x: F.concat(F.lit("Page "), x.page.cast("string"))), ",").alias("labels"))


# --- history -------------------------------------------------------------------------------------------------------------------------------------

RECORD = "task_id string, created_at timestamp, operation string, status string, source string, output string, bytes long, score double, tokens long, chunks long"


def write_history(records: DataFrame, root: str) -> None:
    """Appends records below root by year and month: one task's records share its partition, and Spark's commit makes them visible at once."""
    records.select("*", F.date_format("created_at", "yyyy").alias("year"), F.date_format("created_at", "MM").alias("month")).write.mode("append").partitionBy("year", "month").json(root)


def read_history(spark: SparkSession, root: str) -> DataFrame:
    """task_id, created_at, statuses, operations, sources, outputs, bytes, total, success, failed of all records below root, unreadable lines left out."""
    return entries(spark.read.schema(RECORD).option("mode", "DROPMALFORMED").json(root))


def entries(records: DataFrame) -> DataFrame:
    first = lambda c: F.array_distinct(F.filter(F.transform("r", lambda x: x[c]), lambda x: x.isNotNull()))
    r = records.filter("task_id is not null").groupBy("task_id").agg(F.max("created_at").alias("created_at"), F.array_sort(F.collect_list(F.struct("created_at", "source", "status", "operation", "output"))).alias("r"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "failed").alias("failed"))
    return r.select("task_id", "created_at", first("status").alias("statuses"), first("operation").alias("operations"), first("source").alias("sources"), first("output").alias("outputs"), "bytes", "total", "success", "failed")


def usage(spark: SparkSession, root: str) -> DataFrame:
    """files, bytes of everything below root, whatever it is."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def without(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Records whose task is not among ids (task_id); what is deleted is what a rewrite leaves out."""
    return records.join(ids.select("task_id").distinct(), "task_id", "left_anti")


@query("quality_labels", "WITH t AS (SELECT user_id, event_id % 101 AS score, event_id % 3000 AS tokens, event_id % 3 AS chunks FROM events), a AS (SELECT user_id, CAST(round_even(avg(score), 0) AS BIGINT) AS score, sum(tokens) AS tokens, sum(chunks) AS chunks FROM t GROUP BY user_id) SELECT user_id, score || '/100' || CASE WHEN tokens > 0 THEN ' · about ' || format('{:,}', tokens::BIGINT) || ' tokens' ELSE '' END || CASE WHEN chunks > 0 THEN ' · ' || chunks || ' parts' ELSE '' END AS label FROM a")
def quality_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A task's quality in words: mean score, sum of tokens and of parts; what is nothing is not mentioned."""
    e = F.col("event_id")
    a = table(spark, sf, "events").groupBy("user_id").agg(F.bround(F.avg(e % 101), 0).cast("long").alias("score"), F.sum(e % 3000).alias("tokens"), F.sum(e % 3).alias("chunks"))
    part = F.concat_ws(" · ", F.concat(F.col("score").cast("string"), F.lit("/100")), F.when(F.col("tokens") > 0, F.concat(F.lit("about "), F.format_number("tokens", 0), F.lit(" tokens"))), F.when(F.col("chunks") > 0, F.concat(F.col("chunks").cast("string"), F.lit(" parts"))))
    return a.select("user_id", F.coalesce(F.nullif(part, F.lit("")), F.lit("see details")).alias("label"))


def _throttle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    owner, last = None, 0
    for frame in frames:
        keep = []
        for user, value in zip(frame["user_id"], frame["progress"], strict=True):
            if user != owner:
                owner, last = user, None
            stored = last is None or value < last or value >= last + 5
            last = value if stored else last
            keep.append(stored)
        yield frame.assign(stored=keep)


def throttled(progress: DataFrame) -> DataFrame:
    """user_id, task_id, progress, stored: whether a value is stored, in the order of task_id: the first, one that fell, one that grew by five or more since
    the last that was stored. The fold keeps one number."""
    rows = progress.select("user_id", "task_id", "progress").repartition("user_id").sortWithinPartitions("user_id", "task_id")
    return rows.mapInPandas(_throttle, "user_id long, task_id long, progress long, stored boolean")


@query("progress_throttle", """WITH RECURSIVE t AS (SELECT user_id, event_id AS task_id, event_id * 7 % 23 AS progress, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
p AS (SELECT user_id, task_id, progress, i, progress AS last, true AS stored FROM t WHERE i = 1
 UNION ALL SELECT t.user_id, t.task_id, t.progress, t.i, CASE WHEN t.progress < last OR t.progress >= last + 5 THEN t.progress ELSE last END, t.progress < last OR t.progress >= last + 5 FROM p JOIN t ON t.user_id = p.user_id AND t.i = p.i + 1)
SELECT user_id, task_id, progress, stored FROM p""")
def progress_throttle(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return throttled(table(spark, sf, "events").select("user_id", e.alias("task_id"), (e * 7 % 23).alias("progress")))


@query("task_manifest", _TASKS_SQL + " SELECT CAST(user_id AS VARCHAR) AS task_id, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(sum(bytes) AS BIGINT) AS bytes, array_to_string(list_sort(list(DISTINCT status)), ',') AS statuses FROM t GROUP BY user_id")
def task_manifest(spark: SparkSession, sf: str) -> DataFrame:
    t = tasks(spark, sf).select(F.col("user_id").cast("string").alias("task_id"), "created_at", "operation", "status", F.col("task_id").cast("string").alias("source"), F.lit(None).cast("string").alias("output"), "bytes")
    return entries(t).select("task_id", "total", "success", "failed", "bytes", F.array_join(F.array_sort("statuses"), ",").alias("statuses"))


@query("presets", "SELECT * FROM (VALUES ('research_paper', 128000::BIGINT, true, '128K context window'), ('course_notes', 64000::BIGINT, false, '64K context window'), ('coding_documents', 64000::BIGINT, false, '64K context window')) v(preset, budget, ocr, label)")
def presets(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame(list(PRESETS), "preset string, budget long, ocr boolean")
    return rows.withColumn("label", F.concat((F.col("budget") / 1000).cast("long").cast("string"), F.lit("K context window")))
