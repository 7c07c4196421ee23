"""Queries over functions that no other query reaches: files found and classified, reports and queues read back, usage, labels, links, commands, slides and sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.functions.provenance import location_label, with_spans
from docmill.operators import naming, packs, rules
from docmill.operators.catalog import location, primary, usage
from docmill.operators.chunks import split_documents
from docmill.operators.document_packages import _CUSTOMERS, customer_documents
from docmill.operators.records import known_ids
from docmill.plans.stored import new_place
from docmill.registry import query, table
from docmill.sources import files, task_queue
from docmill.sources.part_files import parts, write_files


def _supplier_files(spark: SparkSession, sf: str, path: Column, text: Column) -> str:
    """A folder with a file for each supplier."""
    root = new_place(spark, "supplier-files")
    write_files(parts(table(spark, sf, "supplier"), F.lit("in"), path, 0, text, exact=True), root)
    return f"{root}/in"


@query("discovered_files", r"""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 6 AS kind FROM supplier), f AS (SELECT k, CASE kind WHEN 0 THEN 'A/' ELSE 'b/' END || k || CASE kind WHEN 0 THEN '.PDF' WHEN 1 THEN '.Mp4' WHEN 2 THEN '.exe' WHEN 3 THEN '.md.docx' WHEN 4 THEN '' ELSE '.HTML' END AS path, kind, length('text ' || k) AS bytes FROM s)
SELECT string_split(path, '/')[-1] AS name, CASE kind WHEN 0 THEN '.pdf' WHEN 1 THEN '.mp4' WHEN 3 THEN '.docx' ELSE '.html' END AS suffix, bytes, CASE WHEN kind = 1 THEN 'videos' ELSE 'documents' END AS workspace, row_number() OVER (ORDER BY lower(path)) AS place FROM f WHERE kind IN (0, 1, 3, 5)""")
def discovered_files(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as files of several kinds: those that a workspace takes, in the order of their paths."""
    k = F.col("s_suppkey")
    kind = k % 6
    suffix = F.when(kind == 0, ".PDF").when(kind == 1, ".Mp4").when(kind == 2, ".exe").when(kind == 3, ".md.docx").when(kind == 4, "").otherwise(".HTML")
    path = F.concat(F.when(kind == 0, "A/").otherwise("b/"), k.cast("string"), suffix)
    found = files.classify(files.discover(spark, _supplier_files(spark, sf, path, F.concat(F.lit("text "), k.cast("string")))))
    # the order is part of the result: a row's place is its place in its partition behind the rows of those before it, of which there is a count each
    rows = found.select("name", "suffix", "bytes", "workspace", F.monotonically_increasing_id().alias("at")).withColumn("run", F.shiftright("at", 33))
    runs = rows.groupBy("run").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(runs.select("run", "first", earlier.alias("n")), "run").select("name", "suffix", "bytes", "workspace", (F.col("at") - F.col("first") + F.col("n") + 1).alias("place"))


@query("history_usage", "SELECT count(*) AS files, CAST(sum(length(s_name) + 2) AS BIGINT) AS bytes FROM supplier")
def history_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Files and bytes below a folder."""
    key = F.col("s_suppkey").cast("string")
    return usage(spark, _supplier_files(spark, sf, F.concat(key, F.lit("/manifest.json")), F.concat(F.col("s_name"), F.lit("\n\n"))))


@query("pack_reports", r"""SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 < 2 THEN s_suppkey * 1000 END AS budget, CASE WHEN s_suppkey % 4 = 3 THEN 0 ELSE 2 END AS n_sources, CASE WHEN s_suppkey % 4 = 3 THEN 0 ELSE 3 END AS n_packs, CASE s_suppkey % 4 WHEN 0 THEN 1 WHEN 3 THEN 0 ELSE 0 END AS overflow,
 CASE WHEN s_suppkey % 4 < 2 THEN s_suppkey || 'K context window' ELSE 'No limit' END AS label, CASE s_suppkey % 4 WHEN 0 THEN 'over_budget' WHEN 1 THEN 'within_budget' ELSE 'no_limit' END AS status FROM supplier""")
def pack_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of packs as files, every fourth broken, some without a budget."""
    k = F.col("s_suppkey")
    pack = lambda over: F.struct(F.lit("1").alias("index"), F.lit("2").alias("estimated_tokens"), over.alias("over_budget"))
    budget = F.when(k % 4 < 2, (k * 1000).cast("string"))
    report = F.to_json(F.struct(budget.alias("requested_tokens"), F.array(F.struct(F.lit("a").alias("id")), F.struct(F.lit("b").alias("id"))).alias("sources"), F.array(pack(k % 4 == 0), pack(F.lit(False)), pack(F.lit(False))).alias("packs")))
    folder = _supplier_files(spark, sf, F.concat(k.cast("string"), F.lit(".json")), F.when(k % 4 == 3, "{broken").otherwise(report))
    return files.read_pack_reports(spark, folder).select(F.regexp_extract("path", r"(\d+)\.json$", 1).cast("long").alias("k"), "budget", "n_sources", "n_packs", "overflow", "label", "status")


@query("task_queue", f"""WITH t AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'success' WHEN 2 THEN 'waiting' END AS status FROM customer)
SELECT CAST(k AS VARCHAR) AS task_id, CASE WHEN status = 'running' THEN 'interrupted' ELSE coalesce(status, 'waiting') END AS status, CASE WHEN status = 'running' THEN least(99, k % 101) ELSE k % 101 END AS progress, CASE WHEN status = 'running' THEN '{task_queue.INTERRUPTED}' END AS message FROM t""")
def queue(spark: SparkSession, sf: str) -> DataFrame:
    """A queue saved twice and loaded after a restart: the newest version, what was running interrupted."""
    k = F.col("c_custkey")
    status = F.when(k % 4 == 0, "running").when(k % 4 == 1, "success").when(k % 4 == 2, "waiting")
    t = table(spark, sf, "customer").select(k.cast("string").alias("task_id"), F.lit("s").alias("source"), F.lit("TO_PDF").alias("operation"), F.lit("o").alias("output_root"), status.alias("status"), (k % 101).cast("int").alias("progress"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"))
    root = new_place(spark, "queue")
    task_queue.save(t.limit(1), root)
    task_queue.save(t, root)
    return task_queue.load(spark, root, recover=True).select("task_id", "status", "progress", "message")


@query("known_task_ids", "SELECT CAST(o_custkey AS VARCHAR) AS task_id FROM orders UNION SELECT CAST(user_id AS VARCHAR) FROM events")
def ids(spark: SparkSession, sf: str) -> DataFrame:
    """Recovered and enqueued ids, each once."""
    named = lambda name, c: table(spark, sf, name).select(F.col(c).cast("string").alias("task_id"))
    return known_ids(named("orders", "o_custkey"), named("events", "user_id"))


@query("ffmetadata_tags", "SELECT event_id, 'two=' || event_id || ' ' AS title, CAST(event_id AS VARCHAR) AS artist, CASE WHEN event_id % 2 = 0 THEN '' END AS empty, 2 + CAST(event_id % 2 = 0 AS INT) AS n FROM events")
def ffmetadata_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tags from key=value lines: comments and lines without a sign say nothing, the last of a key counts."""
    e = F.col("event_id").cast("string")
    text = F.concat(F.lit(";FFMETADATA1\r\nTitle=one\n# artist=no\nARTIST = "), e, F.lit("\nnothing\n ;x=1\ntitle=two="), e, F.when(F.col("event_id") % 2 == 0, "\nempty=").otherwise(""))
    t = table(spark, sf, "events").select("event_id", naming.ffmetadata(text).alias("m"))
    value = lambda k: F.try_element_at("m", F.lit(k)).alias(k)
    return t.select("event_id", F.concat(value("title"), F.lit(" ")).alias("title"), value("artist"), value("empty"), F.size("m").alias("n"))


_SPAN_SQL = "SELECT event_id AS e, ['page', 'slide', 'worksheet', 'ocr', 'document', 'odd'][1 + event_id % 6] AS kind, CASE WHEN event_id % 5 > 0 THEN event_id END AS n, CASE WHEN event_id % 7 > 0 THEN 'L' || event_id ELSE '' END AS label FROM events"


def _span(e: Column) -> Column:
    kinds = F.array(*map(F.lit, ("page", "slide", "worksheet", "ocr", "document", "odd")))
    kind = F.get(kinds, (e % 6).cast("int"))
    label = F.when(e % 7 > 0, F.concat(F.lit("L"), e.cast("string"))).otherwise("")
    return F.struct(kind.alias("kind"), kind.alias("source_type"), label.alias("label"), F.when(e % 5 > 0, e.cast("int")).alias("ordinal"), F.when(e % 2 == 0, 0.5).cast("double").alias("confidence"))


@query("location_labels", f"""WITH s AS ({_SPAN_SQL})
SELECT e AS event_id, CASE WHEN kind = 'page' AND n IS NOT NULL THEN '第 ' || n || ' 页' WHEN kind = 'slide' AND n IS NOT NULL THEN '第 ' || n || ' 张幻灯片' WHEN kind = 'worksheet' AND label <> '' THEN '工作表：' || label
 WHEN kind = 'ocr' THEN CASE WHEN label <> '' THEN 'OCR：' || label ELSE 'OCR' END || CASE WHEN e % 2 = 0 THEN '（置信度 50%）' ELSE '' END ELSE '文档级定位' END AS label FROM s""")
def location_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", location_label(_span(F.col("event_id"))).alias("label"))


@query("primary_locations", f"""WITH s AS ({_SPAN_SQL}), d AS (SELECT e, CASE WHEN kind = 'page' AND n IS NOT NULL THEN 'PDF page ' || n WHEN kind = 'slide' AND n IS NOT NULL THEN 'Slide ' || n WHEN kind = 'worksheet' AND label <> '' THEN 'Sheet ' || label
 WHEN kind = 'ocr' THEN CASE WHEN label <> '' THEN 'OCR ' || label ELSE 'OCR' END || CASE WHEN e % 2 = 0 THEN ' (50% confidence)' ELSE '' END END AS text FROM s)
SELECT e AS event_id, coalesce(text, 'Slide 9') AS place FROM d""")
def primary_locations(spark: SparkSession, sf: str) -> DataFrame:
    """The first location that is not for the whole document: that of an event, else the slide behind it."""
    slide = F.struct(F.lit("slide").alias("kind"), F.lit("slide").alias("source_type"), F.lit("").alias("label"), F.lit(9).alias("ordinal"), F.lit(None).cast("double").alias("confidence"))
    return table(spark, sf, "events").select("event_id", primary(F.transform(F.array(_span(F.col("event_id")), slide), location))["display"].alias("place"))


@query("asset_links", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN concat('```', chr(10), '](assets/', o_orderkey, ')', chr(10), '```') ELSE concat('![a](r/assets/', o_orderkey, '.png) `](assets/code)` [b]: r/assets/b "t" <img src="r/assets/c">', CASE WHEN o_orderkey % 2 = 0 THEN ' ](other/assets/d)' ELSE '' END) END AS content FROM orders""")
def asset_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links to assets put below another root: not in code, not in fences, not to other folders."""
    k = F.col("o_orderkey")
    key = k.cast("string")
    fenced = F.concat(F.lit("```\n](assets/"), key, F.lit(")\n```"))
    text = F.concat(F.lit("![a](assets/"), key, F.lit('.png) `](assets/code)` [b]: ./assets/b "t" <img src="assets/c">'), F.when(k % 2 == 0, " ](other/assets/d)").otherwise(""))
    return table(spark, sf, "orders").select("o_orderkey", packs.link_assets(F.when(k % 3 == 0, fenced).otherwise(text), F.lit("r/assets/")).alias("content"))


@query("slides_and_sheets", r"""SELECT s_suppkey AS doc_id, CASE s_suppkey % 3 WHEN 0 THEN concat_ws(chr(10), '<!-- Slide number: 1 -->', s_name, '', '---', '', '<!-- slide number:2 -->', 'b', '', '---', '', '<!-- Slide number: 3 -->') WHEN 1 THEN concat_ws(chr(10), '# 工作表：' || s_name, '| a |', '### c') ELSE '## ' || s_name END AS markdown FROM supplier""")
def slides_and_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """The rule of a document's suffix: rules between slides, labels of sheets, none."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    slides = F.concat(F.lit("<!-- Slide number: 1 -->\n"), name, F.lit("\n\n\n<!-- slide number:2 -->\nb\n<!-- Slide number: 3 -->"))
    text = F.when(k % 3 == 0, slides).when(k % 3 == 1, F.concat(F.lit("## "), name, F.lit("\n| a |\n### c"))).otherwise(F.concat(F.lit("## "), name))
    suffix = F.when(k % 3 == 0, ".PPTX").when(k % 3 == 1, ".xlsx").otherwise(".md")
    return rules.by_suffix(table(spark, sf, "supplier").select(k.alias("doc_id"), suffix.alias("suffix"), text.alias("markdown"))).select("doc_id", "markdown")


@query("ocr_appendix", r"""SELECT conv_id AS doc_id, sha256('## OCR 补充文本' || chr(10) || chr(10) || string_agg('### Page ' || turn || '（平均置信度 ' || CASE WHEN turn % 2 = 0 THEN '50.0' ELSE '87.5' END || '%）' || chr(10) || chr(10) || 'seen ' || turn, chr(10) || chr(10) ORDER BY turn) || chr(10)) AS sha256 FROM (SELECT DISTINCT conv_id, turn FROM conversations) GROUP BY conv_id""")
def ocr_appendix(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as recognised pages: their sections behind a document."""
    t = F.col("turn")
    pages = table(spark, sf, "conversations").select("conv_id", "turn").distinct()
    pages = pages.select(F.col("conv_id").alias("doc_id"), t.alias("page"), F.concat(F.lit("Page "), t.cast("string")).alias("label"), F.concat(F.lit(" seen "), t.cast("string"), F.lit(" ")).alias("text"), F.when(t % 2 == 0, 0.5).otherwise(0.875).alias("confidence"))
    return rules.appendix(pages).select("doc_id", F.sha2("appendix", 256).alias("sha256"))


@query("chunk_labels", _CUSTOMERS + """ SELECT doc_id, k AS chunk, '第 7 页' AS labels FROM t, unnest(CASE WHEN two THEN [1, 2] ELSE [1] END) u(k)""")
def chunk_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of customers as documents and the places that their text comes from."""
    d = with_spans(customer_documents(spark, sf).withColumn("suffix", F.lit(".docx")))
    chunks = split_documents(d.select("doc_id", "markdown", "spans"), 60, 90)
    return chunks.select("doc_id", F.col("chunk").cast("int").alias("chunk"), F.array_join("labels", ",").alias("labels"))


@query("encoder_commands", r"""WITH m AS (SELECT event_id, ['compress', 'audio', 'standardize', 'rename'][1 + event_id % 4] AS operation, 18 + event_id % 10 AS crf FROM events)
SELECT event_id, CASE operation WHEN 'compress' THEN concat_ws(' ', 'ffmpeg -hide_banner -nostdin -progress pipe:1 -stats_period 0.25 -n -i', event_id || '.mov', '-map_metadata 0 -c:v libx264 -crf', crf, '-preset medium -c:a aac -b:a 160k -movflags +faststart', event_id || '_compressed.mp4')
 WHEN 'audio' THEN concat_ws(' ', 'ffmpeg -hide_banner -nostdin -progress pipe:1 -stats_period 0.25 -n -i', event_id || '.mov', '-vn -c:a libmp3lame -b:a 192k', event_id || '.mp3')
 WHEN 'standardize' THEN concat_ws(' ', 'ffmpeg -hide_banner -nostdin -progress pipe:1 -stats_period 0.25 -n -i', event_id || '.mov', '-map_metadata 0 -c:v libx264 -pix_fmt yuv420p -crf 20 -c:a aac -b:a 192k -movflags +faststart', event_id || '_standard.mp4') END AS command FROM m""")
def encoder_commands(spark: SparkSession, sf: str) -> DataFrame:
    """The commands of encoders, argument by argument; what only renames has none."""
    e = F.col("event_id")
    operation = F.get(F.array(*map(F.lit, ("compress", "audio", "standardize", "rename"))), (e % 4).cast("int"))
    media = table(spark, sf, "events").select("event_id", operation.alias("operation"), F.concat(e.cast("string"), F.lit(".mov")).alias("source_file"), e.alias("size"), F.lit(1.0).alias("duration_seconds"), F.lit("h264").alias("codec"), (18 + e % 10).alias("crf"), F.lit(0.3).alias("threshold"), F.lit(5).alias("max_frames"))
    return naming.previews(media).select("event_id", F.array_join("command", " ").alias("command"))
