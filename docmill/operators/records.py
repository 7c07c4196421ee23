"""Operators over records: job checks, duplicate risks, positional pairs, reports of tasks, recognised pages read back, previews as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions import records as R
from docmill.functions.lines import lines_of
from docmill.operators.documents import COSTS, _ISSUES_SQL, quality_issues
from docmill.registry import query, table


def job_errors(jobs: DataFrame) -> DataFrame:
    """jobs (source, sources, context_budget) with errors (codes, in the order of the checks) and input_sources, the primary one first."""
    sources = F.coalesce("sources", F.array().cast("array<string>"))
    error = lambda when, code: F.when(F.coalesce(when, F.lit(False)), F.lit(code))
    rest = F.slice(sources, 2, F.greatest(F.size(sources) - 1, F.lit(0)))
    codes = F.array(
        error(F.size(F.array_distinct(sources)) != F.size(sources), "duplicate_sources"),
        error(F.array_contains(rest, F.col("source")), "repeated_primary"),
        error(F.col("context_budget") <= 0, "budget_not_positive"),
    )
    whole = F.when(F.get(sources, 0) == F.col("source"), sources).otherwise(F.concat(F.array("source"), sources))
    return jobs.withColumn("errors", F.array_compact(codes)).withColumn("input_sources", whole)


@query("job_validation", """WITH j AS (SELECT o_orderkey, 'f' || o_custkey % 5 AS source, CASE o_orderkey % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['f' || o_custkey % 5, 'g'] WHEN 2 THEN ['g', 'f' || o_orderkey % 5] ELSE ['h', 'h'] END AS sources, o_orderkey % 3 - 1 AS budget FROM orders)
SELECT o_orderkey, concat_ws(',', CASE WHEN len(list_distinct(sources)) <> len(sources) THEN 'duplicate_sources' END, CASE WHEN list_contains(sources[2:], source) THEN 'repeated_primary' END, CASE WHEN budget <= 0 THEN 'budget_not_positive' END) AS errors,
 array_to_string(CASE WHEN len(sources) > 0 AND sources[1] = source THEN sources ELSE list_prepend(source, sources) END, ',') AS input_sources FROM j""")
def job_validation(spark: SparkSession, sf: str) -> DataFrame:
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    source = F.concat(F.lit("f"), (F.col("o_custkey") % 5).cast("string"))
    other = F.concat(F.lit("f"), (key % 5).cast("string"))
    sources = F.when(key % 4 == 0, F.array().cast("array<string>")).when(key % 4 == 1, F.array(source, F.lit("g"))).when(key % 4 == 2, F.array(F.lit("g"), other)).otherwise(F.array(F.lit("h"), F.lit("h")))
    jobs = o.select("o_orderkey", source.alias("source"), sources.alias("sources"), (key % 3 - 1).alias("context_budget"))
    return job_errors(jobs).select("o_orderkey", F.array_join("errors", ",").alias("errors"), F.array_join("input_sources", ",").alias("input_sources"))


def annotate_duplicates(previews: DataFrame, members: DataFrame, key: str = "path") -> DataFrame:
    """previews (key, risks) with the risk duplicate_material behind the risks of each that is a member of a duplicate group; ids alone are joined."""
    marked = members.select(key, F.lit(True).alias("_member")).distinct()
    risks = F.when(F.col("_member"), F.array_append("risks", F.lit("duplicate_material"))).otherwise(F.col("risks"))
    return previews.join(marked, key, "left").withColumn("risks", risks).drop("_member")


@query("duplicate_risks", """WITH m AS (SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 1)
SELECT doc_id, concat_ws(',', CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN doc_id IN (SELECT doc_id FROM m) THEN 'duplicate_material' END) AS risks FROM documents""")
def duplicate_risks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    digest = docs.filter("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    groups = digest.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    previews = docs.select("doc_id", F.array_compact(F.array(F.when(F.col("n_chars") < 200, "short"))).alias("risks"))
    return annotate_duplicates(previews, digest.join(groups, "h"), "doc_id").select("doc_id", F.array_join("risks", ",").alias("risks"))


def by_position(left: DataFrame, right: DataFrame, group: str, left_order: str, right_order: str) -> DataFrame:
    """The i-th row of left and the i-th of right in each group, side by side; what has no partner is null on the other side."""
    rank = lambda order: F.row_number().over(Window.partitionBy(group).orderBy(order))
    return left.withColumn("_i", rank(left_order)).join(right.withColumn("_i", rank(right_order)), [group, "_i"], "full").drop("_i")


def zipped(left: DataFrame, right: DataFrame, group: str, left_order: str, right_order: str) -> DataFrame:
    """by_position() for tables that must have as many rows: a row without partner is an error."""
    rows = by_position(left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True)), group, left_order, right_order)
    lone = F.col("_l").isNull() | F.col("_r").isNull()
    message = F.concat(F.lit("different numbers of rows in "), F.col(group).cast("string"))
    return rows.filter(F.when(lone, F.raise_error(message).cast("boolean")).otherwise(True)).drop("_l", "_r")


@query("source_paths", """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem),
p AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS i FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 3 > 0))
SELECT s.l_orderkey, i AS source_order, p.l_partkey AS path_part FROM s LEFT JOIN p USING (l_orderkey, i)""")
def source_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Sources by their order, each with the path at that place of the session's list; sources beyond the list have none."""
    items = table(spark, sf, "lineitem")
    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    sources = items.select("l_orderkey", order.alias("source_order"))
    paths = items.filter("l_orderkey % 3 > 0").select("l_orderkey", F.col("l_partkey").alias("path_part")).distinct()
    rows = by_position(sources, paths, "l_orderkey", "source_order", "path_part").filter("source_order is not null")
    return rows.select("l_orderkey", F.col("source_order").cast("long").alias("source_order"), "path_part")


def reports(tasks: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A row for each report of (task_id, reports), of the listed tasks only where ids are given."""
    chosen = tasks if ids is None else tasks.join(ids.select("task_id").distinct(), "task_id", "left_semi")
    return chosen.select("task_id", F.explode("reports").alias("report"))


@query("quality_reports", _ISSUES_SQL + """, r AS (SELECT lang AS task_id, d.doc_id, 100 - coalesce(sum(CASE severity WHEN 'error' THEN 25 WHEN 'warning' THEN 10 WHEN 'info' THEN 2 END), 0) AS score, count(i.code) FILTER (WHERE severity <> 'info') AS listed FROM documents d LEFT JOIN i USING (doc_id) WHERE d.lang IN ('en', 'fr') GROUP BY ALL)
SELECT task_id, doc_id, CAST(greatest(0, score) AS BIGINT) AS score, listed FROM r""")
def quality_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of some tasks: score, and the number of issues that a manifest lists (warnings and errors)."""
    docs = table(spark, sf, "documents").filter(F.col("lang").isin("en", "fr"))
    cost = F.coalesce(F.create_map(*[F.lit(x) for pair in COSTS.items() for x in pair])[F.col("severity")], F.lit(0))
    found = quality_issues(docs, 1000).groupBy("doc_id").agg(F.sum(cost).alias("cost"), F.count_if(listed(F.col("severity"))).alias("listed"))
    rows = docs.select("doc_id", F.col("lang").alias("task_id")).join(found, "doc_id", "left")
    report = F.struct("doc_id", F.greatest(F.lit(0), 100 - F.coalesce("cost", F.lit(0))).cast("long").alias("score"), F.coalesce("listed", F.lit(0)).cast("long").alias("listed"))
    tasks = rows.select("task_id", F.array(report).alias("reports"))
    return reports(tasks, docs.select(F.col("lang").alias("task_id"))).select("task_id", "report.*")


def listed(severity):
    """Whether a manifest lists an issue: warnings and errors."""
    return F.coalesce(severity.isin("warning", "error"), F.lit(False))


def recognised_pages(docs: DataFrame) -> DataFrame:
    """doc_id, page (from 1), label, confidence of the recognised pages that the headings of (doc_id, markdown) name."""
    heads = F.filter(lines_of(F.col("markdown")), lambda x: x.rlike(R.OCR_HEADING))
    rows = docs.select("doc_id", F.posexplode(heads).alias("i", "line"))
    part = lambda k: F.regexp_extract("line", R.OCR_HEADING, k)
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("page"), part(1).alias("label"), (part(2).cast("double") / 100).alias("confidence"))


@query("recognised_pages", """SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page, 'Page ' || turn AS label, CAST((turn * 37 + conv_id) % 1000 / 10.0 AS DOUBLE) / 100 AS confidence FROM conversations WHERE turn % 3 < 2""")
def recognised(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations whose turns are headings with a confidence; every third lacks the form."""
    tenth = F.format_string("%.1f", ((F.col("turn") * 37 + F.col("conv_id")) % 1000 / 10.0))
    head = F.concat(F.lit("### Page "), F.col("turn").cast("string"), F.lit("（平均置信度 "), tenth, F.lit("%）"))
    line = F.when(F.col("turn") % 3 < 2, head).otherwise(F.concat(F.lit("## "), head))
    turns = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("t"))
    return recognised_pages(turns.select("doc_id", F.array_join(F.transform("t", lambda x: x["line"]), "\n\ntext\n").alias("markdown")))


def preview_json(previews: DataFrame) -> DataFrame:
    """doc_id, preview: source, suffix, size, at most PREVIEW_CHARS of the cleaned text, risks with coerced levels, as JSON without nulls."""
    risks = F.transform("risks", lambda r: F.struct(r["code"].alias("code"), R.risk_level(r["level"]).alias("level")))
    fields = (F.col("name").alias("source"), F.col("suffix").alias("source_suffix"), F.col("bytes").alias("source_size"), F.substring("cleaned", 1, R.PREVIEW_CHARS).alias("cleaned_preview"), risks.alias("risks"))
    return previews.select("doc_id", F.to_json(F.struct(*fields)).alias("preview"))


@query("preview_records", """SELECT doc_id, 'd' || doc_id || '.md' AS source, n_chars AS source_size, sha256(left(text, 12000)) AS cleaned_sha256, CASE doc_id % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'error' ELSE 'warning' END AS level FROM documents WHERE text IS NOT NULL""")
def preview_records(spark: SparkSession, sf: str) -> DataFrame:
    """Previews written as JSON and read again."""
    level = F.when(F.col("doc_id") % 3 == 0, "info").when(F.col("doc_id") % 3 == 1, "error").otherwise("fatal")
    docs = table(spark, sf, "documents").filter("text is not null")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md"))
    risk = F.array(F.struct(F.lit("x").alias("code"), level.alias("level")))
    written = preview_json(docs.select("doc_id", name.alias("name"), F.lit(".md").alias("suffix"), F.col("n_chars").alias("bytes"), F.col("text").alias("cleaned"), risk.alias("risks")))
    read = written.select("doc_id", F.from_json("preview", "source string, source_size long, cleaned_preview string, risks array<struct<code:string,level:string>>").alias("p"))
    return read.select("doc_id", "p.source", "p.source_size", F.sha2("p.cleaned_preview", 256).alias("cleaned_sha256"), F.get("p.risks", 0)["level"].alias("level"))


@query("provenance_levels", """SELECT doc_id, coalesce(nullif((SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT DISTINCT unnest(kinds) AS k) WHERE k IS NOT NULL), ''), 'document') AS level,
 CASE WHEN regexp_matches(lang, '^e') THEN 'c.md' ELSE 'source-' || doc_id END AS name FROM (SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['slide', lang, 'slide'] WHEN 2 THEN [NULL, 'page'] ELSE ['page', 'ocr', 'page'] END AS kinds FROM documents WHERE lang IS NOT NULL)""")
def provenance_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The level of a source from the kinds of its spans, and its bare display name."""
    k = F.col("doc_id") % 4
    kinds = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("slide"), F.col("lang"), F.lit("slide"))).when(k == 2, F.array(F.lit(None).cast("string"), F.lit("page"))).otherwise(F.array(*map(F.lit, ("page", "ocr", "page"))))
    shown = F.when(F.col("lang").startswith("e"), F.lit(" C:\\a/b\\c.md ")).otherwise(F.lit("a\\b/"))
    return table(spark, sf, "documents").filter("lang is not null").select("doc_id", R.provenance_level(kinds).alias("level"), R.base_name(shown, F.concat(F.lit("source-"), F.col("doc_id").cast("string"))).alias("name"))


_PATHS = ("packs/{0}.md", "packs\\{0}.MD", "./packs//{0}.md", "packs/{0}.txt", "/packs/{0}.md", "packs/a/{0}.md", "../packs/{0}.md", "Packs/{0}.md")
_IDS = ("source-{0}", "../{0}", "a/../{0}", "/{0}", "", "..x{0}", "a\\..\\{0}", "C:{0}")


@query("contained_paths", """SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 'packs/' || s_suppkey || '.md' WHEN 1 THEN 'packs/' || s_suppkey || '.MD' WHEN 2 THEN 'packs/' || s_suppkey || '.md' END AS pack_path,
 CASE s_suppkey % 8 WHEN 0 THEN 'sources/source-' || s_suppkey || '/content.md' WHEN 5 THEN 'sources/..x' || s_suppkey || '/content.md' END AS content_path FROM supplier""")
def contained_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths that manifests name: those that stay in the pack, nulls for the others."""
    key = F.col("s_suppkey")
    made = lambda forms: F.replace(F.element_at(F.array(*map(F.lit, forms)), (key % 8 + 1).cast("int")), F.lit("{0}"), key.cast("string"))
    return table(spark, sf, "supplier").select("s_suppkey", R.pack_path(made(_PATHS)).alias("pack_path"), R.content_path(made(_IDS)).alias("content_path"))


@query("resolved_tools", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'o' || c_nationkey WHEN c_custkey % 3 = 0 THEN 'b9' WHEN c_custkey % 5 = 0 THEN 'p' END AS path, CASE WHEN c_custkey % 2 = 0 THEN 'override' WHEN c_custkey % 3 = 0 THEN 'bundled' WHEN c_custkey % 5 = 0 THEN 'path' END AS source,
 CASE c_custkey % 6 WHEN 0 THEN 2.5 WHEN 4 THEN 0.25 ELSE 0 END::DOUBLE AS seconds, c_custkey % 4 < 2 AS sheet FROM customer""")
def resolved_tools(spark: SparkSession, sf: str) -> DataFrame:
    """Where each tool comes from, what a probe printed as seconds, and which outputs are contact sheets."""
    k = F.col("c_custkey")
    override = F.when(k % 2 == 0, F.concat(F.lit("o"), F.col("c_nationkey").cast("string"))).otherwise("")
    bundled = F.when(k % 3 == 0, F.array(F.lit("b1"), F.lit("b9"), F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    printed = F.element_at(F.array(F.lit(" 2.5\n"), F.lit("N/A"), F.lit("-3"), F.lit(""), F.lit(".25"), F.lit(None)), (k % 6 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, ("contact-sheet.jpg", "Contact-Sheet.JPG", "contact-sheet.png", "x"))), (k % 4 + 1).cast("int"))
    tool = R.resolved_tool(override, bundled, F.when(k % 5 == 0, "p"))
    rows = table(spark, sf, "customer").select("c_custkey", tool.alias("tool"), R.duration_of(F.regexp_replace(printed, r"\s", "")).alias("seconds"), R.is_contact_sheet(name).alias("sheet"))
    return rows.select("c_custkey", "tool.path", "tool.source", "seconds", "sheet")


STATUSES = ("waiting", "running", "success", "failed", "cancelled", "interrupted")  # fixed values, in their order


@query("task_records", """WITH e AS (SELECT user_id, list(DISTINCT CASE event_id % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'success' ELSE event_type END) AS statuses, min(event_id) AS first_id FROM events GROUP BY user_id)
SELECT user_id, concat_ws(',', CASE WHEN list_contains(statuses, 'success') THEN 'success' END, CASE WHEN list_contains(statuses, 'failed') THEN 'failed' END) AS statuses,
 CASE first_id % 3 WHEN 0 THEN 'audio_bitrate=128k' WHEN 1 THEN 'mode=x' ELSE 'output_type=pdf' END AS parameters, CASE first_id % 3 WHEN 0 THEN 'ffmpeg' WHEN 1 THEN 'rapidocr' ELSE '' END AS tools, CASE first_id % 4 WHEN 0 THEN 'over budget' WHEN 1 THEN 'why' WHEN 2 THEN 'what' ELSE 'odd' END AS warning FROM e""")
def task_records(spark: SparkSession, sf: str) -> DataFrame:
    """Statuses of a user's tasks in their order, and what the first one records: its options, tools and warning."""
    status = F.when(F.col("event_id") % 3 == 0, "failed").when(F.col("event_id") % 3 == 1, "success").otherwise(F.col("event_type"))
    e = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set(status).alias("statuses"), F.min("event_id").alias("id"))
    operation = F.element_at(F.array(*map(F.lit, ("EXTRACT_AUDIO", "TO_MARKDOWN", "TO_PDF"))), (F.col("id") % 3 + 1).cast("int"))
    options = F.create_map(*map(F.lit, ("audio_bitrate", "128k", "mode", "x", "output_type", "pdf", "project_name", "p")))
    versions = F.create_map(*map(F.lit, ("ffmpeg", "7", "rapidocr", "1", "libreoffice", "", "other", "2")))
    pairs = lambda m: F.array_join(F.transform(F.map_entries(m), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    k = F.col("id") % 4
    code = F.when(k == 0, "context_pack_over_budget").otherwise("odd")
    warning = R.warning_text(code, F.when(k == 1, "why").otherwise(""), F.when(k == 2, "what"), {"context_pack_over_budget": "over budget"})
    return e.select("user_id", R.in_order(F.col("statuses"), STATUSES).alias("statuses"), pairs(R.task_parameters(operation, options)).alias("parameters"), F.array_join(F.map_keys(R.task_tools(operation, versions)), ",").alias("tools"), warning.alias("warning"))


def newest_first(history: DataFrame, most: int | None = None) -> DataFrame:
    """history (task_id, created_at) from the newest to the oldest, equal times by id; the most newest only where given (a top-k, not a sort of all)."""
    rows = history.orderBy(F.desc("created_at"), "task_id")
    return rows if most is None else rows.limit(most)


def details(history: DataFrame, task_id: str) -> DataFrame:
    """The newest record of a task, with its manifest parsed as far as it is an object; no row for an unknown id."""
    rows = history.filter(F.col("task_id") == task_id).orderBy(F.desc("created_at")).limit(1)
    return rows.withColumn("manifest", F.try_parse_json("manifest")) if "manifest" in history.columns else rows


def known_ids(recovered: DataFrame, enqueued: DataFrame) -> DataFrame:
    """Recovered and enqueued task ids, each once."""
    return recovered.select("task_id").unionByName(enqueued.select("task_id")).distinct()


def all_warnings(sources: DataFrame, budget: DataFrame) -> DataFrame:
    """pack_job, warnings: those of the sources (source_order, warnings) in their order, then those of the budget (pack, warning) in the order of the packs."""
    of_sources = sources.select("pack_job", F.lit(0).alias("kind"), F.col("source_order").alias("place"), F.posexplode("warnings").alias("i", "warning"))
    of_packs = budget.select("pack_job", F.lit(1).alias("kind"), F.col("pack").alias("place"), F.lit(0).alias("i"), "warning")
    rows = of_sources.unionByName(of_packs).groupBy("pack_job").agg(F.array_sort(F.collect_list(F.struct("kind", "place", "i", "warning"))).alias("w"))
    return rows.select("pack_job", F.transform("w", lambda x: x["warning"]).alias("warnings"))


def in_workspace(history: DataFrame, operations: tuple[str, ...]) -> DataFrame:
    """The history entries (operations: array) that share an operation with the workspace."""
    return history.filter(F.arrays_overlap("operations", F.array(*map(F.lit, operations))))


@query("history_of_workspace", """WITH h AS (SELECT user_id AS task_id, max(ts) AS created_at, list_sort(list(DISTINCT event_type)) AS operations FROM events WHERE event_id % 7 < 2 GROUP BY user_id)
SELECT task_id, array_to_string(operations, ',') AS operations, len(list_intersect(operations, ['click', 'view', 'purchase'])) = len(operations) AS only_these FROM h WHERE list_has_any(operations, ['click', 'purchase']) ORDER BY created_at DESC, task_id LIMIT 40""")
def history_of_workspace(spark: SparkSession, sf: str) -> DataFrame:
    """The newest 40 entries of a workspace (the feature is a top-k report), and whether they have its operations only."""
    e = table(spark, sf, "events").filter("event_id % 7 < 2").groupBy(F.col("user_id").alias("task_id")).agg(F.max("ts").alias("created_at"), F.array_sort(F.collect_set("event_type")).alias("operations"))
    rows = newest_first(in_workspace(e, ("click", "purchase")), 40)
    return rows.select("task_id", F.array_join("operations", ",").alias("operations"), R.is_subset(F.col("operations"), F.array(*map(F.lit, ("click", "view", "purchase")))).alias("only_these"))
