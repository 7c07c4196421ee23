"""Document operators: token estimates, quality issues and scores, sentences, lines, spans, headings, tables, blocks, packs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.functions.text import PRIVATE_PATH_SQL, TOKEN_SQL, line_form, private_path, redact, token_estimate
from docmill.plans.next_fit import numbered, place
from docmill.plans.stored import stored
from docmill.registry import query, table

SOFT_TARGET = 0.95
COSTS = {"error": 25, "warning": 10, "info": 2}  # of an issue; any other: 5


@query("token_estimate", f"SELECT doc_id, {TOKEN_SQL} AS estimated_tokens FROM documents")
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", token_estimate(F.col("text")).alias("estimated_tokens"))


@query("token_totals_by_lang", f"SELECT lang, source, count(*) AS n_docs, CAST(sum({TOKEN_SQL}) AS BIGINT) AS total_tokens, max({TOKEN_SQL}) AS most_tokens FROM documents GROUP BY lang, source")
def token_totals(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "documents").select("lang", "source", token_estimate(F.col("text")).alias("t"))
    return df.groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.sum("t").alias("total_tokens"), F.max("t").alias("most_tokens"))


def issues_within(docs: DataFrame, max_tokens: int) -> DataFrame:
    """doc_id, issues (array of code, severity): rules on whole texts, each row by itself; the token estimate is made once a row."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    fences = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"^\s*(```|~~~)")))
    facts = F.struct(token_estimate(F.col("text")).alias("t"), blank.alias("blank"), fences.alias("fences"))
    d = docs.select("doc_id", "text", F.inline(F.array(facts)))  # a generator of one row keeps the estimate from being copied into each rule
    issue = lambda when, code, severity: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    found = F.array(
        issue(F.col("blank"), "empty_document", "error"),
        issue(~F.col("blank") & (F.col("t") < 10), "very_short", "warning"),
        issue(F.col("fences") % 2 == 1, "unclosed_code_fence", "error"),
        issue(F.col("t") > max_tokens, "oversized_document", "warning"),
        issue(F.col("text").rlike(r"\$\$|\$[^$\n]+\$"), "formula", "info"),
        issue(F.col("text").rlike(r"(?m)^\|.*\|\s*$"), "table_layout", "info"),
    )
    return d.select("doc_id", F.array_compact(found).alias("issues"))


def quality_issues(docs: DataFrame, max_tokens: int) -> DataFrame:
    """doc_id, code, severity: one scan."""
    return issues_within(docs, max_tokens).select("doc_id", F.inline("issues"))


_ISSUES_SQL = rf"""
WITH d AS (SELECT doc_id, text, trim(coalesce(text, '')) = '' AS blank, {TOKEN_SQL} AS t FROM documents),
i AS (
 SELECT doc_id, 'empty_document' AS code, 'error' AS severity FROM d WHERE blank
 UNION ALL SELECT doc_id, 'very_short', 'warning' FROM d WHERE NOT blank AND t < 10
 UNION ALL SELECT doc_id, 'unclosed_code_fence', 'error' FROM d WHERE len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '^\s*(```|~~~)'))) % 2 = 1
 UNION ALL SELECT doc_id, 'oversized_document', 'warning' FROM d WHERE t > 1000
 UNION ALL SELECT doc_id, 'formula', 'info' FROM d WHERE regexp_matches(text, '\$\$|\$[^$\n]+\$')
 UNION ALL SELECT doc_id, 'table_layout', 'info' FROM d WHERE regexp_matches(text, '(?m)^\|.*\|\s*$'))"""


@query("quality_issues_plain", _ISSUES_SQL + " SELECT * FROM i")
def issues(spark: SparkSession, sf: str) -> DataFrame:
    return quality_issues(table(spark, sf, "documents"), 1000)


@query("quality_score", _ISSUES_SQL + " SELECT d.doc_id, CAST(greatest(0, 100 - coalesce(sum(CASE severity WHEN 'error' THEN 25 WHEN 'warning' THEN 10 WHEN 'info' THEN 2 END), 0)) AS BIGINT) AS score, count(i.code) AS n_issues FROM d LEFT JOIN i USING (doc_id) GROUP BY d.doc_id")
def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    """The costs of a row's own issues: no join, no shuffle."""
    cost = lambda severity: reduce(lambda c, k: F.when(severity == k[0], k[1]).otherwise(c), COSTS.items(), F.lit(5))
    total = F.aggregate("issues", F.lit(0), lambda a, x: a + cost(x["severity"]))
    return issues_within(table(spark, sf, "documents"), 1000).select("doc_id", F.greatest(F.lit(0), 100 - total).cast("long").alias("score"), F.size("issues").cast("long").alias("n_issues"))


@query("preserve_issues", _ISSUES_SQL + " SELECT doc_id, code, severity FROM i WHERE code IN ('very_short', 'formula') AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = i.doc_id AND l.quality = 1)")
def preserve(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of some codes that the second table does not hold: an anti join, null-safe on the id."""
    held = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("held"))
    rows = quality_issues(table(spark, sf, "documents"), 1000).filter(F.col("code").isin("very_short", "formula"))
    return rows.join(held, F.col("doc_id").eqNullSafe(F.col("held")), "left_anti")


@query(
    "sentence_blocks_plain",
    r"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '[^。！？.!?]*[。！？.!?]|[^。！？.!?]+') AS a FROM documents),
s AS (SELECT doc_id, unnest(list_filter(list_transform(a, lambda x: ltrim(x, E' \n\t\r')), lambda x: x <> '')) AS block FROM p)
SELECT doc_id, count(*) AS n_blocks, sum(length(block))::BIGINT AS n_chars, max(length(block))::BIGINT AS longest FROM s GROUP BY doc_id""",
)
def sentences(spark: SparkSession, sf: str) -> DataFrame:
    pieces = F.transform(F.regexp_extract_all("text", F.lit("[^。！？.!?]*[。！？.!?]|[^。！？.!?]+"), F.lit(0)), lambda x: F.regexp_replace(x, r"^[ \n\t\r]+", ""))
    rows = table(spark, sf, "documents").select("doc_id", F.explode(F.filter(pieces, lambda x: x != "")).alias("block"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("block")).alias("n_chars"), F.max(F.length("block")).cast("long").alias("longest"))


@query(
    "exact_duplicates",
    "SELECT sha256(text) AS sha256, n_chars, lang, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
)
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of equal digest, length and language with more than one member."""
    df = table(spark, sf, "documents").filter("text is not null").select(F.sha2("text", 256).alias("sha256"), "n_chars", "lang", "doc_id")
    return df.groupBy("sha256", "n_chars", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).filter("n > 1")


@query("duplicate_members", "SELECT doc_id, count(*) OVER (PARTITION BY sha256(text), lang) > 1 AS duplicate FROM documents WHERE text IS NOT NULL")
def duplicate_members(spark: SparkSession, sf: str) -> DataFrame:
    """The documents marked that are in a duplicate group: a join with the groups, so that no group meets in one task."""
    df = table(spark, sf, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("h"), "lang")
    groups = df.groupBy("h", "lang").agg(F.count("*").alias("n")).filter("n > 1")
    return df.join(groups, df.h.eqNullSafe(groups.h) & df.lang.eqNullSafe(groups.lang), "left").select("doc_id", F.col("n").isNotNull().alias("duplicate"))


# --- pages: a conversation is a document, a turn a page ------------------------------------------------------------------------------------------


def page_lines(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, page, line_no, line of conversations as paged Markdown: marker, heading, footer, text."""
    level = 1 + F.col("turn") * 2 % 5
    lines = F.array(F.format_string("<!-- Page: %d -->", F.col("turn") + 1), F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), F.col("role")), F.concat(F.lit("Page "), (F.col("turn") + 1).cast("string"), F.lit(" of the transcript")), F.col("text"))
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), F.posexplode(lines).alias("pos", "line"))
    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "pos")).cast("long")).drop("pos")


_LINES_SQL = """
WITH parts AS (SELECT conv_id AS doc_id, turn + 1 AS page, unnest([0, 1, 2, 3]) AS pos,
 unnest(['<!-- Page: ' || (turn + 1) || ' -->', repeat('#', CAST(1 + turn * 2 % 5 AS INT)) || ' ' || role, 'Page ' || (turn + 1) || ' of the transcript', text]) AS line FROM conversations),
lines AS (SELECT doc_id, page, line, row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) AS line_no FROM parts)"""


@query("provenance_spans", _LINES_SQL + ", m AS (SELECT doc_id, page, line_no FROM lines WHERE regexp_matches(line, '^<!-- Page: [0-9]+ -->$')), n AS (SELECT doc_id, max(line_no) AS n FROM lines GROUP BY doc_id) SELECT doc_id, page, line_no AS start_line, coalesce(lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) - 1, greatest(line_no, n)) AS end_line FROM m JOIN n USING (doc_id)")
def spans(spark: SparkSession, sf: str) -> DataFrame:
    """A span from each marker to the line before the next one."""
    lines = page_lines(spark, sf)
    end = F.max("line_no").over(Window.partitionBy("doc_id"))
    marks = lines.withColumn("n", end).filter(F.col("line").rlike("^<!-- Page: [0-9]+ -->$"))
    after = F.lead("line_no").over(Window.partitionBy("doc_id").orderBy("line_no")) - 1
    return marks.select("doc_id", "page", F.col("line_no").alias("start_line"), F.coalesce(after, F.greatest("line_no", "n")).alias("end_line"))


_HEADS_SQL = _LINES_SQL + ", h AS (SELECT doc_id, line_no, CAST(length(regexp_extract(line, '^(#{1,6}) ', 1)) AS BIGINT) AS level, regexp_extract(line, '^#{1,6} (.*)$', 1) AS title, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM lines WHERE regexp_matches(line, '^#{1,6} '))"


@query("heading_outline", _HEADS_SQL + " SELECT doc_id, line_no, level, title, coalesce(level > lag(level) OVER (PARTITION BY doc_id ORDER BY i) + 1, false) AS jump, CAST(least(level, i + min(level - i) OVER (PARTITION BY doc_id ORDER BY i)) AS BIGINT) AS clamped FROM h")
def headings(spark: SparkSession, sf: str) -> DataFrame:
    """Headings with level, jump (more than one level below the heading before) and the level after clamping, in closed form."""
    h = page_lines(spark, sf).filter(F.col("line").rlike("^#{1,6} "))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    h = h.select("doc_id", "line_no", F.length(F.regexp_extract("line", "^(#{1,6}) ", 1)).cast("long").alias("level"), F.regexp_extract("line", "^#{1,6} (.*)$", 1).alias("title")).withColumn("i", F.row_number().over(w))
    clamped = F.least("level", F.col("i") + F.min(F.col("level") - F.col("i")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return h.select("doc_id", "line_no", "level", "title", F.coalesce(F.col("level") > F.lag("level").over(w) + 1, F.lit(False)).alias("jump"), clamped.cast("long").alias("clamped"))


@query("repeated_page_lines", _LINES_SQL + r""", f AS (SELECT DISTINCT doc_id, page, regexp_replace(regexp_replace(trim(line), '\s+', ' ', 'g'), '[0-9]+', '<num>', 'g') AS form FROM lines WHERE trim(line) <> '' AND length(trim(line)) <= 160 AND NOT regexp_matches(trim(line), '^(#|<!--|\||```|~~~|---$)')),
p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM lines GROUP BY doc_id)
SELECT doc_id, form, count(*) AS n_pages FROM f JOIN p USING (doc_id) WHERE pages >= 3 GROUP BY doc_id, form, pages HAVING count(*) >= greatest(3, ceil(0.6 * pages))""")
def repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that stand, digits aside, on at least three pages and on six tenths of a document's pages."""
    lines = page_lines(spark, sf)
    bare = F.trim("line")
    forms = lines.filter((bare != "") & (F.length(bare) <= 160) & ~bare.rlike(r"^(#|<!--|\||```|~~~|---$)")).select("doc_id", "page", line_form(F.col("line")).alias("form")).distinct()
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("pages")).filter("pages >= 3")
    counts = forms.groupBy("doc_id", "form").agg(F.count("*").alias("n_pages"))
    return counts.join(pages, "doc_id").filter(F.col("n_pages") >= F.greatest(F.lit(3), F.ceil(0.6 * F.col("pages")))).select("doc_id", "form", "n_pages")


@query("table_consistency", "WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 THEN 3 ELSE 4 END AS cells FROM lineitem), f AS (SELECT *, first_value(cells) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS want FROM r) SELECT l_orderkey, count(*) AS n_rows, count(*) FILTER (WHERE cells <> want) AS malformed FROM f GROUP BY l_orderkey")
def tables(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a table, one table an order, whose number of cells is not that of its first row."""
    cell = F.when(F.col("l_linenumber") % 5 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")))
    row = F.concat(F.lit("| "), F.array_join(cell, " | "), F.lit(" |"))
    cells = F.size(F.split(F.regexp_replace(row, r"^\||\|$", ""), r"\|"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", cells.alias("cells"))
    rows = rows.withColumn("want", F.first("cells").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n_rows"), F.count_if(F.col("cells") != F.col("want")).alias("malformed"))


@query("block_ids", "SELECT doc_id, source, format('{}-block-{:04d}', source, row_number() OVER (PARTITION BY source ORDER BY doc_id)) AS block_id, sha256(coalesce(text, '')) AS sha256 FROM documents")
def block_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids by the dense number of a block within its source; sources are numbered in spans, so none meets in one task."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.coalesce("source", F.lit(_NO_SOURCE)).alias("job"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("major"), F.lit(0).alias("minor"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return numbered(docs).select("doc_id", "source", F.concat(F.col("source"), F.format_string("-block-%04d", F.col("n") + 1)).alias("block_id"), "sha256")


_NO_SOURCE, _NO_ID = "\0", -(1 << 62)  # stand for null, which would not join


def next_fit(blocks: DataFrame, budget: int) -> DataFrame:
    """doc_id, source, tokens, pack: blocks of a job in order, a new pack where the soft target would be passed. A source may hold any share of the rows."""
    rows = blocks.select(F.coalesce("source", F.lit(_NO_SOURCE)).alias("job"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("major"), F.col("tokens").alias("minor"), F.col("tokens").alias("full"), F.col("tokens").alias("rest"))
    placed = place(rows, int(budget * SOFT_TARGET))
    return placed.select(F.nullif("major", F.lit(_NO_ID)).alias("doc_id"), F.nullif("job", F.lit(_NO_SOURCE)).alias("source"), F.col("minor").alias("tokens"), "pack")


_PACK_SQL = f"""
WITH RECURSIVE b AS (SELECT doc_id, source, {TOKEN_SQL} AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
p AS (SELECT doc_id, source, tokens, i, tokens AS used, CAST(1 AS BIGINT) AS pack FROM b WHERE i = 1
 UNION ALL SELECT b.doc_id, b.source, b.tokens, b.i, CASE WHEN p.used + b.tokens > 1900 THEN b.tokens ELSE p.used + b.tokens END, CASE WHEN p.used + b.tokens > 1900 THEN p.pack + 1 ELSE p.pack END
 FROM p JOIN b ON b.source = p.source AND b.i = p.i + 1)"""


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", token_estimate(F.col("text")).alias("tokens"))


@query("pack_assignment", _PACK_SQL + " SELECT doc_id, source, tokens, pack FROM p")
def pack_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return next_fit(_blocks(spark, sf), 2000)


@query("pack_report", _PACK_SQL + ", k AS (SELECT source, pack, count(*) AS n, sum(tokens) AS t FROM p GROUP BY source, pack) SELECT source, count(*) AS n_packs, CAST(sum(n) AS BIGINT) AS n_blocks, CAST(sum(t) AS BIGINT) AS total_tokens, count(*) FILTER (WHERE t > 2000) AS over_budget, CASE WHEN count(*) FILTER (WHERE t > 2000) > 0 THEN 'over_budget' ELSE 'within_budget' END AS status FROM k GROUP BY source")
def pack_report(spark: SparkSession, sf: str) -> DataFrame:
    packs = next_fit(_blocks(spark, sf), 2000).groupBy("source", "pack").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    over = F.count_if(F.col("t") > 2000)
    return packs.groupBy("source").agg(F.count("*").alias("n_packs"), F.sum("n").alias("n_blocks"), F.sum("t").alias("total_tokens"), over.alias("over_budget"), F.when(over > 0, "over_budget").otherwise("within_budget").alias("status"))


@query("pack_integrity", """WITH b AS (SELECT doc_id, CASE WHEN doc_id % 29 = 3 THEN 0 WHEN doc_id % 31 = 4 THEN 2 ELSE 1 END AS n FROM documents)
SELECT count(*) AS expected, CAST(sum(n) AS BIGINT) AS packed, count(*) FILTER (WHERE n = 0) AS missing, count(*) FILTER (WHERE n = 2) AS duplicates, count(*) FILTER (WHERE n <> 1) = 0 AS complete FROM b""")
def pack_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of expected and packed blocks, of missing and of repeated ones, for packs that lost some blocks and got some twice."""
    docs = _blocks(spark, sf)
    placed = stored(next_fit(docs, 2000), "placed").filter("doc_id % 29 <> 3")
    return integrity_counts(docs, placed.unionByName(placed.filter("doc_id % 31 = 4")))


def integrity_counts(blocks: DataFrame, placed: DataFrame) -> DataFrame:
    """expected, packed, missing, duplicates, complete: one row for blocks and placed (doc_id; a block may be placed more than once)."""
    packed = placed.groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = blocks.groupBy("doc_id").agg(F.count("*").alias("want")).join(packed, "doc_id", "full")
    total = rows.agg(F.coalesce(F.sum("want"), F.lit(0)).alias("expected"), F.coalesce(F.sum("n"), F.lit(0)).alias("packed"), F.count_if(F.col("n").isNull()).alias("missing"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    return total.withColumn("complete", (F.col("missing") == 0) & (F.col("duplicates") == 0))


@query("private_path_scan", rf"""WITH t AS (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN coalesce(text, '') || ' see /HOME/user' || doc_id || '/notes.md) and "C:\temp\x"' WHEN 3 THEN coalesce(text, '') || ' (file:///C:/a%20b) [\\srv\d] /home/ /homes/x C:' ELSE coalesce(text, '') END AS s FROM documents)
SELECT doc_id, regexp_matches(s, '{PRIVATE_PATH_SQL}') AS private, sha256(regexp_replace(s, '{PRIVATE_PATH_SQL}', '[local path omitted]', 'g')) AS redacted_sha256 FROM t""")
def private_paths(spark: SparkSession, sf: str) -> DataFrame:
    s = F.coalesce("text", F.lit(""))
    home = F.concat(s, F.lit(" see /HOME/user"), F.col("doc_id").cast("string"), F.lit('/notes.md) and "C:\\temp\\x"'))
    s = F.when(F.col("doc_id") % 10 == 0, home).when(F.col("doc_id") % 10 == 3, F.concat(s, F.lit(" (file:///C:/a%20b) [\\\\srv\\d] /home/ /homes/x C:"))).otherwise(s)
    return table(spark, sf, "documents").select("doc_id", s.alias("s")).select("doc_id", private_path(F.col("s")).alias("private"), F.sha2(redact(F.col("s")), 256).alias("redacted_sha256"))
