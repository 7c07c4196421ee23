"""Previews of documents before they are packaged: what cleaning, splitting and recognition would give, with quality and risks, as one record each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import records as R
from docmill.functions.lines import lines_of
from docmill.functions.provenance import with_spans
from docmill.functions.text import TOKEN_SQL, token_estimate
from docmill.operators import rules
from docmill.operators.chunks import MOST, TARGET, split_documents
from docmill.operators.document_packages import _CUSTOMERS, cleaned_documents, customer_documents, issues_of
from docmill.operators.documents import COSTS
from docmill.plans.stored import stored
from docmill.registry import query

LOW = 0.75
# The form of a heading, and what readers are told of each risk.
HEADING = r"^(#{1,6})\s+(.+?)\s*$"
RISKS = (
    ("table_layout", "info", r"(?m)^\s*\|.+\|\s*$", "检测到 Markdown 表格；复杂合并单元格可能需要人工核对。"),
    ("formula", "info", r"(?s)\$\$.+?\$\$|(?<!\$)\$[^\n$]+\$", "检测到公式；请核对源文档中的公式是否完整保留。"),
    ("code_block", "info", r"(?m)^```", "检测到代码块；拆分时会将完整代码块作为一个结构单元。"),
)
LOW_PAGES, AND = "OCR 低置信度页面：%s。", "、"


def document_previews(docs: DataFrame, target: int = TARGET, most: int = MOST, split: bool = True) -> DataFrame:
    """doc_id, preview of docs (see document_packages.cleaned_documents; and any of bytes, parameters): source, score, counts, issues, size, suffix, the start of
    the cleaned text, headings, chunks, recognised pages, risks and parameters. Documents are cleaned once; the score counts the issues that cleaning mended."""
    given = {"bytes": F.lit(None).cast("long"), "parameters": F.create_map().cast("map<string,string>")}
    extra = docs.select("doc_id", *[(F.coalesce(F.col(c), other) if c in docs.columns else other).alias(c) for c, other in given.items()])
    d = stored(with_spans(cleaned_documents(docs), "content"), "previewed")
    tokens = token_estimate(F.col("content"))
    cost = F.try_element_at(F.create_map(*[F.lit(x) for pair in COSTS.items() for x in pair]), F.col("severity"))
    found = issues_of(d, most)
    issue = F.struct("code", "severity", rules.message(F.col("code"), F.col("label"), F.col("tokens"), most).alias("message"), "line", F.col("label").alias("source_label"))
    by_doc = found.groupBy("doc_id").agg(F.sum(F.coalesce(cost, F.lit(5))).alias("cost"), F.array_sort(F.collect_list(F.struct("rule_no", F.coalesce("line", F.lit(0)).alias("at"), issue.alias("issue")))).alias("found"))
    rows = d.join(by_doc, "doc_id", "left").join(extra, "doc_id", "left")
    if split:
        chunks = split_documents(d.select("doc_id", F.col("content").alias("markdown"), "spans"), target, most)
        listed = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("chunk").alias("index"), "title", "estimated_tokens"))).alias("chunks"))
        rows = rows.join(listed, "doc_id", "left")
    else:
        rows = rows.withColumn("chunks", F.lit(None).cast("array<struct<index:bigint,title:string,estimated_tokens:bigint>>"))
    ls = lines_of(F.col("content"))
    headings = F.filter(F.transform(ls, lambda x, i: F.struct(F.length(F.regexp_extract(x, HEADING, 1)).alias("level"), F.regexp_extract(x, HEADING, 2).alias("title"), (i + 1).alias("line"))), lambda h: h["level"] > 0)
    issues = F.coalesce(F.transform("found", lambda x: x["issue"]), F.array().cast("array<struct<code:string,severity:string,message:string,line:int,source_label:string>>"))
    risk = lambda code, level, text, line, label: F.struct(code.alias("code"), level.alias("level"), text.alias("message"), line.alias("line"), label.alias("source_label"))
    nothing, no_line = F.lit(""), F.lit(None).cast("int")
    low = F.transform(F.filter("pages", lambda p: p["confidence"] < LOW), lambda p: p["label"])
    flags = [F.when(F.col("content").rlike(pattern), risk(F.lit(code), F.lit(level), F.lit(text), no_line, nothing)) for code, level, pattern, text in RISKS]
    flags.append(F.when(F.size(low) > 0, risk(F.lit("low_ocr_confidence"), F.lit("warning"), F.format_string(LOW_PAGES, F.array_join(low, AND)), no_line, nothing)))
    risks = F.concat(F.transform(issues, lambda i: risk(i["code"], R.risk_level(i["severity"]), i["message"], i["line"], i["source_label"])), F.array_compact(F.array(*flags)))
    pages = F.transform("pages", lambda p: F.struct(p["label"].alias("label"), p["confidence"].alias("confidence"), (p["confidence"] < LOW).alias("low_confidence")))
    images = F.regexp_count("content", F.lit(rules.IMAGE))
    record = F.struct(
        F.col("name").alias("source"), F.greatest(F.lit(0), 100 - F.coalesce("cost", F.lit(0))).alias("score"), tokens.alias("estimated_tokens"), F.size(headings).alias("heading_count"), images.alias("image_count"), issues.alias("issues"),
        F.col("bytes").alias("source_size"), F.lower("suffix").alias("source_suffix"), F.substring("content", 1, R.PREVIEW_CHARS).alias("cleaned_preview"), headings.alias("headings"),
        F.coalesce("chunks", F.array().cast("array<struct<index:bigint,title:string,estimated_tokens:bigint>>")).alias("chunks"), pages.alias("ocr_pages"), risks.alias("risks"), F.col("parameters"),
    )
    return rows.select("doc_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("preview"))


_READ = "source string, score long, estimated_tokens long, heading_count long, image_count long, issues array<struct<code:string,severity:string,message:string,line:int,source_label:string>>, source_size long, source_suffix string, cleaned_preview string, headings array<struct<level:int,title:string,line:int>>, chunks array<struct<index:long,title:string,estimated_tokens:long>>, ocr_pages array<struct<label:string,confidence:double,low_confidence:boolean>>, risks array<struct<code:string,level:string,message:string,line:int,source_label:string>>, parameters map<string,string>"


def _tokens(expression: str) -> str:
    return TOKEN_SQL.replace("coalesce(text, '')", expression)


@query("document_previews", _CUSTOMERS + f""", x AS (SELECT *, doc_id % 2 = 0 AS low, concat_ws(chr(10) || chr(10), title, '## Deep', '<!', '-- Page: 7 -->', trim(a)) || chr(10) AS c1, concat_ws(chr(10) || chr(10), title, '## Second: part', trim(z)) || chr(10) AS c2 FROM t)
SELECT doc_id, 'c' || doc_id || '.Docx' AS source, CAST(90 AS BIGINT) AS score, {_tokens("content")} AS estimated_tokens, CAST(CASE WHEN two THEN 3 ELSE 2 END AS BIGINT) AS heading_count, CAST(0 AS BIGINT) AS image_count, 'heading_jump:warning:{rules.MESSAGES["heading_jump"]}:5:' AS issues,
 doc_id * 10 AS source_size, '.docx' AS source_suffix, sha256(content) AS cleaned, '1:Customer ' || doc_id || ':1,2:Deep:3' || CASE WHEN two THEN ',2:Second: part:7' ELSE '' END AS headings,
 '1:Deep:' || {_tokens("c1")} || CASE WHEN two THEN ',2:Second: part:' || {_tokens("c2")} ELSE '' END AS chunks, 'p:' || CASE WHEN low THEN '0.5:true' ELSE '0.75:false' END AS pages,
 'heading_jump:warning' || CASE WHEN low THEN ',low_ocr_confidence:warning:OCR 低置信度页面：p。' ELSE '' END AS risks, 'k=' || doc_id AS parameters FROM x""")
def previews(spark: SparkSession, sf: str) -> DataFrame:
    """Previews of customers as documents, written as JSON and read again: every key of the record."""
    k = F.col("doc_id")
    page = F.struct(F.lit("p").alias("label"), F.lit("t").alias("text"), F.when(k % 2 == 0, 0.5).otherwise(0.75).alias("confidence"))
    docs = customer_documents(spark, sf).withColumn("pages", F.array(page)).withColumn("bytes", k.cast("long") * 10).withColumn("parameters", F.create_map(F.lit("k"), k.cast("string")))
    p = document_previews(docs, target=60, most=90).select("doc_id", F.from_json("preview", _READ).alias("p")).select("doc_id", "p.*")
    text = lambda c: c.cast("string")
    line = lambda name, *fields: F.array_join(F.transform(name, lambda x: F.concat_ws(":", *[text(x[f]) for f in fields])), ",")
    risks = F.array_join(F.transform("risks", lambda r: F.concat_ws(":", r["code"], r["level"], F.when(r["code"].startswith("low"), r["message"]))), ",")
    return p.select(
        "doc_id", "source", "score", "estimated_tokens", "heading_count", "image_count", line("issues", "code", "severity", "message", "line", "source_label").alias("issues"), "source_size", "source_suffix", F.sha2("cleaned_preview", 256).alias("cleaned"),
        line("headings", "level", "title", "line").alias("headings"), line("chunks", "index", "title", "estimated_tokens").alias("chunks"), line("ocr_pages", "label", "confidence", "low_confidence").alias("pages"), risks.alias("risks"),
        F.array_join(F.transform(F.map_entries("parameters"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("parameters"),
    )
