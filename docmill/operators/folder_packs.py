"""A folder of mixed files to context packs in one call: found, converted, cleaned, packed and written, each step stored as a table that the next one reads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docmill.functions.provenance import SPAN
from docmill.operators import rules
from docmill.operators.chunks import MOST
from docmill.operators.document_packages import cleaned_documents, image_assets, issues_of, packaged, with_asset_links
from docmill.operators.pack_files import create_context_packs, load_source_maps, record
from docmill.plans.ordered import dense_numbers
from docmill.plans.stored import new_place, stored
from docmill.registry import query, table
from docmill.sources.convert import to_markdown
from docmill.sources.files import DOCUMENTS
from docmill.sources.office_media import IMAGES
from docmill.sources.part_files import parts, write_files

Progress = Callable[[str, int], None]
TEXTS = tuple(x for x in (*DOCUMENTS, ".md") if x not in IMAGES)


@dataclass(frozen=True)
class Made:
    """What folder_to_packs() did: files that became sources, files that did not (path, error_code, error), and how many files and bytes were written."""

    sources: DataFrame
    failures: DataFrame
    files: int
    bytes: int


def _below(path: Column, folder: str) -> Column:
    base = "/" + folder.split(":", 1)[-1].strip("/")
    return F.substring_index(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path), base + "/", -1)


def _joined(folder: Column, target: Column) -> Column:
    """A relative path taken from a folder, "." and ".." resolved; null for a path that is absolute or leads out."""
    steps = F.filter(F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), target), "/"), lambda x: ~x.isin("", "."))
    out = F.aggregate(steps, F.array().cast("array<string>"), lambda a, x: F.when(x != "..", F.concat(a, F.array(x))).when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.lit(None)))
    return F.when(~target.rlike(r"^/|^[A-Za-z]:"), F.nullif(F.array_join(out, "/"), F.lit("")))


def images_of(docs: DataFrame, images: DataFrame) -> DataFrame:
    """doc_id, path (as the document names it), uri of the images (path below the folder, uri) that docs (doc_id, path, content) refer to from where they lie."""
    refs = rules.image_references(docs.select("doc_id", F.col("content").alias("markdown"))).select("doc_id", "target").distinct()
    own = docs.select("doc_id", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"))
    at = refs.join(own, "doc_id").select("doc_id", F.col("target").alias("named"), _joined(F.col("folder"), F.col("target")).alias("path"))
    return at.join(images.select("path", "uri"), "path").select("doc_id", F.col("named").alias("path"), "uri")


def folder_to_packs(spark: SparkSession, folder: str, root: str, budget: int | None, created_at: str, progress: Progress | None = None, most: int = MOST) -> Made:
    """The documents below folder (a URI) as context packs below root: a pack for each of its top folders, one for the files at its top.

    Each file is read once: converted, cleaned, with the images that it names from where it lies, its issues as warnings. Files without an engine or with a
    fault are failures, and don't stop the rest; files whose paths differ in letter case alone are one. progress is told of each step and its rows, counted
    as they are written.
    """
    say = progress or (lambda step, n: None)

    def kept(df: DataFrame, step: str) -> DataFrame:
        seen = Observation("rows")
        out = stored(df.observe(seen, F.count(F.lit(1)).alias("n")), step)
        say(step, seen.get["n"])
        return out

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    inside = _below(F.col("path"), folder)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    texts = to_markdown(files.filter(suffix.isin(*TEXTS)).withColumn("sha256", F.sha2("content", 256)), ("sha256",)).withColumn("path", inside)
    converted = kept(texts, "converted")
    once = converted.groupBy(F.lower("path").alias("folded")).agg(F.min("path").alias("path")).select("path")
    good = converted.join(once, "path", "left_semi").filter("error_code is null")
    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise("")
    jobs = dense_numbers(good.select(top.alias("job")).distinct().withColumn("all", F.lit(0)), "all", ["job"], "pack_job").select("job", "pack_job")
    placed = dense_numbers(good.withColumn("job", top).select("job", "path", F.lower("path").alias("folded")), "job", ["folded"], "source_order").join(jobs, "job")
    numbered = dense_numbers(placed.withColumn("all", F.lit(0)), "all", ["pack_job", "source_order"], "doc_id").select("path", "pack_job", "source_order", "doc_id")
    ready = kept(numbered.join(good.select("path", "markdown", "sha256"), "path").withColumn("name", F.substring_index("path", "/", -1)), "numbered")
    images = files.filter(suffix.isin(*IMAGES)).select(inside.alias("path"), F.col("_metadata.file_path").alias("uri"))
    cleaned = kept(cleaned_documents(ready).join(ready.select("doc_id", "path"), "doc_id"), "cleaned")
    named = kept(images_of(cleaned, images), "images")
    links = kept(image_assets(cleaned, named), "assets")
    docs = kept(packaged(with_asset_links(cleaned, links)), "packaged")
    issue = record(F.col("code"), F.col("severity"), rules.message(F.col("code"), F.col("label"), F.col("tokens"), most).alias("message"), F.col("line"), F.col("label").alias("source_label"))
    warnings = issues_of(docs, most).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rule_no", F.coalesce("line", F.lit(0)).alias("at"), issue.alias("w")))).alias("w"))
    keys = ready.select("doc_id", "pack_job", "source_order")
    sources = docs.select("doc_id", F.col("name").alias("display_name"), "content", "sha256", F.col("spans").cast(f"array<{SPAN}>").alias("spans")).join(keys, "doc_id").join(warnings, "doc_id", "left")
    sources = kept(sources.select("pack_job", "source_order", "display_name", "content", "sha256", "spans", F.coalesce(F.transform("w", lambda x: x["w"]), F.array().cast("array<string>")).alias("warnings")), "sources")
    assets = links.join(named.withColumnRenamed("path", "target"), ["doc_id", "target"]).join(keys, "doc_id").select("pack_job", "source_order", F.col("asset").alias("path"), "uri")
    n, size = create_context_packs(sources, budget, root, new_place(spark, "packs"), created_at, assets)
    say("files", n)
    return Made(ready.select("pack_job", "source_order", "path"), converted.filter("error_code is not null").select("path", "error_code", "error"), n, size)


@query("folder_to_packs", """WITH s AS (SELECT s_suppkey AS k, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE '' END AS job FROM supplier WHERE s_suppkey % 5 > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY CASE WHEN job = '' THEN '' ELSE job || '/' END || k || CASE WHEN k % 2 = 0 THEN '.csv' ELSE '.md' END) AS source_order FROM s)
SELECT k || CASE WHEN k % 2 = 0 THEN '.csv' ELSE '.md' END AS display_name, 'source-' || printf('%03d', source_order) AS source_id, block_order, k % 2 = 0 AS is_table, true AS content_verified,
 sha256(CASE WHEN k % 2 = 0 THEN '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || k || ' | ' || name || ' |' WHEN block_order = 1 THEN '# ' || name ELSE 'Text of ' || k END) AS content
FROM o, unnest(CASE WHEN k % 2 = 0 THEN [1] ELSE [1, 2] END) t(block_order)""")
def folder_packs(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as files of two kinds in three folders, every fifth broken: their packs, read back as source maps that hold against the contents."""
    k = F.col("s_suppkey")
    key = k.cast("string")
    folder = F.when(k % 3 == 0, "a/").when(k % 3 == 1, "b/").otherwise("")
    path = F.concat(folder, key, F.when(k % 5 == 0, ".xlsx").when(k % 2 == 0, ".csv").otherwise(".md"))
    text = F.when(k % 2 == 0, F.concat(F.lit("key,name\n"), key, F.lit(","), F.col("s_name"))).otherwise(F.concat(F.lit("# "), F.col("s_name"), F.lit("\n\nText of "), key))
    inputs, out = new_place(spark, "folder"), new_place(spark, "context-packs")
    write_files(parts(table(spark, sf, "supplier"), F.lit("in"), path, 0, text), inputs)
    folder_to_packs(spark, f"{inputs}/in", out, 2000, "2024-01-01T00:00:00+00:00")
    sources, entries, _ = load_source_maps(spark, out)
    rows = entries.join(sources.select("folder", "source_id", "display_name"), ["folder", "source_id"])
    return rows.select("display_name", "source_id", F.col("block_order").cast("int").alias("block_order"), F.col("atomic").alias("is_table"), "content_verified", F.sha2("content", 256).alias("content"))
