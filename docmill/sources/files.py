"""File discovery and prepared packages as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes that each workspace takes.
MARKDOWN = (".docx", ".pptx", ".xlsx", ".pdf", ".html", ".htm", ".csv", ".json", ".xml", ".epub", ".txt", ".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp")
WORD, SLIDES = (".doc", ".docx"), (".ppt", ".pptx")
VIDEOS = (".mp4", ".mov", ".mkv", ".avi", ".webm", ".m4v")
DOCUMENTS = tuple(dict.fromkeys(MARKDOWN + WORD + SLIDES))


def discover(spark: SparkSession, *paths: str, suffixes: tuple[str, ...] = DOCUMENTS + VIDEOS) -> DataFrame:
    """path, name, suffix, bytes, modified of all files below the paths that have one of the suffixes (with or without its dot), in the order of their
    paths; each path once, and both letter case aside (of paths that differ in it the least stays).

    The listing is Spark's own, so any store it reads will do; contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    rows = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    rows = rows.withColumn("suffix", F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))).filter(F.col("suffix").isin(*["." + x.lower().lstrip(".") for x in suffixes]))
    columns = ("path", "name", "suffix", "bytes", "modified")
    once = rows.groupBy(F.lower("path").alias("folded")).agg(F.min(F.struct(*columns)).alias("r"))
    return once.orderBy("folded").select(*[F.col(f"r.{c}").alias(c) for c in columns])


def classify(files: DataFrame) -> DataFrame:
    """files with workspace: documents, videos or null."""
    return files.withColumn("workspace", F.when(F.col("suffix").isin(*DOCUMENTS), "documents").when(F.col("suffix").isin(*VIDEOS), "videos"))


def read_pack_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports as rows: what is missing or malformed is null or 0, and no file fails the read."""
    schema = "requested_tokens string, sources array<struct<id:string>>, packs array<struct<index:string,estimated_tokens:string,over_budget:boolean>>"
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", schema).alias("r"))
    budget = F.expr("try_cast(r.requested_tokens as bigint)")
    over = F.size(F.filter("r.packs", lambda p: p.over_budget))
    rows = raw.select("path", budget.alias("budget"), F.greatest(F.size("r.sources"), F.lit(0)).alias("n_sources"), F.greatest(F.size("r.packs"), F.lit(0)).alias("n_packs"), F.greatest(over, F.lit(0)).alias("overflow"))
    label = F.when(F.col("budget").isNull(), "No limit").when(F.col("budget") % 1000 == 0, F.concat((F.col("budget") / 1000).cast("long").cast("string"), F.lit("K context window"))).otherwise(F.concat(F.format_number("budget", 0), F.lit(" estimated tokens")))
    return rows.withColumn("label", label).withColumn("status", F.when(F.col("budget").isNull(), "no_limit").when(F.col("overflow") > 0, "over_budget").otherwise("within_budget"))
