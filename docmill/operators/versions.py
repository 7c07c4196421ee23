"""Versions in their total order: releases, pre-, post- and development releases; the newest release of a listing that is newer than the one in use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.registry import query, table

# The form of a version, and the words for its pre-releases in their order.
FORM = r"^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d+)?)?((?:-(\d+))|(?:[-_.]?(?:post|rev|r)[-_.]?(\d+)?))?([-_.]?dev[-_.]?(\d+)?)?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
PRE = {"a": ("a", "alpha"), "b": ("b", "beta"), "rc": ("c", "rc", "pre", "preview")}
LAST = 10**18


def version_key(text: Column) -> Column:
    """What versions sort by, null for a text that is none.

    By epoch, then numbers (zeros at the end don't count), then: a development release of a version comes before its pre-releases (a, b, rc by number), those
    before it, and post-releases behind it; within each of these, development releases first; a local label (numbers behind words) last.
    """
    t = F.lower(text)
    part = lambda k: F.nullif(F.regexp_extract(t, FORM, k), F.lit(""))
    number = lambda c, other: F.coalesce(c.try_cast("bigint"), F.lit(other).cast("bigint"))
    numbers = F.transform(F.split(F.regexp_replace(part(2), r"(?:\.0+)+$", ""), r"\."), lambda x: x.try_cast("bigint"))
    post, dev = part(5), part(8)
    kind = F.when(part(3).isNull() & post.isNull() & dev.isNotNull(), 0).when(part(3).isNull(), len(PRE) + 1)
    for rank, words in enumerate(PRE.values(), start=1):
        kind = kind.when(part(3).isin(*words), rank)
    local = F.transform(F.split(part(10), "[-_.]"), lambda x: F.struct(x.rlike(r"^\d+$").alias("is_number"), number(x, 0).alias("n"), F.when(~x.rlike(r"^\d+$"), x).alias("word")))
    key = F.struct(
        number(part(1), 0).alias("epoch"), numbers.alias("numbers"), kind.alias("kind"), F.when(part(3).isNotNull(), number(part(4), 0)).otherwise(0).alias("pre"),
        F.when(post.isNull(), -1).otherwise(number(F.coalesce(part(6), part(7)), 0)).alias("post"), F.when(dev.isNull(), LAST).otherwise(number(part(9), 0)).alias("dev"),
        F.coalesce(local, F.array().cast("array<struct<is_number:boolean,n:bigint,word:string>>")).alias("local"),
    )
    return F.when(t.rlike(FORM) & ~F.exists(numbers, lambda x: x.isNull()), key)


def newest_release(releases: DataFrame, current: Column) -> DataFrame:
    """product, tag of the newest of releases (product, tag, draft) that is newer than current; drafts and tags that are no version are passed over."""
    rows = releases.withColumn("_key", version_key(F.col("tag"))).filter(F.col("_key").isNotNull() & ~F.coalesce("draft", F.lit(False)) & (F.col("_key") > version_key(current)))
    return rows.groupBy("product").agg(F.max_by("tag", F.struct("_key", "tag")).alias("tag"))


@query("newest_releases", r"""WITH r AS (SELECT p_partkey % 50 AS product, p_partkey AS k, p_partkey % 4 AS major, p_partkey % 7 AS minor, p_partkey % 5 AS kind, p_partkey % 3 AS n, p_partkey % 11 = 0 AS draft FROM part),
t AS (SELECT *, CASE kind WHEN 0 THEN 'v' || major || '.' || minor || '.0' WHEN 1 THEN major || '.' || minor || '-rc.' || n WHEN 2 THEN major || '.' || minor || '.0.post' || n WHEN 3 THEN major || '.' || minor || '.dev' || n ELSE 'nightly' || k END AS tag,
 CASE kind WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS place, CASE kind WHEN 0 THEN 0 ELSE n END AS m FROM r WHERE NOT draft)
SELECT product, max_by(tag, ((major * 10 + minor) * 10 + place) * 10 + m) AS tag FROM t WHERE kind < 4 AND (major, minor, place, m) > (1, 2, 2, 0) GROUP BY product""")
def newest_releases(spark: SparkSession, sf: str) -> DataFrame:
    """Releases of fifty products: final, pre-, post- and development ones, drafts, and tags that are no versions; what is newer than 1.2."""
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    base = F.concat_ws(".", text(k % 4), text(k % 7))
    tag = F.when(k % 5 == 0, F.concat(F.lit("v"), base, F.lit(".0"))).when(k % 5 == 1, F.concat(base, F.lit("-rc."), text(k % 3))).when(k % 5 == 2, F.concat(base, F.lit(".0.post"), text(k % 3)))
    tag = tag.when(k % 5 == 3, F.concat(base, F.lit(".dev"), text(k % 3))).otherwise(F.concat(F.lit("nightly"), text(k)))
    return newest_release(table(spark, sf, "part").select((k % 50).alias("product"), tag.alias("tag"), (k % 11 == 0).alias("draft")), F.lit("1.2.0"))
