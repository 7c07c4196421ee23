"""What jobs will need on disk, against the free space of the volumes that their outputs go to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.registry import query, table

# The share of its input that an operation's output may take.
FACTORS = {"TO_MARKDOWN": 1.5, "TO_PDF": 1.5, "COMPRESS_VIDEO": 0.75, "EXTRACT_AUDIO": 0.5, "STANDARDIZE_MP4": 1.25, "KEYFRAMES_CONTACT_SHEET": 0.5, "RENAME_VIDEO": 1.0, "ORGANIZE_VIDEO": 1.0, "DOCUMENT_CONTEXT_PACK": 1.5}
SAFETY = 512 << 20


def estimate(size: Column, operation: Column) -> Column:
    """Bytes that an operation may write, one at least; null for an operation that is not known."""
    factor = F.try_element_at(F.create_map(*[F.lit(x) for pair in FACTORS.items() for x in pair]), operation)
    return F.greatest(F.lit(1).cast("bigint"), F.bround(F.coalesce(size, F.lit(0)) * factor, 0).cast("bigint"))


def _parents(path: Column) -> Column:
    """A path and all folders above it, without slashes at their ends."""
    names = F.split(F.regexp_replace(path, r"/+$", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, 1, k), "/"))


def volumes(spark: SparkSession, folders: list[str]) -> DataFrame:
    """path, volume, free of existing folders, as their stores report them: one call each, so for the few roots of a set-up. A volume is named by its store and size."""
    rows = []
    for folder in folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(at):
            status = fs.getStatus(at)
            rows.append((folder.rstrip("/"), f"{fs.getUri()}#{status.getCapacity()}", status.getRemaining()))
    return spark.createDataFrame(rows, "path string, volume string, free long")


def assess(jobs: DataFrame, folders: DataFrame, safety: int = SAFETY) -> DataFrame:
    """batch, required, n_volumes, free, remaining, short of jobs (batch, root, bytes, operation): required is the sum of all estimates, free that of the least
    volume. A root lies on the volume of its nearest folder among folders (path, volume, free), each volume counts once however many roots lie on it; a root
    on none of them has nothing free."""
    need = jobs.groupBy("batch", "root").agg(F.sum(estimate(F.col("bytes"), F.col("operation"))).alias("need"))
    above = need.select("root").distinct().select("root", F.explode(_parents(F.col("root"))).alias("path"))
    known = folders.groupBy(F.regexp_replace("path", r"/+$", "").alias("path")).agg(F.min_by(F.struct("volume", "free"), "free").alias("v"))
    nearest = above.join(known, "path").groupBy("root").agg(F.max_by("v", F.length("path")).alias("v"))
    rows = need.join(nearest, "root", "left").select("batch", "need", F.col("v.volume").alias("volume"), F.coalesce("v.free", F.lit(0)).alias("free"))
    sums = rows.groupBy("batch").agg(F.sum("need").alias("required"), F.countDistinct("volume").alias("n_volumes"), F.min("free").alias("free"))
    remaining = F.col("free") - F.col("required") - max(0, safety)
    return sums.select("batch", "required", "n_volumes", "free", remaining.alias("remaining"), (remaining < 0).alias("short"))


@query("disk_need", r"""WITH j AS (SELECT user_id AS batch, event_id AS e, event_id % 5000 AS bytes, CASE event_id % 3 WHEN 0 THEN 'TO_PDF' WHEN 1 THEN 'COMPRESS_VIDEO' ELSE 'RENAME_VIDEO' END AS operation, event_id % 30 AS n, event_id % 4 AS sub FROM events),
c AS (SELECT batch, greatest(1, CAST(round_even(bytes * CASE operation WHEN 'TO_PDF' THEN 1.5::DOUBLE WHEN 'COMPRESS_VIDEO' THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END, 0) AS BIGINT)) AS need, CASE WHEN n >= 25 THEN NULL WHEN sub = 1 THEN 'b' || (n % 5) ELSE 'a' || (n % 5) END AS volume,
 CASE WHEN n >= 25 THEN 0 WHEN sub = 1 THEN 70000 + n % 5 * 1000 ELSE 90000 - n % 5 * 1000 END AS free FROM j)
SELECT batch, CAST(sum(need) AS BIGINT) AS required, count(DISTINCT volume) AS n_volumes, CAST(min(free) AS BIGINT) AS free, CAST(min(free) - sum(need) - 1000 AS BIGINT) AS remaining, min(free) - sum(need) - 1000 < 0 AS short FROM c GROUP BY batch""")
def disk_need(spark: SparkSession, sf: str) -> DataFrame:
    """Events as jobs whose roots lie on volumes that nations name, some in a folder of another volume, some on none."""
    e = F.col("event_id")
    root = F.concat(F.lit("/data/"), (e % 30).cast("string"), F.when(e % 4 == 1, "/own/x/").otherwise(F.concat(F.lit("/out/"), (e % 4).cast("string"))))
    operation = F.when(e % 3 == 0, "TO_PDF").when(e % 3 == 1, "COMPRESS_VIDEO").otherwise("RENAME_VIDEO")
    jobs = table(spark, sf, "events").select(F.col("user_id").alias("batch"), root.alias("root"), (e % 5000).alias("bytes"), operation.alias("operation"))
    k = F.col("n_nationkey").cast("bigint")
    volume = lambda name, free: F.struct(F.concat(F.lit(name), (k % 5).cast("string")).alias("volume"), free.alias("free"))
    path = F.concat(F.lit("/data/"), k.cast("string"))
    both = F.array(F.struct(F.concat(path, F.lit("/")).alias("path"), volume("a", 90_000 - k % 5 * 1000).alias("v")), F.struct(F.concat(path, F.lit("/own")).alias("path"), volume("b", 70_000 + k % 5 * 1000).alias("v")))
    folders = table(spark, sf, "nation").select(F.inline(both)).select("path", "v.*")
    return assess(jobs, folders, 1000)
