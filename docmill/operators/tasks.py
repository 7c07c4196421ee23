"""Task and history operators: roll-up, search, retention, progress, disk preflight, recovery, capabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.registry import query, table

#: The share of its input that an operation's output may take.
FACTORS = {"click": 1.5, "view": 1.0, "purchase": 2.0}

_TASKS_SQL = """
WITH t AS (SELECT event_id AS task_id, user_id, event_type AS operation, ts AS created_at, CAST(event_id % 5000 AS BIGINT) AS bytes, CAST(event_id % 100 AS BIGINT) AS progress,
 CASE WHEN event_id % 11 = 0 THEN 'failed' WHEN event_id % 13 = 0 THEN 'running' WHEN event_id % 7 = 0 THEN 'waiting' ELSE 'success' END AS status FROM events)"""


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Events as tasks."""
    e = F.col("event_id")
    status = F.when(e % 11 == 0, "failed").when(e % 13 == 0, "running").when(e % 7 == 0, "waiting").otherwise("success")
    return table(spark, sf, "events").select(e.alias("task_id"), "user_id", F.col("event_type").alias("operation"), F.col("ts").alias("created_at"), (e % 5000).alias("bytes"), (e % 100).alias("progress"), status.alias("status"))


@query("history_rollup", _TASKS_SQL + " SELECT user_id, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(sum(bytes) AS BIGINT) AS total_bytes, string_agg(DISTINCT operation, ',' ORDER BY operation) AS operations, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses FROM t GROUP BY user_id")
def rollup(spark: SparkSession, sf: str) -> DataFrame:
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",").alias(c + ("es" if c == "status" else "s"))
    return tasks(spark, sf).groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("bytes").alias("total_bytes"), names("operation"), names("status"))


@query("history_search", _TASKS_SQL + " SELECT task_id, status FROM t WHERE contains(lower(task_id || ' ' || operation), lower(trim('  1C '))) OR (contains(lower(task_id || ' ' || operation), '42') AND status = 'success')")
def search(spark: SparkSession, sf: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", F.col("task_id").cast("string"), "operation"))
    return tasks(spark, sf).filter(F.contains(text, F.lower(F.trim(F.lit("  1C ")))) | (F.contains(text, F.lit("42")) & (F.col("status") == "success"))).select("task_id", "status")


def retention(entries: DataFrame, key: str, days: int, quota: int) -> DataFrame:
    """entries with their fate: expired (older than the newest by more than days), over_quota (the oldest go until the rest fits), kept.

    Running sums by day keep the window small: whole days are summed first, then the tasks within a day follow their day's start.
    """
    newest = entries.agg(F.max("created_at").alias("newest"))
    live = entries.join(F.broadcast(newest)).withColumn("expired", F.col("created_at") < F.col("newest") - F.expr(f"interval {days} days")).withColumn("day", F.to_date("created_at"))
    days_ = live.filter(~F.col("expired")).groupBy("day").agg(F.sum("bytes").alias("b"))
    later = days_.select("day", F.coalesce(F.sum("b").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("later"))
    own = F.sum(F.when(~F.col("expired"), F.col("bytes")).otherwise(0)).over(Window.partitionBy("day").orderBy(F.desc("created_at"), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0))
    rows = live.withColumn("own", own).join(later, "day", "left")
    return rows.withColumn("fate", F.when(F.col("expired"), "expired").when(F.col("own") + F.col("later") > quota, "over_quota").otherwise("kept"))


@query("retention", _TASKS_SQL + ", n AS (SELECT max(created_at) AS newest FROM t), l AS (SELECT t.*, created_at < newest - INTERVAL 20 DAY AS expired FROM t, n), r AS (SELECT *, sum(CASE WHEN NOT expired THEN bytes ELSE 0 END) OVER (ORDER BY created_at DESC, task_id DESC) AS run FROM l) SELECT task_id, CASE WHEN expired THEN 'expired' WHEN run > 5000000 THEN 'over_quota' ELSE 'kept' END AS fate FROM r")
def retained(spark: SparkSession, sf: str) -> DataFrame:
    return retention(tasks(spark, sf), "task_id", 20, 5_000_000).select("task_id", "fate")


@query("overall_progress", _TASKS_SQL + " SELECT user_id, CAST(round_even(100.0::DOUBLE * count(*) FILTER (WHERE status IN ('success', 'failed')) / count(*), 0) AS BIGINT) AS terminal_percent, CAST(floor(avg(CASE WHEN status IN ('success', 'failed') THEN 100 ELSE progress END)) AS BIGINT) AS mean_percent FROM t GROUP BY user_id")
def progress(spark: SparkSession, sf: str) -> DataFrame:
    done = F.col("status").isin("success", "failed")
    return tasks(spark, sf).groupBy("user_id").agg(F.bround(100.0 * F.count_if(done) / F.count("*"), 0).cast("long").alias("terminal_percent"), F.floor(F.avg(F.when(done, 100).otherwise(F.col("progress")))).cast("long").alias("mean_percent"))


@query("disk_preflight", _TASKS_SQL + ", r AS (SELECT user_id, sum(greatest(1, round_even(bytes * CASE operation WHEN 'click' THEN 1.5::DOUBLE WHEN 'view' THEN 1.0::DOUBLE WHEN 'purchase' THEN 2.0::DOUBLE ELSE 1.2::DOUBLE END, 0))) AS required FROM t GROUP BY user_id) SELECT user_id, CAST(required AS BIGINT) AS required, CAST(500000 - required - 1000 AS BIGINT) AS remaining, 500000 - required - 1000 < 0 AS short FROM r")
def preflight(spark: SparkSession, sf: str) -> DataFrame:
    factor = F.lit(1.2)
    for name, value in FACTORS.items():
        factor = F.when(F.col("operation") == name, F.lit(value)).otherwise(factor)
    need = F.sum(F.greatest(F.lit(1), F.bround(F.col("bytes") * factor, 0).cast("long")))
    rows = tasks(spark, sf).groupBy("user_id").agg(need.cast("long").alias("required"))
    return rows.withColumn("remaining", (500_000 - F.col("required") - 1000).cast("long")).withColumn("short", F.col("remaining") < 0)


@query("task_recovery", _TASKS_SQL + " SELECT task_id, CASE WHEN status = 'running' THEN 'interrupted' ELSE status END AS status, CASE WHEN status = 'running' THEN least(99, progress) ELSE progress END AS progress FROM t")
def recovery(spark: SparkSession, sf: str) -> DataFrame:
    """After a restart, what was running counts as interrupted, short of 100 per cent."""
    running = F.col("status") == "running"
    return tasks(spark, sf).select("task_id", F.when(running, "interrupted").otherwise(F.col("status")).alias("status"), F.when(running, F.least(F.lit(99), "progress")).otherwise(F.col("progress")).alias("progress"))


def progress_percent(line: Column, seconds: Column) -> Column:
    """Per cent that a progress line of a program tells of a whole of so many seconds: at most 99 before its end; null for a line that tells nothing."""
    us = F.regexp_extract(line, "^out_time_us=([0-9]+)", 1).try_cast("double")
    share = F.floor(F.try_divide(us / 1_000_000, seconds) * 100)
    return F.when(line == "progress=end", F.lit(100)).when(line.startswith("out_time_us="), F.least(F.lit(99), F.greatest(F.lit(0), share))).cast("long")


@query("progress_lines", "WITH l AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'progress=end' WHEN event_id % 10 < 8 THEN 'out_time_us=' || (event_id * 1000) ELSE 'frame=' || event_id END AS line FROM events) SELECT event_id, CASE WHEN line = 'progress=end' THEN 100 WHEN starts_with(line, 'out_time_us=') THEN CAST(least(99, greatest(0, floor(CAST(regexp_extract(line, '=([0-9]+)', 1) AS DOUBLE) / 1000000 / 10 * 100))) AS BIGINT) END AS percent FROM l")
def progress_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Per cent of ten seconds from progress lines; other lines say nothing."""
    e = F.col("event_id")
    line = F.when(e % 10 == 0, "progress=end").when(e % 10 < 8, F.concat(F.lit("out_time_us="), (e * 1000).cast("string"))).otherwise(F.concat(F.lit("frame="), e.cast("string")))
    return table(spark, sf, "events").select("event_id", progress_percent(line, F.lit(10.0)).alias("percent"))


@query("captions", "SELECT event_id, printf('%02d:%02d:%02d.%03d', event_id // 3600, event_id % 3600 // 60, event_id % 60, event_id * 7 % 1000) AS caption FROM events")
def captions(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", F.format_string("%02d:%02d:%02d.%03d", F.floor(e / 3600), F.floor(e % 3600 / 60), e % 60, e * 7 % 1000).alias("caption"))


@query("newest_version", "SELECT user_id, max((event_id % 5) * 10000 + (event_id % 13) * 100 + event_id % 7)::BIGINT AS version_code, max([event_id % 5, event_id % 13, event_id % 7])::VARCHAR <> '' AS found FROM events GROUP BY user_id")
def newest_version(spark: SparkSession, sf: str) -> DataFrame:
    """The greatest version of each user, compared part by part."""
    e = F.col("event_id")
    text = F.concat_ws(".", (e % 5).cast("string"), (e % 13).cast("string"), (e % 7).cast("string"))
    v = F.transform(F.split(text, r"\."), lambda x: x.cast("int"))
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.max(v).alias("v"))
    return rows.select("user_id", (F.get("v", 0) * 10000 + F.get("v", 1) * 100 + F.get("v", 2)).cast("long").alias("version_code"), (F.size("v") == 3).alias("found"))


@query("common_operations", "WITH f AS (SELECT DISTINCT lang, source, CASE WHEN source IN ('src0', 'src1') THEN ['convert', 'pack'] ELSE ['convert', 'pack', 'ocr'] END AS ops FROM documents), o AS (SELECT lang, source, unnest(ops) AS op FROM f), n AS (SELECT lang, count(*) AS n FROM f GROUP BY lang) SELECT o.lang, op, count(*) = any_value(n) AS common FROM o JOIN n USING (lang) GROUP BY o.lang, op")
def common_operations(spark: SparkSession, sf: str) -> DataFrame:
    """The operations that all files of a selection allow."""
    ops = F.when(F.col("source").isin("src0", "src1"), F.array(F.lit("convert"), F.lit("pack"))).otherwise(F.array(F.lit("convert"), F.lit("pack"), F.lit("ocr")))
    files = table(spark, sf, "documents").select("lang", "source").distinct()
    counts = files.groupBy("lang").agg(F.count("*").alias("n"))
    each = files.select("lang", F.explode(ops).alias("op")).groupBy("lang", "op").agg(F.count("*").alias("k"))
    return each.join(counts, "lang").select("lang", "op", (F.col("k") == F.col("n")).alias("common"))
