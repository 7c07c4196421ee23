"""Dense numbers in the order of any columns, without ordering in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.plans.stored import stored


def dense_numbers(rows: DataFrame, group: str, order: list[str], name: str = "n") -> DataFrame:
    """rows with their number, from 1, within a group by the order (nulls first). Rows are sorted into runs over the whole cluster and stored; the counts of
    each group in each run tell where its numbers begin there."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    runs = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "sorted-runs")
    run = F.shiftright("_at", 33)
    counts = runs.groupBy(group, run.alias("_run")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(group).alias("_g"), "_run", (before - F.col("_first") + 1).alias("_shift"))
    r = runs.withColumn("_r", run)
    return r.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_r") == F.col("_run"))).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))
