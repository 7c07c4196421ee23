"""Next-fit packing of jobs of any size, in parallel and with the very packs of the loop.

A pack that starts at row i ends before the first row that would pass the target, wherever the packs before it ended. So each run of rows tells, for every row
at which a pack may enter it, how many packs start in it and where the first pack behind it starts. Only these short tables are gone through in order; then
the runs are packed apart from one another. A job's rows never meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.plans.stored import stored

RUN = 1 << 16  # rows of a run, more if a pack may have more
SPAN = 1 << 16  # values of the order that are numbered together


def numbered(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """rows (job, major, minor, ...) with n: dense numbers from 0 in the order of major and minor within a job.

    Rows are counted in cells, a cell being a span of minor within a major, cells in spans of major, and both are numbered by running sums of the counts
    before them. So no task orders more than the rows of a cell, the cells of a span or the spans of a job, however large a job or a major is.
    """
    r = rows.withColumn("_m", F.floor(F.col("minor") / span))
    cells = r.groupBy("job", "major", "_m").agg(F.count("*").alias("_c")).withColumn("_s", F.floor(F.col("major") / span))
    sums = lambda by, *order: F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = cells.groupBy("job", "_s").agg(F.sum("_c").alias("_c")).select("job", "_s", sums(["job"], "_s").alias("_b"))
    starts = cells.withColumn("_w", sums(["job", "_s"], "major", "_m")).join(spans, ["job", "_s"]).select("job", "major", "_m", (F.col("_b") + F.col("_w")).alias("_b"))
    own = F.row_number().over(Window.partitionBy("job", "major", "_m").orderBy("minor"))
    return r.withColumn("_i", own - 1).join(starts, ["job", "major", "_m"]).withColumn("n", F.col("_b") + F.col("_i")).drop("_m", "_b", "_i")


def _exits(frame: pd.DataFrame, target: int) -> pd.DataFrame:
    """For each row of a run: how many packs begin in the run if one begins at that row, and where behind the run the next one begins."""
    frame = frame.sort_values("n")
    full, sums = frame["full"].to_numpy(), frame["rest"].to_numpy().cumsum()
    size = int(frame["own"].sum())
    rows = np.arange(size)
    leave = np.maximum(rows + 1, np.searchsorted(sums, target - full[:size] + sums[:size], side="right"))
    packs = np.ones(size, np.int64)
    while (inside := leave < size).any():  # each round doubles the packs that are jumped over
        packs[inside] += packs[leave[inside]]
        leave[inside] = leave[leave[inside]]
    top = min(size, target + 1)
    return pd.DataFrame({"job": [frame["job"].iloc[0]], "run": [int(frame["run"].iloc[0])], "size": [size], "leave": [(leave - size)[:top]], "packs": [packs[:top]]})


def _entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    job, at, pack = None, 0, 0
    for frame in frames:
        found = []
        for j, size, leave, packs in zip(frame["job"], frame["size"], frame["leave"], frame["packs"], strict=True):
            if j != job:
                job, at, pack = j, 0, 0
            found.append((at, pack))
            if at < len(leave):
                pack, at = pack + int(packs[at]), int(leave[at])
            else:
                at -= size
        yield frame[["job", "run"]].assign(enter=[f[0] for f in found], pack=[f[1] for f in found])


def _place(frames: Iterator[pd.DataFrame], target: int, run: int) -> Iterator[pd.DataFrame]:
    """Rows in order: a step for each pack, which a search in the running sums finds the end of."""
    open_run, used, pack = None, 0, 0
    for frame in frames:
        jobs, number = frame["job"].to_numpy(), frame["run"].to_numpy()
        new = np.ones(len(frame), bool)
        new[1:] = (jobs[1:] != jobs[:-1]) | (number[1:] != number[:-1])
        cuts = np.append(np.flatnonzero(new), len(frame)).tolist()
        place_of, full, rest = (frame[c].to_numpy() for c in ("n", "full", "rest"))
        packs, heads = np.zeros(len(frame), np.int64), np.zeros(len(frame), bool)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = a
            if (jobs[a], number[a]) != open_run:
                open_run, used, pack = (jobs[a], number[a]), None, int(frame["pack"].iloc[a])
            if used is None:  # no pack has begun in this run: those before its entry belong to the last one
                at = min(b, a + max(0, int(number[a]) * run + int(frame["enter"].iloc[a]) - int(place_of[a])))
                packs[a:at] = pack
            sums = np.concatenate([[0], rest[a:b].cumsum()])
            while at < b:
                if used is not None:
                    end = max(at, a + int(np.searchsorted(sums, target - used + sums[at - a], side="right")) - 1)
                    packs[at:end] = pack
                    used += int(sums[end - a] - sums[at - a])
                    at = end
                if at < b:
                    pack, used = pack + 1, int(full[at])
                    packs[at], heads[at] = pack, True
                    at += 1
        yield frame[["job", "major", "minor"]].assign(pack=packs, starts=heads)


def place(rows: DataFrame, target: int, run: int = RUN, span: int = SPAN) -> DataFrame:
    """job, major, minor, pack (from 1), starts of rows (job string, major long, minor long, full long, rest long).

    full is a row's cost at the start of a pack, rest its cost elsewhere; both are at least 1. A row that alone passes the target is a pack by itself.
    Costs are computed once, into a stored table, as are the numbers: several parts of the plan read both.
    """
    run = max(run, target + 1)
    r = stored(numbered(stored(rows, "fit-rows"), span).withColumn("run", F.floor(F.col("n") / run)), "fit-numbered")
    narrow = r.select("job", "run", "n", "full", "rest")
    heads = narrow.filter((F.col("n") % run <= target) & (F.col("run") > 0)).withColumn("run", F.col("run") - 1)  # a pack may end in the next run
    both = narrow.withColumn("own", F.lit(True)).unionByName(heads.withColumn("own", F.lit(False)))
    exits = both.groupBy("job", "run").applyInPandas(partial(_exits, target=target), "job string, run long, size long, leave array<long>, packs array<long>")
    enters = exits.repartition("job").sortWithinPartitions("job", "run").mapInPandas(_entries, "job string, run long, enter long, pack long")
    # By an expression of its own: a repartition by the keys of the join is left out as done, and adaptive execution may then read the join's side by map task, which tears runs apart.
    ready = r.join(enters, ["job", "run"]).repartition(F.xxhash64("job", "run")).sortWithinPartitions("job", "run", "n")
    return ready.mapInPandas(partial(_place, target=target, run=run), "job string, major long, minor long, pack long, starts boolean")
