"""Parallel next-fit against the loop."""

import random

from docmill.plans.next_fit import place


def loop(rows, target):
    out, job, used, pack = {}, None, 0, 0
    for j, a, b, full, rest in sorted(rows):
        if j != job:
            job, used, pack = j, 0, 1
            head = True
        else:
            head = used + rest > target
            pack += head
        used = full if head else used + rest
        out[j, a, b] = (pack, head)
    return out


def test_equals_the_loop(spark):
    rng = random.Random(3)
    rows = []
    for job, n in (("", 1), ("b", 3000), ("c", 41), ("d", 500)):
        for i in range(n):
            rest = rng.choice([1, 1, 2, 5, 9, 30])
            rows.append((job, i * 3, i % 2, rest + rng.choice([0, 4]), rest))
    for target, run in ((20, 1), (20, 50), (20, 1 << 16)):
        got = place(spark.createDataFrame(rows, "job string, major long, minor long, full long, rest long"), target, run, span=64).collect()
        assert len(got) == len(rows)
        assert {(r.job, r.major, r.minor): (r.pack, r.starts) for r in got} == loop(rows, target)


def test_empty(spark):
    assert place(spark.createDataFrame([], "job string, major long, minor long, full long, rest long"), 20).collect() == []


def test_rows_of_a_run_stay_together_when_the_join_becomes_a_broadcast(spark):
    """Adaptive execution turned the join before the packing into a broadcast and read its rows by map task, so a run was packed in pieces."""
    rows = [(job, i, 0, 1 + i % 7, 1 + i % 5) for job in ("a", "b", "c") for i in range(2000)]
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        frame = spark.createDataFrame(rows, "job string, major long, minor long, full long, rest long").repartition(7)
        got = place(frame, 20, 400, span=64).collect()
    finally:
        for name in conf:
            spark.conf.unset(name)
    assert {(r.job, r.major, r.minor): (r.pack, r.starts) for r in got} == loop(rows, 20)
