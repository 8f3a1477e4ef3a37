"""Scans in stretches of a few rows against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tonecairn.operators import stretches


def table(spark):
    r = random.Random(1)
    rows = [(k, i, r.randint(-5, 5), r.choice([None, None, r.randint(0, 9)]), r.random() < 0.8) for k, n in (("a", 150), ("b", 16), ("c", 1), (None, 33), ("all", 64)) for i in range(n)]
    rows = [(k, i, x, y, True if k == "all" else f) for k, i, x, y, f in rows]
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, i long, x int, y int, f boolean").repartition(4)


@pytest.mark.parametrize("size", [16, 5, 1 << 16])
def test_scans(spark, size):
    rows, frame = table(spark)
    of = {}
    for k, i, x, y, f in rows:
        of.setdefault(k, {})[i] = (x, y, f)
    got = {(r["k"], r["i"]): r for r in stretches.running(frame, "k", {"total": F.col("x")}, {"seen": F.col("y")}, size).collect()}
    slid = {(r["k"], r["i"]): r for r in stretches.sliding(frame, "k", 7, 3, lambda w: {"s": F.sum("x").over(w), "n": F.count("x").over(w)}, size).collect()}
    assert len(got) == len(slid) == len(rows)
    longest = {r["k"]: (r["start"], r["length"]) for r in stretches.longest_run(frame, "k", F.col("f"), size).collect()}
    for k, values in of.items():
        total, seen, best, run = 0, None, (0, 0), 0
        for i in range(len(values)):
            x, y, f = values[i]
            total, seen, run = total + x, seen if y is None else y, run + 1 if f else 0
            best = (i - run + 1, run) if run > best[1] else best
            assert (got[k, i]["total"], got[k, i]["seen"]) == (total, seen)
            near = [values[j][0] for j in range(max(0, i - 7), min(len(values), i + 4))]
            assert (slid[k, i]["s"], slid[k, i]["n"]) == (sum(near), len(near))
        assert longest.get(k, (0, 0)) == best


def test_numbers_of_one_long_key(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot"] * 9 + ["x", None]), r.choice([None, *range(40)]), r.choice("ab")) for _ in range(2000)]
    got = stretches.numbered(spark.createDataFrame(rows, "k string, t int, s string").repartition(5), ["k"], ["t", "s"])
    assert got.columns == ["k", "t", "s", "i"]
    for key in ("hot", "x", None):
        own = sorted((x for x in got.collect() if x["k"] == key), key=lambda x: x["i"])
        want = sorted(((t is not None, t or 0, s) for k, t, s in rows if k == key))
        assert [x["i"] for x in own] == list(range(len(want))) and [(x["t"] is not None, x["t"] or 0, x["s"]) for x in own] == want
    plan = stretches.longest_run(got, "k", F.col("s") == "a", 64)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") >= 2
