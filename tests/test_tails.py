"""Longest shared tails against all pairs, in one range and in many."""

import random

import pytest

from tonecairn.operators import tails


def plainly(rows):
    out = set()
    for key, path in rows:
        if path is None:
            continue
        best = None
        for other, there in rows:
            if other == key or there is None:
                continue
            k = tails.shared(path.lower().split("/")[::-1], there.lower().split("/")[::-1])
            if k:
                best = min(best or (1, ""), (-k, there))
        if best:
            out.add((key, best[1], -best[0]))
    return out


def paths(r, n):
    words = ["a", "b", "Kick.wav", "kick.wav", "x y", "é", ""]
    some = ["/".join(r.choice(words) for _ in range(r.randint(1, 6))) + r.choice(["", "/index.html"]) for _ in range(n)]
    return [(k, p) for k, p in enumerate(some + [None, "alone.only", some[0].upper(), some[1]])]


@pytest.mark.parametrize("width", [1, 4, 40])
def test_equals_all_pairs(spark, width):
    r = random.Random(width)
    rows = paths(r, 150) + [(1000 + k, f"p{k}/same/long/tail.txt") for k in range(60)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(width))
    try:
        frame = spark.createDataFrame(rows, "k long, path string").repartition(3)
        got = {(x["k"], x["found"], x["parts"]) for x in tails.longest_shared_tails(frame, "k").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plainly(rows)


def test_least_of_stretches():
    values = list("qwertyuiopasdfg")
    least = tails.Least(values)
    assert all(least.between(a, b) == tuple(sorted(values[a:b])[:2]) for a in range(len(values)) for b in range(a + 1, len(values) + 1))
    assert tails.Least(["x"]).between(0, 1) == ("x",)


def test_no_paths(spark):
    assert tails.longest_shared_tails(spark.createDataFrame([], "k long, path string"), "k").count() == 0
