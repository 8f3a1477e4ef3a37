"""Exact quantiles and greedy pairs against plain loops."""

import math
import statistics

import numpy as np
import pytest

from tonecairn.operators import matching, quantiles


@pytest.mark.parametrize("few", [4096, 3])
def test_quantiles_equal_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "SETTLED", few)
    monkeypatch.setattr(quantiles, "BINS", 4096 if few > 3 else 5)
    r = np.random.default_rng(few)
    groups = {"a": r.standard_normal(301), "b": np.repeat([1.0, 2.0], 50), "c": np.array([7.0]), None: r.integers(0, 5, 40).astype(float), "d": np.append(r.exponential(1, 99), 1e12), "e": np.array([])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("a", None), ("e", None)]
    got = {x["k"]: x for x in quantiles.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v", 0.5, 0.2, 0.0, 1.0).collect()}
    assert got.keys() == groups.keys() - {"e"}
    for k, x in groups.items():
        if len(x):
            row = got[k]
            assert row["n"] == len(x) and math.isclose(row["quantile"], statistics.median(x.tolist())) and math.isclose(row["quantile_2"], np.quantile(x, 0.2))
            assert row["quantile_3"] == x.min() and row["quantile_4"] == x.max() and row["upper"] == sorted(x)[math.ceil((len(x) - 1) / 2)]


def z_scores(v):
    return (v - v.mean(0)) / (v.std(0) + 1e-9)


def plain_pairs(ids, z, share=0.2):
    n = len(z)
    d = {(a, b): round(float(np.sqrt(((z[a] - z[b]) ** 2).sum())), 9) for a in range(n) for b in range(a + 1, n)}
    least = [min((d[min(a, b), max(a, b)] for b in range(n) if b != a), default=None) for a in range(n)]
    floor = np.quantile([x for x in least if x is not None], share) if n > 1 else 0
    used, out = set(), set()
    for x, a, b in sorted((x, *sorted((ids[a], ids[b]))) for (a, b), x in d.items()):
        if x >= floor and a not in used and b not in used:
            used |= {a, b}
            out.add((a, b, round(x, 6)))
    return out


def test_pairs_of_rounds_equal_a_loop_over_all(spark, monkeypatch):
    monkeypatch.setattr(matching, "_BLOCK", 16)
    r = np.random.default_rng(3)
    groups = {1: r.standard_normal((90, 4)), 2: np.vstack([r.standard_normal((20, 4))] * 2), 3: r.standard_normal((1, 4)), None: np.arange(30.0)[:, None] * np.ones(4)}
    rows, want, start = [], set(), 0
    for label, v in groups.items():
        ids = list(range(start, start + len(v)))
        r.shuffle(ids)
        z = z_scores(v) if len(v) > 1 else v
        rows += [(label, i, x.tolist()) for i, x in zip(ids, z)]
        want |= {(label, *p) for p in plain_pairs(ids, z)}
        start += len(v)
    frame = spark.createDataFrame(rows, "label int, vec_id long, z array<double>")
    got = {(x["label"], x["a"], x["b"], round(x["distance"], 6)) for x in matching.match_groups(frame, k=2).collect()}
    assert got == want
    assert matching.match_groups(frame.limit(0)).count() == 0


def test_nearest_rows_equal_all_distances():
    """With ties, equal vectors, far ones and a floor that is one of the distances."""
    r = np.random.default_rng(5)
    for v in (r.standard_normal((60, 8)), np.vstack([r.standard_normal((15, 8))] * 3), 1e4 + r.standard_normal((40, 8)), np.arange(30.0)[:, None] * np.ones(4)):
        ids = r.permutation(len(v))
        d = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)), 9)
        for k in (1, 3, 100):
            for floor in (0.0, float(np.sort(d.ravel())[len(v) * 4])):
                row, column, distance, more = matching.nearest_rows(v, ids, v, ids, floor, k)
                for i in range(len(v)):
                    want = sorted((x, b) for x, b in zip(d[i].tolist(), ids.tolist()) if x >= floor and b != ids[i])
                    assert list(zip(distance[row == i].tolist(), ids[column[row == i]].tolist())) == want[:k]
                    assert more[i] == (len(want) > k)


def test_a_vector_is_sent_a_bounded_number_of_times(spark):
    """Up to 131,072 vectors of a label there are eight blocks at most, so what is sent grows with the input."""
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.createDataFrame([(n,) for n in (1, 256, 2000, 5000, 60_000, 131_072, 300_000)], "n long").select(matching.blocks_of(F.col("n"), 256)).collect()]
    assert got == [1, 1, 8, 8, 8, 8, 19]
