"""Loops of whole periods against plain comparisons of all ends; steps of timbre against a plain transform."""

import math
import os
import statistics

import numpy as np
import pytest

from tonecairn.operators import loops
from tonecairn.plans import seams


def plain_mismatch(x, start, width, end):
    a, b = x[start - width : start], x[end - width : end]
    return math.sqrt(sum((p - q) ** 2 for p, q in zip(a, b)) / sum(p * p for p in a))


def test_curve_and_energy_equal_plain_sums():
    r = np.random.default_rng(1)
    x = r.standard_normal(400)
    curve = loops.mismatch_curve(x, 60, 25, 61, 400)
    assert np.allclose(curve, [plain_mismatch(x, 60, 25, e) for e in range(61, 401)])
    assert np.allclose(loops.moving_energy(x, 7), [sum(v * v for v in x[k : k + 7]) for k in range(394)])
    for bad in ((10, 25, 61, 400), (60, 25, 20, 400), (60, 25, 80, 80), (60, 25, 61, 401)):
        assert loops.mismatch_curve(x, *bad) is None
    assert loops.mismatch_curve(np.zeros(400), 60, 25, 61, 400) is None


def plain_periods(x, start, width, least, most, target, limit):
    def cleanest(low, high):
        if high <= low or start + low < width or start + high > len(x):
            return None
        return min((plain_mismatch(x, start, width, e), e) for e in range(start + low, start + high + 1))

    first = cleanest(least, min(most, limit - width - start))
    if first is None:
        return None
    taken, period = first, first[1] - start
    for k in range(2, 6):
        if k * period <= target and (again := cleanest(k * period - max(width, period // 8), k * period + max(width, period // 8))):
            if again[0] <= max(1.5 * first[0], first[0] + 0.05) and again[1] < limit - width:
                taken = again
    return taken[1], taken[0]


def test_whole_periods_equal_a_search_of_all_ends():
    r = np.random.default_rng(2)
    longer = 0
    for k in range(60):
        period = int(r.integers(20, 70))
        x = np.tile(r.standard_normal(period), 12)[:600] + (k % 3) * 0.05 * r.standard_normal(min(600, 12 * period))
        args = (100 + k, 16, 15, 80, 300, len(x) - (k % 5) * 40)
        got, want = loops.whole_periods(x, *args), plain_periods(x, *args)
        assert (got is None) == (want is None) and (got is None or (abs(got[1] - want[1]) < 1e-6 and (k % 3 == 0 or got[0] == want[0])))
        longer += got is not None and got[0] - args[0] > 80
    assert longer > 10


RATE = 4000


def test_an_aligned_loop_is_offered_first():
    t = np.arange(8 * RATE) / RATE
    x = np.sin(2 * np.pi * 220 * t) * (1 + 0.4 * np.sin(2 * np.pi * 2.5 * t))  # beats every 0.4 s
    found = loops.aligned(x, RATE, RATE // 2, 7 * RATE, round(RATE / 220))
    assert found and found.seam < 0.05 and abs((found.end - found.start) / RATE / 0.4 - round((found.end - found.start) / RATE / 0.4)) < 0.02
    assert found.end - found.start > 1.5 * RATE  # several cycles, not one
    first = loops.ranked(x, RATE, RATE // 2, 7 * RATE, note=57)
    assert first[0].source == "aligned" and len({(c.start, c.end) for c in first}) == len(first) <= 5
    slow = loops.ranked(x, RATE, RATE // 2, 7 * RATE, note=57, modulation=int(6.5 * RATE))
    assert all(c.source != "aligned" for c in slow)
    noise = np.random.default_rng(3).standard_normal(8 * RATE)
    assert loops.aligned(noise, RATE, RATE // 2, 7 * RATE) is None and loops.aligned(np.zeros(8 * RATE), RATE, RATE // 2, 7 * RATE) is None
    assert loops.aligned(x[:100], RATE, 0, 100) is None


def test_first_loop_is_not_repeated():
    a, b, c = (loops.Loop(k, k + 10, "x") for k in range(3))
    lead = loops.Loop(1, 11, "aligned")
    assert loops.led_by(lead, [a, b, c], 5) == [lead, a, c] and loops.led_by(lead, [a, b, c], 2) == [lead, a] and loops.led_by(None, [a, b, c], 2) == [a, b]


def test_crossings_go_the_asked_way():
    x = np.array([1.0, 2, 1, -1, -2, -1, 1, 2, 1, -1, -2])
    assert loops.directed_crossing(x, 5, True, 5) == 5 and loops.directed_crossing(x, 5, False, 5) == 2 and loops.directed_crossing(np.ones(9), 4, True, 3) == 4


def plain_cepstrum(x, rate, bands=26, kept=13):
    n = len(x)
    w = [v * (0.5 - 0.5 * math.cos(2 * math.pi * k / (n - 1))) for k, v in enumerate(x)]
    power = []
    for f in range(n // 2 + 1):
        re, im = (sum(v * g(2 * math.pi * f * k / n) for k, v in enumerate(w)) for g in (math.cos, math.sin))
        power.append(re * re + im * im)
    mel = [2595 * math.log10(1 + rate / 2 / 700) * k / (bands + 1) for k in range(bands + 2)]
    edge = [700 * (10 ** (m / 2595) - 1) for m in mel]
    log = []
    for a, b, c in zip(edge, edge[1:], edge[2:]):
        log.append(math.log(sum(p * max(0.0, min((f * rate / n - a) / (b - a), (c - f * rate / n) / (c - b))) for f, p in enumerate(power)) + 1e-10))
    return [sum(v * math.cos(math.pi / bands * (k + 0.5) * q) for k, v in enumerate(log)) for q in range(kept)]


def plain_step(x, start, end, width, rate):
    if start < 0 or end > len(x) or end - width < start + width:
        return None
    return math.dist(plain_cepstrum(x[start : start + width], rate), plain_cepstrum(x[end - width : end], rate))


def test_votes_of_sets_equal_a_plain_transform(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    signals = {}
    for r in seams.frames(spark, folder).orderBy("sample_id", "i").collect():
        signals.setdefault(r["sample_id"], []).append(r["x"])
    steps = {}
    for i, x in signals.items():
        steps.setdefault(i % 7, []).append(plain_step(x, len(x) // 4, 3 * len(x) // 4, 12, 8000))
    got = {r["set_id"]: r for r in seams.unloopable_sets(spark, folder).collect()}
    assert got.keys() == steps.keys()
    for k, found in steps.items():
        found = [s for s in found if s is not None]
        assert got[k]["votes"] == len(found)
        assert (got[k]["median_step"] is None) == (not found)
        if found:
            assert abs(got[k]["median_step"] - statistics.median(found)) < 1e-5 and got[k]["unloopable"] == (len(found) >= 3 and statistics.median(found) > 16)
