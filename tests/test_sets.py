import numpy as np

from tonecairn.operators import sets

RATE = 16000  # with whole lags, a rate of 8000 is too coarse for the pitch of these tones
T = np.arange(4 * RATE) / RATE


def test_set_analysis(spark):
    tone = lambda hz: (0.25 * np.sin(2 * np.pi * hz * T)).tolist()
    rows = [("pad", k, 57 + k, v, 1, RATE, tone(220 * 2 ** (k / 12)), None) for k in range(3) for v in (60, 110)]
    rows = [(s, 10 * i, *rest) for i, (s, _, *rest) in enumerate(rows)]
    rows += [("perc", 1, 60, 100, 1, RATE, (np.sin(2 * np.pi * 60 * T) * np.exp(-20 * T)).tolist(), 3 * RATE), ("perc", 2, 61, 100, 1, RATE, None, None), ("bad", 3, 60, 100, 1, 0, [0.5] * 100, None)]
    frame = spark.createDataFrame(rows, "set_id string, sample_id long, note int, velocity int, take int, rate int, xs array<double>, note_off long")
    got = sets.analyse(frame, drums=True).cache()
    by = {(r["set_id"], r["sample_id"]): r for r in got.collect()}
    assert by["pad", 0]["pitch_ok"] and by["pad", 0]["classification"] == "sustained" and by["pad", 0]["loop_end"] > by["pad", 0]["loop_start"]
    assert by["perc", 1]["classification"] == "pluck" and by["perc", 1]["drum"] == "kick" and by["perc", 1]["loop_end"] is None
    assert by["bad", 3]["error"] and by["perc", 2]["error"] is None
    verdict = {r["set_id"]: (r["verdict"], r["profile"]) for r in sets.verdicts(got).collect()}
    assert verdict == {"pad": ("Sustained", "synth"), "perc": ("Pluck", "pluck")}
    assert all(abs(r["gain"] * 0.25 - 10 ** -0.05) < 1e-3 for r in sets.with_set_gain(got).where("set_id = 'pad'").collect())
    assert {r["velocity"] for r in sets.shipped(got).where("set_id = 'pad'").collect()} == {110}
    assert sets.loop_report(got).count() == 0
