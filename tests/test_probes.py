"""Probed presets: what renders say, and the plans that follow."""

import numpy as np
import pytest

from tonecairn.operators import probes
from tonecairn.sources import configs

yaml = pytest.importorskip("yaml")
RATE = 16000


def render(kind, hold_s, total_s=6.0, hz=220.0, bright=0.0):
    t = np.arange(int(total_s * RATE)) / RATE
    x = np.sin(2 * np.pi * hz * t) + bright * np.sin(2 * np.pi * 6 * hz * t)
    env = np.where(t < hold_s, np.minimum(1, 20 * t), np.exp(-8 * (t - hold_s))) if kind == "pad" else np.exp(-4 * t)
    return 0.4 * x * env


def rows(preset, kind, stereo=False, soft_bright=0.0, classify=True):
    def one(role, note, hold, **more):
        x = render(kind, hold, hz=440 * 2 ** ((note - 69) / 12), **more)
        right = (0.5 * x if stereo else x).tolist()
        return (preset, role, note, RATE, x.tolist(), right, int(hold * RATE))

    out = [one("short", 57, 1.0), one("long", 57, 4.0), one("soft", 57, 4.0, bright=soft_bright), one("low", 33, 4.0)]
    return out + ([one("classify", n, 4.0) for n in (45, 57, 69)] if classify else [])


def test_presets_are_judged_and_planned(spark, tmp_path):
    table = rows("held", "pad", stereo=True, soft_bright=0.9) + rows("struck", "pluck") + [r for r in rows("lost", "pad") if r[1] != "short"] + [("bad", "long", 60, 0, [0.1], None, None), ("bad", "short", 60, 0, [0.1], None, None)]
    renders = spark.createDataFrame(table, probes.RENDERS).repartition(3)
    got = {r["preset"]: r for r in probes.probed(renders).collect()}
    held, struck = got["held"], got["struck"]
    assert (held["sustains"], held["profile"], held["duration_s"], held["release_tail_s"]) == (True, "synth", 8.0, 2.0) and held["side_db"] > -60 and held["velocity_shift"] > 0.03
    assert (struck["sustains"], struck["profile"]) == (False, "pluck") and struck["side_db"] == float("-inf") and struck["duration_s"] < 4 and struck["velocity_shift"] < 0.03
    assert "KeyError" in got["lost"]["error"] and got["bad"]["error"]
    about = spark.createDataFrame([(p, "  type: vst\n  plugin: /x.so\n  preset: " + p, "Bank", None) for p in got], "preset string, source string, subfolder string, performance string")
    done = probes.scan_probed(renders, about, str(tmp_path / "out")).collect()
    assert sorted((r["place"], r["preset"]) for r in done) == [("Bank", "held"), ("Bank", "struck")]
    text = (tmp_path / "out/Bank/struck.yaml").read_text()
    plan = yaml.safe_load(text)
    assert plan["capture"]["mono"] is True and plan["profile"] == "pluck" and "(side identical)" in text
    assert yaml.safe_load((tmp_path / "out/Bank/held.yaml").read_text())["capture"]["velocities"] == configs.VELOCITY_LAYERS
    assert {r["profile"] for r in probes.probed(renders, profile="pad").where("error IS NULL").collect()} == {"pad"}


def test_what_lasts():
    both = lambda kind, hold: np.stack([render(kind, hold)] * 2)
    assert probes.holds(both("pad", 1.0), both("pad", 4.0), 4 * RATE, RATE) and not probes.holds(both("pluck", 1.0), both("pluck", 4.0), 4 * RATE, RATE)
    assert not probes.holds(np.zeros((2, 10)), np.zeros((2, 10)), 4 * RATE, RATE)
