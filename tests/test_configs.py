"""Plans as YAML: profiles under plans under defaults, errors per file, texts written and read back."""

import pytest

yaml = pytest.importorskip("yaml")

from tonecairn.sources import configs  # noqa: E402

PLAN = """source:
  type: sfz
  path: ../lib/Big Res /a.sfz
profile: drums
capture:
  note_step: 2
analysis:
  loop_qulity_threshold: 1
output:
  name: "Kit: one"
"""


def test_plans_are_laid_over_profiles_and_defaults(spark, tmp_path):
    (tmp_path / "p q").mkdir()
    (tmp_path / "p q/a.yaml").write_text(PLAN)
    (tmp_path / "b.yaml").write_text("source: {type: library, path: /abs, files: [x.wav]}\noutput: {name: B}\nperformance: {voice_mode: odd, glide: 0.25}\n")
    for name, text in {"none": "a: [", "type": "source: {type: tape}\noutput: {name: x}", "field": "source: {type: clap, plugin: x}\noutput: {name: x}", "profile": "profile: no\nsource: {type: sfz, path: x}\noutput: {name: x}"}.items():
        (tmp_path / f"bad_{name}.yaml").write_text(text)
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in configs.plans(spark, str(tmp_path)).collect()}
    a, b = rows["a.yaml"], rows["b.yaml"]
    assert (a["category"], a["note_step"], a["velocities"], a["duration_s"], a["classify_drums"], a["low"], a["high"]) == ("drum", 2, [64, 100, 127], 2.0, True, 21, 108)
    assert a["source_path"] == f"{tmp_path}/lib/Big Res /a.sfz" and a["unknown"] == ["analysis.loop_qulity_threshold"] and a["name"] == "Kit: one"
    assert (b["files"], b["voice_mode"], b["glide"], b["loop_quality_threshold"], b["loop_crossfade_ms"], b["error"]) == ([f"{tmp_path}/x.wav"], "poly", 0.25, 0.8, None, None)
    assert [bool(rows[f"bad_{n}.yaml"]["error"]) for n in ("none", "type", "field", "profile")] == [True] * 4
    assert configs.with_profile(configs.plans(spark, str(tmp_path)), "drums").count() == 1 and configs.few(configs.plans(spark, str(tmp_path)), 3).count() == 3
    assert {r["profile"]: r["settings"]["capture.duration_s"] for r in configs.profiles(spark).collect()} == {"drums": "2", "pad": "8", "pluck": "2", "synth": "4"}


def test_texts_are_written_once_each_and_read_back(spark, tmp_path):
    source = "  type: vst\n  plugin: /p.so\n"
    ddl = "place string, preset string, source string, profile string, flags array<string>, confidence string, sustains boolean, duration_s double, release_tail_s double, side_db double, velocity_shift double, low int, high int, note_step int, sample_rate int, subfolder string, performance string"
    rows = [
        ("x", "BANKS,T.", source, "pad", ["odd", "low"], "low", True, 8.0, 5.0, -70.0, 0.1, 24, 96, 3, 44100, 'a"b', "performance:\n  glide: 0.5\n"),
        ("x", "BANKS T", source, "pad", [], "high", False, 2.0, 1.0, None, None, 24, 96, 3, 48000, None, None),
        (None, "BANKS T", source, "drums", [], "high", False, 2.0, 1.0, float("-inf"), 0.2, 24, 96, 3, 48000, "", None),
        ("x", "BANKS_T_2", source, "pad", [], "high", False, 2.0, 1.0, 3.4, 0.01, 24, 96, 3, 48000, None, None),
    ]
    p = spark.createDataFrame(rows, ddl)
    done = configs.write_plans(p.select("place", "preset", configs.plan_text(p).alias("text")), str(tmp_path / "out")).collect()
    names = sorted(r["path"].removeprefix(f"{tmp_path}/out/") for r in done)
    assert names == ["BANKS_T.yaml", "x/BANKS_T.yaml", "x/BANKS_T_2.yaml", "x/BANKS_T_2_2.yaml"]
    again = configs.write_plans(p.where("preset = 'BANKS T' and place = 'x'").select("place", "preset", configs.plan_text(p).alias("text")), str(tmp_path / "out")).collect()
    assert again[0]["path"].endswith("x/BANKS_T_3.yaml")
    texts = {r["preset"] + (r["place"] or ""): open(r["path"]).read() for r in done}
    first = texts["BANKS,T.x"]
    assert first.startswith("# REVIEW: odd, low\n# confidence=low sustains=yes release=5.0s channels=mono (side -70 dB) velocity_shift=0.100 (sensitive)\nsource:\n")
    read = yaml.safe_load(first)
    assert read["capture"] == {"sample_rate": 44100, "note_range": [24, 96], "note_step": 3, "duration_s": 8.0, "release_tail_s": 5.0, "mono": True, "velocities": [40, 90, 127]}
    assert read["output"] == {"name": "BANKS,T.", "subfolder": 'a"b'} and read["performance"] == {"glide": 0.5}
    drums = texts["BANKS T"]
    assert "(side identical)" in drums and "velocities" not in drums and "note_range" not in drums
    plans = configs.plans(spark, str(tmp_path / "out")).collect()
    assert len(plans) == 5 and not any(r["error"] for r in plans)
