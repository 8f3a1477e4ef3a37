"""Audio that is written: tables, sets, dumps, candidates, and plans run as a batch."""

import numpy as np
import pytest

from tonecairn.sources import configs, riff, writers

RATE = 16000
T = np.arange(4 * RATE) / RATE


def test_tables_as_devices_load_them():
    one = 0.25 * np.sin(np.arange(2 * 2048 + 100) / 50)
    whole = riff.encode(48000, one[None, :4096], 16)
    assert writers.table_bytes(whole) == whole
    marked = riff.with_chunk(riff.encode(48000, one[None], 16), b"clm ", b"<!>2048", before=b"data")
    assert [k for k, _, _ in riff.chunks(marked)] == [b"fmt ", b"clm ", b"data"] and writers.table_bytes(marked) == marked
    for raw in (riff.encode(48000, one[None], 24), riff.with_chunk(riff.encode(48000, np.stack([one, one]), 24), b"clm ", b"x")):
        out = writers.table_bytes(raw)
        form, data = writers.channels_of(out)
        assert form.channels == 1 and data.shape[1] == 4096 and abs(np.abs(data).max() - 1) < 1e-4 and riff.chunk(out, b"clm ") == riff.chunk(raw, b"clm ")
    with pytest.raises(ValueError):
        writers.table_bytes(b"none")


def test_names_within_a_preset():
    taken = set()
    assert [writers.unique_name(p, taken) for p in ("a/1.wav", "b/1.wav", "x/b/1.wav", "c/b/1.wav")] == ["1.wav", "b_1.wav", "b_2_1.wav", "b_3_1.wav"]


def test_sets_and_dumps(spark, tmp_path):
    tone = (0.25 * np.sin(2 * np.pi * 220 * T[:RATE])).tolist()
    quiet = [0.0] * 4096 + tone + [0.0] * 4096
    rows = [("p", 60, 100, 1, RATE, tone, tone, False), ("p", 61, 100, 2, RATE, quiet, None, True), ("q", 60, 1, 1, 0, tone, None, True)]
    frame = spark.createDataFrame(rows, "set_id string, note int, velocity int, take int, rate int, ch0 array<double>, ch1 array<double>, mono boolean")
    done = {(r["set_id"], r["note"]): r for r in writers.write_wav_set(frame, str(tmp_path / "set")).collect()}
    assert done["p", 60]["path"].endswith("set/p/note060_T120_V100_RR1.wav") and done["p", 60]["frames"] == RATE and done["q", 60]["error"]
    assert riff.wav_format(open(done["p", 61]["path"], "rb").read()).channels == 1
    dump = {r["note"]: r for r in writers.dump_classified(frame.where("set_id = 'p'"), str(tmp_path / "dump")).collect()}
    form, data = writers.channels_of(open(dump[61]["path"], "rb").read())
    assert dump[61]["path"].endswith("dump/p/n061_v100_rr02.wav") and form.codec == riff.FLOAT and abs(20 * np.log10(np.abs(data).max()) + 1) < 0.01 and data.shape[1] < len(quiet) - 6000


def test_all_candidates(spark, tmp_path):
    rows = [("p", 1, 57, RATE, (0.25 * np.sin(2 * np.pi * 220 * T)).tolist()), ("p", 2, 57, RATE, None)]
    found = writers.loop_candidates(spark.createDataFrame(rows, "set_id string, sample_id long, note int, rate int, xs array<double>"))
    found.write.json(str(tmp_path / "lines"))
    back = spark.read.json(str(tmp_path / "lines"))
    assert back.count() > 5 and back.where("stop <= start").count() == 0 and back.select("rank").distinct().count() == back.count()


def test_plans_run_as_a_batch(spark, tmp_path):
    pytest.importorskip("yaml")
    lib, plans = tmp_path / "lib", tmp_path / "plans"
    lib.mkdir(), plans.mkdir()
    (lib / "a.wav").write_bytes(riff.encode(192000, np.zeros((2, 400)), 24, loop=(10, 301)))
    (lib / "t.wav").write_bytes(riff.encode(48000, np.ones((2, 5000)) / 2, 16))
    (lib / "k.sfz").write_text("<region> sample=a.wav key=60 loop_mode=loop_continuous\n<region> sample=gone.wav key=61")
    for name, text in {
        "1": f"source: {{type: sfz, path: {lib}/k.sfz}}\noutput: {{name: K, subfolder: S}}", "2": f"source: {{type: sfz, path: {lib}/k.sfz}}\noutput: {{name: K, subfolder: S}}",
        "3": f"source: {{type: wavetable, path: {lib}/t.wav}}\noutput: {{name: T}}", "4": "source: {type: vst, plugin: /x}\noutput: {name: V}",
        "5": f"source: {{type: library, path: {lib}, files: [{lib}/a.wav, {lib}/t.wav]}}\noutput: {{name: L}}", "6": f"source: {{type: granular, path: {lib}/none.wav}}\noutput: {{name: G}}", "7": "broken: [",
    }.items():
        (plans / f"{name}.yaml").write_text(text)
    run = lambda: {(r["plan"][-6], r["status"], (r["file"] or "")[len(str(tmp_path)) + 5 :]): r for r in writers.run_plans(configs.plans(spark, str(plans)), str(tmp_path / "out")).collect()}
    got = run()
    assert {k for k in got} == {
        ("1", "written", "S/K/a.wav"), ("2", "collision", ""), ("3", "written", "T/t.wav"), ("4", "failed", ""), ("5", "written", "L/a.wav"), ("5", "written", "L/t.wav"), ("6", "failed", ""), ("7", "failed", ""),
    }
    k = got["1", "written", "S/K/a.wav"]
    assert (k["loop_start"], k["loop_stop"], k["frames"], k["note"]) == (5, 150, 200, 60)
    assert got["3", "written", "T/t.wav"]["frames"] == 4096 and "host" in got["4", "failed", ""]["error"]
    assert {s for _, s, _ in run()} == {"exists", "collision", "failed"}
    # what fails leaves nothing, and what was left half is written anew
    assert not [p for p in (tmp_path / "out").rglob(".staged*")] and not (tmp_path / "out/G").exists()
    (tmp_path / "out/T/_done").unlink()
    (tmp_path / "out/T/half.wav").write_bytes(b"x")
    assert [s for p, s, _ in run() if p == "3"] == ["written"] and sorted(p.name for p in (tmp_path / "out/T").iterdir()) == ["_done", "t.wav"]
