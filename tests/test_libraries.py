"""What plans of libraries play, and plans of archives run as a batch."""

import io
import zipfile

import numpy as np
import pytest

from tonecairn.functions import labels
from tonecairn.sources import configs, libraries, riff, writers

yaml = pytest.importorskip("yaml")
WAV = riff.encode(48000, np.ones((2, 50)) / 4, 16)


def library(root, names):
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_bytes(WAV)


def played(spark, folder, **source):
    folder.mkdir(exist_ok=True)
    capture = source.pop("capture", {})
    (folder / "plan.yaml").write_text(yaml.safe_dump({"source": {"type": "library", **source}, "capture": {"note_step": 1, **capture}, "output": {"name": "x"}}))
    rows = libraries.samples(configs.plans(spark, str(folder))).collect()
    return sorted((r["note"], r["take"], r["instrument"], r["file"].rsplit("/", 1)[-1]) for r in rows if r["error"] is None), [r["error"] for r in rows if r["error"]]


def test_kinds_of_libraries(spark, tmp_path):
    library(tmp_path / "notes", ["a_C3.wav", "a_C#3.wav", "a_E3.wav", "a_E3_1.wav", "a_E3_2.WAV", "a_E3_3.wav", "readme_x.wav"])
    got, _ = played(spark, tmp_path / "p1", path=str(tmp_path / "notes"), capture={"round_robins": 2, "note_step": 3})
    assert got == [(48, 1, None, "a_C3.wav"), (52, 1, None, "a_E3_1.wav"), (52, 2, None, "a_E3_2.WAV")]
    assert [n for n, *_ in played(spark, tmp_path / "p1", path=str(tmp_path / "notes"))[0]] == [48, 49, 52]
    assert played(spark, tmp_path / "p2", path=str(tmp_path / "notes/a_C3.wav"), note=40)[0] == [(40, 1, None, "a_C3.wav")]
    assert played(spark, tmp_path / "p2", path=str(tmp_path / "notes/a_C3.wav"))[0] == [(60, 1, None, "a_C3.wav")]
    hits = ["Snare.wav", "Kick 2.wav", "Kick 1.wav", "zap.wav", "Tom_V01_RR1.wav", "Tom_V02_RR2.wav", "Tom_V02_RR1.wav", "Tom_V03_RR1.wav", "Clap_V05_RR1.wav"]
    library(tmp_path / "hits", hits)
    got, _ = played(spark, tmp_path / "p3", path=str(tmp_path / "hits"), drumkit=True)
    assert [f for *_, f in got] == ["Kick 1.wav", "Kick 2.wav", "Snare.wav", "Clap_V05_RR1.wav", "Tom_V02_RR1.wav", "zap.wav"] and [n for n, *_ in got] == list(range(6))
    got, _ = played(spark, tmp_path / "p4", path=str(tmp_path / "hits"), files=[str(tmp_path / "hits" / f) for f in ("zap.wav", "Kick 2.wav")])
    assert [(n, f) for n, _, _, f in got] == [(0, "Kick 2.wav"), (1, "zap.wav")]
    library(tmp_path / "by", ["A3/2.wav", "A3/1.wav", "C4/x.wav", "other/y.wav"])
    assert played(spark, tmp_path / "p5", path=str(tmp_path / "by"))[0] == [(57, 1, "A3", "1.wav"), (60, 1, "C4", "x.wav")]
    library(tmp_path / "kit", ["Snare/1.wav", "Kick/b.wav", "Kick/a.wav", "Cymbals/Ride 1.wav", "Cymbals/Ride 2.wav", "Cymbals/China 1.wav", "Cymbals/Crash 2.wav", "Cymbals/HiHat.wav", "empty.txt"])
    got, _ = played(spark, tmp_path / "p6", path=str(tmp_path / "kit"), capture={"round_robins": 9})
    assert got == [
        (0, 1, "Kick", "a.wav"), (0, 2, "Kick", "b.wav"), (1, 1, "Snare", "1.wav"), (2, 1, "Cymbals/cymbal_crash", "Crash 2.wav"), (2, 2, "Cymbals/cymbal_crash", "China 1.wav"),
        (2, 3, "Cymbals/cymbal_crash", "HiHat.wav"), (3, 1, "Cymbals/cymbal_ride", "Ride 1.wav"), (3, 2, "Cymbals/cymbal_ride", "Ride 2.wav"),
    ]
    (tmp_path / "nothing").mkdir()
    got, errors = played(spark, tmp_path / "p7", path=str(tmp_path / "nothing"))
    assert got == [] and "no WAV files" in errors[0]


def test_archives_and_folders_run_as_plans(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("multisample.xml", '<multisample><sample file="A.wav"><key root="60" low="0" high="62"/></sample><sample file="gone.wav"><key root="64"/></sample></multisample>')
        z.writestr("a.wav", riff.encode(48000, np.ones((2, 50)) / 4, 16, loop=(5, 40)))
    (tmp_path / "b.multisample").write_bytes(buffer.getvalue())
    library(tmp_path / "lib", ["x_C3.wav", "x_C4.wav"])
    (tmp_path / "plans").mkdir()
    for k, text in enumerate((f"source: {{type: bitwig, path: {tmp_path}/b.multisample}}\noutput: {{name: B}}", f"source: {{type: library, path: {tmp_path}/lib}}\noutput: {{name: L}}", f"source: {{type: library, path: {tmp_path}/none}}\noutput: {{name: N}}")):
        (tmp_path / f"plans/{k}.yaml").write_text(text)
    got = writers.run_plans(configs.plans(spark, str(tmp_path / "plans")), str(tmp_path / "out")).collect()
    rows = sorted((r["name"], r["status"], r["note"] or 0, r["loop_start"] or 0) for r in got)
    assert rows == [("B", "written", 60, 5), ("L", "written", 48, 0), ("L", "written", 60, 0), ("N", "failed", 0, 0)]
    assert sorted(p.name for p in (tmp_path / "out/B").glob("*.wav")) == ["A.wav"] and len(list((tmp_path / "out/L").glob("*.wav"))) == 2


def test_numbered_takes(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a_C3",), ("a_C3_2",), ("b",)], "s string").select(labels.parsed_note(F.col("s")).alias("p")).collect()
    assert [None if r["p"] is None else tuple(r["p"]) for r in rows] == [(48, 1, False), (48, 2, True), None]
