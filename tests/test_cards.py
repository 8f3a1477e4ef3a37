"""Libraries read as far as a sink plays them; presets that appear whole or not at all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonecairn.sources import cards, riff

WAV = riff.encode(48000, np.ones((2, 50)) / 4, 16, loop=(5, 40))


@pytest.fixture
def library(spark, tmp_path):
    cards.register(spark)
    for folder in ("a", "b/c"):
        (tmp_path / folder).mkdir(parents=True)
        for note in ("C3", "C4", "C5"):
            for v in (40, 90, 127):
                for take in (1, 2):
                    # only what may be opened is a WAV file
                    (tmp_path / folder / f"x_{note}_V{v}_RR{take}.wav").write_bytes(WAV if (note, v, take) == ("C4", 90, 1) else b"not to be opened")
    (tmp_path / "a/.hidden.wav").write_bytes(WAV)
    return spark.read.format("sample_library").option("path", str(tmp_path)).load()


def test_conditions_keep_files_shut(library):
    assert library.count() == 36 and library.where("error IS NOT NULL").count() == 34
    got = library.where("note = 60 AND velocity > 50 AND velocity <= 100 AND take IN (1) AND frames = 50").collect()
    assert len(got) == 2 and {r["folder"] for r in got} == {"a", "b/c"} and all(r["error"] is None and (r["loop_start"], r["loop_end"], r["rate"]) == (5, 40, 48000) for r in got)
    opened = library.where("note = 60 AND take < 2 AND velocity >= 90 AND velocity <> 127")  # <> is left to Spark: two files a folder are opened
    assert sorted(r["velocity"] for r in opened.collect()) == [90, 90]
    assert library.where("note = 60 AND take = 1 AND velocity = 90 AND error IS NOT NULL").count() == 0


def test_sinks_say_what_they_play(library):
    assert cards.SINKS["deluge"].velocities_used([40, 127, 90]) == [90] and cards.SINKS["bento"].velocities_used([127, 40]) == [40, 127] and cards.Plays().velocities_used([90, 110]) == [110]
    assert cards.SINKS["bento_kit"].notes_used([36, 48, 72]) == [48] and cards.SINKS["deluge"].notes_used([3, 1]) == [1, 3] and cards.Plays().velocities_used([]) == []
    assert cards.for_sink(library, "deluge", [40, 90, 127], [48, 60, 72]).count() == 6
    assert cards.for_sink(library, "bento", [40, 90, 127], [48, 60, 72]).count() == 18
    kit = cards.for_sink(library, "deluge_kit", [40, 90, 127], [48, 60, 72])
    assert [r["error"] for r in kit.collect()] == [None, None]
    plan = kit._jdf.queryExecution().executedPlan().toString()
    assert "PythonFilters" in plan or "PushedFilters" in plan or "Filter (" not in plan


def test_names():
    assert [cards.named(s) for s in ("Horn_Db4_3", "x_V07_RR2", "A0")] == [{"note": 61, "velocity": 100, "take": 3}, {"note": None, "velocity": 7, "take": 2}, {"note": 21, "velocity": 100, "take": 1}]


def presets(spark, names, bad=None):
    rows = spark.createDataFrame([(p, f"{k}.wav", bytes([k])) for p in names for k in range(3)], "preset string, file string, content binary")
    if bad:
        rows = rows.withColumn("content", F.when(F.col("preset") == bad, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    return rows


def below(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())


def test_presets_appear_whole_or_not_at_all(spark, tmp_path):
    out = tmp_path / "card"
    out.mkdir()
    cards.write_presets(presets(spark, ["SYNTHS/A", "SYNTHS/B"]), str(out))
    first = [f"SYNTHS/{p}/{k}.wav" for p in "AB" for k in range(3)]
    assert below(out) == first
    with pytest.raises(Exception, match="lost"):  # one task fails: nothing of the other presets is left either
        cards.write_presets(presets(spark, ["KITS/C", "KITS/D", "KITS/E"], bad="KITS/D"), str(out))
    assert below(out) == first and not [p for p in out.iterdir() if p.name.startswith(".")]
    with pytest.raises(Exception, match="there already"):
        cards.write_presets(presets(spark, ["KITS/C", "SYNTHS/A"]), str(out))
    assert below(out) == first
    cards.write_presets(presets(spark, ["SYNTHS/A"]).where("file = '0.wav'"), str(out), overwrite=True)
    assert below(out) == ["SYNTHS/A/0.wav", *first[3:]]
    with pytest.raises(Exception, match="several tasks"):
        presets(spark, ["KITS/Z"]).repartition(3, "file").write.format("preset_folders").option("path", str(out)).mode("append").save()
    assert below(out) == ["SYNTHS/A/0.wav", *first[3:]]


def test_documents_of_devices(spark, tmp_path):
    rows = [("p", "SYNTHS/x/p.xml", "<a/>", None), ("q", "SYNTHS/y/q.xml", None, "ValueError: no")]
    cards.write_documents(spark.createDataFrame(rows, "preset string, path string, document string, error string"), str(tmp_path))
    assert below(tmp_path) == ["SYNTHS/x/p.xml"] and (tmp_path / "SYNTHS/x/p.xml").read_text() == "<a/>"
