"""From folders of WAV files to plans, read back."""

import zipfile

import numpy as np
import pytest

from tonecairn.operators import folders, kits
from tonecairn.sources import configs, riff

yaml = pytest.importorskip("yaml")
RATE = 8000
T = np.arange(2 * RATE) / RATE


def wav(hz=220.0, seconds=2.0, loop=None, decay=0.0, rate=RATE):
    t = np.arange(int(seconds * rate)) / rate
    x = 0.5 * np.sin(2 * np.pi * hz * t) * np.exp(-decay * t)
    return riff.encode(rate, np.stack([x, x]), 16, loop=loop)


def put(path, raw):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(raw)


def plans(spark, out):
    return {r["name"]: r for r in configs.plans(spark, str(out)).collect()}


def test_libraries_of_notes(spark, tmp_path):
    lib, out = tmp_path / "lib", tmp_path / "out"
    for n, hz in (("C3", 130.8), ("C4", 261.6), ("C5", 523.3), ("C6", 1046.5)):
        put(lib / f"Long One/x_{n}.wav", wav(hz, rate=32000))
        put(lib / f"Short One/y_{n}.WAV", wav(hz, decay=12, rate=32000))
    put(lib / "Broken/a.wav", b"nothing")
    put(lib / ".hidden/a.wav", wav())
    done = folders.scan_library(spark, str(lib), str(out)).collect()
    assert sorted(r["preset"] for r in done) == ["Broken", "Long One", "Short One"]
    got = plans(spark, out)
    assert (got["Long One"]["profile"], got["Short One"]["profile"], got["Broken"]["profile"]) == ("synth", "pluck", "synth")
    text = yaml.safe_load((out / "Long_One.yaml").read_text())
    assert text["analysis"] == {"trim": False, "normalize": "none"} and text["capture"] == {"note_range": [24, 84], "note_step": 3} and text["source"] == {"type": "library", "path": f"{lib}/Long One"}
    # an author's loops are believed, and nothing is listened to
    put(lib / "Short One/y_C4.WAV", wav(261.6, decay=12, loop=(100, 900), rate=32000))
    folders.scan_library(spark, str(lib), str(tmp_path / "two")).collect()
    got = plans(spark, tmp_path / "two")
    assert (got["Long One"]["profile"], got["Short One"]["profile"], got["Short One"]["loop_detect"]) == ("pluck", "synth", False)
    forced = folders.scan_library(spark, str(lib), str(tmp_path / "three"), profile="pad", audio="processed", loop_detect="on", note_step=5)
    assert forced.count() == 3 and {r["profile"] for r in plans(spark, tmp_path / "three").values()} == {"pad"}


def test_libraries_of_hits(spark, tmp_path):
    lib, out = tmp_path / "lib", tmp_path / "out"
    for f in ("Kit A/Kick 1.wav", "Kit A/Snare.wav", "Kit B/Kick 1.wav", "Kit B/Kick 2.wav", "Kit C/zap.wav", "Kit D/Kick/1.wav", "Kit D/Snare/1.wav"):
        put(lib / f, wav())
    assert folders.scan_library(spark, str(lib), str(out), "kit").count() == 4
    texts = {p.stem: p.read_text() for p in out.glob("*.yaml")}
    assert "# REVIEW" not in texts["Kit_A"] and "all 2 files classified as 'kick'" in texts["Kit_B"] and "no drum/percussion" in texts["Kit_C"]
    assert all(("drumkit: true" in texts[k]) == (k != "Kit_D") for k in texts) and all(yaml.safe_load(t)["profile"] == "drums" and "analysis" not in yaml.safe_load(t) for t in texts.values())


def test_single_notes(spark, tmp_path):
    folder, out = tmp_path / "shots", tmp_path / "out"
    put(folder / "Mono Bass - A - 01.wav", wav(220, rate=16000))
    put(folder / "Pluck.wav", wav(220, decay=12, rate=16000))
    put(folder / "Looped.wav", wav(220, decay=12, loop=(10, 500), rate=16000))
    put(folder / "Silent - F#.wav", riff.encode(16000, np.zeros((2, 16000)), 16))
    put(folder / "none.wav", b"x")
    assert folders.scan_oneshots(spark, str(folder), str(out), loop_detect="on").count() == 4
    got = {n: yaml.safe_load((out / f"{n}.yaml").read_text()) for n in ("Mono_Bass_A_01", "Pluck", "Looped", "Silent_F")}
    assert [got[n]["source"]["note"] for n in got] == [57, 57, 57, 54] and [got[n]["profile"] for n in ("Mono_Bass_A_01", "Pluck", "Looped")] == ["synth", "pluck", "synth"]
    assert "pitch detection failed" in (out / "Silent_F.yaml").read_text()


def test_roots_of_single_notes():
    assert [folders.letter_class(s) for s in ("x - F - 016", "Bass_c#", "Db tone", "Bass", "Hb", "")] == [5, 1, 1, None, None, None]
    assert folders.single_note(None, None) == (60, "pitch detection failed — defaulted to C4, verify root note manually")
    assert folders.single_note(None, 5)[0] == 65 and folders.single_note(None, 6)[0] == 54 and folders.single_note(440.0, None) == (69, None) and folders.single_note(440.0, 0) == (72, None) and folders.single_note(445.0, 10) == (70, None)
    assert "implausible" in folders.single_note(4600.0, None)[1]


def test_archives(spark, tmp_path):
    folder, out = tmp_path / "packs", tmp_path / "out"
    zone = '<sample file="{n}.wav"><key root="{n}" low="{n}" high="{n}" track="{t}"/><loop mode="{m}" start="1" stop="9"/></sample>'
    for name, mode, track in (("Brass/Long", "loop", "1"), ("Short", "off", "0")):
        path = folder / f"{name}.multisample"
        path.parent.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("multisample.xml", "<multisample>" + "".join(zone.format(n=n, m=mode, t=track) for n in (60, 64)) + "</multisample>")
    (folder / "bad.multisample").write_bytes(b"x")
    done = folders.scan_bitwig(spark, str(folder), str(out)).collect()
    assert sorted((r["place"], r["preset"]) for r in done) == [("", "Short"), ("Brass", "Long")]
    got = plans(spark, out)
    assert (got["Long"]["profile"], got["Short"]["profile"], got["Long"]["source_type"], got["Long"]["subfolder"]) == ("synth", "pluck", "bitwig", "Brass")
    assert "# REVIEW: fixed-pitch" in (out / "Short.yaml").read_text() and "REVIEW" not in (out / "Brass/Long.yaml").read_text()


def test_tables_alone_and_in_pairs(spark, tmp_path):
    folder, out = tmp_path / "tables", tmp_path / "out"
    k = np.arange(2048)
    for name, harmonics in (("a1", 2), ("a2", 3), ("b1", 40), ("b2", 44), ("c", 200)):
        x = sum(np.sin(2 * np.pi * h * k / 2048) / h for h in range(1, harmonics))
        put(folder / f"{name}.wav", riff.encode(44100, np.tile(0.3 * np.stack([x, x]), 4), 24))
    put(folder / "short.wav", riff.encode(44100, np.zeros((2, 100)), 16))
    assert folders.scan_wavetables(spark, str(folder), str(out)).count() == 6
    one = yaml.safe_load((out / "a1.yaml").read_text())
    assert one["wavetable"]["archetype"] == "sustaining" and (one["wavetable"]["attack"], one["wavetable"]["filter_type"]) == (0.1, "lpf") and "partner" not in one["source"]
    done = folders.scan_wavetables(spark, str(folder), str(tmp_path / "pairs"), archetype="percussive", pair=True).collect()
    assert 1 <= len(done) <= 2
    both = yaml.safe_load(open(done[0]["path"]))
    assert both["wavetable"]["archetype"] == "percussive" and both["wavetable"]["release"] == 0.15 and both["source"]["partner"] != both["source"]["path"] and "+" in both["output"]["name"]


def test_grain_sources(spark, tmp_path):
    folder, out = tmp_path / "grains", tmp_path / "out"
    put(folder / "long.wav", wav(220, 4.0))
    put(folder / "short.wav", wav(220, 0.5))
    assert folders.scan_granular(spark, str(folder), str(out)).count() == 2
    assert 0 < yaml.safe_load((out / "long.yaml").read_text())["granular"]["freeze_pos"] < 1 and "only 0.5 s long" in (out / "short.yaml").read_text()


TREE = ["Kick/01. Clean/Kick a.wav", "Kick/Color 02/Kick b.wav", "Kick/TUBE/Kick c.wav", "Hi Hat/CH/Clean/HiHat.wav", "Hi Hat/OH/Color 01/Open Hat.wav", "Tom/Various/Tom Hi.wav", "Tom/Clean/Tom Lo.wav", "Cymbal/Crash.wav", "loose.wav", ".x/Clean/Kick.wav", "Snare/Various/Snare 2.wav", "Snare/Various/Snare 1.wav"]


def test_hit_trees(spark):
    tree = kits.hit_tree(spark.createDataFrame([(p,) for p in TREE], "path string"))
    got = {r["path"]: (r["category"], r["tags"], r["family"]) for r in tree.collect()}
    assert len(got) == 10 and got["Kick/01. Clean/Kick a.wav"] == ("kick", ["CLEAN"], "kick") and got["Hi Hat/OH/Color 01/Open Hat.wav"] == ("hat_open", ["COLOR"], "hat")
    assert got["Tom/Various/Tom Hi.wav"] == ("tom_high", ["VARIOUS"], "tom") and got["Cymbal/Crash.wav"] == ("cymbal_crash", [], "cymbal")
    flavours = kits.flavours(tree)
    assert {r["kit"]: r["families"] for r in flavours.collect()} == {"CLEAN": 3, "COLOR": 2, "VARIOUS": 2}
    pads = {(r["kit"], r["category"]): (r["path"], r["tier"]) for r in kits.assembled(tree, flavours).collect()}
    assert len(pads) == 3 * 7 and pads["CLEAN", "kick"] == (TREE[0], 1) and pads["CLEAN", "snare"] == ("Snare/Various/Snare 1.wav", 2) and pads["COLOR", "cymbal_crash"] == ("Cymbal/Crash.wav", 3)


def test_kits_from_hits(spark, tmp_path):
    folder, out = tmp_path / "909", tmp_path / "out"
    for p in TREE:
        put(folder / p, wav(seconds=0.1))
    done = folders.scan_kit_assemble(spark, str(folder), str(out)).collect()
    assert sorted(r["preset"] for r in done) == ["909 - Clean Kit", "909 - Color Kit", "909 - Various Kit"]
    clean = yaml.safe_load((out / "909_Clean_Kit.yaml").read_text())
    assert clean["source"]["files"][0] == f"{folder}/{TREE[0]}" and len(clean["source"]["files"]) == 7 and clean["source"]["drumkit"] and clean["profile"] == "drums"
    assert "no exact 'Clean' match for" in (out / "909_Clean_Kit.yaml").read_text()
    assert plans(spark, out)["909 - Clean Kit"]["files"][0] == f"{folder}/{TREE[0]}"
