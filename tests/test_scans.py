"""From mapping files to plans, and older programs."""

import struct
import zlib

import numpy as np
import pytest

from tonecairn.operators import scans
from tonecairn.sources import configs, programs, readers, riff

WAV = riff.encode(48000, np.zeros((2, 50)), 16)
XML = b"""<?xml version="1.0"?><K2><K2_Program><Parameters><V name="volume" value="0.5"/></Parameters>
<Groups><K2_Group index="0"><Parameters><V name="pan" value="0.4"/></Parameters></K2_Group><K2_Group index="1"><Parameters><V name="releaseTrigger" value="yes"/></Parameters></K2_Group></Groups>
<Zones><K2_Zone groupIdx="0"><Parameters><V name="rootKey" value="60"/><V name="zonePan" value="0.9"/><V name="zoneTune" value="2"/><V name="sampleStart" value="5"/><V name="sampleEnd" value="9"/></Parameters>
<Sample><V name="file_ex2" value="@bd003WAVF00000000000a%20b.wav"/></Sample><Loops><Loop><V name="mode" value="oneshot"/></Loop><Loop><V name="mode" value="until_end"/><V name="loopStart" value="10"/><V name="loopLength" value="20"/></Loop></Loops></K2_Zone>
<K2_Zone groupIdx="1"><Parameters><V name="rootKey" value="61"/></Parameters><Sample><V name="file" value="a b.wav"/></Sample></K2_Zone>
<K2_Zone groupIdx="0"><Parameters><V name="rootKey" value="62"/></Parameters><Sample><V name="file" value="C:\\lib\\WAV\\a b.wav"/></Sample></K2_Zone></Zones></K2_Program></K2>"""


def program(xml=XML, magic=0x1290A87F):
    return struct.pack("<I", magic) + b"\0" * 12 + b"\0" * 30 + zlib.compress(xml)


def test_coded_sample_paths():
    assert programs.sample_path("a\\b.wav") == ("a/b.wav", False)
    assert programs.sample_path("@bbd003WAVd002xyF00000000000a.wav") == ("../../WAV/xy/a.wav", False)
    assert programs.sample_path("@v002C:m003libf000000a%20b.wav") == ("C:/lib/a b.wav", True)
    assert programs.sample_path("@v003Volf000000a.wav") == ("/Vol/a.wav", True)
    for bad in ("@", "@q", "@dxyz", "@d003abc"):
        with pytest.raises(programs.NotReadable):
            programs.sample_path(bad)


def test_programs_become_zones():
    first, second = programs.program_zones(program())
    assert (first["file"], first["root"], first["pan"], first["tune_cents"], first["sample_start"], first["sample_stop"]) == ("../WAV/a b.wav", 60, 1.0, 1200.0, 5, 9)
    assert (first["loop_start"], first["loop_stop"], round(first["gain_db"], 2), second["group"]) == (10, 29, -6.02, 2)
    for raw in (b"", b"\0" * 40, program(magic=0x5EE56EB3), program(b"no xml")):
        with pytest.raises(programs.NotReadable):
            programs.program_zones(raw)


def test_scan_writes_plans(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    lib, wav = tmp_path / "lib", tmp_path / "lib/Pack/WAV/Brass/Loud Horn"
    wav.mkdir(parents=True)
    for n in ("a.wav", "b.wav", "l.wav", "r.wav"):
        (wav / n).write_bytes(WAV)
    (lib / "Pack/.hid.sfz").write_text("<region> sample=WAV/Brass/Loud Horn/a.wav")
    (lib / "Pack/Keys - Horn X.sfz").write_text(
        "<global> loop_mode=loop_sustain loop_start=1 loop_end=9\n<region> sample=WAV/Brass/Loud Horn/a.wav key=60\n"
        "<region> sample=wav/Brass/loud horn/l.wav key=62 pan=-100\n<region> sample=WAV/Brass/Loud Horn/r.wav key=62 pan=100"
    )
    (lib / "drum.sfz").write_text("<region> sample=Pack/WAV/Brass/Loud Horn/b.wav key=1 pitch_keytrack=0\n<region> sample=gone.wav key=2")
    (lib / "none.sfz").write_text("nothing")
    (lib / "Pack/prog.nki").write_bytes(program(XML.replace(b"@bd003WAV", b"@d003WAVd005Brassd009Loud Horn").replace(b"%20b", b"").replace(b"a b.wav", b"b.wav")))
    done = scans.scan_mapped(spark, str(lib), str(tmp_path / "out"), strip_suffix=" X", split_prefix=True).collect()
    assert sorted((r["place"], r["preset"]) for r in done) == [("", "drum"), ("Pack/Keys", "Horn")]
    plans = {r["name"]: r for r in configs.plans(spark, str(tmp_path / "out")).collect()}
    assert (plans["Horn"]["profile"], plans["Horn"]["subfolder"], plans["Horn"]["source_path"], plans["Horn"]["error"]) == ("synth", "Pack/Keys", f"{lib}/Pack/Keys - Horn X.sfz", None)
    assert plans["drum"]["profile"] == "pluck" and plans["drum"]["normalize"] == "none"
    horn = (tmp_path / "out/Pack/Keys/Horn.yaml").read_text()
    assert horn.startswith("# 2 samples, 2 notes [60-62], 2 looped\n") and "# REVIEW: fixed-pitch" in (tmp_path / "out/drum.yaml").read_text()
    assert yaml.safe_load(horn)["analysis"] == {"pitch_verify": False, "loop_detect": False, "trim": False, "normalize": "none"}
    zones = readers.zones(spark, str(lib), "*.nki").collect()
    assert [z["root"] for z in zones] == [60, 62] and all(z["file"].startswith(str(wav)) and z["error"] is None for z in zones)
    named = scans.mapped_presets(readers.zones(spark, str(lib), "*.nki"), str(lib), name_from_folder=True).collect()
    assert [(r["preset"], r["subfolder"]) for r in named] == [("Loud Horn", "Brass")]
