import io
import struct
import zipfile
import zlib

import numpy as np
import pytest

from tonecairn.sources import mappings, readers, riff, sinks


def tone(n=800, channels=2):
    x = 0.5 * np.sin(np.arange(n) / 9)
    return np.stack([x * (1 if c == 0 else -0.5) for c in range(channels)])


@pytest.mark.parametrize("bits,codec,limit", [(16, riff.PCM, 1e-4), (24, riff.PCM, 1e-6), (32, riff.FLOAT, 1e-7)])
def test_wav_round_trip(bits, codec, limit):
    rate, x = riff.decode(riff.encode(48000, tone(), bits, codec))
    assert rate == 48000 and np.abs(x - tone()).max() < limit


def test_mono_is_doubled_and_loops_are_read():
    raw = riff.encode(44100, tone(channels=1), 16, loop=(10, 500))
    assert riff.decode(raw)[1].shape == (2, 800)
    assert riff.loop_points(raw) == (10, 500)
    assert riff.loop_points(riff.encode(44100, tone(), 16)) is None


def test_extensible_header_is_rewritten_and_data_kept():
    raw = riff.encode(48000, tone(), 24)
    form = riff.wav_format(raw)
    body = raw[form.fmt_offset : form.fmt_offset + 16]
    wide = struct.pack("<H", riff.EXTENSIBLE) + body[2:] + struct.pack("<HHIH", 22, 24, 3, 1) + bytes.fromhex("000000001000800000aa00389b71")
    long_ = raw[:16] + struct.pack("<I", len(wide)) + wide + raw[form.fmt_offset + 16 :]
    out, ratio = riff.conform(long_)
    assert ratio == 1.0 and riff.wav_format(out).codec == riff.PCM and riff.chunk(out, b"data") == riff.chunk(raw, b"data")


def test_high_rate_is_halved():
    out, ratio = riff.conform(riff.encode(192000, tone(), 24))
    assert ratio == 0.5 and riff.wav_format(out).rate == 96000 and riff.scaled_loop((100, 301), ratio) == (50, 150)
    assert riff.chunk(riff.with_chunk(out, b"test", b"abc"), b"test") == b"abc"


def test_sfz_scopes_skips_and_macros():
    text = """// head
#define $V 90
<global> volume=-3 <group> lovel=1 hivel=$V
<region> sample=a b.wav key=c4 loop_mode=loop_continuous loop_start=5 loop_end=99
<region> sample=b.wav key=61 trigger=release
<region> sample=*sine key=1
<group> <region> sample=c.wav pitch_keycenter=d#3 volume=2
"""
    zones = mappings.sfz_zones(text)
    assert [(z["file"], z["root"], z["vel_high"], z["gain_db"]) for z in zones] == [("a b.wav", 60, 90, -3.0), ("c.wav", 51, 127, 2.0)]
    assert (zones[0]["loop_start"], zones[0]["loop_stop"]) == (5, 99)


def test_sfz_rules_of_zones():
    files = {"a.inc": '#include "b.inc"\n<region> sample=in.wav key=60', "b.inc": '#include "a.inc"\n#define $X 7\n<region> sample=deep$X.wav'}
    text = """<control> default_path=S\\ sw_default=c1
/* #define $N 1 */ #define $N 50
#define $NN 70
#include "a.inc"
<global> sw_last=c1
<region> sample=kept.wav lokey=10 hikey=20 key=$NN // key wins
<region> sample=other.wav sw_last=d1
<region> sample=one.wav lokey=$N hikey=$N
<region> sample=wide.wav hikey=40 lovel=12.0 end=99 offset=3 pan=-250 transpose=1 tune=5 seq_position=2 loopmode=loop_sustain loopstart=1 loopend=8 loop_crossfade=0.5 pitch_keytrack=0 direction=reverse
<region> sample=file.wav loop_mode=loop_continuous loop_crossfade=2
<region> sample=off.wav end=-1
<region> sample=bad.wav key=h9
<region> sample=bad.wav lovel=x
<region> sample=rel.wav trigger=release_key
"""
    zones = mappings.sfz_zones(text, files.get, lambda f: (2, 9) if f.endswith("file.wav") else None)
    assert [(z["file"], z["root"], z["key_low"], z["key_high"]) for z in zones] == [
        ("S/deep7.wav", 60, 0, 127), ("S/in.wav", 60, 60, 60), ("S/kept.wav", 70, 70, 70), ("S/one.wav", 50, 50, 50), ("S/wide.wav", 60, 0, 40), ("S/file.wav", 60, 0, 127),
    ]
    wide, looped = zones[4], zones[5]
    assert (wide["vel_low"], wide["sample_start"], wide["sample_stop"], wide["pan"], wide["tune_cents"], wide["group"]) == (12, 3, 100, -1.0, 105.0, 2005)
    assert (wide["loop_start"], wide["loop_stop"], wide["loop_fade_s"], wide["track"], wide["reverse"]) == (1, 8, 0.5, False, True)
    assert (looped["loop_start"], looped["loop_stop"], looped["loop_fade_s"]) == (2, 9, 2.0)
    assert mappings.sfz_zones("<region> sample=x.wav sw_last=c1") == []  # no default switch
    assert [mappings.sfz_note(v) for v in ("60", "12.7", "C4", "db2", "F#-1", "x", "", None)] == [60, 12, 60, 37, 6, None, None, None]


def test_blocks_that_are_cut_short():
    for block in (bytes([2]) + b"ab", bytes([2]) + b"abc" + bytes([4 << 5])):
        with pytest.raises(ValueError):
            mappings.fastlz(block, 9)
    with pytest.raises(ValueError):
        mappings.fastlz(bytes([2]) + b"abc" + bytes([(4 << 5) | 0, 2]), 5)


def test_headers_and_rates_that_a_device_refuses():
    form = riff.wav_format(riff.encode(48000, tone(), 24))
    assert riff.violations(form) == []
    assert riff.violations(form._replace(extensible=True, channels=0) if hasattr(form, "_replace") else __import__("dataclasses").replace(form, extensible=True, channels=0)) == ["header", "channels"]
    assert [riff.fitting_rate(r) for r in (192001, 384003, 4999, 96000, 1)] == [96000, 96000, 9998, 96000, 8192]


def archive(xml):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("multisample.xml", xml)
    return out.getvalue()


def test_multisample_archive():
    xml = '<multisample><sample file="a.wav" gain="1.5"><key root="60.0" low="50" high="70"/><velocity high="100"/><loop mode="loop" start="1.0" stop="9"/></sample><sample file="b.wav"/></multisample>'
    (zone,) = mappings.multisample_zones(archive(xml))
    assert (zone["root"], zone["vel_low"], zone["vel_high"], zone["loop_start"], zone["loop_stop"]) == (60, 0, 100, 1, 9)


def test_embedded_program_and_fastlz():
    raw = b"\x12\x54" + b"\0" * 40 + zlib.compress(b"<program><zone file='x'/></program>")
    assert mappings.embedded_program(raw).find("zone").get("file") == "x"
    assert mappings.embedded_program(b"none") is None
    # three literals, then a match of 6 bytes three back
    assert mappings.fastlz(bytes([2]) + b"abc" + bytes([(4 << 5) | 0, 2]), 9) == b"abcabcabc"


def test_ini_section_first_value_wins():
    assert mappings.ini_section("#cm=A\nx=1\n#cm=VCC\nx=2\nx=3\ny=4", "cm=VCC") == {"x": "2", "y": "4"}


def test_readers_over_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.wav").write_bytes(riff.encode(48000, tone(), 16, loop=(3, 90)))
    (tmp_path / "in/bad.WAV").write_bytes(b"nothing")
    (tmp_path / "in/k.sfz").write_text('#include "Parts/x.inc"\n<region> sample=gone.wav key=61')
    (tmp_path / "in/parts").mkdir()
    (tmp_path / "in/parts/X.inc").write_text("<region> sample=A.WAV key=60 loop_mode=loop_continuous")
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in readers.wav_headers(spark, str(tmp_path / "in")).collect()}
    assert (rows["a.wav"]["frames"], rows["a.wav"]["loop_end"], rows["a.wav"]["broken"]) == (800, 90, "")
    assert rows["bad.WAV"]["broken"] == "no WAV file"
    errors = {r["path"].rsplit("/", 1)[-1]: r["error"] for r in readers.samples(spark, str(tmp_path / "in")).collect()}
    assert errors["a.wav"] is None and errors["bad.WAV"]
    zone, missing = sorted(readers.zones(spark, str(tmp_path / "in"), "*.sfz").collect(), key=lambda r: r["root"])
    assert zone["root"] == 60 and zone["error"] is None and zone["file"].endswith("in/a.wav") and (zone["loop_start"], zone["loop_stop"]) == (3, 90)
    assert missing["error"] == "no such sample"
    files = spark.read.format("binaryFile").load(str(tmp_path / "in/a.wav"))
    assert sinks.conformed(files).collect()[0]["ratio"] == 1.0


def test_index_and_documents(spark):
    index = spark.createDataFrame([("A & B/<x>", ["Bass", "Q&A"]), ("c", [])], "path string, tags array<string>")
    for _ in range(5):
        index = sinks.read_index_lines(sinks.index_lines(index))
    assert sorted((r["path"], r["tags"]) for r in index.collect()) == [("A & B/<x>", ["Bass", "Q&A"]), ("c", [])]
    zones = [{"file": "b&.wav", "root": 62, "vel_low": 0, "loop_start": 1, "loop_stop": 5}, {"file": "a.wav", "root": 60, "vel_low": 0}]
    rows = spark.createDataFrame([("P", z["file"], z["root"], None, None, 0, z.get("loop_start"), z.get("loop_stop")) for z in zones], "preset string, file string, root int, key_low int, key_high int, vel_low int, loop_start long, loop_stop long")
    assert sinks.preset_documents(rows).collect()[0]["document"] == sinks.preset_document("P", zones)
