"""Documents of the Deluge: ranges, zones, cables, kits, folders."""

from xml.etree import ElementTree

from tonecairn.sources import bento, deluge


def sample(note, **more):
    return {"note": note, "file": f"SAMPLES/C/P/{note}.wav", "frames": 1000, "loop_start": None, "loop_stop": None} | more


def test_encodings():
    assert [deluge.fraction(x) for x in (0, 1, 0.5, 2, -1)] == ["0x80000000", "0x7FFFFFFF", "0x00000000", "0x7FFFFFFF", "0x80000000"]
    assert [deluge.cable_amount(x) for x in (0, 50, -50, 25, 99)] == ["0x00000000", "0x40000000", "0xC0000000", "0x20000000", "0x40000000"]
    assert [deluge.nearest_release(s) for s in (0.0, 2.3, 2.4, 99.0)] == [0, 28, 29, 50]


def test_ranges_and_loops():
    both = [sample(48, loop_start=5, loop_stop=900), sample(60, loop_start=7, loop_stop=1200), sample(55)]
    root = ElementTree.fromstring(deluge.multisample(both).encode())
    ranges = root.findall("osc1/sampleRanges/sampleRange")
    assert [(r.get("rangeTopNote"), r.get("transpose")) for r in ranges] == [("54", "0"), ("59", "-7"), ("66", "-12")]
    assert ranges[0].find("zone").attrib == {"startSamplePos": "0", "endSamplePos": "1000", "startLoopPos": "5", "endLoopPos": "900"}
    assert root.find("osc1").get("loopMode") == "0" and "startLoopPos" not in ranges[1].find("zone").attrib
    through = ElementTree.fromstring(deluge.multisample(both[:2], through={60}).encode())
    a, b = (r.find("zone").attrib for r in through.iter("sampleRange"))
    assert through.find("osc1").get("loopMode") == "2" and a["endLoopPos"] == "900" and "endLoopPos" not in b and b["endSamplePos"] == "1000"
    voice = deluge.Voice("mono", 0.5, True, True, True, "0x01000000")
    played = ElementTree.fromstring(deluge.multisample(both, voice).encode())
    cables = [c.attrib for c in played.findall("defaultParams/patchCables/patchCable")]
    assert played.get("lpfMode") == "12dB" and played.find("defaultParams").get("portamento") == "0x00000000" and cables[2]["amount"] == deluge.cable_amount(-20)
    assert [c["destination"] for c in cables] == ["volume", "volume", "lpfFrequency", "lpfFrequency", "pitch"] and played.find(".//depthControlledBy/patchCable").get("source") == "aftertouch"
    assert played.find("defaultParams/envelope1").get("release") == "0x01000000"


def test_tables_and_kits():
    shape = dict.fromkeys(("wt_position", "lfo2_rate", "filter_cutoff", "attack", "decay", "sustain", "release"), 0.5) | {"lfo2_depth": 0.4}
    root = ElementTree.fromstring(deluge.wavetable("SAMPLES/t.wav", shape).encode())
    names = list(root.find("defaultParams").attrib)
    assert names.index("oscAWavetablePosition") == names.index("oscAPulseWidth") + 1
    cables = root.findall("defaultParams/patchCables/patchCable")
    assert [c.get("amount") for c in cables[3:]] == [deluge.cable_amount(20), deluge.cable_amount(-20)]
    assert [k.get("controlsParam") for k in root.findall("modKnobs/modKnob")][14:] == ["oscBWavetablePosition", "oscAWavetablePosition"] and len(root.findall("modKnobs/modKnob")) == 16
    hits = [sample(37, category="hat_open", instrument="Hat & co"), sample(36, category="kick"), sample(38, category="snare", loop_start=1, loop_stop=2)]
    kit = ElementTree.fromstring(deluge.kit(hits).encode())
    sounds = kit.findall("soundSources/sound")
    assert [(s.get("name"), s.get("polyphonic"), s.get("sideChainSend")) for s in sounds] == [("note036", "auto", "2147483647"), ("Hat & co", "choke", None), ("note038", "auto", None)]
    assert all(s.find("osc1").get("loopMode") == "1" for s in sounds) and kit.find("selectedDrumIndex").text == "1"
    assert deluge.card_places("C", "P", "a/../b", True) == ("SAMPLES/C/a/b/P", "KITS/C/a/b/P.xml") and deluge.on_card("/x/SAMPLES/y.wav") == "SAMPLES/y.wav"


def test_documents_of_presets(spark):
    ddl = "preset string, collection string, subfolder string, category string, note int, velocity int, take int, file string, frames long, loop_start long, loop_stop long, tail boolean, instrument string, hit string, release_s double, shape map<string,double>"
    row = lambda preset, category, note, velocity=100, take=1, loop=None, shape=None, release=None: (preset, "C", None, category, note, velocity, take, f"/m/SAMPLES/C/{preset}/{note}_{velocity}_{take}.wav", 99, loop, loop and 50, False, None, "kick", release, shape)
    shape = dict.fromkeys(("wt_position", "lfo2_rate", "lfo2_depth", "filter_cutoff", "attack", "decay", "sustain", "release"), 0.5)
    rows = [row("pad", "synth", 60, 127, loop=3, release=2.3), row("pad", "synth", 60, 97, 2, loop=3, release=2.3), row("pad", "synth", 60, 97, 1, loop=3, release=2.3), row("pad", "synth", 62, loop=4)]
    rows += [row("k", "drum", 36), row("w", "wavetable", 60, shape=shape), row("bare", "wavetable", 60), row("g", "granular", 60)]
    done = {r["preset"]: r for r in deluge.documents(spark.createDataFrame(rows, ddl)).collect()}
    pad = ElementTree.fromstring(done["pad"]["document"].encode())
    assert [r.get("fileName") for r in pad.iter("sampleRange")] == ["SAMPLES/C/pad/60_97_1.wav", "SAMPLES/C/pad/62_100_1.wav"] and pad.find("osc1").get("loopMode") == "2"
    assert pad.find("defaultParams/envelope1").get("release") == deluge.fraction(28 / 50) and done["pad"]["path"] == "SYNTHS/C/pad.xml"
    assert done["k"]["path"] == "KITS/C/k.xml" and done["w"]["document"] and done["bare"]["error"] and done["g"]["error"]


def cells(document):
    return [(c.get("type"), c.find("params").attrib, [(m.get("dest"), m.get("src"), m.get("slot"), m.get("amount")) for m in c.findall("modsource")]) for c in ElementTree.fromstring(document.encode()).iter("cell")]


def test_instruments_of_the_other_device():
    both = [sample(48, velocity=40, take=1, loop_start=5, loop_stop=2000), sample(48, velocity=120, take=2), sample(48, velocity=120, take=1, frames=7), sample(60, velocity=100, loop_start=1, loop_stop=9)]
    found = cells(bento.instrument(both, release=300))
    assert [k for k, _, _ in found] == ["saminst", "samasst", "samasst", "samasst", "noteseq"]
    inst, low, high, lone, seq = (p for _, p, _ in found)
    assert (inst["samtrigtype"], inst["loopmodes"], inst["loopfadeamt"], inst["envrel"], inst["polymode"], inst["multisammode"]) == ("1", "1", "200", "300", "4", "1")
    assert (low["keyrangebottom"], low["keyrangetop"], lone["keyrangebottom"], lone["keyrangetop"]) == ("0", "53", "54", "127")
    assert (low["velroot"], low["velrangebottom"], low["velrangetop"], high["velrangebottom"], high["velrangetop"], lone["velroot"], lone["velrangetop"]) == ("40", "0", "79", "80", "127", "63", "127")
    assert (low["loopstart"], low["loopend"], high["loopend"], high["samlen"]) == ("5", "1000", "7", "7") and "notestepcount" not in seq
    assert 'cellname="Track 1"' in bento.instrument(both) and "outputbus" in bento.instrument(both)
    authored = [s | {"authored": True} for s in both]
    assert cells(bento.instrument(authored))[0][1]["loopfadeamt"] == "0" and cells(bento.instrument([sample(1, velocity=1)]))[0][1]["loopmodes"] == "0"


def test_kits_tables_and_grains_of_the_other_device():
    pads = [sample(36, category="kick", place=8), sample(42, category="hat_closed", place=0, loop_start=3, loop_stop=9)]
    found = cells(bento.kit(pads))
    assert [(p["celldisppos"], p["chokegrp"]) for k, p, _ in found if k == "saminst"] == [("8", "0"), ("0", "1")]
    assert [(p["rootnote"], p["velrangetop"], p["loopstart"], p["loopend"]) for k, p, _ in found if k == "samasst"] == [("0", "0", "0", "1000")] * 2 and found[-1][1]["notestepcount"] == "16"
    assert bento.table_sweep(0.5, 0.9) == (191, 250) and bento.table_sweep(-1, 0.2) == (26, 100)
    shape = dict.fromkeys(("wt_position", "lfo2_depth", "attack", "decay", "sustain", "release", "filter_cutoff", "lfo2_rate"), 0.4)
    lone, pair = cells(bento.wavetable("x/a.wav", shape)), cells(bento.wavetable("x/a.wav", shape, "x/b.wav"))
    order = ["wavetable", "wavetable", "osc", "filter", "filter", "env", "env", "lfo", "lfo", "seqmod", "partparms", "flangerdist", "delay", "fxlemon"]
    assert [k for k, _, _ in lone] == [k for k, _, _ in pair] == order
    assert [c[1]["filename"] for c in pair[:2]] == ["a.wav", "b.wav"] and [c[2] for c in lone[:2]] == [[("wavepos", "lfo1", "0", "200")], [("wavepos", "lfo1", "0", "-200")]]
    assert [m[2] for m in pair[3][2]] == ["0", "1", "2"] and pair[6][1]["envsus"] == "300" and pair[8][2] == [("lfoamount", "modwheel", "0", "400")] and not lone[8][2]
    grains = cells(bento.granular("a.wav", "b.wav", 0.25))
    assert [k for k, _, _ in grains] == ["grainosc", "grainosc", "osc", "filter", "filter", "env", "env", "lfo", "lfo", "seqmod", "partparms", "chorus", "reverb", "fxlemon"]
    assert (grains[0][1]["grainfreezepos"], grains[1][1]["grainfreezepos"], grains[1][1]["pitch"]) == ("250", "70", "0") and len(grains[0][2]) == 4 and "quantsize" not in grains[9][1]


def test_documents_of_the_other_device(spark):
    ddl = "preset string, category string, note int, velocity int, take int, file string, frames long, loop_start long, loop_stop long, authored boolean, hit string, place int, shape map<string,double>"
    row = lambda preset, category, note, file, place=None, shape=None, velocity=100: (preset, category, note, velocity, 1, file, 99, None, None, None, "snare", place, shape)
    rows = [row("p", "synth", 60, "a.wav"), row("k", "drum", 1, "b.wav", 3), row("k", "drum", 2, "c.wav", 9), row("w", "wavetable", 60, "t.wav", shape={"attack": 1.0}), row("g", "granular", 1, "x.wav"), row("g", "granular", 2, "y.wav"), row("n", "synth", 60, "z.wav", velocity=None)]
    done = {r["preset"]: r for r in bento.documents(spark.createDataFrame(rows, ddl)).collect()}
    assert [done[p]["path"].split("/")[1] for p in "pkwg"] == ["SampInst", "OneShots", "Wavetable", "Granular"]
    assert done["p"]["document"] and len(cells(done["k"]["document"])) == 5 and "KeyError" in done["w"]["error"] and [c[1].get("filename") for c in cells(done["g"]["document"])[:2]] == ["x.wav", "y.wav"] and done["n"]["error"]
