"""Patch documents of the Bento: instruments over key and velocity ranges, kits, wavetable and grain patches.

A document is a track with cells; cells are fixed blocks with a few values of their own. ``documents`` makes them for all
patches of a table of shipped samples, one row per patch.
"""

from __future__ import annotations

from collections.abc import Iterable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the format: parameters of tracks and cells in the device's order.
_MIDI = {
    "midiinport": "0", "midiinchan": "0", "cc1inport": "0", "cc1inchan": "0", "cc2inport": "0", "midioutport": "0", "midioutchan": "0", "padrowoffset": "0",
}
_TRACK = {"selcellpos": "0", "celldisppos": "0", "cellname": "Track 1", "selseqpos": "0", "out3gain": "0", "fx1send": "0", "fx2send": "0", **_MIDI}
_MULTISAMPLE_TRACK = {"selcellpos": "0", "celldisppos": "0", "cellname": "Track 1", "selseqpos": "0", "out3gain": "0", "fx1send": "0", "fx2send": "0", "outputbus": "0", **_MIDI}
_TABLE_TRACK = {
    "selcellpos": "0", "celldisppos": "0", "cellname": "", "selseqpos": "0", "seqplayenable": "1", "trkgain": "0", "trkpan": "0", "trkmute": "0", "trksolo": "0",
    "trkfx1send": "0", "trkfx2send": "0", "outputbus": "0",
    **_MIDI,
    "recactive": "0", "recinput": "0", "recgain": "0", "recautoplay": "0", "recpresetlen": "0", "recquant": "3", "recmonmode": "1", "recusethres": "0",
    "recthresh": "-30000",
}
_GRAIN_TRACK = {"selcellpos": "0", "celldisppos": "0", "cellname": "", "selseqpos": "0", "out3gain": "0", "fx1send": "0", "fx2send": "0", "outputbus": "0", **_MIDI}
_INSTRUMENT = {
    "gaindb": "0", "pitch": "0", "panpos": "0", "cellmode": "0", "samtrigtype": "0", "loopmodes": "0", "reverse": "0", "envattack": "0", "envdecay": "0",
    "envsus": "1000", "envrel": "200", "velamount": "0", "outputbus": "0", "polymode": "0", "chokegrp": "0", "dualfilcutoff": "0", "res": "500", "fx1send": "0",
    "fx2send": "0", "overdrive": "0", "multisammode": "0", "interpqual": "0", "loopfadeamt": "0", "lfowave": "0", "lforate": "100", "lfoamount": "1000",
    "lfokeytrig": "0", "lfobeatsync": "0", "lforatebeatsync": "0", "legatomode": "0", "celldisppos": "0",
}
_KIT_SEQUENCE = {"cellname": "", "notesteplen": "10", "notestepcount": "16", "seqstepmode": "1", "selcellpos": "0", "seqplayenable": "1", "quantsizeseq": "0"}
_SEQUENCE = {k: v for k, v in _KIT_SEQUENCE.items() if k != "notestepcount"}
_PART = {
    "globtempo": "120", "unisonmode": "0", "unisondetune": "0", "unisonspread": "0", "unisonvcount": "4", "oscphasereset": "1", "midibend": "2", "macroxsnap": "0",
    "macroysnap": "0",
}
_LFO = {"lfowave": "0", "lforate": "0", "lfoamount": "0", "lfokeytrig": "0", "lfobeatsync": "0", "lforatebeatsync": "0"}
_FILTER = {"filtertype": "0", "cutoff": "500", "res": "500", "filtenable": "0", "filtparallel": "0"}
_ENVELOPE = {"envattack": "0", "envdecay": "500", "envsus": "1000", "envrel": "500", "velamount": "0"}
_EFFECTS = {
    "flangeamount": "0", "flangelforate": "500", "flangefeedback": "0", "distamount": "0", "phaseamount": "0", "phaselforate": "500", "phasefeedback": "500",
    "chorusamount": "0", "chorusrate": "500", "fx1send": "0", "fx2send": "0", "fx3type": "0",
}
_TABLE_EFFECTS = [
    ("flangerdist", {"flangeamount": "0", "lforate": "500", "feedback": "0", "distamount": "0"}),
    ("delay", {
    "amount": "0", "feedback": "300", "filtenable": "0", "cutoffFx": "500", "filtquality": "1000", "delaypingpong": "1", "dealybeatsync": "1", "delay": "400",
    "delaymustime": "6",
}),
]
_HELD = {
    "pitch": "0", "level": "950", "grainbeatsync": "0", "grainbeatrate": "10", "graindensity": "548", "grainsizeperc": "787", "grainshape": "0", "gainssrcwin": "487",
    "grainjitter": "0", "grainpanrnd": "718", "grainfreezemode": "1", "grainfreezepos": "0", "samstart": "0", "samstartpercent": "0", "grainreadspeed": "640",
    "grainliveinpos": "0", "grainsaveattack": "1", "grainpitchpatt": "0", "graindetune": "105", "grainliveinput": "0", "loopmodes": "0", "samlen": "0", "wavesel": "0",
}
_MOVING = {
    "level": "940", "graindensity": "537", "grainsizeperc": "814", "gainssrcwin": "850", "grainjitter": "136", "grainpanrnd": "978", "grainfreezemode": "0",
    "grainfreezepos": "70", "grainreadspeed": "645", "graindetune": "66",
}
# What is moved, by what, and how much.
_HELD_ROUTES = [("pitch", "lfo1", "100"), ("grainfreezepos", "lfo2", "383"), ("grainsizeperc", "macrox", "-250"), ("graindensity", "macroy", "207")]
_MOVING_ROUTES = [("pitch", "lfo1", "100"), ("grainfreezepos", "lfo2", "390"), ("grainsizeperc", "macrox", "-240"), ("graindensity", "macroy", "185")]
# Voices of an instrument, how far loops fade, the group in which hats choke, the greatest table position and what two tables are apart.
POLY_8, LOOP_FADE, CHOKE_GROUP, CHOKED, TABLE_END, DETUNE, RELEASE = 4, 200, 1, ("hat_closed", "hat_open"), 255, 60, 200
# What a second table adds: a filter envelope and a vibrato on the wheel.
STACK_CUTOFF = [("cutoff", "env2", "500"), ("cutoff", "macrox", "400"), ("cutoff", "key", "200")]
STACK_SUSTAIN, STACK_VIBRATO, STACK_RATE, STACK_WHEEL, GRAIN_WHEEL, LONE_VELOCITY = 300, 150, 765, 400, 300, 63
FOLDERS = {"drum": "OneShots", "wavetable": "Wavetable", "granular": "Granular"}
PATCH_ROOT, INSTRUMENTS = "UserPatches", "SampInst"


def thousandth(share: float) -> str:
    return str(min(max(round(share * 1000), 0), 1000))


def _cell(track: ElementTree.Element, kind: str, values: dict[str, str], **own: object) -> ElementTree.Element:
    """A cell with these values, of which ``own`` replaces some or adds to them."""
    cell = ElementTree.SubElement(track, "cell", {"type": kind})
    ElementTree.SubElement(cell, "params", values | {k: str(v) for k, v in own.items()})
    return cell


def _routes(cell: ElementTree.Element, routes: list[tuple[str, str, str]]) -> None:
    """Each route (to, from, amount) has the next free slot of what it goes to."""
    slots: dict[str, int] = {}
    for to, source, amount in routes:
        ElementTree.SubElement(cell, "modsource", {"dest": to, "src": source, "slot": str(slots.get(to, 0)), "amount": amount})
        slots[to] = slots.get(to, 0) + 1


def _document(kind: str, track_values: dict[str, str]) -> tuple[ElementTree.Element, ElementTree.Element]:
    root = ElementTree.Element("document")
    track = ElementTree.SubElement(ElementTree.SubElement(root, "session", {"version": "1"}), "track", {"type": kind})
    ElementTree.SubElement(track, "params", track_values)
    return root, track


def _text(root: ElementTree.Element) -> str:
    ElementTree.indent(root)
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ElementTree.tostring(root, encoding="unicode") + "\n"


def centred(values: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """Ranges that meet half-way between neighbours and end before ``high``."""
    cuts = [low, *((a + b + 1) // 2 for a, b in zip(values, values[1:])), high]
    return [(a, b - 1) for a, b in zip(cuts, cuts[1:])]


def loops_as_a_whole(samples: Iterable[dict]) -> bool:
    """At least half of the notes loop."""
    looped = [s.get("loop_start") is not None for s in samples]
    return bool(looped) and 2 * sum(looped) >= len(looped)


def instrument(samples: list[dict], release: int = RELEASE) -> str:
    """A cell for each note and velocity, the lowest take of each; one loop mode for all, with a fade unless most loops are their author's."""
    layers: dict[int, dict[int, dict]] = {}
    for s in sorted(samples, key=lambda s: s.get("take") or 1):
        layers.setdefault(s["note"], {}).setdefault(s["velocity"], s)
    notes = sorted(layers)
    typical = [min(layers[n].values(), key=lambda s: (abs(s["velocity"] - 100), s["velocity"])) for n in notes]
    loop = loops_as_a_whole(typical)
    fade = LOOP_FADE if loop and 2 * sum(bool(s.get("authored")) for s in typical) < len(notes) else 0
    root, track = _document("multisamtrack", _MULTISAMPLE_TRACK)
    _cell(track, "saminst", _INSTRUMENT, samtrigtype=1, loopmodes=int(loop), multisammode=1, loopfadeamt=fade, envrel=release, polymode=POLY_8)
    for note, (low, high) in zip(notes, centred(notes, 0, 128), strict=True):
        velocities = sorted(layers[note])
        for velocity, (bottom, top) in zip(velocities, centred(velocities, 0, 128), strict=True):
            s = layers[note][velocity]
            keys = s.get("key_range") or (low, high)
            _sample(track, s, keys, (velocity if len(velocities) > 1 else LONE_VELOCITY, bottom, top), note)
    ElementTree.SubElement(_cell(track, "noteseq", _SEQUENCE), "sequence")
    return _text(root)


def _sample(track: ElementTree.Element, s: dict, keys: tuple[int, int], velocity: tuple[int, int, int], note: int, loop: bool = True) -> None:
    frames = s["frames"]
    start, stop = (min(max(x, 0), frames) for x in ((s["loop_start"], s["loop_stop"]) if loop and s.get("loop_start") is not None else (0, frames)))
    values = zip(
        "rootnote keyrangebottom keyrangetop velroot velrangebottom velrangetop samstart samlen loopstart loopend".split(), (note, *keys, *velocity, 0, frames, start, stop), strict=True
    )
    ElementTree.SubElement(_cell(track, "samasst", {}, filename=s["file"].rsplit("/", 1)[-1], **dict(values)), "slices")


def kit(pads: list[dict]) -> str:
    """A pad for each hit (``place``: its slot); all play once, and hats choke each other."""
    root, track = _document("samtrack", _TRACK)
    for s in pads:
        _cell(track, "saminst", _INSTRUMENT, celldisppos=s["place"], chokegrp=CHOKE_GROUP if s.get("category") in CHOKED else 0)
        _sample(track, s, (0, 0), (0, 0, 0), 0, loop=False)
    ElementTree.SubElement(_cell(track, "noteseq", _KIT_SEQUENCE), "sequence")
    return _text(root)


def table_sweep(position: float, depth: float) -> tuple[int, int]:
    """(centre, amount) of an LFO that goes from a position up by a depth, as far as the table reaches."""
    start = min(max(position, 0.0), 1.0)
    span = max(0.0, min(1.0 - start, depth))
    return round((start + span / 2) * TABLE_END), round(span / 2 * 1000)


def wavetable(file: str, shape: dict, partner: str | None = None) -> str:
    """One table on two oscillators, or a pair of tables with a filter envelope and a vibrato on the wheel."""
    root, track = _document("wttrack", _TABLE_TRACK)
    at, depth = table_sweep(shape["wt_position"], shape["lfo2_depth"])
    p = {k: thousandth(shape[k]) for k in ("attack", "decay", "sustain", "release", "filter_cutoff", "lfo2_rate")}
    for name, detune, turn in ((file, -DETUNE, 1), (partner or file, DETUNE, -1)):
        cell = _cell(track, "wavetable", {"pitch": str(detune), "level": "1000", "wavesel": "0", "wavepos": str(at), "samlen": "0"}, filename=name.rsplit("/", 1)[-1])
        _routes(cell, [("wavepos", "lfo1", str(depth * turn)), *([("pitch", "lfo2", str(STACK_VIBRATO))] if partner else [])])
    _cell(track, "osc", {"pitch": "0", "level": "0", "waveform": "0", "dutycyc": "500"})
    _routes(_cell(track, "filter", _FILTER, cutoff=p["filter_cutoff"], res=250, filtenable=1), STACK_CUTOFF if partner else [])
    _cell(track, "filter", _FILTER)
    _cell(track, "env", _ENVELOPE, envattack=p["attack"], envdecay=p["decay"], envsus=p["sustain"], envrel=p["release"])
    second = {"envdecay": p["decay"], "envsus": STACK_SUSTAIN, "envrel": p["release"]} if partner else {}
    _cell(track, "env", _ENVELOPE, **second)
    _cell(track, "lfo", _LFO, lfowave=2, lforate=p["lfo2_rate"], lfoamount=1000, lforatebeatsync=p["lfo2_rate"])
    rate = STACK_RATE if partner else 500
    _routes(_cell(track, "lfo", _LFO, lforate=rate, lforatebeatsync=rate), [("lfoamount", "modwheel", str(STACK_WHEEL))] if partner else [])
    ElementTree.SubElement(_cell(track, "seqmod", {"steplen": "8", "seqsteps": "16", "seqkeytrig": "0", "seqquant": "0", "quantsize": "0"}), "sequence")
    _cell(track, "partparms", _PART)
    for name, values in _TABLE_EFFECTS:
        _cell(track, name, values)
    _cell(track, "fxlemon", _EFFECTS)
    return _text(root)


def granular(held: str, moving: str, freeze: float) -> str:
    """Two clouds of grains: one held on a moment of its source, one moving through its own."""
    root, track = _document("grtrack", _GRAIN_TRACK)
    for name, own, routes in ((held, {"grainfreezepos": str(round(freeze * 1000))}, _HELD_ROUTES), (moving, _MOVING, _MOVING_ROUTES)):
        _routes(_cell(track, "grainosc", _HELD | own, filename=name.rsplit("/", 1)[-1]), routes)
    _cell(track, "osc", {"pitch": "0", "level": "0", "waveform": "3", "dutycyc": "500"})
    _routes(_cell(track, "filter", _FILTER, cutoff=760, res=140, filtenable=1), [("cutoff", "macrox", "139")])
    _cell(track, "filter", _FILTER, cutoff=585, res=160)
    _cell(track, "env", _ENVELOPE, envattack=164, envdecay=466, envsus=1000, envrel=445, velamount=770)
    _cell(track, "env", _ENVELOPE, envattack=0, envdecay=738, envsus=36, envrel=500, velamount=1000)
    _routes(_cell(track, "lfo", _LFO, lfowave=2, lforate=770, lforatebeatsync=757), [("lfoamount", "modwheel", str(GRAIN_WHEEL))])
    _cell(track, "lfo", _LFO, lfowave=2, lforate=182, lfoamount=1000, lforatebeatsync=182)
    ElementTree.SubElement(_cell(track, "seqmod", {"steplen": "8", "seqsteps": "16", "seqkeytrig": "0", "seqquant": "0"}), "sequence")
    _cell(track, "partparms", _PART)
    _cell(track, "chorus", {"amount": "214", "chorrate": "172"})
    _cell(track, "reverb", {"amount": "211", "decay": "714", "predelay": "316", "damping": "262"})
    _cell(track, "fxlemon", _EFFECTS, flangefeedback=600, chorusamount=214, chorusrate=172, fx2send=211, fx3type=1)
    return _text(root)


DOCUMENT = "preset string, path string, document string, error string"


def documents(shipped: DataFrame) -> DataFrame:
    """(preset, path, document, error) of shipped samples.

    Columns: preset, category (drum, wavetable, granular or another), note, velocity, take, file, frames, loop_start, loop_stop,
    authored, hit (the drum's category), place (its pad), shape (map of a table's values, or ``freeze`` of a grain patch).
    A grain patch has two files, held and moving, by note; a table's partner is its second.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["note"] or 0, r["velocity"] or 0, r["take"] or 0, r["file"]))
        kind, preset, shape = rows[0]["category"], rows[0]["preset"], dict(rows[0]["shape"] or ())
        document = error = None
        try:
            if kind == "drum":
                first: dict[int, dict] = {}
                for r in rows:
                    first.setdefault(r["place"], {**r, "category": r["hit"]})
                document = kit(list(first.values()))
            elif kind == "wavetable":
                document = wavetable(rows[0]["file"], shape, rows[1]["file"] if len(rows) > 1 else None)
            elif kind == "granular":
                document = granular(rows[0]["file"], rows[-1]["file"], shape.get("freeze", 0.5))
            else:
                document = instrument(rows)
        except (KeyError, TypeError, ValueError) as e:
            error = f"{type(e).__name__}: {e}"
        path = f"{PATCH_ROOT}/{FOLDERS.get(kind, INSTRUMENTS)}/{preset}/patch.xml"
        return pa.table({k: pa.array([v], pa.string()) for k, v in (("preset", preset), ("path", path), ("document", document), ("error", error))})

    return shipped.groupBy("preset").applyInArrow(run, DOCUMENT)
