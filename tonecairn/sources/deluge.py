"""Preset documents of the Deluge: sounds over sample ranges, sounds over a wavetable, kits; and the plan of its card's folders.

Documents are made from fixed blocks and a handful of values. ``documents`` makes them for all presets of a table of shipped
samples, one row per preset, in one Arrow pass over the preset's rows.
"""

from __future__ import annotations

import posixpath
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the format: attributes of elements, and elements that stand together.
_ROOT = {"firmwareVersion": "4.1.3", "earliestCompatibleFirmware": "4.1.0-alpha"}
_LFOS = [("lfo1", {"type": "triangle", "syncLevel": "0"}), ("lfo2", {"type": "triangle"})]
_SYNCED_LFOS = [("lfo1", {"type": "triangle", "syncLevel": "0"}), ("lfo2", {"type": "triangle", "syncLevel": "0"})]
_UNISON = [("unison", {"num": "1", "detune": "8"})]
_EFFECTS = [("delay", {"pingPong": "1", "analog": "0", "syncLevel": "7"}), ("compressor", {"syncLevel": "6", "attack": "327244", "release": "936"})]
_SAMPLE_OSC = {"type": "sample", "loopMode": "0", "reversed": "0", "timeStretchEnable": "0", "timeStretchAmount": "0"}
_EQUALIZER = [("equalizer", {"bass": "0x00000000", "treble": "0x00000000", "bassFrequency": "0x00000000", "trebleFrequency": "0x00000000"})]
_ARPEGGIATOR = [("arpeggiator", {"mode": "off", "numOctaves": "2", "syncLevel": "7"})]
_PARAMS = {
    "arpeggiatorGate": "0x00000000", "portamento": "0x80000000", "compressorShape": "0xDC28F5B2", "oscAVolume": "0x19999999", "oscAPulseWidth": "0x00000000",
    "oscBVolume": "0x80000000", "oscBPulseWidth": "0x00000000", "noiseVolume": "0x80000000", "volume": "0x4CCCCCA8", "pan": "0x00000000", "lpfFrequency": "0x7FFFFFFF",
    "lpfResonance": "0x80000000", "hpfFrequency": "0x80000000", "hpfResonance": "0x80000000", "lfo1Rate": "0x1999997E", "lfo2Rate": "0x00000000",
    "modFXRate": "0x00000000", "modFXDepth": "0x00000000", "delayRate": "0x00000000", "delayFeedback": "0x80000000", "reverbAmount": "0x80000000",
    "arpeggiatorRate": "0x00000000", "stutterRate": "0x00000000", "sampleRateReduction": "0x80000000", "bitCrush": "0x80000000", "modFXOffset": "0x00000000",
    "modFXFeedback": "0x00000000",
}
_KIT_PARAMS = {
    "reverbAmount": "0x80000000", "volume": "0x3504F334", "pan": "0x00000000", "sidechainCompressorShape": "0xDC28F5B2", "modFXDepth": "0x00000000",
    "modFXRate": "0xE0000000", "stutterRate": "0x00000000", "sampleRateReduction": "0x80000000", "bitCrush": "0x80000000", "modFXOffset": "0x00000000",
    "modFXFeedback": "0x80000000",
}
_KIT_FILTERS = [
    ("delay", {"rate": "0x00000000", "feedback": "0x80000000"}),
    ("lpf", {"frequency": "0x7FFFFFFF", "resonance": "0x80000000"}),
    ("hpf", {"frequency": "0x80000000", "resonance": "0x80000000"}),
]
_ENVELOPE_1 = {"attack": "0x80000000", "decay": "0xE6666654", "sustain": "0x7FFFFFFF"}
_ENVELOPE_2 = [("envelope2", {"attack": "0xE6666654", "decay": "0xE6666654", "sustain": "0xFFFFFFE9", "release": "0xE6666654"})]
# What the sixteen knobs turn, and for one the source whose amount it turns.
_KNOBS = (
    ("pan", None), ("volumePostFX", None), ("lpfResonance", None), ("lpfFrequency", None),
    ("env1Release", None), ("env1Attack", None), ("delayFeedback", None), ("delayRate", None),
    ("reverbAmount", None), ("volumePostReverbSend", "compressor"), ("pitch", "lfo1"), ("lfo1Rate", None),
    ("portamento", None), ("stutterRate", None), ("bitcrushAmount", None), ("sampleRateReduction", None),
)
_CABLES = (("velocity", "volume", "0x3FFFFFE8"), ("aftertouch", "volume", "0x2A3D7094"), ("y", "lpfFrequency", "0x19999990"))
# A filter that opens with velocity, a wheel that darkens, a vibrato at full pressure, the release of what has none to measure.
VELOCITY_FILTER = {"lpfMode": "12dB", "lpfFrequency": "0x4CCCCCA8", "cable": "0x19999990"}
DARKEN_UNITS, VIBRATO_UNITS, FULL_DEPTH, DEFAULT_RELEASE, DETUNE_CENTS = -20, 5, "0x3FFFFFE8", "0x02000000", 6
CHOKED, DUCKING = ("hat_closed", "hat_open"), "kick"


def fraction(share: float) -> str:
    """0 to 1 over the whole range of a signed 32-bit word."""
    return f"0x{round(min(max(share, 0.0), 1.0) * (2**32 - 1) - 2**31) & 0xFFFFFFFF:08X}"


def cable_amount(units: float) -> str:
    """-50 to 50 over half that range, with nothing at 0."""
    return f"0x{round(min(max(units, -50.0), 50.0) / 50 * 2**30) & 0xFFFFFFFF:08X}"


def _add(parent: ElementTree.Element, elements: list[tuple[str, dict[str, str]]]) -> None:
    for name, attributes in elements:
        ElementTree.SubElement(parent, name, attributes)


def _sample_osc(mode: int) -> dict[str, str]:
    return {**_SAMPLE_OSC, "loopMode": str(mode)}


def _text(root: ElementTree.Element) -> str:
    ElementTree.indent(root)
    return "<?xml version='1.0' encoding='UTF-8'?>\n" + ElementTree.tostring(root, encoding="unicode") + "\n"


@dataclass(frozen=True)
class Voice:
    """How a preset is played, and what is done about it."""

    polyphonic: str = "poly"
    glide: float = 0.0
    velocity_filter: bool = False
    darken: bool = False
    vibrato: bool = False
    release: str = DEFAULT_RELEASE


def _zone(parent: ElementTree.Element, s: dict, through: bool) -> None:
    """Positions in a file: in a range that loops through its release, the loop's end is the sample's."""
    looped, frames = s.get("loop_start") is not None, s["frames"]
    end = min(s["loop_stop"], frames) if looped and through else frames
    loop = {} if not looped else {"startLoopPos": str(s["loop_start"])} | ({} if through else {"endLoopPos": str(s["loop_stop"])})
    ElementTree.SubElement(parent, "zone", {"startSamplePos": "0", "endSamplePos": str(end), **loop})


def _cables(parent: ElementTree.Element, extra: list[tuple] = (), wheel: str = _CABLES[2][2]) -> None:
    box = ElementTree.SubElement(parent, "patchCables")
    for source, destination, amount, *depth in (*_CABLES[:2], (*_CABLES[2][:2], wheel), *extra):
        cable = ElementTree.SubElement(box, "patchCable", {"source": source, "destination": destination, "amount": amount})
        if depth:
            ElementTree.SubElement(ElementTree.SubElement(cable, "depthControlledBy"), "patchCable", {"source": depth[0], "amount": depth[1]})


def _knobs(parent: ElementTree.Element, other: dict[int, str]) -> None:
    box = ElementTree.SubElement(parent, "modKnobs")
    for k, (name, source) in enumerate(_KNOBS):
        name = other.get(k, name)
        ElementTree.SubElement(box, "modKnob", {"controlsParam": name} | ({"patchAmountFromSource": source} if source else {}))


def _sound(tag: str, **attributes: str) -> ElementTree.Element:
    return ElementTree.Element(tag, {**(_ROOT if "name" not in attributes else {}), **attributes})


def multisample(samples: list[dict], voice: Voice = Voice(), through: set[int] | None = None) -> str:
    """One range for each note up to the next one, the last up to six semitones more. ``through``: notes that loop through their release, if all loop."""
    root = _sound("sound", polyphonic=voice.polyphonic, voicePriority="1", mode="subtractive", lpfMode=VELOCITY_FILTER["lpfMode"] if voice.velocity_filter else "24dB", modFXType="none")
    osc = ElementTree.SubElement(root, "osc1", _sample_osc(0 if through is None else 2))
    ranges, by_note = ElementTree.SubElement(osc, "sampleRanges"), sorted(samples, key=lambda s: s["note"])
    tops = [s["note"] - 1 for s in by_note[1:]] + [by_note[-1]["note"] + 6] if by_note else []
    for s, top in zip(by_note, tops, strict=True):
        one = ElementTree.SubElement(ranges, "sampleRange", {"rangeTopNote": str(top), "fileName": s["file"], "transpose": str(48 - s["note"])})
        _zone(one, s, through is not None and s["note"] in through)
    _add(root, [("osc2", {"type": "square", "transpose": "0", "cents": "0", "retrigPhase": "-1"}), *_LFOS, *_UNISON, *_EFFECTS])
    own = {"portamento": fraction(voice.glide)} if voice.glide > 0 else {}
    own |= {"lpfFrequency": VELOCITY_FILTER["lpfFrequency"]} if voice.velocity_filter else {}
    params = ElementTree.SubElement(root, "defaultParams", _PARAMS | own)
    _add(params, [("envelope1", {**_ENVELOPE_1, "release": voice.release}), *_ENVELOPE_2])
    extra = [("velocity", "lpfFrequency", VELOCITY_FILTER["cable"])] if voice.velocity_filter else []
    extra += [("lfo1", "pitch", cable_amount(VIBRATO_UNITS), "aftertouch", FULL_DEPTH)] if voice.vibrato else []
    _cables(params, extra, cable_amount(DARKEN_UNITS) if voice.darken else _CABLES[2][2])
    _add(params, _EQUALIZER)
    _add(root, _ARPEGGIATOR)
    return _text(root)


def wavetable(file: str, shape: dict) -> str:
    """One table on two oscillators a little apart; an LFO sweeps their positions in opposite directions.

    ``shape``: wt_position, lfo2_rate, lfo2_depth, filter_cutoff, attack, decay, sustain, release, from 0 to 1.
    """
    root = _sound("sound", polyphonic="poly", voicePriority="1", mode="subtractive", lpfMode="24dB", modFXType="none")
    for name, cents in (("osc1", -DETUNE_CENTS), ("osc2", DETUNE_CENTS)):
        ElementTree.SubElement(root, name, {"type": "wavetable", "transpose": "0", "cents": str(cents), "retrigPhase": "-1", "fileName": file})
    _add(root, [*_SYNCED_LFOS, *_UNISON, *_EFFECTS])
    at, base = fraction(shape["wt_position"]), dict(_PARAMS)
    base |= {"oscAVolume": fraction(1), "oscBVolume": fraction(1), "lpfFrequency": fraction(shape["filter_cutoff"]), "lfo2Rate": fraction(shape["lfo2_rate"])}
    ordered = {}
    for k, v in base.items():  # a position stands after its oscillator's pulse width
        ordered[k] = v
        if k.endswith("PulseWidth"):
            ordered[k.replace("PulseWidth", "WavetablePosition")] = at
    params = ElementTree.SubElement(root, "defaultParams", ordered)
    _add(params, [("envelope1", {k: fraction(shape[k]) for k in ("attack", "decay", "sustain", "release")}), *_ENVELOPE_2])
    sweep = min(max(shape["lfo2_depth"], 0.0), 1.0) * 50
    _cables(params, [("lfo2", "oscAWavetablePosition", cable_amount(sweep)), ("lfo2", "oscBWavetablePosition", cable_amount(-sweep))])
    _add(params, _EQUALIZER)
    _add(root, _ARPEGGIATOR)
    _knobs(root, {14: "oscBWavetablePosition", 15: "oscAWavetablePosition"})
    return _text(root)


def kit(samples: list[dict]) -> str:
    """One sound for each hit, in the order of notes: hats choke each other, kicks duck the mix, all play to their end."""
    root = _sound("kit", lpfMode="24dB", modFXType="flanger", modFXCurrentParam="feedback", currentFilterType="lpf")
    _add(root, _EFFECTS)
    _add(ElementTree.SubElement(root, "defaultParams", _KIT_PARAMS), [*_KIT_FILTERS, *_EQUALIZER])
    box = ElementTree.SubElement(root, "soundSources")
    for s in sorted(samples, key=lambda s: s["note"]):
        category = s.get("category")
        sends = {"sideChainSend": "2147483647"} if category == DUCKING else {}
        name = s.get("instrument") or f"note{s['note']:03d}"
        sound = _sound("sound", name=name, polyphonic="choke" if category in CHOKED else "auto", voicePriority="1", **sends, mode="subtractive", lpfMode="24dB", modFXType="none")
        box.append(sound)
        _zone(ElementTree.SubElement(sound, "osc1", _sample_osc(1) | {"fileName": s["file"]}), s, False)
        _add(sound, [("osc2", _sample_osc(0)), *_LFOS, *_UNISON, *_EFFECTS])
        params = ElementTree.SubElement(sound, "defaultParams", _PARAMS | {"oscAVolume": "0x7FFFFFFF"})
        _add(params, _EQUALIZER)
        _add(sound, _ARPEGGIATOR)
        _cables(params)
    ElementTree.SubElement(root, "selectedDrumIndex").text = "1"
    return _text(root)


def card_places(collection: str, name: str, subfolder: str, drums: bool) -> tuple[str, str]:
    """(folder of the samples, path of the document) on the card; parts of a subfolder that lead elsewhere are left out."""
    inner = [p for p in subfolder.split("/") if p not in ("", ".", "..")]
    return posixpath.join("SAMPLES", collection, *inner, name), posixpath.join("KITS" if drums else "SYNTHS", collection, *inner, f"{name}.xml")


def on_card(path: str) -> str:
    """A path from the card's sample folder on."""
    parts = path.split("/")
    return "/".join(parts[parts.index("SAMPLES") :]) if "SAMPLES" in parts else path


DOCUMENT = "preset string, path string, document string, error string"


def documents(shipped: DataFrame) -> DataFrame:
    """(preset, path, document, error) of shipped samples, one document for each preset.

    Columns: preset, collection, subfolder, category (drum, wavetable or another), note, velocity, take, file, frames, loop_start,
    loop_stop, tail (whether what follows the loop is a release), instrument, hit (the drum's category), release_s, shape (map of
    a wavetable's values). Of a note the sample nearest to velocity 100 and then of the lowest take is shipped.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["note"], abs((r["velocity"] or 100) - 100), r["velocity"] or 0, r["take"] or 1, r["file"]))
        first: dict[int, dict] = {}
        for r in rows:
            first.setdefault(r["note"], {**r, "file": on_card(r["file"]), "category": r["hit"]})
        kept, kind, preset = list(first.values()), rows[0]["category"], rows[0]["preset"]
        path, document, error = None, None, None
        try:
            if kind == "granular":
                raise ValueError("this device has no grain engine")
            path = card_places(rows[0]["collection"] or "", preset, rows[0]["subfolder"] or "", kind == "drum")[1]
            if kind == "drum":
                document = kit(kept)
            elif kind == "wavetable":
                document = wavetable(kept[0]["file"], dict(rows[0]["shape"] or ()))
            else:
                times = [r["release_s"] for r in kept if r["release_s"] is not None]
                release = fraction(nearest_release(float(np.median(times))) / 50) if times else DEFAULT_RELEASE
                through = {r["note"] for r in kept if not r["tail"]} if all(r["loop_start"] is not None for r in kept) else None
                document = multisample(kept, Voice(release=release), through)
        except (KeyError, ValueError) as e:
            error = f"{type(e).__name__}: {e}"
        return pa.table({k: pa.array([v], pa.string()) for k, v in (("preset", preset), ("path", path), ("document", document), ("error", error))})

    return shipped.groupBy("preset", "collection", "subfolder").applyInArrow(run, DOCUMENT)


# Seconds in which envelope 1 falls by 40 dB at release 0, 1, ... 50.
RELEASE_S = (
    0.004, 0.042, 0.085, 0.132, 0.179, 0.226, 0.276, 0.329, 0.383, 0.439,
    0.499, 0.562, 0.626, 0.694, 0.762, 0.836, 0.914, 1.001, 1.082, 1.177,
    1.268, 1.375, 1.486, 1.599, 1.711, 1.862, 1.988, 2.132, 2.299, 2.452,
    2.675, 2.829, 3.065, 3.344, 3.588, 3.872, 4.203, 4.458, 4.904, 5.254,
    5.885, 6.397, 7.006, 7.743, 8.654, 9.808, 11.317, 12.26, 14.712, 16.347,
    21.017,
)


def nearest_release(seconds: float) -> int:
    """The release whose fall is nearest on a logarithmic scale."""
    return int(np.argmin(np.abs(np.log(np.array(RELEASE_S) / max(seconds, RELEASE_S[0])))))
