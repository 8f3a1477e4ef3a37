"""From the renders of a probe to plans: how long to hold and ring, mono or stereo, layers or one, which profile.

A host renders a few notes of every preset; that table is where this begins. A
row is one render: ``role`` says what it is for (short and long holds of the
probe's note, a soft one, the lowest note, notes to classify). The renders of
one preset, a handful, are judged together; presets are dealt to all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources import configs
from . import envelope, loops
from .folders import EVOLVING, FIRST_NOTE, LAST_NOTE, NOTE_STEP, SEAM_STEP, SEAM_VOTES, SEAM_WINDOW_S

# How much louder a held note is than one let go to count as sustained, what of its peak is left late in the hold and what is late, the window after
# the note's end in seconds; seconds of release that a sustained sound gets at least, and as a share of its hold; shares of classes.
RATIO, LATE_LEFT, LATE_FROM, WINDOW_S = 5.0, 0.10, 0.8, 1.0
LEAST_RELEASE_S, RELEASE_SHARE = 2.0, 0.25
RHYTHM_SEEN, RHYTHM_AGREED = 0.30, 0.15
RENDERS = "preset string, role string, note int, rate int, left array<double>, right array<double>, hold long"
PROBED = (
    "preset string, profile string, flags array<string>, confidence string, sustains boolean, duration_s double, release_tail_s double, side_db double, velocity_shift double, "
    "sample_rate int, error string"
)


def holds(short: np.ndarray, long: np.ndarray, hold: int, rate: int) -> bool:
    """Whether a sound lasts while its key is held: louder after the long hold than the short one's leavings, and not mostly decayed by then."""
    level = lambda x: float(np.sqrt(np.mean(x[:, hold : hold + int(WINDOW_S * rate)] ** 2))) if x.shape[1] > hold else 0.0
    if level(long) / (level(short) + 1e-9) <= RATIO:
        return False
    rms = envelope.block_rms(long.mean(0)[:hold], envelope.HOP, False)
    if not len(rms) or rms.max() <= 0:
        return True
    late = rms[int(LATE_FROM * len(rms)) :]
    return bool(late.mean() >= LATE_LEFT * rms.max())


def _profile(classify: list[dict], bpm: float | None) -> tuple[str, str | None]:
    """The vote of the classified notes, and why it must not loop."""
    kinds, periods, steps = [], [], []
    for r in classify:
        x = r["audio"].mean(0)
        lead, trail = envelope.trim(x)
        cut = x[lead:trail]
        env = envelope.analyse(cut, r["rate"], r["hold"] - lead, bpm)
        kinds.append(env.classification == "pluck")
        if env.modulation_period:
            periods.append(round(env.modulation_period / r["rate"], 2))
        if not kinds[-1]:
            found = loops.best(cut, r["rate"], env.sustain_start, env.sustain_end, note=r["note"], bpm=bpm, modulation=env.modulation_period)
            step = loops.timbre_step(cut, found[0], found[1], int(SEAM_WINDOW_S * r["rate"]), r["rate"]) if found else None
            steps += [step] if step is not None else []
    if 2 * sum(kinds) > len(kinds):
        return "pluck", None
    median = float(np.median(steps)) if len(steps) >= SEAM_VOTES else 0.0
    if median > SEAM_STEP:
        return "pluck", EVOLVING.format(f"{median:.0f}")
    agreed = max((periods.count(p) for p in periods), default=0)
    rhythm = len(periods) >= RHYTHM_SEEN * len(kinds) and agreed >= RHYTHM_AGREED * len(kinds) and agreed > 0
    return ("pad" if rhythm else "synth"), None


def judged(renders: list[dict], sustain_s: float, profile: str | None, bpm: float | None) -> dict:
    """What the renders of one preset say. Raises where the long or the short one is missing."""
    of = {r["role"]: r for r in renders if r["role"] != "classify"}
    classify = [r for r in renders if r["role"] == "classify"]
    long, short = of["long"], of["short"]
    rate, hold = long["rate"], long["hold"]
    sustains = holds(short["audio"], long["audio"], hold, rate)
    found = envelope.probe(long["audio"].mean(0), rate, hold, sustains)
    flags = list(found["flags"])
    duration, tail = found["duration_s"], found["release_tail_s"]
    if found["sustains"]:
        duration, tail = sustain_s, max(tail, LEAST_RELEASE_S, RELEASE_SHARE * sustain_s)
    elif "low" in of:  # a pluck rings longest at the lowest note
        low = envelope.probe(of["low"]["audio"].mean(0), rate, of["low"]["hold"], False)
        duration, tail = max(duration, low["duration_s"]), max(tail, low["release_tail_s"])
    sides = [envelope.side_db(*long["audio"])]
    kind, why = profile or "pluck", None
    if profile is None and sustains:
        kind, why = _profile(classify, bpm) if classify else ("synth", None)
        sides += [envelope.side_db(*r["audio"]) for r in classify]
    shift = envelope.centroid_shift(of["soft"]["audio"].mean(0), long["audio"].mean(0)) if "soft" in of else None
    return {
        "profile": kind, "flags": flags + ([why] if why else []), "confidence": found["confidence"], "sustains": found["sustains"], "duration_s": duration, "release_tail_s": tail,
        "side_db": max(sides), "velocity_shift": shift, "sample_rate": rate,
    }


def probed(renders: DataFrame, sustain_s: float = 8.0, profile: str | None = None, bpm: float | None = None) -> DataFrame:
    """One row per preset of ``renders``; a preset that can't be judged has its error and takes no other with it."""
    arrow = to_arrow_schema(StructType.fromDDL(PROBED))

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = {"preset": rows[0]["preset"], "error": None}
        try:
            for r in rows:
                r["audio"] = np.array([r["left"] or [], r["right"] if r["right"] is not None else r["left"] or []], float)
            rows.sort(key=lambda r: (r["role"] or "", r["note"] or 0))
            out |= judged(rows, sustain_s, profile, bpm)
        except (KeyError, ValueError, TypeError, ZeroDivisionError, IndexError) as e:
            out["error"] = f"{type(e).__name__}: {e}"
        return pa.Table.from_pylist([{n: out.get(n) for n in arrow.names}], schema=arrow)

    columns = [c.split()[0] for c in RENDERS.split(", ")]
    return renders.select(*columns).groupBy("preset").applyInArrow(run, PROBED)


def scan_probed(renders: DataFrame, presets: DataFrame, out: str, note_step: int = NOTE_STEP, low: int = FIRST_NOTE, high: int = LAST_NOTE, **options) -> DataFrame:
    """Write a plan for every preset that its renders allow to judge; returns (place, preset, path).

    ``presets``: (preset, source: the plan's source lines, subfolder, performance: its lines or null). ``options``: those of ``probed``.
    """
    found = probed(renders, **options).where("error IS NULL").join(presets, "preset")
    rows = found.withColumns({"note_step": F.lit(note_step), "low": F.lit(low), "high": F.lit(high), "place": F.coalesce("subfolder", F.lit(""))})
    return configs.write_plans(rows.select("place", "preset", configs.plan_text(rows).alias("text")), out)
