"""Plans as YAML: profiles, a reader that lays a plan over its profile and the defaults, and a writer of plan texts."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import sanitised
from .readers import _files, plain_path

# What a plan has that says nothing else, by section.
DEFAULTS = {
    "capture": {"note_range": [36, 96], "note_step": 3, "velocities": [100], "round_robins": 1, "duration_s": 4.0, "release_tail_s": 2.0, "tempo_bpm": 120.0, "sample_rate": 48000, "mono": False},
    "analysis": {
        "trim": True, "pitch_verify": True, "pitch_tolerance_cents": 50.0, "loop": False, "loop_detect": True, "loop_use_tempo": False, "loop_quality_threshold": 0.8,
        "loop_crossfade_ms": None, "tempo_bpm": None, "normalize": "per_set", "classify_drums": False,
    },
    "output": {"name": None, "subfolder": "", "folder": ""},
    "performance": {"voice_mode": "poly", "glide": 0.0, "mod_wheel": None, "aftertouch": None},
}
# The profiles a plan may name.
PROFILES = {
    "drums": {
        "category": "drum", "capture": {"note_range": [21, 108], "note_step": 1, "velocities": [64, 100, 127], "round_robins": 3, "duration_s": 2, "release_tail_s": 1},
        "analysis": {"loop": False, "pitch_verify": False, "normalize": "per_sample", "classify_drums": True},
    },
    "pad": {
        "category": "synth", "capture": {"note_range": [24, 96], "note_step": 3, "velocities": [100], "round_robins": 1, "duration_s": 8, "release_tail_s": 5},
        "analysis": {"loop": True, "loop_use_tempo": True, "loop_quality_threshold": 0.8, "normalize": "per_set"},
    },
    "pluck": {
        "category": "synth", "capture": {"note_range": [21, 108], "note_step": 3, "velocities": [100], "round_robins": 1, "duration_s": 2, "release_tail_s": 1},
        "analysis": {"loop": False, "normalize": "per_set"},
    },
    "synth": {
        "category": "synth", "capture": {"note_range": [21, 108], "note_step": 3, "velocities": [100], "round_robins": 1, "duration_s": 4, "release_tail_s": 2},
        "analysis": {"loop": True, "loop_use_tempo": False, "normalize": "per_set"},
    },
}
# Kinds of sources with what each needs, paths first; ways a voice plays; layers of a preset that velocity changes.
SOURCES = {
    "vst": ("plugin",), "clap": ("plugin", "plugin_id"), "library": ("path",), "bitwig": ("path",), "sfz": ("path",), "kontakt": ("path",), "wavetable": ("path",), "granular": ("path",),
}
SOURCE_PATHS = ("plugin", "path", "preset_path", "partner")
VOICES = ("poly", "mono", "legato")
VELOCITY_LAYERS = [40, 90, 127]
SECTIONS = ("source", "capture", "analysis", "output", "profile", "name", "category", "wavetable", "granular", "performance")

PLAN = (
    "path string, name string, category string, profile string, source_type string, source_path string, preset string, files array<string>, low int, high int, note_step int, "
    "velocities array<int>, round_robins int, duration_s double, release_tail_s double, tempo_bpm double, sample_rate int, mono boolean, loop boolean, loop_detect boolean, "
    "loop_quality_threshold double, loop_crossfade_ms double, normalize string, classify_drums boolean, subfolder string, folder string, voice_mode string, glide double, "
    "settings map<string,string>, unknown array<string>, error string"
)


def merged(base: dict, over: dict) -> dict:
    """``over`` laid on ``base``, section in section; what isn't a section on both sides is replaced."""
    both = {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}
    return {**base, **both}


def plan_row(path: str, raw: dict) -> dict:
    """A typed plan. Raises where it can't be one: no source, an unknown type or profile, or a type's field missing."""
    if "profile" in raw:
        raw = merged(PROFILES[raw["profile"]], raw)
    unknown = [k for k in raw if k not in SECTIONS] + [f"{s}.{k}" for s, known in DEFAULTS.items() for k in (raw.get(s) or {}) if k not in known]
    source, here = raw["source"], posixpath.dirname(path)
    for needed in SOURCES[source["type"]]:
        source[needed]
    absolute = lambda p: None if p is None else posixpath.normpath(posixpath.join(here, str(p)))
    source = {**source, **{k: absolute(source[k]) for k in SOURCE_PATHS if source.get(k)}}
    c, a, o, p = (merged(DEFAULTS[s], raw.get(s) or {}) for s in DEFAULTS)
    if o["name"] is None:
        raise KeyError("output.name")
    own = {f"{s}.{k}": str(v) for s in ("source", "wavetable", "granular") for k, v in ((source if s == "source" else raw.get(s)) or {}).items() if k != "files"}
    return {
        "path": path, "name": str(raw.get("name", o["name"])), "category": raw.get("category", "synth"), "profile": raw.get("profile"), "source_type": source["type"],
        "source_path": source[SOURCES[source["type"]][0]], "preset": source.get("preset"), "files": [absolute(f) for f in source["files"]] if source.get("files") is not None else None,
        "low": c["note_range"][0], "high": c["note_range"][1], "subfolder": o["subfolder"], "folder": o["folder"], "glide": float(p["glide"]),
        "voice_mode": p["voice_mode"] if p["voice_mode"] in VOICES else "poly", "settings": own, "unknown": sorted(unknown), "error": None,
        **{k: c[k] for k in ("note_step", "velocities", "round_robins", "sample_rate", "mono")}, **{k: float(c[k]) for k in ("duration_s", "release_tail_s", "tempo_bpm")},
        **{k: a[k] for k in ("loop", "loop_detect", "normalize", "classify_drums")}, **{k: None if a[k] is None else float(a[k]) for k in ("loop_quality_threshold", "loop_crossfade_ms")},
    }


_ARROW = {
    "string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()),
    "map<string,string>": pa.map_(pa.string(), pa.string()),
}


def plans(spark: SparkSession, folder: str, pattern: str = "*.yaml") -> DataFrame:
    """One row per plan file of a folder and those below it; a file that is none has its path and an error."""
    fields = [x.split(" ") for x in PLAN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        for batch in batches:
            rows = []
            for uri, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                path = plain_path(uri)
                try:
                    rows.append(plan_row(path, yaml.safe_load(raw)))
                except Exception as e:  # one bad file must not end the scan
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"})
            pairs = lambda v: list(v.items()) if isinstance(v, dict) else v
            yield pa.RecordBatch.from_arrays([pa.array([pairs(r.get(k)) for r in rows], _ARROW[t]) for k, t in fields], names=[k for k, _ in fields])

    return _files(spark, folder, pattern).mapInArrow(run, PLAN)


def profiles(spark: SparkSession) -> DataFrame:
    """The profiles as rows: name, category, and the settings that each brings."""
    rows = [(n, p["category"], {f"{s}.{k}": str(v) for s in ("capture", "analysis") for k, v in p[s].items()}) for n, p in PROFILES.items()]
    return spark.createDataFrame(rows, "profile string, category string, settings map<string,string>")


def with_profile(plans_: DataFrame, only: str | None) -> DataFrame:
    """The plans of one profile; all without one."""
    return plans_ if only is None else plans_.where(F.col("profile") == only)


def few(plans_: DataFrame, most: int = 5, seed: int | None = None) -> DataFrame:
    """A handful of plans to try things with, the same in every run: the first by path, or with a ``seed`` a sample of all of them."""
    return plans_.orderBy(*([] if seed is None else [F.xxhash64(F.lit(seed), "path")]), "path").limit(most)


def quoted(text: Column) -> Column:
    """A double-quoted YAML scalar."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def plan_text(p: DataFrame) -> Column:
    """The YAML text of a probed preset, with a review line for what was flagged and a line with what was measured.

    Columns: preset, source (its lines), profile, flags, confidence, sustains, duration_s, release_tail_s, side_db, velocity_shift, low, high,
    note_step, sample_rate, subfolder, performance (its lines, or null).
    """
    c, text = F.col, F.lit
    line = lambda when, *parts: F.when(when, F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))).otherwise("")
    drums, mono = c("profile") == "drums", F.coalesce(c("side_db") <= -60, F.lit(False))
    side = F.when(c("side_db") == float("-inf"), "identical").when(c("side_db") == float("inf"), "anti-phase").otherwise(F.concat(F.bround("side_db").cast("long").cast("string"), text(" dB")))
    sensitive = F.coalesce(c("velocity_shift") >= 0.03, F.lit(False))
    measured = F.concat(
        text("confidence="), c("confidence"), text(" sustains="), F.when(c("sustains"), "yes").otherwise("no"), text(" release="), F.format_string("%.1f", c("release_tail_s")), text("s"),
        line(c("side_db").isNotNull(), " channels=", F.when(mono, "mono").otherwise("stereo"), " (side ", side, ")"),
        line(c("velocity_shift").isNotNull(), " velocity_shift=", F.format_string("%.3f", c("velocity_shift")), F.when(sensitive, " (sensitive)").otherwise("")),
    )
    return F.concat(
        line(F.size("flags") > 0, "# REVIEW: ", F.array_join("flags", ", "), "\n"), text("# "), measured, text("\nsource:\n"), c("source"), text("\nprofile: "), c("profile"), text("\n\ncapture:\n"),
        line(c("sample_rate") != 48000, "  sample_rate: ", c("sample_rate"), "\n"), line(~drums, "  note_range: [", c("low"), ", ", c("high"), "]\n"), line(~drums, "  note_step: ", c("note_step"), "\n"),
        text("  duration_s: "), c("duration_s").cast("string"), text("\n  release_tail_s: "), c("release_tail_s").cast("string"), text("\n"), line(mono, "  mono: true\n"),
        line(sensitive & ~drums, f"  velocities: {VELOCITY_LAYERS}\n"), text("\noutput:\n  name: "), quoted(c("preset")), text("\n"),
        line(F.coalesce(c("subfolder"), text("")) != "", "  subfolder: ", quoted(c("subfolder")), "\n"), line(c("performance").isNotNull(), "\n", c("performance")),
    )


def write_plans(presets: DataFrame, folder: str) -> DataFrame:
    """Write one file for each row (place, preset, text) under ``folder``; returns (place, preset, path).

    The stem is the sanitised preset name. A name that is taken, by a file that is there or by a row before (in the order of
    preset and text), gets the next free suffix _2, _3 and so on, place by place.
    """
    spark = presets.sparkSession
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").option("recursiveFileLookup", "true")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(target)
    root = system.getFileStatus(target).getPath().toString().rstrip("/")
    held = there.load(folder).select(F.substr("path", F.lit(len(root) + 2)).alias("at")).select(F.regexp_replace("at", "/?[^/]*$", "").alias("place"), F.regexp_extract("at", r"([^/]*)\.yaml$", 1).alias("stem"))
    rows = presets.select(F.coalesce("place", F.lit("")).alias("place"), "preset", "text", sanitised(F.col("preset")).alias("stem"))
    both = rows.withColumn("held", F.lit(False)).unionByName(held.select("place", F.lit(None).cast("string").alias("preset"), F.lit(None).cast("string").alias("text"), "stem", F.lit(True).alias("held")))

    def write(table: pa.Table) -> pa.Table:
        from .readers import Beside

        found = sorted(table.to_pylist(), key=lambda r: (not r["held"], r["preset"] or "", r["text"] or ""))
        taken = {r["stem"] for r in found if r["held"]}
        out = []
        for r in found:
            if r["held"]:
                continue
            stem, number = r["stem"], 1
            while stem in taken:
                number += 1
                stem = f"{r['stem']}_{number}"
            taken.add(stem)
            files = Beside(f"{root}/{r['place']}/x".replace("//x", "/x") if r["place"] else f"{root}/x")
            files.files.create_dir(files.folder, recursive=True)
            with files.files.open_output_stream(f"{files.folder}/{stem}.yaml", compression=None) as f:
                f.write((r["text"] or "").encode())
            out.append({"place": r["place"], "preset": r["preset"], "path": f"{files.folder}/{stem}.yaml"})
        return pa.Table.from_pylist(out, pa.schema([("place", pa.string()), ("preset", pa.string()), ("path", pa.string())]))

    return both.groupBy("place").applyInArrow(write, "place string, preset string, path string")
