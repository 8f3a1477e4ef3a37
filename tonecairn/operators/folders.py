"""From folders of WAV files to plans: libraries, single notes, wavetables, grain sources, archives and kits from single hits.

Files are listed by Spark. Names decide what names can; audio is opened for the
files that a decision needs, a few of each folder of a library, all of a folder
of presets, in the tasks that have their paths.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import labels as L
from ..functions import vocabulary as V
from ..sources import configs, readers, riff
from . import envelope, kits, loops, matching, scans, wavetables

# The notes and steps that a plan without wishes plays, the notes at which a folder is listened to, the pitch classes of letters.
NOTE_STEP, FIRST_NOTE, LAST_NOTE = 3, 24, 84
LISTENED = (48, 60, 72)
# Files looked at for an author's loops, of a folder and in all; window of a loop's timbre, and the median step that no loop hides.
PROBED, PROBED_ALL = 3, 48
SEAM_WINDOW_S, SEAM_STEP, SEAM_VOTES = 0.3, 16.0, 3
# Envelope of each archetype of tables; seconds that a grain source has at least; notes between which a root is believed.
SHAPES = {"sustaining": (0.10, 0.35, 0.90, 0.35), "evolving": (0.75, 0.60, 1.00, 0.85), "percussive": (0.00, 0.25, 0.00, 0.15)}
LEAST_GRAIN_S, BELIEVED = 1.5, (12, 108)
MARGINAL = ("tonality", "movement")
# What the review line of a plan says.
EVOLVING = "evolving timbre (loop seam {}) — looping disabled"
NO_DRUMS = "no drum/percussion instrument keywords recognized in any filename — verify manually"
ONE_DRUM = "all {} files classified as '{}' — verify this is a complete kit, not a single-instrument multisample"
NO_PITCH = "pitch detection failed — defaulted to C4, verify root note manually"
NO_OCTAVE = "pitch detection failed — verify root note/octave manually"
ODD_PITCH = "detected pitch implausible ({} Hz) — verify root note/octave manually"
SHORT_GRAIN = "only {} s long -- too short to hold a grain cloud"
FALLBACK = "no exact '{}' match for {} (used Various/any-file fallback)"

_WAV = "*.[wW][aA][vV]"


def wav_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, below): every WAV file and its place below ``folder``; files and folders whose names begin with a dot are passed over."""
    root = readers.plain_path(folder).rstrip("/")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", _WAV).option("recursiveFileLookup", "true").load(folder).select(scans._path(F.col("path")).alias("path"))
    return listed.select("path", F.substr("path", F.lit(len(root) + 2)).alias("below")).where(~F.col("below").rlike(r"(^|/)\."))


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.[^.]*$", "")


def _bytes(path: str) -> bytes:
    return readers.Beside(path).read(posixpath.basename(path)) or b""


def _from_files(rows: DataFrame, kernel, ddl: str) -> DataFrame:
    """The columns of ``rows`` and what ``kernel`` makes of the file at ``path``; a file that can't be read gives an error and nulls."""
    schema = StructType(rows.schema.fields + StructType.fromDDL(f"{ddl}, error string").fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    out.append(row | kernel(row, _bytes(row["path"])) | {"error": None})
                except (ValueError, TypeError, OSError, ZeroDivisionError) as e:
                    out.append(row | {"error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema)


def ships_loops(files: DataFrame) -> bool:
    """Whether an author set loops: of a folder's first files some are opened, folders nearest to the root first, and few in all."""
    folder = F.regexp_replace("below", "/?[^/]*$", "")
    depth = F.when(folder == "", 0).otherwise(F.size(F.split(folder, "/")))
    order = [depth, F.replace(folder, F.lit("/"), F.lit("\0")), "below"]  # a folder before those whose names it begins
    first = files.withColumn("_k", F.row_number().over(Window.partitionBy(folder).orderBy("below"))).where(F.col("_k") <= PROBED)
    probed = first.orderBy(*order).limit(PROBED_ALL).select("path")
    looped = _from_files(probed, lambda row, raw: {"looped": riff.loop_points(raw) is not None}, "looped boolean")
    return not looped.where("looped").isEmpty()


def _review(flags: Column) -> Column:
    return F.when(F.size(flags) > 0, F.concat(F.lit("# REVIEW: "), F.array_join(flags, ", "), F.lit("\n"))).otherwise("")


def _said(text: str, *values: Column) -> Column:
    """``text`` with the values in its braces."""
    pieces = text.split("{}")
    return F.concat(F.lit(pieces[0]), *(x for value, piece in zip(values, pieces[1:], strict=True) for x in (value.cast("string"), F.lit(piece))))


def _lines(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def audio_block(audio: str, detect: bool) -> str:
    """The analysis settings of a plan over finished files; only what differs from the defaults."""
    lines = ([] if detect else ["  loop_detect: false"]) + (["  trim: false", "  normalize: none"] if audio == "verbatim" else [])
    return "analysis:\n" + "\n".join(lines) + "\n\n" if lines else ""


def _detects(mode: str, files: DataFrame) -> bool:
    return mode == "on" or mode != "off" and not ships_loops(files)


def _heard(row: dict, raw: bytes) -> dict:
    """Class, loop of the author and step of the timbre at the loop that would be shipped."""
    rate, stereo = riff.decode(raw)
    x = stereo.mean(0).astype(float)
    lead, trail = envelope.trim(x)
    cut = x[lead:trail]
    env = envelope.analyse(cut, rate)
    found = loops.best(cut, rate, env.sustain_start, env.sustain_end, note=row.get("note"), modulation=env.modulation_period) if env.classification != "pluck" else None
    step = loops.timbre_step(cut, found[0], found[1], int(SEAM_WINDOW_S * rate), rate) if found else None
    period = env.modulation_period / rate if env.modulation_period else None
    return {"pluck": env.classification == "pluck", "period": period, "looped": riff.loop_points(raw) is not None, "step": step}


HEARD = "pluck boolean, period double, looped boolean, step double"


def listened(files: DataFrame) -> DataFrame:
    """For each folder (top, path, stem) the files nearest to the notes that are listened to; its first three where no name has a note."""
    parsed = files.withColumn("p", L.parsed_note(F.col("stem"))).select("top", "path", "stem", F.col("p.note").alias("note"))
    of_note = parsed.where("note IS NOT NULL").groupBy("top", "note").agg(F.min("path").alias("path"))
    near = None
    for target in LISTENED:
        best = of_note.groupBy("top").agg(F.min(F.struct(F.abs(F.col("note") - target).alias("far"), "note", "path")).alias("b"))
        near = best.select("top", "b.note", "b.path") if near is None else near.union(best.select("top", "b.note", "b.path"))
    near = near.distinct()
    unnamed = parsed.join(of_note.select("top").distinct(), "top", "left_anti")
    rank = F.row_number().over(Window.partitionBy("top").orderBy("path"))
    return near.union(unnamed.withColumn("_k", rank).where(F.col("_k") <= len(LISTENED)).select("top", "note", "path"))


def heard_profiles(files: DataFrame, detect: bool) -> DataFrame:
    """(top, profile, flags) of folders of notes, by listening to a few of each."""
    chosen = listened(files)
    none = F.array().cast("array<string>")
    if not detect:  # the author has said which files loop
        looped = _from_files(chosen, lambda row, raw: {"looped": riff.loop_points(raw) is not None}, "looped boolean")
        return looped.groupBy("top").agg(F.max("looped").alias("looped")).select("top", F.when(F.col("looped"), "synth").otherwise("pluck").alias("profile"), none.alias("flags"))
    heard = _from_files(chosen, _heard, HEARD).where("error IS NULL").groupBy("top").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("pluck").alias("plucks"), F.count("period").alias("periods"), F.max("looped").alias("looped"), F.count("step").alias("votes"), F.median("step").alias("step")
    )
    plucked, rhythm = F.col("plucks") * 2 > F.col("n"), (F.col("periods") >= 0.30 * F.col("n")) & (F.col("periods") > 0)
    first = F.when(plucked, "pluck").when(rhythm, "pad").otherwise("synth")
    evolving = ~F.col("looped") & ~plucked & (F.col("votes") >= SEAM_VOTES) & (F.col("step") > SEAM_STEP)
    profile = F.when(F.col("looped") & plucked, "synth").when(evolving, "pluck").otherwise(first)
    flag = _said(EVOLVING, F.bround("step").cast("long"))
    return heard.select("top", profile.alias("profile"), F.when(evolving, F.array(flag)).otherwise(none).alias("flags"))


def drum_profiles(files: DataFrame) -> DataFrame:
    """(top, profile, flags) of folders of hits, by the instruments that their names say."""
    hits = files.withColumn("category", V.drum_category(F.col("stem"))).groupBy("top", "category").agg(F.count(F.lit(1)).alias("n"))
    g = hits.groupBy("top").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.min("category").alias("one"))
    flag = F.when((F.col("kinds") == 1) & (F.col("one") == "other"), NO_DRUMS).when(F.col("kinds") == 1, _said(ONE_DRUM, F.col("n"), F.col("one")))
    return g.select("top", F.lit("drums").alias("profile"), F.when(flag.isNotNull(), F.array(flag)).otherwise(F.array().cast("array<string>")).alias("flags"))


def scan_library(
    spark: SparkSession, folder: str, out: str, library_type: str = "multisample", profile: str | None = None, note_step: int = NOTE_STEP, low: int = FIRST_NOTE, high: int = LAST_NOTE,
    audio: str | None = None, loop_detect: str = "auto",
) -> DataFrame:
    """Write a plan for every folder of a library that has WAV files; returns (place, preset, path).

    ``library_type``: multisample, drumkit (a folder of hits) or kit (folders of hits by instrument; one with hits of its own is a drumkit).
    """
    files = wav_files(spark, folder).where(F.col("below").contains("/"))
    files = files.withColumns({"top": F.substring_index("below", "/", 1), "direct": F.size(F.split("below", "/")) == 2, "stem": _stem(F.col("path"))})
    detect = _detects(loop_detect, files)
    tops = files.groupBy("top").agg(F.max("direct").alias("direct"))
    drums = (F.lit(library_type) == "drumkit") | ((F.lit(library_type) == "kit") & F.col("direct"))
    tops = tops.withColumn("drumkit", drums)
    direct = files.where("direct").join(tops.select("top", "drumkit"), "top")
    none = F.array().cast("array<string>")
    if profile is not None:
        said = tops.select("top", F.lit(profile).alias("profile"), none.alias("flags"))
    else:
        said = drum_profiles(direct.where("drumkit"))
        said = said if library_type in ("kit", "drumkit") else said.union(heard_profiles(direct.select("top", "path", "stem"), detect))
    other = "drums" if library_type in ("kit", "drumkit") else "synth"
    rows = tops.join(said, "top", "left").withColumns({"profile": F.coalesce("profile", F.lit(other)), "flags": F.coalesce("flags", none)})
    root = readers.plain_path(folder).rstrip("/")
    text = _lines(
        _review(F.col("flags")), "source:\n  type: library\n  path: ", configs.quoted(F.concat(F.lit(root + "/"), "top")), "\n", F.when(F.col("drumkit"), "  drumkit: true\n").otherwise(""), "\nprofile: ", F.col("profile"), "\n",
        F.when(F.col("profile") == "drums", "").otherwise(f"\ncapture:\n  note_range: [{low}, {high}]\n  note_step: {note_step}\n"), "\n",
        audio_block(audio or ("processed" if library_type in ("kit", "drumkit") else "verbatim"), detect), "output:\n  name: ", configs.quoted(F.col("top")), "\n",
    )
    return configs.write_plans(rows.select(F.lit("").alias("place"), F.col("top").alias("preset"), text.alias("text")), out)


def letter_class(stem: str) -> int | None:
    """The pitch class of a word that is nothing but a note's letter, with a sharp or flat."""
    for word in stem.replace("_", " ").replace("-", " ").split():
        letter, sign = word[:1].upper(), word[1:]
        if letter in L.NOTES and len(letter) == 1 and sign in ("", "#", "b"):
            return (L.NOTES.index(letter) + {"": 0, "#": 1, "b": -1}[sign]) % 12
    return None


def single_note(hz: float | None, pitch_class: int | None) -> tuple[int, str | None]:
    """The root of a lone file, from its pitch and the letter in its name, and what to look at again."""
    near = lambda note: min(range(pitch_class, 128, 12), key=lambda n: abs(n - note))
    if hz is None:
        if pitch_class is None:
            return 60, NO_PITCH
        return near(60), NO_OCTAVE
    heard = 69 + 12 * float(np.log2(hz / 440))
    note = near(heard) if pitch_class is not None else min(max(round(heard), 0), 127)
    if not BELIEVED[0] <= note <= BELIEVED[1]:
        return note, ODD_PITCH.format(f"{hz:.0f}")
    return note, None


def scan_oneshots(spark: SparkSession, folder: str, out: str, profile: str | None = None, audio: str | None = None, loop_detect: str = "auto") -> DataFrame:
    """Write a plan for every WAV file of a folder, each a preset of one note; returns (place, preset, path)."""
    files = wav_files(spark, folder)
    detect = _detects(loop_detect, files)

    def kernel(row: dict, raw: bytes) -> dict:
        rate, stereo = riff.decode(raw)
        x = stereo.mean(0).astype(float)
        note, flag = single_note(envelope.pitch_hz(x, rate), letter_class(row["stem"]))
        lead, trail = envelope.trim(x)
        env = envelope.analyse(x[lead:trail], rate)
        kind = profile or ("pluck" if env.classification == "pluck" else "pad" if env.modulation_period else "synth")
        if profile is None and kind == "pluck" and riff.loop_points(raw) is not None:
            kind = "synth"  # its author loops it
        return {"note": note, "profile": kind, "flags": [flag] if flag else []}

    direct = files.where(~F.col("below").contains("/")).select("path", _stem(F.col("path")).alias("stem"))
    rows = _from_files(direct, kernel, "note int, profile string, flags array<string>").where("error IS NULL")
    text = _lines(
        _review(F.col("flags")), "source:\n  type: library\n  path: ", configs.quoted(F.col("path")), "\n  note: ", F.col("note"), "\n\nprofile: ", F.col("profile"), "\n\n", audio_block(audio or "verbatim", detect),
        "output:\n  name: ", configs.quoted(F.col("stem")), "\n",
    )
    return configs.write_plans(rows.select(F.lit("").alias("place"), F.col("stem").alias("preset"), text.alias("text")), out)


def scan_bitwig(spark: SparkSession, folder: str, out: str, profile: str | None = None, note_step: int = NOTE_STEP) -> DataFrame:
    """Write a plan for every multisample archive that has zones; loops and roots are their author's. Returns (place, preset, path)."""
    presets = scans.mapped_presets(readers.zones(spark, folder, scans.KINDS["bitwig"]), readers.plain_path(folder), profile=profile)
    c = F.col
    text = _lines(
        _review(c("flags")), "# ", c("zones"), " samples, ", c("notes"), " notes [", c("low"), "-", c("high"), "], ", c("looped"), " looped\nsource:\n  type: bitwig\n  path: ", configs.quoted(c("path")),
        "\n\nprofile: ", c("profile"), f"\n\nanalysis:\n  pitch_verify: false\n\ncapture:\n  note_step: {note_step}\n\noutput:\n  name: ", configs.quoted(c("preset")), "\n",
        F.when(c("subfolder") != "", F.concat(F.lit("  subfolder: "), configs.quoted(c("subfolder")), F.lit("\n"))).otherwise(""),
    )
    return configs.write_plans(presets.select(c("subfolder").alias("place"), "preset", text.alias("text")), out)


TABLE = "archetype string, tag string, wt_position double, lfo2_rate double, lfo2_depth double, filter_cutoff double, flags array<string>, vector array<double>"


def _table(row: dict, raw: bytes) -> dict:
    x = riff.decode(raw)[1].mean(0).astype(float)
    vector = wavetables.fingerprint(x)
    return wavetables.archetype(x) | {"vector": None if vector is None else vector.tolist()}


def table_pairs(tables: DataFrame) -> DataFrame:
    """(path, partner): tables of (path, vector) with a near relative each, by rounds of mutually nearest z-scored vectors."""
    known = tables.where("vector IS NOT NULL").withColumn("vec_id", F.row_number().over(Window.orderBy("path")).cast("long"))
    stats = known.select(F.posexplode("vector").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("mean"), (F.stddev_pop("x") + 1e-9).alias("dev"))
    all_ = stats.groupBy().agg(F.array_sort(F.collect_list(F.struct("k", "mean", "dev"))).alias("s"))
    z = known.withColumn("_all", F.lit(1)).join(F.broadcast(all_.withColumn("_all", F.lit(1))), "_all")
    z = z.select("path", "vec_id", F.lit(0).alias("label"), F.zip_with("vector", "s", lambda x, s: (x - s["mean"]) / s["dev"]).alias("z"))
    pairs = matching.match_groups(z)
    names = z.select("vec_id", "path")
    return pairs.join(names.withColumnRenamed("vec_id", "a"), "a").join(names.select(F.col("vec_id").alias("b"), F.col("path").alias("partner")), "b").select("path", "partner")


def scan_wavetables(spark: SparkSession, folder: str, out: str, archetype: str | None = None, pair: bool = False) -> DataFrame:
    """Write a plan for every table of a folder, or with ``pair`` for every two that are near relatives; returns (place, preset, path).

    The numbers of a pair are means; its archetype, envelope and tag are the first table's. An ``archetype`` that is given overrules the one found.
    """
    direct = wav_files(spark, folder).where(~F.col("below").contains("/")).select("path", _stem(F.col("path")).alias("stem"))
    tables = _from_files(direct, _table, TABLE).where("error IS NULL").drop("error")
    numbers = ["wt_position", "lfo2_rate", "lfo2_depth", "filter_cutoff"]
    if pair:
        other = tables.select(F.col("path").alias("partner"), F.col("stem").alias("_stem"), F.col("flags").alias("_flags"), *(F.col(c).alias(f"_{c}") for c in numbers))
        tables = tables.join(table_pairs(tables.select("path", "vector")), "path").join(other, "partner")
        tables = tables.withColumns({c: (F.col(c) + F.col(f"_{c}")) / 2 for c in numbers} | {"stem": F.concat_ws("+", "stem", "_stem"), "flags": F.array_sort(F.array_union("flags", "_flags"))})
    else:
        tables = tables.withColumn("partner", F.lit(None).cast("string"))
    if archetype is not None:
        tables = tables.withColumns({"archetype": F.lit(archetype), "flags": F.filter("flags", lambda f: ~f.isin(*MARGINAL))})
    shape = F.create_map(*(x for k, v in SHAPES.items() for x in (F.lit(k), F.array(*(F.lit(y) for y in v)))))[F.col("archetype")]
    show = lambda name, value: _lines(f"  {name}: ", F.format_string("%.4f", value), "\n")
    text = _lines(
        _review(F.col("flags")), "source:\n  type: wavetable\n  path: ", configs.quoted(F.col("path")), "\n", F.when(F.col("partner").isNotNull(), F.concat(F.lit("  partner: "), configs.quoted(F.col("partner")), F.lit("\n"))).otherwise(""),
        "\nwavetable:\n  archetype: ", F.col("archetype"), "\n", *(show(c, F.col(c)) for c in numbers), *(show(c, shape[k]) for k, c in enumerate(("attack", "decay", "sustain", "release"))),
        "  filter_type: lpf\n  tag_hint: ", F.col("tag"), "\n\noutput:\n  name: ", configs.quoted(F.col("stem")), "\n",
    )
    return configs.write_plans(tables.select(F.lit("").alias("place"), F.col("stem").alias("preset"), text.alias("text")), out)


def scan_granular(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Write a plan for every sound of a folder, held where it is loud and steady; returns (place, preset, path)."""

    def kernel(row: dict, raw: bytes) -> dict:
        rate, stereo = riff.decode(raw)
        seconds = stereo.shape[1] / rate
        flags = [SHORT_GRAIN.format(f"{seconds:.1f}")] if seconds < LEAST_GRAIN_S else []
        return {"at": wavetables.stillest(stereo.mean(0), rate), "flags": flags}

    direct = wav_files(spark, folder).where(~F.col("below").contains("/")).select("path", _stem(F.col("path")).alias("stem"))
    rows = _from_files(direct, kernel, "at double, flags array<string>").where("error IS NULL")
    text = _lines(
        _review(F.col("flags")), "source:\n  type: granular\n  path: ", configs.quoted(F.col("path")), "\n\ngranular:\n  freeze_pos: ", F.format_string("%.4f", F.col("at")),
        "\n  tag_hint: texture\n\noutput:\n  name: ", configs.quoted(F.col("stem")), "\n",
    )
    return configs.write_plans(rows.select(F.lit("").alias("place"), F.col("stem").alias("preset"), text.alias("text")), out)


def scan_kit_assemble(spark: SparkSession, folder: str, out: str, least: int = 2, audio: str | None = None) -> DataFrame:
    """Write a plan for every flavour of a tree of hits that makes a kit; returns (place, preset, path)."""
    root = readers.plain_path(folder).rstrip("/")
    hits = kits.hit_tree(wav_files(spark, folder).select(F.col("below").alias("path")))
    plans = kits.kit_plans(kits.assembled(hits, kits.flavours(hits, least)))
    title, own = F.initcap("kit"), posixpath.basename(root)
    missing = _said(FALLBACK, title, F.array_join("fallbacks", ", "))
    flags = F.when(F.size("fallbacks") > 0, F.array(missing)).otherwise(F.array().cast("array<string>"))
    files = F.array_join(F.transform("files", lambda f: F.concat(F.lit("    - "), configs.quoted(F.concat(F.lit(root + "/"), f)), F.lit("\n"))), "")
    name = F.concat(F.lit(f"{own} - "), title, F.lit(" Kit"))
    text = _lines(
        _review(flags), "source:\n  type: library\n  path: ", configs.quoted(F.lit(root)), "\n  drumkit: true\n  files:\n", files, "\nprofile: drums\n\n", audio_block(audio or "processed", True), "output:\n  name: ", configs.quoted(name), "\n",
    )
    return configs.write_plans(plans.select(F.lit("").alias("place"), name.alias("preset"), text.alias("text")), out)
