"""A scan from mapping files to plan texts: files to zones, zones to presets, presets to plans, plans to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import configs, readers

# Kinds of mapping with their files, and folders that hold a library's samples.
KINDS = {"sfz": "*.sfz", "kontakt": "*.nki", "bitwig": "*.multisample"}
SAMPLE_ROOTS = ("wav", "samples")


def _path(uri: Column) -> Column:
    return F.when(uri.startswith("file:"), F.regexp_replace(uri, "^file:/*", "/")).otherwise(uri)


def joined_pairs(zones: DataFrame) -> DataFrame:
    """One row for each hard-left and hard-right zone of a preset with one root, key and velocity range, with ``partner``; other zones as they are."""
    side = F.when(F.col("pan") <= -1.0, 0).when(F.col("pan") >= 1.0, 1)
    place = ["path", "root", "key_low", "key_high", "vel_low", "vel_high"]
    z = zones.withColumn("side", side).withColumn("_nth", F.row_number().over(Window.partitionBy(*place, "side").orderBy("group", "file")))
    right = z.where("side = 1").select(*place, "_nth", F.col("file").alias("partner"))
    left = z.where("side = 0").join(right, [*place, "_nth"], "left")
    alone = right.join(z.where("side = 0").select(*place, "_nth"), [*place, "_nth"], "left_anti")
    lone = z.where("side = 1").join(alone.select(*place, "_nth"), [*place, "_nth"], "left_semi")
    none = F.lit(None).cast("string").alias("partner")
    rest = z.where("side is null").select("*", none).unionByName(lone.select("*", none))
    return left.select(*rest.columns).unionByName(rest).drop("side", "_nth")


def mapped_presets(zones: DataFrame, folder: str, strip_suffix: str = "", name_from_folder: bool = False, split_prefix: bool = False, profile: str | None = None) -> DataFrame:
    """One row per mapping that has zones: preset, subfolder, profile, flags, zones, notes, low, high, looped, paired.

    A preset is named after its file; or after the one folder that all its samples are in, if no other mapping plays from it.
    """
    good = zones.where("error is null").withColumn("path", _path(F.col("path"))).withColumn("wav_dir", F.regexp_replace("file", "/[^/]*$", ""))
    count = lambda c: F.count_if(c).cast("long")
    dirs = good.groupBy("path").agg(F.min("wav_dir").alias("wav_dir"), F.count_distinct("wav_dir").alias("dirs")).where("dirs = 1").drop("dirs")
    claimed = dirs.join(dirs.groupBy("wav_dir").agg(F.count(F.lit(1)).alias("claims")).where("claims = 1").drop("claims"), "wav_dir")
    g = joined_pairs(good).groupBy("path").agg(
        F.count(F.lit(1)).alias("zones"), F.count_distinct("root").alias("notes"), F.min("root").alias("low"), F.max("root").alias("high"),
        count(F.col("loop_start").isNotNull()).alias("looped"), count(~F.col("track")).alias("fixed"), count(F.col("partner").isNotNull()).alias("paired"),
    )
    j = g.join(claimed, "path", "left")
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "")
    if strip_suffix:
        stem = F.when(stem.endswith(strip_suffix), F.rtrim(F.substring(stem, F.lit(1), F.length(stem) - len(strip_suffix)))).otherwise(stem)
    root = folder.rstrip("/")
    sub = F.regexp_replace(F.substr("path", F.lit(len(root) + 2)), "/?[^/]*$", "")
    if name_from_folder:
        own = F.col("wav_dir").isNotNull()
        parts = F.split("wav_dir", "/")
        last = F.size(parts) - F.array_position(F.reverse(F.transform(parts, lambda p: F.lower(p).isin(*SAMPLE_ROOTS))), True).cast("int")
        under = F.array_contains(F.transform(parts, lambda p: F.lower(p).isin(*SAMPLE_ROOTS)), True)
        inner = F.array_join(F.slice(parts, last + 2, F.greatest(F.size(parts) - last - 2, F.lit(0))), "/")
        stem, sub = F.when(own, F.element_at(parts, -1)).otherwise(stem), F.when(own & under, inner).otherwise(sub)
    j = j.withColumns({"preset": stem, "subfolder": sub})
    if split_prefix:
        has = F.col("preset").contains(" - ")
        head = F.substring_index("preset", " - ", 1)
        j = j.withColumns(
            {
                "subfolder": F.when(has, F.concat_ws("/", F.when(F.col("subfolder") != "", F.col("subfolder")), head)).otherwise(F.col("subfolder")),
                "preset": F.when(has, F.substr("preset", F.length(head) + 4)).otherwise(F.col("preset")),
            }
        )
    kept = F.lit(profile) if profile else F.when(F.col("looped") * 2 > F.col("zones"), "synth").otherwise("pluck")
    fixed = F.lit("fixed-pitch samples (percussion?) — each key maps to its own hit; verify keyboard mapping or split into a kit")
    flags = F.when(F.col("fixed") * 2 > F.col("zones"), F.array(fixed)).otherwise(F.array().cast("array<string>"))
    return j.select("path", "preset", "subfolder", kept.alias("profile"), flags.alias("flags"), "zones", "notes", "low", "high", "looped", "paired")


def mapped_text(kind: str, note_step: int) -> Column:
    """The plan of a mapped preset: its samples ship as they are, with the loops that their author gave them."""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    c = F.col
    return text(
        F.when(F.size("flags") > 0, text("# REVIEW: ", F.array_join("flags", ", "), "\n")).otherwise(""), "# ", c("zones"), " samples, ", c("notes"), " notes [", c("low"), "-", c("high"), "], ",
        c("looped"), f" looped\nsource:\n  type: {kind}\n  path: ", configs.quoted(c("path")), "\n\nprofile: ", c("profile"),
        "\n\nanalysis:\n  pitch_verify: false\n  loop_detect: false\n  trim: false\n  normalize: none\n\n" + f"capture:\n  note_step: {note_step}\n\noutput:\n  name: ", configs.quoted(c("preset")), "\n",
        F.when(c("subfolder") != "", text("  subfolder: ", configs.quoted(c("subfolder")), "\n")).otherwise(""),
    )


def scan_mapped(spark: SparkSession, folder: str, out: str, kind: str = "sfz", note_step: int = 3, **options) -> DataFrame:
    """Write a plan for every mapping of a folder that can be read and has zones; returns (place, preset, path) of the plans.

    Hidden files and archive leftovers are passed over; a mapping that can't be read takes no other with it.
    """
    found = readers.zones(spark, folder, KINDS[kind])
    shown = found.where(~F.col("path").rlike(r"/\.[^/]*$") & ~F.col("path").contains("/__MACOSX/"))
    presets = mapped_presets(shown, folder, **options)
    return configs.write_plans(presets.select(F.col("subfolder").alias("place"), "preset", mapped_text(kind, note_step).alias("text")), out)
