"""Analysis of sample sets: one Arrow pass per sample, then votes and gains over the set.

``analyse`` trims, classifies, checks the pitch and finds a loop for every row;
a row whose audio fails has an error and no features, and the set goes on.
The set stages are column expressions: a verdict by vote, one gain for all
samples of a set, a kit category, and the report of notes without a loop.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import signal as S
from ..sources.memo import KEY, Counted, Memo, code_digest
from . import envelope, loops, spectra

FEATURES = (
    "set_id string, sample_id long, note int, velocity int, take int, lead long, trail long, peak double, classification string, modulation_s double, "
    "pitch_ok boolean, cents double, loop_start long, loop_end long, loop_source string, drum string, error string"
)


def analyse(samples: DataFrame, loop: bool = True, bpm: float | None = None, drums: bool = False) -> DataFrame:
    """Features of samples (set_id, sample_id, note, velocity, take, rate, xs, note_off); loop points are in trimmed frames."""
    keys = ["set_id", "sample_id", "note", "velocity", "take"]

    def kernel(row: dict) -> dict:
        out = {k: row[k] for k in keys}
        try:
            x, rate = row["xs"], row["rate"]
            lead, trail = envelope.trim(x)
            cut = x[lead:trail]
            off = None if row["note_off"] is None else row["note_off"] - lead
            env = envelope.analyse(cut, rate, off, bpm)
            check = envelope.pitch_check(envelope.pitch_hz(cut, rate), row["note"]) if row["note"] is not None else {"ok": None, "cents": None}
            out |= {
                "lead": lead, "trail": trail, "peak": float(np.abs(cut).max(initial=0.0)), "classification": env.classification,
                "modulation_s": env.modulation_period / rate if env.modulation_period else None, "pitch_ok": check["ok"], "cents": check["cents"],
                "drum": envelope.drum_class(cut, rate) if drums else None, "error": None,
            }
            if loop and env.classification != "pluck":
                found = loops.best(cut, rate, env.sustain_start, env.sustain_end, note=row["note"], bpm=bpm, modulation=env.modulation_period)
                if found:
                    out |= dict(zip(("loop_start", "loop_end", "loop_source"), found, strict=True))
        except (ValueError, TypeError, ZeroDivisionError) as e:
            out["error"] = f"{type(e).__name__}: {e}"
        return out

    return envelope.per_signal(samples.select(*keys, "rate", "xs", "note_off"), FEATURES, kernel)


_IDENTITY = ["set_id", "sample_id", "note", "velocity", "take"]
MEMO_DDL = ", ".join(c for c in FEATURES.split(", ") if c.split()[0] not in _IDENTITY)


def memo_of(spark: SparkSession, folder: str) -> Memo:
    """A memo of what ``analyse`` finds."""
    return Memo(spark, folder, MEMO_DDL)


def analyse_memoised(samples: DataFrame, kept: Memo, loop: bool = True, bpm: float | None = None, drums: bool = False) -> tuple[DataFrame, Counted]:
    """``analyse``, but samples whose audio, note and settings have been analysed by the same code are looked up; and what the pass met."""

    def kernel(missing: DataFrame) -> DataFrame:
        found = analyse(missing.withColumn("set_id", F.col(KEY)), loop, bpm, drums)
        return found.withColumnRenamed("set_id", KEY)

    config = {"loop": loop, "bpm": bpm, "drums": drums}
    fields = ["note", "velocity", "take", "rate", "xs", "note_off"]
    done, met = kept.through(samples.select("set_id", "sample_id", *fields), fields, kernel, config, code_digest(envelope, loops, spectra))
    return done.select(*(c.split()[0] for c in FEATURES.split(", "))), met


def verdicts(features: DataFrame, seen: float = 0.30, agreed: float = 0.15) -> DataFrame:
    """(set_id, verdict, profile, period_s, rows): the most frequent class; rhythm where enough rows have a period and agree on it."""
    good = features.where("error is null").withColumn("class", F.when(F.col("classification") == "pluck", "pluck").otherwise("sustained"))
    classes = good.groupBy("set_id", "class").agg(F.count(F.lit(1)).alias("votes"), F.min("sample_id").alias("first"))
    w = Window.partitionBy("set_id")
    top = classes.withColumns({"rows": F.sum("votes").over(w), "k": F.row_number().over(w.orderBy(F.desc("votes"), "first"))}).where("k = 1")
    periods = good.where("modulation_s is not null").groupBy("set_id", F.round("modulation_s", 2).alias("period_s")).agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first"))
    best = periods.withColumns({"with_period": F.sum("n").over(w), "k": F.row_number().over(w.orderBy(F.desc("n"), "first"))}).where("k = 1").select("set_id", "period_s", "n", "with_period")
    j = top.join(best, "set_id", "left")
    rhythm = (F.col("class") != "pluck") & (F.col("with_period") >= seen * F.col("rows")) & (F.col("n") >= agreed * F.col("rows"))
    verdict = F.when(F.col("class") == "pluck", "Pluck").when(rhythm, "Sustained + rhythm").otherwise("Sustained")
    profile = F.when(F.col("class") == "pluck", "pluck").when(rhythm, "pad").otherwise("synth")
    return j.select("set_id", verdict.alias("verdict"), profile.alias("profile"), F.when(rhythm, F.col("period_s")).alias("period_s"), "rows")


def with_set_gain(features: DataFrame, target_db: float = -1.0) -> DataFrame:
    """One gain for all samples of a set, so their levels against each other stay."""
    return features.withColumn("gain", S.gain_to(F.max("peak").over(Window.partitionBy("set_id")), target_db))


def loop_report(features: DataFrame) -> DataFrame:
    """Sets in which some notes have a loop and others have none, with the notes on both sides."""
    notes = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("note"))))
    has = F.col("loop_end").isNotNull()
    g = features.where("error is null").groupBy("set_id").agg(notes(has).alias("looped"), notes(~has).alias("unlooped"))
    return g.where("size(looped) > 0 and size(unlooped) > 0")


def shipped(features: DataFrame, target_velocity: int = 100) -> DataFrame:
    """The row of each note that a device without layers gets: nearest velocity, then the first take."""
    w = Window.partitionBy("set_id", "note").orderBy(F.abs(F.col("velocity") - target_velocity), "take", "sample_id")
    return features.where("error is null").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
