"""What a plan of a library plays: listed files, a single file, a folder of notes, a folder of hits, or folders by note or by instrument.

The folder of a plan is listed by the task that has the plan; what its names
mean is worked out by column expressions over all plans at once.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import vocabulary as V
from .readers import file_system

LISTED = "plan string, kind string, place string, file string, nth int, note int, note_step int, takes int, error string"
# How a name gives velocity and take of a hit, the words that name a crash itself, and the root of a file that says none.
_LAYER = r"(?i)^(.*)_V(\d+)_RR(\d+)$"
_CRASH, _ROOT = ("CRASH", "CRAS"), 60


def _listing(plan: dict) -> list[dict]:
    """The files that a plan could play, by kind of source: files, single, hits, notes or folders."""
    settings = dict(plan["settings"] or ())
    note = int(settings["source.note"]) if settings.get("source.note") not in (None, "None") else None
    base = {"plan": plan["path"], "place": "", "note": note, "note_step": plan["note_step"], "takes": plan["round_robins"], "error": None}
    if plan["files"]:
        return [base | {"kind": "files", "file": f, "nth": k} for k, f in enumerate(plan["files"])]
    from pyarrow import fs

    system, root = file_system(plan["source_path"])
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [base | {"kind": "single", "file": root, "nth": 0}]
    wavs = lambda folder: sorted(f.path for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.is_file and f.base_name.lower().endswith(".wav"))
    own = wavs(root)
    if own:
        kind = "hits" if settings.get("source.drumkit", "").lower() == "true" else "notes"
        return [base | {"kind": kind, "file": f, "nth": k} for k, f in enumerate(own)]
    inner = sorted(f.path for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.Directory)
    found = [base | {"kind": "folders", "place": posixpath.basename(d), "file": f, "nth": k} for d in inner for k, f in enumerate(wavs(d))]
    if not found:
        raise FileNotFoundError(f"no WAV files or folders in {plan['source_path']}")
    return found


def listed(plans: DataFrame) -> DataFrame:
    """One row per file that a plan of a library could play; a plan that has none has its error."""
    kinds = {"string": pa.string(), "int": pa.int32()}
    schema = pa.schema([(k, kinds[t]) for k, t in (x.split() for x in LISTED.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for plan in batch.to_pylist():
                try:
                    rows += _listing(plan)
                except (OSError, ValueError) as e:
                    rows.append({"plan": plan["path"], "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema=schema)

    wanted = plans.where((F.col("source_type") == "library") & F.col("error").isNull())
    return wanted.select("path", "source_path", "files", "settings", "note_step", "round_robins").mapInArrow(run, LISTED)


def one_layer(hits: DataFrame, *keys: str) -> DataFrame:
    """Of hits recorded at several velocities one file each: the layer below the loudest, or the only one, and of that the first take."""
    part = lambda k: F.regexp_extract("stem", _LAYER, k)
    layered = hits.withColumns({"_hit": F.when(F.col("stem").rlike(_LAYER), part(1)), "_v": part(2).try_cast("int"), "_rr": part(3).try_cast("int")})
    w = Window.partitionBy(*keys, "_hit")
    ranked = layered.where("_hit IS NOT NULL").withColumn("_layer", F.dense_rank().over(w.orderBy(F.desc("_v"))))
    ranked = ranked.withColumn("_layers", F.max("_layer").over(w)).where("_layer = least(2, _layers)").withColumn("_k", F.row_number().over(w.orderBy("_rr", "file"))).where("_k = 1")
    names = hits.columns
    return layered.where("_hit IS NULL").select(*names).unionByName(ranked.select(*names))


def _thinned(notes: Column, step: Column) -> Column:
    """Of ascending notes those at least ``step`` above the last one kept."""
    none = F.array().cast("array<int>")
    return F.aggregate(notes, none, lambda kept, n: F.when((F.size(kept) == 0) | (n - F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(-999)) >= step), F.array_append(kept, n)).otherwise(kept))


def _says_crash(stem: Column) -> Column:
    words = F.regexp_extract_all(F.upper(stem), F.lit("[A-Z0-9#]+"), 0)
    bare = F.transform(words, lambda w: F.regexp_replace(w, "[0-9]+$", ""))
    return F.arrays_overlap(F.concat(words, bare), F.array(*(F.lit(w) for w in _CRASH)))


def _notes(rows: DataFrame) -> DataFrame:
    """A folder of notes: numbered takes hide a file without a number; notes closer than the plan's step are left out."""
    parsed = rows.where("kind = 'notes'").withColumn("p", L.parsed_note(F.col("stem"))).where("p IS NOT NULL")
    parsed = parsed.select("plan", "file", "note_step", "takes", F.col("p.note").alias("note"), F.col("p.take").alias("take"), F.col("p.numbered").alias("numbered"))
    kept = parsed.groupBy("plan", "note_step").agg(F.array_sort(F.collect_set("note")).alias("all")).select("plan", F.explode(_thinned(F.col("all"), F.col("note_step"))).alias("note"))
    w = Window.partitionBy("plan", "note")
    # of files that give one note and take the last counts
    last = parsed.join(kept, ["plan", "note"]).groupBy("plan", "note", "take", "numbered", "takes").agg(F.max("file").alias("file"))
    shown = last.withColumn("_numbered", F.max("numbered").over(w)).where("numbered = _numbered")
    shown = shown.withColumn("_k", F.row_number().over(w.orderBy("take"))).where("NOT numbered OR _k <= takes")
    return shown.select("plan", "note", F.when(F.col("numbered"), F.col("take")).otherwise(1).alias("take"), F.lit(None).cast("string").alias("instrument"), "file")


def _hits(rows: DataFrame) -> DataFrame:
    """Files that are pads: by the order of a kit, then by name."""
    flat = one_layer(rows.where("kind = 'hits'"), "plan").unionByName(rows.where("kind = 'files'"))
    order = Window.partitionBy("plan").orderBy(V.kit_rank(V.drum_category(F.col("stem"))), "stem", "file")
    return flat.select("plan", (F.row_number().over(order) - 1).cast("int").alias("note"), F.lit(1).alias("take"), F.col("stem").alias("instrument"), "file")


def _folders(rows: DataFrame) -> DataFrame:
    """Folders by note, if any is named like one; else by instrument, where a folder that mixes several instruments is several pads."""
    rows = rows.where("kind = 'folders'").withColumn("p", L.parsed_note(F.col("place")))
    rows = rows.withColumn("by_note", F.max(F.col("p").isNotNull()).over(Window.partitionBy("plan")))
    place = Window.partitionBy("plan", "place")
    noted = rows.where("by_note AND p IS NOT NULL").withColumn("_k", F.row_number().over(place.orderBy("file"))).where("_k <= takes")
    noted = noted.select("plan", F.col("p.note").alias("note"), F.col("_k").cast("int").alias("take"), F.col("place").alias("instrument"), "file")

    hits = one_layer(rows.where("NOT by_note").drop("p"), "plan", "place").withColumn("category", V.drum_category(F.col("stem")))
    counts = hits.groupBy("plan", "place", "category").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("first"))
    many = counts.where("n > 1").groupBy("plan", "place").agg(F.count(F.lit(1)).alias("majors"), F.min_by("category", F.struct((-F.col("n")).alias("n"), "first")).alias("main")).where("majors > 1")
    joined = hits.join(counts.drop("first"), ["plan", "place", "category"]).join(many, ["plan", "place"], "left")
    pad = F.when(F.col("main").isNull(), V.drum_category(F.col("place"))).when(F.col("n") > 1, F.col("category")).otherwise(F.col("main"))
    label = F.when(F.col("main").isNull(), F.col("place")).otherwise(F.concat_ws("/", "place", pad))
    pads = joined.withColumns({"pad": pad, "instrument": label})
    first = F.when((F.col("pad") == "cymbal_crash") & ~_says_crash(F.col("stem")), 1).otherwise(0)  # a crash before its variants
    in_pad = Window.partitionBy("plan", "instrument").orderBy(first, "file")
    pads = pads.withColumn("_take", F.row_number().over(in_pad)).where("_take <= takes")
    number = F.dense_rank().over(Window.partitionBy("plan").orderBy(V.kit_rank(F.col("pad")), "place", "pad")) - 1
    return noted.unionByName(pads.select("plan", number.cast("int").alias("note"), F.col("_take").cast("int").alias("take"), "instrument", "file"))


def samples(plans: DataFrame) -> DataFrame:
    """(plan, note, take, instrument, file, error) of all plans of libraries."""
    found = listed(plans)
    rows = found.where("error IS NULL").drop("error").withColumn("stem", F.regexp_replace(F.regexp_extract("file", "([^/]*)$", 1), r"\.[^.]*$", ""))
    single = rows.where("kind = 'single'").select("plan", F.coalesce("note", F.lit(_ROOT)).alias("note"), F.lit(1).alias("take"), F.lit(None).cast("string").alias("instrument"), "file")
    good = single.unionByName(_notes(rows)).unionByName(_hits(rows)).unionByName(_folders(rows)).withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(found.where("error IS NOT NULL").select("plan", "error"), allowMissingColumns=True)
