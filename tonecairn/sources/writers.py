"""Writers of audio: sets of renders, tables, dumps of what was classified, loop candidates, and whole plans."""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import sanitised
from . import libraries, mappings, programs, readers, riff

# Frames of a table's window, the chunk that tells a table from other files, the peak that a dump is brought to.
WINDOW, TABLE_CHUNK, DUMP_PEAK_DB = 2048, b"clm ", -1.0


def channels_of(raw: bytes) -> tuple[riff.WavFormat, np.ndarray]:
    """The format and all channels, one row each."""
    form, body = riff.wav_format(raw), riff.chunk(raw, b"data")
    if form is None or body is None or form.channels < 1:
        raise ValueError("not a WAV file with data")
    return form, np.stack([riff.decode(riff.encode_channel(form, body, c))[1][0] for c in range(form.channels)]).astype(np.float64)


def table_bytes(raw: bytes) -> bytes:
    """A wavetable as a device loads it: as it is where it can be, else mono, in whole windows and at full scale, with its table chunk."""
    form, data = channels_of(raw)
    mark = riff.chunk(raw, TABLE_CHUNK)
    if form.channels == 1 and (data.shape[1] % WINDOW == 0 or mark is not None):
        return riff.conform(raw)[0]
    mono = data.mean(0)
    mono = mono[: len(mono) // WINDOW * WINDOW] if len(mono) >= WINDOW else mono
    peak = np.abs(mono).max(initial=0.0)
    out = riff.encode(form.rate, mono / peak if peak else mono, form.bits if form.bits >= 16 else 16, form.codec)
    return out if mark is None else riff.with_chunk(out, TABLE_CHUNK, mark, before=b"data")


def unique_name(path: str, taken: set[str]) -> str:
    """A file's own name; where it is taken with its folder's before it, then with a number between."""
    folder, name = posixpath.split(path)
    folder = posixpath.basename(folder)
    found, number = name, 1
    while found in taken:
        found = f"{folder}_{name}" if number == 1 else f"{folder}_{number}_{name}"
        number += 1
    taken.add(found)
    return found


def _put(folder: str, name: str, data: bytes) -> str:
    files, root = readers.file_system(folder)
    path = posixpath.join(root, name)
    files.create_dir(posixpath.dirname(path), recursive=True)
    with files.open_output_stream(path, compression=None) as f:
        f.write(data)
    return path


_WRITTEN = "set_id string, note int, velocity int, take int, path string, frames long, error string"


def _each(samples: DataFrame, write: Callable[[dict], tuple[str, int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                done = {k: row[k] for k in ("set_id", "note", "velocity", "take")}
                try:
                    path, frames = write(row)
                    out.append({**done, "path": path, "frames": frames, "error": None})
                except (ValueError, TypeError, ZeroDivisionError) as e:
                    out.append({**done, "path": None, "frames": None, "error": f"{type(e).__name__}: {e}"})
            kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
            yield pa.RecordBatch.from_pylist(out, pa.schema([(k, kinds[t]) for k, t in (x.split() for x in _WRITTEN.split(", "))]))

    keys = [F.col("set_id").cast("string"), *(F.col(c).cast("int") for c in ("note", "velocity", "take"))]
    return samples.select(*keys, "rate", "ch0", "ch1", "mono").mapInArrow(run, _WRITTEN)


def _stereo(row: dict) -> np.ndarray:
    left = np.asarray(row["ch0"], float)
    return left[None] if row["mono"] or row["ch1"] is None else np.stack([left, np.asarray(row["ch1"], float)])


def write_wav_set(samples: DataFrame, folder: str, tempo: float = 120.0, bits: int = 24) -> DataFrame:
    """One file for each render (set_id, note, velocity, take, rate, ch0, ch1, mono), named by what it is; a retried task writes the same files again."""

    def write(row: dict) -> tuple[str, int]:
        x = _stereo(row)
        name = f"note{row['note']:03d}_T{round(tempo):03d}_V{row['velocity']:03d}_RR{row['take']}.wav"
        return _put(folder, posixpath.join(row["set_id"] or "", name), riff.conform(riff.encode(row["rate"], x, bits))[0]), x.shape[1]

    return _each(samples, write)


def dump_classified(samples: DataFrame, folder: str) -> DataFrame:
    """What a classification has listened to: each sample at full level, without the silence around it, as float files."""
    from ..operators.envelope import trim

    def write(row: dict) -> tuple[str, int]:
        x = _stereo(row)
        peak = np.abs(x).max(initial=0.0)
        x = x * (10 ** (DUMP_PEAK_DB / 20) / peak) if peak else x
        first, last = trim(x.mean(0))
        name = f"n{row['note']:03d}_v{row['velocity']:03d}_rr{row['take']:02d}.wav"
        place = (row["set_id"] or "").replace("/", "_").replace("\\", "_")
        return _put(folder, posixpath.join(place, name), riff.encode(row["rate"], x[:, first:last], 32, riff.FLOAT)), last - first

    return _each(samples, write)


CANDIDATES = "set_id string, sample_id long, rank int, start long, stop long, source string, score double, chroma double, drift double, seam double"


def loop_candidates(samples: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Every loop candidate of samples (set_id, sample_id, note, rate, xs) with its scores; ``.write.json`` makes the debug lines."""
    from ..operators import envelope, loops

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                x = np.asarray(row["xs"] or [], float)
                if not len(x) or not row["rate"]:
                    continue
                env = envelope.analyse(x, row["rate"], None, None)
                for k, c in enumerate(loops.ranked(x, row["rate"], env.sustain_start, env.sustain_end, note=row["note"], most=most)):
                    out.append({"set_id": row["set_id"], "sample_id": row["sample_id"], "rank": k, "start": c.start, "stop": c.end, **{f: getattr(c, f) for f in ("source", "score", "chroma", "drift", "seam")}})
            kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
            yield pa.RecordBatch.from_pylist(out, pa.schema([(k, kinds[t]) for k, t in (x.split() for x in CANDIDATES.split(", "))]))

    return samples.select("set_id", "sample_id", "note", "rate", "xs").mapInArrow(run, CANDIDATES)


_SHIPPED = "plan string, name string, status string, file string, source string, note int, key_low int, key_high int, vel_low int, vel_high int, loop_start long, loop_stop long, frames long, error string"


def _zones_of(kind: str, path: str, samples: list[dict]) -> list[dict]:
    """The zones of a plan's source, whatever its kind; raises where it takes a host to render it. ``samples``: what a library's folder plays."""
    if kind in ("wavetable", "granular"):
        return [{"file": path, "root": 60, "key_low": 0, "key_high": 127, "vel_low": 0, "vel_high": 127}]
    if kind == "library":
        return [{"file": s["file"], "root": s["note"], "key_low": s["note"], "key_high": s["note"], "vel_low": 0, "vel_high": 127} for s in samples]
    read = {"sfz": readers._sfz_rows, "kontakt": readers._program_rows, "bitwig": lambda path, raw: packed_zones(raw)}.get(kind)
    if read is None:
        raise programs.NotReadable(f"a {kind} source needs a host")
    beside = readers.Beside(path)
    raw = beside.read(posixpath.basename(path))
    if raw is None:
        raise FileNotFoundError(path)
    return [z for z in read(path, raw) if not z.get("error")]


def packed_zones(archive: bytes) -> list[dict]:
    """Zones of a multisample archive with the bytes of their samples; a sample that isn't in the archive is left out."""
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        inside = {n.lower(): n for n in z.namelist()}
        found = [(zone, inside.get((zone["file"] or "").lower())) for zone in mappings.multisample_zones(archive)]
        return [zone | {"data": z.read(name)} for zone, name in found if name is not None]


def run_plans(plans: DataFrame, out: str) -> DataFrame:
    """Ship every plan's samples under ``out``: one row per file written, or one per plan that wasn't run, with its status.

    collision: two plans claim one place, and only the first by path runs; exists: the place is there already; failed: with the
    reason, and no other plan is touched. Files are copied as far as a device plays them; loop points follow a changed rate.
    """
    place = F.concat_ws("/", F.nullif("folder", F.lit("")), F.nullif("subfolder", F.lit("")), sanitised(F.col("name")))
    nth = F.row_number().over(Window.partitionBy("place").orderBy("path"))
    named = plans.withColumn("place", place).withColumn("nth", nth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SHIPPED.split(", ")]
        for batch in batches:
            for p in batch.to_pylist():
                lone = lambda status, error=None: [{"plan": p["path"], "name": p["name"], "status": status, "error": error}]  # noqa: B023, E731
                files, root = readers.file_system(posixpath.join(out, p["place"] or ""))
                if p["error"]:
                    rows = lone("failed", p["error"])
                elif p["nth"] > 1:
                    rows = lone("collision")
                elif files.get_file_info(posixpath.join(root, "_done")).is_file:
                    rows = lone("exists")
                else:
                    try:
                        rows = _ship(p, posixpath.join(out, p["place"]))
                    except (OSError, ValueError, KeyError) as e:
                        rows = lone("failed", f"{type(e).__name__}: {e}")
                kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
                full = [{k: r.get(k) for k in names} for r in rows]
                yield pa.RecordBatch.from_pylist(full, pa.schema([(k, kinds[t]) for k, t in (x.split() for x in _SHIPPED.split(", "))]))

    played = libraries.samples(plans).groupBy(F.col("plan").alias("path")).agg(
        F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("note", "take", "file")))).alias("samples"), F.max("error").alias("_unread")
    )
    known = named.join(played, "path", "left").withColumn("error", F.coalesce("error", "_unread"))
    return known.select("path", "name", "source_type", "source_path", "samples", "place", "nth", "error").mapInArrow(run, _SHIPPED)


def _ship(plan: dict, folder: str) -> list[dict]:
    """Write a plan's files beside their place, in a hidden folder of this attempt, and move them there when all are written."""
    place, _, name = folder.rpartition("/")
    stage = f"{place}/.staged-{uuid.uuid4().hex}"
    files, staged = readers.file_system(stage)
    try:
        rows = _written(plan, stage, folder)
        _put(stage, "_done", b"")
        root = readers.file_system(folder)[1]
        if files.get_file_info(root).type.name == "Directory":  # what an attempt before staging left
            files.delete_dir(root)
        files.move(staged, root)
    except BaseException:
        if files.get_file_info(staged).type.name == "Directory":
            files.delete_dir(staged)
        raise
    return rows


def _written(plan: dict, stage: str, folder: str) -> list[dict]:
    rows, taken = [], set()
    for z in _zones_of(plan["source_type"], plan["source_path"], plan["samples"] or []):
        raw = z.get("data") or readers.Beside(z["file"]).read(posixpath.basename(z["file"]))
        if raw is None:
            raise FileNotFoundError(z["file"])
        loop = (z["loop_start"], z["loop_stop"]) if z.get("loop_start") is not None else riff.loop_points(raw)
        data, ratio = (table_bytes(raw), 1.0) if plan["source_type"] == "wavetable" else riff.conform(raw)
        loop = riff.scaled_loop(loop, ratio) if loop else (None, None)
        own = unique_name(z["file"], taken)
        _put(stage, own, data)
        form, body = riff.wav_format(data), riff.chunk(data, b"data")
        rows.append(
            {
                "plan": plan["path"], "name": plan["name"], "status": "written", "file": posixpath.join(readers.file_system(folder)[1], own), "source": z["file"], "note": z["root"], "loop_start": loop[0], "loop_stop": loop[1],
                "frames": len(body) // max(1, form.channels * form.bits // 8), **{k: z[k] for k in ("key_low", "key_high", "vel_low", "vel_high")},
            }
        )
    if not rows:
        raise ValueError(f"no playable sample in {location(plan)}")
    return rows


def location(plan: dict) -> str:
    """Where a plan's audio was to come from, for people."""
    return plan.get("source_path") or plan.get("preset") or plan["source_type"]
