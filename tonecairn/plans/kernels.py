"""Queries that run the array kernels, readers and writers over the driver tables: files are made from rows, read back, and compared with SQL on the rows."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import envelope, loops, preview, sets
from ..sources import bento, configs, containers, deluge, mappings, programs, riff, sinks
from ..sources.tables import read
from .hits import VIEW as HITS
from .hits import hits
from .signals import VIEW as FRAMES
from .signals import frames

_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def each_row(rows: DataFrame, kernel: Callable[[dict], dict], ddl: str) -> DataFrame:
    """What ``kernel`` makes of every row, an Arrow batch at a time."""
    schema = pa.schema([(k, _ARROW[t]) for k, t in (x.split() for x in ddl.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([kernel(r) for r in batch.to_pylist()], schema)

    return rows.mapInArrow(run, ddl)


def _signals(spark, sf_dir) -> DataFrame:
    return frames(spark, sf_dir).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda t: t["x"]).alias("xs"))


def wav_round_trip(spark, sf_dir):
    """Signals as WAV files of several formats, read back: header, loop and quantised sums of both channels."""

    def kernel(r: dict) -> dict:
        k, x = r["sample_id"], np.array(r["xs"]) / 1000.0
        bits, two = (16, 24)[k % 2], k % 3 == 0
        raw = riff.encode(8000 * (1 + k % 6), np.stack([x, x * -0.5]) if two else x, bits, loop=(k % 7, len(x)) if k % 4 == 0 else None)
        form, loop, (_, y) = riff.wav_format(raw), riff.loop_points(raw), riff.decode(raw)
        whole = np.rint(y.astype(np.float64) * 2 ** (bits - 1)).sum(1)
        start, stop = loop or (None, None)
        return {"sample_id": k, "channels": form.channels, "rate": form.rate, "bits": form.bits, "frames": y.shape[1], "loop_start": start, "loop_stop": stop, "left": int(whole[0]), "right": int(whole[1])}

    return each_row(_signals(spark, sf_dir), kernel, "sample_id long, channels int, rate int, bits int, frames long, loop_start long, loop_stop long, left long, right long")


_RATES = (44100, 96000, 192000, 384001, 4000, 48000)


def conformed_files(spark, sf_dir):
    """Files of hits as the device plays them: what it would refuse, the new rate, channels and frames, and a loop moved with the rate."""

    def kernel(r: dict) -> dict:
        k, n = r["id"], r["size"] * 10
        raw = riff.encode(_RATES[k % 6], np.zeros((1 + k % 4, n)), (16, 24)[k % 2])
        out, ratio = riff.conform(raw)
        form = riff.wav_format(out)
        start, stop = riff.scaled_loop((5, n), ratio)
        body = len(riff.chunk(out, b"data"))
        return {"id": k, "broken": ",".join(riff.violations(riff.wav_format(raw))), "rate": form.rate, "channels": form.channels, "frames": body // (form.channels * form.bits // 8), "start": start, "stop": stop}

    return each_row(hits(spark, sf_dir).select("id", "size"), kernel, "id long, broken string, rate int, channels int, frames long, start long, stop long")


def sfz_texts(spark, sf_dir):
    """SFZ texts of suppliers: scopes, macros, key switches, triggers, loops and skips."""

    def kernel(r: dict) -> dict:
        k = r["s_suppkey"]
        text = (
            f"// {k}\n#define $ROOT {k % 128}\n<control> default_path=W/ {'sw_default=c4' if k % 8 == 0 else ''}\n<global> volume={k % 7 - 3} lovel=3\n<group> lovel={k % 64} "
            f"{'trigger=release' if k % 5 == 0 else ''} /* <region> sample=no.wav */\n<region> sample=a b{k}.wav {'key' if k % 3 else 'pitch_keycenter'}=$ROOT lokey=10 {'sw_last=60' if k % 4 == 0 else ''} "
            f"loopmode={'loop_sustain' if k % 2 else 'no_loop'} loop_start=4 loopend={k % 90 + 5} offset={k % 11}.0 end={k % 13 - 1}"
        )
        found = mappings.sfz_zones(text)
        z = found[0] if found else {}
        return {"s_suppkey": k, "zones": len(found), **{c: z.get(c) for c in ("file", "root", "key_low", "key_high", "vel_low", "loop_start", "loop_stop", "sample_start", "sample_stop")}, "gain_db": z.get("gain_db")}

    ddl = "s_suppkey long, zones int, file string, root int, key_low int, key_high int, vel_low int, loop_start long, loop_stop long, sample_start long, sample_stop long, gain_db double"
    return each_row(read(spark, sf_dir, "supplier").select("s_suppkey"), kernel, ddl)


def multisample_archives(spark, sf_dir):
    """Mapping archives of suppliers, with numbers written as floats."""

    def kernel(r: dict) -> dict:
        k, out = r["s_suppkey"], io.BytesIO()
        loop = f'<loop mode="loop" start="{k % 9}.0" stop="{k % 90 + 20}.0"/>' if k % 3 else '<loop mode="off" start="1" stop="2"/>'
        key = f'root="{k % 128}.0" low="{k % 60}" high="{k % 60 + 40}.0"' if k % 5 else 'low="1"'
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("x/multisample.xml", f'<multisample><sample file="{k}.wav" gain="{k % 12 - 6}.5"><key {key}/><velocity low="{k % 100}"/>{loop}</sample></multisample>')
        found = mappings.multisample_zones(out.getvalue())
        z = found[0] if found else {}
        return {"s_suppkey": k, "zones": len(found), **{c: z.get(c) for c in ("file", "root", "key_low", "key_high", "vel_low", "vel_high", "gain_db", "loop_start", "loop_stop")}}

    ddl = "s_suppkey long, zones int, file string, root int, key_low int, key_high int, vel_low int, vel_high int, gain_db double, loop_start long, loop_stop long"
    return each_row(read(spark, sf_dir, "supplier").select("s_suppkey"), kernel, ddl)


def program_files(spark, sf_dir):
    """Older programs of suppliers: coded sample paths, products of levels, sums of pans, loops by length."""

    def kernel(r: dict) -> dict:
        k = r["s_suppkey"]
        value = lambda **v: "".join(f'<V name="{n}" value="{x}"/>' for n, x in v.items())
        name = f"@bd003WAVF00000000000n%20{k}.wav" if k % 2 else f"C:\\x\\{k}.wav"
        group = value(volume=0.5, pan=0.25, releaseTrigger="yes" if k % 6 == 0 else "no", keyTracking="no" if k % 5 == 0 else "yes")
        zone = value(rootKey=k % 128, zoneVolume=1 + k % 4, zonePan=(k % 9 - 4) / 4, zoneTune=2 ** (k % 3), sampleStart=k % 20, sampleEnd=10)
        loop = value(mode="until_end" if k % 3 else "oneshot", loopStart=k % 50, loopLength=k % 70 + 2)
        xml = (
            f'<?xml version="1.0"?><K2><K2_Program><Parameters>{value(volume=2)}</Parameters><Groups><K2_Group index="1"><Parameters>{group}</Parameters></K2_Group></Groups><Zones>'
            f'<K2_Zone groupIdx="1"><Parameters>{zone}</Parameters><Sample>{value(file_ex2=name)}</Sample><Loops><Loop>{loop}</Loop></Loops></K2_Zone></Zones></K2_Program></K2>'
        )
        raw = struct.pack("<I", 0x1290A87F) + bytes(12 + k % 200) + zlib.compress(xml.encode())
        found = programs.program_zones(raw)
        z = found[0] if found else {}
        rounded = {c: round(z[c], 6) if z else None for c in ("gain_db", "tune_cents", "pan")}
        return {"s_suppkey": k, "zones": len(found), **{c: z.get(c) for c in ("file", "root", "track", "sample_start", "sample_stop", "loop_start", "loop_stop")}, **rounded}

    ddl = "s_suppkey long, zones int, file string, root int, track boolean, sample_start long, sample_stop long, loop_start long, loop_stop long, gain_db double, tune_cents double, pan double"
    return each_row(read(spark, sf_dir, "supplier").select("s_suppkey"), kernel, ddl)


def _container(k: int) -> bytes:
    """A newer program with one group and one zone, whose values follow from ``k``."""
    counted = lambda body: struct.pack("<I", len(body)) + body
    whole = lambda body: struct.pack("<Q", len(body) + 8) + body
    text = lambda t: struct.pack("<I", len(t)) + t.encode("utf-16-le")
    chunk = lambda kind, body: struct.pack("<H", kind) + counted(body)
    held = lambda public, inner=b"": b"\x01" + struct.pack("<H", 0x99) + counted(b"") + counted(public) + counted(inner)
    loop = struct.pack("<HHiII9xI", 1, containers.LOOP_RECORD, k % 4, k % 50, k % 70 + 2, 0)
    zone = struct.pack("<III4H8xH3f", k % 20, k % 30, 0, 1, 127, 10, 90, k % 128, 0.5, 0.25, 2.0) + struct.pack("<I9xI", 0, 1000)
    group = text("g") + struct.pack("<3f3B15x2B", 2.0, 0.5, 0.5, k % 5 != 0, 0, k % 6 == 0, k % 7 == 0, 0)
    inner = chunk(containers.GROUPS, struct.pack("<I", 1) + held(group)) + chunk(containers.ZONES, struct.pack("<II", 1, 0) + held(zone, chunk(containers.LOOPS, loop)))
    program = chunk(containers.PROGRAM, held(text("P") + bytes(9) + struct.pack("<3f", 1.0, (k % 9 - 4) / 4, 1.0) + bytes(23), inner))
    files = struct.pack("<ii", 0, 1) + struct.pack("<I", 2) + b"\x03" + b"\x04" + text(f"n{k}.wav")
    tree = program + chunk(containers.FILES, files)
    preset = struct.pack("<8xII4x", 1, len(tree)) + tree
    parts = whole(struct.pack("<III", 0, containers.PRESET, 1) + whole(struct.pack("<III", 0, containers.END, 1)) + preset)
    return whole(struct.pack("<I4s24x", 1, b"hsin") + parts + bytes(8))


def container_files(spark, sf_dir):
    """Newer programs of suppliers: groups that don't sound, loops by length, frames cut from the end."""

    def kernel(r: dict) -> dict:
        found = containers.container_zones(_container(r["s_suppkey"]))
        z = found[0] if found else {}
        return {**r, "zones": len(found), **{c: z.get(c) for c in ("file", "root", "track", "sample_start", "sample_stop", "loop_start", "loop_stop", "pan", "gain_db")}}

    ddl = "s_suppkey long, zones int, file string, root int, track boolean, sample_start long, sample_stop long, loop_start long, loop_stop long, pan double, gain_db double"
    return each_row(read(spark, sf_dir, "supplier").select("s_suppkey"), kernel, ddl)


def tag_index_lines(spark, sf_dir):
    """The tag index of parts as XML lines, read back."""
    index = read(spark, sf_dir, "part").select(F.concat("p_name", F.lit(' <"&> '), "p_brand").alias("path"), F.array("p_type", F.concat(F.lit("A & "), "p_brand")).alias("tags"), "p_partkey")
    lines = sinks.index_lines(index.select(F.concat(F.col("p_partkey").cast("string"), F.lit("|"), "path").alias("path"), "tags"))
    back = sinks.read_index_lines(lines)
    key = F.substring_index("path", "|", 1).cast("long")
    return back.select(key.alias("p_partkey"), F.substr("path", F.length(F.substring_index("path", "|", 1)) + 2).alias("path"), F.array_join("tags", ";").alias("tags"))


def velocity_shift(spark, sf_dir):
    """How far the spectral centre of a signal (an even id) is from that of the next one, and whether that is a change of timbre."""
    s = _signals(spark, sf_dir)
    pairs = s.where("sample_id % 2 = 0").join(s.select((F.col("sample_id") - 1).alias("sample_id"), F.col("xs").alias("loud")), "sample_id")

    def kernel(r: dict) -> dict:
        shift = envelope.centroid_shift(np.array(r["xs"]), np.array(r["loud"]))
        return {"sample_id": r["sample_id"], "shift": round(shift, 6), "sensitive": bool(shift >= 0.03)}

    return each_row(pairs, kernel, "sample_id long, shift double, sensitive boolean")


_PROFILES = ("drums", "pad", "pluck", "synth")


def plan_rows(spark, sf_dir):
    """Plans of customers, laid over their profile and the defaults."""

    def kernel(r: dict) -> dict:
        k = r["c_custkey"]
        raw = {"profile": _PROFILES[k % 4], "source": {"type": "sfz", "path": f"../l/{k}.sfz"}, "output": {"name": f"P{k}"}, "performance": {"voice_mode": ("mono", "odd")[k % 2]}}
        raw |= {"capture": {"note_step": k % 7 + 1, "typo": 1}} if k % 3 == 0 else {}
        raw |= {"analysis": {"loop": k % 10 == 5}} if k % 5 == 0 else {}
        p = configs.plan_row(f"/plans/a/{k}.yaml", raw)
        return {"c_custkey": k, **{c: p[c] for c in ("category", "source_path", "note_step", "low", "high", "duration_s", "loop", "normalize", "voice_mode")}, "layers": len(p["velocities"]), "unknown": ",".join(p["unknown"])}

    ddl = "c_custkey long, category string, source_path string, note_step int, low int, high int, duration_s double, loop boolean, normalize string, voice_mode string, layers int, unknown string"
    return each_row(read(spark, sf_dir, "customer").select("c_custkey"), kernel, ddl)


def preset_settings(spark, sf_dir):
    """Settings of preset texts of suppliers: the first value of a key in the section asked for."""

    def kernel(r: dict) -> dict:
        k = r["s_suppkey"]
        text = f"/*@Meta\nUsage:\n'MW = x'\n*/\n#cm=OSC\nMode=9\n#cm=VCC\nMode={k % 5}\nMode=7\n Porta = {k % 101} \nnothing\n#cm=END\nPorta=1"
        found = mappings.ini_section(text, "cm=VCC" if k % 3 else "cm=NONE")
        return {"s_suppkey": k, "mode": found.get("Mode"), "porta": found.get("Porta")}

    return each_row(read(spark, sf_dir, "supplier").select("s_suppkey"), kernel, "s_suppkey long, mode string, porta string")


def fastlz_blocks(spark, sf_dir):
    """Texts as FastLZ blocks, literals and one match, decompressed."""

    def kernel(r: dict) -> dict:
        raw = (r["text"] or "").encode() + b"abc"
        runs = [raw[k : k + 32] for k in range(0, len(raw), 32)]
        block = b"".join(bytes([len(x) - 1]) + x for x in runs) + bytes([4 << 5, 2])
        out = mappings.fastlz(block, len(raw) + 6)
        return {"doc_id": r["doc_id"], "size": len(out), "text": out.decode()}

    made = each_row(read(spark, sf_dir, "documents").select("doc_id", "text"), kernel, "doc_id long, size long, text string")
    return made.select("doc_id", "size", F.sha2("text", 256).alias("digest"))


def phase_lock(spark, sf_dir):
    """The end of a loop at which a signal is most like it was before the start."""

    def kernel(r: dict) -> dict:
        return {"sample_id": r["sample_id"], "stop": loops.phase_locked(np.array(r["xs"]), 20, 40, 6, 8)}

    return each_row(_signals(spark, sf_dir), kernel, "sample_id long, stop long")


def shaped_preview(spark, sf_dir):
    """Signals fitted to 64 frames, brought to the preview's peak and faded in and out."""

    def kernel(r: dict) -> dict:
        y = preview.faded(preview.normalised(preview.fitted(np.array(r["xs"])[None], 64)), 100, 0.05, 0.25)[0]
        return {"sample_id": r["sample_id"], "total": round(float(y.sum()), 5), "size": round(float(np.abs(y).sum()), 5), "last": round(float(y[50]), 5)}

    return each_row(_signals(spark, sf_dir), kernel, "sample_id long, total double, size double, last double")


def drum_bands(spark, sf_dir):
    """Kick, snare or hat by the bands of a signal's spectrum."""
    return each_row(_signals(spark, sf_dir), lambda r: {"sample_id": r["sample_id"], "drum": envelope.drum_class(np.array(r["xs"]), 2000)}, "sample_id long, drum string")


def _features(spark, sf_dir) -> DataFrame:
    h = hits(spark, sf_dir)
    return h.select(
        F.col("brand").alias("set_id"), F.col("id").alias("sample_id"), F.col("size").alias("note"), (F.col("id") % 128).alias("velocity"), (F.col("id") % 4).alias("take"),
        F.when(F.col("size") % 3 > 0, F.col("id")).alias("loop_end"), F.when(F.col("id") % 17 == 0, "odd").alias("error"), (F.col("price") / 3000).alias("peak"),
    )


def partial_loops(spark, sf_dir):
    """Sets of which some notes loop and others don't, with both lists of notes."""
    r = sets.loop_report(_features(spark, sf_dir))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda n: n.cast("string")))
    return r.select("set_id", text("looped").alias("looped"), text("unlooped").alias("unlooped"))


def shipped_notes(spark, sf_dir):
    """Of each note of a set the row nearest to velocity 100, then the first take."""
    return sets.shipped(_features(spark, sf_dir)).select("set_id", "note", "sample_id", "velocity", "take")


def device_ranges(spark, sf_dir):
    """Preset documents of brands, a sample for each size, read back: tops and transpositions of all ranges."""
    f = _features(spark, sf_dir)
    none = lambda kind: F.lit(None).cast(kind)
    rows = f.select(
        F.col("set_id").alias("preset"), F.lit("C").alias("collection"), none("string").alias("subfolder"), F.lit("synth").alias("category"), F.col("note").cast("int").alias("note"), F.col("velocity").cast("int").alias("velocity"),
        F.col("take").cast("int").alias("take"), F.concat(F.lit("/m/SAMPLES/"), F.col("sample_id").cast("string"), F.lit(".wav")).alias("file"), F.lit(1000).cast("long").alias("frames"), F.lit(10).cast("long").alias("loop_start"),
        F.lit(900).cast("long").alias("loop_stop"), (F.col("note") % 2 == 0).alias("tail"), none("string").alias("instrument"), none("string").alias("hit"), none("double").alias("release_s"), none("map<string,double>").alias("shape"),
    )
    all_of = lambda what: F.array_join(F.regexp_extract_all("document", F.lit(what), 1), ",")
    d = deluge.documents(rows)
    return d.select("preset", "path", all_of('rangeTopNote="(\\d+)"').alias("tops"), all_of('transpose="(-?\\d+)">').alias("transposed"), all_of('fileName="([^"]*)"').alias("files"), all_of('endLoopPos="(\\d+)"').alias("loop_ends"))


def patch_ranges(spark, sf_dir):
    """Patch documents of brands, read back: roots, key ranges and files of all cells."""
    none = lambda kind: F.lit(None).cast(kind)
    f = hits(spark, sf_dir).select(
        F.col("brand").alias("preset"), F.lit("synth").alias("category"), F.col("size").cast("int").alias("note"), F.lit(100).alias("velocity"), F.col("id").cast("int").alias("take"), F.concat(F.lit("x/"), F.col("id").cast("string")).alias("file"),
        F.lit(50).cast("long").alias("frames"), F.when(F.col("size") % 4 == 0, F.lit(5)).cast("long").alias("loop_start"), F.when(F.col("size") % 4 == 0, F.lit(90)).cast("long").alias("loop_stop"), F.lit(False).alias("authored"),
        none("string").alias("hit"), none("int").alias("place"), none("map<string,double>").alias("shape"),
    )
    all_of = lambda name: F.array_join(F.regexp_extract_all("document", F.lit(name + '="([^"]*)"'), 1), ",")
    return bento.documents(f).select("preset", "path", *(all_of(n).alias(c) for n, c in (("rootnote", "roots"), ("keyrangebottom", "lows"), ("keyrangetop", "highs"), ("filename", "files"), ("loopstart", "starts"), ("loopend", "ends"))))


_CANON = ("ring", "bolt")


def ordered_rows(spark, sf_dir):
    """Places of hits in four orders: canonical words first and else as they came, least seam then greatest rank, by name."""
    h = hits(spark, sf_dir)
    place = lambda *order: F.row_number().over(Window.partitionBy("brand").orderBy(*order)).cast("long")
    first = F.when(F.col("category").isin(*_CANON), 0).otherwise(1)
    return h.select("id", place(first, "id").alias("canonical"), place("price", F.desc("size"), "id").alias("fallback"), place("stem", "id").alias("emitted"))


def longest_steady(spark, sf_dir):
    """Of a brand's hits that are steady (price under 1500) the longest, then the one with the least seam."""
    w = Window.partitionBy("brand").orderBy(F.desc("size"), "price", "id")
    return hits(spark, sf_dir).where("price < 1500").withColumn("k", F.row_number().over(w)).where("k = 1").select("brand", "id", "size")


_FEATURES = HITS + """, f AS (SELECT brand AS set_id, id AS sample_id, size AS note, id % 128 AS velocity, id % 4 AS take, size % 3 > 0 AS looped, id % 17 = 0 AS bad FROM h)"""
SQL = {
    "wav_round_trip": FRAMES + """, q AS (SELECT sample_id, x / 1000.0 AS y, CASE WHEN sample_id % 2 = 0 THEN 32767.0 ELSE 8388607.0 END AS top FROM f),
        s AS (SELECT sample_id, count(*) AS n, CAST(sum(round_even(y * top, 0)) AS BIGINT) AS l, CAST(sum(round_even(y * -0.5 * top, 0)) AS BIGINT) AS r FROM q GROUP BY 1)
        SELECT sample_id, CAST(CASE WHEN sample_id % 3 = 0 THEN 2 ELSE 1 END AS INT) AS channels, CAST(8000 * (1 + sample_id % 6) AS INT) AS rate, CAST(CASE WHEN sample_id % 2 = 0 THEN 16 ELSE 24 END AS INT) AS bits, n AS frames,
               CASE WHEN sample_id % 4 = 0 AND n - 1 > sample_id % 7 THEN sample_id % 7 END AS loop_start, CASE WHEN sample_id % 4 = 0 AND n - 1 > sample_id % 7 THEN n END AS loop_stop, l AS left, CASE WHEN sample_id % 3 = 0 THEN r ELSE l END AS right FROM s""",
    "conformed_files": HITS + f""", r AS (SELECT id, size * 10 AS n, {list(_RATES)}[id % 6 + 1] AS rate, 1 + id % 4 AS channels FROM h),
        t AS (SELECT *, CASE rate WHEN 192000 THEN 96000 WHEN 384001 THEN 96000 WHEN 4000 THEN 8000 ELSE rate END AS fit FROM r)
        SELECT id, array_to_string(list_filter([CASE WHEN channels > 2 THEN 'channels' END, CASE WHEN fit <> rate THEN 'rate' END], lambda x: x IS NOT NULL), ',') AS broken, CAST(fit AS INT) AS rate, CAST(least(channels, 2) AS INT) AS channels,
               CASE WHEN fit = rate THEN n ELSE greatest(1, CAST(round_even(n * (fit / rate), 0) AS BIGINT)) END AS frames, CAST(round_even(5 * (fit / rate), 0) AS BIGINT) AS start, CAST(round_even(n * (fit / rate), 0) AS BIGINT) AS stop FROM t""",
    "sfz_texts": """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 5 <> 0 AND (s_suppkey % 4 <> 0 OR s_suppkey % 8 = 0) AND s_suppkey % 13 > 0 AS ok FROM supplier)
        SELECT k AS s_suppkey, CAST(ok AS INT) AS zones, CASE WHEN ok THEN 'W/a b' || k || '.wav' END AS file, CASE WHEN ok THEN CAST(k % 128 AS INT) END AS root, CASE WHEN ok THEN CAST(CASE WHEN k % 3 > 0 THEN k % 128 ELSE 10 END AS INT) END AS key_low,
               CASE WHEN ok THEN CAST(CASE WHEN k % 3 > 0 THEN k % 128 ELSE 127 END AS INT) END AS key_high, CASE WHEN ok THEN CAST(k % 64 AS INT) END AS vel_low, CASE WHEN ok AND k % 2 = 1 THEN 4 END AS loop_start,
               CASE WHEN ok AND k % 2 = 1 THEN k % 90 + 5 END AS loop_stop, CASE WHEN ok THEN k % 11 END AS sample_start, CASE WHEN ok THEN CASE WHEN k % 13 - 1 > 0 THEN k % 13 ELSE 0 END END AS sample_stop, CASE WHEN ok THEN (k % 7 - 3)::DOUBLE END AS gain_db FROM s""",
    "multisample_archives": """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 5 <> 0 AS ok, s_suppkey % 5 <> 0 AND s_suppkey % 3 <> 0 AS looped FROM supplier)
        SELECT k AS s_suppkey, CAST(ok AS INT) AS zones, CASE WHEN ok THEN k || '.wav' END AS file, CASE WHEN ok THEN CAST(k % 128 AS INT) END AS root, CASE WHEN ok THEN CAST(k % 60 AS INT) END AS key_low, CASE WHEN ok THEN CAST(k % 60 + 40 AS INT) END AS key_high,
               CASE WHEN ok THEN CAST(k % 100 AS INT) END AS vel_low, CASE WHEN ok THEN 127 END AS vel_high, CASE WHEN ok THEN CAST((k % 12 - 6) || '.5' AS DOUBLE) END AS gain_db, CASE WHEN looped THEN k % 9 END AS loop_start, CASE WHEN looped THEN k % 90 + 20 END AS loop_stop FROM s""",
    "program_files": """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 6 <> 0 AS ok FROM supplier)
        SELECT k AS s_suppkey, CAST(ok AS INT) AS zones, CASE WHEN NOT ok THEN NULL WHEN k % 2 = 1 THEN '../WAV/n ' || k || '.wav' ELSE 'C:/x/' || k || '.wav' END AS file, CASE WHEN ok THEN CAST(k % 128 AS INT) END AS root, CASE WHEN ok THEN k % 5 <> 0 END AS track,
               CASE WHEN ok THEN CASE WHEN k % 20 < 10 THEN k % 20 ELSE 0 END END AS sample_start, CASE WHEN ok THEN CASE WHEN k % 20 < 10 THEN 10 ELSE 0 END END AS sample_stop, CASE WHEN ok AND k % 3 > 0 THEN k % 50 END AS loop_start,
               CASE WHEN ok AND k % 3 > 0 THEN k % 50 + k % 70 + 1 END AS loop_stop, CASE WHEN ok THEN round(20 * log10(1 + k % 4), 6) END AS gain_db, CASE WHEN ok THEN 1200.0 * (k % 3) END::DOUBLE AS tune_cents, CASE WHEN ok THEN least(greatest((k % 9 - 4) / 4 + 0.25, -1.0), 1.0) END::DOUBLE AS pan FROM s""",
    "container_files": """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 6 <> 0 AND s_suppkey % 7 <> 0 AS ok, s_suppkey % 4 IN (1, 2) AS looped FROM supplier)
        SELECT k AS s_suppkey, CAST(ok AS INT) AS zones, CASE WHEN ok THEN '../n' || k || '.wav' END AS file, CASE WHEN ok THEN CAST(k % 128 AS INT) END AS root, CASE WHEN ok THEN k % 5 <> 0 END AS track, CASE WHEN ok THEN k % 20 END AS sample_start,
               CASE WHEN ok THEN CASE WHEN k % 30 > 0 THEN 1000 - k % 30 ELSE 0 END END AS sample_stop, CASE WHEN ok AND looped THEN k % 50 END AS loop_start, CASE WHEN ok AND looped THEN k % 50 + k % 70 + 1 END AS loop_stop,
               CASE WHEN ok THEN least(greatest(0.75 + (k % 9 - 4) / 4, -1.0), 1.0) END::DOUBLE AS pan, CASE WHEN ok THEN 0.0 END::DOUBLE AS gain_db FROM s""",
    "tag_index_lines": """SELECT p_partkey, p_name || ' <"&> ' || p_brand AS path, p_type || ';A & ' || p_brand AS tags FROM part""",
    "velocity_shift": FRAMES + """, n AS (SELECT sample_id, i, x, count(*) OVER (PARTITION BY sample_id) AS n FROM f),
        d AS (SELECT sample_id, k, n // 2 + 1 AS m, CASE WHEN k = 0 THEN 0 ELSE sqrt(pow(sum(x * cos(2 * pi() * k * i / n)), 2) + pow(sum(x * sin(2 * pi() * k * i / n)), 2)) END AS a FROM n, range(0, 200) t(k) WHERE k <= n // 2 GROUP BY sample_id, k, n),
        c AS (SELECT sample_id, coalesce(sum(a * k) / nullif(sum(a), 0) / any_value(m), 0.0) AS c FROM d GROUP BY 1)
        SELECT a.sample_id, round(abs(b.c - a.c), 6) AS shift, abs(b.c - a.c) >= 0.03 AS sensitive FROM c a JOIN c b ON b.sample_id = a.sample_id + 1 WHERE a.sample_id % 2 = 0""",
    "plan_rows": """WITH c AS (SELECT c_custkey AS k, c_custkey % 4 AS p FROM customer)
        SELECT k AS c_custkey, CASE WHEN p = 0 THEN 'drum' ELSE 'synth' END AS category, '/plans/l/' || k || '.sfz' AS source_path, CAST(CASE WHEN k % 3 = 0 THEN k % 7 + 1 WHEN p = 0 THEN 1 ELSE 3 END AS INT) AS note_step, CAST(CASE WHEN p = 1 THEN 24 ELSE 21 END AS INT) AS low,
               CAST(CASE WHEN p = 1 THEN 96 ELSE 108 END AS INT) AS high, [2.0, 8.0, 2.0, 4.0][p + 1]::DOUBLE AS duration_s, CASE WHEN k % 5 = 0 THEN k % 10 = 5 ELSE p IN (1, 3) END AS loop, CASE WHEN p = 0 THEN 'per_sample' ELSE 'per_set' END AS normalize,
               CASE WHEN k % 2 = 0 THEN 'mono' ELSE 'poly' END AS voice_mode, CAST(CASE WHEN p = 0 THEN 3 ELSE 1 END AS INT) AS layers, CASE WHEN k % 3 = 0 THEN 'capture.typo' ELSE '' END AS unknown FROM c""",
    "preset_settings": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN (s_suppkey % 5)::VARCHAR END AS mode, CASE WHEN s_suppkey % 3 > 0 THEN (s_suppkey % 101)::VARCHAR END AS porta FROM supplier",
    "fastlz_blocks": "SELECT doc_id, octet_length(encode(text)) + 9 AS size, sha256(text || 'abcabcabc') AS digest FROM documents",
    "phase_lock": FRAMES + """, n AS (SELECT sample_id, count(*) AS n FROM f GROUP BY 1), c AS (SELECT sample_id, e FROM n, range(34, 46) t(e) WHERE e < least(n, 46)),
        d AS (SELECT c.sample_id, e, sum((a.x - b.x) * (a.x - b.x)) AS far FROM c JOIN range(1, 9) t(k) ON true JOIN f a ON a.sample_id = c.sample_id AND a.i = e - k JOIN f b ON b.sample_id = c.sample_id AND b.i = 20 - k GROUP BY 1, 2),
        m AS (SELECT sample_id, e FROM d QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY far, e) = 1) SELECT sample_id, coalesce(e, 40) AS stop FROM n LEFT JOIN m USING (sample_id)""",
    "shaped_preview": FRAMES + """, c AS (SELECT sample_id, i, x FROM f WHERE i < 64), m AS (SELECT *, max(abs(x)) OVER (PARTITION BY sample_id) AS top FROM c),
        g AS (SELECT sample_id, i, CASE WHEN top > 0 THEN x * (0.89 / top) ELSE x END * CASE WHEN i < 5 THEN i / 4 ELSE 1 END * CASE WHEN i >= 39 THEN 1 - (i - 39) / 24 ELSE 1 END AS y FROM m)
        SELECT sample_id, round(sum(y), 5) AS total, round(sum(abs(y)), 5) AS size, round(coalesce(sum(y) FILTER (i = 50), 0.0), 5) AS last FROM g GROUP BY 1""",
    "drum_bands": FRAMES + """, n AS (SELECT sample_id, i, x, least(count(*) OVER (PARTITION BY sample_id), 200) AS n FROM f), w AS (SELECT * FROM n WHERE i < n),
        p AS (SELECT sample_id, k, k * 2000.0 / n AS hz, pow(sum(x * cos(2 * pi() * k * i / n)), 2) + pow(sum(x * sin(2 * pi() * k * i / n)), 2) AS p FROM w, range(0, 101) t(k) WHERE k <= n // 2 GROUP BY sample_id, k, n),
        b AS (SELECT sample_id, coalesce(sum(p) FILTER (hz >= 20 AND hz < 200), 0) AS low, coalesce(sum(p) FILTER (hz >= 200 AND hz < 2000), 0) AS mid FROM p GROUP BY 1)
        SELECT sample_id, CASE WHEN low + mid <= 0 THEN 'other' WHEN low / (low + mid) > 0.5 THEN 'kick' WHEN mid / (low + mid) > 0.25 THEN 'snare' ELSE 'other' END AS drum FROM b""",
    "partial_loops": _FEATURES + """, g AS (SELECT set_id, string_agg(DISTINCT note, ',' ORDER BY note) FILTER (looped) AS looped, string_agg(DISTINCT note, ',' ORDER BY note) FILTER (NOT looped) AS unlooped FROM f WHERE NOT bad GROUP BY 1)
        SELECT * FROM g WHERE looped IS NOT NULL AND unlooped IS NOT NULL""",
    "shipped_notes": _FEATURES + " SELECT set_id, note, sample_id, velocity, take FROM f WHERE NOT bad QUALIFY row_number() OVER (PARTITION BY set_id, note ORDER BY abs(velocity - 100), take, sample_id) = 1",
    "device_ranges": _FEATURES + """, s AS (SELECT set_id, note, '/m/SAMPLES/' || sample_id || '.wav' AS file, velocity, take FROM f),
        k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY set_id, note ORDER BY abs(CASE WHEN velocity = 0 THEN 100 ELSE velocity END - 100), velocity, CASE WHEN take = 0 THEN 1 ELSE take END, file) = 1),
        t AS (SELECT *, coalesce(lead(note) OVER (PARTITION BY set_id ORDER BY note) - 1, note + 6) AS top FROM k)
        SELECT set_id AS preset, 'SYNTHS/C/' || set_id || '.xml' AS path, string_agg(top, ',' ORDER BY note) AS tops, string_agg(48 - note, ',' ORDER BY note) AS transposed, string_agg(substr(file, 4), ',' ORDER BY note) AS files,
               coalesce(string_agg(900, ',' ORDER BY note) FILTER (note % 2 = 0), '') AS loop_ends FROM t GROUP BY set_id""",
    "patch_ranges": HITS + """, n AS (SELECT brand, size AS note, min(id) AS id FROM h GROUP BY 1, 2),
        r AS (SELECT *, coalesce((lag(note) OVER w + note + 1) // 2, 0) AS low, coalesce((note + lead(note) OVER w + 1) // 2 - 1, 127) AS high FROM n WINDOW w AS (PARTITION BY brand ORDER BY note))
        SELECT brand AS preset, 'UserPatches/SampInst/' || brand || '/patch.xml' AS path, string_agg(note, ',' ORDER BY note) AS roots, string_agg(low, ',' ORDER BY note) AS lows, string_agg(high, ',' ORDER BY note) AS highs,
               string_agg(id, ',' ORDER BY note) AS files, string_agg(CASE WHEN note % 4 = 0 THEN 5 ELSE 0 END, ',' ORDER BY note) AS starts, string_agg(50, ',' ORDER BY note) AS ends FROM r GROUP BY brand""",
    "ordered_rows": HITS + f""" SELECT id, row_number() OVER (PARTITION BY brand ORDER BY CASE WHEN category IN {_CANON} THEN 0 ELSE 1 END, id) AS canonical,
        row_number() OVER (PARTITION BY brand ORDER BY price, size DESC, id) AS fallback, row_number() OVER (PARTITION BY brand ORDER BY stem, id) AS emitted FROM h""",
    "longest_steady": HITS + " SELECT brand, id, size FROM h WHERE price < 1500 QUALIFY row_number() OVER (PARTITION BY brand ORDER BY size DESC, price, id) = 1",
}
QUERIES = {k: f for k, f in list(globals().items()) if k in SQL}
