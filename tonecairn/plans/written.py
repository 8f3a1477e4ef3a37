"""Queries in two steps: files are written to the shared folder from the tables, and what reads them back finds the tables again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import labels as L
from ..sources import cards, readers, riff
from ..sources.tables import read, work_dir
from .signals import VIEW as FRAMES
from .signals import frames

RATE = 8000


def library_files(spark, sf_dir):
    """Signals written as a library, a WAV file each, in folders of twelve sets; read back as far as a sink of two takes and low velocities asks."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = []
            for key, xs in zip(batch.column("sample_id").to_pylist(), batch.column("xs").to_pylist(), strict=True):
                x = np.array(xs) / 1000.0
                contents.append(riff.encode(RATE, np.stack([x, x]) if key % 3 else x, 16, loop=(key % 5, len(x)) if key % 2 else None))
            yield pa.RecordBatch.from_arrays([batch.column("preset"), batch.column("file"), pa.array(contents, pa.binary())], names=["preset", "file", "content"])

    k = F.col("sample_id")
    number = lambda c: c.cast("string")
    name = F.concat(F.lit("s"), number(k), F.lit("_"), L.note_name(k % 128), F.lit("_V"), number(k * 7 % 127 + 1), F.lit("_RR"), number(k % 3 + 1), F.lit(".wav"))
    xs = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda t: t["x"])
    signals = frames(spark, sf_dir).groupBy("sample_id").agg(xs.alias("xs")).select("sample_id", F.concat(F.lit("set"), number(k % 12)).alias("preset"), name.alias("file"), "xs")
    folder = work_dir(spark, "library")
    cards.write_presets(signals.mapInArrow(encode, "preset string, file string, content binary"), folder)
    library = spark.read.format("sample_library").option("path", folder).load()
    return library.where("take <= 2 AND velocity < 100 AND error IS NULL").select("folder", "note", "velocity", "take", "channels", "bits", "frames", "loop_start", "loop_end")


def mapped_files(spark, sf_dir):
    """Zones of a supplier written as an SFZ text of groups and regions that take on what is around them; read back as zones."""
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("preset"), F.col("l_returnflag").alias("flag"), (F.col("l_partkey") % 120).cast("int").alias("k"), F.col("l_quantity").cast("int").alias("top"), (F.col("l_linenumber") % 3 == 0).alias("own")
    )
    region = F.concat(
        F.lit("<region> lokey="), F.col("k").cast("string"), F.lit(" hikey="), (F.col("k") + 2).cast("string"), F.lit(" pitch_keycenter="), (F.col("k") + 1).cast("string"), F.lit(" lovel=1 hivel="), F.col("top").cast("string"),
        F.when(F.col("own"), " volume=-9").otherwise(""), F.lit(" // a zone\n"),
    )
    group = F.when(F.col("flag") == "R", "<group>\n").otherwise(F.concat(F.lit("<group> volume="), F.when(F.col("flag") == "A", "-2").otherwise("-3"), F.lit("\n")))
    groups = rows.groupBy("preset", "flag").agg(F.concat(group, F.array_join(F.array_sort(F.collect_list(region)), "")).alias("text"))
    texts = groups.groupBy("preset").agg(F.concat(F.lit("<global> sample=a.wav volume=-1\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("flag", "text"))), lambda g: g["text"]), "")).alias("text"))
    place = F.concat(F.lit("maps/p"), F.col("preset").cast("string"))
    wav = riff.encode(RATE, np.zeros(8), 16)
    files = texts.select(place.alias("preset"), F.lit("map.sfz").alias("file"), F.col("text").cast("binary").alias("content")).union(texts.select(place, F.lit("a.wav"), F.lit(wav)))
    folder = work_dir(spark, "maps")
    cards.write_presets(files, folder)
    zones = readers.zones(spark, folder, "*.sfz").where("error IS NULL")
    preset = F.regexp_extract("path", r"/p(\d+)/map\.sfz$", 1).cast("long")
    return zones.select(preset.alias("preset"), "root", "key_low", "key_high", "vel_low", "vel_high", F.round("gain_db", 4).alias("gain_db"))


SQL = {
    "library_files": FRAMES
    + """, s AS (SELECT sample_id AS k, count(*) AS n FROM f GROUP BY 1)
        SELECT 'set' || k % 12 AS folder, CAST(k % 128 AS INT) AS note, CAST(k * 7 % 127 + 1 AS INT) AS velocity, CAST(k % 3 + 1 AS INT) AS take, CASE WHEN k % 3 > 0 THEN 2 ELSE 1 END AS channels, 16 AS bits,
               n AS frames, CASE WHEN k % 2 = 1 THEN k % 5 END AS loop_start, CASE WHEN k % 2 = 1 THEN n END AS loop_end
        FROM s WHERE k % 3 + 1 <= 2 AND k * 7 % 127 + 1 < 100""",
    "mapped_files": """SELECT l_suppkey AS preset, CAST(l_partkey % 120 + 1 AS INT) AS root, CAST(l_partkey % 120 AS INT) AS key_low, CAST(l_partkey % 120 + 2 AS INT) AS key_high, 1 AS vel_low,
               CAST(l_quantity AS INT) AS vel_high, CASE WHEN l_linenumber % 3 = 0 THEN -9.0 WHEN l_returnflag = 'A' THEN -2.0 WHEN l_returnflag = 'R' THEN -1.0 ELSE -3.0 END::DOUBLE AS gain_db FROM lineitem""",
}
QUERIES = {k: f for k, f in list(globals().items()) if k in SQL}
