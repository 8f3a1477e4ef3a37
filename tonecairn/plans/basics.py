"""Queries for the small rules around a capture: parameters, states, identities, sources, names and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..sources.tables import read
from .hits import VIEW as HITS
from .hits import hits
from .signals import HOPS, frames, hops
from .signals import VIEW as FRAMES


def capture_fault(step: Column, seconds: Column, low: Column, high: Column) -> Column:
    """The first parameter of a capture that can't be: step, duration, range or order; '' if all can."""
    in_range = low.between(0, 127) & high.between(0, 127)
    return F.when(step < 1, "step").when(seconds <= 0, "duration").when(~in_range, "range").when(low >= high, "order").otherwise("")


def capture_faults(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    seconds = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") / 100000.0 - 0.5)
    fault = capture_fault(F.col("o_orderkey") % 9, seconds, F.col("o_custkey") % 140 - 5, F.col("o_orderkey") % 150 - 5)
    return o.select(F.col("o_orderkey").alias("plan"), fault.alias("fault"))


def note_period(spark, sf_dir):
    """Frames of one period of a note at a rate, whole and at least one."""
    h = hits(spark, sf_dir).select("id", (F.col("size") * 1000).alias("rate"), (F.col("id") % 128).alias("note"))
    hz = F.lit(440.0) * F.pow(F.lit(2.0), (F.col("note") - 69) / 12.0)
    return h.select("id", F.greatest(F.lit(1), F.bround(F.col("rate") / hz)).cast("long").alias("period"))


def without_fxp(content: Column) -> Column:
    """The inner chunk of a preset file that has the FXP wrapper, any other file as it is."""
    size = F.conv(F.hex(F.substring(content, 57, 4)), 16, 10).cast("int")
    wrapped = (F.octet_length(content) >= 60) & (F.substring(content, 1, 4) == F.lit("CcnK").cast("binary")) & (F.substring(content, 9, 4) == F.lit("FPCh").cast("binary"))
    return F.when(wrapped, F.substring(content, F.lit(61), size)).otherwise(content)


def raw_state(spark, sf_dir):
    """A preset's state: as given, else its file in base 64 without an FXP wrapper, else empty."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.encode("s_name", "utf-8").alias("name"))
    wrapper = lambda magic: F.concat(F.lit("CcnK").cast("binary"), F.unhex(F.lit("00000000")), F.lit(magic).cast("binary"), F.unhex(F.lit("00" * 44)), F.unhex(F.lpad(F.hex(F.octet_length("name") - 1), 8, "0")), F.col("name"))
    kind = F.col("s_suppkey") % 5
    content = F.when(kind == 0, wrapper("FPCh")).when(kind == 1, wrapper("FxCk")).when(kind == 2, F.col("name")).when(kind == 3, F.lit("CcnK").cast("binary"))
    given = F.when(F.col("s_suppkey") % 11 == 0, F.lit("given"))
    return s.select("s_suppkey", F.coalesce(given, F.replace(F.base64(without_fxp(content)), F.lit("\r\n"), F.lit("")), F.lit("")).alias("state"))


def yaml_paths(spark, sf_dir):
    """Texts as double-quoted YAML scalars: blanks at the ends, colons and number signs survive."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return read(spark, sf_dir, "documents").select("doc_id", quoted.alias("scalar"))


def lead_in(spark, sf_dir):
    """Signals from the frame on at which the note begins."""
    g = frames(spark, sf_dir).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda t: t["x"]).alias("xs"))
    left = F.slice("xs", (F.col("sample_id") % 60 + 1).cast("int"), F.size("xs"))
    return g.select("sample_id", F.size(left).cast("long").alias("frames"), F.round(F.aggregate(left, F.lit(0.0), lambda t, x: t + x), 4).alias("total"))


def applied_gain(spark, sf_dir):
    """Frames at a gain in decibels; without one they stay as they are."""
    f = frames(spark, sf_dir)
    gain = F.col("sample_id") % 13 - 6
    return f.select("sample_id", "i", F.round(F.when(gain == 0, F.col("x")).otherwise(F.col("x") * F.pow(F.lit(10.0), gain / 20.0)), 5).alias("x"))


def build_identity(spark, sf_dir):
    """What tells builds of a plugin (eight parts) apart: names, sizes and times of its files, by name."""
    p = read(spark, sf_dir, "part")
    files = F.array_sort(F.collect_list(F.struct("p_name", "p_size", F.col("p_partkey").alias("time"))))
    each = lambda x: F.concat_ws(":", x["p_name"], x["p_size"].cast("string"), x["time"].cast("string"))
    g = p.groupBy(F.floor(F.col("p_partkey") / 8).alias("plugin")).agg(files.alias("files"))
    return g.select("plugin", F.array_join(F.transform("files", each), "|").alias("identity"))


def tag_name(spark, sf_dir):
    """The name that tags are derived from: a wavetable's or grain source's hint is put after it."""
    h = hits(spark, sf_dir)
    hint = F.when((F.col("id") % 3 != 0) & (F.col("id") % 5 != 0), F.element_at(F.array(*(F.lit(x) for x in ("pad", "bass", "lead", "drone"))), (F.col("size") % 4 + 1).cast("int")))
    return h.select("id", F.concat_ws(" ", "stem", hint).alias("name"))


def single_sources(spark, sf_dir):
    """One row for each wavetable or grain source: note 60, full name of the file, and a partner table for wavetables."""
    p = read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    table = F.col("page_id") % 2 == 0
    file = F.element_at(F.split("path", "/"), -1)
    return p.select(
        "page_id", "path", F.when(table, "wavetable").otherwise("granular").alias("category"), F.regexp_replace(file, r"(?<=.)\.[^.]*$", "").alias("name"), F.lit(60).alias("note"),
        F.lit(100).alias("velocity"), F.lit(1).alias("take"), F.when(table & (F.col("page_id") % 3 == 0), F.concat("path", F.lit(".partner"))).alias("partner"),
    )


def level_depth(spark, sf_dir):
    """(max - min) / mean of a signal's hop levels over its middle half; 0 where it is silent."""
    n = F.max("hop").over(Window.partitionBy("sample_id")) + 1
    h = hops(spark, sf_dir).withColumn("n", n).where((F.col("hop") >= F.floor(F.col("n") / 4)) & (F.col("hop") < F.floor(F.col("n") * 3 / 4)))
    mean = F.avg("rms")
    return h.groupBy("sample_id").agg(F.round(F.when(mean > 1e-6, (F.max("rms") - F.min("rms")) / mean).otherwise(0.0), 5).alias("depth"))


def chroma_movement(spark, sf_dir):
    """Mean cosine distance of a label's unit vectors from their common direction: 0 for a label that stands still."""
    e = read(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("k", "x"))
    unit = e.withColumn("x", F.col("x") / (F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("vec_id"))) + 1e-12))
    centre = unit.groupBy("label", "k").agg(F.avg("x").alias("c"))
    of_label = centre.groupBy("label").agg(F.sum(F.col("c") * F.col("c")).alias("square"))
    # the mean of the dot products with the centre is the dot product of the mean with it
    moved = 1 - F.col("square") / (F.sqrt("square") + 1e-12)
    return of_label.select("label", F.round(moved, 6).alias("movement"))


def echo_free_names(spark, sf_dir):
    """Names without what the folder's label already says."""
    h = hits(spark, sf_dir).select("id", F.concat_ws(" ", "brand", "stem").alias("name"), F.col("brand").alias("label"))
    return h.select("id", "name", L.without_echo(F.col("name"), F.array("label")).alias("short"))


_CHUNK = "encode(left(s_name, greatest(length(s_name) - 1, 0)))"
SQL = {
    "capture_faults": """WITH p AS (SELECT o_orderkey AS plan, o_orderkey % 9 AS step, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 100000.0 - 0.5 END AS seconds, o_custkey % 140 - 5 AS low, o_orderkey % 150 - 5 AS high FROM orders)
        SELECT plan, CASE WHEN step < 1 THEN 'step' WHEN seconds <= 0 THEN 'duration' WHEN low < 0 OR low > 127 OR high < 0 OR high > 127 THEN 'range' WHEN low >= high THEN 'order' ELSE '' END AS fault FROM p""",
    "note_period": HITS + " SELECT id, greatest(1, CAST(round_even(size * 1000 / (440.0 * pow(2.0, (id % 128 - 69) / 12.0)), 0) AS BIGINT)) AS period FROM h",
    "raw_state": f"""SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 11 = 0 THEN 'given' END, base64(CASE s_suppkey % 5 WHEN 0 THEN {_CHUNK}
        WHEN 1 THEN unhex('43636E4B00000000' || hex(encode('FxCk')) || repeat('00', 44) || printf('%08X', octet_length(encode(s_name)) - 1) || hex(encode(s_name)))
        WHEN 2 THEN encode(s_name) WHEN 3 THEN encode('CcnK') END), '') AS state FROM supplier""",
    "yaml_paths": """SELECT doc_id, '"' || replace(replace(text, '\\', '\\\\'), '"', '\\"') || '"' AS scalar FROM documents""",
    "lead_in": FRAMES + """ SELECT sample_id, count(*) FILTER (i >= sample_id % 60) AS frames, round(coalesce(sum(x) FILTER (i >= sample_id % 60), 0.0), 4) AS total FROM f GROUP BY 1""",
    "applied_gain": FRAMES + " SELECT sample_id, i, round(CASE WHEN sample_id % 13 = 6 THEN x ELSE x * pow(10.0, (sample_id % 13 - 6) / 20.0) END, 5) AS x FROM f",
    "build_identity": "SELECT p_partkey // 8 AS plugin, string_agg(p_name || ':' || p_size || ':' || p_partkey, '|' ORDER BY p_name, p_size, p_partkey) AS identity FROM part GROUP BY 1",
    "tag_name": HITS + " SELECT id, stem || CASE WHEN id % 3 <> 0 AND id % 5 <> 0 THEN ' ' || ['pad', 'bass', 'lead', 'drone'][size % 4 + 1] ELSE '' END AS name FROM h",
    "single_sources": """WITH p AS (SELECT page_id, url AS path, string_split(url, '/')[-1] AS file FROM pages)
        SELECT page_id, path, CASE WHEN page_id % 2 = 0 THEN 'wavetable' ELSE 'granular' END AS category, regexp_replace(file, '^(.+)\\.[^.]*$', '\\1') AS name, 60 AS note, 100 AS velocity, 1 AS take,
               CASE WHEN page_id % 6 = 0 THEN path || '.partner' END AS partner FROM p""",
    "level_depth": HOPS + """, n AS (SELECT *, max(hop) OVER (PARTITION BY sample_id) + 1 AS n FROM h)
        SELECT sample_id, round(CASE WHEN avg(rms) > 1e-6 THEN (max(rms) - min(rms)) / avg(rms) ELSE 0.0 END, 5) AS depth FROM n WHERE hop >= n // 4 AND hop < n * 3 // 4 GROUP BY 1""",
    "chroma_movement": """WITH m AS (SELECT label, vec_id, generate_subscripts(embedding, 1) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
        u AS (SELECT label, vec_id, k, x / (sqrt(sum(x * x) OVER (PARTITION BY vec_id)) + 1e-12) AS x FROM m),
        c AS (SELECT label, k, avg(x) AS c FROM u GROUP BY 1, 2), l AS (SELECT label, sqrt(sum(c * c)) + 1e-12 AS norm FROM c GROUP BY 1),
        d AS (SELECT u.label, u.vec_id, 1 - sum(u.x * c.c / norm) AS far FROM u JOIN c ON u.label = c.label AND u.k = c.k JOIN l ON l.label = u.label GROUP BY 1, 2)
        SELECT label, round(avg(far), 6) AS movement FROM d GROUP BY 1""",
    "echo_free_names": HITS + """, n AS (SELECT id, brand || ' ' || stem AS name, brand AS label FROM h)
        SELECT id, name, trim(regexp_replace(name, '^' || regexp_replace(label, '[^0-9A-Za-z'']+', '[^0-9A-Za-z'']+', 'g') || '[^0-9A-Za-z'']*', '', 'i'), ' -_') AS short FROM n""",
}
QUERIES = {k: f for k, f in list(globals().items()) if k in SQL}
