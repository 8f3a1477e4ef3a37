"""Queries over the vocabulary: names that hits could have, with the categories and tags that they give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocabulary as V
from .hits import VIEW, hits

# names, with the categories that the rules give them
_HITS = (
    ("Bass Drum 707", "kick"), ("Bass Drumtrax 05", "kick"), ("Bass Hit", "other"), ("SD_Rim", "snare"), ("Crash1", "cymbal_crash"), ("Ride_Cymbal", "cymbal_ride"), ("Cymbal_01", "cymbal_crash"), ("Open Hat", "hat_open"),
    ("HiHat03", "hat_closed"), ("OH", "hat_open"), ("Low Tom 3", "tom_low"), ("tom2 hi", "tom_high"), ("TOM", "tom_mid"), ("Bongos", "conga_mid"), ("Lo Conga7", "conga_low"), ("Conga HI", "conga_high"), ("zap", "other"),
    ("kick-bell", "kick"), ("bell4", "bell"), ("Tamb#1", "other"), ("woodblock", "block"), ("", "other"),
)
_FOLDERS = (("01. Bass Drum", "kick"), ("CH", "hat_closed"), ("02. Hand Clap", "clap"), ("3 Cymbal", "other"), ("10.Rim Shot", "rim"), ("Open Hat", "other"), ("Wood-Block", "block"))
_LABELS = ("01. Keys & Pads", "Vinyl Drums", "DreamyTextures", "Orchestral Brass", "808 Bass", "Found", "Kits", "Individual Hits", "Shaker Loops")
_NAMES = ("Brass Knuckle", "Acid Line", "softPad Lead", "nothing here", "Bell Choir Voice Organ", "dream on")


def _pick(values, index):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def drum_names(spark, sf_dir):
    """Categories and places in a kit of the names and folders of hits."""
    h = hits(spark, sf_dir)
    name, folder = _pick([n for n, _ in _HITS], F.col("id")), _pick([n for n, _ in _FOLDERS], F.col("id"))
    c = V.drum_category(name)
    return h.select("id", name.alias("name"), c.alias("category"), V.kit_rank(c).cast("long").alias("rank"), V.folder_category(folder).alias("folder_category"))


def preset_tags(spark, sf_dir):
    """Tags of presets from two labels, a collection and a name, and whether the first label says no more than tags do."""
    h = hits(spark, sf_dir)
    deep, shallow, name = _pick(_LABELS, F.col("id")), _pick(_LABELS, F.floor(F.col("id") / 9)), _pick(_NAMES, F.floor(F.col("id") / 4))
    tags = V.preset_tags(F.col("id") % 5 == 0, F.array(deep, shallow, F.lit("Analogue Collection")), name)
    return h.select("id", F.array_join(tags, ",").alias("tags"), V.said_by_tags(deep).alias("said"))


_WORDS = ", ".join(f"('{w}', '{t}', {str(w in V.THEMES).lower()})" for t, words in V.TAG_WORDS.items() for w in words.split())
_SPLIT = "list_filter(regexp_split_to_array(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"
SQL = {
    "drum_names": VIEW + f""", n AS (SELECT id, {[n for n, _ in _HITS]}[id % {len(_HITS)} + 1] AS name, {[c for _, c in _HITS]}[id % {len(_HITS)} + 1] AS category, {[c for _, c in _FOLDERS]}[id % {len(_FOLDERS)} + 1] AS folder_category FROM h)
        SELECT id, name, category, list_position({V.KIT_ORDER}, category) - 1 AS rank, folder_category FROM n""",
    "preset_tags": VIEW + f""", m(w, tag, theme) AS (VALUES {_WORDS}),
        p AS (SELECT id, id % 5 = 0 AS drum, {list(_LABELS)}[id % 9 + 1] AS deep, [{list(_LABELS)}[id % 9 + 1], {list(_LABELS)}[id // 9 % 9 + 1], 'Analogue Collection', {list(_NAMES)}[id // 4 % 6 + 1]] AS texts FROM h),
        s AS (SELECT id, unnest(texts) AS x, generate_subscripts(texts, 1) AS k FROM p), t AS (SELECT id, k, {_SPLIT.format(x="x")} AS ws FROM s), u AS (SELECT id, k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
        c AS (SELECT id, k, i, tag, theme, bool_or(k = 4) OVER (PARTITION BY id) AS named, bool_or(tag = 'Percussion') OVER (PARTITION BY id) AS perc FROM u JOIN m USING (w)),
        f AS (SELECT id, tag, min(k * 1000 + i) AS place FROM c WHERE NOT (theme AND k < 4 AND named) GROUP BY 1, 2), g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS n FROM f),
        a AS (SELECT id, string_agg(tag, ',' ORDER BY n) FILTER (n <= 3) AS tags FROM g GROUP BY 1), b AS (SELECT id, bool_or(perc) AS perc FROM c GROUP BY 1),
        d AS (SELECT id, count(*) = count(m.w) AS said FROM (SELECT id, unnest({_SPLIT.format(x="deep")}) AS w FROM p) LEFT JOIN m USING (w) GROUP BY 1)
        SELECT p.id, CASE WHEN drum THEN CASE WHEN coalesce(perc, false) THEN 'Drum,Percussion' ELSE 'Drum' END ELSE coalesce(tags, 'Synth') END AS tags, said
        FROM p LEFT JOIN a USING (id) LEFT JOIN b USING (id) LEFT JOIN d USING (id)""",
}
QUERIES = {k: f for k, f in list(globals().items()) if k in SQL}
