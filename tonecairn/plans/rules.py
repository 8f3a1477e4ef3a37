"""Queries for single rules: regions, skips, lookups, scaling, defaults, paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import signal as S
from ..sources.tables import read
from .hits import VIEW as HITS
from .hits import hits
from .signals import VIEW as FRAMES
from .signals import frames
from .zones import VIEW as ZONES
from .zones import first_of, zones


def region_read(spark, sf_dir):
    """The part of a signal from start to stop, both clamped; a stop of 0 or less is the end."""
    g = frames(spark, sf_dir).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda t: t["x"]).alias("xs"))
    n = F.size("xs")
    start = F.least(F.greatest((F.col("sample_id") % 7) * 5 - 5, F.lit(0)), n)
    wanted = F.when(F.col("sample_id") % 5 == 0, 0).otherwise((F.col("sample_id") % 9) * 9)
    stop = F.greatest(F.when(wanted <= 0, n).otherwise(F.least(wanted, n)), start)
    part = F.slice("xs", (start + 1).cast("int"), (stop - start).cast("int"))
    return g.select("sample_id", F.size(part).cast("long").alias("frames"), F.round(F.aggregate(part, F.lit(0.0), lambda t, x: t + x), 4).alias("total"))


def folder_kind(spark, sf_dir):
    """A brand's sizes are folders: a kit if none of their names (the size and first word) is a note, else one note each."""
    h = hits(spark, sf_dir).select("brand", (F.concat(F.substring("flavour", 1, 1), (F.col("size") % 9).cast("string"))).alias("folder"))
    note = F.upper("folder").rlike("^[A-G][0-9]$")
    return h.groupBy("brand").agg(F.when(F.bool_or(note), "notes").otherwise("kit").alias("kind"), F.count_distinct("folder").alias("folders"))


def solo_filter(spark, sf_dir):
    """Where a preset has soloed zones (dearest hundredth of a step) only those play; muted ones never do."""
    z = zones(spark, sf_dir).withColumns({"muted": F.col("status") == "F", "soloed": (F.col("note") % 50 == 0) & (F.col("velocity") > 30)})
    any_ = F.bool_or("soloed").over(Window.partitionBy("preset"))
    return z.withColumn("any", any_).where("not muted and (soloed or not any)").groupBy("preset").agg(F.count(F.lit(1)).alias("zones"))


def zone_skips(spark, sf_dir):
    """Zones by the first rule that leaves them out: no root, release trigger, other key switch, bounds."""
    z = zones(spark, sf_dir)
    rule = F.when(F.col("note") > 120, "no root").when(F.col("status") == "F", "release").when(F.col("rr") % 5 == 4, "key switch").when(F.col("gain") > 0.09, "bounds").otherwise("kept")
    return z.groupBy("preset", rule.alias("rule")).agg(F.count(F.lit(1)).alias("zones"))


def preview_note(spark, sf_dir):
    """The zone that a preview plays: nearest note to 60, then velocity to 100, then round robin."""
    tie = ["file", "price", "gain", "pan", "looped", "status", "shipped", "velocity", "note"]
    return first_of(zones(spark, sf_dir), ["preset"], F.abs(F.col("note") - 60), F.abs(F.col("velocity") - 100), "rr", *tie).select("preset", "note", "velocity", "rr")


def velocity_collapse(spark, sf_dir):
    """Of each note the highest layer below the top one, or the only one; of that the lowest round robin."""
    w = Window.partitionBy("preset", "note").orderBy(F.desc("velocity"))
    z = zones(spark, sf_dir).withColumn("layer", F.dense_rank().over(w))
    z = z.withColumn("layers", F.max("layer").over(Window.partitionBy("preset", "note"))).where("layer = least(2, layers)")
    return z.groupBy("preset", "note", "velocity").agg(F.min("rr").alias("rr"))


def key_lookup(spark, sf_dir):
    """The root that plays each key in a preset: an interval lookup in its centred key ranges."""
    from .zones import key_ranges_centred

    r = key_ranges_centred(spark, sf_dir).where("low <= high")
    r = r.withColumn("key", F.explode(F.sequence(F.greatest("low", F.lit(0)), F.least("high", F.lit(127)))))  # rows per range, no theta join
    return r.select("preset", F.col("key").cast("long").alias("key"), "note")


# What a free text on a controller asks for, in the order in which the intents are tried.
_VIBRATO = "vibrato|waver|warble"
_DARKEN = "cutoff down|close filter|darken|soften|softer|dampen|warmer"
_BRIGHTEN = "cutoff|filter|bright|presence"
_NOT_BRIGHTEN = "filter (fm|mod|lfo|env)"
_USAGES = ("Cutoff down", "Filter", "Filter Env depth", "WARBLE + cutoff", "brightness", "warmer", "Volume", "presence, vibrato", "filter lfo", "Close Filter")


def intent_of(text, controller):
    """vibrato for any controller; of the wheel (MW) darken before brighten, and no brighten for the filter's own modulators."""
    says = lambda words: F.lower(text).rlike(words)
    wheel = F.when(says(_DARKEN), "darken").when(says(_BRIGHTEN) & ~says(_NOT_BRIGHTEN), "brighten")
    return F.when(says(_VIBRATO), "vibrato").when(controller == "MW", wheel)


def intent(spark, sf_dir):
    """What the usage line of each event asks its controller to do."""
    usages = F.array(*(F.lit(u) for u in _USAGES))
    e = read(spark, sf_dir, "events").select("event_id", F.element_at(usages, (F.col("event_id") % len(_USAGES) + 1).cast("int")).alias("usage"), F.when(F.col("user_id") % 2 == 0, "MW").otherwise("AT").alias("controller"))
    return e.select("event_id", "usage", "controller", intent_of(F.col("usage"), F.col("controller")).alias("intent"))


def cutoff_steps(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    moves = F.abs("value") * 2
    rate = F.when(moves > 150, 0.55).when(moves > 50, 0.30).otherwise(0.15)
    depth = F.least(F.when(moves > 150, 0.75).when(moves > 50, 0.60).otherwise(0.45), F.lit(1.0) - (F.col("event_id") % 10) / 10.0)
    return e.select("event_id", rate.alias("rate"), F.round(depth, 6).alias("depth"), F.round(F.least(F.greatest(0.35 + moves / 600, F.lit(0.05)), F.lit(0.95)), 6).alias("cutoff"))


def scaled_loop(spark, sf_dir):
    """Loop points at the rate that fits, rounded half to even."""
    h = hits(spark, sf_dir)
    rate = F.col("size") * 8000
    ratio = S.fitted_rate(rate) / rate
    return h.select("id", F.round(ratio, 6).alias("ratio"), F.bround((F.col("id") * 3) * ratio).cast("long").alias("start"), F.bround((F.col("id") * 3 + 1001) * ratio).cast("long").alias("stop"))


def backfill(spark, sf_dir):
    """A customer's segment only where its balance says nothing, and only if it isn't the default."""
    c = read(spark, sf_dir, "customer")
    own = F.nullif("c_mktsegment", F.lit("BUILDING"))
    return c.select("c_custkey", F.coalesce(F.when(F.col("c_acctbal") < 0, F.lit("overdrawn")), own, F.lit("plain")).alias("mode"))


def oneshot_note(spark, sf_dir):
    """The MIDI note of a pitch class nearest to a target, the lower of two; a flag outside 12 to 108."""
    h = hits(spark, sf_dir).select("id", (F.col("size") % 12).alias("klass"), (F.col("id") % 128).alias("target"))
    up = F.pmod(F.col("klass") - F.col("target"), F.lit(12))
    note = F.when((up <= 5) | (F.col("target") - (12 - up) < 0), F.col("target") + up).otherwise(F.col("target") - (12 - up))
    note = F.when(note > 127, note - 12).otherwise(note)
    return h.select("id", note.alias("note"), (~note.between(12, 108)).alias("flagged"))


def near_thresholds(spark, sf_dir):
    """Values within five percent of a threshold, and lengths near a multiple of a period from either side."""
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id", (F.abs(F.col("value") - 50) <= 0.05 * 50).alias("near"), S.near_multiple(F.col("event_id") % 1000, (F.col("user_id") % 40 + 10).cast("double")).alias("multiple")
    )


def tail_is_release(spark, sf_dir):
    """Whether the last four frames are under a tenth of the level of the middle half, and whether all of a set's signals are."""
    f = frames(spark, sf_dir)
    n = F.count(F.lit(1)).over(Window.partitionBy("sample_id"))
    f = f.withColumn("n", n)
    d = F.col("x").cast("decimal(12,2)")
    last, mid = F.when(F.col("i") >= F.col("n") - 4, d * d), F.when((F.col("i") * 4 >= F.col("n")) & (F.col("i") * 4 < F.col("n") * 3), d * d)
    g = f.groupBy("sample_id").agg(F.round(F.sqrt(F.avg(last.cast("double"))), 4).alias("tail"), F.round(F.sqrt(F.avg(mid.cast("double"))), 4).alias("body"))
    g = g.withColumn("release", F.col("tail") < 0.1 * F.col("body"))
    return g.select("sample_id", "release", F.every("release").over(Window.partitionBy(F.col("sample_id") % 10)).alias("all_of_set"))


def path_candidates(spark, sf_dir):
    """Where a preset may already lie: two folders by two extensions."""
    s = read(spark, sf_dir, "supplier")
    name = F.regexp_replace("s_name", "[^A-Za-z0-9]+", "_")
    paths = [F.concat(F.lit(a), name, F.lit(b)) for a in ("SYNTHS/", "KITS/") for b in (".XML", ".xml")]
    return s.select("s_suppkey", F.posexplode(F.array(*paths)).alias("k", "path")).select("s_suppkey", F.col("k").cast("long").alias("k"), "path")


def prefix_split(spark, sf_dir):
    """Category and name of ``category - name`` labels; the folder below the last ``fr``, ``en``, ``de`` or ``es`` of a URL."""
    p = read(spark, sf_dir, "pages").select("page_id", F.split(F.regexp_replace("url", "[?#].*$", ""), "/").alias("parts"))
    marks = F.transform("parts", lambda x, i: F.when(x.isin("fr", "en", "de", "es"), i + 1))
    last = F.array_max(marks)
    return p.select("page_id", F.array_join(F.slice("parts", F.coalesce(last, F.size("parts")) + 1, F.size("parts")), "/").alias("below"), F.element_at("parts", 1).alias("scheme"))


def family_counts(spark, sf_dir):
    """Categories collapsed into families, and flavours with at least two of them."""
    family = F.when(F.col("category").isin("ring", "bolt"), "metal").when(F.col("category").rlike("^g"), "g").otherwise(F.col("category"))
    return hits(spark, sf_dir).groupBy("flavour").agg(F.count_distinct(family).alias("families")).where("families >= 2")


def correlation(spark, sf_dir):
    """Pearson correlation of both channels, none where one is still; equal power up to a third."""
    g = frames(spark, sf_dir).groupBy("sample_id").agg(F.round(F.corr("x", "r"), 6).alias("r"), F.stddev_pop("x").alias("sx"), F.stddev_pop("r").alias("sr"))
    return g.select("sample_id", "r", ((F.col("sx") > 0) & (F.col("sr") > 0) & (F.col("r") <= 0.333333)).alias("equal_power"))


def hit_rates(spark, sf_dir):
    """Hits and misses of a cache layer by priority, with the rate."""
    o = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("hits"), F.count_if(F.col("o_orderstatus") != "F").alias("misses"))
    return o.withColumn("rate", F.round(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), 6))


SQL = {
    "region_read": FRAMES + """, n AS (SELECT sample_id, count(*) AS n FROM f GROUP BY 1), b AS (SELECT sample_id, n, least(greatest(sample_id % 7 * 5 - 5, 0), n) AS a,
            CASE WHEN sample_id % 5 = 0 OR sample_id % 9 = 0 THEN n ELSE least(sample_id % 9 * 9, n) END AS z FROM n)
        SELECT sample_id, greatest(max(z), max(a)) - max(a) AS frames, round(coalesce(sum(x) FILTER (i >= a AND i < z), 0), 4) AS total FROM b JOIN f USING (sample_id) GROUP BY 1""",
    "folder_kind": HITS + """, k AS (SELECT brand, substr(flavour, 1, 1) || (size % 9) AS folder FROM h)
        SELECT brand, CASE WHEN bool_or(regexp_matches(upper(folder), '^[A-G][0-9]$')) THEN 'notes' ELSE 'kit' END AS kind, count(DISTINCT folder) AS folders FROM k GROUP BY 1""",
    "solo_filter": ZONES + """, s AS (SELECT *, note % 50 = 0 AND velocity > 30 AS soloed FROM z), a AS (SELECT *, bool_or(soloed) OVER (PARTITION BY preset) AS any_ FROM s)
        SELECT preset, count(*) AS zones FROM a WHERE status <> 'F' AND (soloed OR NOT any_) GROUP BY 1""",
    "zone_skips": ZONES + """ SELECT preset, CASE WHEN note > 120 THEN 'no root' WHEN status = 'F' THEN 'release' WHEN rr % 5 = 4 THEN 'key switch' WHEN gain > 0.09 THEN 'bounds' ELSE 'kept' END AS rule,
        count(*) AS zones FROM z GROUP BY 1, 2""",
    "preview_note": ZONES + " SELECT preset, note, velocity, rr FROM z QUALIFY row_number() OVER (PARTITION BY preset ORDER BY abs(note - 60), abs(velocity - 100), rr, file, price, gain, pan, looped, status, shipped, velocity, note) = 1",
    "velocity_collapse": ZONES + """, d AS (SELECT *, dense_rank() OVER (PARTITION BY preset, note ORDER BY velocity DESC) AS layer FROM z), m AS (SELECT *, max(layer) OVER (PARTITION BY preset, note) AS layers FROM d)
        SELECT preset, note, velocity, min(rr) AS rr FROM m WHERE layer = least(2, layers) GROUP BY 1, 2, 3""",
    "key_lookup": ZONES + """, n AS (SELECT DISTINCT preset, note FROM z), c AS (SELECT preset, note, coalesce((lag(note) OVER w + note + 1) // 2, 0) AS low, coalesce((note + lead(note) OVER w - 1) // 2, 127) AS high FROM n WINDOW w AS (PARTITION BY preset ORDER BY note))
        SELECT preset, key, note FROM c JOIN range(0, 128) t(key) ON key BETWEEN low AND high""",
    "intent": f"""WITH u AS (SELECT event_id, {list(_USAGES)}[event_id % {len(_USAGES)} + 1] AS usage, CASE WHEN user_id % 2 = 0 THEN 'MW' ELSE 'AT' END AS controller FROM events)
        SELECT event_id, usage, controller, CASE WHEN regexp_matches(lower(usage), '{_VIBRATO}') THEN 'vibrato' WHEN controller <> 'MW' THEN NULL WHEN regexp_matches(lower(usage), '{_DARKEN}') THEN 'darken'
        WHEN regexp_matches(lower(usage), '{_BRIGHTEN}') AND NOT regexp_matches(lower(usage), '{_NOT_BRIGHTEN}') THEN 'brighten' END AS intent FROM u""",
    "cutoff_steps": """WITH e AS (SELECT event_id, abs(value) * 2 AS m FROM events)
        SELECT event_id, CASE WHEN m > 150 THEN 0.55 WHEN m > 50 THEN 0.30 ELSE 0.15 END::DOUBLE AS rate,
               round(least(CASE WHEN m > 150 THEN 0.75 WHEN m > 50 THEN 0.60 ELSE 0.45 END::DOUBLE, 1.0::DOUBLE - (event_id % 10) / 10.0::DOUBLE), 6) AS depth, round(least(greatest(0.35 + m / 600, 0.05), 0.95), 6) AS cutoff FROM e""",
    "scaled_loop": HITS + """, r AS (SELECT id, CASE WHEN size * 8000 > 384000 THEN 0.125 WHEN size * 8000 > 192000 THEN 0.25 WHEN size * 8000 > 96000 THEN 0.5 ELSE 1.0 END::DOUBLE AS ratio FROM h)
        SELECT id, ratio, CAST(round_even(id * 3 * ratio, 0) AS BIGINT) AS start, CAST(round_even((id * 3 + 1001) * ratio, 0) AS BIGINT) AS stop FROM r""",
    "backfill": "SELECT c_custkey, coalesce(CASE WHEN c_acctbal < 0 THEN 'overdrawn' END, nullif(c_mktsegment, 'BUILDING'), 'plain') AS mode FROM customer",
    "oneshot_note": HITS + """, n AS (SELECT id, note FROM h, range(0, 128) t(note) WHERE note % 12 = size % 12 QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(note - id % 128), CASE WHEN note % 12 = size % 12 AND note - id % 128 = 6 THEN 1 ELSE 0 END, note) = 1)
        SELECT id, note, note NOT BETWEEN 12 AND 108 AS flagged FROM n""",
    "near_thresholds": """WITH e AS (SELECT event_id, value, event_id % 1000 AS l, (user_id % 40 + 10)::DOUBLE AS t FROM events)
        SELECT event_id, abs(value - 50) <= 0.05 * 50 AS near, least(l % t, t - l % t) < 0.1 * t AS multiple FROM e""",
    "tail_is_release": FRAMES + """, m AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n FROM f),
        g AS (SELECT sample_id, round(sqrt(avg(x * x) FILTER (i >= n - 4)), 4) AS tail, round(sqrt(avg(x * x) FILTER (i * 4 >= n AND i * 4 < n * 3)), 4) AS body FROM m GROUP BY 1)
        SELECT sample_id, tail < 0.1 * body AS release, bool_and(tail < 0.1 * body) OVER (PARTITION BY sample_id % 10) AS all_of_set FROM g""",
    "path_candidates": """WITH s AS (SELECT s_suppkey, regexp_replace(s_name, '[^A-Za-z0-9]+', '_', 'g') AS n FROM supplier)
        SELECT s_suppkey, k, ['SYNTHS/', 'KITS/'][k // 2 + 1] || n || ['.XML', '.xml'][k % 2 + 1] AS path FROM s, range(0, 4) t(k)""",
    "prefix_split": """WITH p AS (SELECT page_id, string_split(regexp_replace(url, '[?#].*$', ''), '/') AS parts FROM pages),
        m AS (SELECT page_id, parts, list_max(list_transform(range(1, len(parts) + 1), lambda i: CASE WHEN parts[i] IN ('fr', 'en', 'de', 'es') THEN i END)) AS k FROM p)
        SELECT page_id, coalesce(array_to_string(parts[coalesce(k, len(parts)) + 1 :], '/'), '') AS below, parts[1] AS scheme FROM m""",
    "family_counts": HITS + """ SELECT flavour, count(DISTINCT CASE WHEN category IN ('ring', 'bolt') THEN 'metal' WHEN category LIKE 'g%' THEN 'g' ELSE category END) AS families FROM h GROUP BY 1 HAVING families >= 2""",
    "correlation": FRAMES + """, g AS (SELECT sample_id, round(corr(x, r), 6) AS r, stddev_pop(x) AS sx, stddev_pop(r) AS sr FROM f GROUP BY 1)
        SELECT sample_id, r, sx > 0 AND sr > 0 AND r <= 0.333333 AS equal_power FROM g""",
    "hit_rates": """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS hits, count(*) FILTER (o_orderstatus <> 'F') AS misses,
        round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS rate FROM orders GROUP BY 1""",
}
QUERIES = {k: f for k, f in list(globals().items()) if k in SQL}
