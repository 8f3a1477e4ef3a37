"""Zone queries: a supplier of ``lineitem`` is a preset, its rows are zones.

Note: part key modulo 128; velocity: quantity; round robin: line number; gain:
discount; a loop: return flag A. Rows repeat, so every order is by all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.quantiles import quantiles
from ..sources.tables import read

VIEW = "WITH z AS (SELECT l_suppkey AS preset, l_partkey % 128 AS note, CAST(l_quantity AS BIGINT) AS velocity, CAST(l_linenumber AS BIGINT) AS rr, l_discount AS gain, l_returnflag = 'A' AS looped, l_orderkey AS file, l_extendedprice AS price, l_tax AS pan, l_linestatus AS status, l_shipdate AS shipped FROM lineitem)"
_TIE = ["file", "rr", "price", "gain", "pan", "looped", "status", "shipped", "velocity", "note"]
TIE = ", ".join(_TIE)


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("preset"), (F.col("l_partkey") % 128).alias("note"), F.col("l_quantity").cast("long").alias("velocity"),
        F.col("l_linenumber").cast("long").alias("rr"), F.col("l_discount").alias("gain"), (F.col("l_returnflag") == "A").alias("looped"),
        F.col("l_orderkey").alias("file"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("pan"), F.col("l_linestatus").alias("status"), F.col("l_shipdate").alias("shipped"),
    )


def first_of(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def velocity_pick(spark, sf_dir):
    """Of each note of a preset the zone whose velocity is nearest to 40, then the lowest round robin."""
    picked = first_of(zones(spark, sf_dir), ["preset", "note"], F.abs(F.col("velocity") - 40), "rr", *_TIE)
    return picked.select("preset", "note", "velocity", "rr", "file")


def rr_renumber(spark, sf_dir):
    """Round robins of a root and layer numbered from 1."""
    w = Window.partitionBy("preset", "note", "velocity").orderBy(*_TIE)
    return zones(spark, sf_dir).select("preset", "note", "velocity", "file", "price", F.row_number().over(w).cast("long").alias("take"))


def layer_nearest(spark, sf_dir):
    """Of a preset's layers of ten velocities the one nearest to 25, ties to the louder."""
    layers = zones(spark, sf_dir).groupBy("preset", (F.floor((F.col("velocity") - 1) / 10) * 10 + 1).cast("long").alias("low")).agg(F.count(F.lit(1)).alias("zones"))
    away = F.when(F.col("low") > 25, F.col("low") - 25).when(F.col("low") + 9 < 25, 25 - F.col("low") - 9).otherwise(F.lit(0))
    return first_of(layers, ["preset"], away, F.desc("low"))


def _notes(spark, sf_dir) -> DataFrame:
    return zones(spark, sf_dir).select("preset", "note").distinct()


def key_ranges_simple(spark, sf_dir):
    """Each root reaches to the next one's lower neighbour, the last one six keys on."""
    w = Window.partitionBy("preset").orderBy("note")
    return _notes(spark, sf_dir).select("preset", "note", F.coalesce(F.lead("note").over(w) - 1, F.col("note") + 6).alias("top"), (F.lit(48) - F.col("note")).alias("transpose"))


def centred(note: str, keys: str, low: int, high: int) -> dict[str, Column]:
    """Ranges that meet half way between neighbours and run to ``low`` and ``high`` at the ends."""
    w = Window.partitionBy(keys).orderBy(note)
    below, above = F.lag(note).over(w), F.lead(note).over(w)
    return {
        "low": F.coalesce(F.floor((below + F.col(note) + 1) / 2), F.lit(low)).cast("long"),
        "high": F.coalesce(F.floor((F.col(note) + above - 1) / 2), F.lit(high)).cast("long"),
    }


def key_ranges_centred(spark, sf_dir):
    return _notes(spark, sf_dir).withColumns(centred("note", "preset", 0, 127))


def key_ranges_authored(spark, sf_dir):
    """Every seventh root has a range of its own of two keys around it, unless another root is inside; neighbours give way."""
    w = Window.partitionBy("preset").orderBy("note")
    r = _notes(spark, sf_dir).withColumns(centred("note", "preset", 0, 127)).withColumns({"below": F.lag("note").over(w), "above": F.lead("note").over(w)})
    free = (F.coalesce(F.col("note") - F.col("below"), F.lit(99)) > 2) & (F.coalesce(F.col("above") - F.col("note"), F.lit(99)) > 2)
    r = r.withColumn("own", (F.col("note") % 7 == 0) & free)
    r = r.withColumns({"low": F.when(F.col("own"), F.greatest(F.col("note") - 2, F.lit(0))).otherwise(F.col("low")), "high": F.when(F.col("own"), F.least(F.col("note") + 2, F.lit(127))).otherwise(F.col("high"))})
    before, after = F.lag(F.when(F.col("own"), F.col("high"))).over(w), F.lead(F.when(F.col("own"), F.col("low"))).over(w)
    return r.select(
        "preset", "note", "own",
        F.when(F.col("own"), F.col("low")).otherwise(F.coalesce(before + 1, F.col("low"))).alias("low"),
        F.when(F.col("own"), F.col("high")).otherwise(F.coalesce(after - 1, F.col("high"))).alias("high"),
    )


def thin_notes(spark, sf_dir):
    """Of a preset's notes in order those at least 3 above the last one kept: a fold over the sorted notes."""
    notes = zones(spark, sf_dir).groupBy("preset").agg(F.array_sort(F.collect_set("note")).alias("notes"))
    none = F.array().cast("array<bigint>")
    kept = F.aggregate("notes", none, lambda a, n: F.when((F.size(a) == 0) | (n - F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(-9)) >= 3), F.array_append(a, n)).otherwise(a))
    return notes.select("preset", F.explode(kept).alias("note"))


def loop_vote(spark, sf_dir):
    """Loops on by at least half, a looping profile by more than half, fades for under half authored."""
    g = zones(spark, sf_dir).groupBy("preset", "note").agg(F.count(F.lit(1)).alias("n"), F.count_if("looped").alias("loops"))
    return g.select("preset", "note", (F.col("loops") * 2 >= F.col("n")).alias("loop_on"), (F.col("loops") * 2 > F.col("n")).alias("looping_profile"), (F.col("loops") * 2 < F.col("n")).alias("fade"))


def medians(spark, sf_dir):
    """The interpolated median, the upper median and the lower fifth of velocities."""
    v = F.array_sort(F.collect_list("velocity"))
    g = zones(spark, sf_dir).groupBy("preset").agg(F.median("velocity").alias("median"), F.percentile("velocity", 0.2).alias("fifth"), v.alias("vs"))
    return g.select("preset", "median", F.element_at("vs", (F.floor(F.size("vs") / 2) + 1).cast("int")).alias("upper"), F.round("fifth", 6).alias("fifth"))


def price_quantiles(spark, sf_dir):
    """Median, upper median and lower fifth of the prices of a whole return flag: groups that no task holds."""
    found = quantiles(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.5, 0.2)
    return found.select("l_returnflag", "n", F.round("quantile", 6).alias("median"), F.col("upper"), F.round("quantile_2", 6).alias("fifth"))


def ref_gain(spark, sf_dir):
    """Gain under the preset's largest; less than a hundredth counts as none."""
    z = zones(spark, sf_dir).groupBy("preset", "note").agg(F.max("gain").alias("gain"))
    d = F.round(F.col("gain") - F.max("gain").over(Window.partitionBy("preset")), 6)
    return z.select("preset", "note", F.when(F.abs(d) < 0.01, F.lit(0.0)).otherwise(d).alias("gain"))


def stereo_pair_zip(spark, sf_dir):
    """Hard-left zones (status O) and hard-right ones (F) of one root and velocity, paired by rank; the rest stay alone."""
    z = zones(spark, sf_dir)
    w = Window.partitionBy("preset", "note", "velocity", "status").orderBy(*_TIE)
    z = z.withColumn("rank", F.row_number().over(w).cast("long"))
    left = z.where("status = 'O'").select("preset", "note", "velocity", "rank", F.col("file").alias("left_file"))
    right = z.where("status = 'F'").select("preset", "note", "velocity", "rank", F.col("file").alias("right_file"))
    return left.join(right, ["preset", "note", "velocity", "rank"], "full")


def group_layers(spark, sf_dir):
    """Members of each velocity layer, in the order of their files."""
    g = zones(spark, sf_dir).groupBy("preset", "velocity").agg(F.array_sort(F.collect_list("file")).alias("files"))
    return g.select("preset", "velocity", F.size("files").cast("long").alias("members"), F.array_join(F.slice("files", 1, 5), ",").alias("first_files"))


def mapped_summary(spark, sf_dir):
    """Roots, loops and pairs of every preset."""
    return zones(spark, sf_dir).groupBy("preset").agg(
        F.min("note").alias("lowest"), F.max("note").alias("highest"), F.count_distinct("note").alias("roots"), F.count_if("looped").alias("looped"),
        F.count_if(F.col("status") == "O").alias("open"), (F.count_if("looped") * 2 > F.count(F.lit(1))).alias("synth"),
    )


def slot_pads(spark, sf_dir):
    """Notes of a preset on 16 pads: low ones to 8-15, high ones to 0-7, what finds no place to the free pads in order."""
    n = _notes(spark, sf_dir).withColumn("kind", F.when(F.col("note") < 40, "low").when(F.col("note") >= 88, "high").otherwise("mid"))
    n = n.withColumn("k", F.row_number().over(Window.partitionBy("preset", "kind").orderBy("note")))
    home = F.when((F.col("kind") == "low") & (F.col("k") <= 8), F.col("k") + 7).when((F.col("kind") == "high") & (F.col("k") <= 8), F.col("k") - 1)
    n = n.withColumn("pad", home)
    placed = n.where("pad is not null").select("preset", "note", F.col("pad").cast("long").alias("pad"))
    rest = n.where("pad is null").withColumn("k", F.row_number().over(Window.partitionBy("preset").orderBy("note"))).select("preset", "note", "k")
    pads = n.select("preset").distinct().select("preset", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("pad"))
    free = pads.join(placed, ["preset", "pad"], "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("preset").orderBy("pad")))
    return placed.unionByName(rest.join(free, ["preset", "k"]).select("preset", "note", "pad"))


def hidden_base_takes(spark, sf_dir):
    """Where numbered takes exist the unnumbered first is hidden; at most two takes of each note stay."""
    z = zones(spark, sf_dir)
    w = Window.partitionBy("preset", "note")
    z = z.withColumn("numbered", F.max((F.col("rr") > 1).cast("int")).over(w)).where("rr > 1 or numbered = 0")
    ranked = z.withColumn("take", F.row_number().over(w.orderBy("rr", *_TIE)).cast("long")).where("take <= 2")
    return ranked.select("preset", "note", "take", "rr", "file")


_RANGES = VIEW + """, n AS (SELECT DISTINCT preset, note FROM z), w AS (SELECT *, lag(note) OVER p AS below, lead(note) OVER p AS above FROM n WINDOW p AS (PARTITION BY preset ORDER BY note)),
    c AS (SELECT preset, note, below, above, coalesce((below + note + 1) // 2, 0) AS low, coalesce((note + above - 1) // 2, 127) AS high FROM w)"""

SQL = {
    "velocity_pick": VIEW + f" SELECT preset, note, velocity, rr, file FROM z QUALIFY row_number() OVER (PARTITION BY preset, note ORDER BY abs(velocity - 40), rr, {TIE}) = 1",
    "rr_renumber": VIEW + f" SELECT preset, note, velocity, file, price, row_number() OVER (PARTITION BY preset, note, velocity ORDER BY {TIE}) AS take FROM z",
    "layer_nearest": VIEW + """, l AS (SELECT preset, (velocity - 1) // 10 * 10 + 1 AS low, count(*) AS zones FROM z GROUP BY 1, 2)
        SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY preset ORDER BY CASE WHEN low > 25 THEN low - 25 WHEN low + 9 < 25 THEN 25 - low - 9 ELSE 0 END, low DESC) = 1""",
    "key_ranges_simple": VIEW + ", n AS (SELECT DISTINCT preset, note FROM z) SELECT preset, note, coalesce(lead(note) OVER (PARTITION BY preset ORDER BY note) - 1, note + 6) AS top, 48 - note AS transpose FROM n",
    "key_ranges_centred": _RANGES + " SELECT preset, note, low, high FROM c",
    "key_ranges_authored": _RANGES + """, o AS (SELECT preset, note, note % 7 = 0 AND coalesce(note - below, 99) > 2 AND coalesce(above - note, 99) > 2 AS own, low, high FROM c),
        r AS (SELECT preset, note, own, CASE WHEN own THEN greatest(note - 2, 0) ELSE low END AS low, CASE WHEN own THEN least(note + 2, 127) ELSE high END AS high FROM o),
        b AS (SELECT *, lag(CASE WHEN own THEN high END) OVER p AS bh, lead(CASE WHEN own THEN low END) OVER p AS al FROM r WINDOW p AS (PARTITION BY preset ORDER BY note))
        SELECT preset, note, own, CASE WHEN own THEN low ELSE coalesce(bh + 1, low) END AS low, CASE WHEN own THEN high ELSE coalesce(al - 1, high) END AS high FROM b""",
    "thin_notes": "WITH RECURSIVE n AS (SELECT DISTINCT l_suppkey AS preset, l_partkey % 128 AS note FROM lineitem), k AS (SELECT preset, min(note) AS note FROM n GROUP BY 1 UNION ALL SELECT preset, (SELECT min(n.note) FROM n WHERE n.preset = k.preset AND n.note >= k.note + 3) FROM k WHERE note IS NOT NULL) SELECT * FROM k WHERE note IS NOT NULL",
    "loop_vote": VIEW + """ SELECT preset, note, count(*) FILTER (looped) * 2 >= count(*) AS loop_on, count(*) FILTER (looped) * 2 > count(*) AS looping_profile,
        count(*) FILTER (looped) * 2 < count(*) AS fade FROM z GROUP BY 1, 2""",
    "price_quantiles": """SELECT l_returnflag, count(*) AS n, round(median(l_extendedprice), 6) AS median, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS upper,
        round(quantile_cont(l_extendedprice, 0.2), 6) AS fifth FROM lineitem GROUP BY 1""",
    "medians": VIEW + " SELECT preset, median(velocity) AS median, list_sort(list(velocity))[count(*) // 2 + 1] AS upper, round(quantile_cont(velocity, 0.2), 6) AS fifth FROM z GROUP BY 1",
    "ref_gain": VIEW + """, g AS (SELECT preset, note, max(gain) AS gain FROM z GROUP BY 1, 2), d AS (SELECT preset, note, round(gain - max(gain) OVER (PARTITION BY preset), 6) AS d FROM g)
        SELECT preset, note, CASE WHEN abs(d) < 0.01 THEN 0.0 ELSE d END AS gain FROM d""",
    "stereo_pair_zip": VIEW + f""", k AS (SELECT *, row_number() OVER (PARTITION BY preset, note, velocity, status ORDER BY {TIE}) AS rank FROM z),
        a AS (SELECT preset, note, velocity, rank, file AS left_file FROM k WHERE status = 'O'), b AS (SELECT preset, note, velocity, rank, file AS right_file FROM k WHERE status = 'F')
        SELECT * FROM a FULL JOIN b USING (preset, note, velocity, rank)""",
    "group_layers": VIEW + " SELECT preset, velocity, count(*) AS members, array_to_string(list_sort(list(file))[1:5], ',') AS first_files FROM z GROUP BY 1, 2",
    "mapped_summary": VIEW + """ SELECT preset, min(note) AS lowest, max(note) AS highest, count(DISTINCT note) AS roots, count(*) FILTER (looped) AS looped,
        count(*) FILTER (status = 'O') AS "open", count(*) FILTER (looped) * 2 > count(*) AS synth FROM z GROUP BY 1""",
    "slot_pads": VIEW + """, n AS (SELECT DISTINCT preset, note, CASE WHEN note < 40 THEN 'low' WHEN note >= 88 THEN 'high' ELSE 'mid' END AS kind FROM z),
        k AS (SELECT *, row_number() OVER (PARTITION BY preset, kind ORDER BY note) AS k FROM n),
        h AS (SELECT preset, note, CASE WHEN kind = 'low' AND k <= 8 THEN k + 7 WHEN kind = 'high' AND k <= 8 THEN k - 1 END AS pad FROM k),
        r AS (SELECT preset, note, row_number() OVER (PARTITION BY preset ORDER BY note) AS k FROM h WHERE pad IS NULL),
        a AS (SELECT DISTINCT preset, p AS pad FROM n, range(0, 16) t(p)),
        e AS (SELECT preset, pad, row_number() OVER (PARTITION BY preset ORDER BY pad) AS k FROM a ANTI JOIN (SELECT preset, pad FROM h WHERE pad IS NOT NULL) USING (preset, pad))
        SELECT preset, note, pad FROM h WHERE pad IS NOT NULL UNION ALL SELECT preset, note, pad FROM r JOIN e USING (preset, k)""",
    "hidden_base_takes": VIEW + f""", m AS (SELECT *, bool_or(rr > 1) OVER (PARTITION BY preset, note) AS numbered FROM z),
        k AS (SELECT preset, note, rr, file, row_number() OVER (PARTITION BY preset, note ORDER BY rr, {TIE}) AS take FROM m WHERE rr > 1 OR NOT numbered)
        SELECT preset, note, take, rr, file FROM k WHERE take <= 2""",
}
QUERIES = {k: f for k, f in list(globals().items()) if k in SQL}
