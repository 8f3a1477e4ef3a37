"""Queries over ``part`` as hits: adjective and noun of the name are flavour and category, the type is the family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import signal as S
from ..operators import tables as T
from ..sources.tables import read

VIEW = "WITH h AS (SELECT p_partkey AS id, p_name AS stem, split_part(p_name, ' ', 1) AS flavour, split_part(p_name, ' ', 2) AS category, p_type AS family, CAST(p_size AS BIGINT) AS size, p_brand AS brand, p_retailprice AS price FROM part)"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("stem"), words[0].alias("flavour"), words[1].alias("category"), F.col("p_type").alias("family"),
        F.col("p_size").cast("long").alias("size"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"),
    )


def round_robin_limit(spark, sf_dir):
    """One hit of each category in turn, up to 16 for a brand."""
    h = hits(spark, sf_dir)
    h = h.withColumn("turn", F.row_number().over(Window.partitionBy("brand", "category").orderBy("size", "id")))
    h = h.withColumn("slot", F.row_number().over(Window.partitionBy("brand").orderBy("turn", "category", "id")).cast("long"))
    return h.where("slot <= 16").select("brand", "slot", "category", "id")


def output_collision(spark, sf_dir):
    """Paths that more than one hit claims."""
    path = F.concat_ws("/", F.lower("brand"), L.sanitised(F.col("stem")))
    g = hits(spark, sf_dir).groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("claims"), F.min("id").alias("first"))
    return g.where("claims > 1")


def unique_names(spark, sf_dir):
    """File names made unique within a brand by a counter from the second on, in the order of ids."""
    w = Window.partitionBy("brand", "stem").orderBy("id")
    h = hits(spark, sf_dir).withColumn("k", F.row_number().over(w))
    return h.select("id", F.concat(L.sanitised(F.col("stem")), F.when(F.col("k") > 1, F.concat(F.lit("_"), F.col("k").cast("string"))).otherwise("")).alias("name"))


def nearest_targets(spark, sf_dir):
    """For ten target sizes the nearest hit of each brand; a hit is taken once, by its smallest target."""
    targets = spark.range(1, 51, 5).select(F.col("id").alias("target"))
    sizes = hits(spark, sf_dir).groupBy("brand", "size").agg(F.min("id").alias("id"))
    w = Window.partitionBy("brand", "target").orderBy(F.abs(F.col("size") - F.col("target")), "size")
    near = sizes.join(F.broadcast(targets)).withColumn("k", F.row_number().over(w)).where("k = 1")
    return T_first(near, ["brand", "id"], "target").select("brand", "target", "size", "id")


def T_first(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def exclusive_claim(spark, sf_dir):
    """Hits that are the only one of their brand, name and size."""
    h = hits(spark, sf_dir).withColumn("place", F.concat_ws("/", "brand", "stem", "size"))
    return T.exclusive(h, "place").select("place", "id")


def flavour_discovery(spark, sf_dir):
    """Flavours that at least two families have."""
    g = hits(spark, sf_dir).groupBy("flavour").agg(F.count_distinct("family").alias("families"), F.count(F.lit(1)).alias("hits"))
    return g.where("families >= 2")


def kit_assemble(spark, sf_dir):
    """For each flavour and category a hit: one with the flavour, else one of a neutral flavour, else any; then by name."""
    h = hits(spark, sf_dir)
    flavours = h.select(F.col("flavour").alias("kit")).distinct()
    neutral = h.agg(F.min("flavour").alias("n"))
    # one best candidate per category and tier is enough, so nothing is joined with all hits
    by_flavour = T_first(h, ["category", "flavour"], "stem", "id").select("category", "flavour", "id")
    any_ = T_first(h, ["category"], "stem", "id").select("category", F.col("id").alias("any_id"))
    neutral_ = by_flavour.join(F.broadcast(neutral), by_flavour["flavour"] == neutral["n"]).select("category", F.col("id").alias("neutral_id"))
    kits = flavours.crossJoin(any_).join(neutral_, "category", "left")
    own = by_flavour.select("category", F.col("flavour").alias("kit"), F.col("id").alias("own_id"))
    return kits.join(own, ["category", "kit"], "left").select(
        "kit", "category", F.coalesce("own_id", "neutral_id", "any_id").alias("id"),
        F.when(F.col("own_id").isNotNull(), 0).when(F.col("neutral_id").isNotNull(), 1).otherwise(2).cast("long").alias("tier"),
    )


_VOCABULARY = (("kick", ("ring", "bolt")), ("snare", ("plate",)), ("hat", ("gear", "widget")))


def token_category(spark, sf_dir):
    """The first category of an ordered vocabulary whose words a name has, and its place in the kit."""
    h = hits(spark, sf_dir).withColumn("tokens", L.tokens(F.col("stem")))
    found, rank = F.lit("other"), F.lit(len(_VOCABULARY))
    for k, (name, words) in reversed(list(enumerate(_VOCABULARY))):
        hit = F.arrays_overlap("tokens", F.array(*(F.lit(w) for w in words)))
        found, rank = F.when(hit, name).otherwise(found), F.when(hit, k).otherwise(rank)
    h = h.select("id", "brand", "stem", found.alias("drum"), rank.alias("rank"))
    return h.select("id", "drum", (F.row_number().over(Window.partitionBy("brand").orderBy("rank", "stem", "id")) - 1).cast("long").alias("place"))


def fold_singletons(spark, sf_dir):
    """Within brand and size, categories of one hit go to the largest category, where two have more than one."""
    n = hits(spark, sf_dir).groupBy("brand", "size", "category").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("brand", "size")
    n = n.withColumns({"many": F.count_if(F.col("n") > 1).over(w), "main": F.first("category").over(w.orderBy(F.desc("n"), "category"))})
    to = F.when((F.col("many") >= 2) & (F.col("n") == 1), F.col("main")).otherwise(F.col("category"))
    return n.groupBy("brand", "size", to.alias("category")).agg(F.sum("n").alias("n"))


def _stems(spark, sf_dir) -> DataFrame:
    letter = F.element_at(F.array(*(F.lit(x) for x in ("C#", "Db", "A", "Bb", "F", "Cb"))), (F.col("size") % 6 + 1).cast("int"))
    letter = F.when(F.col("id") % 5 == 0, F.lower(letter)).otherwise(letter)
    octave = (F.col("id") % 13 - 1).cast("string")
    end, kind = F.concat(F.col("flavour"), F.lit("_"), letter, octave), F.col("id") % 4
    shapes = F.when(kind == 0, F.concat(end, F.lit("_0002"))).when(kind == 1, end).when(kind == 2, F.concat(letter, octave, F.lit(" "), F.col("flavour"))).otherwise(F.concat(end, F.lit("-93E2")))
    return hits(spark, sf_dir).select("id", shapes.alias("stem"))


def note_parse(spark, sf_dir):
    p = _stems(spark, sf_dir).withColumn("p", L.parsed_note(F.col("stem")))
    return p.select("id", "stem", F.col("p.note").alias("note"), F.col("p.take").alias("take"))


def note_name(spark, sf_dir):
    return hits(spark, sf_dir).select("id", L.note_name(F.col("id") % 128).alias("name"), L.note_of(F.lit("A"), F.col("id") % 12).alias("a_of_octave"))


def rule_violations(spark, sf_dir):
    """Rules that a rate, depth and channel count break, and the rate that fits."""
    h = hits(spark, sf_dir).select("id", (F.col("size") * 4000).alias("rate"), (F.col("id") % 4 * 8 + 8).alias("bits"), (F.col("size") % 3 + 1).alias("channels"))
    broken = F.array_compact(F.array(F.when(F.col("rate") > 96000, F.lit("rate")), F.when(F.col("rate") < 5000, F.lit("slow")), F.when(~F.col("bits").isin(16, 24, 32), F.lit("bits")), F.when(F.col("channels") > 2, F.lit("channels"))))
    return h.select("id", F.array_join(broken, ",").alias("broken"), F.round(S.fitted_rate(F.col("rate")), 6).alias("rate"))


def longest_entry(spark, sf_dir):
    """Of renders with one key the longest is kept, ties to the first; all others are served a prefix of it."""
    return T_first(hits(spark, sf_dir), ["brand", "category"], F.desc("size"), "id").select("brand", "category", "size", "id")


def folder_profile(spark, sf_dir):
    """Categories of a brand's sizes; a folder of one category is a single one."""
    g = hits(spark, sf_dir).groupBy("brand", "size").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.count_distinct("category").alias("kinds"))
    return g.select("brand", "size", "categories", (F.col("kinds") == 1).alias("single"))


def bounded_probe(spark, sf_dir):
    """At most 3 hits of each size and 48 of a brand are looked at to see whether it has large ones."""
    h = hits(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("brand", "size").orderBy("id"))).where("k <= 3")
    h = h.withColumn("m", F.row_number().over(Window.partitionBy("brand").orderBy("size", "id"))).where("m <= 48")
    return h.groupBy("brand").agg(F.count(F.lit(1)).alias("probed"), F.bool_or(F.col("size") >= 40).alias("large"))


def name_ladder(spark, sf_dir):
    """Names within a brand that grow by a word for every member of a clash, until none is left or the words are."""
    from ..operators.naming import climb

    h = hits(spark, sf_dir)
    rungs = F.array("category", F.concat_ws(" ", "flavour", "category"), F.concat_ws(" ", "flavour", "category", F.col("size").cast("string")), F.concat_ws(" ", "flavour", "category", F.col("id").cast("string")))
    return climb(h.select("id", "brand", rungs.alias("rungs")), "brand")


_LETTERS = "['C#','Db','A','Bb','F','Cb']"
_PLACES = "map {'C': 0, 'C#': 1, 'D': 2, 'D#': 3, 'E': 4, 'F': 5, 'F#': 6, 'G': 7, 'G#': 8, 'A': 9, 'A#': 10, 'B': 11, 'Db': 1, 'Eb': 3, 'Gb': 6, 'Ab': 8, 'Bb': 10}"
_SAFE = "trim(regexp_replace(regexp_replace(stem, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_')"

# every round lifts all members of a clash by a rung; four rungs settle well within as many rounds as are written out
_ROUNDS = 12
_LADDER = VIEW + """, l AS (SELECT id, brand, [category, flavour || ' ' || category, flavour || ' ' || category || ' ' || size, flavour || ' ' || category || ' ' || id] AS rungs FROM h),
    r0 AS (SELECT *, 1 AS rung FROM l)""" + "".join(f", r{k + 1} AS (SELECT id, brand, rungs, rung + CASE WHEN rung < 4 AND count(*) OVER (PARTITION BY brand, rungs[rung]) > 1 THEN 1 ELSE 0 END AS rung FROM r{k})" for k in range(_ROUNDS))

SQL = {
    "name_ladder": _LADDER + f" SELECT id, brand, rungs[rung] AS name, CAST(rung - 1 AS BIGINT) AS rung FROM r{_ROUNDS}",
    "round_robin_limit": VIEW + """, t AS (SELECT *, row_number() OVER (PARTITION BY brand, category ORDER BY size, id) AS turn FROM h),
        s AS (SELECT brand, category, id, row_number() OVER (PARTITION BY brand ORDER BY turn, category, id) AS slot FROM t) SELECT brand, slot, category, id FROM s WHERE slot <= 16""",
    "output_collision": VIEW + f" SELECT lower(brand) || '/' || {_SAFE} AS path, count(*) AS claims, min(id) AS first FROM h GROUP BY 1 HAVING count(*) > 1",
    "unique_names": VIEW + f", k AS (SELECT *, row_number() OVER (PARTITION BY brand, stem ORDER BY id) AS k FROM h) SELECT id, {_SAFE} || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS name FROM k",
    "nearest_targets": VIEW + """, s AS (SELECT brand, size, min(id) AS id FROM h GROUP BY 1, 2),
        n AS (SELECT * FROM s, range(1, 51, 5) t(target) QUALIFY row_number() OVER (PARTITION BY brand, target ORDER BY abs(size - target), size) = 1)
        SELECT brand, target, size, id FROM n QUALIFY row_number() OVER (PARTITION BY brand, id ORDER BY target) = 1""",
    "exclusive_claim": VIEW + " SELECT brand || '/' || stem || '/' || size AS place, min(id) AS id FROM h GROUP BY 1 HAVING count(*) = 1",
    "flavour_discovery": VIEW + " SELECT flavour, count(DISTINCT family) AS families, count(*) AS hits FROM h GROUP BY 1 HAVING count(DISTINCT family) >= 2",
    "kit_assemble": VIEW + """, k AS (SELECT DISTINCT flavour AS kit FROM h), m AS (SELECT min(flavour) AS n FROM h),
        c AS (SELECT kit, category, id, stem, CASE WHEN flavour = kit THEN 0 WHEN flavour = n THEN 1 ELSE 2 END AS tier, CASE WHEN flavour = kit THEN 0 WHEN flavour = n THEN 1 ELSE 2 END AS t FROM k, h, m),
        b AS (SELECT *, min(t) OVER (PARTITION BY kit, category) AS bt FROM c)
        SELECT kit, category, id, bt AS tier FROM b WHERE t = bt OR bt = 2 QUALIFY row_number() OVER (PARTITION BY kit, category ORDER BY stem, id) = 1""",
    "token_category": VIEW + """, c AS (SELECT id, brand, stem, CASE WHEN regexp_matches(stem, '\\b(ring|bolt)\\b') THEN 0 WHEN regexp_matches(stem, '\\bplate\\b') THEN 1 WHEN regexp_matches(stem, '\\b(gear|widget)\\b') THEN 2 ELSE 3 END AS rank FROM h)
        SELECT id, ['kick', 'snare', 'hat', 'other'][rank + 1] AS drum, row_number() OVER (PARTITION BY brand ORDER BY rank, stem, id) - 1 AS place FROM c""",
    "fold_singletons": VIEW + """, n AS (SELECT brand, size, category, count(*) AS n FROM h GROUP BY 1, 2, 3),
        m AS (SELECT *, count(*) FILTER (n > 1) OVER (PARTITION BY brand, size) AS many, first_value(category) OVER (PARTITION BY brand, size ORDER BY n DESC, category) AS main FROM n)
        SELECT brand, size, CASE WHEN many >= 2 AND n = 1 THEN main ELSE category END AS category, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY 1, 2, 3""",
    "note_parse": VIEW + f""", t AS (SELECT id, flavour, {_LETTERS}[size % 6 + 1] AS letter, id % 13 - 1 AS octave FROM h),
        w AS (SELECT *, CASE WHEN id % 5 = 0 THEN lower(letter) ELSE letter END || octave AS shown FROM t),
        s AS (SELECT id, letter, octave, CASE id % 4 WHEN 0 THEN flavour || '_' || shown || '_0002' WHEN 1 THEN flavour || '_' || shown WHEN 2 THEN shown || ' ' || flavour ELSE flavour || '_' || shown || '-93E2' END AS stem FROM w),
        n AS (SELECT id, stem, (octave + 1) * 12 + {_PLACES}[letter] AS note FROM s)
        SELECT id, stem, CASE WHEN note BETWEEN 0 AND 127 THEN note END AS note, CASE WHEN note BETWEEN 0 AND 127 THEN CASE WHEN id % 4 = 0 THEN 2 ELSE 1 END END AS take FROM n""",
    "note_name": VIEW + """ SELECT id, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][id % 128 % 12 + 1] || (id % 128 // 12 - 1) AS name,
        CASE WHEN (id % 12 + 1) * 12 + 9 BETWEEN 0 AND 127 THEN (id % 12 + 1) * 12 + 9 END AS a_of_octave FROM h""",
    "rule_violations": VIEW + """, r AS (SELECT id, size * 4000 AS rate, id % 4 * 8 + 8 AS bits, size % 3 + 1 AS channels FROM h)
        SELECT id, array_to_string(list_filter([CASE WHEN rate > 96000 THEN 'rate' END, CASE WHEN rate < 5000 THEN 'slow' END, CASE WHEN bits NOT IN (16, 24, 32) THEN 'bits' END, CASE WHEN channels > 2 THEN 'channels' END], lambda x: x IS NOT NULL), ',') AS broken,
               CASE WHEN rate > 96000 THEN CASE WHEN rate / 2.0 > 96000 THEN rate / 4.0 ELSE rate / 2.0 END WHEN rate < 5000 THEN rate * 2.0 ELSE rate::DOUBLE END AS rate FROM r""",
    "longest_entry": VIEW + " SELECT brand, category, size, id FROM h QUALIFY row_number() OVER (PARTITION BY brand, category ORDER BY size DESC, id) = 1",
    "folder_profile": VIEW + " SELECT brand, size, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, count(DISTINCT category) = 1 AS single FROM h GROUP BY 1, 2",
    "bounded_probe": VIEW + """, k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY brand, size ORDER BY id) <= 3), m AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY brand ORDER BY size, id) <= 48)
        SELECT brand, count(*) AS probed, bool_or(size >= 40) AS large FROM m GROUP BY 1""",
}
QUERIES = {k: f for k, f in list(globals().items()) if k in SQL}
