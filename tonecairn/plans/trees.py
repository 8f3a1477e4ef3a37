"""Queries over ``part`` as a tree of single hits: folders by instrument and flavour, and the kits that they make."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kits
from ..sources.tables import read
from .names import _HITS, _pick

# folders of instruments, those that split them further, and what flavours are called
_TOPS, _SPLITS = ("Kick", "01. Snare", "Hi Hat", "Toms", "Cymbal", "Percussion"), ("CH", "OH")


def tree(spark, sf_dir):
    """(id, path): each part as a file of the tree."""
    p = read(spark, sf_dir, "part")
    i = F.col("p_partkey")
    flavour = F.when(i % 7 == 0, F.lit(None)).when(i % 5 == 0, "Various").when(i % 3 == 0, F.concat(F.lit("02. "), F.initcap("p_type"))).otherwise(F.concat(F.initcap("p_type"), F.lit(" "), F.lpad((i % 4 + 1).cast("string"), 2, "0")))
    split = F.when(i % 6 == 2, _pick(_SPLITS, F.floor(i / 6)))
    name = F.concat(_pick([n for n, _ in _HITS], i), F.lit(" "), "p_name", F.lit(".wav"))
    return p.select(i.alias("id"), F.concat_ws("/", _pick(_TOPS, i), split, flavour, "p_brand", name).alias("path"))


def hit_tree(spark, sf_dir):
    """What the tree says of every hit: its instrument, the instrument's family and its flavours."""
    hits = kits.hit_tree(tree(spark, sf_dir))
    return hits.select("id", "path", "category", "family", F.array_join("tags", ",").alias("tags"))


def tree_flavours(spark, sf_dir):
    """Flavours that hits of at least two families have."""
    return kits.flavours(kits.hit_tree(tree(spark, sf_dir)))


def tree_kits(spark, sf_dir):
    """For each flavour and instrument a hit, and how far it had to be looked for."""
    hits = kits.hit_tree(tree(spark, sf_dir))
    return kits.assembled(hits, kits.flavours(hits)).select("kit", "category", "path", "tier")


_FAMILY = "coalesce(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in kits.FAMILIES.items()) + "}[category], category)"
_TREE = f"""WITH p AS (
        SELECT p_partkey AS id, {list(_TOPS)}[p_partkey % {len(_TOPS)} + 1] AS top, CASE WHEN p_partkey % 6 = 2 THEN {list(_SPLITS)}[p_partkey // 6 % 2 + 1] END AS split,
               CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'Various' ELSE p_type[1] || lower(p_type[2:]) END AS flavour, p_type, p_brand,
               {[n for n, _ in _HITS]}[p_partkey % {len(_HITS)} + 1] || ' ' || p_name || '.wav' AS name, {[c for _, c in _HITS]}[p_partkey % {len(_HITS)} + 1] AS category
        FROM part
    ), h AS (
        SELECT id, name, category, {_FAMILY} AS family, list_sort(list_filter([upper(flavour), regexp_replace(upper(p_brand), '[0-9]+$', '')], lambda t: t IS NOT NULL)) AS tags,
               concat_ws('/', top, split, CASE WHEN flavour IS NULL OR flavour = 'Various' THEN flavour WHEN id % 3 = 0 THEN '02. ' || flavour ELSE flavour || ' 0' || (id % 4 + 1) END, p_brand, name) AS path
        FROM p
    )"""
_KITS = _TREE + ", k AS (SELECT kit, count(DISTINCT family) AS families FROM (SELECT family, unnest(tags) AS kit FROM h) GROUP BY 1 HAVING count(DISTINCT family) >= 2)"
SQL = {
    "hit_tree": _TREE + " SELECT id, path, category, family, array_to_string(tags, ',') AS tags FROM h",
    "tree_flavours": _KITS + " SELECT kit, families FROM k",
    "tree_kits": _KITS
    + f""", t AS (SELECT kit, category, path, name, CASE WHEN list_contains(tags, kit) THEN 1 WHEN list_contains(tags, '{kits.NEUTRAL}') THEN 2 ELSE 3 END AS tier FROM h, k)
        SELECT kit, category, path, tier FROM t QUALIFY row_number() OVER (PARTITION BY kit, category ORDER BY tier, name, path) = 1""",
}
QUERIES = {k: f for k, f in list(globals().items()) if k in SQL}
