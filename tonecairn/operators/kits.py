"""Kits put together from a tree of single hits: what its folders say, flavours that make a kit, and a hit for each pad."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V

# Instruments that count as one family, and the tag of hits that fit any kit.
FAMILIES = {
    "hat_closed": "hat", "hat_open": "hat", "cymbal_crash": "cymbal", "cymbal_ride": "cymbal", "tom_low": "tom", "tom_mid": "tom", "tom_high": "tom",
    "conga_low": "conga", "conga_mid": "conga", "conga_high": "conga",
}
NEUTRAL = "VARIOUS"


def family(category: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in FAMILIES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, category), category)


def flavour_tag(folder: Column) -> Column:
    """A folder's name as a tag: no number before or after it, letters and digits only, in capitals."""
    bare = F.regexp_replace(F.regexp_replace(folder, r"^\d+\.\s*", ""), r"[\s_-]*\d+$", "")
    return F.upper(F.regexp_replace(bare, "[^A-Za-z0-9#]", ""))


def hit_tree(files: DataFrame) -> DataFrame:
    """``files`` (path: below the tree's root) with ``name``, ``category``, ``family`` and ``tags``.

    The first folder sorts hits by instrument. Of the folders below it those
    that name an instrument only split it further; the others are flavours, and
    a hit has the tags of all that it lies in. What a hit is, its own name says.
    Hits that lie in no folder, and those in hidden folders, are left out.
    """
    parts = F.split("path", "/")
    rows = files.withColumn("_folders", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).withColumn("name", F.element_at(parts, -1))
    rows = rows.where((F.size("_folders") > 0) & ~F.exists("_folders", lambda f: f.startswith(".")))
    flavours = F.filter(F.slice("_folders", 2, F.size("_folders")), lambda f: V.folder_category(f) == "other")
    rows = rows.withColumn("tags", F.array_sort(F.array_distinct(F.transform(flavours, flavour_tag)))).drop("_folders")
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    return rows.withColumn("category", V.drum_category(stem)).withColumn("family", family(F.col("category")))


def flavours(hits: DataFrame, least: int = 2) -> DataFrame:
    """(kit, families): tags that hits of at least so many families have; one that only kicks have makes no kit."""
    tags = hits.select("family", F.explode("tags").alias("kit")).groupBy("kit", "family").agg(F.lit(1).alias("one"))
    return tags.groupBy("kit").agg(F.count(F.lit(1)).alias("families")).where(F.col("families") >= least)


def _first(rows: DataFrame, *keys: str) -> DataFrame:
    """Of each group the hit with the smallest name, then path."""
    return rows.groupBy(*keys).agg(F.min(F.struct("name", "path")).alias("hit"))


def assembled(hits: DataFrame, kits: DataFrame) -> DataFrame:
    """(kit, category, rank, path, tier): a hit for every instrument of the tree: one of the kit's flavour (1), else one that fits any kit (2), else any (3).

    The instruments are a short fixed list, so a kit is joined with what each has to offer and never with hits.
    """
    tagged = hits.select("category", "name", "path", F.explode("tags").alias("kit"))
    own = _first(tagged, "kit", "category").withColumnRenamed("hit", "own")
    neutral = _first(tagged.where(F.col("kit") == NEUTRAL), "category").withColumnRenamed("hit", "neutral")
    any_ = _first(hits, "category").withColumnRenamed("hit", "any")
    offers = any_.join(neutral, "category", "left").groupBy().agg(F.collect_list(F.struct("category", "neutral", "any")).alias("offers"))
    pads = kits.select("kit").withColumn("_all", F.lit(1)).join(F.broadcast(offers.withColumn("_all", F.lit(1))), "_all").select("kit", F.inline("offers"))
    found = pads.join(own, ["kit", "category"], "left")
    tier = F.when(F.col("own").isNotNull(), 1).when(F.col("neutral").isNotNull(), 2).otherwise(3)
    return found.select("kit", "category", V.kit_rank(F.col("category")).cast("long").alias("rank"), F.coalesce("own", "neutral", "any")["path"].alias("path"), tier.alias("tier"))


def kit_plans(kits: DataFrame) -> DataFrame:
    """(kit, files, fallbacks) of ``assembled``: paths in the order of pads, and the instruments that the flavour itself has not."""
    w = Window.partitionBy("kit")
    rows = kits.withColumn("fallbacks", F.array_sort(F.collect_list(F.when(F.col("tier") > 1, F.col("category"))).over(w)))
    pads = F.array_sort(F.collect_list(F.struct("rank", "category", "path")))
    return rows.groupBy("kit", "fallbacks").agg(F.transform(pads, lambda p: p["path"]).alias("files"))
