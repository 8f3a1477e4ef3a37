"""Keyed operators on whole tables: upsert, re-key, sync, layered defaults, exclusive claims, longest suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Rows of ``delta`` replace those of ``base`` with the same key; all others stay."""
    return base.join(delta.select(key), key, "left_anti").unionByName(delta)


def rekey(base: DataFrame, moves: DataFrame, key: str) -> DataFrame:
    """All keys old to new at once, so swaps are safe; a moved row replaces one that stays at its target. ``moves``: (old, new)."""
    joined = base.join(moves, base[key] == moves["old"], "left")
    placed = joined.withColumns({"_moved": F.col("new").isNotNull(), key: F.coalesce("new", key)}).drop("old", "new")
    order = Window.partitionBy(key).orderBy(F.desc("_moved"))
    return placed.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "_moved")


def sync_counts(source: DataFrame, target: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """How many wanted keys the target lacks or has with another value, and how many the source lacks."""
    s, t = source.select(key, F.col(value).alias("_s")), target.select(key, F.col(value).alias("_t"))
    joined = wanted.select(key).distinct().join(s, key, "left").join(t, key, "left")
    return joined.agg(
        F.count_if(F.col("_s").isNotNull() & ~F.col("_s").eqNullSafe(F.col("_t"))).alias("updated"), F.count_if(F.col("_s").isNull()).alias("missing")
    )


def layered(base: DataFrame, over: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields of ``over`` where given, else those of ``base``."""
    o = over.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    return base.join(o, key, "left").withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*(f"_{f}" for f in fields))


def exclusive(rows: DataFrame, place: str) -> DataFrame:
    """Rows that are alone at their place."""
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(place))).where("_n = 1").drop("_n")


def suffixes(path: Column) -> Column:
    """All tails of a path, longest first, as (parts, tail)."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct((F.size(parts) - k + 1).alias("parts"), F.array_join(F.slice(parts, k, F.size(parts)), "/").alias("tail")))


def locate(wanted: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """For every path of ``wanted`` the file that shares its longest tail, ties to the smallest. Both: (key, path)."""
    w = wanted.select(key, F.explode(suffixes(F.lower("path"))).alias("s")).select(key, "s.*")
    f = files.select(F.col("path").alias("found"), F.explode(suffixes(F.lower("path"))).alias("s")).select("found", "s.tail")
    best = Window.partitionBy(key).orderBy(F.desc("parts"), "found")
    first = f.groupBy("tail").agg(F.min("found").alias("found"))
    return w.join(first, "tail").withColumn("_k", F.row_number().over(best)).where("_k = 1").select(key, "found", "parts")


def locate_other(files: DataFrame, key: str) -> DataFrame:
    """For every path the path of another key that shares its longest tail, ties to the smallest. (key, path); of a tail two candidates are enough, as one of them is another."""
    f = files.select(key, F.col("path").alias("found"), F.explode(suffixes(F.lower("path"))).alias("s")).select(key, "found", "s.*")
    of_key = f.groupBy("tail", F.col(key).alias("other")).agg(F.min("found").alias("found"))
    # the rank is bounded before the shuffle as well, so a common tail sends two rows from each task
    two = of_key.withColumn("_k", F.row_number().over(Window.partitionBy("tail").orderBy("found", "other"))).where("_k <= 2").select("tail", "other", "found")
    met = f.select(key, "parts", "tail").join(two, "tail").where(F.col(key) != F.col("other"))
    best = met.groupBy(key).agg(F.min(F.struct((-F.col("parts")).alias("parts"), "found")).alias("best"))
    return best.select(key, "best.found", (-F.col("best.parts")).alias("parts"))
