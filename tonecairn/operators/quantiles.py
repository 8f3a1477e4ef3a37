"""Exact quantiles of groups of any size, by histograms that are refined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut

BINS, SETTLED = 4096, 4096  # bins of a round, and values of a group that are sorted in one array


def quantiles(rows: DataFrame, keys: list[str], value: str, *shares: float) -> DataFrame:
    """``keys``, n, and for each share the exact quantile between neighbours (``quantile``, ``quantile_2``, ...) with the values at and above its place (``lower``, ``upper``, ...).

    The value at a place of a sorted group is found by counting: its range is
    cut into equal bins, and the bin that holds the place becomes the next
    range, until it has few values or one. A group is never gathered: a
    round counts values per group and bin, partial counts first. Null values
    are left out, groups without values too.
    """
    base = rows.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    base = cut(base)
    whole = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    places = []
    for k, share in enumerate(shares):
        at = (F.col("n") - 1) * F.lit(float(share))
        places += [F.struct(F.lit(2 * k).alias("what"), F.floor(at).cast("long").alias("place")), F.struct(F.lit(2 * k + 1).alias("what"), F.ceil(at).cast("long").alias("place"))]
    wanted = cut(whole.select(*keys, "n", "low", "high", F.explode(F.array(*places)).alias("w")).select(*keys, "n", "low", "high", "w.what", "w.place", F.col("n").alias("inside")))
    found: list[DataFrame] = []
    while True:
        settled = (F.col("inside") <= SETTLED) | (F.col("low") == F.col("high"))
        ranges = wanted.where(settled).select(*keys, "low", "high").distinct()
        ready = _values_of(base, ranges, keys).withColumnsRenamed({"low": "_low", "high": "_high"})
        same = _same(keys, "_k") & (F.col("low") == F.col("_low")) & (F.col("high") == F.col("_high"))
        one = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.element_at("sorted", (F.col("place") + 1).cast("int")))
        found.append(wanted.where(settled).join(ready, same, "left").select(*keys, "n", "what", one.alias("x")))
        open_ = wanted.where(~settled)
        if open_.isEmpty():
            break
        wanted = cut(_refined(base, open_, keys))
    flat = found[0]
    for more in found[1:]:
        flat = flat.union(more)
    pick = lambda k: F.max(F.when(F.col("what") == k, F.col("x")))
    out = flat.groupBy(*keys, "n").agg(*(pick(k).alias(f"_{k}") for k in range(2 * len(shares))))
    columns = []
    for k, share in enumerate(shares):
        part = (F.col("n") - 1) * F.lit(float(share)) - F.floor((F.col("n") - 1) * F.lit(float(share)))
        end = "" if k == 0 else f"_{k + 1}"
        low, high = F.col(f"_{2 * k}"), F.col(f"_{2 * k + 1}")
        columns += [(low + (high - low) * part).alias(f"quantile{end}"), low.alias(f"lower{end}"), high.alias(f"upper{end}")]
    return out.select(*keys, "n", *columns)


def _same(keys: list[str], mark: str):
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{mark}{k}"))
    return out


def _in_ranges(base: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Values with each range of their group that holds them; a group has few ranges."""
    named = ranges.withColumnsRenamed({k: f"_k{k}" for k in keys})
    return base.join(named, _same(keys, "_k")).where("_v >= low AND _v <= high")


def _values_of(base: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The sorted values of ranges that hold few; a range of one value needs none."""
    open_ = ranges.where("low < high")
    return _in_ranges(base, open_, keys).groupBy(*(f"_k{k}" for k in keys), "low", "high").agg(F.array_sort(F.collect_list("_v")).alias("sorted"))


def _refined(base: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Each place with the bin of its range that holds it."""
    ranges = wanted.select(*keys, "low", "high").distinct()
    step = (F.col("high") - F.col("low")) / BINS
    number = F.least(F.floor((F.col("_v") - F.col("low")) / step), F.lit(BINS - 1)).cast("long")
    counted = _in_ranges(base, ranges, keys).groupBy(*(f"_k{k}" for k in keys), "low", "high", number.alias("bin")).agg(
        F.count(F.lit(1)).alias("inside"), F.min("_v").alias("least"), F.max("_v").alias("most")
    )
    bins = counted.groupBy(*(f"_k{k}" for k in keys), "low", "high").agg(F.array_sort(F.collect_list(F.struct("bin", "inside", "least", "most"))).alias("bins"))  # at most BINS
    bins = bins.withColumnsRenamed({"low": "_low", "high": "_high"})
    same = _same(keys, "_k") & (F.col("low") == F.col("_low")) & (F.col("high") == F.col("_high"))
    start = F.struct(F.col("place").alias("left"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("inside"), F.lit(0.0).alias("least"), F.lit(0.0).alias("most"))

    def go(state, b):
        here = ~state["done"] & (state["left"] < b["inside"])
        left = F.when(state["done"] | here, state["left"]).otherwise(state["left"] - b["inside"])
        pick = lambda name: F.when(here, b[name]).otherwise(state[name]).alias(name)
        return F.struct(left.alias("left"), (state["done"] | here).alias("done"), pick("inside"), pick("least"), pick("most"))

    at = wanted.join(bins, same).withColumn("at", F.aggregate("bins", start, go))
    return at.select(*keys, "n", F.col("at.least").alias("low"), F.col("at.most").alias("high"), "what", F.col("at.left").alias("place"), F.col("at.inside").alias("inside"))
