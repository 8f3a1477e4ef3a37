"""Operators over signals in exploded form: one row per frame, ``sample_id``, ``i`` and a value.

All of them window or group by ``sample_id``, so a table of frames that is
partitioned by it is shuffled once for any chain of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order() -> Window:
    return Window.partitionBy("sample_id").orderBy("i")


def exact_square(x: Column) -> Column:
    """The square of a value of two decimals, as a decimal: sums of it don't depend on their order."""
    d = x.cast("decimal(12,2)")
    return d * d


def root_mean(total: Column, count: Column) -> Column:
    return F.sqrt(total.cast("double") / count)


def with_length(frames: DataFrame) -> DataFrame:
    return frames.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("sample_id")))


def hop_levels(frames: DataFrame, hop: int, keep_tail: bool) -> DataFrame:
    """RMS and peak of every ``hop`` frames; the last, shorter one is kept or dropped."""
    hops = frames.withColumn("hop", F.floor(F.col("i") / hop).cast("long")).groupBy("sample_id", "hop")
    out = hops.agg(
        root_mean(F.sum(exact_square(F.col("x"))), F.count(F.lit(1))).alias("rms"),
        F.max(F.abs("x")).alias("peak"),
        F.count(F.lit(1)).alias("frames"),
    )
    return out if keep_tail else out.where(F.col("frames") == hop)


def centred_rms(frames: DataFrame, width: int, hop: int) -> DataFrame:
    """RMS of ``width`` frames around every ``hop``-th; missing ones at the ends are zeros that count."""
    around = in_order().rowsBetween(-width // 2, width // 2 - 1)
    return (
        frames.withColumn("rms", F.sqrt(F.sum(exact_square(F.col("x"))).over(around).cast("double") / width))
        .where(F.col("i") % hop == 0)
        .select("sample_id", (F.col("i") / hop).cast("long").alias("hop"), "rms")
    )


def trim_bounds(frames: DataFrame, block: int, drop_db: float = -60.0) -> DataFrame:
    """First and past-the-end frame of what is loud; trailing blocks are counted from the end. Silence: the whole."""
    share = 10.0 ** (drop_db / 20.0)
    whole = Window.partitionBy("sample_id")
    marked = frames.withColumns({"n": F.count(F.lit(1)).over(whole), "limit": F.max(F.abs("x")).over(whole) * share})
    loud = (F.abs(F.col("x")) >= F.col("limit")) & (F.col("limit") > 0)
    lead = F.floor(F.col("i") / block) * block
    trail = F.col("n") - F.floor((F.col("n") - 1 - F.col("i")) / block) * block
    return marked.groupBy("sample_id").agg(
        F.coalesce(F.min(F.when(loud, lead)), F.lit(0)).cast("long").alias("lead"),
        F.coalesce(F.max(F.when(loud, trail)), F.max("n")).cast("long").alias("trail"),
    )


def sustain_bounds(hops: DataFrame, hold: float = 0.9, release: float = 0.4) -> DataFrame:
    """First peak hop, start of the run at ``hold`` of the peak that ends in it, first later hop below ``release``."""
    whole = Window.partitionBy("sample_id")
    first = F.min(F.when(F.col("rms") == F.col("top"), F.col("hop"))).over(whole)
    marked = hops.withColumns({"top": F.max("rms").over(whole), "hops": F.count(F.lit(1)).over(whole)}).withColumn("peak_hop", first)
    before = (F.col("hop") <= F.col("peak_hop")) & (F.col("rms") < hold * F.col("top"))
    after = (F.col("hop") > F.col("peak_hop")) & (F.col("rms") < release * F.col("top"))
    return marked.groupBy("sample_id").agg(
        F.first("peak_hop").alias("peak_hop"),
        (F.coalesce(F.max(F.when(before, F.col("hop"))), F.lit(-1)) + 1).alias("start_hop"),
        F.coalesce(F.min(F.when(after, F.col("hop"))), F.max("hops")).alias("end_hop"),
    )


def longest_run(rows: DataFrame, flag: Column, order: str) -> DataFrame:
    """The first of the longest runs of consecutive rows with ``flag``, as start and length; none where no row has it."""
    by = Window.partitionBy("sample_id").orderBy(order)
    islands = (
        rows.withColumn("_flag", flag)
        .withColumn("_island", F.sum(F.when(F.col("_flag"), 0).otherwise(1)).over(by))
        .where("_flag")
        .groupBy("sample_id", "_island")
        .agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("length"))
    )
    best = Window.partitionBy("sample_id").orderBy(F.desc("length"), "start")
    return islands.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").select("sample_id", "start", "length")


def sliding(rows: DataFrame, value: str, width: int, order: str = "i") -> DataFrame:
    """Mean and coefficient of variation of the ``width`` values from each row on; incomplete windows are left out."""
    ahead = Window.partitionBy("sample_id").orderBy(order).rowsBetween(0, width - 1)
    mean = F.avg(value).over(ahead)
    return rows.withColumns(
        {"mean": mean, "cv": F.try_divide(F.stddev_pop(value).over(ahead), mean), "_n": F.count(F.lit(1)).over(ahead)}
    ).where(F.col("_n") == width).drop("_n")


def local_maxima(rows: DataFrame, value: str, order: str) -> DataFrame:
    by = Window.partitionBy("sample_id").orderBy(order)
    return (
        rows.withColumns({"_before": F.lag(value).over(by), "_after": F.lead(value).over(by)})
        .where((F.col(value) > F.col("_before")) & (F.col(value) > F.col("_after")))
        .drop("_before", "_after")
    )


def top_one(rows: DataFrame, *order: Column | str) -> DataFrame:
    """One row for each signal, the first in a total order."""
    by = Window.partitionBy("sample_id").orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(by)).where("_rank = 1").drop("_rank")


def lag_products(frames: DataFrame, most: int) -> DataFrame:
    """Autocorrelation sums for lags 1 to ``most``, by window lags instead of a self-join."""
    lags = F.array(*(F.lag("x", k).over(in_order()) for k in range(1, most + 1)))
    return (
        frames.withColumn("_lags", lags)
        .select("sample_id", F.col("x").cast("decimal(12,2)").alias("x"), F.posexplode("_lags").alias("lag", "y"))
        .where("y is not null")
        .groupBy("sample_id", (F.col("lag") + 1).cast("long").alias("lag"))
        .agg(F.sum(F.col("x") * F.col("y").cast("decimal(12,2)")).cast("double").alias("product"), F.count(F.lit(1)).alias("pairs"))
    )


def keep_unless_empty(rows: DataFrame, predicate: Column) -> DataFrame:
    """Apply a predicate to each signal's rows, but only where at least one of them passes."""
    any_ = F.max(F.coalesce(predicate, F.lit(False))).over(Window.partitionBy("sample_id"))
    passes = rows.withColumns({"_passes": F.coalesce(predicate, F.lit(False)), "_any": any_})
    return passes.where("_passes or not _any").drop("_passes", "_any")
