"""Scans along one very long key: numbering, running values, sliding windows and longest runs, a stretch at a time.

A window over a key puts the whole key into one task. Here a key is cut into
stretches of ``size`` rows: a stretch is a task's group, and what it needs from
others is one row each: a count, a sum, the last value that is there, or the runs
that touch its ends. Only those rows are put in order per key; of n rows
there are n / size. Sliding windows get the rows before and after a stretch that
they reach, as copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut

SIZE = 1 << 16


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "i", size_hint: list[Column] | None = None) -> DataFrame:
    """``rows`` with their place from 0 among the rows of their keys, in ascending ``order``, nulls first; as a written table.

    Rows are sorted in ranges, which cut a key wherever it is long; a count for
    each key and range makes the places. ``size_hint`` replaces ``order`` in
    the choice of ranges where the columns of the order are too wide for that:
    it must not tell apart what the order puts the other way round.
    """
    by = [F.col(k) for k in keys] + (size_hint if size_hint is not None else [F.col(c) for c in order])
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(width, *by).sortWithinPartitions(*keys, *order)
    placed = cut(dealt.withColumn("_row", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_row", 33))
    pieces = placed.groupBy(*keys, "_range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = pieces.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_piece"), (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = F.col("_range") == F.col("_piece")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return placed.join(shift, same).withColumn(name, F.col("_row") + F.col("_shift")).select(*rows.columns, name)


def _stretch(size: int, i: str = "i") -> Column:
    return F.floor(F.col(i) / size).cast("long")


def _carried(rows: DataFrame, key: str, summary: list[Column], over: Callable[[Window], list[Column]], size: int) -> DataFrame:
    """(``_key``, ``_stretch``, carried columns): what the stretches before each stretch of a key amount to."""
    of = rows.groupBy(F.col(key).alias("_key"), _stretch(size).alias("_stretch")).agg(*summary)
    return of.select("_key", "_stretch", *over(Window.partitionBy("_key").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)))


def running(rows: DataFrame, key: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, size: int = SIZE) -> DataFrame:
    """``rows`` (key, i, ...) with running sums, and with the last values that aren't null, up to and including each row.

    Sums of decimals and whole numbers are exact; sums of doubles are added up by stretches.
    """
    sums, lasts = sums or {}, lasts or {}
    marked = rows.withColumn("_at", _stretch(size)).withColumns({f"_{n}": e for n, e in (sums | lasts).items()})
    summary = [F.sum(f"_{n}").alias(f"_s_{n}") for n in sums] + [F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.col("i"))).alias(f"_s_{n}") for n in lasts]
    carried = _carried(marked, key, summary, lambda w: [F.sum(f"_s_{n}").over(w).alias(f"_b_{n}") for n in sums] + [F.last(f"_s_{n}", ignorenulls=True).over(w).alias(f"_b_{n}") for n in lasts], size)
    inside = Window.partitionBy(key, "_at").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = marked.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_at") == F.col("_stretch")), "left")
    out = {n: F.sum(f"_{n}").over(inside) + F.coalesce(F.col(f"_b_{n}"), F.lit(0)) for n in sums} | {n: F.coalesce(F.last(f"_{n}", ignorenulls=True).over(inside), F.col(f"_b_{n}")) for n in lasts}
    return joined.withColumns(out).select(*rows.columns, *out)


def sliding(rows: DataFrame, key: str, before: int, after: int, values: Callable[[Window], dict[str, Column]], size: int = SIZE) -> DataFrame:
    """``rows`` (key, i, ...) with ``values`` over the rows from ``before`` ahead of each to ``after`` behind it."""
    near = F.sequence(F.floor(F.greatest(F.col("i") - after, F.lit(0)) / size).cast("long"), F.floor((F.col("i") + before) / size).cast("long"))
    copies = rows.withColumn("_at", F.explode(near))
    w = Window.partitionBy(key, "_at").orderBy("i").rowsBetween(-before, after)
    made = values(w)
    return copies.withColumns(made).where(F.col("_at") == _stretch(size)).select(*rows.columns, *made)


def longest_run(rows: DataFrame, key: str, flag: Column, size: int = SIZE) -> DataFrame:
    """(key, start, length) of the longest run of rows with ``flag``, the first of equally long ones; keys without one are left out.

    A stretch gives its runs; those that touch its ends are joined with what they meet, stretch by stretch.
    """
    true = rows.where(F.coalesce(flag, F.lit(False))).select(F.col(key).alias("_key"), "i", _stretch(size).alias("_at"))
    inside = Window.partitionBy("_key", "_at").orderBy("i")
    runs = true.withColumn("_run", F.col("i") - F.row_number().over(inside)).groupBy("_key", "_at", "_run").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop"))
    starts, ends = F.col("start") == F.col("_at") * size, F.col("stop") == (F.col("_at") + 1) * size
    edge = runs.where(starts | ends)
    order = Window.partitionBy("_key").orderBy("start")
    fresh = F.coalesce(F.col("start") != F.lag("stop").over(order), F.lit(True)).cast("int")
    joined = edge.withColumn("_fresh", fresh).withColumn("_chain", F.sum("_fresh").over(order)).groupBy("_key", "_chain").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    all_ = runs.where(~(starts | ends)).select("_key", "start", "stop").union(joined.select("_key", "start", "stop"))
    best = all_.groupBy("_key").agg(F.min(F.struct((F.col("start") - F.col("stop")).alias("less"), "start")).alias("b"))
    return best.select(F.col("_key").alias(key), F.col("b.start").alias("start"), (-F.col("b.less")).alias("length"))
