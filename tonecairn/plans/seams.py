"""Queries over ``events`` as signals: where loops of whole periods end, and how the timbre steps at a seam."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import frames as O
from ..operators import loops, stretches
from .signals import VIEW, frames

# frames of the window, the shortest and longest period and the longest loop of these short signals
WIDTH, LEAST, MOST, TARGET = 4, 6, 16, 40
STEP, VOTES = 16.0, 3  # a set whose median step is above this, by at least so many signals, can't be looped


def _signals(spark, sf_dir) -> DataFrame:
    return frames(spark, sf_dir).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda t: t["x"]).alias("xs"))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Arrow batches with the signals of their rows, as views of one array."""
    for batch in batches:
        lists = batch.column("xs")
        values, at = lists.flatten().to_numpy(), np.append(0, np.cumsum(pa.compute.list_value_length(lists).to_numpy()))
        yield batch, [values[a:b] for a, b in zip(at, at[1:])]


def moving_energy(spark, sf_dir):
    """The sum of squares of every eight frames, as the difference of two running sums; a signal may be of any length."""
    f = stretches.running(frames(spark, sf_dir).select("sample_id", "i", "x"), "sample_id", sums={"total": O.exact_square(F.col("x"))})
    both = stretches.sliding(f, "sample_id", 8, 0, lambda w: {"before": F.first("total").over(w)})
    energy = F.col("total") - F.when(F.col("i") >= 8, F.col("before")).otherwise(0)
    return both.where("i >= 7").select("sample_id", "i", energy.cast("double").alias("energy"))


def mismatch_curve(spark, sf_dir):
    """For every signal and every end behind its first quarter: how unlike the frames before the end are to those before the quarter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, signals in _each(batches):
            curves = [loops.mismatch_curve(x, len(x) // 4, WIDTH, len(x) // 4 + 1, len(x)) for x in signals]
            rows = [(i, len(x) // 4 + 1 + k, m) for i, x, c in zip(batch.column("sample_id").to_pylist(), signals, curves) if c is not None for k, m in enumerate(c.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["sample_id", "stop", "mismatch"])

    made = _signals(spark, sf_dir).select("sample_id", "xs").mapInArrow(run, "sample_id long, stop long, mismatch double")
    return made.withColumn("mismatch", F.round("mismatch", 6))


def aligned_loop(spark, sf_dir):
    """The loop of whole periods from the first quarter of every signal that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, signals in _each(batches):
            found = [loops.whole_periods(x, len(x) // 4, WIDTH, LEAST, MOST, TARGET, len(x)) for x in signals]
            rows = [(i, len(x) // 4, *f) for i, x, f in zip(batch.column("sample_id").to_pylist(), signals, found) if f]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["sample_id", "start", "stop", "mismatch"])

    made = _signals(spark, sf_dir).select("sample_id", "xs").mapInArrow(run, "sample_id long, start long, stop long, mismatch double")
    return made.withColumn("mismatch", F.round("mismatch", 6))


def unloopable_sets(spark, sf_dir):
    """How far the cepstrum steps at the wrap of each signal's middle half, and whether the median step of a set of signals is too large, by enough votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, signals in _each(batches):
            steps = [loops.timbre_step(x, len(x) // 4, 3 * len(x) // 4, 12, 8000) for x in signals]
            yield pa.RecordBatch.from_arrays([batch.column("sample_id"), pa.array(steps, pa.float64())], names=["sample_id", "step"])

    steps = _signals(spark, sf_dir).mapInArrow(run, "sample_id long, step double")
    of_set = steps.groupBy((F.col("sample_id") % 7).alias("set_id")).agg(F.count("step").alias("votes"), F.median("step").alias("median"))
    return of_set.select("set_id", "votes", F.round("median", 6).alias("median_step"), ((F.col("votes") >= VOTES) & (F.col("median") > STEP)).alias("unloopable"))


_CURVE = VIEW + f""", n AS (SELECT sample_id, count(*) AS n, count(*) // 4 AS start FROM f GROUP BY 1),
    a AS (SELECT f.sample_id, f.i - start + {WIDTH} AS k, x FROM f JOIN n USING (sample_id) WHERE f.i >= start - {WIDTH} AND f.i < start),
    z AS (SELECT sample_id, sum(x * x) AS size FROM a GROUP BY 1),
    c AS (SELECT a.sample_id, f.i - a.k + {WIDTH} AS stop, sqrt(sum((f.x - a.x) * (f.x - a.x)) / any_value(size)) AS mismatch
          FROM a JOIN f ON f.sample_id = a.sample_id JOIN n ON n.sample_id = a.sample_id JOIN z ON z.sample_id = a.sample_id
          WHERE f.i - a.k + {WIDTH} > start AND f.i - a.k + {WIDTH} <= n GROUP BY 1, 2 HAVING count(*) = {WIDTH})"""
SQL = {
    "moving_energy": VIEW
    + """, e AS (SELECT sample_id, i, sum(CAST(x AS DECIMAL(12,2)) * CAST(x AS DECIMAL(12,2))) OVER (PARTITION BY sample_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS e FROM f)
        SELECT sample_id, i, CAST(e AS DOUBLE) AS energy FROM e WHERE i >= 7""",
    "mismatch_curve": _CURVE + " SELECT sample_id, stop, round(mismatch, 6) AS mismatch FROM c",
    "aligned_loop": _CURVE
    + f""", p AS (SELECT sample_id, n, start, arg_min(stop, (mismatch, stop)) AS first, min(mismatch) AS mm FROM c JOIN n USING (sample_id)
          WHERE stop BETWEEN start + {LEAST} AND start + least({MOST}, n - {WIDTH} - start) AND least({MOST}, n - {WIDTH} - start) > {LEAST} GROUP BY 1, 2, 3),
        t AS (SELECT sample_id, k, arg_min(stop, (mismatch, stop)) AS stop, min(mismatch) AS mismatch
              FROM p JOIN c USING (sample_id), range(2, 6) t(k)
              WHERE k * (first - start) <= {TARGET} AND start + k * (first - start) + greatest({WIDTH}, (first - start) // 8) <= n
                AND abs(stop - start - k * (first - start)) <= greatest({WIDTH}, (first - start) // 8) GROUP BY 1, 2),
        u AS (SELECT p.*, t.k, t.stop, t.mismatch FROM p LEFT JOIN t ON t.sample_id = p.sample_id AND t.mismatch <= greatest(1.5 * mm, mm + 0.05) AND t.stop < n - {WIDTH})
        SELECT sample_id, start, coalesce(stop, first) AS stop, round(coalesce(mismatch, mm), 6) AS mismatch FROM u
        QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY k DESC NULLS LAST) = 1""",
}
QUERIES = {k: f for k, f in list(globals().items()) if k in SQL or k == "unloopable_sets"}
