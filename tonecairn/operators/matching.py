"""Greedy one-to-one matching of similar vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut
from .quantiles import quantiles


def greedy_match(vectors: np.ndarray, floor_share: float = 0.2) -> list[tuple[int, int, float]]:
    """Pairs (i < j) by ascending distance of z-scores, each row used once.

    Pairs nearer than the ``floor_share`` quantile of the rows' least distances
    are too alike to be partners and are passed over. Ties go to the smaller i, then j.
    """
    n = len(vectors)
    if n < 2:
        return []
    z = (vectors - vectors.mean(0)) / (vectors.std(0) + 1e-9)
    square = (z * z).sum(1)
    distance = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * z @ z.T, 0))
    np.fill_diagonal(distance, np.inf)
    floor = np.quantile(distance.min(1), floor_share)
    i, j = np.triu_indices(n, 1)
    order = np.lexsort((j, i, np.round(distance[i, j], 9)))
    used, out = np.zeros(n, bool), []
    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if not used[a] and not used[b] and distance[a, b] >= floor:
            used[a] = used[b] = True
            out.append((a, b, float(distance[a, b])))
    return out


_BLOCK = 1024  # vectors of a block, of which a label has up to ``_FEW``: a task compares two blocks
_FEW, _LARGE = 8, 16384  # more blocks than ``_FEW`` only where these would have more vectors than ``_LARGE``
_CELLS = 1 << 20  # distances of a task at a time


def blocks_of(n: Column, block: int) -> Column:
    """Blocks of a label with ``n`` vectors: every vector is sent once for each, so there are no more than keep all cores busy and a task small."""
    return F.least(F.ceil(n / block), F.greatest(F.lit(_FEW), F.ceil(n / _LARGE))).cast("int")


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (label, vec_id, z) once for each pair of blocks of its label that it is in; ``asks`` says whether its partners are sought."""
    blocks = rows.groupBy(F.col("label").alias("_l")).agg(blocks_of(F.count(F.lit(1)), _BLOCK).alias("blocks"))
    own = rows.join(blocks, F.col("label").eqNullSafe(F.col("_l"))).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("p"), F.greatest("own", o).alias("q")))
    return own.select("label", "vec_id", "z", "asks", "own", F.explode(pair).alias("at")).select("label", "vec_id", "z", "asks", "own", "at.p", "at.q")


def nearest_rows(z: np.ndarray, ids: np.ndarray, to: np.ndarray, to_ids: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the ``k`` nearest of ``to`` for each of ``z``, by (row, distance, id), none below ``floor``; and which rows have more.

    A matrix product finds those that may count, with room for its rounding; they are compared by their distances, to nine digits.
    """
    square, to_square = (z * z).sum(1), (to * to).sum(1)
    room = 1e-8 * (1 + square + to_square.max(initial=0))[:, None]
    rough = square[:, None] + to_square[None] - 2 * (z @ to.T)
    rough[ids[:, None] == to_ids[None]] = np.inf
    rough[np.isnan(rough)] = np.inf
    low = floor * floor if floor > 0 else -np.inf
    most = np.full((len(z), 1), np.inf)
    if len(to) > k:
        sure = np.where(rough > low + room, rough, np.inf) if floor > 0 else rough
        most = np.partition(sure, k - 1, axis=1)[:, k - 1 : k] + room
    row, column = np.nonzero((rough >= low - room) & (rough <= most) & (rough < np.inf))
    beyond = ((rough > most) & (rough < np.inf)).sum(1)
    distance = np.round(np.sqrt(((to[column] - z[row]) ** 2).sum(1)), 9)
    good = distance >= floor
    row, column, distance = row[good], column[good], distance[good]
    order = np.lexsort((to_ids[column], distance, row))
    row, column, distance = row[order], column[order], distance[order]
    counts = np.bincount(row, minlength=len(z))
    first = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) < k
    return row[first], column[first], distance[first], counts + beyond > k


def nearest_of(rows: DataFrame, floors: DataFrame | None, k: int) -> DataFrame:
    """(label, a, near, more): for every vector that asks the ``k`` nearest others of its label, as (distance, b); whether there are more.

    Vectors nearer than the label's ``floor`` don't count. Blocks meet in pairs, a task has two blocks whatever a label holds, and sends on
    at most ``k`` partners for each vector.
    """
    dealt = _dealt(rows)
    dealt = dealt.join(F.broadcast(floors), F.col("label").eqNullSafe(F.col("_l")), "left").drop("_l") if floors is not None else dealt.withColumn("floor", F.lit(0.0))

    def run(key, table):
        ids, own, asks = (table.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "own", "asks"))
        z = np.array(table.column("z").to_pylist(), np.float64).reshape(len(ids), -1)
        p, q, floor = key[1].as_py(), key[2].as_py(), table.column("floor")[0].as_py() or 0.0
        sides = [(own == p, own == q)] if p == q else [(own == p, own == q), (own == q, own == p)]
        found = []
        for left, right in sides:
            asking, to = np.flatnonzero(left & asks), np.flatnonzero(right)
            step = max(1, _CELLS // max(1, len(to)))
            for at in range(0, len(asking), step):
                some = asking[at : at + step]
                row, column, distance, more = nearest_rows(z[some], ids[some], z[to], ids[to], floor, k)
                ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(some)))).astype(np.int32)
                near = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([distance, ids[to[column]]], ["d", "b"]))
                label = pa.array([key[0].as_py()] * len(some), pa.int32())
                found.append(pa.table({"label": label, "a": ids[some], "near": near, "more": more}))
        kinds = {"label": pa.int32(), "a": pa.int64(), "near": pa.list_(pa.struct([("d", pa.float64()), ("b", pa.int64())])), "more": pa.bool_()}
        return pa.concat_tables(found) if found else pa.table({c: pa.array([], t) for c, t in kinds.items()})

    found = dealt.groupBy("label", "p", "q").applyInArrow(run, "label int, a long, near array<struct<d:double,b:long>>, more boolean")
    whole = found.groupBy("label", "a").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"), F.max("more").alias("more"))
    return whole.select("label", "a", F.slice("near", 1, k).alias("near"), (F.col("more") | (F.size("near") > k)).alias("more"))


def match_groups(rows: DataFrame, floor_share: float = 0.2, k: int = 16) -> DataFrame:
    """(label, a, b, distance) for rows (label, vec_id, z): pairs by ascending (distance, a, b), each vector used once.

    Pairs below the ``floor_share`` quantile of the label's least distances are
    passed over. A round pairs all vectors that are each other's nearest left:
    such a pair comes before all others of both in the order of distances, so
    rounds give what going through all pairs in that order would. A vector
    whose ``k`` known partners are all used asks anew among those that are left.
    Vectors are compared with all others of their label, which is quadratic in a
    label; no task holds more than two blocks of it, and rounds move pairs only.
    """
    rows = cut(rows.select(F.col("label").cast("int").alias("label"), F.col("vec_id").cast("long").alias("vec_id"), "z").where("vec_id IS NOT NULL"))
    nearest = cut(nearest_of(rows.withColumn("asks", F.lit(True)), None, k))
    least = nearest.select("label", F.get("near", F.lit(0))["d"].alias("d"))
    floors = cut(quantiles(least, ["label"], "d", floor_share).select(F.col("label").alias("_l"), F.col("quantile").alias("floor")))

    def again(lists: DataFrame) -> DataFrame:
        """``lists``, with new partners among the vectors that are left for those that have used all they knew."""
        if lists.where((F.size("near") == 0) & F.col("more")).isEmpty():
            return lists
        there = lists.select(F.col("label").alias("_l"), "a", (F.col("more") & (F.size("near") == 0)).alias("asks"))
        left = rows.join(there, F.col("label").eqNullSafe(F.col("_l")) & (F.col("vec_id") == F.col("a"))).select("label", "vec_id", "z", "asks")
        return cut(lists.where((F.size("near") > 0) | ~F.col("more")).unionByName(nearest_of(left, floors, k)))

    # the nearest without a floor are those with it, less those below; who has none of them left asks anew
    above = nearest.join(F.broadcast(floors), F.col("label").eqNullSafe(F.col("_l")), "left")
    lists = again(cut(above.select("label", "a", F.filter("near", lambda n: n["d"] >= F.coalesce("floor", F.lit(0.0))).alias("near"), "more")))
    done: DataFrame | None = None
    while True:
        best = lists.where(F.size("near") > 0).select("label", "a", F.get("near", F.lit(0))["d"].alias("d"), F.get("near", F.lit(0))["b"].alias("b"))
        back = best.select(F.col("label").alias("_l"), F.col("a").alias("b"), F.col("b").alias("a"))
        same = F.col("label").eqNullSafe(F.col("_l"))
        pairs = cut(best.where("a < b").join(back, ["a", "b"]).where(same).select("label", "a", "b", F.col("d").alias("distance")))
        if pairs.isEmpty():
            break
        done = pairs if done is None else done.union(pairs)
        used = pairs.select("label", "a").union(pairs.select("label", "b")).select(F.col("label").alias("_l"), F.col("a").alias("_u"))
        left = lists.join(used, same & (F.col("a") == F.col("_u")), "left_anti")
        # partners that are used leave the lists: a row for each that stays, and one for vectors that have none
        flat = left.select("label", "a", "more", F.explode_outer("near").alias("n"))
        kept = flat.join(used, same & (F.col("n.b") == F.col("_u")), "left_anti")
        lists = cut(
            left.select("label", "a", "more")
            .join(kept.groupBy("label", "a").agg(F.array_sort(F.collect_list("n")).alias("near")).withColumnsRenamed({"label": "_l", "a": "_a"}), same & (F.col("a") == F.col("_a")), "left")
            .select("label", "a", F.coalesce("near", F.array().cast("array<struct<d:double,b:long>>")).alias("near"), "more")
        )
        lists = again(lists)
    empty = lists.select("label", "a", F.col("a").alias("b"), F.lit(0.0).alias("distance")).limit(0)
    return empty if done is None else done
