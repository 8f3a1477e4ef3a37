"""Nearest neighbours by a hash-prefix forest.

After a reduction of inner product to angle, vectors get hash symbols: the
largest coordinate, with its sign, of a random projection (cross-polytope
hashing). A tree has one long hash string per vector, the symbols of a few
projections in its own random choice; all trees share one pool of projections.
A tree is the array of its strings in sorted order. A query descends every
tree to its longest common prefix by binary search, then all trees ascend
together, one bit at a time, until the prefix ranges hold enough entries (the
level where that is the case is found by bisection, as ranges only grow); the
candidates are scored exactly in double precision.

The rows are dealt into blocks of about ``block_rows`` distinct vectors; each
task builds the forest of one block and streams all queries through it, so
memory is bounded by a block. Equal vectors are one entry with its smallest
``k + 1`` ids, which is all that any answer can hold.

Defined results
---------------
* a vector that is null, empty, zero or has a null or non-finite component
  takes no part, neither as a query nor as a candidate; null ids neither;
* vectors are only compared with vectors of their own length;
* a query's own id is no candidate; ties go to the smaller id; fewer than
  ``k`` candidates: all of them; repeated rows (same id and vector) count once;
* empty table: no rows; other input columns are not read.

Recall depends on ``entries``, which all ranges together must hold before the
ascent stops, a quarter of them different rows, and on the number of trees.
What is scored does not grow with a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read_table

FOUND = "query_id long, vec_ids array<long>, scores array<double>"


class Forest:
    """Sorted arrays of long hash strings over the rows of ``vectors``: ``symbols`` symbols of one of ``pool`` projections each."""

    def __init__(self, vectors: np.ndarray, trees: int = 512, symbols: int = 4, pool: int = 384, seed: int = 20240229) -> None:
        self.vectors, rng = vectors, np.random.default_rng(seed)
        dim = vectors.shape[1] + 1
        self.faces = min(32, dim)
        self.symbol_bits = (2 * self.faces - 1).bit_length()
        self.bits = symbols * self.symbol_bits
        self.planes = rng.standard_normal((pool, dim, self.faces)).astype(np.float32)
        self.names = np.stack([rng.permutation(1 << self.symbol_bits) for _ in range(pool)]).astype(np.uint32)  # which faces a shorter prefix merges
        self.of_tree = np.stack([rng.choice(pool, symbols, replace=False) for _ in range(trees)])
        norms = np.einsum("ij,ij->i", vectors, vectors)
        codes = self._codes(np.hstack([vectors, np.sqrt(np.maximum(float(norms.max()) - norms, 0))[:, None]]))
        self.order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self.codes = np.take_along_axis(codes, self.order, 1)

    def _codes(self, lifted: np.ndarray) -> np.ndarray:
        """(trees, rows) hash strings as numbers."""
        lifted = lifted / np.sqrt((lifted**2).sum(1, keepdims=True))  # a length says nothing about an angle, and may be out of a float's range
        lifted, rows = lifted.astype(np.float32), np.arange(len(lifted))
        symbols = np.empty((len(self.planes), len(lifted)), np.uint32)
        for k, (plane, names) in enumerate(zip(self.planes, self.names, strict=True)):
            x = lifted @ plane
            face = np.abs(x).argmax(1)
            symbols[k] = names[2 * face + (x[rows, face] > 0)]
        out = np.zeros((len(self.of_tree), len(lifted)), np.uint32)
        for picked in self.of_tree.T:
            out = (out << np.uint32(self.symbol_bits)) | symbols[picked]
        return out

    def ranges(self, codes: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-end positions, (trees, queries), of the strings that agree with each query's in ``level`` bits."""
        rest = ((np.uint64(1) << (self.bits - level).astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
        least = codes & ~rest
        low = np.stack([np.searchsorted(c, x, "left") for c, x in zip(self.codes, least, strict=True)])
        return low, np.stack([np.searchsorted(c, x, "right") for c, x in zip(self.codes, least | rest, strict=True)])

    def levels(self, codes: np.ndarray, entries: int) -> np.ndarray:
        """Where the common ascent of each query stops: the deepest level at which all ranges hold ``entries``."""
        deep, flat = np.full(codes.shape[1], self.bits), np.zeros(codes.shape[1], int)  # the level looked for is in flat .. deep
        while len(open_ := np.flatnonzero(flat < deep)):
            level = (flat[open_] + deep[open_] + 1) // 2
            low, high = self.ranges(codes[:, open_], level)
            enough = (high - low).sum(0) >= entries
            flat[open_[enough]] = level[enough]
            deep[open_[~enough]] = level[~enough] - 1
        return flat

    def candidates(self, queries: np.ndarray, entries: int, step: int = 256) -> Iterator[tuple[int, np.ndarray]]:
        """(query, rows), in any order: ascends on for a query whose entries are a few rows that many trees have found, up to a quarter as many different ones."""
        n, flat = len(self.vectors), self.order.reshape(-1)
        start = np.arange(len(self.order))[:, None] * n
        for first in range(0, len(queries), step):
            some = queries[first : first + step]
            codes = self._codes(np.hstack([some, np.zeros((len(some), 1))]))
            level, open_ = self.levels(codes, entries), np.arange(len(some))
            while len(open_):
                low, high = self.ranges(codes[:, open_], level[open_])
                size, low, again = high - low, low + start, []
                for k, q in enumerate(open_.tolist()):
                    seen = np.zeros(n, bool)
                    seen[flat[np.arange(int(size[:, k].sum())) + np.repeat(low[:, k] - (np.cumsum(size[:, k]) - size[:, k]), size[:, k])]] = True
                    rows = np.flatnonzero(seen)
                    if level[q] and 4 * len(rows) < entries:
                        again.append(q)
                    else:
                        yield first + q, rows
                open_ = np.array(again, int)
                level[open_] -= 1

    def search(self, queries: np.ndarray, k: int, entries: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, rows, scores): at least the ``k`` best candidates of each query with all ties of the last."""
        for q, rows in self.candidates(queries, max(4 * k, entries)):
            scores = self.vectors[rows] @ queries[q]
            if len(rows) > k:
                keep = scores >= np.partition(scores, len(rows) - k)[len(rows) - k]
                rows, scores = rows[keep], scores[keep]
            yield q, rows, scores


def usable(column: str):
    c = F.col(column)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return c.isNotNull() & (F.size(c) > 0) & F.forall(c, finite) & F.exists(c, lambda x: x != 0)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    trees: int = 512,
    symbols: int = 4,
    entries: int = 4096,
    block_rows: int = 16384,
) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs: vec_id long, embedding array<float>.

    ``entries`` counts a candidate once for every tree that finds it.
    """
    pick = lambda df: df.selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) embedding").where(
        usable("embedding") & F.col("vec_id").isNotNull()
    )
    rows = pick(vectors)
    smallest = Window.partitionBy("embedding").orderBy("vec_id")
    once = (
        rows.distinct()
        .withColumn("rank", F.row_number().over(smallest))
        .where(F.col("rank") <= k + 1)
        .groupBy("embedding")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )
    sizes = {r["dim"]: r["n"] for r in rows.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks_of = F.coalesce(*[F.when(F.col("dim") == d, F.lit(-(-n // block_rows))) for d, n in sizes.items()], F.lit(1))
    once = once.withColumn("dim", F.size("embedding")).withColumn(
        "block", F.pmod(F.xxhash64(F.col("ids")[0]), blocks_of).cast("int")
    )
    asked = (
        pick(queries)
        .distinct()
        .withColumn("dim", F.size("embedding"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), (blocks_of - 1).cast("int"))))
    )
    mixed = once.selectExpr("dim", "block", "0 kind", "ids", "embedding").unionByName(
        asked.selectExpr("dim", "block", "1 kind", "array(vec_id) ids", "embedding")
    )
    total = sum(-(-n // block_rows) for n in sizes.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matrix(column, dim: int) -> np.ndarray:
            return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)

        at, parts, ids, forest = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column(x).to_numpy() for x in ("dim", "block", "kind")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                dim, block, kind = keys[a].tolist()
                piece = batch.slice(a, b - a)
                if at != (dim, block):
                    at, parts, ids, forest = (dim, block), [], [], None
                if kind == 0:
                    parts.append(matrix(piece.column("embedding"), dim))
                    ids += piece.column("ids").to_pylist()
                    continue
                if forest is None:
                    if not parts:
                        continue
                    forest, parts = Forest(np.concatenate(parts), trees, symbols), []
                own = piece.column("ids").flatten().to_numpy()
                wanted = matrix(piece.column("embedding"), dim)
                out_ids, out_scores = [[]] * len(own), [[]] * len(own)
                for q, found, scores in forest.search(wanted, k + 1, entries):
                    pairs = [(-s, i) for r, s in zip(found.tolist(), scores.tolist(), strict=True) for i in ids[r] if i != own[q]]
                    pairs.sort()
                    out_ids[q], out_scores[q] = [i for _, i in pairs[:k]], [-s for s, _ in pairs[:k]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int64()), pa.array(out_ids, pa.list_(pa.int64())), pa.array(out_scores, pa.list_(pa.float64()))],
                    names=["query_id", "vec_ids", "scores"],
                )

    dealt = mixed.repartition(max(total, 1), "dim", "block").sortWithinPartitions("dim", "block", "kind")
    found = dealt.mapInArrow(run, FOUND)
    pairs = F.transform(F.arrays_zip("scores", "vec_ids"), lambda x: F.struct((-x["scores"]).alias("far"), x["vec_ids"].alias("vec_id")))
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.far")).alias("score")
    )


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
