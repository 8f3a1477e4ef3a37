"""Connected components of a table of links: alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, keep_table


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that it reaches) of all but the least nodes, for links within one array."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while (label[i] != label[j]).any():
        a, b = label[i], label[j]
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)  # roots are hooked, so a path halves in every pass
        np.minimum.at(label, b, least)
        while (shorter := label[label]).tobytes() != label.tobytes():
            label = shorter
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _contracted(links: DataFrame, most: int = 1 << 22) -> DataFrame:
    """The same components with each task's links, at most ``most`` at a time, made stars: what a task has needs no round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for last, batch in _marked(batches):
            held += [batch] if batch is not None else []
            if held and (last or sum(b.num_rows for b in held) >= most):
                table = pa.Table.from_batches(held)
                u, v = stars(table.column("u").to_numpy(), table.column("v").to_numpy())
                held = []
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return links.mapInArrow(run, links.schema)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch | None]]:
    """(False, batch) for every batch, then (True, None)."""
    yield from ((False, b) for b in batches)
    yield True, None


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the least one around that node instead."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked with the least of these."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(links: DataFrame) -> tuple:
    """Number of links and an order-free sum over them: equal only for equal tables, but for a chance of 2**-64."""
    mixed = F.xxhash64("u", "v")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.shiftright(mixed, 32)), F.sum(mixed.bitwiseAND(F.lit(0xFFFFFFFF)))).first())


def connected(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each linked node reaches. ``links``: (a, b), of one type, no nulls.

    First every task makes stars of the links that it has. Then a round makes
    stars of ever larger parts of a component, so rounds grow with the
    logarithm of its size: 18 for a path of 100,000 nodes. The table
    of links never grows. A round is written to the shared folder and the one
    before it deleted; nothing but two counts and sums reaches the driver. It
    ends when a round changes nothing.
    """
    pair = F.struct(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).alias("p")
    now = keep_table(_contracted(links.where("a <> b").select(pair).select("p.*").distinct()), "links", release=False)
    known = _digest(now)
    while True:
        after = keep_table(_small_star(_large_star(now)), "links", release=False)
        drop_table(now)
        now, before = after, known
        known = _digest(now)
        if known == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
