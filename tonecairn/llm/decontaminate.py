"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters, digits and non-ASCII characters in lower case.
Windows of ``seed`` tokens that a document shares with a benchmark item are
joined; only pairs whose shared windows could cover enough of the item are
tiled. Tiling takes the longest matches first: Karp-Rabin hashes of all
unmarked windows of the current length are compared, matches extended and the
longest non-overlapping ones marked, then the length is lowered, down to
``seed``. The share of the item's tokens that the tiles cover decides, so a
passage whose sentences were put in another order is still found.

The benchmark is the stated query set: it is cut into blocks of a bounded
number of bytes, each block is broadcast and all documents are read against
it; nothing is shuffled. Of several blocks one is broadcast at a time: what is
found is written to the shared folder before the next one is sent.

Defined results
---------------
* null or empty texts on either side, and items of fewer than ``seed`` tokens,
  match nothing;
* items with equal texts each have rows of their own; repeated documents too;
* ties between tiles of one length: the first in the document, then in the item;
* very long texts: matched whole, one text at a time if one exceeds a batch;
* an empty table gives no rows; other input columns are not read.

A block's index has six numbers of eight bytes for a token, which is about twelve
times the block's text: ``block_bytes`` bounds what is broadcast.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hash_exchange import group_starts
from .shared import free_name, keep_table, read_table, text_batches
from .text_blocks import Words, bounded, long_window_hashes, text_bytes, whole_windows, window_hashes

SEED = 5
COVERAGE = 0.5
_ENTRIES = 1 << 20  # seeds of items that are looked at at a time
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
FOUND = "doc_id long, item_id long, item_tokens int, covered_tokens int, n_tiles int, longest_tile int, coverage double"


def tokens(column: pa.Array) -> Words:
    raw, offsets = text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    return Words(raw, offsets, ~_TOKEN[raw])


def _free_windows(tokens_: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, running Karp-Rabin hash) of every window without a marked token."""
    marked = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(marked[size:] == marked[:-size]) if len(free) >= size else np.zeros(0, np.int64)
    return at, long_window_hashes(tokens_, size)[at]


def tile(document: np.ndarray, item: np.ndarray, seed: int, gaps: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (document position, item position, length), none overlapping, longest first.

    Lengths go down from the longest that can be; at each, the hashes of all unmarked windows of both sides are
    compared and matches marked from left to right, so nothing longer is left when the next length begins. A window
    whose hash agrees is compared token by token. ``gaps`` masks document positions that match nothing.
    """
    free_d, free_i = np.ones(len(document), bool), np.ones(len(item), bool)
    if gaps is not None:
        free_d[gaps] = False
    tiles: list[tuple[int, int, int]] = []

    def matches(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions and hashes of the windows of document and item that the other side has as well."""
        there, own = _free_windows(document, free_d, length)
        where, hashes = _free_windows(item, free_i, length)
        common = np.intersect1d(own, hashes)
        some, here = np.isin(own, common), np.isin(hashes, common)
        return there[some], own[some], where[here], hashes[here]

    length = min(len(item), _longest_run(free_d))
    while length >= seed:
        nexts, values, where, hashes = matches(length)
        if not len(nexts):  # a shorter match exists wherever a longer one does: search for the longest
            low, high = seed - 1, length - 1
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if len(matches(middle)[0]) else (low, middle - 1)
            length = low
            continue
        places: dict[int, list[int]] = {}  # of a hash: positions in the item, the first last
        for value, i in zip(hashes[::-1].tolist(), where[::-1].tolist(), strict=True):
            places.setdefault(value, []).append(i)
        values, k = values.tolist(), 0
        while k < len(values) and places:
            d, value = int(nexts[k]), values[k]
            left, other, found = places.get(value, []), [], False
            while left and not found:
                i = left.pop()
                if not free_i[i : i + length].all():
                    continue  # marked for good
                found = np.array_equal(item[i : i + length], document[d : d + length])
                if not found:
                    other.append(i)  # only the hash agrees
            left.extend(reversed(other))
            if not left:
                places.pop(value, None)
            if found:
                free_d[d : d + length] = free_i[i : i + length] = False
                tiles.append((d, i, length))
                k = int(np.searchsorted(nexts, d + length))
            else:
                k += 1
        length = min(length - 1, _longest_run(free_i), _longest_run(free_d))
    return tiles


def _longest_run(free: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


class Items:
    """One block of the benchmark: its tokens and the sorted seeds."""

    def __init__(self, ids: list[int | None], texts: pa.Array, seed: int) -> None:
        self.ids, self.seed = ids, seed
        words = tokens(texts)
        self.bounds, self.hash = words.bounds, words.hash
        at = np.flatnonzero(whole_windows(words.bounds, seed))
        seeds = window_hashes(words.hash, seed)[at]
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.at = seeds[order], at[order]
        self.item = words.doc[self.at] if len(at) else self.at
        by_place = np.argsort(self.at)
        self.positions, self.first_of = self.at[by_place], np.searchsorted(self.seeds, self.seeds, "left")[by_place]
        self.size = np.diff(words.bounds)

    def matches(self, column: pa.Array, coverage: float) -> list[tuple[int, int, int, int, int]]:
        """(row, item, covered tokens, tiles, longest tile) of every pair that reaches ``coverage``."""
        seed = self.seed
        words = tokens(column)
        if not len(self.seeds) or len(words.hash) < seed:
            return []
        hashes = window_hashes(words.hash, seed)
        low = np.searchsorted(self.seeds, hashes, "left")
        near = np.minimum(low, len(self.seeds) - 1)
        hit = np.flatnonzero((self.seeds[near] == hashes) & whole_windows(words.bounds, seed))
        out: list[tuple[int, int, int, int, int]] = []
        # a few documents at a time, so that what their seeds lead to stays bounded
        doc = words.doc[hit]
        new = np.ones(len(hit), bool)
        order = np.lexsort((low[hit], doc))
        new[1:] = (doc[order][1:] != doc[order][:-1]) | (low[hit][order][1:] != low[hit][order][:-1])
        first = order[new]  # one of each seed of a document: how often it has it doesn't matter yet
        entries = np.searchsorted(self.seeds, hashes[hit[first]], "right") - low[hit[first]]
        piece = (np.cumsum(entries) - entries) // _ENTRIES
        piece = np.maximum.accumulate(np.where(np.diff(doc[first], prepend=-1) != 0, piece, 0))  # whole documents
        cuts = np.append(group_starts(piece), len(first)).tolist()
        for a, b in zip(cuts, cuts[1:]):
            out += self._tiled(words, hit, doc, low[hit], first[a:b], entries[a:b], coverage)
        return out

    def _tiled(self, words: Words, hit: np.ndarray, doc: np.ndarray, low: np.ndarray, first: np.ndarray, entries: np.ndarray, coverage: float) -> list[tuple[int, int, int, int, int]]:
        seed = self.seed
        entry = np.arange(int(entries.sum())) - np.repeat(np.cumsum(entries) - entries - low[first], entries)
        pair = np.stack([np.repeat(doc[first], entries), self.item[entry], self.at[entry]], 1)
        pair = pair[np.lexsort((pair[:, 2], pair[:, 1], pair[:, 0]))]
        # tokens of the item under any shared seed: no tiling covers more
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:, :2] != pair[:-1, :2]).any(1)
        adds = np.full(len(pair), seed)
        adds[:-1] = np.where(new[1:], seed, np.minimum(pair[1:, 2] - pair[:-1, 2], seed))
        starts = np.flatnonzero(new)
        most = np.add.reduceat(adds, starts) if len(starts) else adds
        stops = np.append(starts[1:], len(pair))
        out, of = [], -1
        for k in np.flatnonzero(most >= coverage * self.size[pair[starts, 1]]).tolist():
            d, i = pair[starts[k], :2].tolist()
            if d != of:  # the document's positions with a seed of any item, by seed
                of, (a, b) = d, np.searchsorted(doc, (d, d + 1))
                order = np.argsort(low[a:b], kind="stable")
                by_seed, at_seed = hit[a:b][order], low[a:b][order]
            shared = np.unique(self.seeds_at(pair[starts[k] : stops[k], 2]))
            x, y = np.searchsorted(at_seed, shared, "left"), np.searchsorted(at_seed, shared, "right")
            place = np.sort(by_seed[np.arange(int((y - x).sum())) + np.repeat(x - (np.cumsum(y - x) - (y - x)), y - x)])
            covers = np.zeros(int(place[-1] - place[0]) + seed + 1, np.int32)
            np.add.at(covers, place - place[0], 1)
            np.add.at(covers, place - place[0] + seed, -1)
            at = np.flatnonzero(np.cumsum(covers) > 0) + place[0]
            breaks = np.flatnonzero(np.diff(at) > 1) + 1
            document = np.insert(words.hash[at], breaks, 0)
            tiles = tile(document, self.hash[self.bounds[i] : self.bounds[i + 1]], seed, breaks + np.arange(len(breaks)))
            covered = sum(t[2] for t in tiles)
            if tiles and covered >= coverage * self.size[i]:
                out.append((d, i, covered, len(tiles), max(t[2] for t in tiles)))
        return out

    def seeds_at(self, positions: np.ndarray) -> np.ndarray:
        """The first entry with the seed that starts at each position of the block."""
        return self.first_of[np.searchsorted(self.positions, positions)]


def item_blocks(benchmark: DataFrame, seed: int, block_bytes: int) -> Iterator[tuple[Items, bool]]:
    """The benchmark in blocks of about ``block_bytes`` of text, one in the driver's memory at a time; and whether it is the last."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    count = max(1, -(-total // block_bytes))
    for k in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        table = part.orderBy("item_id", "text").toArrow()
        yield Items(table.column("item_id").to_pylist(), table.column("text").combine_chunks(), seed), k == count - 1


def find_contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, block_bytes: int = 8 << 20) -> DataFrame:
    """Pairs of a document and an item of which the document has at least the share ``coverage``."""
    rows, found_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), []

    def found(items: Items, batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = items.matches(batch.column("text"), coverage)
        ids = batch.column("doc_id").to_pylist()
        columns = [
            ([ids[d] for d, *_ in pairs], pa.int64()),
            ([items.ids[i] for _, i, *_ in pairs], pa.int64()),
            ([int(items.size[i]) for _, i, *_ in pairs], pa.int32()),
            *(([p[k] for p in pairs], pa.int32()) for k in (2, 3, 4)),
            ([p[2] / int(items.size[p[1]]) for p in pairs], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays([pa.array(*c) for c in columns], names=[x.split()[0] for x in FOUND.split(", ")])

    for made, last in _each_block(rows, benchmark, found, FOUND, seed, block_bytes):
        found_in.append(made if last else keep_table(made, "found", release=False))
    return functools.reduce(DataFrame.unionByName, found_in)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` that reach ``coverage`` of no item.

    The last block of the benchmark filters the rows as they are read. Of
    those before it only digests of the texts that contain an item are
    written, and such texts are left out by an anti-join at the end.
    """

    def clean(items: Items, batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.ones(batch.num_rows, bool)
        keep[[m[0] for m in items.matches(batch.column("text"), coverage)]] = False
        return batch.filter(pa.array(keep))

    def named(items: Items, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        rows = sorted({m[0] for m in items.matches(texts, coverage)})
        digests = {hashlib.sha256(texts[d].as_py().encode()).hexdigest() for d in rows}
        return pa.RecordBatch.from_arrays([pa.array(sorted(digests), pa.string())], names=["digest"])

    texts, bad, left = docs.select("text"), [], docs
    for block, last in item_blocks(benchmark, seed, block_bytes):
        if last:
            left = _with_block(docs, block, clean, docs.schema)[0]
        else:
            made, shared = _with_block(texts, block, named, "digest string")
            bad.append(keep_table(made.distinct(), "named", release=False))
            shared.destroy()
    if not bad:
        return left
    gone = functools.reduce(DataFrame.union, bad).distinct().withColumnRenamed("digest", own := free_name(docs, "_digest"))
    return left.withColumn(own, F.sha2(F.col("text").cast("binary"), 256)).join(gone, own, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def _with_block(rows: DataFrame, block: Items, run, schema) -> tuple[DataFrame, Broadcast]:
    """What ``run`` makes of the rows with a block, and the broadcast block."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            yield run(shared.value, batch)

    return text_batches(rows).mapInArrow(over, schema), shared


def _each_block(rows: DataFrame, benchmark: DataFrame, run, schema, seed: int, block_bytes: int) -> Iterator[tuple[DataFrame, bool]]:
    """(what ``run`` makes of the rows with one block, whether it is the last); a block is dropped when the next one is asked for."""
    shared = None
    for block, last in item_blocks(benchmark, seed, block_bytes):
        if shared is not None:
            shared.destroy()
        made, shared = _with_block(rows, block, run, schema)
        yield made, last


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains."""
    return find_contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    A null id or text, repeated rows and ids that tie change nothing for other rows: each is judged by its own text; no rows, no rows.
    """
    return without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))
