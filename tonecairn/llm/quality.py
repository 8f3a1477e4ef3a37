"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from the text alone, a batch at a time. Trees grow
level by level on quantile bins and are flattened into arrays; scoring walks
all documents of a batch through a tree at once.

The model is fitted on the driver on a bounded sample of labelled documents
(``sample_rows``, the smallest hashes of the id, so the same rows in every
run); statistics and scores cover every document. Rows whose crc32 of the id
as text leaves 1 modulo 3 are held out: no label of theirs is read.

Defined results
---------------
* null or empty text: statistics of an empty text, a score like any other;
* null id: not held out; null label: not learned from; ids that repeat in
  ``labels``: each row is learned from; a repeated document: each is scored;
* no labels, or one class only: every score is that class's share (0.5 if none);
* very long texts: statistics of the whole text, one text at a time if one exceeds a batch;
* empty ``documents``: no rows; other input columns are not read and come to no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .shared import is_held_out, read_table, text_batches
from .text_blocks import Words, bounded, lowered, text_bytes, window_hashes

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_spread", "longest_word", "distinct_words", "lines_per_word",
    "upper", "digit", "punctuation", "symbols", "pipes", "stops", "commas", "not_ascii", "spaces", "repeats_of_pairs",
    "first_upper", "marked_words", "upper_words", "one_byte_words", "line_bytes", "exclaims", "words_ending_in_stop",
)


def _class_table() -> np.ndarray:
    """Bit flags of each byte value."""
    table = np.zeros(256, np.uint16)
    for bit, chars in enumerate((range(65, 91), range(48, 58), b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b"#$%&*+=<>@^_~`\\", b"|", b".", b",", range(128, 256), b" ", b"\n", b"!")):
        table[list(chars)] |= 1 << bit
    return table


_CLASSES = _class_table()


def statistics(column: pa.Array) -> np.ndarray:
    """(documents, len(STATISTICS)) float64."""
    raw, offsets = text_bytes(column)
    n_docs = len(offsets) - 1
    words = Words(lowered(raw), offsets)
    n_bytes = np.diff(offsets).astype(float)
    n_words = np.diff(words.bounds).astype(float)
    size, n = np.maximum(n_bytes, 1), np.maximum(n_words, 1)
    flags = _CLASSES[raw]

    def share(bit: int) -> np.ndarray:
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((flags >> bit) & 1, out=total[1:])
        return np.diff(total[offsets]) / size

    def per_word(values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1)
        np.cumsum(values, out=total[1:])
        return np.diff(total[words.bounds]) / n

    upper, digit, punctuation, symbols, pipes, stops, commas, high, spaces, lines, exclaims = (share(b) for b in range(11))
    length = (words.stop - words.start).astype(float)
    mean = per_word(length)
    spread = np.sqrt(np.maximum(per_word(length**2) - mean**2, 0))
    longest = np.zeros(n_docs)
    np.maximum.at(longest, words.doc, length)

    doc_bits = np.uint64(max(n_docs.bit_length(), 1))

    def distinct(hashes: np.ndarray, doc: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Different hashes of each document, by one sort of document number and leading hash bits."""
        keys = np.sort((doc.astype(np.uint64) << (np.uint64(64) - doc_bits)) | (hashes >> doc_bits))
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        return np.bincount((keys[new] >> (np.uint64(64) - doc_bits)).astype(np.int64), minlength=n_docs) / of

    pairs = window_hashes(words.hash, 2)
    same = words.doc[1:] == words.doc[:-1]
    first, last = _CLASSES[raw[words.start]], _CLASSES[raw[words.stop - 1]]
    second = _CLASSES[raw[np.minimum(words.start + 1, words.stop - 1)]]
    return np.stack(
        [
            np.log1p(n_bytes), np.log1p(n_words), mean, spread, longest, distinct(words.hash, words.doc, n),
            lines * size / n, upper, digit, punctuation, symbols, pipes, stops, commas, high, spaces,
            1 - distinct(pairs[same], words.doc[1:][same], np.maximum(n_words - 1, 1)),
            per_word(first & 1), per_word((last >> 3) & 1), per_word(first & second & 1), per_word(length == 1),
            np.log1p(size / (1 + lines * size)), exclaims, per_word((last >> 5) & 1),
        ],
        1,
    )


@dataclass
class Boosted:
    """Trees as arrays over nodes: the feature (-1 at a leaf), threshold, left child (right is next to it), value."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                go = self.left[node] + (x[rows, np.maximum(f, 0)] > self.threshold[node])
                node = np.where(f < 0, node, go)
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, shrink: float = 1.0, leaf_rows: float = 8
) -> Boosted:
    """Second-order boosting of the logistic loss."""
    n, p = x.shape
    share = y.mean() if n else 0.5
    out: list[list] = [[], [], [], []]
    roots: list[int] = []

    def made(base: float) -> Boosted:
        return Boosted(base, np.array(roots, int), np.array(out[0], int), np.array(out[1], float), np.array(out[2], int), np.array(out[3], float), depth)

    if n == 0 or share in (0.0, 1.0):
        return made(0.0 if n == 0 else 40.0 * (1 if share else -1))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(p)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(p)], 1)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    flat = binned + np.arange(p) * bins

    def new() -> int:
        for c, v in zip(out, (-1, 0.0, 0, 0.0), strict=True):
            c.append(v)
        return len(out[0]) - 1

    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = prob - y, prob * (1 - prob)
        roots.append(new())
        at, nodes = np.zeros(n, int), [roots[-1]]
        for level in range(depth + 1):
            k = len(nodes)
            g, h = np.bincount(at[at >= 0], grad[at >= 0], k), np.bincount(at[at >= 0], hess[at >= 0], k)
            for i, node in enumerate(nodes):
                out[3][node] = float(-rate * g[i] / (h[i] + shrink))
            if level == depth:
                break
            live = at >= 0
            key = (at[live][:, None] * (p * bins) + flat[live]).ravel()
            hist = lambda w: np.bincount(key, np.repeat(w, p), k * p * bins).reshape(k, p, bins).cumsum(2)
            gl, hl, nl = hist(grad[live]), hist(hess[live]), hist(np.ones(int(live.sum())))
            total = nl[:, :, -1:]
            gain = gl**2 / (hl + shrink) + (g[:, None, None] - gl) ** 2 / (h[:, None, None] - hl + shrink) - (g**2 / (h + shrink))[:, None, None]
            gain[(nl < leaf_rows) | (total - nl < leaf_rows)] = -1
            best = gain.reshape(k, -1).argmax(1)
            children, moved = [], np.full(n, -1)
            for i, node in enumerate(nodes):
                j, b = divmod(int(best[i]), bins)
                if gain[i, j, b] <= 1e-6 or b >= len(edges[j]):
                    continue
                low = new()
                new()
                out[0][node], out[1][node], out[2][node] = j, float(edges[j][b]), low
                rows = at == i
                moved[rows] = len(children) + (binned[rows, j] > b)
                children += [low, low + 1]
            at, nodes = moved, children
            if not children:
                break
        margin = margin + _one(out, roots[-1], x, depth)
    return made(base)


def _one(out: list[list], root: int, x: np.ndarray, depth: int) -> np.ndarray:
    """The values of the tree at ``root``."""
    tree = Boosted(0.0, np.array([0]), *(np.array(c[root:]) for c in out), depth)
    node, rows = np.zeros(len(x), int), np.arange(len(x))
    for _ in range(depth):
        f = tree.feature[node]
        node = np.where(f < 0, node, tree.left[node] - root + (x[rows, np.maximum(f, 0)] > tree.threshold[node]))
    return tree.value[node]


def _statistics_frame(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the statistics of every row."""
    schema = docs.select(*keep).schema.add("statistics", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(list(x), pa.list_(pa.float64()))], names=[*keep, "statistics"]
            )

    return text_batches(docs.select(*keep, "text")).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000) -> Boosted:
    """Fit on at most ``sample_rows`` labelled documents that aren't held out."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(sample_rows)
    )
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    found = _statistics_frame(picked.withColumn("place", F.xxhash64("doc_id")).withColumnRenamed("quality", "label"), ["place", "doc_id", "label"])
    # ids that repeat in the documents bring more rows than labels, so the bound holds once more
    rows = found.orderBy("place", "doc_id", "label", F.xxhash64("statistics")).limit(sample_rows).toPandas()
    if not len(rows):
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    order = np.lexsort(np.stack(rows["statistics"]).T[::-1])  # the same sums whatever the partitions were
    return fit(np.stack(rows["statistics"])[order], rows["label"].to_numpy(float)[order])


def with_scores(docs: DataFrame, model: Boosted, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row, with ``score`` put last."""
    schema = docs.select(*keep).schema.add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            score = shared.value.score(statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score)], names=[*keep, "score"])

    return text_batches(docs.select(*dict.fromkeys([*keep, "text"]))).mapInArrow(run, schema)


def above(docs: DataFrame, model: Boosted, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least so much, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            yield batch.filter(pa.array(shared.value.score(statistics(batch.column("text"))) >= least))

    return text_batches(docs).mapInArrow(run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return with_scores(docs, model, ["doc_id"]).select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null or empty text has a score like any other; repeated rows and ids that tie share their text's fate; no rows, no rows.
    """
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return above(docs, model)
