"""Interaction audit of document filters: what each of five filters removes in every order of application.

Texts are scanned in their Arrow buffers. A table gives each byte its classes,
prefix sums of the classes count code points, capitals and symbols between
text bounds, and words are counted by their first bytes. Distinct words are
the runs of equal hashes among a document's sorted word hashes; words that
share a hash are compared byte by byte, and a document in which two different
ones do is counted from its words. A document's failures are a mask of five
bits, and all figures of an order are sums of mask counts. No order is ever
run over documents.

The filters: A, fewer than 200 words; B, less than half of the words distinct;
C, more than 3 % of the code points in ``[A-Z]``; D, one of ``#$%&*|``; E, the
text of a document with a smaller id.

Equal texts are found by a digest of 128 bits (BLAKE2b). Rows of a text, part
and label are counted before they move, so a text that a third of all
documents share is a few rows per task.

Defined results
---------------
* null or empty text: no words, so it fails A alone, and E after an equal text of a smaller id; null and '' are equal texts;
* null id: no smaller id exists, so such a row never fails E and makes none fail it; its label is unknown;
* rows that share their id aren't smaller than one another: repeated rows of the smallest id all pass E;
* ``labels`` that name an id twice: quality or toxic if any of its rows says so; labels without a document count nowhere;
* null lang: part '', together with documents whose lang is '';
* very long texts are scanned whole, one text at a time if it exceeds a batch;
* empty ``documents``: no parts, so no rows; other input columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read_table, text_batches
from .text_blocks import Words, bounded, same_bytes, text_bytes

FILTERS = "ABCDE"
BLANK, CAPITAL, SYMBOL, POINT = 1, 2, 4, 8
MASKS = 1 << len(FILTERS)
_U = np.uint64


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[[32, *range(9, 14)]] |= BLANK
    table[ord("A") : ord("Z") + 1] |= CAPITAL
    table[list(b"#$%&*|")] |= SYMBOL
    table[[b for b in range(256) if b & 0xC0 != 0x80]] |= POINT  # all but continuation bytes begin a code point
    return table


CLASSES = _classes()


def counts_between(marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marked bytes each text has, by prefix sums."""
    before = np.zeros(len(marked) + 1, np.int64)
    np.cumsum(marked, out=before[1:])
    return np.diff(before[offsets])


def distinct_words(raw: np.ndarray, words: Words) -> np.ndarray:
    """Distinct words of each text."""
    texts = len(words.bounds) - 1
    bits = _U(max(texts - 1, 1).bit_length())
    key = (words.doc.astype(_U) << (_U(64) - bits)) | (words.hash >> bits)
    order = np.argsort(key, kind="stable")
    key = key[order]
    equal = np.flatnonzero(key[1:] == key[:-1])
    one, two = order[equal], order[equal + 1]
    length = words.stop[one] - words.start[one]
    same = length == words.stop[two] - words.start[two]
    same[same] = same_bytes(raw, words.start[one[same]], raw, words.start[two[same]], length[same])
    out = np.diff(words.bounds) - np.bincount(words.doc[one[same]], minlength=texts)
    for text in np.unique(words.doc[one[~same]]).tolist():
        own = range(words.bounds[text], words.bounds[text + 1])
        out[text] = len({raw[words.start[w] : words.stop[w]].tobytes() for w in own})
    return out


def text_failures(column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Which of A to D each text fails, as bits 0 to 3, and the digest of each text."""
    raw, offsets = text_bytes(column)
    classes = CLASSES[raw]
    words = Words(raw, offsets, blanks=(classes & BLANK) != 0)
    n = np.diff(words.bounds)
    fails = (n < 200).astype(np.int32)
    fails |= (100 * distinct_words(raw, words) < 50 * n) << 1
    fails |= (100 * counts_between(classes & CAPITAL != 0, offsets) > 3 * counts_between(classes & POINT != 0, offsets)) << 2
    fails |= (counts_between(classes & SYMBOL != 0, offsets) > 0) << 3
    bounds = offsets.tolist()
    return fails, [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(bounds, bounds[1:])]


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part``, ``fails`` (A to D) and ``digest`` of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            fails, digests = text_failures(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(fails), pa.array(digests, pa.binary())], names=["doc_id", "part", "fails", "digest"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text")
    return text_batches(rows).mapInArrow(run, "doc_id long, part string, fails int, digest binary")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask`` (all five failures), documents ``n``, and those of them labelled ``good`` and ``toxic``."""
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = said.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    kind = ["digest", "part", "fails", "good", "toxic"]
    of_id = scanned(docs).join(known, "doc_id", "left").fillna(0, ["good", "toxic"]).groupBy("doc_id", *kind).agg(F.count(F.lit(1)).alias("n"))
    of_kind = of_id.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.min("doc_id").alias("first"),
        F.min_by("n", "doc_id").alias("n_first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
    )
    # one row for each text, part and label remains, so a window holds few rows of a text however often it occurs
    earliest = F.min("first").over(Window.partitionBy("digest"))
    passes = F.col("n_null") + F.when(F.col("first") == earliest, F.col("n_first")).otherwise(0)
    split = of_kind.withColumn("passes", passes).withColumn(
        "at",
        F.explode(
            F.array(
                F.struct(F.col("fails").alias("mask"), F.col("passes").alias("n")),
                F.struct((F.col("fails") + F.lit(16)).alias("mask"), (F.col("n") - F.col("passes")).alias("n")),
            )
        ),
    )
    n = F.col("at.n")
    return split.groupBy("part", F.col("at.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic")
    )


def _orders() -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The orders, and for each step of each: its filter, its bit, and the bits of the filters before it."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    letter = np.array([[FILTERS.index(x) for x in order] for order in orders])
    bit = 1 << letter
    return orders, letter.ravel(), bit.ravel(), (np.cumsum(bit, 1) - bit).ravel()


FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    steps = len(FILTERS)
    by_part = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, letter, bit, before = _orders()
        mask = np.arange(MASKS)
        fails, gone = (mask[:, None] & bit) != 0, (mask[:, None] & before) != 0
        removes, redundant = fails & ~gone, fails & gone
        kept, alone = ~fails & ~gone, mask[:, None] == bit
        for batch in batches:
            for part, masks in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist(), strict=True):
                n, good, toxic = np.zeros((3, MASKS), np.int64)
                for x in masks:
                    n[x["mask"]], good[x["mask"]], toxic[x["mask"]] = x["n"], x["good"], x["toxic"]
                removed = n @ removes
                shapley = np.array([removed[letter == k].sum() for k in range(steps)])[letter]
                figures = [n @ kept, removed, n @ redundant, n @ alone, good @ removes, toxic @ removes, shapley]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(letter)),
                        pa.array(np.repeat(orders, steps)),
                        pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(orders))),
                        *(pa.array(x, pa.int64()) for x in figures),
                    ],
                    names=["part", "filter_order", "step", *FIGURES],
                )

    return by_part.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{x} long" for x in FIGURES))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents, for each language."""
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
