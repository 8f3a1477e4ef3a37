"""Exchange of 64-bit hashes between batches of documents, in packed columns instead of rows.

Documents are dealt into batches of bounded size (``packed``). A batch
sends its distinct hashes, sorted and packed, cut by hash range into parts; the
task of a part sees every batch's hashes of its range, already combined per
batch, so a hash that a third of all documents share arrives once per batch.
Answers return to the batches the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, keep_table, shuffle_width, text_batches
from .text_blocks import bounded, give_back


def pack(values: np.ndarray) -> bytes:
    """Ascending uint64 values as one width byte and differences of that width."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=np.uint64(0))
    width = max(1, -(-int(steps[1:].max(initial=0)).bit_length() // 8))
    return bytes([width]) + values[:1].tobytes() + steps[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    width = raw[0]
    body = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(body) + 1, 8), np.uint8)
    steps[0] = np.frombuffer(raw, np.uint8, 8, 1)
    steps[1:, :width] = body
    return np.cumsum(steps.reshape(-1).view(np.uint64), dtype=np.uint64)


def part_runs(hashes: np.ndarray, parts: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """(part, first, past the end) of each part that ascending ``hashes`` of ``bits`` bits have; parts are equal ranges of the hash."""
    if not len(hashes):
        return []
    part = ((hashes << np.uint64(64 - bits)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    starts = group_starts(part)
    return list(zip(part[starts].tolist(), starts.tolist(), np.append(starts[1:], len(part)).tolist(), strict=True))


def sizes_of(docs: DataFrame) -> tuple[int, int]:
    """Rows and text bytes."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


@dataclass
class Ranges:
    """Batches as ranges of the id, null after all ids. Each range is one batch but where one id alone exceeds a batch: it has several."""

    last: np.ndarray  # the last id of each range, ascending; a range of nulls comes after these
    pieces: np.ndarray  # batches of each range
    quantum: int = 1 << 18

    def __post_init__(self) -> None:
        self.first = np.cumsum(self.pieces) - self.pieces
        self.order = np.repeat(np.arange(len(self.pieces)), self.pieces).astype(np.int32)  # the range of each batch

    def __len__(self) -> int:
        return len(self.order)

    def batches(self, ids: pa.Array, sizes: np.ndarray, before: int) -> np.ndarray:
        """The batch of each row. Rows of an id that has several are dealt to them by the bytes that went ``before`` in the task."""
        at = np.where(ids.is_null().to_numpy(zero_copy_only=False), len(self.last), np.searchsorted(self.last, ids.fill_null(0).to_numpy(zero_copy_only=False), "left"))
        turn = (before + np.cumsum(sizes) - sizes) // self.quantum
        return self.first[at] + turn % self.pieces[at]


def id_ranges(docs: DataFrame, batch_bytes: int) -> tuple[Ranges, int]:
    """Ranges of about ``batch_bytes`` of text, and the bytes of all texts.

    Ids with their bytes are sorted by range; every task cuts its ids by
    running sums. One row for each range reaches the driver.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    of_id = keep_table(docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sum(size).alias("bytes")), "sizes", release=False)
    total = of_id.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts: list[tuple[int | None, int]] = []
        held, last = 0, None
        for batch in batches:
            ids, nulls = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            sizes = batch.column("bytes").to_numpy()
            cuts += [(None, max(1, -(-int(n) // batch_bytes))) for n in sizes[nulls]]
            ids, sizes = ids[~nulls], sizes[~nulls]
            sums, at, before = np.cumsum(sizes), 0, 0
            while at < len(ids):
                stop = int(np.searchsorted(sums, before + batch_bytes - held, "right"))
                if stop > at:
                    held, last = held + int(sums[stop - 1] - before), int(ids[stop - 1])
                    before, at = int(sums[stop - 1]), stop
                elif last is not None:
                    cuts.append((last, 1))
                    held, last = 0, None
                else:
                    cuts.append((int(ids[at]), -(-int(sizes[at]) // batch_bytes)))
                    before, at = int(sums[at]), at + 1
        if last is not None:
            cuts.append((last, 1))
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cuts], pa.int64()), pa.array([c[1] for c in cuts], pa.int32())], names=["last", "pieces"])

    width = min(shuffle_width(docs.sparkSession), max(1, -(-total // batch_bytes)))
    cuts = of_id.repartitionByRange(width, "doc_id").sortWithinPartitions("doc_id").mapInArrow(cut, "last long, pieces int").toArrow()
    drop_table(of_id)
    nulls, some = cuts.filter(pc.is_null(cuts.column("last"))), cuts.filter(pc.is_valid(cuts.column("last"))).sort_by("last")
    pieces = np.concatenate([t.column("pieces").to_numpy() for t in (some, nulls)]).astype(np.int64)
    return Ranges(some.column("last").to_numpy(), pieces, max(1, batch_bytes // 8)), total


def packed(rows: DataFrame, ranges: Ranges | None = None) -> DataFrame:
    """(batch, payload): the documents of a batch that one task has, as compressed Arrow streams.

    The batch is a column, or follows from ``doc_id`` by ``ranges``. A few
    rows per task and batch are dealt instead of one per document, and texts
    next to each other compress well.
    """
    names = [c for c in rows.columns if c != "batch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        before = TaskContext.get().partitionId() * 0x9E3779B1  # tasks begin at different batches of an id that has several
        for piece in bounded(batches, "text", 4 << 20):
            if ranges is None:
                number = piece.column("batch").to_numpy()
            else:
                sizes = pc.binary_length(piece.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                number = ranges.batches(piece.column("doc_id"), sizes, before)
                before += int(sizes.sum())
            order = np.argsort(number, kind="stable")
            cuts = np.append(group_starts(number[order]), len(order)).tolist()
            documents = pa.Table.from_batches([piece.select(names)])
            ids, payloads = [], []
            for a, b in zip(cuts, cuts[1:]):
                some = documents.take(pa.array(order[a:b])).combine_chunks()
                for part in bounded(some.to_batches(), "text", 1 << 18):  # rows of a few hundred KB are large objects to the JVM
                    out = pa.BufferOutputStream()
                    with pa.ipc.new_stream(out, part.schema, options=options) as stream:
                        stream.write_batch(part)
                    ids.append(int(number[order[a]]))
                    payloads.append(out.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(payloads, pa.binary())], names=["batch", "payload"])

    return text_batches(rows).mapInArrow(run, "batch int, payload binary")


def unpacked(table: pa.Table) -> pa.Table:
    """The documents of one batch; there must be some."""
    give_back()
    return pa.concat_tables([pa.ipc.open_stream(p.as_buffer()).read_all() for p in table.column("payload").combine_chunks()]).combine_chunks()


def exchange_table(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})


def merged(blobs: list[bytes], sources: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of the blobs in ascending order, each with its source; equal hashes in any order."""
    lists = [unpack(b) for b in blobs]
    hashes = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
    source = np.repeat(np.array(sources, np.int32), [len(x) for x in lists])
    at = np.argsort(hashes)
    return hashes[at], source[at]


def by_source(source: np.ndarray) -> np.ndarray:
    """A stable order by source; up to 16 bits numpy sorts by radix."""
    return np.argsort(source.astype(np.uint16) if len(source) and source.max() < 1 << 16 else source, kind="stable")


def group_starts(sorted_: np.ndarray) -> np.ndarray:
    """Index of the first of each run of equal values."""
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)


def column_list(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def one_table(tables: Iterator[pa.Table]) -> pa.Table:
    return pa.concat_tables(list(tables))
