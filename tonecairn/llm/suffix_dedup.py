"""Exact dedup of long repeated byte strings with suffix arrays.

Every string of ``size`` bytes holds one anchor: of its substrings of ``GRAM``
bytes the first with the least hash. Equal strings have equal anchors at equal
offsets, so a string can only repeat where its anchor repeats. The strings of
one anchor are consecutive and make one context.

1. Batches of documents exchange the hashes of their distinct anchors and
   contexts, a context by hashes of two families. Strings of a context that
   occurs twice, with equal hashes of anchor and both families, all repeat;
   those of an anchor that occurs once do not.
2. The other contexts of a repeated anchor meet in one task. Each is cut into
   cells at fixed distances from its anchor; one suffix array of all cells,
   built by linear grouping, and its adjacent prefixes decide: two strings are
   equal where their suffixes are in one group of equal whole cells and the
   few bytes before and after those cells are equal, too. Nothing is hashed
   here; hashes have only brought the contexts together.
3. Each batch marks the bytes of its repeated strings.

Contexts of an anchor that has more than ``hot_contexts`` of them are too many
for one task: their strings are exchanged by their own hashes, of two
families, which spread over all tasks, and compared that way.

Defined results
---------------
* null or empty text: no bytes, nothing removed, the digest of no bytes;
* texts shorter than ``size`` keep all; matches never cross documents; very long texts are scanned whole, in a batch of at least their size;
* every copy of a repeated string is removed, also in rows that repeat a
  document as a whole and within one document;
* ids play no part but to be returned: null and equal ids are kept as they are;
* empty table: no rows; other input columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hash_exchange import column_list, exchange_table, group_starts, pack, packed, part_runs, sizes_of, unpack, unpacked
from .shared import keep_table, read_table, shuffle_width
from .suffix_groups import adjacent_prefixes, prefix_groups, suffix_array
from .text_blocks import TAILS, covered, eight_bytes, long_window_hashes, mix, mix_second, range_hashes, text_bytes, whole_windows

SIZE = 200
GRAM = 100
CELL = 8
_U = np.uint64
_SLICE = 1 << 20
_POSITION = _U((1 << 24) - 1)
# what becomes of a context
_ALONE, _ALL, _COMPARED, _JUDGED, _HOT_COMPARED, _HOT_JUDGED = range(6)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(values)
    full = np.full(-(-n // width) * width, ~_U(0))
    full[:n] = values
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class _Contexts:
    """Anchors of one batch: position, hash, first and last string, hash of the context; and the order of the distinct ones."""

    def __init__(self, column: pa.Array, size: int) -> None:
        self.raw, self.offsets = text_bytes(column)
        raw, n = self.raw, len(self.raw)
        whole = whole_windows(self.offsets, size)
        width = size - GRAM + 1
        runs: list[list[np.ndarray]] = [[], [], [], []]
        for a in range(0, max(n - size + 1, 0), _SLICE):
            piece = raw[a : min(a + _SLICE + size - 1, n)]
            hashes = long_window_hashes(piece.astype(_U) + _U(1), GRAM)
            packed = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=_U)
            anchor = (_sliding_least(packed, width) & _POSITION).astype(np.int64)
            start = np.flatnonzero(whole[a : a + len(anchor)])
            if not len(start):
                continue
            anchor = anchor[start]
            new = np.ones(len(start), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(start)) - 1
            for out, values in zip(runs, (anchor[first] + a, hashes[anchor[first]], start[first] + a, start[last] + a), strict=True):
                out.append(values)
        anchor, hashes, first, last = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in runs)
        hashes = hashes.astype(_U)
        if len(anchor):  # a run that a slice has cut
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (first[1:] != last[:-1] + 1)
            at = np.flatnonzero(new)
            anchor, hashes, first, last = anchor[at], hashes[at], first[at], last[np.append(at[1:], len(new)) - 1]
        # the least hashes of many are all small: mixed anew they spread evenly over the parts
        self.anchor, self.hash, self.first, self.last, self.size = anchor, mix(hashes ^ _U(0x2545F4914F6CDD1D)), first, last, size
        shape = mix(((last - first) * 4096 + (anchor - first)).astype(_U) + _U(1))
        self.context = mix(range_hashes(raw, first, last + size, long=2 * size) + shape)
        self.second = mix_second(range_hashes(raw, first, last + size, second=True, long=2 * size) + shape)
        self.order = np.lexsort((self.second, self.context, self.hash))
        h, c, d = self.hash[self.order], self.context[self.order], self.second[self.order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])
        self.starts = np.flatnonzero(new)
        self.distinct = self.order[self.starts]

    def of_distinct(self, values: np.ndarray) -> np.ndarray:
        """Spread a value of each distinct context to all contexts."""
        out = np.empty(len(self.order), values.dtype)
        out[self.order] = np.repeat(values, np.diff(np.append(self.starts, len(self.order))))
        return out

    def string_keys(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, key, second key) of all strings of the contexts ``which``; keys hold the string, its anchor and their distance."""
        count = self.last[which] - self.first[which] + 1
        ends = np.cumsum(count)
        start = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[which] - (ends - count), count)
        sums, more = (range_hashes(self.raw, start, start + self.size, second, 2 * self.size) for second in (False, True))
        where = np.repeat(self.hash[which], count) + (np.repeat(self.anchor[which], count) - start).astype(_U)
        return start, mix(sums + mix(where)), mix_second(more + mix_second(where))


def _send_anchors(parts: int, size: int):
    def run(table: pa.Table) -> pa.Table:
        x = _Contexts(unpacked(table).column("text").combine_chunks(), size)
        hashes, contexts, seconds = (v[x.distinct] for v in (x.hash, x.context, x.second))
        often = np.minimum(np.diff(np.append(x.starts, len(x.order))), 2).astype(np.uint8)
        batch = table.column("batch")[0].as_py()
        full = part_runs(hashes, parts)
        return exchange_table(
            {
                "part": ([p for p, _, _ in full], pa.int32()),
                "batch": ([batch] * len(full), pa.int32()),
                "anchors": ([pack(hashes[a:b]) for _, a, b in full], pa.binary()),
                "contexts": ([contexts[a:b].tobytes() for _, a, b in full], pa.binary()),
                "seconds": ([seconds[a:b].tobytes() for _, a, b in full], pa.binary()),
                "often": ([often[a:b].tobytes() for _, a, b in full], pa.binary()),
            }
        )

    return run


def _decide(hot_contexts: int):
    """Per batch and part the fate of every context, in the order that the batch sent them."""

    def run(table: pa.Table) -> pa.Table:
        lists = [unpack(b) for b in column_list(table, "anchors")]
        sizes = [len(x) for x in lists]
        anchors = np.concatenate(lists)
        contexts, seconds = (np.frombuffer(b"".join(column_list(table, k)), _U) for k in ("contexts", "seconds"))
        often = np.frombuffer(b"".join(column_list(table, "often")), np.uint8).astype(np.int64)
        order = np.lexsort((seconds, contexts, anchors))
        a, c, d, o = anchors[order], contexts[order], seconds[order], often[order]
        fate = np.zeros(len(order), np.uint8)
        if len(order):
            new_a = np.concatenate([[True], a[1:] != a[:-1]])
            new_c = new_a | np.concatenate([[True], (c[1:] != c[:-1]) | (d[1:] != d[:-1])])
            start_c = np.flatnonzero(new_c)
            each = np.add.reduceat(o, start_c)
            single = each == 1
            of_a = np.cumsum(new_a) - 1
            anchor_of_c = of_a[start_c]
            n_a = int(of_a[-1]) + 1
            total = np.bincount(of_a, o, n_a)
            singles = np.bincount(anchor_of_c, single, n_a)
            kinds = np.bincount(anchor_of_c, minlength=n_a)
            hot = (kinds > hot_contexts)[anchor_of_c]
            judged = np.where(hot, _HOT_JUDGED, _JUDGED)
            compared = np.where(singles[anchor_of_c] > 0, np.where(hot, _HOT_COMPARED, _COMPARED), _ALL)
            of_c = np.where(total[anchor_of_c] == 1, _ALONE, np.where(single, judged, _ALL)).astype(np.uint8)
            fate[order] = np.repeat(of_c, np.diff(np.append(start_c, len(order))))
            fate[order[start_c[~single]]] = compared[~single]  # one copy is enough to compare with
        cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        return exchange_table(
            {
                "batch": (column_list(table, "batch"), pa.int32()),
                "part": (column_list(table, "part"), pa.int32()),
                "fates": ([fate[p:q].tobytes() for p, q in zip(cuts, cuts[1:])], pa.binary()),
            }
        )

    return run


_SENT = "part int, batch int, anchors binary, shapes binary, judged binary, bytes binary"


def _fates_of(answers: pa.Table) -> np.ndarray:
    rows = sorted(zip(column_list(answers, "part"), column_list(answers, "fates"), strict=True))
    return np.frombuffer(b"".join(r[1] for r in rows), np.uint8)


def _send_contexts(parts: int, size: int):
    """Bytes of the contexts that must be compared, to the part of their anchor; for hot anchors keys of their strings."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, tuple[list, pa.DataType]] = {k: ([], t) for k, t in (("part", pa.int32()), ("batch", pa.int32()), *((k, pa.binary()) for k in ("anchors", "shapes", "judged", "bytes")))}
        if not table.num_rows or not answers.num_rows:
            return exchange_table(out)
        x = _Contexts(unpacked(table).column("text").combine_chunks(), size)
        fates, batch = _fates_of(answers), table.column("batch")[0].as_py()
        pick = (fates == _COMPARED) | (fates == _JUDGED)
        which, judged = x.distinct[pick], fates[pick] == _JUDGED
        for p, a, b in part_runs(x.hash[which], parts):
            rows = which[a:b]
            first, last, anchor = x.first[rows], x.last[rows], x.anchor[rows]
            data = [x.raw[s:t].tobytes() for s, t in zip(first.tolist(), (last + size).tolist(), strict=True)]
            shapes = np.stack([anchor - first, last - first + 1], 1).astype(np.uint16)
            values = (p, batch, pack(x.hash[rows]), shapes.tobytes(), judged[a:b].tobytes(), b"".join(data))
            for (column, _), value in zip(out.values(), values, strict=True):
                column.append(value)
        hot = np.flatnonzero((fates == _HOT_COMPARED) | (fates == _HOT_JUDGED))
        if len(hot):
            _, keys, more = x.string_keys(x.distinct[hot])
            order = np.lexsort((more, keys))
            keys, more = keys[order], more[order]
            few = np.concatenate([[True, True], (keys[2:] != keys[:-2]) | (more[2:] != more[:-2])])[: len(keys)]  # two are as good as more
            keys, more = keys[few], more[few]
            for p, a, b in part_runs(keys, parts):
                for (column, _), value in zip(out.values(), (parts + p, batch, pack(keys[a:b]), None, None, more[a:b].tobytes()), strict=True):
                    column.append(value)
        return exchange_table(out)

    return run


def repeated_strings(anchors: np.ndarray, shapes: np.ndarray, data: np.ndarray, size: int) -> np.ndarray:
    """Of all strings of the contexts, in order, whether another context of the same anchor has it.

    ``anchors``: hash of each context's anchor; ``shapes``: the anchor's distance
    from the context's start and the number of strings; ``data``: the contexts' bytes.
    """
    back, count = shapes[:, 0].astype(np.int64), shapes[:, 1].astype(np.int64)
    length = count + size - 1
    base = np.cumsum(length) - length
    # cells: full ones at multiples of CELL from the anchor; an end mark after each context
    skip = back % CELL
    cells = (length - skip) // CELL
    owner = np.repeat(np.arange(len(cells)), cells + 1)
    first_cell = np.cumsum(cells + 1) - (cells + 1)
    nth = np.arange(len(owner)) - first_cell[owner]
    at = base[owner] + skip[owner] + nth * CELL
    end = nth == cells[owner]
    full = np.flatnonzero(~end)
    view = eight_bytes(data)
    # a cell's symbol is the rank of its bytes, its anchor and its distance from that: equal only where all are
    number = np.unique(anchors, return_inverse=True)[1]
    of = owner[full]
    place = number[of] * 256 + nth[full] - back[of] // CELL + 128
    bytes_ = view[at[full]]
    order = np.lexsort((bytes_, place))
    new = np.ones(len(full), bool)
    new[1:] = (bytes_[order[1:]] != bytes_[order[:-1]]) | (place[order[1:]] != place[order[:-1]])
    symbol = np.empty(len(owner), np.int64)
    symbol[full[order]] = np.cumsum(new)
    symbol[end] = len(full) + 1 + np.arange(len(count))  # no end mark equals another
    sorted_ = suffix_array(symbol)
    shared = adjacent_prefixes(symbol, sorted_, size // CELL)
    # a string of the context: the whole cells inside it, what precedes them and what follows
    of = np.repeat(np.arange(len(count)), count)
    offset = np.arange(len(of)) - (np.cumsum(count) - count)[of]
    lead = (skip[of] - offset) % CELL
    first = first_cell[of] + (offset + lead - skip[of]) // CELL
    start = base[of] + offset
    out = np.zeros(len(of), bool)
    for width in range(CELL):
        some = np.flatnonzero(lead == width)
        whole = (size - width) // CELL
        rest = size - width - whole * CELL
        group = prefix_groups(sorted_, shared, whole)[first[some]]
        often = np.bincount(group)[group] > 1
        some, group = some[often], group[often]
        before, after = view[start[some]] & TAILS[width], view[start[some] + size - rest] & TAILS[rest]
        order = np.lexsort((before, after, group))
        equal = np.zeros(len(some) + 1, bool)
        a, b = order[1:], order[:-1]
        equal[1:-1] = (group[a] == group[b]) & (before[a] == before[b]) & (after[a] == after[b])
        out[some[order]] = equal[1:] | equal[:-1]
    return out


_ANSWER = "batch int, part int, strings binary"


def _compare(parts: int, size: int):
    """Per batch: bits of the strings of its judged contexts, or for hot anchors the keys of the repeated strings."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(column_list(table, "batch"), kind="stable")
        table = table.take(pa.array(order))
        batches, part = column_list(table, "batch"), table.column("part")[0].as_py()
        lists = [unpack(b) for b in column_list(table, "anchors")]
        sizes = np.array([len(x) for x in lists])
        hashes = np.concatenate(lists)
        if part >= parts:
            more = np.frombuffer(b"".join(column_list(table, "bytes")), _U)
            at = np.lexsort((more, hashes))
            new = np.ones(len(at), bool)
            new[1:] = (hashes[at][1:] != hashes[at][:-1]) | (more[at][1:] != more[at][:-1])
            times = np.diff(np.append(np.flatnonzero(new), len(at)))
            many = np.empty(len(hashes), bool)
            many[at] = np.repeat(times > 1, times)
            cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            answers = [np.stack([v[a:b][many[a:b]] for v in (hashes, more)]).tobytes() for a, b in zip(cuts, cuts[1:])]
        else:
            shapes = np.frombuffer(b"".join(column_list(table, "shapes")), np.uint16).reshape(-1, 2)
            judged = np.frombuffer(b"".join(column_list(table, "judged")), bool)
            data = np.frombuffer(b"".join(column_list(table, "bytes")), np.uint8)
            # the contexts of an anchor next to each other, in pieces that bound the memory
            by_anchor = np.argsort(hashes, kind="stable")
            count = shapes[:, 1].astype(np.int64)
            length = count + size - 1
            base = np.cumsum(length) - length
            piece_of = np.cumsum(length[by_anchor]) // (3 << 20)
            changes = group_starts(hashes[by_anchor])
            piece = np.repeat(piece_of[changes], np.diff(np.append(changes, len(by_anchor))))
            first = np.cumsum(count) - count
            repeated = np.zeros(int(count.sum()), bool)
            cuts = np.append(group_starts(piece), len(piece)).tolist()
            for a, b in zip(cuts, cuts[1:]):
                rows = by_anchor[a:b]
                spread = lambda start, n: np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)
                found = repeated_strings(hashes[rows], shapes[rows], data[spread(base[rows], length[rows])], size)
                repeated[spread(first[rows], count[rows])] = found
            wanted = np.repeat(judged, count)
            batch_of = np.repeat(np.repeat(np.arange(len(sizes)), sizes), count)
            answers = [np.packbits(repeated[(batch_of == k) & wanted]).tobytes() for k in range(len(sizes))]
        return exchange_table({"batch": (batches, pa.int32()), "part": ([part] * len(batches), pa.int32()), "strings": (answers, pa.binary())})

    return run


_REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _mark(parts: int, size: int, with_bytes: bool):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
        if not table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in zip(names, types, strict=True)})
        table = unpacked(table)
        x = _Contexts(table.column("text").combine_chunks(), size)
        n = len(x.raw)
        decided = answers.filter(pa.compute.is_valid(answers.column("fates")))
        compared = answers.filter(pa.compute.is_valid(answers.column("strings")))
        starts = [np.zeros(0, np.int64)]
        if decided.num_rows:
            fates = _fates_of(decided)
            fate = x.of_distinct(fates)
            spread = lambda which: _positions(x.first[which], x.last[which])
            starts.append(spread(np.flatnonzero((fate == _ALL) | (fate == _COMPARED) | (fate == _HOT_COMPARED))))
            bits, keys = {}, []
            for part, raw in zip(column_list(compared, "part"), column_list(compared, "strings"), strict=True):
                if part < parts:
                    bits[part] = raw
                else:
                    keys.append(np.frombuffer(raw, _U).reshape(2, -1))
            judged = x.distinct[fates == _JUDGED]
            for p, a, b in part_runs(x.hash[judged], parts):
                where = spread(judged[a:b])
                starts.append(where[np.unpackbits(np.frombuffer(bits[p], np.uint8), count=len(where)).astype(bool)])
            hot = np.flatnonzero(fate == _HOT_JUDGED)
            if len(hot) and keys:
                known = np.hstack(keys)
                known = known[:, np.lexsort(known[::-1])]
                where, own, more = x.string_keys(hot)
                at, stop = (np.searchsorted(known[0], own, side) for side in ("left", "right"))
                again, open_ = np.zeros(len(own), bool), np.arange(len(own))
                while len(open_ := open_[(at[open_] < stop[open_]) & ~again[open_]]):  # equal first keys stand next to each other
                    again[open_] = known[1][at[open_]] == more[open_]
                    at[open_] += 1
                starts.append(where[again])
        gone = covered(np.concatenate(starts), size, n)
        total = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inside = x.offsets[:-1][x.offsets[:-1] < n]
        begins[inside] |= gone[inside]
        runs = np.concatenate([[0], np.cumsum(begins)])
        digests, kept = [], []
        left = x.raw[~gone].tobytes()
        cuts = (x.offsets - total[x.offsets]).tolist()
        for a, b in zip(cuts, cuts[1:]):
            digests.append(hashlib.sha256(left[a:b]).hexdigest())
            kept.append(left[a:b] if with_bytes else None)
        columns = (table.column("doc_id").combine_chunks(), np.diff(x.offsets), np.diff(total[x.offsets]), np.diff(runs[x.offsets]), digests, kept)
        return pa.table({k: c if isinstance(c, pa.Array) else pa.array(c, t) for k, c, t in zip(names, columns, types, strict=True)})

    return run


def _positions(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    count = last - first + 1
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)


def remove_repeated_strings(docs: DataFrame, size: int = SIZE, with_bytes: bool = True, batch_bytes: int = 4 << 20, hot_contexts: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (null without ``with_bytes``) of every document."""
    _, total = sizes_of(docs)
    count = max(1, -(-total // batch_bytes))
    parts = max(1, min(4 * count, -(-total // (16 << 20))))
    rows = docs.select(
        F.pmod(F.xxhash64(F.col("doc_id"), "text"), F.lit(count)).cast("int").alias("batch"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    batches = packed(rows)
    sent = batches.groupBy("batch").applyInArrow(_send_anchors(parts, size), "part int, batch int, anchors binary, contexts binary, seconds binary, often binary")
    fates = keep_table(sent.groupBy("part").applyInArrow(_decide(hot_contexts), "batch int, part int, fates binary"), "fates")
    contexts = batches.groupBy("batch").cogroup(fates.groupBy("batch")).applyInArrow(_send_contexts(parts, size), _SENT)
    # a set number of tasks: few bytes make much work here, so small partitions must not be joined
    tasks = min(parts, 4 * shuffle_width(docs.sparkSession))
    compared = contexts.repartition(tasks, "part").groupBy("part").applyInArrow(_compare(parts, size), _ANSWER)
    answers = fates.withColumn("strings", F.lit(None).cast("binary")).unionByName(compared.withColumn("fates", F.lit(None).cast("binary")))
    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_mark(parts, size, with_bytes), _REMOVED)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 200-byte strings that occur elsewhere."""
    done = remove_repeated_strings(read_table(spark, sf_dir, "documents"), with_bytes=False)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
