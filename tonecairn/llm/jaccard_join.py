"""Exact Jaccard join of documents by their sets of word shingles, with set-relation skipping.

Equal sets are one class. Shingles that a single batch and set has can't be
shared, so batches exchange their distinct shingles once; a set with too few
shared shingles has no partner. The others are indexed under a prefix of their
shared shingles, rarest first. An index list is sorted by set size and cut
into blocks; whole blocks are skipped by size and by the position of the
shingle in the sets, single pairs by size, position and a parity sketch whose
Hamming distance never exceeds the sets' difference.

Links are found in two rounds, so that a group of many similar sets costs one
verification for each set and not one for each pair:

1. each list's sets are verified against its hub, the set with the smallest
   share of shingles of its own;
2. pairs of sets in different components so far are decided; the sets of a long
   list are parted into blocks, and its pairs of blocks are lists of their own. From the known
   distances of both sets to a common hub the answer is often derived (the
   distances bound the pair's); what is left is verified.

The result names the component of every document. Links within a component
that rounds 1 and 2 leave out are not needed for that; where the number of
links is asked for, all pairs of a component's sets are decided, block by
block, and counted for each set: the answers of one set of a block are
computed and those of the others derived from them by the differences of the
sets, which are small where sets are similar.

Defined results
---------------
* fewer words than a shingle: the whole sequence is the one shingle; null or
  empty texts have no shingle and link with nothing, not even each other;
* null id: sorts after all others; component_id is null where all ids are;
* equal ids with other texts are documents of their own; repeated rows link;
* texts of any length; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected
from .hash_exchange import by_source, column_list, exchange_table, group_starts, pack, packed, part_runs, sizes_of, unpack, unpacked
from .shared import free_name, keep_table, read_table, shuffle_width
from .text_blocks import Words, lowered, mix, text_bytes, whole_windows, window_hashes

SHINGLE = 5
SIMILAR = (75, 100)
SKETCH_WORDS = 16
LINK_BLOCK = 256
_U = np.uint64


class _Sets:
    """Distinct shingles of every document of one batch, ascending by hash and then by document."""

    def __init__(self, column: pa.Array, size: int) -> None:
        raw, offsets = text_bytes(column)
        words = Words(lowered(raw), offsets)
        n_docs = len(offsets) - 1
        at = np.flatnonzero(whole_windows(words.bounds, size))
        hashes, doc = window_hashes(words.hash, size)[at], words.doc[at]
        count = np.diff(words.bounds)
        for length in range(1, size):  # a whole short text is one shingle
            few = np.flatnonzero(count == length)
            if len(few):
                run = words.hash[words.bounds[few][:, None] + np.arange(length)]
                whole = np.full(len(few), _U(length))
                for k in range(length):
                    whole = mix(whole * _U(0x9E3779B97F4A7C15) + run[:, k])
                hashes, doc = np.concatenate([hashes, whole]), np.concatenate([doc, few])
        order = np.argsort(hashes)
        hashes, doc = hashes[order], doc[order]
        tied = np.zeros(len(hashes) + 1, bool)  # equal to the one before
        tied[1:-1] = hashes[1:] == hashes[:-1]
        some = np.flatnonzero(tied[:-1] | tied[1:])
        if len(some):  # documents in order within equal hashes
            run = np.cumsum(~tied[:-1])[some]
            doc[some] = np.sort(run * n_docs + doc[some]) % n_docs
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        self.hash, self.doc = hashes[new], doc[new]
        self.size = np.bincount(self.doc, minlength=n_docs)
        total = np.zeros(n_docs, _U)
        np.add.at(total, self.doc, mix(self.hash ^ _U(0x5851F42D4C957F2D)))
        self.key = mix(total + self.size.astype(_U) * _U(0x9E3779B97F4A7C15)).view(np.int64)
        self.starts = group_starts(self.hash)


def _first_of_class(sets: _Sets) -> np.ndarray:
    first = np.zeros(len(sets.size), bool)
    first[np.unique(sets.key, return_index=True)[1]] = True
    return first & (sets.size > 0)


def _batched(docs: DataFrame, batch_bytes: int) -> tuple[DataFrame, int, int]:
    _, total = sizes_of(docs)
    count = max(1, -(-total // batch_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(count)).cast("int")), count, total


_SHARED = {"batch": pa.int32(), "shingles": pa.binary(), "rarity": pa.binary()}


def _code_bits(total_bytes: int) -> int:
    """Leading hash bits by which shared shingles are found: so many that one shingle in some thousands is taken for another.

    That costs a little pruning and no link; sets are compared by whole hashes.
    """
    return min(64, 10 + max(total_bytes, 1).bit_length())


def _level(count: np.ndarray) -> np.ndarray:
    """A count as one byte, an eighth of a doubling to a step; exact up to 2."""
    return np.minimum(np.rint(8 * np.log2(np.maximum(count, 1))), 255).astype(np.uint8)


def _count(level: np.ndarray) -> np.ndarray:
    return 2.0 ** (level / 8)


def _shared_shingles(batches: DataFrame, parts: int, size: int, bits: int) -> DataFrame:
    """(batch, shingles, rarity): the shingle codes of each batch that two sets have, and a byte that grows with their number."""

    def send(table: pa.Table) -> pa.Table:
        sets = _Sets(unpacked(table).column("text").combine_chunks(), size)
        one = _first_of_class(sets)[sets.doc]
        hashes = sets.hash[one] >> _U(64 - bits)
        starts = group_starts(hashes)
        distinct = hashes[starts]
        often = _level(np.diff(np.append(starts, len(hashes))))
        batch = table.column("batch")[0].as_py()
        full = part_runs(distinct, parts, bits)
        return exchange_table(
            {
                "part": ([p for p, _, _ in full], pa.int32()),
                "batch": ([batch] * len(full), pa.int32()),
                "shingles": ([pack(distinct[a:b]) for _, a, b in full], pa.binary()),
                "often": ([often[a:b].tobytes() for _, a, b in full], pa.binary()),
            }
        )

    def meet(table: pa.Table) -> pa.Table:
        sources = column_list(table, "batch")
        blobs, counts = column_list(table, "shingles"), column_list(table, "often")
        lists = [unpack(b) for b in blobs]
        hashes = np.concatenate(lists)
        often = _count(np.frombuffer(b"".join(counts), np.uint8))
        source = np.repeat(np.array(sources, np.int32), [len(x) for x in lists])
        order = np.argsort(hashes)
        hashes, often, source = hashes[order], often[order], source[order]
        starts = group_starts(hashes)
        total = np.add.reduceat(often, starts) if len(starts) else often
        each = np.repeat(total, np.diff(np.append(starts, len(hashes))))
        keep = each > 1.5
        rarity = _level(each)
        hashes, source, rarity = hashes[keep], source[keep], rarity[keep]
        order = by_source(source)
        hashes, source, rarity = hashes[order], source[order], rarity[order]
        cuts = np.append(group_starts(source), len(source)).tolist()
        rows = [(int(source[a]), pack(hashes[a:b]), rarity[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
        return exchange_table({k: ([r[i] for r in rows], t) for i, (k, t) in enumerate(_SHARED.items())})

    sent = batches.groupBy("batch").applyInArrow(send, "part int, batch int, shingles binary, often binary")
    return sent.groupBy("part").applyInArrow(meet, "batch int, shingles binary, rarity binary")


_SETS = {
    "doc_id": pa.int64(), "text_hash": pa.int64(), "n_shingles": pa.int64(), "class": pa.int64(), "shared": pa.binary(), "prefix": pa.binary(), "rarity": pa.binary(),
    "first_position": pa.int32(), "sketch": pa.binary(),
}
_SETS_DDL = "doc_id long, text_hash long, n_shingles long, class long, shared binary, prefix binary, rarity binary, first_position int, sketch binary"


def _classify(size: int, share: tuple[int, int], bits: int):
    """All documents with size and class; the first of each class also with what the join needs, if it may have a partner."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return exchange_table({k: ([], t) for k, t in _SETS.items()})
        table = unpacked(table)
        sets = _Sets(table.column("text").combine_chunks(), size)
        blobs, codes = column_list(answers, "shingles"), column_list(answers, "rarity")
        known = np.concatenate([unpack(b) for b in blobs]) if blobs else np.zeros(0, _U)
        rarity = np.frombuffer(b"".join(codes), np.uint8)
        order = np.argsort(known)
        known, rarity = known[order], rarity[order]
        n_docs = len(sets.size)
        columns: dict[str, list] = {k: [None] * n_docs for k in ("shared", "prefix", "rarity", "first_position", "sketch")}
        if len(known):
            distinct = sets.hash[sets.starts] >> _U(64 - bits)
            at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
            there = known[at] == distinct
            span = np.diff(np.append(sets.starts, len(sets.hash)))
            shared, rare = np.repeat(there, span), np.repeat(rarity[at], span)
            hashes, doc, rare = sets.hash[shared], sets.doc[shared], rare[shared]
            have = np.bincount(doc, minlength=n_docs)
            wanted = -(-sets.size * share[0] // share[1])
            go = (have >= wanted) & _first_of_class(sets)
            live = go[doc]
            hashes, doc, rare = hashes[live], doc[live], rare[live]
            order = np.argsort(doc, kind="stable")
            hashes, doc, rare = hashes[order], doc[order], rare[order]
            cuts = np.searchsorted(doc, np.arange(n_docs + 1)).tolist()
            for d in np.flatnonzero(go).tolist():
                mine = hashes[cuts[d] : cuts[d + 1]]
                by_rarity = np.argsort(rare[cuts[d] : cuts[d + 1]], kind="stable")
                columns["shared"][d] = pack(mine)
                picked = by_rarity[: len(mine) - int(wanted[d]) + 1]
                columns["prefix"][d], columns["rarity"][d] = mine[picked].tobytes(), rare[cuts[d] + picked].tobytes()
                columns["first_position"][d] = int(sets.size[d]) - len(mine)
            every = go[sets.doc]
            bit = mix(sets.hash[every] ^ _U(0xD1B54A32D192ED03)) >> _U(64 - 10)
            key = sets.doc[every] * (SKETCH_WORDS * 64) + bit.astype(np.int64)
            odd, times = np.unique(key, return_counts=True)
            odd = odd[times % 2 == 1]
            sketch = np.zeros((n_docs, SKETCH_WORDS), _U)
            flat = sketch.reshape(-1)
            np.bitwise_or.at(flat, odd >> 6, _U(1) << (odd & 63).astype(_U))
            for d in np.flatnonzero(go).tolist():
                columns["sketch"][d] = sketch[d].tobytes()
        out = {k: table.column(k).to_pylist() for k in ("doc_id", "text_hash")} | {"n_shingles": sets.size.tolist(), "class": sets.key.tolist(), **columns}
        return exchange_table({k: (out[k], t) for k, t in _SETS.items()})

    return run


_ENTRY = {
    "class": np.int64, "n_shingles": np.int64, "first_position": np.int32, "label": np.int64, "hub": np.int64, "distance": np.int32,
}


def _lists_of(shingle: np.ndarray, block: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The key of an index list: a shingle, or a pair of blocks of a long shingle's sets."""
    return np.where((block == 0) & (other == 0), shingle, mix(shingle ^ mix((block.astype(_U) << _U(32)) + other.astype(_U))))


def _entries(classes: DataFrame, parts: int, most: int, paired: bool) -> DataFrame:
    """The index, packed: for each part that a batch of classes has list entries for, one row with those classes and entries.

    A shingle with more than ``most`` sets has several lists. For the first round its sets are only parted into blocks
    (by a bound on their number), for the second (``paired``) a set goes to every pair of blocks that its own is in (by
    their number, which round 1 has counted: ``long`` holds the shingles and numbers of the long lists that a class is in).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {k: batch.column(k).to_numpy().astype(t) for k, t in _ENTRY.items()}
            sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), _U).reshape(-1, SKETCH_WORDS)
            prefixes = [np.frombuffer(p, _U) for p in batch.column("prefix").to_pylist()]
            lengths = np.array([len(p) for p in prefixes], np.int64)
            shingle = np.concatenate(prefixes) if prefixes else np.zeros(0, _U)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            position = columns["first_position"][owner] + np.arange(len(owner)) - (np.cumsum(lengths) - lengths)[owner]
            count = _count(np.frombuffer(b"".join(batch.column("rarity").to_pylist()), np.uint8))
            if paired:
                exact = dict(zip(shingle[count > most].tolist(), [1] * int((count > most).sum())))
                for row in batch.column("long").to_pylist():
                    exact.update((x["shingle"] & (1 << 64) - 1, x["n"]) for x in row or ())
                hot = np.flatnonzero(count > most)
                count[hot] = [exact[x] for x in shingle[hot].tolist()]
            blocks = np.maximum(np.ceil(count / most), 1).astype(np.int64)
            own = (mix(columns["class"].astype(_U) ^ _U(0xA24BAED4963EE407))[owner] % blocks.astype(_U)).astype(np.int64)
            if paired:
                at = np.repeat(np.arange(len(owner)), blocks)
                other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                side = np.where(own[at] == other, 0, np.where(own[at] < other, 1, 2))
                lists = _lists_of(shingle[at], np.minimum(own[at], other), np.maximum(own[at], other))
                owner, position = owner[at], position[at]
            else:
                # with the numbers of its blocks a list is told from that of the shingle itself
                lists, side = np.where(blocks > 1, _lists_of(shingle, own, blocks), shingle), np.where(blocks > 1, 1, 0)
            of = (mix(lists) % _U(parts)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            starts = group_starts(of[order])
            rows: dict[str, list] = {k: [] for k in ("part", "lists", "sides", "owners", "positions", "shingles", *_ENTRY, "sketch")}
            for a, b in zip(starts.tolist(), np.append(starts[1:], len(order)).tolist()):
                here = order[a:b]
                some, who = np.unique(owner[here], return_inverse=True)
                rows["part"].append(int(of[here[0]]))
                rows["lists"].append(lists[here].tobytes())
                rows["sides"].append(side[here].astype(np.uint8).tobytes())
                rows["owners"].append(who.astype(np.int32).tobytes())
                rows["positions"].append(position[here].astype(np.int32).tobytes())
                rows["shingles"].append(None if paired else shingle[here[side[here] > 0]].tobytes())
                for k in _ENTRY:
                    rows[k].append(columns[k][some].tobytes())
                rows["sketch"].append(sketches[some].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k == "part" else pa.binary()) for k, v in rows.items()], names=list(rows))

    ddl = ", ".join(f"{k} binary" for k in ("lists", "sides", "owners", "positions", "shingles", *_ENTRY, "sketch"))
    return classes.select(*_ENTRY, "sketch", "prefix", "rarity", *(["long"] if paired else [])).mapInArrow(run, "part int, " + ddl)


class _Index:
    """The lists of one part, each sorted by set size."""

    def __init__(self, table: pa.Table) -> None:
        joined = lambda name, kind: np.frombuffer(b"".join(column_list(table, name)), kind)
        self.cls, self.size, self.own, self.label, self.hub, self.distance = (joined(k, t).astype(np.int64) for k, t in _ENTRY.items())
        self.sketch = joined("sketch", _U).reshape(-1, SKETCH_WORDS)
        counts = [len(x) // 8 for x in column_list(table, "class")]
        spans = [len(x) // 4 for x in column_list(table, "owners")]
        row = joined("owners", np.int32) + np.repeat(np.cumsum(counts) - counts, spans)
        lists, position, side = joined("lists", _U), joined("positions", np.int32).astype(np.int64), joined("sides", np.uint8)
        order = np.lexsort((self.cls[row], self.size[row], lists))
        self.row, self.position, self.side = row[order], position[order], side[order]
        starts = group_starts(lists[order])
        stops = np.append(starts[1:], len(order))
        many = stops - starts > 1
        self.lists = list(zip(starts[many].tolist(), stops[many].tolist(), strict=True))


def _allowed(a: np.ndarray, b: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """The largest size of the symmetric difference of similar sets of sizes a and b."""
    p, q = share
    least = -(-(a + b) * p // (p + q))  # overlap o with q * o >= p * (a + b - o)
    return a + b - 2 * least


def _may_link(x: _Index, i: np.ndarray, j: np.ndarray, at_i: np.ndarray, at_j: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Mask of pairs (rows i, j; shingle positions at_i, at_j) that no bound excludes."""
    a, b = x.size[i], x.size[j]
    room = _allowed(a, b, share)
    # at the first shingle that two sets share, no more can be common than what follows in both
    rest = np.minimum(a - at_i, b - at_j)
    ok = (np.minimum(a, b) * share[1] >= np.maximum(a, b) * share[0]) & (2 * rest >= a + b - room)
    where = np.flatnonzero(ok)
    if len(where):
        apart = np.bitwise_count(x.sketch[i[where]] ^ x.sketch[j[where]]).sum(1, dtype=np.int64)
        ok[where] = apart <= room[where]
    return ok


def _hub_pairs(share: tuple[int, int]):
    """Round 1: (a, b) with b the hub of a list that a is in; or a shingle, null and the number of its sets in a block."""

    def run(table: pa.Table) -> pa.Table:
        x = _Index(table)
        found = []
        for a, b in x.lists:
            rows, at = x.row[a:b], x.position[a:b]
            hub = np.lexsort((x.cls[rows], x.own[rows] / np.maximum(x.size[rows], 1)))[0]
            other = np.arange(len(rows)) != hub
            i, j = rows[other], np.full(len(rows) - 1, rows[hub])
            ok = _may_link(x, i, j, at[other], np.full(len(i), at[hub]), share)
            found.append(np.stack([x.cls[i[ok]], x.cls[j[ok]]], 1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        # how many sets each shingle has here whose sets are parted into blocks
        long, n = np.unique(np.frombuffer(b"".join(column_list(table, "shingles")), np.int64), return_counts=True)
        b = pa.concat_arrays([pa.array(pairs[:, 1], pa.int64()), pa.nulls(len(long), pa.int64())])
        return pa.table({"a": np.concatenate([pairs[:, 0], long]), "b": b, "n": np.concatenate([np.zeros(len(pairs), np.int64), n])})

    return run


def _cross_pairs(share: tuple[int, int], block: int = 512):
    """Round 2: pairs of different components; ``sure`` if the distances to a common hub already decide for a link."""

    def run(table: pa.Table) -> pa.Table:
        x = _Index(table)
        found, sure = [], []
        for start, stop in x.lists:
            rows, at = x.row[start:stop], x.position[start:stop]
            if (x.label[rows] == x.label[rows[0]]).all():
                continue
            size = x.size[rows]
            for a in range(0, len(rows), block):
                b = min(a + block, len(rows))
                # sizes ascend: later blocks are skipped from the first set on that is too large for all of this block
                end = int(np.searchsorted(size, size[b - 1] * share[1] // share[0], "right"))
                for c in range(a, end, block):
                    d = min(c + block, end)
                    most = min((size[a:b] - at[a:b]).max(), (size[c:d] - at[c:d]).max())
                    if most * (share[0] + share[1]) < (size[a] + size[c]) * share[0]:
                        continue  # every pair of the two blocks meets too late in its sets
                    i, j = np.meshgrid(np.arange(a, b), np.arange(c, d), indexing="ij")
                    side = x.side[start:stop]
                    go = (x.label[rows[i]] != x.label[rows[j]]) & (i < j) & ((side[i] == 0) | (side[i] != side[j]))
                    i, j = i[go], j[go]
                    if not len(i):
                        continue
                    ri, rj = rows[i], rows[j]
                    room = _allowed(size[i], size[j], share)
                    known = (x.hub[ri] == x.hub[rj]) & (x.distance[ri] >= 0) & (x.distance[rj] >= 0)
                    is_hub = (x.hub[ri] == x.cls[rj]) | (x.hub[rj] == x.cls[ri])  # decided in round 1
                    ok = ~is_hub & (~known | (np.abs(x.distance[ri] - x.distance[rj]) <= room))
                    i, j, ri, rj, known, room = i[ok], j[ok], ri[ok], rj[ok], known[ok], room[ok]
                    ok = _may_link(x, ri, rj, at[i], at[j], share)
                    ri, rj, known, room = ri[ok], rj[ok], known[ok], room[ok]
                    found.append(np.stack([x.cls[ri], x.cls[rj]], 1))
                    sure.append(known & (x.distance[ri] + x.distance[rj] <= room))
        if not found:
            return exchange_table({"a": ([], pa.int64()), "b": ([], pa.int64()), "sure": ([], pa.bool_())})
        pairs, first = np.unique(np.sort(np.concatenate(found), axis=1), axis=0, return_index=True)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "sure": np.concatenate(sure)[first]})

    return run


def _long_prefixes(classes: DataFrame, most: int) -> DataFrame:
    """(class, shingle) of the prefix shingles that may have more than ``most`` sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hot = [np.frombuffer(p, np.int64)[_count(np.frombuffer(r, np.uint8)) > most] for p, r in zip(batch.column("prefix").to_pylist(), batch.column("rarity").to_pylist(), strict=True)]
            owner = np.repeat(batch.column("class").to_numpy(), [len(x) for x in hot])
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(np.concatenate(hot) if hot else np.zeros(0, np.int64))], names=["class", "shingle"])

    return classes.select("class", "prefix", "rarity").mapInArrow(run, "class long, shingle long")


def _verified(pairs: DataFrame, classes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b, overlap, distance, linked) by intersecting the sets."""
    left = classes.select(F.col("class").alias("a"), F.col("n_shingles").alias("size_a"), F.col("shared").alias("set_a"))
    right = classes.select(F.col("class").alias("b"), F.col("n_shingles").alias("size_b"), F.col("shared").alias("set_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            overlap = []
            for b, p, q in zip(batch.column("b").to_pylist(), batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                if b not in kept:
                    if len(kept) > 64:
                        kept.clear()
                    kept[b] = unpack(q)
                mine, other = unpack(p), kept[b]
                at = np.minimum(np.searchsorted(other, mine), len(other) - 1)
                overlap.append(int((other[at] == mine).sum()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in ("a", "b", "size_a", "size_b")), pa.array(overlap, pa.int64())], names=["a", "b", "size_a", "size_b", "overlap"]
            )

    met = pairs.join(left, "a").join(right, "b").select("a", "b", "size_a", "size_b", "set_a", "set_b")
    counted = met.mapInArrow(run, "a long, b long, size_a long, size_b long, overlap long")
    union = F.col("size_a") + F.col("size_b") - F.col("overlap")
    return counted.select(
        "a", "b", "overlap", (union - F.col("overlap")).cast("int").alias("distance"), (F.col("overlap") * share[1] >= union * share[0]).alias("linked")
    )


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of another, by products of bounded stretches of the incidence matrices."""
    out = np.zeros((len(left), len(right)), np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    sides = []
    for hashes, sets in ((a, left), (b, right)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, hashes), max(len(both) - 1, 0))
        there = both[at] == hashes if len(both) else np.zeros(len(hashes), bool)
        order = np.argsort(at[there], kind="stable")
        sides.append((row[there][order], at[there][order]))
    for start in range(0, len(both), width):
        stretch = []
        for (row, at), sets in zip(sides, (left, right), strict=True):
            i, j = np.searchsorted(at, (start, start + width)).tolist()
            has = np.zeros((len(sets), min(width, len(both) - start)), np.float32)
            has[row[i:j], at[i:j] - start] = 1
            stretch.append(has)
        out += (stretch[0] @ stretch[1].T).astype(np.int64)
    return out


def _derived_overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The same as ``_overlaps``, derived from the answers of one set H that is like the others.

    H's overlap with a set X is the size of H less that of H - X. Two other sets share what H has and neither lacks, and
    what both have beyond H: only their differences to H are compared, and those of similar sets are small.
    """
    hub = left[0]
    lacks, more = [], []
    for sets in (left, right):
        there = [np.isin(hub, x, assume_unique=True) for x in sets]
        lacks.append([hub[~t] for t in there])
        more.append([x[~np.isin(x, hub, assume_unique=True)] for x in sets])
    answers = [len(hub) - np.array([len(x) for x in side], np.int64) for side in lacks]
    out = answers[0][:, None] + answers[1][None] - len(hub)
    for a, b in (lacks, more):
        if any(map(len, a)) and any(map(len, b)):
            out += _overlaps(a, b)
    return out


def _linked_members(share: tuple[int, int]):
    """(class, n) of every set of two blocks, or of one with itself: how many members the sets linked with it have."""

    def run(table: pa.Table) -> pa.Table:
        label, cls, size, members, side = (table.column(k).to_numpy() for k in ("label", "class", "n_shingles", "members", "side"))
        sets = [unpack(s) for s in column_list(table, "shared")]
        n = np.zeros(len(cls), np.int64)
        same = table.num_rows == 0 or table.column("p")[0].as_py() == table.column("q")[0].as_py()
        order = np.argsort(label, kind="stable")
        cuts = np.append(group_starts(label[order]), len(order)).tolist()
        for a, b in zip(cuts, cuts[1:]):
            here = order[a:b]
            left, right = (here, here) if same else (here[side[here] == 0], here[side[here] == 1])
            if not len(left) or not len(right):
                continue
            overlap = _derived_overlaps([sets[i] for i in left], [sets[i] for i in right])
            linked = overlap * share[1] >= (size[left][:, None] + size[right][None] - overlap) * share[0]
            if same:
                np.fill_diagonal(linked, False)
            else:
                n[right] += linked.T @ members[left]
            n[left] += linked @ members[right]
        return pa.table({"class": cls, "n": n})

    return run


def _link_counts(classes: DataFrame, labels: DataFrame, members: DataFrame, share: tuple[int, int], parts: int) -> DataFrame:
    """(class, others): the documents of other classes that a class is linked with. All links are within components."""
    of = labels.withColumnRenamed("node", "class")
    blocks = of.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / LINK_BLOCK).cast("int").alias("blocks"))
    x = classes.select("class", "n_shingles", "shared").join(of, "class").join(members, "class").join(blocks, "label")
    x = x.withColumns({"own": F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"), "large": F.col("blocks") > 1})
    # components of one block are dealt together, larger ones by pairs of blocks
    x = x.withColumn("cell", F.when(F.col("large"), F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(parts))))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("p"), F.greatest("own", o).alias("q"))))
    x = x.select("label", "class", "n_shingles", "members", "shared", "large", "cell", "own", pair.alias("pair"))
    x = x.select("label", "class", "n_shingles", "members", "shared", "large", "cell", "pair.*", (F.col("own") > F.col("pair.p")).cast("int").alias("side"))
    return x.groupBy("large", "cell", "p", "q").applyInArrow(_linked_members(share), "class long, n long").groupBy("class").agg(F.sum("n").alias("others"))


def similar_components(docs: DataFrame, size: int = SHINGLE, share: tuple[int, int] = SIMILAR, batch_bytes: int = 4 << 20, links: bool = False, part_bytes: int = 8 << 20, list_sets: int = 4096) -> DataFrame:
    """doc_id, text_hash, n_shingles, class, component_id and stays of every document.

    ``stays`` holds for the row with the smallest id and hash of its component (rows that repeat it, too). With ``links`` also n_links, the
    number of other rows that are similar to a row. A task holds about ``part_bytes`` of index lists, of at most about
    ``list_sets`` sets each.
    """
    spark = docs.sparkSession
    rows, count, total = _batched(docs, batch_bytes)
    batches = packed(rows)
    bits = _code_bits(total)
    answers = _shared_shingles(batches, max(1, min(4 * count, -(-total // (10 << 20)))), size, bits)
    table = keep_table(batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_classify(size, share, bits), _SETS_DDL), "sets")
    first = lambda name: F.first(name).alias(name)
    classes = keep_table(
        table.where("shared is not null").groupBy("class").agg(*(first(c) for c in ("n_shingles", "shared", "prefix", "rarity", "first_position", "sketch"))), "classes"
    )
    row_bytes = F.octet_length("prefix") * 2 + 8 * (SKETCH_WORDS + len(_ENTRY))
    parts = max(1, -(-(classes.agg(F.coalesce(F.sum(row_bytes), F.lit(0))).first()[0]) // part_bytes))
    none = classes.withColumns({"label": F.col("class"), "hub": F.col("class"), "distance": F.lit(-1)})
    hubs = keep_table(_entries(none, parts, list_sets, False).groupBy("part").applyInArrow(_hub_pairs(share), "a long, b long, n long"), "hubs", release=False)
    checked = keep_table(_verified(hubs.where("b is not null").select("a", "b").distinct(), classes, share), "checked")
    first_links = checked.where("linked").select("a", "b")
    labels = connected(first_links)
    nearest = checked.groupBy("a").agg(F.min_by(F.struct("b", "distance"), F.struct("distance", "b")).alias("near")).select(F.col("a").alias("class"), F.col("near.b").alias("hub"), F.col("near.distance").alias("distance"))
    known = (
        classes.join(labels.withColumnRenamed("node", "class"), "class", "left")
        .join(nearest, "class", "left")
        .withColumns({"label": F.coalesce("label", "class"), "hub": F.coalesce("hub", "class"), "distance": F.coalesce("distance", F.lit(-1))})
    )
    # the long lists that each class is in, with their number of sets
    sets_of = hubs.where("b is null").groupBy(F.col("a").alias("shingle")).agg(F.sum("n").alias("n")).where(F.col("n") > list_sets)
    long = _long_prefixes(classes, list_sets).join(sets_of, "shingle").groupBy("class").agg(F.collect_list(F.struct("shingle", "n")).alias("long"))
    known = known.join(long, "class", "left")
    crossed = keep_table(_entries(known, parts, list_sets, True).groupBy("part").applyInArrow(_cross_pairs(share), "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure")), "crossed")
    more = _verified(crossed.where("not sure").select("a", "b"), classes, share).where("linked").select("a", "b")
    labels = connected(first_links.union(crossed.where("sure").select("a", "b")).union(more))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")  # a null id comes after all others
    own = table.groupBy("class").agg(F.min(row).alias("least"), F.count(F.lit(1)).alias("members"))
    joined = own.join(labels.withColumnRenamed("node", "class"), "class", "left")
    least = joined.where("label is not null").groupBy("label").agg(F.min("least").alias("first"))
    of_class = joined.join(least, "label", "left").select("class", F.coalesce("first", "least").alias("first"), (F.col("members") - 1).alias("n_links"))
    if links:
        counts = _link_counts(classes, labels, own.select("class", "members"), share, max(4 * parts, shuffle_width(spark)))
        of_class = of_class.join(counts, "class", "left").withColumn("n_links", F.col("n_links") + F.coalesce("others", F.lit(0)))
    some = table.where("n_shingles > 0").join(of_class, "class", "left")
    lone = table.where("n_shingles = 0").withColumns({"first": row, "n_links": F.lit(0).cast("long")})
    names = ["doc_id", "text_hash", "n_shingles", "class", "first", "n_links"]
    return (
        some.select(*names)
        .unionByName(lone.select(*names))
        .select("doc_id", "text_hash", "n_shingles", "class", F.col("first.doc_id").alias("component_id"), row.eqNullSafe(F.col("first")).alias("stays"), *(["n_links"] if links else []))
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document."""
    return similar_components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document and its number of links: all other documents that are similar to it."""
    return similar_components(read_table(spark, sf_dir, "documents"), links=True).select("doc_id", "n_shingles", "component_id", "n_links")


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that with the smallest id. Of rows that repeat it as a whole, one stays.

    A null id comes after all others; texts without words are linked with nothing and all stay; no rows, no rows.
    """
    key_id, key_hash, own = (free_name(docs, n) for n in ("_id", "_hash", "_text"))
    kept = keep_table(
        similar_components(docs).where("stays").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies")), "kept"
    ).withColumnsRenamed({"doc_id": key_id, "text_hash": key_hash})
    here = docs.withColumn(own, F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key_id)) & (F.col(own) == F.col(key_hash))
    once = here.join(kept.drop("copies"), same, "left_semi")
    if kept.where("copies > 1").limit(1).count():
        once = once.dropDuplicates(["doc_id", own])
    return once.drop(own)
