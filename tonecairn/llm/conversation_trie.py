"""Prefix trie of rebuilt conversations, merged family first.

A family is the conversations that share the base id ``c - c % 20``. Each is
rebuilt with the first turns of its base conversation, so what a family's
members share is found inside the family: conversations and the head of the
base conversation are cogrouped by base id, every group is built into one
small trie, and only the combined nodes of families are shuffled to be merged
by their prefixes. Sums over subtrees take the same way back: each merged node
gives its own figures to the one family of its smallest member, families sum
their small tries upwards, and the sums of a node's families are added.

Texts are read once. A turn becomes two hashes of role and text and a word
count; a prefix of turns is named by its length and the two exclusive ors of
its turns' hashes, each taken with the turn's place, 128 bits in all.

No key is bounded by hope. Turns are numbered by a range sort, whose
partitions cut a conversation wherever it gets long, with offsets added per
piece of a conversation. Families are cut into stretches of ``STRETCH`` turns:
the name of the prefix before a stretch and the sums of the stretches after it
are carried along, so a group holds at most 39 conversations (20 unless ids
are negative) times one stretch. Members that end at one node are joined per
block of families, and their digest reads the blocks in order without holding
them.

Defined results
---------------
* null role or text: empty; null turn: before all others; turns that tie: by role, then text, in byte order; repeated rows: each is a turn;
* null conv_id: such rows belong to no conversation and are not read;
* ``%`` keeps the sign, so the conversations -19 to 19 have the base 0;
* the base conversation is absent: nothing is inherited, and what is left of a conversation may be no turn, a member of the root alone;
* very long texts: hashed and counted whole, by the JVM; very long conversations: in stretches, as above;
* empty ``conversations``: no nodes, not even a root; other input columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import drop_table, keep_table, read_table, shuffle_width

FAMILY = 20
HEAD = 3  # turns of the base conversation that can be inherited
STRETCH = 4096
BLOCK = 1024 * FAMILY  # ids whose endings are joined before they are digested
KEY = ["depth", "ka", "kb"]


def _base(conv_id: str):
    return F.col(conv_id) - F.col(conv_id) % FAMILY


def _stretch(depth, size: int):
    """The stretch of the node at ``depth``; the root is in the first."""
    return F.floor(F.greatest(depth - 1, F.lit(0)) / size).cast("long")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``at`` (from 0), hashes ``a`` and ``b``, ``words``, and ``n_own`` turns of the conversation, as a written table."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    first = lambda c: F.substring(c, 1, 64)  # noqa: E731  bounds of ranges reach the driver, so no whole texts
    ranges = ["conv_id", "turn", first("role"), F.when(F.length("role") < 64, first("text"))]
    dealt = rows.repartitionByRange(shuffle_width(rows.sparkSession), *ranges).sortWithinPartitions("conv_id", "turn", "role", "text")
    narrow = keep_table(
        dealt.select(
            "conv_id",
            F.monotonically_increasing_id().alias("row"),
            F.xxhash64(F.lit(1), "role", "text").alias("a"),
            F.xxhash64(F.lit(2), "role", "text").alias("b"),
            F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        ).withColumn("piece", F.shiftright("row", 33)),
        "turns",
    )
    pieces = narrow.groupBy("conv_id", "piece").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("conv_id")
    before = F.sum("n").over(own.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("conv_id", "piece", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(own).alias("n_own"))
    out = keep_table(
        narrow.join(pieces, ["conv_id", "piece"]).select("conv_id", (F.col("row") + F.col("shift")).alias("at"), "a", "b", "words", "n_own"), "numbered"
    )
    drop_table(narrow)
    return out


def members(turns: DataFrame) -> DataFrame:
    """Per conversation: ``base``, ``h``, ``taken`` (turns that it inherits) and ``total`` turns when rebuilt."""
    convs = turns.where("at = 0").select(
        "conv_id", _base("conv_id").alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).alias("h"), "n_own"
    )
    bases = convs.where(F.col("conv_id") == F.col("base")).select("base", F.col("n_own").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    return convs.join(bases, "base", "left").select(
        "conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("total")
    )


def _placed(rows: DataFrame, place) -> DataFrame:
    """``rows`` with the hashes of turns taken at their place in the rebuilt conversation."""
    return rows.withColumn("pos", place).withColumn("ka", F.xxhash64("a", "pos")).withColumn("kb", F.xxhash64("b", "pos"))


FAMILY_NODES = "base long, stretch long, depth long, ka long, kb long, pa long, pb long, conv_id long, n_convs long, words long, ends string"


def family_trie(base: int, stretch: int, own: pa.Table, heads: pa.Table, size: int = STRETCH) -> pa.Table:
    """The nodes of one stretch of a family.

    ``own`` has a row before each conversation's turns (``pos`` -1) with the
    name of the prefix before the stretch, ``h`` as ``words``, and ``total``.
    """
    column = lambda t, c: t.column(c).to_numpy()
    conv, pos, ka, kb, words, total = (column(own, c) for c in ("conv_id", "pos", "ka", "kb", "words", "total"))
    first, start = pos < 0, stretch * size
    by = np.argsort(column(heads, "pos"))
    takes = np.minimum(words[first], len(by)) if stretch == 0 else np.zeros(int(first.sum()), np.int64)
    which = by[np.arange(takes.sum()) - np.repeat(np.cumsum(takes) - takes, takes)]
    join = lambda begin, taken, rest: np.concatenate([begin, taken, rest])
    total = join(total[first], np.repeat(total[first], takes), total[~first])
    conv = join(conv[first], np.repeat(conv[first], takes), conv[~first])
    ka, kb = (join(k[first], column(heads, c)[which], k[~first]) for k, c in ((ka, "ka"), (kb, "kb")))
    words = join(np.zeros(len(takes), np.int64), column(heads, "words")[which], words[~first])
    pos = join(np.full(len(takes), start - 1), column(heads, "pos")[which], pos[~first])

    order = np.lexsort((pos, conv))
    conv, pos, ka, kb, words, total = (x[order] for x in (conv, pos, ka, kb, words, total))
    begins = np.flatnonzero(pos == start - 1)
    lengths = np.diff(np.append(begins, len(pos)))
    total = np.repeat(total[begins], lengths)
    names = []
    for k in (ka, kb):
        run = np.bitwise_xor.accumulate(k)
        names.append(run ^ np.repeat(run[begins] ^ k[begins], lengths))
    depth = pos + 1
    parents = [np.concatenate([name[:1], name[:-1]]) for name in names]
    kept = np.flatnonzero((depth > start) | (depth == 0))
    kept = kept[np.lexsort((conv[kept], names[1][kept], names[0][kept], depth[kept]))]
    depth, conv, words, total, (ka, kb), (pa_, pb_) = depth[kept], conv[kept], words[kept], total[kept], (x[kept] for x in names), (x[kept] for x in parents)
    new = np.ones(len(kept), bool)
    new[1:] = (depth[1:] != depth[:-1]) | (ka[1:] != ka[:-1]) | (kb[1:] != kb[:-1])
    at = np.flatnonzero(new)
    ends: list[str | None] = [None] * len(at)
    ending = np.flatnonzero(depth == total)
    for node, c in zip((np.cumsum(new) - 1)[ending].tolist(), conv[ending].tolist(), strict=True):
        ends[node] = str(c) if ends[node] is None else f"{ends[node]},{c}"
    root = depth[at] == 0
    return pa.table(
        {
            "base": np.full(len(at), base),
            "stretch": np.full(len(at), stretch),
            "depth": depth[at],
            "ka": ka[at],
            "kb": kb[at],
            "pa": pa.array(pa_[at], mask=root),
            "pb": pa.array(pb_[at], mask=root),
            "conv_id": conv[at],
            "n_convs": np.diff(np.append(at, len(kept))),
            "words": words[at],
            "ends": pa.array(ends, pa.string()),
        }
    )


def subtree_sums(nodes: pa.Table, weights: pa.Table) -> pa.Table:
    """``leaves`` and ``saved`` of every node of a family's stretch, summed over the nodes below it."""
    named = lambda t, *c: list(zip(*(t.column(x).to_pylist() for x in c)))
    own = {name: [0, 0] for name in named(nodes, *KEY)}
    for *name, leaves, saved in named(weights, *KEY, "leaves", "saved"):
        at = own[tuple(name)]
        at[0] += leaves
        at[1] += saved
    for depth, ka, kb, above_a, above_b in sorted(named(nodes, *KEY, "pa", "pb"), key=lambda x: -x[0]):
        above = own.get((depth - 1, above_a, above_b))  # none at the top of a stretch
        if above is not None:
            below = own[depth, ka, kb]
            above[0] += below[0]
            above[1] += below[1]
    out = [(*name, *at) for name, at in own.items() if at != [0, 0]]
    return pa.table({c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate([*KEY, "leaves", "saved"])})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the endings of nodes whose rows follow one another, in ascending order; holds one row at a time."""
    name, digest = None, None
    for batch in batches:
        done: list[tuple] = []
        for *key, ends in zip(*(batch.column(c).to_pylist() for c in [*KEY, "ends"]), strict=True):
            if key != name:
                if name is not None:
                    done.append((*name, digest.hexdigest()))
                name, digest = key, hashlib.sha256(ends.encode())
            else:
                digest.update(b"," + ends.encode())
        yield _digest_rows(done)
    if name is not None:
        yield _digest_rows([(*name, digest.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)] + [pa.array([r[3] for r in rows], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[*KEY, "ends_sha256"])


def ending_digests(family: DataFrame) -> DataFrame:
    """``ends_sha256`` of the nodes at which a conversation ends."""
    block = (F.col("base") - F.pmod("base", F.lit(BLOCK))).alias("block")
    ends = F.transform(F.array_sort(F.collect_list(F.struct("base", "ends"))), lambda x: x["ends"])
    joined = family.where("ends IS NOT NULL").groupBy(*KEY, block).agg(F.array_join(ends, ",").alias("ends"))
    dealt = joined.repartition(shuffle_width(family.sparkSession), *KEY).sortWithinPartitions(*KEY, "block")
    return dealt.select(*KEY, "ends").mapInArrow(_digests, "depth long, ka long, kb long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations; ``stretch`` is at least ``HEAD``, so what is inherited is in the first."""
    turns = numbered_turns(conversations)
    convs = members(turns)
    heads = _placed(turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("at") < HEAD)).withColumnRenamed("conv_id", "base"), F.col("at"))
    own = _placed(turns.join(convs, "conv_id").where("at >= h"), F.col("at") - F.col("h") + F.col("taken"))
    in_stretch = F.floor(F.col("pos") / stretch).cast("long").alias("stretch")

    # the names of the prefixes before the later stretches of long conversations
    long = convs.where(F.col("total") > stretch)
    taken = long.select("conv_id", "base", "h").join(heads, "base").where("at < h")
    of_long = own.where(F.col("total") > stretch).select("conv_id", "ka", "kb", in_stretch).union(taken.select("conv_id", "ka", "kb", in_stretch))
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    xors = of_long.groupBy("conv_id", "stretch").agg(F.bit_xor("ka").alias("ka"), F.bit_xor("kb").alias("kb"))
    carried = keep_table(xors.select("conv_id", "stretch", F.bit_xor("ka").over(before).alias("ka"), F.bit_xor("kb").over(before).alias("kb")).where("stretch > 0"), "carried")

    columns = ["base", "stretch", "conv_id", "pos", "ka", "kb", "words", "total"]
    nothing = F.lit(0).cast("long")
    begins = convs.select("conv_id", "base", F.col("h").alias("words"), "total", nothing.alias("stretch"), nothing.alias("ka"), nothing.alias("kb")).unionByName(
        carried.join(convs.select("conv_id", "base", F.col("h").alias("words"), "total"), "conv_id")
    )
    rows = begins.withColumn("pos", F.lit(-1).cast("long")).select(*columns).union(own.withColumn("stretch", in_stretch).select(*columns))
    head_rows = heads.select("base", nothing.alias("stretch"), "pos", "ka", "kb", "words")

    def build(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return family_trie(key[0].as_py(), key[1].as_py(), left, right, stretch)

    grouped = rows.groupBy("base", "stretch").cogroup(head_rows.groupBy("base", "stretch"))
    family = keep_table(grouped.applyInArrow(build, FAMILY_NODES), "families")
    drop_table(turns)

    merged = family.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("words").alias("words"), F.max("pa").alias("pa"), F.max("pb").alias("pb")
    )
    above = merged.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb"))
    children = above.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = keep_table(merged.join(children, KEY, "left").fillna(0, ["n_children"]), "nodes")

    own_weight = nodes.select(
        "conv_id", *KEY, (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    ).where("leaves > 0 OR saved > 0")
    weights = own_weight.withColumn("base", _base("conv_id")).withColumn("stretch", _stretch(F.col("depth"), stretch))
    # what the later stretches of a long conversation hold is added where each stretch ends
    held = weights.join(carried.select("conv_id").distinct(), "conv_id", "left_semi").groupBy("conv_id", "stretch").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    onwards = Window.partitionBy("conv_id").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, 0)
    summed = lambda c: F.coalesce(F.sum(c).over(onwards), F.lit(0)).alias(c)
    later = (
        carried.join(held, ["conv_id", "stretch"], "left")
        .select("conv_id", "ka", "kb", (F.col("stretch") * stretch).alias("depth"), (F.col("stretch") - 1).alias("stretch"), summed("leaves"), summed("saved"))
        .where("leaves > 0 OR saved > 0")
        .withColumn("base", _base("conv_id"))
    )
    placed = ["base", "stretch", *KEY, "leaves", "saved"]
    given = weights.select(*placed).union(later.select(*placed))

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        return subtree_sums(left, right)

    small = family.select("base", "stretch", *KEY, "pa", "pb")
    sums = (
        small.groupBy("base", "stretch")
        .cogroup(given.groupBy("base", "stretch"))
        .applyInArrow(add_up, "depth long, ka long, kb long, leaves long, saved long")
        .groupBy(*KEY)
        .agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    )
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(sums, KEY, "left")
        .join(ending_digests(family), KEY, "left")
        .join(parents, ["depth", "pa", "pb"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"),
            F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return prefix_trie(read_table(spark, sf_dir, "conversations"))
