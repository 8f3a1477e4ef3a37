"""The conversation trie against a plain trie, in one stretch and in many."""

import hashlib
import random
import re
import zlib

import pytest

from tonecairn.llm import conversation_trie as ct


def plainly(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    turns = {c: [t[2:] for t in sorted(x)] for c, x in convs.items()}
    base = lambda c: c - (abs(c) % 20) * (1 if c >= 0 else -1)
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns.get(base(c), [])[:h] + turns[c][h:]
    nodes = {}
    for c, x in rebuilt.items():
        for d in range(len(x) + 1):
            nodes.setdefault(tuple(x[:d]), []).append(c)
    below = {p: [q for q in nodes if q[: len(p)] == p] for p in nodes}
    children = {p: [q for q in below[p] if len(q) == len(p) + 1] for p in nodes}
    words = lambda p: len(re.findall(rb"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    return sorted(
        (
            min(members),
            len(p),
            min(nodes[p[:-1]]) if p else -(10**9),
            len(members),
            len(children[p]),
            sum(not children[q] for q in below[p]),
            sum((len(nodes[q]) - 1) * words(q) for q in below[p]),
            hashlib.sha256(",".join(str(c) for c in sorted(c for c in members if len(rebuilt[c]) == len(p))).encode()).hexdigest(),
        )
        for p, members in nodes.items()
    )


def conversations():
    r = random.Random(2)
    say = lambda k: f"some words {k}" + " é\t x" * (k % 3)
    rows = [(c, t, r.choice(["user", "assistant"]), say(r.randint(0, 2))) for c in [*range(-45, 90), 10**12, 10**12 + 1] for t in range(r.choice([1, 2, 3, 7]))]
    rows = [x for x in rows if x[0] not in (40, -20)]  # families without their base
    rows += [(c, t, "user", f"same {t}") for c in (61, 62, 63, 75, 82, 83, 20, 21) for t in range(8, 30)]  # long ones that share much
    rows += [(5, None, "user", "a null turn"), (5, None, None, None), (5, 0, "user", "tie"), (5, 0, "user", "tie"), (5, 0, "u" * 70, "b"), (5, 0, "u" * 70, "a")]
    return rows + [(None, 0, "user", "nobody"), (7, 3, "", " "), (99, 0, "user", "w " * 200_000)]


@pytest.mark.parametrize("stretch", [ct.STRETCH, 5, ct.HEAD])
def test_equals_a_plain_trie(spark, stretch):
    rows = conversations()
    frame = spark.createDataFrame([(*x, "extra", 1) for x in rows], "conv_id long, turn long, role string, text string, base string, depth int").repartition(7)
    got = ct.prefix_trie(frame, stretch).fillna(-(10**9), ["parent_conv_id"]).collect()
    assert sorted(tuple(r) for r in got) == plainly(rows)


def test_no_conversations(spark):
    assert ct.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
