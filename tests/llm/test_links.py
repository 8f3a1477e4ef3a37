"""All links of the similarity join, those within a component too."""

import random

import pytest

from tonecairn.llm import jaccard_join


def sets_of(text):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


@pytest.mark.parametrize("block", [3, 256])
def test_number_of_links(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "LINK_BLOCK", block)
    r = random.Random(4)
    base, rows = [f"w{k}" for k in range(80)], [(900, None), (901, ""), (902, "one two"), (903, "one two"), (904, "lone words of no other text at all")]
    for k in range(40):  # one large component in which some pairs are similar and some are not
        words = list(base)
        for _ in range(r.randint(0, 2)):
            words[r.randrange(80)] = f"x{r.randint(0, 20)}"
        rows.append((k, " ".join(words)))
    rows += [(100, rows[5][1]), (101, rows[9][1]), (101, rows[9][1])]
    rows += [(200 + k, " ".join(f"c{i}" for i in range(3 * k, 60 + 3 * k))) for k in range(12)]  # a chain
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [sets_of(t) for _, t in rows]
    want = sorted((d, sum(100 * len(s & o) >= 75 * len(s | o) for j, o in enumerate(sets) if j != i and s and o)) for i, ((d, _), s) in enumerate(zip(rows, sets)))
    got = sorted((x["doc_id"], x["n_links"]) for x in jaccard_join.similar_components(docs, batch_bytes=2000, links=True).collect())
    assert got == want
    large = [n for d, n in want if d < 40]
    assert min(large) < max(large)


def test_overlaps_derived_from_one_set_equal_plain_ones():
    import numpy as np

    r = np.random.default_rng(2)
    for _ in range(40):
        base = r.choice(200, 60, replace=False)
        sets = [np.unique(np.concatenate([r.choice(base, r.integers(0, 60), replace=False), r.choice(200, r.integers(0, 9))])).astype(np.uint64) for _ in range(r.integers(2, 12))]
        left, right = sets[: len(sets) // 2 + 1], sets[len(sets) // 2 :]
        want = [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]
        assert jaccard_join._derived_overlaps(left, right).tolist() == want == jaccard_join._overlaps(left, right).tolist()
