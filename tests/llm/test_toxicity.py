"""Toxicity: the index against a full comparison, terms against a plain count, odd rows, and held-out accuracy."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tonecairn.llm import toxicity as tx


def sparse(r, n, n_terms, most):
    rows = [sorted(r.sample(range(n_terms), r.randint(1, most))) for _ in range(n)]
    rows[1:1] = [rows[0]] * 3  # equal rows, so ties
    bounds = np.append(0, np.cumsum([len(x) for x in rows]))
    terms = np.array([t for x in rows for t in x])
    counts = np.array([1 + (t * 7) % 5 for t in terms])
    return bounds, terms, counts


@pytest.mark.parametrize("block", [1, 4, 64])
def test_the_index_equals_a_full_comparison(block):
    r = random.Random(block)
    n_terms, k = 60, 7
    idf = 1 + np.arange(n_terms) / 10
    dense = lambda b, t, w: np.array([np.bincount(t[a:z], w[a:z], n_terms) for a, z in zip(b, b[1:])])
    bounds, terms, counts = sparse(r, 300, n_terms, 6)
    weights = tx.unit_vectors(bounds, terms, counts, idf)
    index = tx.BlockMaxIndex(bounds, terms, weights, n_terms, block)
    asked = sparse(r, 120, n_terms, 4)
    asked_weights = tx.unit_vectors(*asked, idf)
    rows, scores, visited = index.search(asked[0], asked[1], asked_weights, k)
    full = dense(asked[0], asked[1], asked_weights) @ dense(bounds, terms, weights).T
    for q in range(len(full)):
        best = sorted((-round(s, 12), i) for i, s in enumerate(full[q]) if s > 0)[:k]
        assert [i for i in rows[q] if i >= 0] == [i for _, i in best]
        assert np.allclose(scores[q][: len(best)], [-s for s, _ in best])
    assert 0 < visited <= len(full) * index.blocks
    if block == 4:
        assert visited < 0.6 * len(full) * index.blocks  # blocks are left out


def test_equal_vectors_are_compared_once():
    n_terms, k, block = 40, 7, 4
    examples = [[t, t + 1] for t in range(30) for _ in range(50)]
    random.Random(3).shuffle(examples)
    asked = [[t] for t in range(12) for _ in range(100)]
    flat = lambda rows: (np.append(0, np.cumsum([len(x) for x in rows])), np.array([t for x in rows for t in x]))
    weigh = lambda b, t: (b, t, tx.unit_vectors(b, t, np.ones(len(t)), np.ones(n_terms)))
    index = tx.BlockMaxIndex(*weigh(*flat(examples)), n_terms, block)
    rows, scores, visited = index.search(*weigh(*flat(asked)), k)
    for q, (term,) in enumerate(asked):
        assert rows[q].tolist() == [i for i, x in enumerate(examples) if term in x][:k]  # all of one score, so the smaller rows
        assert np.allclose(scores[q], 0.5**0.5)
    assert index.blocks == 8 and visited <= 12 * index.blocks


def test_documents_of_a_term_are_counted_before_they_are_sent(spark):
    lists = [[0, 2], [2], [], [1, 2]] * 25
    table = spark.createDataFrame([(x,) for x in lists], "terms array<int>").repartition(3)
    counted = tx.documents_with(table, 4)
    assert {r["term"]: r["n"] for r in counted.collect()} == {0: 25, 1: 25, 2: 75}
    assert "Generate" not in counted._jdf.queryExecution().toString()
    assert tx.documents_with(table.where("size(terms) = 0"), 0).count() == 0


def test_term_counts_equal_a_plain_count():
    texts = [None, "", "Hello, hello-WORLD!", "überlang überlang2 x", "a\0b " * 50, "12345 123456 1234567"]

    def plain(text):
        found = Counter()
        for word in re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())):
            found[word, 0] += 1
            for size in tx.PREFIXES:
                if len(word) > size:
                    found[word[:size], size] += 1
        return found

    hashes = np.unique(np.concatenate([h for _, h in tx._term_hashes(pa.array(texts))]))
    text, _, n = tx.term_counts(pa.array(texts), hashes)
    for i, t in enumerate(texts):
        assert sorted(n[text == i].tolist()) == sorted(plain(t).values())
    assert len(hashes) == len({w for t in texts for w in plain(t)})
    assert not len(tx.term_counts(pa.array(texts), hashes[:0])[0])


def test_isotonic_is_the_nearest_rising_function():
    x, y = np.array([0.1, 0.1, 0.2, 0.3, 0.5, 0.9]), np.array([0.0, 0, 1, 0, 1, 1])
    tops, values = tx.isotonic(x, y)
    assert tops.tolist() == [0.1, 0.3, 0.9] and values.tolist() == [0.5 / 3, 0.5, 2.5 / 3]


def corpus(n=600, seed=1):
    r = random.Random(seed)
    plain, bad = [f"word{k}" for k in range(300)], ["zonk", "florb", "grizzlak"]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randint(5, 80))]
        toxic = i % 5 == 1
        if toxic:
            for _ in range(r.randint(1, 4)):
                words.insert(r.randint(0, len(words)), r.choice(bad) + r.choice(["", "!", ",", "ovia"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_evidence(spark):
    rows, labels = corpus()
    docs, known = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in tx.toxicity(docs, known).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 80 and sum((got[i]["score"] >= 0.5) == bool(dict(labels)[i]) for i in held) >= 0.97 * len(held)
    voters = {v["doc_id"] for r in got.values() for v in r["evidence"]}
    assert voters and not voters & set(held)
    assert all(v["toxic"] == dict(labels)[v["doc_id"]] and 0 < v["cosine"] <= 1 + 1e-9 for r in got.values() for v in r["evidence"])
    assert all(v["doc_id"] != i or v["cosine"] > 1 - 1e-9 for i, r in got.items() for v in r["evidence"])
    # labels that are held out change nothing
    turned = spark.createDataFrame([(i, 1 - t if i in held else t) for i, t in labels], "doc_id long, toxic int")
    assert {r["doc_id"]: r["score"] for r in tx.toxicity(docs, turned).collect()} == {i: r["score"] for i, r in got.items()}


def test_odd_rows(spark):
    rows, labels = corpus(200)
    rows += [(None, "zonk zonk"), (300, None), (300, ""), (7, rows[7][1]), (301, "florb " * 100_000), (302, "word1 " * 100_000)]
    docs = spark.createDataFrame([(*r, 0.5, [1]) for r in rows], "doc_id long, text string, score double, terms array<int>")
    labels += [(1, 1), (None, 1), (2, None), (10**9, 1)]
    got = tx.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert got.columns == ["doc_id", "score", "evidence"]
    found = got.collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    score = {r["doc_id"]: r["score"] for r in found}
    assert score[None] > 0.5 and score[301] > 0.5 and score[302] < 0.5 and score[300] < 0.5


def test_no_labels_one_class_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in tx.toxicity(docs, none).collect()] == [0.5, 0.5]
    assert {r["score"] for r in tx.toxicity(docs, spark.createDataFrame([(1, 1), (2, 1)], none.schema)).collect()} <= {1.0, 0.5}
    assert tx.toxicity(docs.limit(0), none).count() == 0
