"""Components of long paths, and words whose polynomial hashes would be equal."""

import math
import random

import pytest

from tonecairn.llm import components, pieces, text_blocks
from tonecairn.llm.jaccard_join import similar_components
from tonecairn.llm.substring_dedup import remove_repeats


def labels(spark, monkeypatch, links):
    rounds, real = [], components.keep_table
    monkeypatch.setattr(components, "keep_table", lambda df, *a, **k: rounds.append(1) or real(df, *a, **k))
    got = components.connected(spark.createDataFrame(links, "a long, b long").repartition(3))
    return {r["node"]: r["label"] for r in got.collect()}, len(rounds) - 1


def test_a_long_path_settles_in_few_rounds(spark, monkeypatch):
    n = 5000
    nodes = list(range(n))
    random.Random(3).shuffle(nodes)
    got, rounds = labels(spark, monkeypatch, list(zip(nodes, nodes[1:])))
    assert got == dict.fromkeys(range(n), 0)
    assert rounds <= 2 * math.log2(n)


def test_stars_of_one_task():
    import numpy as np

    r = random.Random(1)
    for _ in range(60):
        n = r.randint(2, 60)
        links = [(r.randrange(n) * 7 - 50, r.randrange(n) * 7 - 50) for _ in range(r.randint(1, 60))]
        of = {x: {x} for p in links for x in p}
        for a, b in links:
            both = of[a] | of[b]
            of.update(dict.fromkeys(both, both))
        u, v = components.stars(*np.array(links).T)
        assert dict(zip(u.tolist(), v.tolist())) == {x: min(s) for x, s in of.items() if x != min(s)}
    nodes = list(range(200_000))
    r.shuffle(nodes)
    u, v = components.stars(np.array(nodes[1:]), np.array(nodes[:-1]))
    assert len(u) == 199_999 and not v.any()


def test_rounds_without_the_first_step(spark, monkeypatch):
    monkeypatch.setattr(components, "_contracted", lambda links: links)
    n = 3000
    nodes = list(range(n))
    random.Random(5).shuffle(nodes)
    got, rounds = labels(spark, monkeypatch, list(zip(nodes, nodes[1:])))
    assert got == dict.fromkeys(range(n), 0) and rounds <= 2 * math.log2(n)


def test_components_of_random_links(spark, monkeypatch):
    r = random.Random(8)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(7, 7), (1, 2), (2, 1)]
    of = {x: {x} for pair in links if pair[0] != pair[1] for x in pair}
    for a, b in links:
        if a != b:
            both = of[a] | of[b]
            of.update(dict.fromkeys(both, both))
    got, _ = labels(spark, monkeypatch, links)
    assert got == {x: min(s) for x, s in of.items()}
    assert labels(spark, monkeypatch, [(1, 1)])[0] == {}


def word(n, letters="ab"):
    """The Thue-Morse word: polynomials modulo 2**64 cannot tell the two of 1024 bytes apart."""
    return "".join(letters[k.bit_count() & 1] for k in range(n))


A, B = word(1024), word(1024, "ba")


def test_words_that_polynomials_confuse(spark):
    import pyarrow as pa

    raw, offsets = text_blocks.text_bytes(pa.array([A, B]))
    words = text_blocks.Words(raw, offsets)
    assert words.hash[0] != words.hash[1] and len(set(text_blocks.range_hashes(raw, words.start, words.stop, second=True).tolist())) == 2
    rest = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"{A} {rest}"), (2, f"{B} {rest}"), (3, A), (4, B)], "doc_id long, text string")
    for size in (1 << 22, 1000):
        assert {r["doc_id"]: r["n_removed"] for r in remove_repeats(docs, batch_bytes=size).collect()} == dict.fromkeys((1, 2, 3, 4), 0)
        assert {r["doc_id"]: r["component_id"] for r in similar_components(docs.where("doc_id > 2"), batch_bytes=size).collect()} == {3: 3, 4: 4}


def test_pieces_of_words_with_equal_hashes(monkeypatch):
    import os

    import numpy as np
    import pyarrow as pa
    import sentencepiece

    if not os.path.exists(pieces.MODEL):
        pytest.skip("no vocabulary")
    with open(pieces.MODEL, "rb") as f:
        vocabulary = pieces.Vocabulary(f.read())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [A, B, "some words and others", "other words and some", "word " * 90, None]
    for hashes in (text_blocks.range_hashes, lambda raw, start, stop, second=False: np.zeros(len(start), np.uint64)):
        monkeypatch.setattr(text_blocks, "range_hashes", hashes)
        encoder = pieces.Encoder(vocabulary)
        for _ in range(2):
            ids, offsets = encoder.encode(pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [library.encode(t or "") for t in texts]


def test_the_largest_id_is_no_null(spark):
    from tonecairn.llm.jaccard_join import similar_components

    last, text = 2**63 - 1, "one two three four five six"
    docs = spark.createDataFrame([(last, text), (None, text), (None, "lone words"), (last - 1, "")], "doc_id long, text string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["stays"]) for r in similar_components(docs).collect()]
    assert sorted(got, key=str) == sorted([(last, 2, last, True), (None, 2, last, False), (None, 1, None, True), (last - 1, 0, last - 1, True)], key=str)
