"""The filter audit against filters that are applied one after the other."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa

from tonecairn.llm import filter_audit as fa
from tonecairn.llm.text_blocks import Words, text_bytes


def plainly(docs, labels):
    """Rows of the audit, by applying every order to lists of documents."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    smallest = {}
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    rows, parts = [], {}
    for i, text, lang in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and smallest[text] < i,
        }
        parts.setdefault(lang or "", []).append((i, {x for x in fails if fails[x]}))
    for part, members in parts.items():
        removed_by, found = Counter(), []
        for order in permutations("ABCDE"):
            left = members
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                before = [d for d in members if d[1] & set(order[: step - 1])]
                left = [d for d in left if x not in d[1]]
                removed_by[x] += len(gone)
                found.append((part, "".join(order), step, len(left), len(gone), sum(x in d[1] for d in before), sum(d[1] == {x} for d in members), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), x))
        rows += [(*r[:-1], removed_by[r[-1]]) for r in found]
    return sorted(rows)


def odd_documents():
    r = random.Random(5)
    words = ["a", "b", "é", "Word", "longer-than-eight-bytes", "x$", "|", "LOUD"] + [f"w{k}" for k in range(400)]
    texts = [None, "", " \n\t", "$", "A", "a " * 300, " ".join(f"w{k}" for k in range(250)), "é" * 97 + "ABC", "é" * 96 + "ABC", "A\0 A\0 A", "w " * 300_000]
    texts += [" ".join(r.choice(words) for _ in range(r.choice([3, 150, 199, 200, 201, 500]))) for _ in range(60)]
    docs = [(k, t, r.choice(["en", "de", None, ""])) for k, t in enumerate(texts * 2)]
    return docs + [(None, "", "en"), (None, texts[6], None), (3, "$", "en"), (3, "$", "de"), (-7, texts[20], "x"), (2**63 - 1, texts[20], "x")]


def test_every_order_equals_plain_filters(spark):
    docs = odd_documents()
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 90, 2)] + [(4, 0, 0), (4, 1, 1), (None, 1, 1), (8, None, None), (10**9, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    frame = spark.createDataFrame([(*d, "t", 1) for d in docs], "doc_id long, text string, lang string, digest string, n long").repartition(3)
    got = fa.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == plainly(docs, labels)
    assert got.schema.simpleString().startswith("struct<part:string,filter_order:string,step:int,kept:bigint")


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "A", "en")], docs.schema)
    assert fa.audit(one, labels).count() == 600 and fa.audit(one, labels).where("good_lost + toxic_lost > 0").count() == 0


def test_words_that_share_a_hash_are_told_apart():
    texts = ["a b a b c", "", "x", "same same", "one two three one"]
    raw, offsets = text_bytes(pa.array(texts))
    words = Words(raw, offsets)
    words.hash = np.zeros_like(words.hash)
    assert fa.distinct_words(raw, words).tolist() == [len(set(t.split())) for t in texts]
