"""Document statistics against a plain computation; stages on odd rows."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tonecairn.llm import decontaminate, pieces, quality


def plainly(text):
    raw = (text or "").encode()
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw)
    words, kept = re.findall(rb"[^\x20\x09-\x0D]+", low), re.findall(rb"[^\x20\x09-\x0D]+", raw)
    size, n = max(len(raw), 1), max(len(words), 1)
    count = lambda chars: sum(b in chars for b in raw)
    punctuation = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    pairs = list(zip(words, words[1:]))
    upper = lambda b: 65 <= b <= 90
    return [
        math.log1p(len(raw)), math.log1p(len(words)), mean, math.sqrt(max(sum(x * x for x in lengths) / n - mean * mean, 0)), max(lengths, default=0), len(set(words)) / n, raw.count(b"\n") / n,
        count(range(65, 91)) / size, count(range(48, 58)) / size, count(punctuation) / size, count(b"#$%&*+=<>@^_~`\\") / size, raw.count(b"|") / size, raw.count(b".") / size, raw.count(b",") / size,
        count(range(128, 256)) / size, raw.count(b" ") / size, 1 - len(set(pairs)) / max(len(words) - 1, 1), sum(upper(w[0]) for w in kept) / n, sum(w[-1] in punctuation[:0] + b"#$%&*+=<>@^_~`\\" for w in kept) / n,
        sum(upper(w[0]) and upper(w[min(1, len(w) - 1)]) for w in kept) / n, sum(x == 1 for x in lengths) / n, math.log1p(size / (1 + raw.count(b"\n"))), raw.count(b"!") / size, sum(w[-1:] == b"." for w in kept) / n,
    ]


def test_statistics_equal_a_plain_computation():
    r = random.Random(3)
    texts = [None, "", " \n\t", "A", "one. Two THREE, four! $x$ a|b é€", "a b a b a b", "x" * 5000]
    texts += ["".join(r.choice("abcDEF .,!|\n$é0 ") for _ in range(r.randint(0, 300))) for _ in range(200)]
    got = quality.statistics(pa.array(texts, pa.string()))
    assert got.shape[1] == len(quality.STATISTICS)
    for k, t in enumerate(texts):
        assert np.allclose(got[k], plainly(t)), (t, [n for n, a, b in zip(quality.STATISTICS, got[k], plainly(t)) if not np.isclose(a, b)])


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, ITEM), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages_on_odd_rows(spark, folder):
    rows = [(1, f"before {ITEM} after", "en", "s", 9, "i", "k", 0.5), (2, None, None, None, None, None, None, None), (None, "", "en", "s", 0, "i", "k", 0.1), (4, "w " * 200_000, "en", "s", 1, "i", "k", 0.2)]
    rows += [(5, "a repeated row", "en", "s", 1, "i", "k", 0.2)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, ids string, item_id string, score double")
    left = decontaminate.stage_decontaminate(spark, docs, folder)
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["2", "4", "5", "5", "None"]
    scored = quality.stage_quality(spark, docs, folder)
    assert scored.columns == docs.columns and scored.count() <= docs.count()
    for stage in (decontaminate.stage_decontaminate, quality.stage_quality):
        assert stage(spark, docs.limit(0), folder).count() == 0
    try:
        encoded = pieces.stage_encode(spark, docs, folder)
    except FileNotFoundError:
        pytest.skip("no vocabulary")
    got = {str(r["doc_id"]): r["n_ids"] for r in encoded.collect()}
    assert encoded.count() == 6 and got["2"] == got["None"] == 0 and got["4"] > 0
    assert pieces.stage_encode(spark, docs.limit(0), folder).count() == 0


def grown(x, y, trees, depth, bins, rate, shrink, leaf_rows):
    """The scores of boosting written with plain loops."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    margin = np.full(len(x), math.log(y.mean() / (1 - y.mean())))

    def value(rows, grad, hess):
        return -rate * sum(grad[i] for i in rows) / (sum(hess[i] for i in rows) + shrink)

    def split(rows, grad, hess, level):
        if level == depth:
            return [(rows, value(rows, grad, hess))]
        worth = lambda some: sum(grad[i] for i in some) ** 2 / (sum(hess[i] for i in some) + shrink)
        best = (1e-6, None)
        for j, cuts in enumerate(edges):
            for cut in cuts:
                low, high = [i for i in rows if x[i, j] <= cut], [i for i in rows if x[i, j] > cut]
                if min(len(low), len(high)) >= leaf_rows and (gain := worth(low) + worth(high) - worth(rows)) > best[0] + 1e-9:
                    best = (gain, (low, high))
        if best[1] is None:
            return [(rows, value(rows, grad, hess))]
        return [leaf for side in best[1] for leaf in split(side, grad, hess, level + 1)]

    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(x))
        for rows, v in split(list(range(len(x))), prob - y, prob * (1 - prob), 0):
            step[rows] = v
        margin = margin + step
    return 1 / (1 + np.exp(-margin))


def test_the_trainer_equals_plain_loops():
    r = np.random.default_rng(7)
    x = r.standard_normal((150, 3))
    y = ((x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + 0.3 * r.standard_normal(150)) > 0).astype(float)
    how = dict(trees=4, depth=3, bins=8, rate=0.3, shrink=1.0, leaf_rows=6)
    assert np.allclose(quality.fit(x, y, **how).score(x), grown(x, y, **how))


def test_held_out_is_the_crc_of_the_decimal_id(spark):
    import zlib

    from pyspark.sql import functions as F

    from tonecairn.llm.shared import is_held_out

    ids = [0, 1, -1, 12345, 2**63 - 1, -(2**63), *range(100, 200), None]
    got = {r["i"]: r["h"] for r in spark.createDataFrame([(i,) for i in ids], "i long").select("i", is_held_out(F.col("i")).alias("h")).collect()}
    assert got == {i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in ids}


def test_the_sample_is_bounded_where_ids_repeat(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y, **_: seen.append(len(y)))
    docs = spark.createDataFrame([(k % 3, f"text {k}") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    quality.train(docs, labels, sample_rows=15)
    assert seen == [15]


def test_roles_of_any_characters_come_back(spark):
    from pyspark.sql import functions as F

    from tonecairn.llm import chat_format

    odd = ["a\0b", "a\\b", "\\", "\\n", "\\s", "\\\\s\n", "\n", "<|im_end|>", "<\\|", "<\\\\|x", "\0", "\\\0n", "é\\n\0", ""]
    rows = [(k, t, role, text) for k, role in enumerate(odd) for t, text in enumerate(odd)]
    done = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in done.select("conv_id", chat_format.read_back(F.col("formatted")).alias("back")).collect():
        assert [(x["role"], x["text"]) for x in r["back"]] == [(odd[r["conv_id"]], t) for t in odd]


def test_the_whole_pipeline_on_odd_and_on_no_rows(spark, tmp_path):
    import os

    import corpus_pipeline
    from tonecairn.llm import pieces as p

    if not os.path.exists(p.MODEL):
        pytest.skip("no vocabulary")
    ddl = "doc_id long, text string, lang string, source string, n_chars long, ids string, `class` string, digest string"
    long = " ".join(f"word{k}" for k in range(3000))
    rows = [(1, long), (2, long), (None, long + " more"), (3, None), (4, ""), (5, f"x {ITEM} y"), (2**63 - 1, "quite another text of some words"), (7, "seven"), (7, "seven")]
    full = [(i, t, None, "s", len(t or ""), "a", "b", "c") for i, t in rows]
    for name, docs in (("full", full), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(docs, ddl).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, ITEM), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        spark.createDataFrame([(7, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        left = corpus_pipeline.run(spark, folder)
        got = sorted(str(r["doc_id"]) for r in left.collect())
        # one of the near copies, the one row that is twice there, and all that is alone stay; the item goes
        assert got == (sorted(["1", "3", "4", "7", str(2**63 - 1)]) if docs else [])
