"""The three dedup operators against brute force on small fixtures with all the odd cases."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tonecairn.llm.hash_exchange import pack, part_runs, unpack
from tonecairn.llm.jaccard_join import similar_components, stage_near_duplicates
from tonecairn.llm.substring_dedup import remove_repeats, stage_substring_dedup
from tonecairn.llm.suffix_dedup import remove_repeated_strings
from tonecairn.llm.suffix_groups import adjacent_prefixes, prefix_groups, suffix_array

DDL = "doc_id long, text string, batch string, rest int, `class` string, score double, _text string, ids string, n_chars int"


def corpus(seed=7):
    r = random.Random(seed)
    word = lambda: r.choice(["ab", "Cd", "e", "fgh", "ij", "kl", "mno"]) + str(r.randint(0, 40))
    words = lambda n: [word() for _ in range(n)]
    passage, other = words(60), words(40)
    texts = [None, "", " \n ", "one two three", "one two  three", "ONE two three", "x" * 500, "ab " * 400]
    for k in range(12):
        texts.append(" ".join(words(30) + passage[k : 60 - k] + words(10)))
    for k in range(8):
        near = list(other)
        near[k] = "changed"
        texts.append("\n".join(near + words(k % 3)))
    texts += [texts[9], texts[9], texts[12], " ".join(other * 3), "é€ " * 80, " ".join(words(3000))]
    ids = [*range(len(texts) - 3), 5, None, None]
    r.shuffle(ids)
    rows = [(i, t, "b", 1, "c", 0.5, "t", "x", len(t or "")) for i, t in zip(ids, texts, strict=True)]
    return rows + [rows[9], rows[20]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DDL).repartition(3)


def key(i):
    return 2**63 - 1 if i is None else i


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    sets = [shingles(r[1]) for r in rows]
    of = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                old, new = of[a], of[b]
                of = [new if x == old else x for x in of]
    least = defaultdict(lambda: 2**63 - 1)
    for r, c in zip(rows, of, strict=True):
        least[c] = min(least[c], key(r[0]))
    return sorted((key(r[0]), len(s), least[c]) for r, s, c in zip(rows, sets, of, strict=True)), len(set(of))


@pytest.mark.parametrize("batch_bytes,part_bytes,list_sets", [(1 << 22, 8 << 20, 4096), (2000, 500, 3)])
def test_components_equal_brute_force(docs, batch_bytes, part_bytes, list_sets):
    got = similar_components(docs, batch_bytes=batch_bytes, part_bytes=part_bytes, list_sets=list_sets).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((key(r[0]), r[1], key(r[2])) for r in got) == components(corpus())[0]


def test_near_duplicate_stage_keeps_one_of_each(docs, spark):
    kept = stage_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert kept.count() == components(corpus())[1]


def chain(spark):
    """Sets in a chain, each similar to the next only: the links must reach from end to end."""
    w = [f"w{k}" for k in range(120)]
    return spark.createDataFrame([(k, " ".join(w[4 * k : 4 * k + 60])) for k in range(15)], "doc_id long, text string")


def test_chains_are_followed(spark):
    rows = [(r["doc_id"], r["text"]) for r in chain(spark).collect()]
    got = similar_components(chain(spark)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == components(rows)[0]


def windows_removed(rows, size=13):
    first = {}
    parts = [(key(r[0]), re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    for i, w in parts:
        for k in range(len(w) - size + 1):
            t = tuple(w[k : k + size])
            first[t] = min(first.get(t, i), i)
    out = []
    for i, w in parts:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batch_bytes", [1 << 22, 1500])
def test_substring_dedup_equals_brute_force(docs, batch_bytes):
    got = remove_repeats(docs, with_text=False, batch_bytes=batch_bytes).collect()
    assert sorted((key(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == windows_removed(corpus())


def test_words_that_stand_apart_in_their_source_are_removed(spark):
    """An earlier batch has every window of a passage, but no text of it has them in a row."""
    w, x, r = [f"w{k}" for k in range(40)], [f"x{k}" for k in range(40)], random.Random(3)
    ends = [(0, " ".join(w[:13])), (1, " ".join(w[1:14])), (2, " ".join(x)), (3, " ".join(w[:14] + ["z"]))]
    inside = [(0, " ".join(w[:13] + x[:5])), (1, " ".join(x[4:9] + w[1:14])), (2, " ".join(x)), (3, " ".join(w[:14] + ["z"]))]
    pieces = [(k, " ".join(w[k : k + 14] if k % 2 else x[k : k + 13])) for k in range(26)] + [(100 + k, " ".join(r.choice([w, x])[k : k + 30])) for k in range(8)]
    for rows in (ends, inside, pieces):
        got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False, batch_bytes=160).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == windows_removed(rows)


def test_substring_stage_leaves_clean_documents_alone(docs, spark):
    left = stage_substring_dedup(spark, docs, "")
    assert left.columns == docs.columns
    texts = [r["text"] for r in left.collect()]
    assert " \n " in texts and "one two  three" in texts
    assert {r["batch"] for r in left.select("batch").distinct().collect()} == {"b"}


def strings_removed(rows, size=200):
    seen = defaultdict(int)
    raws = [(r[1] or "").encode() for r in rows]
    for b in raws:
        for k in range(len(b) - size + 1):
            seen[b[k : k + size]] += 1
    out = []
    for r, b in zip(rows, raws, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((key(r[0]), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batch_bytes,hot", [(1 << 22, 20_000), (2500, 20_000), (2500, 1)])
def test_suffix_dedup_equals_brute_force(docs, batch_bytes, hot):
    got = remove_repeated_strings(docs, batch_bytes=batch_bytes, hot_contexts=hot, with_bytes=False).collect()
    want = strings_removed(corpus())
    assert sorted((key(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert similar_components(none).count() == 0
    assert remove_repeats(none).count() == 0
    assert remove_repeated_strings(none).count() == 0
    assert stage_substring_dedup(spark, stage_near_duplicates(spark, none, ""), "").count() == 0


def test_suffix_array_by_groups():
    r = random.Random(1)
    for _ in range(500):
        s = [r.randint(0, r.randint(1, 3)) for _ in range(r.randint(0, 30))]
        order = suffix_array(np.array(s, np.int64))
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        code, shared = np.array(s, np.int64), None
        shared = adjacent_prefixes(code, order, 6)
        assert shared.tolist() == [next((k for k in range(6) if max(i, j) + k >= len(s) or s[i + k] != s[j + k]), 6) for i, j in zip(order[:-1], order[1:])]
        for depth in (1, 2, 4):
            group = prefix_groups(order, shared, depth) if s else np.zeros(0)
            long = [i for i in range(len(s)) if i + depth <= len(s)]
            assert all((group[i] == group[j]) == (s[i : i + depth] == s[j : j + depth]) for i in long for j in long)


def test_the_suffix_array_decides(monkeypatch):
    """Strings of contexts of one anchor against all pairs; with another order in the array's place the answer is another."""
    from tonecairn.llm import suffix_dedup

    r = random.Random(5)
    size, differs = 24, False
    for _ in range(60):
        anchors, shapes, data, strings = [], [], b"", []
        centre = bytes(r.choices(b"ab", k=12))
        for k in range(r.randint(2, 12)):
            left, right = (bytes(r.choices(b"ab", weights=(9, 1), k=12)) for _ in range(2))
            whole = left + centre + right
            first = r.randint(0, 12)
            last = r.randint(first, 12)
            anchors.append(7)
            shapes.append((12 - first, last - first + 1))
            data += whole[first : last + size]
            strings += [(12 - o, whole[o : o + size], k) for o in range(first, last + 1)]
        args = np.array(anchors, np.uint64), np.array(shapes, np.uint16), np.frombuffer(data, np.uint8), size
        got = suffix_dedup.repeated_strings(*args).tolist()
        assert got == [any(a[:2] == b[:2] and a[2] != b[2] for b in strings) for a in strings]
        with monkeypatch.context() as m:
            m.setattr(suffix_dedup, "suffix_array", lambda symbols: np.arange(len(symbols)))
            differs |= got != suffix_dedup.repeated_strings(*args).tolist()
    assert differs


def test_packing():
    r = np.random.default_rng(2)
    for n in (0, 1, 5, 1000):
        x = np.sort(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        assert (unpack(pack(x)) == x).all()
        runs = part_runs(x, 7)
        assert [i for _, a, b in runs for i in range(a, b)] == list(range(n)) and len({p for p, _, _ in runs}) == len(runs)
        assert all(p == int(v) * 7 >> 64 for p, a, b in runs for v in x[a:b])


@pytest.mark.parametrize("hot", [20_000, 1])
def test_equal_hashes_of_one_family_remove_nothing(monkeypatch, hot):
    """All hashes of the first family that name contexts and strings are equal: the second and the bytes still tell them apart."""
    import pyarrow as pa

    from tonecairn.llm import suffix_dedup as sd

    plain = sd.range_hashes
    blind = lambda raw, start, stop, second=False, long=256: plain(raw, start, stop, True, long) if second else np.zeros(len(start), np.uint64)
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    centre, whole = text(120), text(260)
    rows = [(k, text(120) + centre + text(120)) for k in range(6)] + [(10, whole), (11, "x" + whole), (12, None)]
    stream = pa.BufferOutputStream()
    with pa.ipc.new_stream(stream, pa.schema([("doc_id", pa.int64()), ("text", pa.string())])) as out:
        out.write_table(pa.table({"doc_id": pa.array([i for i, _ in rows]), "text": pa.array([t for _, t in rows])}))
    table = pa.table({"batch": pa.array([0], pa.int32()), "payload": pa.array([stream.getvalue().to_pybytes()], pa.binary())})
    for hashes in (plain, blind):
        monkeypatch.setattr(sd, "range_hashes", hashes)
        fates = sd._decide(hot)(sd._send_anchors(1, 200)(table))
        sent = sd._send_contexts(1, 200)(table, fates)
        compared = [sd._compare(1, 200)(sent.filter(pa.compute.equal(sent.column("part"), p))) for p in set(sent.column("part").to_pylist())]
        answers = pa.concat_tables([fates, *compared], promote_options="default")
        got = [tuple(x.values())[:5] for x in sd._mark(1, 200, False)(table, answers).to_pylist()]
        assert sorted(got) == strings_removed(rows) and [x[2] for x in got] == [0] * 6 + [260, 260, 0]
