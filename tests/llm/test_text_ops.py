"""Decontamination, classifier, pieces, HTML, chat, neighbours and archives."""

import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tonecairn.llm import ann_forest, chat_format, decontaminate, html_text, pieces, quality, warc

BENCHMARK = [(1, "Alpha beta gamma delta epsilon zeta eta theta. Iota kappa lambda mu nu xi omicron pi."), (2, None), (3, "too short"), (4, ""), (5, "Rho sigma tau upsilon phi chi psi omega one two")]


def filler(n, seed):
    r = random.Random(seed)
    return " ".join(f"word{r.randint(0, 999)}" for _ in range(n))


def tiles_by_hand(doc, item, least):
    """Greedy string tiling the slow way."""
    d_free, i_free, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = []
        for a in range(len(doc)):
            for b in range(len(item)):
                k = 0
                while a + k < len(doc) and b + k < len(item) and d_free[a + k] and i_free[b + k] and doc[a + k] == item[b + k]:
                    k += 1
                if k >= least:
                    best.append((-k, a, b))
        if not best:
            return out
        longest = min(best)[0]
        for k, a, b in sorted(best):
            if k == longest and all(d_free[a : a - k]) and all(i_free[b : b - k]):
                d_free[a : a - k] = [False] * -k
                i_free[b : b - k] = [False] * -k
                out.append((a, b, -k))


def test_tiling_equals_the_slow_way():
    r = random.Random(4)
    for _ in range(200):
        doc, item = [r.randint(0, 3) for _ in range(25)], [r.randint(0, 3) for _ in range(12)]
        assert decontaminate.tile(np.array(doc, np.uint64), np.array(item, np.uint64), 2) == tiles_by_hand(doc, item, 2)


def test_contaminated_documents(spark):
    item = BENCHMARK[0][1]
    first, second = item.split(". ")
    rows = [
        (1, filler(50, 1)), (2, filler(20, 2) + " " + item.upper() + " " + filler(20, 3)), (3, f"{second} {filler(9, 4)} {first}"),
        (4, " ".join(first.split()[:6])), (5, None), (6, ""), (None, item), (2, item), (7, filler(30_000, 5) + " " + item),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    for block_bytes in (1 << 20, 60):
        found = decontaminate.find_contaminated(docs, benchmark, block_bytes=block_bytes).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["item_id"]) for r in found) == [(-1, 1), (2, 1), (2, 1), (3, 1), (7, 1)]
    left = decontaminate.without_contaminated(docs, benchmark)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 4, 5, 6]
    assert decontaminate.find_contaminated(docs.limit(0), benchmark).count() == 0
    assert decontaminate.find_contaminated(docs, benchmark.limit(0)).count() == 0


def test_whole_operator_against_brute_force(spark):
    """Repetitive texts in which seeds occur many times on both sides."""
    r = random.Random(12)
    sentence = lambda n: " ".join(r.choice("abcd") for _ in range(n))
    items = [(k, sentence(r.randint(1, 30))) for k in range(25)]
    docs = [(k, " ".join(r.choice([sentence(9), r.choice(items)[1], "x"]) for _ in range(r.randint(0, 6)))) for k in range(60)]
    want = {}
    for d, text in docs:
        for i, item in items:
            tiles = tiles_by_hand(text.split(), item.split(), 5) if len(item.split()) >= 5 else []
            if tiles and sum(t[2] for t in tiles) >= 0.5 * len(item.split()):
                want[d, i] = (len(item.split()), sum(t[2] for t in tiles), len(tiles), max(t[2] for t in tiles))
    made = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string").repartition(2)
    for block_bytes in (1 << 20, 300):
        found = decontaminate.find_contaminated(made(docs, "doc_id"), made(items, "item_id"), block_bytes=block_bytes).collect()
        assert {(x["doc_id"], x["item_id"]): (x["item_tokens"], x["covered_tokens"], x["n_tiles"], x["longest_tile"]) for x in found} == want
        left = decontaminate.without_contaminated(made(docs, "doc_id"), made(items, "item_id"), block_bytes=block_bytes).collect()
        assert {x["doc_id"] for x in left} == {d for d, _ in docs} - {d for d, _ in want}


def test_four_megabytes_of_one_token():
    import time

    items = decontaminate.Items([1, 2], pa.array([" ".join(["a"] * 60), " ".join(f"w{k}" for k in range(40))]), 5)
    text = pa.array(["a " * (2 << 20), " ".join(["a"] * 80 + [f"w{k}" for k in range(20)] * 3)])
    began = time.monotonic()
    assert [m[:3] for m in items.matches(text, 0.5)] == [(0, 0, 60), (1, 0, 60), (1, 1, 20)]
    assert time.monotonic() - began < 30


def test_boosting_learns_and_is_defined_without_labels():
    r = np.random.default_rng(0)
    x = r.standard_normal((3000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    assert (quality.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))) == 0.5).all()
    assert (quality.fit(np.zeros((4, 3)), np.ones(4)).score(np.zeros((2, 3))) > 0.99).all()


def test_trees_are_walked_as_written():
    r = np.random.default_rng(1)
    x = r.standard_normal((400, 4))
    model = quality.fit(x, (x[:, 1] > 0).astype(float), trees=5, depth=3)

    def walk(row):
        total = model.base
        for node in model.roots:
            while model.feature[node] >= 0:
                node = model.left[node] + (row[model.feature[node]] > model.threshold[node])
            total += model.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x), [walk(row) for row in x])


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    scores = quality.op4_quality(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = scores.join(labels, "doc_id").where("held_out").collect()
    assert scores.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (None, "", 9.0), (1, "a b " * 50_000, 9.0), (1, "a", 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.with_scores(docs, model, ["doc_id"]).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.above(docs, model).columns == docs.columns
    assert quality.with_scores(docs.limit(0), quality.train(docs.limit(0), labels.limit(0)), ["doc_id"]).count() == 0


MODEL = pieces.MODEL


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary")
def test_pieces_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(9)
    alphabet = "abcdetnoi  ▁\n\té€日.,'ers😀"
    texts = [None, "", " ", "   ", "a" * 3000, " " * 37 + "x" + " " * 9, "▁▁▁▁", "<s> </s> <0x41>", "\x00"]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 80))) for _ in range(1500)]
    encoder, decoder = pieces.Encoder(pieces.read_model(spark, MODEL), most_words=500), pieces.Decoder(pieces.read_model(spark, MODEL))
    for part in (texts[:700], texts[700:]):
        ids, offsets = encoder.encode(pa.array(part, pa.string()))
        back = decoder.decode(ids, offsets)
        for k, t in enumerate(part):
            want = library.encode(t or "")
            assert ids[offsets[k] : offsets[k + 1]].tolist() == want
            assert back[k] == library.decode(want)
    frame = spark.createDataFrame([(1, t, "clash") for t in texts[:50]], "doc_id long, text string, ids string")
    encoded = pieces.with_ids(frame)
    assert encoded.columns == ["doc_id", "ids"] and encoded.count() == 50
    assert sorted(x["text"] for x in pieces.with_text(encoded).collect()) == sorted((t or "").replace("▁", " ") for t in texts[:50])
    assert pieces.with_ids(frame.limit(0)).count() == 0


PAGE = """<!doctype html><html><head><title>t</title><script>var a="<p>no</p>"</script></head><body>
<header>Site</header><nav><ul><li><a href=x>Home</a><li><a href=y>More</a></ul></nav><div class="cookie-notice">We use</div>
<div id=main><h1>Head &amp; line</h1><div class="adBanner"><p>Buy this now</p></div><p>First   para
with <a href=z>a link</a> in it and enough text to be dense.<p>Second one, also of some length, &lt;b&gt; kept.<ul><li>item one<li>item two</ul>
<table><tr><td>cell<td>next</table></div><aside>side</aside><div class=comments><p>Reader says</div><form>f<input></form><footer>end</footer>"""


def test_main_text():
    assert html_text.extract(PAGE) == "Head & line\nFirst para with a link in it and enough text to be dense.\nSecond one, also of some length, <b> kept.\nitem one\nitem two\ncell\nnext"
    for none in (None, "", "   ", "<p>", "<!-- x", "<script>a"):
        assert html_text.extract(none) == ""
    assert html_text.extract("plain & text") == "plain & text"
    assert html_text.extract("<article><h1>A</h1><p>b</article>") == "A\nb"
    assert len(html_text.extract("<p>" + "x " * 500_000)) == 999_999
    assert html_text.extract("<div>" * 3000 + "deep") == "deep"


def test_pages(spark):
    rows = [(1, "u", PAGE, "a"), (1, None, None, "b"), (None, "u", "", "c"), (1, "u", PAGE, "a")]
    got = html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert [r["n_chars"] for r in got.collect()].count(0) == 2 and got.count() == 4


def chat(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss string")


@pytest.mark.parametrize("block", [1, 64])
def test_chat_round_trip(spark, block):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<|", "<\\|", "<\\\\|x", "a<|im_end|>\n", "", None, "é\n\n", "z" * 200_000]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t, "x") for k, t in enumerate(nasty)]
    rows += [(2, None, None, "n", "x"), (2, None, "odd\nrole\\n<|", "m", "x"), (None, 0, "user", "q", "x"), (None, 0, "user", "q", "x"), (3, 0, "assistant", "early", "x"), (4, 0, "user", "u", "x"), (4, 1, "assistant", "a", "x")]
    done = chat_format.format_conversations(chat(spark, rows), block_turns=block)
    from pyspark.sql import functions as F

    back = {r["conv_id"]: r for r in done.withColumn("turns", chat_format.read_back(F.col("formatted"))).collect()}
    for conv in (1, 2, None, 3, 4):
        want = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == [(w[2], w[3]) for w in want]
        assert back[conv]["n_turns"] == len(want)
    assert back[4]["valid"] and not back[3]["valid"] and back[3]["final_state"] == "error"
    assert [s["loss"] for s in back[4]["segments"]] == [False, False, False, False, True, False]
    assert chat_format.format_conversations(chat(spark, rows).limit(0)).count() == 0


def test_neighbours(spark):
    r = np.random.default_rng(5)
    v = r.standard_normal((600, 8))
    v[100:300] = v[100]
    rows = [(i, x.tolist(), "a") for i, x in enumerate(v)] + [(900, None, "a"), (901, [0.0] * 8, "a"), (902, [float("nan")] * 8, "a"), (903, [1.0, None] + [0.0] * 6, "a"), (904, [1.0, 2.0], "a"), (None, v[0].tolist(), "a"), (7, v[7].tolist(), "a"), (905, [], "a")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = ann_forest.nearest(frame, frame.where("vec_id % 20 = 0"), k=20, block_rows=150).collect()
    found, hits = {}, 0
    for x in got:
        found.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    assert set(found) == {*range(0, 600, 20)}
    for q, answer in found.items():
        answer.sort()
        scores = v @ v[q]
        order = [i for i in np.lexsort((np.arange(600), -np.round(scores, 12))).tolist() if i != q][:20]
        hits += len({a[1] for a in answer} & set(order))
        assert [a[0] for a in answer] == list(range(1, 21)) and q not in {a[1] for a in answer}
        assert all(abs(scores[a[1]] - a[2]) < 1e-9 for a in answer)
    assert hits / (20 * len(found)) >= 0.9
    close = v[500] + 1e-6 * r.standard_normal((12, 8))  # found by all trees, yet too few
    near = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.concatenate([v[:100], v[300:], close]))], "vec_id long, embedding array<double>")
    assert near.sparkSession is spark and ann_forest.nearest(near, near.where("vec_id = 400")).count() == 20
    few = spark.createDataFrame([(20, [1.0, 0.0]), (21, [1.0, 1.0]), (22, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(x["vec_id"], x["rank"]) for x in ann_forest.nearest(few, few.where("vec_id = 20")).orderBy("rank").collect()] == [(21, 1), (22, 2)]
    assert ann_forest.nearest(few.limit(0), few).count() == 0


def test_recall_on_the_tables(spark):
    """Recall of at least 0.9 against brute force, while much less than a block is scored."""
    folder = "/root/testdata/check_s" if os.path.isdir("/root/testdata/check_s") else "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    import pyarrow.parquet as pq

    table = pq.read_table(f"{folder}/embeddings.parquet")
    v, ids = np.array(table.column("embedding").to_pylist(), float), table.column("vec_id").to_numpy()
    asked = np.flatnonzero(ids % 20 == 0)[::8]
    forest, hits = ann_forest.Forest(v), 0
    scores = v @ v[asked].T
    for q, rows, _ in forest.search(v[asked], 21, 4096):
        best = np.argpartition(-scores[:, q], 20)[:21]
        hits += np.isin(best, rows).sum() - 1
    assert hits >= 0.93 * 20 * len(asked)
    share = [len(rows) / len(v) for _, rows in forest.candidates(v[asked], 4096)]
    assert folder.endswith("sf0.1") or np.mean(share) < 0.4


def test_archives(spark):
    rows = [(3, "http://a/ b\r\n%41", "<p>x</p>"), (1, None, "<p>x</p>"), (1, "u", "<p>x</p>"), (2, "u", None), (5, "u", ""), (None, "u", "<p>x</p>"), (6, "é", "ü" * 100_000 + "\r\n\r\n"), (7, "u", "once")]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, archive string").repartition(3)
    index = warc.write_archives(pages)
    got = {(r["page_id"], r["url"]): r for r in warc.read_records(index).collect()}
    assert len(got) == len(rows)
    for page, url, html in rows:
        raw, r = (html or "").encode(), got[(page, url)]
        same = [p for p, _, h in rows if (h or "").encode() == raw and p is not None]
        first = min(same, default=None)
        revisit = first is not None and (page is None or page > first)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), warc.sha1_base32(raw))
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if revisit else ("response", None))
        assert r["payload"] == (None if revisit else raw)
    assert {r["record_type"] for r in warc.read_records(warc.write_archives(pages, min_revisit_bytes=10**9)).collect()} == {"response"}
    chosen = index.where("page_id = 7")
    assert warc.read_records(chosen).collect()[0]["payload"] == b"once"
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0


def test_records_are_named_once_and_digests_equal_plain_ones(spark):
    import gzip

    from pyspark.sql import functions as F

    texts = [None, "", "a", "é€", "x" * 70_000, "<p>x</p>"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, html string").select("k", warc.base32_digest(F.coalesce("html", F.lit(""))).alias("d"))
    assert {r["k"]: r["d"] for r in got.collect()} == {k: warc.sha1_base32((t or "").encode()) for k, t in enumerate(texts)}
    pages = spark.createDataFrame([(1, "u", "same"), (1, "u", "same"), (2, "u", "same"), (None, None, None)], "page_id long, url string, html string").repartition(2)
    names = set()
    for row in warc.write_archives(pages).collect():
        files, root = warc._file_system(row["folder"])
        with files.open_input_file(f"{root}/{row['archive']}") as f:
            head = gzip.decompress(f.read_at(row["length"], row["offset"])).decode()
        names.add(re.search("WARC-Record-ID: (.*)", head)[1])
    assert len(names) == 4


def test_contract_of_archive_digest():
    assert warc.sha1_base32(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert hashlib.sha1(b"").hexdigest().startswith("da39a3ee")


def test_sql_equals_queries_on_the_smallest_tables(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    import duckdb

    from tonecairn.llm import queries

    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    for name, sql in queries.SQL.items():
        frame = queries.QUERIES[name](spark, folder)
        columns = sorted(frame.columns)
        theirs = con.sql(sql).select(*(f'"{c}"' for c in columns)).fetchall()
        assert sorted(map(repr, (tuple(r) for r in frame.select(*columns).collect()))) == sorted(map(repr, theirs)), name


def test_pages_of_the_tables_equal_a_plain_reading(spark):
    """Brute force for the tables' own template: the blocks between the article's tags."""
    import html
    import re

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    for row in html_text.op7_html_extraction(spark, folder).join(spark.read.parquet(f"{folder}/pages.parquet").drop("url"), "page_id").collect():
        inside = row["html"].split("<article>", 1)[1].split("</article>")[0]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>|<br>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", inside))
        assert row["text"] == "\n".join(b for b in blocks if b) and row["n_chars"] == len(row["text"])


def test_pipeline_against_plain_steps(spark):
    """On a small table every stage's result equals the operators' own brute-force rules."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    scores = {r["doc_id"]: r["predicted"] for r in quality.op4_quality(spark, folder).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name.startswith("quality"):
            assert set(after) == {k for k in before if scores[k]}
        elif name.startswith("n-gram"):
            sets = {k: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if (w := t.lower().split()) else set() for k, t in before.items()}
            like = lambda a, b: 100 * len(a & b) >= 75 * len(a | b) > 0
            assert not any(like(sets[a], sets[b]) for a in after for b in after if a < b)
            reached = set(after)
            while more := {k for k in set(before) - reached if any(like(sets[k], sets[r]) for r in reached)}:
                reached |= more
            assert reached == set(before)
        elif name.startswith("substring"):
            seen: dict = {}
            for k in sorted(before):
                w = before[k].split()
                gone = [False] * len(w)
                for i in range(len(w) - 12):
                    if seen.setdefault(tuple(w[i : i + 13]), k) < k:
                        gone[i : i + 13] = [True] * 13
                left = [x for x, g in zip(w, gone, strict=True) if not g]
                assert (k in after) == (bool(left) or not any(gone))
                if k in after:
                    assert after[k] == (before[k] if not any(gone) else " ".join(left))
        else:
            assert all(after[k] == before[k] for k in after)
        counts.append(docs.count())
    ids = corpus_pipeline.run(spark, folder)
    assert ids.count() == counts[-1] and ids.where("size(ids) = n_ids").count() == counts[-1]
