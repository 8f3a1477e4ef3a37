"""Queries on whole tables against SQL of their own, without any subset, prefix or cap."""

import duckdb
import pytest

from tonecairn.plans import catalogue, rules

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in "orders lineitem events documents embeddings pages benchmark".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return lambda text: sorted(con.sql(text).fetchall())


def rows(spark, name, *columns):
    return sorted(tuple(r) for r in catalogue.QUERIES[name](spark, DATA).select(*columns).collect())


def test_capture_grid_of_every_order(spark, whole):
    got = rows(spark, "capture_grid", "plan", "note", "velocity", "take")
    assert got == whole("""SELECT o_orderkey, n, v, t FROM orders, range(36, 61) a(n), (VALUES (42), (97), (118)) b(v), range(1, 3) c(t)
        WHERE (n - 36) % (o_orderkey % 5 + 2) = 0""")


def test_key_lookup_answers_every_key(spark, whole):
    got = rows(spark, "key_lookup", "preset", "key", "note")
    presets = {p for p, _, _ in got}
    assert len(got) == 128 * len(presets) == len({(p, k) for p, k, _ in got})
    assert got == whole(rules.ZONES + """, n AS (SELECT DISTINCT preset, note FROM z), c AS (SELECT preset, note, coalesce((lag(note) OVER w + note + 1) // 2, 0) AS low,
        coalesce((note + lead(note) OVER w - 1) // 2, 127) AS high FROM n WINDOW w AS (PARTITION BY preset ORDER BY note))
        SELECT preset, key, note FROM c JOIN range(0, 128) t(key) ON key BETWEEN low AND high""")


def test_names_of_whole_texts(spark, whole):
    blanks = "[\\x09-\\x0D\\x1C-\\x1F\\x{85}\\p{Z}]+"
    assert rows(spark, "sanitise_names", "doc_id", "safe", "spaced") == whole(f"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_]', '_', 'g'), '_+', '_', 'g'), '_'),
        trim(regexp_replace(replace(text, '.', ' '), '{blanks}', ' ', 'g')) FROM documents""")
    assert rows(spark, "xml_names", "doc_id", "escaped", "back") == whole(
        """SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), true FROM documents"""
    )


def test_said_by_the_whole_item(spark, tmp_path):
    text = {1: "the and que die ing to the and que", 2: "the and que die ing nothing", 3: "", 4: "the and que die ing tonic"}
    spark.createDataFrame(list(text.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["item_id"]: (r["named"], r["said"]) for r in catalogue.QUERIES["said_by_tags"](spark, str(tmp_path)).collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (False, False), 4: (True, False)}


def test_every_page_is_matched_against_all_others(spark, whole):
    got = rows(spark, "suffix_match", "page_id", "found", "parts")
    assert got == whole("""WITH x AS (SELECT page_id, url, string_split(lower(url), '/') AS parts FROM pages),
        s AS (SELECT page_id, url, len(parts) - k + 1 AS n, array_to_string(parts[k:], '/') AS tail FROM x, range(1, 40) t(k) WHERE k <= len(parts))
        SELECT w.page_id, f.url, w.n FROM s w JOIN s f ON w.tail = f.tail AND w.page_id <> f.page_id QUALIFY row_number() OVER (PARTITION BY w.page_id ORDER BY w.n DESC, f.url) = 1""")


def test_matches_of_pages_with_equal_tails(spark):
    from tonecairn.operators.tables import locate_other

    pages = [(10, "a/x/i"), (20, "b/x/i"), (20, "0/x/i"), (30, "c/i"), (40, "c/I"), (50, "alone"), (60, None)]
    got = {r["k"]: (r["found"], r["parts"]) for r in locate_other(spark.createDataFrame(pages, "k long, path string"), "k").collect()}
    assert got == {10: ("0/x/i", 2), 20: ("a/x/i", 2), 30: ("c/I", 2), 40: ("c/i", 2)}


def test_distances_of_all_pairs_of_all_labels(spark, monkeypatch):
    import numpy as np

    from tonecairn.plans import spectral

    monkeypatch.setattr(spectral, "_BLOCK", 7)
    by_label = {}
    for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect():
        by_label.setdefault(r["label"], []).append((r["vec_id"], r["embedding"]))
    want = {}
    for group in by_label.values():
        v = np.array([x for _, x in group], np.float64)
        z = (v - v.mean(0)) / (v.std(0) + 1e-9)
        d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
        want |= {(a, b): d[i, j] for i, (a, _) in enumerate(group) for j, (b, _) in enumerate(group) if a < b}
    got = [((r["a"], r["b"]), r["distance"]) for r in catalogue.QUERIES["zscore_distance"](spark, DATA).collect()]
    assert len(got) == len(want) and dict(got).keys() == want.keys()
    assert all(abs(d - want[k]) < 2e-6 for k, d in got)


def shuffled(spark):
    """Bytes that each stage so far has written to shuffles."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


@pytest.mark.parametrize("block", [1024, 60])
def test_distances_shuffle_no_more_than_the_input_a_few_times(spark, monkeypatch, tmp_path, block):
    import numpy as np

    from tonecairn.plans import spectral

    monkeypatch.setattr(spectral, "_BLOCK", block)
    r = np.random.default_rng(5)
    v = r.standard_normal((2400, 32)).astype(np.float32)
    v[100:140] = v[7]  # copies
    v[140:180] = v[8] + 1e-4 * v[140:180]  # and nearly
    labels = [1] * 2300 + [2] * 60 + [3] + [None] * 39
    ids = [None if i in (5, 2310) else 3 * i for i in range(2400)]
    rows = [(i, x.tolist(), k) for i, x, k in zip(ids, v, labels)] + [(9999, None, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    before = shuffled(spark)
    got = catalogue.QUERIES["zscore_distance"](spark, str(tmp_path)).toArrow()
    sent = sum(n for stage, n in shuffled(spark).items() if stage not in before)
    assert sent < 4 * v.nbytes  # more if vectors are sent for each pair of blocks
    assert got.schema.names == ["a", "b", "distance"] and got.num_rows == 2299 * 2298 // 2 + 59 * 58 // 2
    a, b, d = (got.column(c).to_numpy() for c in ("a", "b", "distance"))
    assert (a < b).all() and len(np.unique(a * 10000 + b)) == len(a)
    z = np.empty((2400, 32))
    for k in (1, 2):
        at = [i for i, x in enumerate(labels) if x == k]
        x = v[at].astype(np.float64)
        z[at] = (x - x.mean(0)) / (x.std(0) + 1e-9)
    for at in range(0, len(a), 1 << 18):
        i, j = a[at : at + (1 << 18)] // 3, b[at : at + (1 << 18)] // 3
        assert np.abs(np.sqrt(((z[i] - z[j]) ** 2).sum(1)) - d[at : at + (1 << 18)]).max() < 5.01e-7


def test_mixdown_of_all_frames_at_even_offsets(spark, whole):
    got = rows(spark, "mixdown", "set_id", "place", "x")
    assert got == whole("""WITH f AS (SELECT user_id, event_type, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
        k AS (SELECT event_type, x, i + 4 * (dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) - 1) AS place FROM f)
        SELECT event_type, place, CAST(sum(CAST(x AS DECIMAL(18,2))) AS DOUBLE) FROM k GROUP BY 1, 2""")
