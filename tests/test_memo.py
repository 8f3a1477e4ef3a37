"""Memo, render store and their counters against plain dictionaries."""

import random

from pyspark.sql import functions as F

from tonecairn.sources import memo
from tonecairn.streaming import renders


def lengths(df):
    return df.select(memo.KEY, F.length("text").alias("size"))


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)


def test_second_run_makes_nothing_and_a_changed_configuration_makes_all(spark, tmp_path):
    kept = memo.Memo(spark, str(tmp_path / "memo"), "size int")
    texts = ["a", "bb", "bb", "", None, "ccc"] + ["hot"] * 20
    first, met = kept.through(rows(spark, texts), ["text"], lengths, {"rate": 1}, "v1")
    assert (met.hits, met.misses, met.made) == (0, 26, 6)
    want = sorted((i, None if t is None else len(t)) for i, t in enumerate(texts))
    assert sorted((r["id"], r["size"]) for r in first.collect()) == want
    again, met = kept.through(rows(spark, texts), ["text"], lengths, {"rate": 1}, "v1")
    assert (met.hits, met.misses, met.made, met.rate) == (26, 0, 0, 1.0) and sorted((r["id"], r["size"]) for r in again.collect()) == want
    for config, code in (({"rate": 2}, "v1"), ({"rate": 1}, "v2")):
        assert kept.through(rows(spark, texts), ["text"], lengths, config, code)[1].made == 6
    _, met = kept.through(rows(spark, [*texts, "new"]), ["text"], lengths, {"rate": 1}, "v1")
    assert (met.hits, met.misses, met.made) == (26, 1, 1)
    before = sorted(map(tuple, kept.results().collect()))
    kept.compact()
    assert len(kept._parts()) == 1 and sorted(map(tuple, kept.results().collect())) == before
    assert memo.Memo(spark, str(tmp_path / "none"), "size int").through(rows(spark, []), ["text"], lengths, {}, "")[1].rate is None


def test_a_part_that_was_not_finished_is_not_seen(spark, tmp_path):
    kept = memo.Memo(spark, str(tmp_path / "memo"), "size int")
    kept.through(rows(spark, ["a"]), ["text"], lengths, {}, "")

    def broken(df):
        return df.select(memo.KEY, F.raise_error(F.lit("lost")).cast("int").alias("size"))

    try:
        kept.through(rows(spark, ["b"]), ["text"], broken, {}, "")
        raise AssertionError("it should have failed")
    except Exception as e:
        assert "lost" in str(e)
    assert kept.results().count() == 1
    assert kept.through(rows(spark, ["a", "b"]), ["text"], lengths, {}, "")[1].made == 1


def test_code_digest_changes_with_the_source():
    assert memo.code_digest(memo) == memo.code_digest(memo) != memo.code_digest(memo, renders)


def entries(r, n):
    out = []
    for _ in range(n):
        key, frames = r.randint(0, 9), r.randint(1, 40)
        out.append((key, frames / 10, [float(key * 100 + i) for i in range(frames)]))
    return out


def test_stream_in_any_order_equals_the_batch(spark, tmp_path):
    r, ddl = random.Random(1), "key long, seconds double, xs array<double>"
    all_ = entries(r, 60)
    for name in ("one", "two"):
        r.shuffle(all_)
        source = str(tmp_path / name)
        for k in range(0, 60, 15):
            spark.createDataFrame(all_[k : k + 15] + all_[:3], ddl).coalesce(1).write.mode("append").parquet(source)  # three come again and again
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(source)
        renders.longest_stream(stream, str(tmp_path / f"{name}-table"), str(tmp_path / f"{name}-state"))
        got = sorted(map(tuple, renders.stored(spark, str(tmp_path / f"{name}-table")).collect()))
        assert got == sorted(map(tuple, memo.longest_entries(spark.createDataFrame(all_, ddl)).collect())) and len(got) == 10
        assert spark.read.parquet(str(tmp_path / f"{name}-table")).count() < 60


def test_prefixes_are_served_and_misses_are_logged(spark, tmp_path):
    r = random.Random(2)
    made = entries(r, 40)
    store = memo.longest_entries(spark.createDataFrame(made, "key long, seconds double, xs array<double>"))
    longest = {}
    for key, seconds, xs in made:
        longest[key] = max(longest.get(key, (0, [])), (seconds, xs))
    asked = [(k, r.randint(0, 12), r.randint(0, 50) / 10) for k in range(200)]
    requests = spark.createDataFrame(asked, "id long, key long, seconds double")
    plan = memo.served(requests, store, 10.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2  # requests and store, once each
    counters = memo.serve_and_log(requests, store, 10.0, str(tmp_path / "answers"), str(tmp_path / "log"))
    got = {x["id"]: x for x in spark.read.parquet(str(tmp_path / "answers")).collect()}
    hits = 0
    for i, key, seconds in asked:
        have = longest.get(key)
        if have is None or have[0] < seconds - 1e-6:
            assert got[i]["why"] == ("no entry" if have is None else "stored entry too short") and got[i]["xs"] is None
        else:
            hits += 1
            assert got[i]["why"] is None and got[i]["xs"] == have[1][: round(seconds * 10)]
    log = spark.read.parquet(str(tmp_path / "log"))
    assert counters["hits"] == hits and counters["unknown"] + counters["too_short"] == log.count() == 200 - hits
    assert counters["frames"] == sum(len(x["xs"]) for x in got.values() if x["xs"] is not None)


def test_analysis_is_looked_up(spark, tmp_path):
    import numpy as np

    from tonecairn.operators import sets

    rate, t = 8000, np.arange(16000) / 8000
    tone = (np.sin(2 * np.pi * 220 * t) * np.minimum(1, 20 * t)).tolist()
    rows = [(s, i, 57, 100, 1, rate, xs, 12000) for s, i, xs in (("a", 1, tone), ("b", 1, tone), ("b", 2, [0.5 * x for x in tone]), ("b", 3, []))]
    samples = spark.createDataFrame(rows, "set_id string, sample_id long, note int, velocity int, take int, rate int, xs array<double>, note_off int")
    want = sorted(map(str, sets.analyse(samples).collect()))
    kept = sets.memo_of(spark, str(tmp_path / "memo"))
    for made in (3, 0):  # two sets have one sample in common
        done, met = sets.analyse_memoised(samples, kept)
        assert met.made == made and sorted(map(str, done.collect())) == want
    assert sets.analyse_memoised(samples, kept, bpm=120.0)[1].made == 3
