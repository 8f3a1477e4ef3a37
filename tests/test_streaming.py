import datetime as dt

from tonecairn.streaming import changes


def test_upsert_stream_equals_a_batch(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    ddl = "path string, at long, tag string"
    for k in range(3):
        rows = [(f"p{i}", 10 * k + i % 2, f"t{k}{i}") for i in range(k, k + 3)] + [(f"p{k}", 10 * k + 5, "last")]
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(source)
    changes.upsert_stream(stream, table, "path", "at", str(tmp_path / "state")).awaitTermination()
    want = changes.last_per_key(spark.read.parquet(source), "path", "at")
    got = changes.version(spark, table, 2)
    assert sorted(map(tuple, got.select("path", "at").collect())) == sorted(map(tuple, want.select("path", "at").collect()))
    assert changes.version(spark, table, -1) is None
    early = sorted(map(tuple, changes.version(spark, table, 1).select("path", "at").collect()))
    assert early != sorted(map(tuple, got.select("path", "at").collect()))
    before = sorted(map(tuple, got.select("path", "at", "tag").collect()))
    changes.compact(spark, table, 2)
    after = spark.read.parquet(table)
    assert {r["batch"] for r in after.select("batch").distinct().collect()} == {2} and sorted(map(tuple, changes.version(spark, table, 2).select("path", "at", "tag").collect())) == before


def test_late_changes_do_not_win(spark, tmp_path):
    source, table, ddl = str(tmp_path / "in"), str(tmp_path / "table"), "path string, at long, tag string"
    for rows in ([("p", 9, "new"), ("q", 1, "a")], [("p", 3, "late"), ("q", 1, "b")]):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ddl).parquet(source)
        changes.upsert_stream(stream, table, "path", "at", str(tmp_path / "state")).awaitTermination()
    assert sorted(map(tuple, changes.version(spark, table, 1).select("path", "at", "tag").collect())) == [("p", 9, "new"), ("q", 1, "b")]


def test_window_levels(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, start + dt.timedelta(minutes=m), float(m)) for m in range(20)]
    folder = str(tmp_path / "events")
    spark.createDataFrame(rows, "sample_id long, ts timestamp, x double").write.parquet(folder)
    stream = changes.window_levels(spark.readStream.schema("sample_id long, ts timestamp, x double").parquet(folder))
    query = stream.writeStream.format("memory").queryName("levels").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r["peak"], r["frames"]) for r in spark.table("levels").collect())
    assert got == [(4.0, 5), (9.0, 5), (14.0, 5), (19.0, 5)]
