"""Incremental forms of the bounded analogues: a stream of tag changes upserted into a table, and levels of an event stream.

State is bounded: the upsert keeps none, the levels keep one row per signal and window until the watermark passes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def last_per_key(changes: DataFrame, key: str, order: str) -> DataFrame:
    """Of the changes of a key the last; ties go to the largest row."""
    others = sorted(c for c in changes.columns if c not in (key, order))
    w = Window.partitionBy(key).orderBy(F.desc(order), *(F.desc(c) for c in others))
    return changes.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def upsert_stream(changes: DataFrame, table: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Add what each micro-batch changes to a table folder, a part for each batch; a repeated batch rewrites its own part.

    A batch costs what it changes: the table is put together by ``version`` when it is read, and ``compact`` folds parts into one.
    """
    spark = changes.sparkSession
    spark.createDataFrame([(key, order)], "key string, `order` string").coalesce(1).write.mode("overwrite").parquet(f"{table}/_keys")

    def apply(batch: DataFrame, number: int) -> None:
        last_per_key(batch, key, order).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def version(spark: SparkSession, table: str, number: int) -> DataFrame | None:
    """The state after a micro-batch: of a key's changes the last, of those at one time that of the later batch; None before the first."""
    if number < 0:
        return None
    names = spark.read.parquet(f"{table}/_keys").first()
    parts = spark.read.parquet(table).where(F.col("batch") <= number)
    rest = sorted(c for c in parts.columns if c not in (names["key"], names["order"], "batch"))
    w = Window.partitionBy(names["key"]).orderBy(F.desc(names["order"]), F.desc("batch"), *(F.desc(c) for c in rest))
    return parts.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "batch")


def compact(spark: SparkSession, table: str, number: int) -> None:
    """Fold the parts up to a batch into that batch's own. The folded part is whole before others go, and with them it says the same; no stream may run meanwhile."""
    state, before = version(spark, table, number), f"{table}/_folded"
    if state is None:
        return
    state.write.mode("overwrite").parquet(before)
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = files.Path(table).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    spark.read.parquet(before).write.mode("overwrite").parquet(f"{table}/batch={number}")
    for status in system.listStatus(files.Path(table)):
        name = status.getPath().getName()
        if name.startswith("batch=") and int(name[6:]) < number:
            system.delete(status.getPath(), True)
    system.delete(files.Path(before), True)


def window_levels(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Peak and RMS of each signal in tumbling windows of event time. ``events``: (sample_id, ts, x)."""
    d = F.col("x").cast("double")
    return (
        events.withWatermark("ts", late)
        .groupBy("sample_id", F.window("ts", width))
        .agg(F.max(F.abs("x")).alias("peak"), F.sqrt(F.avg(d * d)).alias("rms"), F.count(F.lit(1)).alias("frames"))
        .select("sample_id", F.col("window.start").alias("start"), "peak", "rms", "frames")
    )
