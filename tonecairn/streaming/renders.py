"""The store of longest renders as a stream: state that only grows, whatever the order in which renders arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.memo import longest_entries

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Longest(StatefulProcessor):
    """Keeps of each key the longest render and sends it on when a longer one has come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "seconds double, xs array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.best.get()
        best = None if held is None else (-held[0], list(held[1]))
        for part in rows:
            for seconds, xs in zip(part["seconds"], part["xs"], strict=True):
                entry = (-float(seconds), [float(x) for x in xs])
                best = entry if best is None else min(best, entry)
        if held is None or best != (-held[0], list(held[1])):
            self.best.update((-best[0], best[1]))
            yield pd.DataFrame({"key": [key[0]], "seconds": [-best[0]], "xs": [best[1]]})

    def close(self) -> None:
        pass


def longest_stream(entries: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Run a stream of renders (key, seconds, xs) into ``table``, a folder with a part for each micro-batch.

    State holds one render for a key. A batch that is repeated after a failure
    replaces its own part. ``stored`` reads the table.
    """
    spark = entries.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # the stream keeps the setting that it began with
    changed = entries.groupBy("key").transformWithStateInPandas(Longest(), "key long, seconds double, xs array<double>", "update", "none")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{table}/batch={number}")
    query = changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if before is None:
        spark.conf.unset(_PROVIDER)
    else:
        spark.conf.set(_PROVIDER, before)
    return query


def stored(spark, table: str) -> DataFrame:
    """The longest render of each key so far."""
    return longest_entries(spark.read.parquet(table).select(F.col("key").cast("long").alias("key"), "seconds", "xs"))
