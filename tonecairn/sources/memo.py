"""Results kept by what they were made from, and the longest renders kept by what was rendered.

A memo is a folder of parts. A part is written as a whole: readers take only
parts that Spark has marked as complete, so a job that is killed leaves nothing
that is seen, and two jobs at once can at worst write a result twice. Keys
cover the content, the fields, the configuration and the code, so nothing has
to be invalidated: what changes is not found.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from types import ModuleType

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

KEY = "memo_key"


def code_digest(*modules: ModuleType) -> str:
    """Changes whenever the source of a module or the release of a library that it counts with does."""
    import numpy

    text = "\0".join([numpy.__version__, *(inspect.getsource(m) for m in modules)])
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def memo_key(fields: list[str], config: dict, code: str) -> Column:
    """SHA-256 of the fields of a row by name, of the configuration and of the code."""
    fixed = json.dumps(config, sort_keys=True, default=str)
    content = F.to_json(F.struct(*(F.col(f) for f in sorted(fields))), {"ignoreNullFields": "false"})
    return F.sha2(F.concat_ws("\x1f", F.lit(code), F.lit(fixed), content), 256)


@dataclass(frozen=True)
class Counted:
    """What a pass met: rows whose result was there, rows whose result wasn't, and results that were made."""

    hits: int
    misses: int
    made: int

    @property
    def rate(self) -> float | None:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else None


class Memo:
    """A folder of results with the columns ``ddl``, by ``memo_key``."""

    def __init__(self, spark: SparkSession, folder: str, ddl: str) -> None:
        self.spark, self.folder, self.ddl = spark, folder.rstrip("/"), f"{KEY} string, {ddl}"

    def _parts(self) -> list[str]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/part=*/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(str(f.getPath().getParent()) for f in found) if found is not None else []

    def results(self) -> DataFrame:
        """One row for each key that has a result."""
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], self.ddl)
        return self.spark.read.schema(self.ddl).parquet(*parts).dropDuplicates([KEY])

    def through(self, rows: DataFrame, fields: list[str], kernel: Callable[[DataFrame], DataFrame], config: dict, code: str) -> tuple[DataFrame, Counted]:
        """``rows`` with their results, and what the pass met.

        ``kernel`` gets each content that has no result once, as a row with the
        columns of ``rows`` and the key, and returns the key with the results'
        columns. Hits and misses are observed while the misses are looked for.
        """
        seen, made = Observation(), Observation()
        keyed = rows.withColumn(KEY, memo_key(fields, config, code))
        known = self.results().select(KEY, F.lit(True).alias("_known"))
        # one row for each content before it moves: a content that a third of all rows have is a row of each task
        once = keyed.groupBy(KEY).agg(F.count(F.lit(1)).alias("_rows"), *(F.first(c).alias(c) for c in rows.columns))
        of = lambda there: F.coalesce(F.sum(F.when(there, F.col("_rows"))), F.lit(0))
        looked = once.join(known, KEY, "left").observe(seen, of(F.col("_known").isNotNull()).alias("hits"), of(F.col("_known").isNull()).alias("misses"))
        missing = looked.where(F.col("_known").isNull()).drop("_known", "_rows")
        names = [c.split()[0] for c in self.ddl.split(", ")]
        results = kernel(missing).select(*names).observe(made, F.count(F.lit(1)).alias("made"))
        results.write.parquet(f"{self.folder}/part={uuid.uuid4().hex}")
        counted = Counted(seen.get["hits"], seen.get["misses"], made.get["made"])
        return keyed.join(self.results(), KEY, "left"), counted

    def compact(self) -> None:
        """All parts as one; a reader sees either, and each result once."""
        old = self._parts()
        if len(old) < 2:
            return
        self.results().write.parquet(f"{self.folder}/part={uuid.uuid4().hex}")
        for part in old:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# By how much a stored render may be short of a request, in seconds and in frames.
SHORT_SECONDS, SHORT_FRAMES = 1e-6, 2


def longest_entries(entries: DataFrame) -> DataFrame:
    """(key, seconds, xs): of the renders of a key the longest; of equally long ones the one with the least values."""
    best = F.min_by(F.struct("seconds", "xs"), F.struct((-F.col("seconds")).alias("s"), "xs")).alias("e")
    return entries.groupBy("key").agg(best).select("key", "e.seconds", "e.xs")


def served(requests: DataFrame, store: DataFrame, rate: float) -> DataFrame:
    """``requests`` (key, seconds, ...) with ``xs``, cut from the stored render, and ``why`` where there is none.

    The beginning of a longer render is the shorter render, so an entry serves every request up to its length.
    """
    want = F.round(F.col("seconds") * rate).cast("int")
    kept = store.select("key", F.col("seconds").alias("_stored"), F.col("xs").alias("_xs"))
    found = requests.join(kept, "key", "left").withColumn("_want", want)
    long_enough = (F.col("_stored") >= F.col("seconds") - SHORT_SECONDS) & (F.size("_xs") >= F.col("_want") - SHORT_FRAMES)
    why = F.when(F.col("_stored").isNull(), "no entry").when(~long_enough, "stored entry too short")
    return found.withColumn("why", why).withColumn("xs", F.when(F.col("why").isNull(), F.slice("_xs", F.lit(1), F.greatest("_want", F.lit(0))))).drop("_xs", "_want").withColumnRenamed("_stored", "stored_seconds")


def serve_and_log(requests: DataFrame, store: DataFrame, rate: float, answers: str, log: str) -> dict:
    """Write the answers to one folder and the misses, with their reason, to another; the counters of the pass that wrote the answers.

    Requests and store are read once: counters are observed on the way, and the log is taken from the answers.
    """
    counters = Observation()
    passed = served(requests, store, rate).observe(
        counters,
        F.count_if(F.col("why").isNull()).alias("hits"),
        F.count_if(F.col("why") == "no entry").alias("unknown"),
        F.count_if(F.col("why") == "stored entry too short").alias("too_short"),
        F.coalesce(F.sum(F.when(F.col("why").isNull(), F.size("xs"))), F.lit(0)).cast("long").alias("frames"),
    )
    passed.write.parquet(answers)
    requests.sparkSession.read.parquet(answers).where("why IS NOT NULL").select("key", "why", F.col("seconds").alias("want_s"), F.col("stored_seconds").alias("stored_s")).write.mode("append").parquet(log)
    return counters.get
