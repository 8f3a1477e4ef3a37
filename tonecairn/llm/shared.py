"""What several operators need: the shared working folder and column picking."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: dict[str, SparkSession] = {}  # folders of written tables, and the session that wrote them
_PATH_OF = "_written_to"


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent a folder under the warehouse is taken, but
    only by a local session: on a cluster that could be a folder of one
    machine, so there the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(clean_up)
    _MADE[path] = spark
    return path


_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep_table(df: DataFrame, label: str, release: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    With ``release`` Spark deletes the shuffle files of the write when it has ended, and not some time later.
    """
    spark = df.sparkSession
    path = work_dir(spark, label)
    before = spark.conf.get(_CLEAN_SHUFFLES, "false")
    spark.conf.set(_CLEAN_SHUFFLES, "true" if release else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_SHUFFLES, before)
    kept = spark.read.schema(df.schema).parquet(path)
    setattr(kept, _PATH_OF, path)
    return kept


def drop_table(kept: DataFrame) -> None:
    """Delete what ``keep_table`` wrote, once nothing reads it any more."""
    _delete(getattr(kept, _PATH_OF))


def _delete(path: str) -> None:
    spark = _MADE.pop(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clean_up() -> None:
    """Delete all written tables of this process. Results that still read them are void; called when the process ends, too."""
    for path, spark in list(_MADE.items()):
        if spark.sparkContext._jsc is not None:
            _delete(path)
    _MADE.clear()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def is_held_out(doc_id):
    """crc32 of the id as text, mod 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many leading underscores as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def text_batches(df: DataFrame, most: str = "4m") -> DataFrame:
    """``df``, in a session that sends texts to Python in small batches: the default of 64 MB costs a task several times as much.

    A session in which the setting was changed keeps it.
    """
    conf = df.sparkSession.conf
    if conf.get(_ARROW_BYTES, "67108864b") in ("67108864b", "67108864"):
        conf.set(_ARROW_BYTES, most)
    return df
