"""Reader of the catalogue's tables, and tables written between steps."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, SparkSession] = {}  # folders of written tables, and the session that wrote them


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, deleted when the process ends.

    Where the setting is absent a local session takes a folder under its
    warehouse; a cluster must name a folder that all its machines share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_clean_up)
    _MADE[path] = spark
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts its lineage and survives lost executors."""
    path = work_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _clean_up() -> None:
    for path, spark in list(_MADE.items()):
        if spark.sparkContext._jsc is not None:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _MADE.clear()
