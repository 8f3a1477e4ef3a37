"""Names by rounds: every member of a clash takes its next, longer candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut


def climb(rows: DataFrame, scope: str) -> DataFrame:
    """(id, scope, name, rung) for rows (id, scope, rungs): all members of a clash step up until names are unique or rungs end.

    Rows with one list of rungs in a scope stand at one rung, so rounds move distinct lists with their numbers of rows, and ids
    join their list at the end. Each round sums the rows of every name in the scope, ended by a count of the lists that moved;
    what a round made is written to the shared folder. A list moves at most once for each of its rungs, so it ends.
    """
    name = F.element_at("rungs", F.col("rung") + 1)
    rows = cut(rows.select("id", F.col(scope).alias("_scope"), "rungs"))
    current = cut(rows.groupBy("_scope", "rungs").agg(F.count(F.lit(1)).alias("_rows")).withColumn("rung", F.lit(0)))
    same_name = F.col("_scope").eqNullSafe(F.col("_s")) & F.col("_name").eqNullSafe(F.col("_n"))
    while True:
        named = current.withColumn("_name", name)
        clashes = named.groupBy(F.col("_scope").alias("_s"), F.col("_name").alias("_n")).agg(F.sum("_rows").alias("_all")).where("_all > 1")
        up = F.coalesce(F.col("_all").isNotNull() & (F.col("rung") + 1 < F.size("rungs")), F.lit(False))
        stepped = cut(named.join(clashes, same_name, "left").select("_scope", "rungs", "_rows", "rung", up.alias("_up")))
        moved = stepped.where("_up").limit(1).count()
        current = stepped.withColumn("rung", F.col("rung") + F.col("_up").cast("int")).drop("_up")
        if not moved:
            break
    at = current.select(F.col("_scope").alias("_s"), F.col("rungs").alias("_r"), "rung")
    joined = rows.join(at, F.col("_scope").eqNullSafe(F.col("_s")) & F.col("rungs").eqNullSafe(F.col("_r")))
    return joined.select("id", F.col("_scope").alias(scope), name.alias("name"), F.col("rung").cast("long").alias("rung"))
