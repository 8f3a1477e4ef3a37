"""Queries over orders, customers and nations as plans, overrides and profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import tables as T
from ..sources.tables import read


def capture_grid(spark, sf_dir):
    """Note by velocity by take of every order: three exploded sequences, no join."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan"), (F.col("o_orderkey") % 5 + 2).cast("int").alias("step"))
    o = o.select("plan", F.explode(F.sequence(F.lit(36), F.lit(60), F.col("step"))).alias("note"))
    o = o.select("plan", "note", F.explode(F.array(F.lit(42), F.lit(97), F.lit(118))).alias("velocity"))
    return o.select("plan", "note", "velocity", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("take"))


def expected_count(spark, sf_dir):
    """Rows that a plan's grid will have, without making it."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan"), (F.col("o_orderkey") % 5 + 2).alias("step"))
    return o.select("plan", ((F.floor(F.lit(24) / F.col("step")) + 1) * 6).cast("long").alias("rows"))


def profile_merge(spark, sf_dir):
    """A customer's settings over those of its nation's profile; given fields win."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("profile"), F.concat(F.lit("p"), F.col("n_regionkey").cast("string")).alias("mode"), (F.col("n_nationkey") * 10.0).alias("hold"))
    c = read(spark, sf_dir, "customer")
    rows = c.select("c_custkey", F.col("c_nationkey").alias("profile"), F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("own_mode"), F.when(F.col("c_acctbal") < 0, F.lit(1.0)).alias("own_hold"))
    j = rows.join(F.broadcast(nation), "profile", "left")  # nations: 25 rows by definition
    return j.select("c_custkey", F.coalesce("own_mode", "mode").alias("mode"), F.coalesce("own_hold", "hold").alias("hold"))


def layered_fields(spark, sf_dir):
    """Suppliers with the fields that every third of them overrides."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    over = s.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit(None).cast("string").alias("s_name"), (-F.col("s_acctbal")).alias("s_acctbal"))
    return T.layered(s, over, "s_suppkey", ["s_name", "s_acctbal"]).select("s_suppkey", "s_name", "s_acctbal")


def batch_status(spark, sf_dir):
    """Every plan with its fate in a batch: refused, already there, in collision, or run."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan"), F.concat_ws("/", "o_orderpriority", F.col("o_custkey").cast("string")).alias("path"), "o_orderstatus", "o_totalprice")
    n = F.count(F.lit(1)).over(Window.partitionBy("path"))
    status = F.when(F.col("o_totalprice") < 2000, "refused").when(F.col("o_orderstatus") == "F", "exists").when(n > 1, "collision").otherwise("run")
    return o.select("plan", "path", status.alias("status"))


def resume_pending(spark, sf_dir):
    """Customers without a large order: what a resumed scan has left to do."""
    done = read(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").join(done, "c_custkey", "left_anti").select("c_custkey", "c_name")


SQL = {
    "capture_grid": """SELECT o_orderkey AS plan, n AS note, v AS velocity, t AS take FROM orders, range(36, 61) a(n), (VALUES (42), (97), (118)) b(v), range(1, 3) c(t)
        WHERE (n - 36) % (o_orderkey % 5 + 2) = 0""",
    "expected_count": "SELECT o_orderkey AS plan, (24 // (o_orderkey % 5 + 2) + 1) * 6 AS rows FROM orders",
    "profile_merge": """SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, 'p' || n_regionkey) AS mode,
        coalesce(CASE WHEN c_acctbal < 0 THEN 1.0 END, n_nationkey * 10.0)::DOUBLE AS hold FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "layered_fields": "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN -s_acctbal ELSE s_acctbal END AS s_acctbal FROM supplier",
    "batch_status": """WITH p AS (SELECT o_orderkey AS plan, o_orderpriority || '/' || o_custkey AS path, o_orderstatus, o_totalprice FROM orders), n AS (SELECT *, count(*) OVER (PARTITION BY path) AS n FROM p)
        SELECT plan, path, CASE WHEN o_totalprice < 2000 THEN 'refused' WHEN o_orderstatus = 'F' THEN 'exists' WHEN n > 1 THEN 'collision' ELSE 'run' END AS status FROM n""",
    "resume_pending": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)",
}
QUERIES = {k: f for k, f in list(globals().items()) if k in SQL}
