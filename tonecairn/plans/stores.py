"""Queries over stores: a memo that runs fill, and renders that requests are cut from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..sources import memo
from ..sources.tables import read, work_dir
from .signals import VIEW as FRAMES
from .signals import frames

RATE = 10.0


def _features(df):
    """What is worth keeping of a text: its words and the key of its content."""
    return df.select(memo.KEY, F.size(L.tokens(F.col("text"))).alias("n_tokens"), L.content_key(F.col("text")).alias("content"))


def memo_runs(spark, sf_dir):
    """What four runs over one memo meet: labelled documents, all, all again, and all under another configuration."""
    kept = memo.Memo(spark, work_dir(spark, "memo"), "n_tokens int, content string")
    docs, code = read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), memo.code_digest(L)
    labelled = docs.join(read(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    met = [kept.through(rows, ["lang", "text"], _features, {"tokens": t}, code)[1] for rows, t in ((labelled, 1), (docs, 1), (docs, 1), (docs, 2))]
    return spark.createDataFrame([(k, m.hits, m.misses, m.made) for k, m in enumerate(met, 1)], "run int, hits long, misses long, made long")


def _store(spark, sf_dir):
    """The longest render of each key: signals of a user are renders, a tenth of a second a frame."""
    xs = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda t: t["x"])
    signals = frames(spark, sf_dir).groupBy("sample_id").agg(xs.alias("xs"))
    return memo.longest_entries(signals.select((F.col("sample_id") % 40).alias("key"), (F.size("xs") / RATE).alias("seconds"), "xs"))


def _requests(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("key"), ((F.col("o_orderkey") % 90) / RATE).alias("seconds"))


def served_renders(spark, sf_dir):
    """What each order gets of the longest render of its key, or why nothing."""
    found = memo.served(_requests(spark, sf_dir), _store(spark, sf_dir), RATE)
    total = F.round(F.aggregate("xs", F.lit(0.0), lambda t, x: t + x), 4)
    return found.select("o_orderkey", "key", "why", F.when(F.col("why").isNull(), F.size("xs")).alias("frames"), total.alias("total"))


def render_counters(spark, sf_dir):
    """Hits, misses by reason and frames, observed while the answers are written."""
    got = memo.serve_and_log(_requests(spark, sf_dir), _store(spark, sf_dir), RATE, work_dir(spark, "answers"), work_dir(spark, "log"))
    return spark.createDataFrame([(got["hits"], got["unknown"], got["too_short"], got["frames"])], "hits long, unknown long, too_short long, frames long")


_SERVED = FRAMES + """, s AS (SELECT sample_id, count(*) AS n, list(x ORDER BY i) AS xs FROM f GROUP BY 1),
    e AS (SELECT sample_id % 40 AS key, n, xs FROM s QUALIFY row_number() OVER (PARTITION BY sample_id % 40 ORDER BY n DESC, xs) = 1),
    r AS (SELECT o_orderkey, o_custkey % 50 AS key, o_orderkey % 90 AS want FROM orders),
    a AS (SELECT o_orderkey, r.key, want, xs, CASE WHEN n IS NULL THEN 'no entry' WHEN n < want THEN 'stored entry too short' END AS why FROM r LEFT JOIN e ON e.key = r.key)"""
SQL = {
    "memo_runs": """WITH d AS (SELECT doc_id, lang, text, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents),
        c AS (SELECT lang, text, count(*) AS n, count(*) FILTER (labelled) AS first FROM d GROUP BY 1, 2),
        t AS (SELECT sum(n) AS n, count(*) AS kinds, sum(first) AS first, count(*) FILTER (first > 0) AS first_kinds, sum(n) FILTER (first > 0) AS known FROM c)
        SELECT run, CAST(CASE run WHEN 1 THEN 0 WHEN 2 THEN known WHEN 3 THEN n ELSE 0 END AS BIGINT) AS hits,
               CAST(CASE run WHEN 1 THEN first WHEN 2 THEN n - known WHEN 3 THEN 0 ELSE n END AS BIGINT) AS misses,
               CAST(CASE run WHEN 1 THEN first_kinds WHEN 2 THEN kinds - first_kinds WHEN 3 THEN 0 ELSE kinds END AS BIGINT) AS made
        FROM t, (VALUES (1), (2), (3), (4)) r(run)""",
    "served_renders": _SERVED + " SELECT o_orderkey, key, why, CASE WHEN why IS NULL THEN want END AS frames, CASE WHEN why IS NULL THEN round(coalesce(list_sum(xs[: want]), 0.0), 4) END AS total FROM a",
    "render_counters": _SERVED
    + """ SELECT count(*) FILTER (why IS NULL) AS hits, count(*) FILTER (why = 'no entry') AS unknown, count(*) FILTER (why LIKE 'stored%') AS too_short,
        CAST(coalesce(sum(want) FILTER (why IS NULL), 0) AS BIGINT) AS frames FROM a""",
}
QUERIES = {k: f for k, f in list(globals().items()) if k in SQL}
