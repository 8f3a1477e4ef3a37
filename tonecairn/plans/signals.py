"""Signal queries: a user of ``events`` is a signal, its events in time order are the frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import signal as S
from ..operators import frames as O
from ..sources.tables import read

HOP = 4
# the same view in SQL; x is the left channel
VIEW = """WITH f AS (
    SELECT user_id AS sample_id, event_type AS set_id, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS r,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i
    FROM events)"""
HOPS = VIEW + f""", h AS (
    SELECT sample_id, i // {HOP} AS hop, sqrt(CAST(sum(CAST(x AS DECIMAL(12,2)) * CAST(x AS DECIMAL(12,2))) AS DOUBLE) / count(*)) AS rms,
           max(abs(x)) AS peak, count(*) AS frames
    FROM f GROUP BY 1, 2)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("sample_id"),
        F.col("event_type").alias("set_id"),
        (F.row_number().over(by) - 1).cast("long").alias("i"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("r"),
    )


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.hop_levels(frames(spark, sf_dir), HOP, True)


def r6(c) -> F.Column:
    return F.round(c, 6)


def set_gain(spark, sf_dir):
    peaks = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("set_id"), F.col("user_id").alias("sample_id")).agg(F.max(F.abs("value")).alias("peak"))
    top = F.max("peak").over(Window.partitionBy("set_id"))
    return peaks.withColumn("set_peak", top).select("set_id", "sample_id", "peak", "set_peak", r6(S.gain_to(F.col("set_peak"))).alias("gain"), r6(S.decibels(S.gain_to(F.col("set_peak")))).alias("gain_db"))


def sample_gain(spark, sf_dir):
    peaks = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sample_id")).agg(F.max(F.abs("value")).alias("peak"))
    return peaks.select("sample_id", "peak", r6(S.gain_to(F.col("peak"))).alias("gain"))


def side_level(spark, sf_dir):
    mid, side = (F.col("x") + F.col("r")) / 2, (F.col("x") - F.col("r")) / 2
    f = frames(spark, sf_dir).groupBy("sample_id").agg(F.sqrt(F.avg(mid * mid)).alias("mid"), F.sqrt(F.avg(side * side)).alias("side"))
    level = S.side_level(F.col("mid"), F.col("side"))
    return f.select("sample_id", r6(level).alias("side_db"), (level <= -60).alias("is_mono"))


def trim_bounds(spark, sf_dir):
    return O.trim_bounds(frames(spark, sf_dir), 4, -20.0)


def hop_rms_keep_tail(spark, sf_dir):
    return hops(spark, sf_dir).select("sample_id", "hop", r6("rms").alias("rms"), "peak")


def hop_rms_drop_tail(spark, sf_dir):
    return O.hop_levels(frames(spark, sf_dir), HOP, False).select("sample_id", "hop", r6("rms").alias("rms"), "peak")


def centred_rms(spark, sf_dir):
    return O.centred_rms(frames(spark, sf_dir), 8, HOP).select("sample_id", "hop", r6("rms").alias("rms"))


def sustain_bounds(spark, sf_dir):
    return O.sustain_bounds(hops(spark, sf_dir))


def longest_plateau(spark, sf_dir):
    h = hops(spark, sf_dir).withColumn("peak_rms", F.max("rms").over(Window.partitionBy("sample_id")))
    windows = O.sliding(h.withColumn("level", F.round("rms", 6)), "level", 3, "hop")
    return O.longest_run(windows, (F.round("mean", 4) > F.round(0.15 * F.col("peak_rms"), 4)) & (F.round("cv", 4) <= 0.25), "hop")


def pluck_flag(spark, sf_dir):
    """Whether the mean level of the four hops before note-off, at three quarters, is under a tenth of the peak."""
    f = frames(spark, sf_dir)
    n = f.groupBy("sample_id").agg((F.floor(F.count(F.lit(1)) * 3 / (4 * HOP))).cast("long").alias("off"))
    h = hops(spark, sf_dir).join(n, "sample_id")
    held = (F.col("hop") < F.col("off")) & (F.col("hop") >= F.col("off") - 4)
    return h.groupBy("sample_id").agg(F.max("rms").alias("top"), F.avg(F.when(held, F.col("rms"))).alias("held")).select(
        "sample_id", (F.round("held", 6) < F.round(0.10 * F.col("top"), 6)).alias("pluck")
    )


def probe_duration(spark, sf_dir):
    """Hold and tail of a probe render in units of hops, with the flags that lower its confidence."""
    w = Window.partitionBy("sample_id")
    h = hops(spark, sf_dir).withColumns({"top": F.max("peak").over(w), "hops": F.count(F.lit(1)).over(w)})
    hold = F.floor(F.col("hops") / 2)
    loud = F.col("rms") >= 0.5 * F.col("top")
    g = h.groupBy("sample_id").agg(
        F.max("hops").alias("hops"),
        F.coalesce(F.max(F.when(loud & (F.col("hop") < hold), F.col("hop"))), F.lit(-1)).alias("last_hold"),
        F.coalesce(F.max(F.when(loud & (F.col("hop") >= hold), F.col("hop"))), F.lit(-1)).alias("last_tail"),
        F.max((loud & (F.col("hop") >= F.floor(hold / 2)) & (F.col("hop") < hold)).cast("int")).alias("sustains"),
    )
    held = F.floor(F.col("hops") / 2)
    duration = F.when(F.col("sustains") == 1, held).when(F.col("last_hold") >= 0, F.least(F.col("last_hold") + 1, held)).otherwise(F.lit(1))
    tail = F.when(F.col("last_tail") >= 0, F.least(F.col("last_tail") - held + 1, F.lit(8))).otherwise(F.lit(0))
    flags = (F.col("sustains") == 0).cast("int") + (tail >= 8).cast("int")
    return g.select(
        "sample_id", duration.cast("long").alias("duration"), tail.cast("long").alias("tail"), (F.col("sustains") == 1).alias("sustains"),
        F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), flags + 1).alias("confidence"),
    )


def peak_movement(spark, sf_dir):
    """Spread of the peaks of 12 equal chunks against the largest; the remainder is ignored."""
    f = O.with_length(frames(spark, sf_dir)).withColumn("step", F.floor(F.col("n") / 12)).where("step > 0 and i < 12 * step")
    chunks = f.groupBy("sample_id", F.floor(F.col("i") / F.col("step")).alias("chunk")).agg(F.max(F.abs("x")).alias("peak"))
    return chunks.groupBy("sample_id").agg(r6(F.try_divide(F.max("peak") - F.min("peak"), F.max("peak"))).alias("movement"))


def local_maxima_top(spark, sf_dir):
    return O.top_one(O.local_maxima(frames(spark, sf_dir), "x", "i"), F.desc("x"), "i").select("sample_id", "i", "x")


def zero_cross_nearest(spark, sf_dir):
    """The upward crossing of the signal's middle value that is nearest to the signal's middle frame."""
    w = Window.partitionBy("sample_id")
    f = frames(spark, sf_dir).withColumns({"mid": F.avg(F.col("x").cast("decimal(12,2)")).over(w).cast("double"), "n": F.count(F.lit(1)).over(w)})
    f = f.withColumn("before", F.lag("x").over(O.in_order())).where("before < mid and x >= mid")
    return O.top_one(f, F.abs(F.col("i") - F.floor(F.col("n") / 2)), "i").select("sample_id", "i", "x")


def steadiest_window(spark, sf_dir):
    """Of windows of 4 hops the one with most level for its movement."""
    h = hops(spark, sf_dir).withColumn("flux", F.abs(F.col("rms") - F.lag("rms").over(Window.partitionBy("sample_id").orderBy("hop"))))
    h = h.withColumn("flux", F.coalesce("flux", F.lit(0.0)))
    ahead = Window.partitionBy("sample_id").orderBy("hop").rowsBetween(0, 3)
    w = Window.partitionBy("sample_id")
    s = h.withColumns({"loud": F.avg("rms").over(ahead), "moves": F.avg("flux").over(ahead), "k": F.count(F.lit(1)).over(ahead), "top": F.max("rms").over(w)}).where("k = 4")
    score = F.round(F.try_divide(F.col("loud"), F.col("top")) / (0.05 + F.col("moves")), 6)
    return O.top_one(s.withColumn("score", score), F.desc("score"), "hop").select("sample_id", "hop", "score")


def release_time(spark, sf_dir):
    """Blocks after note-off (half way) until the level is under a half of that just before it."""
    h = hops(spark, sf_dir).withColumn("off", F.floor(F.count(F.lit(1)).over(Window.partitionBy("sample_id")) / 2))
    h = h.withColumn("ref", F.max(F.when(F.col("hop") == F.col("off") - 1, F.col("rms"))).over(Window.partitionBy("sample_id")))
    below = (F.col("hop") >= F.col("off")) & (F.col("rms") < 0.5 * F.col("ref"))
    return h.groupBy("sample_id").agg(F.min(F.when(below, F.col("hop") - F.col("off"))).cast("long").alias("release_hops"))


def autocorr_lag(spark, sf_dir):
    return O.lag_products(frames(spark, sf_dir), 6).select("sample_id", "lag", "product", "pairs")


def seam_score(spark, sf_dir):
    """Mismatch of 8 frames before two seam positions, level drift and steps of value and slope at the seam."""
    f = O.with_length(frames(spark, sf_dir)).where("n >= 40")
    start, end = F.floor(F.col("n") / 4), F.floor(3 * F.col("n") / 4)
    a = f.select("sample_id", "n", "i", "x", start.alias("start"), end.alias("end"))
    by = O.in_order()
    a = a.withColumn("slope", F.col("x") - F.lag("x").over(by))
    grab = lambda what, at: F.max(F.when(F.col("i") == F.col(at), F.col(what)))
    near = lambda at: (F.col("i") >= F.col(at) - 8) & (F.col("i") < F.col(at))
    pick = lambda at: F.transform(F.array_sort(F.collect_list(F.when(near(at), F.struct("i", "x")))), lambda t: t["x"])
    g = a.groupBy("sample_id").agg(pick("start").alias("u"), pick("end").alias("v"), grab("x", "start").alias("x0"), grab("x", "end").alias("x1"), grab("slope", "start").alias("s0"), grab("slope", "end").alias("s1"))
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda t, x: t + x * x)
    diff = F.zip_with("u", "v", lambda p, q: p - q)
    mean = (square("u") + square("v")) / 2
    peak_u, peak_v = F.array_max(F.transform("u", F.abs)), F.array_max(F.transform("v", F.abs))
    return g.select(
        "sample_id",
        r6(F.sqrt(F.try_divide(square(diff), mean))).alias("seam"),
        r6(F.try_divide(F.abs(peak_u - peak_v), F.greatest(peak_u, peak_v))).alias("drift"),
        r6(F.abs(F.col("x1") - F.col("x0"))).alias("step"),
        r6(F.abs(F.col("s1") - F.col("s0"))).alias("slope_step"),
        (F.signum("s0") == F.signum("s1")).alias("same_direction"),
    )


def _candidates(f: DataFrame) -> DataFrame:
    """Loop candidates of three generators in order: tempo multiples, quarters, halves."""
    n = f.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    tempo = n.select("sample_id", "n", F.lit(0).alias("source"), F.explode(F.array(*(F.lit(k) for k in (8, 16, 24)))).alias("length")).select("sample_id", "source", F.lit(8).cast("long").alias("start"), (F.lit(8) + F.col("length")).cast("long").alias("end"))
    quarter = n.select("sample_id", F.lit(1).alias("source"), F.lit(8).cast("long").alias("start"), (F.lit(8) + F.floor(F.col("n") / 4)).cast("long").alias("end"))
    half = n.select("sample_id", F.lit(2).alias("source"), F.floor(F.col("n") / 4).cast("long").alias("start"), (F.floor(F.col("n") / 4) + 16).cast("long").alias("end"))
    return tempo.unionByName(quarter).unionByName(half)


def candidate_union_dedupe(spark, sf_dir):
    """Of candidates with the same bounds the one of the first generator."""
    by = Window.partitionBy("sample_id", "start", "end").orderBy("source")
    return _candidates(frames(spark, sf_dir)).withColumn("k", F.row_number().over(by)).where("k = 1").select("sample_id", "start", "end", "source")


def gate_unless_empty(spark, sf_dir):
    """Three gates in turn, none of which may empty a signal's candidates; then the five longest."""
    c = candidate_union_dedupe(spark, sf_dir).withColumn("length", F.col("end") - F.col("start"))
    c = O.keep_unless_empty(c, F.col("length") >= 16)
    c = O.keep_unless_empty(c, F.col("start") > 8)
    c = O.keep_unless_empty(c, F.col("source") < 2)
    by = Window.partitionBy("sample_id").orderBy(F.desc("length"), F.desc("start"), F.desc("end"))
    return c.withColumn("rank", F.row_number().over(by).cast("long")).where("rank <= 5").select("sample_id", "rank", "start", "end")


def crossfade_length(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("hz", S.midi_to_hz(F.col("user_id") % 128))
    rough = F.col("value") / 1000.0
    ms = S.crossfade_ms(rough, rough / 2, F.col("hz"))
    return e.select("event_id", r6("hz").alias("hz"), r6(ms).alias("crossfade_ms"), r6(S.fold_cents(F.col("value") * 10)).alias("cents"), r6(S.hz_to_midi(F.col("hz") * 1.5)).alias("fifth"))


def cut_and_tile(spark, sf_dir):
    """The signal cut at its loop's end, and the loop repeated up to 64 frames."""
    g = frames(spark, sf_dir).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda t: t["x"]).alias("xs"))
    g = g.withColumns({"n": F.size("xs"), "start": F.floor(F.size("xs") / 4).cast("int")}).withColumn("end", (F.col("start") + F.floor(F.col("n") / 2)).cast("int"))
    g = g.withColumn("cut", F.slice("xs", F.lit(1), F.col("end")))
    at = lambda k: F.when(k < F.col("end"), k).otherwise(F.col("start") + F.pmod(k - F.col("start"), F.col("end") - F.col("start")))
    tiled = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.element_at("cut", (at(k) + 1).cast("int")))
    return g.select("sample_id", F.posexplode(tiled).alias("i", "x")).select("sample_id", F.col("i").cast("long").alias("i"), "x")


def bake_crossfade(spark, sf_dir):
    """Blend what precedes the loop's start into its tail over 8 frames, linearly."""
    f = O.with_length(frames(spark, sf_dir)).where("n >= 40")
    start, end, fade = F.floor(F.col("n") / 4), F.floor(3 * F.col("n") / 4), 8
    f = f.withColumns({"start": start, "end": end})
    other = f.select("sample_id", (F.col("i") - F.col("start") + F.col("end")).alias("i"), F.col("x").alias("y")).where(F.col("i") < F.col("end"))
    j = f.join(other, ["sample_id", "i"], "left")
    share = (F.col("i") - (F.col("end") - fade) + 1) / (fade + 1.0)
    inside = (F.col("i") >= F.col("end") - fade) & (F.col("i") < F.col("end"))
    return j.select("sample_id", "i", r6(F.when(inside, F.col("x") * (1 - share) + F.col("y") * share).otherwise(F.col("x"))).alias("x"))


def mixdown(spark, sf_dir):
    """The signals of a set laid over each other at evenly spaced offsets, four frames from one to the next."""
    f = frames(spark, sf_dir)
    # a signal's place is the number of signals in stretches of ids before its own and its rank in that: no task has all signals of a set
    s = f.select("set_id", "sample_id").distinct().withColumn("stretch", F.floor(F.col("sample_id") / 1024))
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("set_id", "stretch").orderBy("sample_id")) - 1)
    before = Window.partitionBy("set_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    start = s.groupBy("set_id", "stretch").agg(F.count(F.lit(1)).alias("n")).select("set_id", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    k = s.join(start, ["set_id", "stretch"]).select("set_id", "sample_id", (F.col("start") + F.col("rank")).alias("k"))
    laid = f.join(k, ["set_id", "sample_id"]).withColumn("place", F.col("i") + 4 * F.col("k"))
    return laid.groupBy("set_id", F.col("place").cast("long").alias("place")).agg(F.sum(F.col("x").cast("decimal(18,2)")).cast("double").alias("x"))


def mode_vote(spark, sf_dir):
    """Most frequent event type of a user, ties to the first met; and whether it has at least 30 percent."""
    f = frames(spark, sf_dir)
    c = f.groupBy("sample_id", "set_id").agg(F.count(F.lit(1)).alias("votes"), F.min("i").alias("first"))
    c = c.withColumn("total", F.sum("votes").over(Window.partitionBy("sample_id")))
    return O.top_one(c, F.desc("votes"), "first").select("sample_id", F.col("set_id").alias("verdict"), "votes", (F.col("votes") * 100 >= F.col("total") * 30).alias("rhythm"))


_BEATS = ((1, 4), (1, 3), (1, 2), (2, 3), (1, 1), (3, 2), (2, 1), (3, 1), (4, 1))


def bpm_snap(spark, sf_dir):
    """The beat subdivision nearest to a period, if within 12 percent."""
    beat = 60.0 / 120.0
    options = F.array(*(F.struct(F.round(F.abs(F.col("seconds") / (beat * a / b) - 1), 9).alias("off"), F.lit(k).alias("k"), F.lit(beat * a / b).alias("to")) for k, (a, b) in enumerate(_BEATS)))
    e = read(spark, sf_dir, "events").select("event_id", (F.col("value") / 100.0).alias("seconds")).withColumn("best", F.array_min(options))
    return e.select("event_id", F.when(F.col("best.off") <= 0.12, F.round("best.to", 6)).alias("snapped"))


_CURVE = [(0.01, 0.0), (1.0, 40.0), (5.0, 80.0), (20.0, 100.0)]


def release_curve(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    knob = S.piecewise_log(F.abs("value") / 10.0 + 0.001, _CURVE)
    return e.select("event_id", r6(knob).alias("knob"), S.thousandths(knob / 100.0).alias("coded"))


def q31(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    share = o["o_totalprice"] / 600000.0 * 2 - 1
    return o.select("o_orderkey", S.signed_q31(share).alias("coded"), S.signed_q31(share, 2**30).alias("cable"))


def fft_features(spark, sf_dir):
    """Pitch lag by padded FFT autocorrelation and band energies, an Arrow kernel per signal."""
    from ..operators.spectra import spectral_features

    g = frames(spark, sf_dir).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda t: t["x"]).alias("xs"))
    return spectral_features(g)


_G = "sqrt(CAST(sum(CAST(x AS DECIMAL(12,2)) * CAST(x AS DECIMAL(12,2)))"
_CANDIDATES = VIEW + """, n AS (SELECT sample_id, count(*) AS n FROM f GROUP BY 1), c AS (
    SELECT sample_id, 0 AS source, 8 AS "start", 8 + len AS "end" FROM n, (VALUES (8), (16), (24)) t(len)
    UNION ALL SELECT sample_id, 1, 8, 8 + n // 4 FROM n
    UNION ALL SELECT sample_id, 2, n // 4, n // 4 + 16 FROM n
), d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY sample_id, "start", "end" ORDER BY source) = 1)"""

SQL = {
    "fft_features": VIEW + """, n AS (SELECT sample_id, i, x, count(*) OVER w AS n, avg(x) OVER w AS mean FROM f WINDOW w AS (PARTITION BY sample_id)),
        y AS (SELECT sample_id, i, n, (x - mean) * (CASE WHEN n > 1 THEN 0.5 - 0.5 * cos(2 * pi() * i / (n - 1)) ELSE 1 END) AS y FROM n),
        r AS (SELECT a.sample_id, b.i - a.i AS lag, a.n, sum(a.y * b.y) AS r FROM y a JOIN y b ON a.sample_id = b.sample_id AND b.i >= a.i AND 2 * (b.i - a.i) <= a.n GROUP BY 1, 2, 3),
        z AS (SELECT sample_id, r AS zero FROM r WHERE lag = 0),
        l AS (SELECT sample_id, lag, r FROM r WHERE lag >= 2 AND lag < n // 2 QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY r DESC, lag) = 1),
        d AS (SELECT sample_id, k, n // 2 + 1 AS m, CASE WHEN k = 0 THEN 0 ELSE pow(sum(x * cos(2 * pi() * k * i / n)), 2) + pow(sum(x * sin(2 * pi() * k * i / n)), 2) END AS p
              FROM n, range(0, 200) t(k) WHERE k <= n // 2 GROUP BY sample_id, k, n),
        b AS (SELECT *, CASE WHEN k < m % 3 * (m // 3 + 1) THEN k // (m // 3 + 1) ELSE m % 3 + (k - m % 3 * (m // 3 + 1)) // greatest(m // 3, 1) END AS band FROM d),
        g AS (SELECT sample_id, sum(p) AS total, sum(p) FILTER (band = 0) AS b0, sum(p) FILTER (band = 1) AS b1, sum(p) FILTER (band = 2) AS b2, sum(sqrt(p) * k) / nullif(sum(sqrt(p)), 0) AS c FROM b GROUP BY 1)
        SELECT sample_id, CASE WHEN zero > 0 AND r / zero >= 0.3 THEN lag END AS lag,
               list_transform([b0, b1, b2], lambda v: CASE WHEN total > 0 THEN round(coalesce(v, 0) / total, 6) ELSE 0.0 END) AS bands, round(c, 6) AS centroid
        FROM g JOIN z USING (sample_id) LEFT JOIN l USING (sample_id)""",
    "set_gain": """WITH p AS (SELECT event_type AS set_id, user_id AS sample_id, max(abs(value)) AS peak FROM events GROUP BY 1, 2),
        q AS (SELECT *, max(peak) OVER (PARTITION BY set_id) AS set_peak FROM p),
        g AS (SELECT *, CASE WHEN set_peak > 0 THEN pow(10.0, -0.05) / set_peak ELSE 1 END AS g FROM q)
        SELECT set_id, sample_id, peak, set_peak, round(g, 6) AS gain, round(20 * log10(g), 6) AS gain_db FROM g""",
    "sample_gain": """SELECT user_id AS sample_id, max(abs(value)) AS peak,
        round(CASE WHEN max(abs(value)) > 0 THEN pow(10.0, -0.05) / max(abs(value)) ELSE 1 END, 6) AS gain FROM events GROUP BY 1""",
    "side_level": VIEW + """, g AS (SELECT sample_id, sqrt(avg(((x + r) / 2) * ((x + r) / 2))) AS m, sqrt(avg(((x - r) / 2) * ((x - r) / 2))) AS s FROM f GROUP BY 1),
        l AS (SELECT sample_id, CASE WHEN s <= 0 THEN '-inf'::DOUBLE WHEN m <= 0 THEN 'inf'::DOUBLE ELSE 20 * log10(s / m) END AS d FROM g)
        SELECT sample_id, round(d, 6) AS side_db, d <= -60 AS is_mono FROM l""",
    "trim_bounds": VIEW + """, m AS (SELECT *, count(*) OVER w AS n, max(abs(x)) OVER w * pow(10.0, -1.0) AS lim FROM f WINDOW w AS (PARTITION BY sample_id))
        SELECT sample_id, coalesce(min(CASE WHEN abs(x) >= lim AND lim > 0 THEN i // 4 * 4 END), 0) AS lead,
               coalesce(max(CASE WHEN abs(x) >= lim AND lim > 0 THEN n - (n - 1 - i) // 4 * 4 END), max(n)) AS trail FROM m GROUP BY 1""",
    "hop_rms_keep_tail": HOPS + " SELECT sample_id, hop, round(rms, 6) AS rms, peak FROM h",
    "hop_rms_drop_tail": HOPS + f" SELECT sample_id, hop, round(rms, 6) AS rms, peak FROM h WHERE frames = {HOP}",
    "centred_rms": VIEW + """, c AS (SELECT sample_id, i, sqrt(CAST(sum(CAST(x AS DECIMAL(12,2)) * CAST(x AS DECIMAL(12,2)))
            OVER (PARTITION BY sample_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) AS DOUBLE) / 8) AS rms FROM f)
        SELECT sample_id, i // 4 AS hop, round(rms, 6) AS rms FROM c WHERE i % 4 = 0""",
    "sustain_bounds": HOPS + """, m AS (SELECT *, max(rms) OVER w AS top, count(*) OVER w AS hops FROM h WINDOW w AS (PARTITION BY sample_id)),
        p AS (SELECT *, min(CASE WHEN rms = top THEN hop END) OVER (PARTITION BY sample_id) AS peak_hop FROM m)
        SELECT sample_id, min(peak_hop) AS peak_hop, coalesce(max(CASE WHEN hop <= peak_hop AND rms < 0.9 * top THEN hop END), -1) + 1 AS start_hop,
               coalesce(min(CASE WHEN hop > peak_hop AND rms < 0.4 * top THEN hop END), max(hops)) AS end_hop FROM p GROUP BY 1""",
    "longest_plateau": HOPS + """, m AS (SELECT sample_id, hop, round(rms, 6) AS level, max(rms) OVER (PARTITION BY sample_id) AS top FROM h),
        s AS (SELECT sample_id, hop, top, avg(level) OVER w AS mean, stddev_pop(level) OVER w AS sd, count(*) OVER w AS k FROM m
              WINDOW w AS (PARTITION BY sample_id ORDER BY hop ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
        g AS (SELECT *, round(mean, 4) > round(0.15 * top, 4) AND round(sd / nullif(mean, 0), 4) <= 0.25 AS ok FROM s WHERE k = 3),
        n AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY sample_id ORDER BY hop ROWS UNBOUNDED PRECEDING) AS island FROM g),
        r AS (SELECT sample_id, island, min(hop) AS "start", count(*) AS length FROM n WHERE ok GROUP BY 1, 2)
        SELECT sample_id, "start", length FROM r QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY length DESC, "start") = 1""",
    "pluck_flag": HOPS + """, n AS (SELECT sample_id, count(*) * 3 // 16 AS off FROM f GROUP BY 1)
        SELECT sample_id, round(avg(CASE WHEN hop < off AND hop >= off - 4 THEN rms END), 6) < round(0.10 * max(rms), 6) AS pluck
        FROM h JOIN n USING (sample_id) GROUP BY 1""",
    "probe_duration": HOPS + """, m AS (SELECT *, max(peak) OVER w AS top, count(*) OVER w AS hops, count(*) OVER w // 2 AS hold FROM h WINDOW w AS (PARTITION BY sample_id)),
        g AS (SELECT sample_id, max(hold) AS hold, coalesce(max(CASE WHEN rms >= 0.5 * top AND hop < hold THEN hop END), -1) AS lh,
              coalesce(max(CASE WHEN rms >= 0.5 * top AND hop >= hold THEN hop END), -1) AS lt,
              bool_or(rms >= 0.5 * top AND hop >= hold // 2 AND hop < hold) AS sustains FROM m GROUP BY 1),
        t AS (SELECT *, CASE WHEN lt >= 0 THEN least(lt - hold + 1, 8) ELSE 0 END AS tail FROM g)
        SELECT sample_id, CASE WHEN sustains THEN hold WHEN lh >= 0 THEN least(lh + 1, hold) ELSE 1 END AS duration, tail, sustains,
               CASE (NOT sustains)::INT + (tail >= 8)::INT WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM t""",
    "peak_movement": VIEW + """, n AS (SELECT *, count(*) OVER (PARTITION BY sample_id) // 12 AS step FROM f),
        c AS (SELECT sample_id, i // step AS chunk, max(abs(x)) AS peak FROM n WHERE step > 0 AND i < 12 * step GROUP BY 1, 2)
        SELECT sample_id, round((max(peak) - min(peak)) / nullif(max(peak), 0), 6) AS movement FROM c GROUP BY 1""",
    "local_maxima_top": VIEW + """, m AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM f WINDOW w AS (PARTITION BY sample_id ORDER BY i))
        SELECT sample_id, i, x FROM m WHERE x > a AND x > b QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY x DESC, i) = 1""",
    "zero_cross_nearest": VIEW + """, m AS (SELECT *, round(CAST(sum(CAST(x AS DECIMAL(12,2))) OVER v AS DOUBLE) / count(*) OVER v, 6) AS mid, count(*) OVER v AS n,
            lag(x) OVER (PARTITION BY sample_id ORDER BY i) AS a FROM f WINDOW v AS (PARTITION BY sample_id))
        SELECT sample_id, i, x FROM m WHERE a < mid AND x >= mid QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY abs(i - n // 2), i) = 1""",
    "steadiest_window": HOPS + """, u AS (SELECT *, coalesce(abs(rms - lag(rms) OVER (PARTITION BY sample_id ORDER BY hop)), 0) AS flux, max(rms) OVER (PARTITION BY sample_id) AS top FROM h),
        s AS (SELECT sample_id, hop, top, avg(rms) OVER w AS loud, avg(flux) OVER w AS moves, count(*) OVER w AS k FROM u
              WINDOW w AS (PARTITION BY sample_id ORDER BY hop ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
        t AS (SELECT sample_id, hop, round(loud / nullif(top, 0) / (0.05 + moves), 6) AS score FROM s WHERE k = 4)
        SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, hop) = 1""",
    "release_time": HOPS + """, m AS (SELECT *, count(*) OVER (PARTITION BY sample_id) // 2 AS off FROM h),
        q AS (SELECT *, max(CASE WHEN hop = off - 1 THEN rms END) OVER (PARTITION BY sample_id) AS ref FROM m)
        SELECT sample_id, min(CASE WHEN hop >= off AND rms < 0.5 * ref THEN hop - off END) AS release_hops FROM q GROUP BY 1""",
    "autocorr_lag": VIEW + """ SELECT a.sample_id, a.i - b.i AS lag, CAST(sum(CAST(a.x AS DECIMAL(12,2)) * CAST(b.x AS DECIMAL(12,2))) AS DOUBLE) AS product, count(*) AS pairs
        FROM f a JOIN f b ON a.sample_id = b.sample_id AND a.i - b.i BETWEEN 1 AND 6 GROUP BY 1, 2""",
    "seam_score": VIEW + """, m AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n, x - lag(x) OVER (PARTITION BY sample_id ORDER BY i) AS slope FROM f),
        k AS (SELECT *, n // 4 AS s, 3 * n // 4 AS e FROM m WHERE n >= 40),
        p AS (SELECT a.sample_id, sqrt(sum((a.x - b.x) * (a.x - b.x)) / nullif((sum(a.x * a.x) + sum(b.x * b.x)) / 2, 0)) AS seam,
                     max(abs(a.x)) AS pu, max(abs(b.x)) AS pv
              FROM k a JOIN k b ON a.sample_id = b.sample_id AND b.i - b.e = a.i - a.s WHERE a.i >= a.s - 8 AND a.i < a.s GROUP BY 1),
        q AS (SELECT sample_id, max(CASE WHEN i = s THEN x END) AS x0, max(CASE WHEN i = e THEN x END) AS x1,
                     max(CASE WHEN i = s THEN slope END) AS s0, max(CASE WHEN i = e THEN slope END) AS s1 FROM k GROUP BY 1)
        SELECT sample_id, round(seam, 6) AS seam, round(abs(pu - pv) / nullif(greatest(pu, pv), 0), 6) AS drift, round(abs(x1 - x0), 6) AS step,
               round(abs(s1 - s0), 6) AS slope_step, sign(s0) = sign(s1) AS same_direction FROM p JOIN q USING (sample_id)""",
    "candidate_union_dedupe": _CANDIDATES + ' SELECT sample_id, "start", "end", source FROM d',
    "gate_unless_empty": _CANDIDATES + """, a AS (SELECT *, "end" - "start" AS len FROM d),
        g1 AS (SELECT * FROM a QUALIFY len >= 16 OR NOT bool_or(len >= 16) OVER (PARTITION BY sample_id)),
        g2 AS (SELECT * FROM g1 QUALIFY "start" > 8 OR NOT bool_or("start" > 8) OVER (PARTITION BY sample_id)),
        g3 AS (SELECT * FROM g2 QUALIFY source < 2 OR NOT bool_or(source < 2) OVER (PARTITION BY sample_id)),
        k AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY len DESC, "start" DESC, "end" DESC) AS rank, "start", "end" FROM g3)
        SELECT * FROM k WHERE rank <= 5""",
    "crossfade_length": """WITH e AS (SELECT event_id, value, 440.0 * pow(2.0, (user_id % 128 - 69) / 12.0) AS hz, value / 1000.0 AS rough FROM events)
        SELECT event_id, round(hz, 6) AS hz, round(least(greatest((1.5 + 2.5 * least(greatest(0.0, rough / 0.25, rough / 2 / 0.5), 1.0)) * 1000.0 / hz, 3.0), 60.0), 6) AS crossfade_ms,
               round(value * 10 + 600 - 1200 * floor((value * 10 + 600) / 1200) - 600, 6) AS cents, round(69 + 12 * log2(hz * 1.5 / 440.0), 6) AS fifth FROM e""",
    "cut_and_tile": VIEW + """, n AS (SELECT sample_id, count(*) // 4 AS s, count(*) // 4 + count(*) // 2 AS e FROM f GROUP BY 1),
        t AS (SELECT sample_id, k AS i, CASE WHEN k < e THEN k ELSE s + (k - s) % (e - s) END AS at FROM n, range(0, 64) r(k))
        SELECT t.sample_id, t.i, f.x FROM t JOIN f ON f.sample_id = t.sample_id AND f.i = t.at""",
    "bake_crossfade": VIEW + """, m AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n FROM f), k AS (SELECT *, n // 4 AS s, 3 * n // 4 AS e FROM m WHERE n >= 40)
        SELECT a.sample_id, a.i, round(CASE WHEN a.i >= a.e - 8 AND a.i < a.e THEN a.x * (1 - (a.i - (a.e - 8) + 1) / 9.0) + b.x * ((a.i - (a.e - 8) + 1) / 9.0) ELSE a.x END, 6) AS x
        FROM k a LEFT JOIN k b ON a.sample_id = b.sample_id AND b.i = a.i - a.e + a.s AND a.i < a.e""",
    "mixdown": VIEW + """, k AS (SELECT set_id, x, i + 4 * (dense_rank() OVER (PARTITION BY set_id ORDER BY sample_id) - 1) AS place FROM f)
        SELECT set_id, place, CAST(sum(CAST(x AS DECIMAL(18,2))) AS DOUBLE) AS x FROM k GROUP BY 1, 2""",
    "mode_vote": VIEW + """, c AS (SELECT sample_id, set_id AS verdict, count(*) AS votes, min(i) AS first FROM f GROUP BY 1, 2),
        t AS (SELECT *, sum(votes) OVER (PARTITION BY sample_id) AS total FROM c)
        SELECT sample_id, verdict, votes, votes * 100 >= total * 30 AS rhythm FROM t QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY votes DESC, first) = 1""",
    "bpm_snap": "WITH b AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {0.5 * a / b!r}::DOUBLE)" for k, (a, b) in enumerate(_BEATS)) + """) t(k, beat)),
        o AS (SELECT event_id, k, beat, round(abs(value / 100.0 / beat - 1), 9) AS off FROM events, b),
        w AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY off, k) = 1)
        SELECT event_id, CASE WHEN off <= 0.12 THEN round(beat, 6) END AS snapped FROM w""",
    "release_curve": """WITH e AS (SELECT event_id, abs(value) / 10.0 + 0.001 AS t FROM events),
        k AS (SELECT event_id, CASE WHEN t <= 0.01 THEN 0.0 WHEN t <= 1 THEN 40 * (ln(t) - ln(0.01)) / (ln(1.0) - ln(0.01)) WHEN t <= 5 THEN 40 + (t - 1) / 4.0 * 40
                     WHEN t <= 20 THEN 80 + (t - 5) / 15.0 * 20 ELSE 100.0 END AS knob FROM e)
        SELECT event_id, round(knob, 6) AS knob, CAST(least(greatest(round_even(knob / 100.0 * 1000, 0), 0), 1000) AS INT) AS coded FROM k""",
    "q31": """WITH o AS (SELECT o_orderkey, o_totalprice / 600000.0 * 2 - 1 AS s FROM orders),
        v AS (SELECT o_orderkey, CAST(least(greatest(round_even(s * 2147483648, 0), -2147483648), 2147483647) AS BIGINT) AS a,
                     CAST(least(greatest(round_even(s * 1073741824, 0), -1073741824), 1073741823) AS BIGINT) AS b FROM o)
        SELECT o_orderkey, lpad(to_hex(a & 4294967295), 8, '0') AS coded, lpad(to_hex(b & 4294967295), 8, '0') AS cable FROM v""",
}

QUERIES = {k: f for k, f in list(globals().items()) if k in SQL}
