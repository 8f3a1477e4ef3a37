"""Queries over ``part`` as patches in folders: what a flat browser calls them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import titles as T
from ..functions import vocabulary as V
from ..operators.naming import climb
from ..sources.tables import read


def patches(spark, sf_dir):
    """Each part as a patch: the folders it lies in, the outermost first, and its name, which may repeat them."""
    p = read(spark, sf_dir, "part")
    tagged = F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("1 BASS"))).when(F.col("p_partkey") % 4 == 1, F.array(F.lit("02 - Keys & Pads"))).otherwise(F.array().cast("array<string>"))
    numbered = F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(". "), F.col("p_type"))
    folders = F.concat(F.array(F.concat("p_brand", F.lit(" parts collection")), numbered), tagged, F.array(F.split("p_name", " ")[1]))
    echo = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit(" "), F.upper("p_brand"), F.lit(" Parts take "), (F.col("p_partkey") % 3).cast("string"))).otherwise("")
    return p.select(F.col("p_partkey").alias("id"), folders.alias("folders"), F.concat("p_type", F.lit(" "), "p_name", echo).alias("name"), F.lit("card").alias("card"))


def patch_titles(spark, sf_dir):
    """The title that each patch ends with once no two of a card clash, or nothing longer is left, and how far it had to climb."""
    p = patches(spark, sf_dir)
    # patches that say the same have the same titles, which are made once
    titled = T.with_titles(p.select("folders", "name").distinct(), F.col("folders"), F.col("name"), "rungs").select(F.col("folders").alias("_f"), F.col("name").alias("_n"), "rungs")
    named = p.join(titled, F.col("folders").eqNullSafe(F.col("_f")) & F.col("name").eqNullSafe(F.col("_n")))
    return climb(named.select("id", "card", "rungs"), "card").select("id", F.col("name").alias("title"), "rung")


def patch_labels(spark, sf_dir):
    """Labels of a patch's folders, spelled out and abbreviated."""
    labels = T.fresh_labels(F.col("folders"))
    p = patches(spark, sf_dir).withColumn("labels", labels)
    return p.select("id", F.array_join("labels", "/").alias("labels"), F.array_join(F.transform("labels", T.abbreviated), "/").alias("short"))


_WORD = "[0-9A-Za-z'']+"
_GAP = "[^0-9A-Za-z'']"
_TAGGED = ", ".join(f"'{w}'" for words in V.TAG_WORDS.values() for w in words.split())
_PATCHES = rf"""p AS (
        SELECT p_partkey AS id, list_concat([p_brand || ' parts collection', lpad(CAST(p_size AS VARCHAR), 2, '0') || '. ' || p_type],
                   list_concat(CASE p_partkey % 4 WHEN 0 THEN ['1 BASS'] WHEN 1 THEN ['02 - Keys & Pads'] ELSE [] END, [split_part(p_name, ' ', 2)])) AS folders,
               p_type || ' ' || p_name || CASE WHEN p_partkey % 7 = 0 THEN ' ' || upper(p_brand) || ' Parts take ' || p_partkey % 3 ELSE '' END AS name
        FROM part
    ), t AS (
        SELECT id, name, [regexp_extract_all(array_to_string([CASE WHEN regexp_matches(w, '^\p{{Lu}}{{4,}}$') THEN w[1] || lower(w[2:]) ELSE w END
            FOR w IN regexp_split_to_array(trim(regexp_replace(f, '^\d{{1,2}}\s*[.\-_)]?\s+', '')), '\s+') IF w <> ''], ' '), '{_WORD}') FOR f IN folders] AS words
        FROM p
    ), l AS (
        SELECT id, name, [x FOR x IN [array_to_string(list_filter(words[k], lambda w: NOT list_contains(flatten(list_transform(words[: k - 1], lambda x: list_transform(x, lambda y: lower(y)))), lower(w))), ' ')
            FOR k IN range(1, len(words) + 1)] IF x <> ''] AS labels
        FROM t
    ), s AS (
        SELECT id, name, labels, [CASE WHEN length(x) <= 11 OR len(regexp_extract_all(x, '{_WORD}')) < 2 THEN x
            ELSE array_to_string([CASE WHEN regexp_matches(w, '^[0-9]') THEN w ELSE upper(w[1]) END FOR w IN regexp_extract_all(x, '{_WORD}')], '') END FOR x IN labels] AS short
        FROM l
    )"""
_RUNGS = rf"""WITH RECURSIVE {_PATCHES}, e AS (
        SELECT id, name, labels, 1 AS k, len(regexp_extract_all(labels[1], '{_WORD}')) AS n FROM s
        UNION ALL
        SELECT id, CASE WHEN said THEN less ELSE name END, labels, CASE WHEN said OR n = 1 THEN k + 1 ELSE k END,
               CASE WHEN said OR n = 1 THEN len(regexp_extract_all(coalesce(labels[k + 1], ''), '{_WORD}')) ELSE n - 1 END
        FROM (SELECT *, less <> '' AND less <> name AS said FROM (SELECT *, CASE
                WHEN len(words) <= n THEN name
                WHEN n > 1 THEN trim(regexp_replace(regexp_replace(name, '(^|{_GAP})' || run || '({_GAP}|$)', '\1\2', 'gi'), '\s{{2,}}', ' ', 'g'), ' -_')
                WHEN lower(words[1]) = run THEN trim(regexp_replace(regexp_replace(name, '^' || run || '{_GAP}*', '', 'i'), '\s{{2,}}', ' ', 'g'), ' -_')
                WHEN lower(words[-1]) = run THEN trim(regexp_replace(regexp_replace(name, '{_GAP}*' || run || '$', '', 'i'), '\s{{2,}}', ' ', 'g'), ' -_')
                ELSE name END AS less
            FROM (SELECT *, regexp_extract_all(name, '{_WORD}') AS words, array_to_string(regexp_extract_all(lower(labels[k]), '{_WORD}')[: n], '{_GAP}+') AS run FROM e WHERE k <= len(labels))))
    ), f AS (SELECT s.id, e.name, s.labels, s.short FROM s JOIN e USING (id) WHERE k = len(s.labels) + 1),
    g AS (
        SELECT id, name, short, [short[k] FOR k IN range(1, len(labels) + 1) IF NOT list_has_all([{_TAGGED}],
            list_filter(regexp_split_to_array(lower(regexp_replace(labels[k], '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda w: w <> ''))] AS telling
        FROM f
    ), u AS (SELECT id, k, [array_to_string(x[i:], ' ') || ' - ' || name FOR i IN range(len(x), 0, -1)] AS runs
             FROM (SELECT id, name, 1 AS k, telling AS x FROM g UNION ALL SELECT id, name, 2, short FROM g)),
    v AS (SELECT id, k, runs[coalesce(list_max([i FOR i IN range(1, len(runs) + 1) IF length(runs[i]) <= 18]), 1) :] AS runs FROM u),
    w AS (SELECT a.id, [trim(regexp_replace(replace(replace(x, '/', '_'), '.', ' '), '\s+', ' ', 'g')) FOR x IN list_concat(a.runs, [x FOR x IN b.runs IF NOT list_contains(a.runs, x)])] AS rungs
          FROM v a JOIN v b ON a.id = b.id AND a.k = 1 AND b.k = 2),
    r0 AS (SELECT *, 1 AS rung FROM w)"""
_ROUNDS = 16  # of at most seven rungs; the last rounds change nothing

SQL = {
    "patch_labels": f"WITH {_PATCHES} SELECT id, array_to_string(labels, '/') AS labels, array_to_string(short, '/') AS short FROM s",
    "patch_titles": _RUNGS
    + "".join(f", r{k + 1} AS (SELECT id, rungs, rung + CASE WHEN rung < len(rungs) AND count(*) OVER (PARTITION BY rungs[rung]) > 1 THEN 1 ELSE 0 END AS rung FROM r{k})" for k in range(_ROUNDS))
    + f" SELECT id, rungs[rung] AS title, CAST(rung - 1 AS BIGINT) AS rung FROM r{_ROUNDS}",
}
QUERIES = {k: f for k, f in list(globals().items()) if k in SQL}
