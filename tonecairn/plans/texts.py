"""Queries over documents, labels, pages and conversations: tags, keys, indexes, scopes, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import stretches
from ..operators import tables as T
from ..operators.tails import longest_shared_tails
from ..sources.tables import read

# Words that stand for a tag.
TAG_OF = {"the": "Bass", "and": "Lead", "que": "Pad", "die": "Pluck", "ing": "Drone", "to": "Keys"}
_TAGS = ", ".join(f"('{w}', '{t}')" for w, t in TAG_OF.items())


def first_of(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def derive_tags(spark, sf_dir):
    """Up to three tags of a document in the order in which its words first name them; without any, Synth."""
    tag = F.create_map(*(F.lit(x) for pair in TAG_OF.items() for x in pair))
    # the few words that name a tag, in their order, by one hash lookup a token; only these are mapped
    naming = F.array_intersect(L.tokens(F.col("text")), F.array(*(F.lit(w) for w in TAG_OF)))
    named = F.array_distinct(F.transform("naming", lambda t: F.element_at(tag, t)))
    d = read(spark, sf_dir, "documents").select("doc_id", naming.alias("naming"))
    return d.select("doc_id", F.array_join(F.when(F.size(named) > 0, F.slice(named, 1, 3)).otherwise(F.array(F.lit("Synth"))), ",").alias("tags"))


def said_by_tags(spark, sf_dir):
    """Whether all words of a benchmark item name tags."""
    words = F.array(*(F.lit(w) for w in TAG_OF))
    b = read(spark, sf_dir, "benchmark").select("item_id", L.tokens(F.col("text")).alias("t"))
    return b.select("item_id", (F.size("t") > 0).alias("named"), ((F.size("t") > 0) & (F.size(F.array_except("t", words)) == 0)).alias("said"))


def sanitise_names(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", L.sanitised(F.col("text")).alias("safe"), L.spaced(F.col("text")).alias("spaced"))


def xml_names(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("name"))
    return d.select("doc_id", L.xml_escaped(F.col("name")).alias("escaped"), (L.xml_unescaped(L.xml_escaped(F.col("name"))) == F.col("name")).alias("back"))


def content_key(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", L.content_key(F.col("source"), F.col("lang"), F.col("text")).alias("key"), L.content_key(F.col("text"), digits=16).alias("short_key"))


def memo_misses(spark, sf_dir):
    """Documents whose key no labelled document has, with the reason."""
    d = read(spark, sf_dir, "documents").select("doc_id", L.content_key(F.col("text")).alias("key"))
    known = d.join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("key").distinct()
    return d.join(known, "key", "left_anti").select("doc_id", "key", F.lit("unseen content").alias("reason"))


def index_upsert(spark, sf_dir):
    """The tag index of all documents with the quality labels written over it."""
    base = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("tag"))
    delta = read(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("tag"))
    return T.upsert(base, delta, "doc_id")


def index_rekey(spark, sf_dir):
    """Documents 2k and 2k + 1 swap places for every k under 40; 100 + k move onto 200 + k."""
    base = read(spark, sf_dir, "documents").select("doc_id", "source")
    swap = spark.range(80).select(F.col("id").alias("old"), (F.col("id").bitwiseXOR(F.lit(1).cast("long"))).alias("new"))
    move = spark.range(100, 140).select(F.col("id").alias("old"), (F.col("id") + 100).alias("new"))
    return T.rekey(base, swap.unionByName(move), "doc_id").select("doc_id", "source")


def index_sync(spark, sf_dir):
    source = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("v"))
    target = read(spark, sf_dir, "labels").where("doc_id % 3 <> 0").select("doc_id", (F.col("quality") * (F.col("doc_id") % 5 != 0).cast("int")).alias("v"))
    wanted = read(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return T.sync_counts(source, target, wanted, "doc_id", "v")


def suffix_match(spark, sf_dir):
    """For every page the other page whose URL shares the longest tail of path parts."""
    p = read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    return T.locate_other(p, "page_id").select("page_id", "found", F.col("parts").cast("long").alias("parts"))


def tail_match(spark, sf_dir):
    """What ``suffix_match`` finds, by sorting URLs from their end instead of by all of their tails."""
    return longest_shared_tails(read(spark, sf_dir, "pages").select("page_id", "url"), "page_id", "url")


def scope_inherit(spark, sf_dir):
    """Turns take on the last system and user text before them within their conversation, however long it is."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    narrow = [F.col("turn"), F.substring("role", 1, 64), F.when(F.length("role") < 64, F.substring("text", 1, 64))]  # bounds of ranges reach the driver
    turns = stretches.numbered(c, ["conv_id"], ["turn", "role", "text"], size_hint=narrow).select("conv_id", "turn", "role", "i", F.length("text").cast("long").alias("chars"))
    of = lambda role: F.when(F.col("role") == role, F.col("chars"))
    found = stretches.running(turns, "conv_id", lasts={"system_chars": of("system"), "user_chars": of("user")})
    return found.select("conv_id", "turn", "role", "system_chars", "user_chars")


def longest_text(spark, sf_dir):
    """Of documents of one source and language the longest, ties to the first."""
    return first_of(read(spark, sf_dir, "documents"), ["source", "lang"], F.desc("n_chars"), "doc_id").select("source", "lang", "doc_id", "n_chars")


def merged_flags(spark, sf_dir):
    """Flags of a document from its two labels and its length, distinct and sorted."""
    l, d = read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    a = F.when(F.col("toxic") == 1, F.array(F.lit("review"), F.lit("toxic"))).otherwise(F.array().cast("array<string>"))
    b = F.when((F.col("quality") == 0) | (F.col("n_chars") > 5000), F.array(F.lit("review"))).otherwise(F.array().cast("array<string>"))
    return l.join(d, "doc_id").select("doc_id", F.array_join(F.array_sort(F.array_union(a, b)), ",").alias("flags"))


_PATHS = """WITH p AS (SELECT page_id, url AS path FROM pages), x AS (SELECT page_id, path, string_split(lower(path), '/') AS parts FROM p),
    s AS (SELECT page_id, path, len(parts) - k + 1 AS n, array_to_string(parts[k:], '/') AS tail FROM x, range(1, 40) t(k) WHERE k <= len(parts))"""

SQL = {
    "derive_tags": f"""WITH m(w, tag) AS (VALUES {_TAGS}), t AS (SELECT doc_id, regexp_split_to_array(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+') AS ts FROM documents),
        u AS (SELECT doc_id, unnest(ts) AS w, generate_subscripts(ts, 1) AS i FROM t), f AS (SELECT doc_id, tag, min(i) AS i FROM u JOIN m USING (w) GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f), g AS (SELECT doc_id, string_agg(tag, ',' ORDER BY k) AS tags FROM k WHERE k <= 3 GROUP BY 1)
        SELECT doc_id, coalesce(tags, 'Synth') AS tags FROM documents LEFT JOIN g USING (doc_id)""",
    "said_by_tags": f"""WITH t AS (SELECT item_id, list_filter(regexp_split_to_array(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM benchmark)
        SELECT item_id, len(t) > 0 AS named, len(t) > 0 AND len(list_filter(t, lambda x: x NOT IN ({', '.join(repr(w) for w in dict.fromkeys(TAG_OF))}))) = 0 AS said FROM t""",
    "sanitise_names": r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_]', '_', 'g'), '_+', '_', 'g'), '_') AS safe,
        trim(regexp_replace(replace(text, '.', ' '), '[\x09-\x0D\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g')) AS spaced FROM documents""",
    "xml_names": """WITH n AS (SELECT doc_id, text AS name FROM documents)
        SELECT doc_id, replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped, true AS back FROM n""",
    "content_key": "SELECT doc_id, substr(sha256(source || chr(31) || lang || chr(31) || text), 1, 32) AS key, substr(sha256(text), 1, 16) AS short_key FROM documents",
    "memo_misses": """WITH k AS (SELECT doc_id, substr(sha256(text), 1, 32) AS key FROM documents)
        SELECT doc_id, key, 'unseen content' AS reason FROM k WHERE key NOT IN (SELECT key FROM k WHERE doc_id IN (SELECT doc_id FROM labels))""",
    "index_upsert": "SELECT d.doc_id, coalesce('q' || l.quality, d.lang) AS tag FROM documents d LEFT JOIN labels l USING (doc_id) UNION ALL SELECT doc_id, 'q' || quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "index_rekey": """WITH m AS (SELECT i AS old, xor(i, 1) AS new FROM range(0, 80) t(i) UNION ALL SELECT i, i + 100 FROM range(100, 140) t(i)),
        j AS (SELECT coalesce(m.new, d.doc_id) AS doc_id, source, m.new IS NOT NULL AS moved FROM documents d LEFT JOIN m ON d.doc_id = m.old)
        SELECT doc_id, source FROM j QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY moved DESC) = 1""",
    "index_sync": """WITH t AS (SELECT doc_id, quality * (doc_id % 5 <> 0)::INT AS v FROM labels WHERE doc_id % 3 <> 0), w AS (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en')
        SELECT count(*) FILTER (l.quality IS NOT NULL AND l.quality IS DISTINCT FROM t.v) AS updated, count(*) FILTER (l.quality IS NULL) AS missing
        FROM w LEFT JOIN labels l USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "suffix_match": _PATHS + """, m AS (SELECT w.page_id, f.path AS found, w.n AS parts FROM s w JOIN s f ON w.tail = f.tail AND w.page_id <> f.page_id)
        SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY parts DESC, found) = 1""",
    "scope_inherit": """SELECT conv_id, turn, role, last_value(CASE WHEN role = 'system' THEN length(text) END IGNORE NULLS) OVER w AS system_chars,
        last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER w AS user_chars FROM conversations
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)""",
    "longest_text": "SELECT source, lang, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) = 1",
    "merged_flags": """SELECT doc_id, CASE WHEN toxic = 1 THEN 'review,toxic' WHEN quality = 0 OR n_chars > 5000 THEN 'review' ELSE '' END AS flags
        FROM labels JOIN documents USING (doc_id)""",
}
SQL["tail_match"] = SQL["suffix_match"]
QUERIES = {k: f for k, f in list(globals().items()) if k in SQL}
