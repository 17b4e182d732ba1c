"""The operators as queries over the driver tables, with production parameters and whole
tables, and the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abspark.llm import decontaminate as decon
from abspark.llm import (
    lexical_search, license_scan, lm_score, mixing, setsketch, spelling, spotsigs, suffix_dedup, token_counts, toxicity, url_filter,
    vector_search,
)
from abspark.llm.common import table
from abspark.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The rules of the url query.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, folder: fn(prepare(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOKEN = r"[^\x20\x09-\x0D]+"


@query("op1_decontaminate", rf"""
WITH d AS (
    SELECT doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM benchmark
), gram AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n,
        array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS gram
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), sizes AS (
    SELECT DISTINCT n FROM gram
), tried AS (
    SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS gram
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)
), hit AS (
    SELECT doc_id, s, n, item_id FROM tried JOIN gram USING (n, gram)
), place AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit))
    GROUP BY doc_id
), item AS (
    SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS sha
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
    coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN place USING (doc_id) LEFT JOIN item USING (doc_id)
""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    judged = decon.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op3_license_scan")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, folder, "documents"))


@query("op6_url_filters", r"""
WITH u AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), p AS (
    SELECT page_id,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM u
), r(rule_host, rule_path, action) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), best AS (
    SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
        arg_max(action, length(rule_host || rule_path)) AS action
    FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)
""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge_urls(table(spark, folder, "pages"), rules)


@query("op8_token_counts")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.length_histogram(table(spark, folder, "documents"))


@query("op9_mix_sources", rf"""
WITH d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) AS BIGINT) AS size FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
    FROM d GROUP BY source
), level AS (
    SELECT *, (SELECT sum(least(3 * o.source_size * s.weight, 3 * s.source_size * o.weight)) FROM s AS o)
        <= (SELECT sum(source_size) FROM s) * s.weight AS is_full
    FROM s
), target AS (
    SELECT source, source_size, CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE) ELSE
        CAST((SELECT sum(source_size) - sum(CASE WHEN is_full THEN 3 * source_size ELSE 0 END) FROM level) AS DOUBLE)
        / CAST((SELECT sum(CASE WHEN is_full THEN 0 ELSE weight END) FROM level) AS DOUBLE) * weight END AS target
    FROM level
), ranked AS (
    SELECT d.source, d.doc_id, d.size, t.source_size, t.target, target / nullif(t.source_size, 0) AS rate,
        dense_rank() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS k
    FROM d JOIN target AS t ON d.source IS NOT DISTINCT FROM t.source
), draw AS (
    SELECT source, target, n, CAST(CAST('0x' || substr(md5(coalesce(source, '') || ':1:' || n), 1, 8) AS BIGINT)
        AS DOUBLE) / 4294967296.0 AS u
    FROM target, (SELECT unnest(range(1, 17)) AS n)
), placed AS (
    SELECT ranked.*, n, u, (k - 1) // 2 * 2 + 1 + (k - 1 + CASE WHEN substr(md5(coalesce(ranked.source, '')
        || ':1:' || n || ':' || (k - 1) // 2), 1, 1) < '8' THEN 0 ELSE 1 END) % 2 AS p
    FROM ranked JOIN draw ON ranked.source IS NOT DISTINCT FROM draw.source
), tried AS (
    SELECT *, size * CAST(coalesce(floor(p * rate + u) - floor((p - 1) * rate + u), 0) AS BIGINT) AS taken FROM placed
), best AS (
    SELECT source, arg_min(n, row(away, n)) AS n
    FROM (SELECT source, n, abs(CAST(sum(taken) AS BIGINT) - any_value(target)) AS away FROM tried GROUP BY source, n)
    GROUP BY source
)
SELECT doc_id, size, source_size, target, taken
FROM tried JOIN best ON tried.source IS NOT DISTINCT FROM best.source AND tried.n = best.n
""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    drawn = mixing.draw(table(spark, folder, "documents"))
    each = drawn.select("*", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row"))
    return each.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op10_setsketch_dedup", rf"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all({LOWERED}, '{TOKEN}') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
    SELECT x.doc_id AS a, y.doc_id AS b
    FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id <> y.doc_id
    JOIN n AS p ON p.doc_id = x.doc_id JOIN n AS q ON q.doc_id = y.doc_id
    GROUP BY x.doc_id, y.doc_id, p.n, q.n
    HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM reach AS r JOIN link AS l ON r.other = l.a
), c AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    judged = setsketch.near_duplicates(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_shingles", "component_id", "kept")


@query("op4_suffix_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    judged = suffix_dedup.remove_repeats(table(spark, folder, "documents"), with_text=False)
    return judged.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op5_lm_scoring")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.score_texts(table(spark, folder, "documents"))


@query("op2_spotsigs")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    pairs = spotsigs.compare_edited(table(spark, folder, "documents"))
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.printed(F.col("signatures")).alias("fingerprint"),
        spotsigs.printed(F.col("edited_signatures")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


@query("op7_toxicity")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op11_spelling_variants")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


@query("op12_lexical_search", rf"""
WITH d AS (
    SELECT doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM documents
), whole AS (
    SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0
), post AS (
    SELECT doc_id, n, term, count(*) AS tf
    FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d) GROUP BY doc_id, n, term
), rare AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight
    FROM (SELECT term, count(*) AS df FROM post GROUP BY term), whole
), item AS (
    SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all({LOWERED}, '{WORD}')) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark)
    ) GROUP BY item_id, term
), scored AS (
    SELECT item_id, doc_id, CAST(sum(times * weight
        * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM item JOIN rare USING (term) JOIN post USING (term), whole GROUP BY item_id, doc_id
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
    FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_nearest_neighbours")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return vector_search.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)
