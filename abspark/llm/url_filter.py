"""URL filters: rules of host and path prefix, looked up by hashed expressions.

Each distinct host and path is expanded into host suffixes and path prefixes; expressions
meet rules by the first bytes of their digest, are confirmed by the whole digest, and the
longest rule wins (at equal length the one with the longer host, then block before allow).

A null url or one without "://" has an empty host and path and fits no rule. Urls that no
rule fits are allowed. Rows that repeat keep their own result; an empty table of rules
allows everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abspark.llm.common import LOWER, UPPER, bounded

DEFAULT = "allow"
PREFIX_BYTES = 4
RULES_BROADCAST = 200_000  # rules up to this count are broadcast; more are joined by shuffle


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def digests(host: Column, path: Column) -> list[Column]:
    """Short prefix and whole digest of an expression."""
    digest = F.sha2(F.concat_ws("\n", host, path), 256)
    return [F.substring(digest, 1, 2 * PREFIX_BYTES).alias("short"), digest.alias("digest")]


def host_suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    tails = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(tails)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url).
    rules: host, path, action; a rule holds for its host and all subdomains."""
    rules = rules.select(
        F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action",
        *digests(F.col("host"), F.col("path")),
    ).where("rule_host <> ''").dropDuplicates(["digest", "action"])
    # Prefixes are only cut at lengths some rule has; a path has few lengths that exist.
    lengths = [r[0] for r in rules.select(F.length("rule_path")).distinct().collect()]
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    cuts = F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>")
    fitting = F.filter(cuts, lambda n: n <= F.length("path"))
    asked = (
        urls.select("host", "path").distinct()
        .select("host", "path", F.explode(host_suffixes(F.col("host"))).alias("suffix"))
        .select("host", "path", "suffix", F.explode(fitting).alias("cut"))
        .select("host", "path", *digests(F.col("suffix"), F.substr(F.col("path"), F.lit(1), F.col("cut"))))
    )
    rules = bounded(rules.withColumnRenamed("digest", "rule_digest"), RULES_BROADCAST)
    hits = asked.join(rules, "short").where(F.col("digest") == F.col("rule_digest"))
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("length"),
        F.length("rule_host").alias("host_length"), (F.col("action") == "block").alias("blocks"),
        F.concat("rule_host", "rule_path").alias("rule"), "action",
    )
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    judged = urls.join(best, ["host", "path"], "left")
    return judged.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
