"""Benchmark decontamination by winnowing.

Words are lower-cased runs of letters and digits. Of every SPAN consecutive words, cut into
k-grams, the smallest k-gram hash is a fingerprint; two texts that share SPAN words share
the fingerprint of that span, whatever stands around it. Distinct fingerprints of documents
meet those of the benchmark; in the documents that have some in common, the places of the
common fingerprints are extended to every window around them, and a window counts when the
benchmark holds the same words. Items shorter than SPAN words are one window; they are
looked up by the hash of all their words, one length at a time.

Arrays are blown up with explode_outer: for explode() the optimizer adds a filter on the
array's size and pushes it down to the scan, where the array would be computed once more,
inside lambdas for every element.

Hashes only choose candidates; windows are compared by their words. Rows are judged by
themselves: rows that repeat a doc_id with another text get results of their own, exact
repeats the same. Null or empty texts have no words; an empty benchmark hits nothing; items
without words have no window; repeated items count by their distinct ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abspark.llm.common import ascii_lower, bounded, row_key, staged, words

SPAN = 10  # words of a window
GRAM = 5  # words hashed together; SPAN - GRAM + 1 of them lie in a window
PRINTS_BROADCAST = 500_000  # benchmark fingerprints up to this count are broadcast


def gram_hashes(tokens: Column, n: int) -> Column:
    """Hash of the n words from each place on; no places if there are fewer words."""
    at = lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(n)])
    places = F.sequence(F.lit(0), F.size(tokens) - n)
    return F.when(F.size(tokens) >= n, F.transform(places, at)).otherwise(F.array().cast("array<bigint>"))


def winnow(hashes: Column) -> Column:
    """Distinct smallest hashes of all runs of SPAN - GRAM + 1; none from shorter inputs."""
    run = SPAN - GRAM + 1
    smallest = F.transform(
        hashes, lambda h, i: F.when(i <= F.size(hashes) - run, F.least(h, *[F.get(hashes, i + j) for j in range(1, run)]))
    )
    return F.array_distinct(F.filter(smallest, lambda h: h.isNotNull()))


def with_prints(df: DataFrame, tokens: str, name: str) -> DataFrame:
    """Add the winnowed hashes of a token column. Hashes get a column of their own first:
    inside the lambda the expression would be computed anew for every place."""
    hashed = df.withColumn("hashes", gram_hashes(F.col(tokens), GRAM))
    return hashed.withColumn(name, winnow(F.col("hashes"))).drop("hashes")


def windows(tokens: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(tokens, start + 1, length), " ")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """window, length, item: one row for every item a window is in."""
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item"), words(ascii_lower(F.col("text"))).alias("tokens")
    ).where(F.size("tokens") > 0)
    length = F.least(F.size("tokens"), F.lit(SPAN))
    places = F.explode_outer(F.sequence(F.lit(0), F.size("tokens") - length)).alias("start")
    cut = items.select("item", "tokens", length.alias("length"), places)
    cut = cut.select("length", windows(F.col("tokens"), F.col("start"), F.col("length")).alias("window"), "item")
    return cut.distinct()


def contaminated_words(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, part (tells repeated ids apart), spans (array of start and length of the
    occurrences), items (distinct ids), for documents with a hit. Windows are looked up
    without their items, which may be very many for a template; items are joined to the
    distinct windows of a document afterwards."""
    of_items = staged(benchmark_windows(benchmark))
    found = staged(of_items.select("window", "length").distinct())
    short = [r[0] for r in found.where(F.col("length") < SPAN).select("length").distinct().collect()]
    found = found.withColumn("tokens", F.split("window", " "))
    prints = with_prints(found.where(F.col("length") == SPAN), "tokens", "prints").select(
        F.lit(SPAN).alias("length"), F.explode_outer("prints").alias("print")
    )
    for n in sorted(short):
        one = found.where(F.col("length") == n)
        prints = prints.union(one.select(F.lit(n), F.get(gram_hashes(F.col("tokens"), n), F.lit(0))))
    prints = staged(prints.distinct())
    tagged = lambda hashes, n: F.transform(hashes, lambda h: F.struct(F.lit(n).alias("length"), h.alias("print")))

    texts = docs.select("doc_id", row_key(F.col("text")).alias("part"), F.col("text").alias("body"))
    texts = texts.where("body is not null")
    tokenized = texts.select("doc_id", "part", words(ascii_lower(F.col("body"))).alias("tokens"))
    sets = [tagged(F.col("prints"), SPAN)]
    sets += [tagged(F.array_distinct(gram_hashes(F.col("tokens"), n)), n) for n in sorted(short)]
    printed = with_prints(tokenized, "tokens", "prints")
    rows = printed.select("doc_id", "part", F.explode_outer(F.concat(*sets)).alias("ask"))
    rows = rows.select("doc_id", "part", F.col("ask.length").alias("length"), F.col("ask.print").alias("print"))
    common = rows.join(bounded(prints, PRINTS_BROADCAST), ["length", "print"])
    lengths = [SPAN, *sorted(short)]
    own = [F.collect_set(F.when(F.col("length") == n, F.col("print"))).alias(f"own_{n}") for n in lengths]
    common = staged(common.groupBy("doc_id", "part").agg(*own))
    common = common.withColumnsRenamed({"doc_id": "of", "part": "of_part"})

    # Extend: every window that holds a place of a common fingerprint is looked up by its words.
    held = texts.join(common, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    held = held.dropDuplicates(["doc_id", "part"])
    held = held.withColumn("tokens", words(ascii_lower(F.col("body"))))

    def starts(n: int) -> Column:
        gram = GRAM if n == SPAN else n
        common_here = lambda h, i: F.when(F.array_contains(F.col(f"own_{n}"), h), i)
        places = F.array_compact(F.transform(gram_hashes(F.col("tokens"), gram), common_here))
        first = lambda i: F.greatest(i - (n - gram), F.lit(0))
        last = lambda i: F.least(i, F.size("tokens") - n)
        around = F.flatten(F.transform(places, lambda i: F.sequence(first(i), last(i))))
        return F.when(F.size("tokens") >= n, F.array_distinct(around))

    for n in lengths:
        held = held.withColumn(f"starts_{n}", starts(n))
    none = F.array().cast("array<struct<start:int,length:int>>")
    spans = lambda n: F.transform(f"starts_{n}", lambda s: F.struct(s.alias("start"), F.lit(n).alias("length")))
    tried = F.concat(*[F.coalesce(spans(n), none) for n in lengths])
    tried = held.select("doc_id", "part", "tokens", F.explode_outer(tried).alias("span"))
    tried = tried.select(
        "doc_id", "part", "span",
        windows(F.col("tokens"), F.col("span.start"), F.col("span.length")).alias("window"),
    )
    known = bounded(found.select("window"), PRINTS_BROADCAST, "window")
    hits = staged(tried.join(known, "window").select("doc_id", "part", "span", "window"))
    spans = hits.groupBy("doc_id", "part").agg(F.collect_set("span").alias("spans"))
    in_items = bounded(of_items.select("window", "item"), PRINTS_BROADCAST, "window")
    items = hits.select("doc_id", "part", "window").distinct().join(in_items, "window")
    items = items.select("doc_id", "part", "item").distinct()
    items = items.groupBy(F.col("doc_id").alias("of"), F.col("part").alias("of_part")).agg(
        F.collect_list("item").alias("items")
    )
    match = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))
    return spans.join(items, match).select("doc_id", "part", "spans", "items")


def covered(spans: Column) -> Column:
    """Words that lie in any of the spans."""
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("words"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["end"], s["start"] + s["length"]).alias("end"),
        (acc["words"] + F.greatest(s["start"] + s["length"] - F.greatest(acc["end"], s["start"]), F.lit(0))).alias("words"),
    )
    return F.aggregate(F.array_sort(spans), begin, step, lambda acc: acc["words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, part, n_words, n_hit, items (sorted ids), spans."""
    hits = contaminated_words(docs, benchmark).select(
        F.col("doc_id").alias("of"), F.col("part").alias("of_part"), "spans", "items"
    )
    sized = docs.select(
        "doc_id", row_key(F.col("text")).alias("part"),
        F.size(words(F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "a" * 26))).cast("long").alias("n_words"),
    )
    joined = sized.join(hits, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")), "left")
    return joined.select(
        "doc_id", "part", "n_words",
        F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.array_sort("items"), F.array().cast("array<string>")).alias("items"), "spans",
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a hit; columns unchanged."""
    hit = contaminated_words(docs, benchmark).select(F.col("doc_id").alias("of"), F.col("part").alias("of_part"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    match = F.col("row.doc_id").eqNullSafe(F.col("of")) & (row_key(F.col("row.text")) == F.col("of_part"))
    return rows.join(hit, match, "left_anti").select("row.*")
