"""Document fingerprints by SpotSigs.

A signature is a common word (the anchor) with the CHAIN content words that follow it within
REACH words. So that texts without common words have signatures, the start of the text and
every content word whose hash is divisible by EXTRA are anchors, too; chains at the end of a
text are shorter. The fingerprint of a text is the sorted set of its signature hashes, eight
hex digits each; likeness is the Jaccard similarity of two sets.

near_classes() finds likely pairs in a table: documents with equal fingerprints are a class;
classes are partitioned by set length so that only neighbouring partitions can hold sets
similar enough, meet by a signature of their prefixes, and are compared only if their lengths
allow the threshold.

A null or empty text, or one without words, has the empty fingerprint; two empty ones are
alike (1), an empty and another are not (0). Null doc_ids come last in order. Where a doc_id
repeats, the text with the smallest hash is the next document of the one before. An empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abspark.llm.common import ascii_lower, ordered_blocks, row_key, staged, words

CHAIN, REACH, EXTRA = 2, 8, 8

# Common words of four languages.
COMMON = {
    "en": "the a an of to in on at by for with from as is are was were be been it its this that these "
    "those and or but not he she they you we i his her their our has have had will would can said",
    "fr": "le la les un une des du de et ou en dans sur pour par avec que qui est sont au aux ce cette "
    "il elle se ne pas plus son sa ses",
    "de": "der die das den dem des ein eine einen und oder in im zu von mit auf für ist sind war nicht "
    "auch als an bei nach sich es er sie wir",
    "es": "el los las una unos y o en con por para que es son al lo se su sus no más como pero",
}
COMMON_WORDS = sorted({w for text in COMMON.values() for w in text.split()})


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the sorted distinct signatures of a text column. Each step is a column of its own,
    so that no lambda computes an array again for every element."""
    w, c = f"{name}_words", f"{name}_content"
    df = df.withColumn(w, words(ascii_lower(F.col(text))))
    common = lambda x: x.isin(COMMON_WORDS)
    df = df.withColumn(c, F.transform(F.col(w), lambda x: F.when(~common(x), x)))

    def signature(x: Column, i: Column) -> Column:
        chain = F.slice(F.array_compact(F.slice(F.col(c), i + 2, REACH)), 1, CHAIN)
        anchor = F.get(F.col(c), i).isNull() | (F.pmod(F.hash(x), F.lit(EXTRA)) == 0)
        return F.when(anchor, F.hash(x, chain))

    start = F.hash(F.lit(""), F.slice(F.array_compact(F.slice(F.col(c), 1, REACH)), 1, CHAIN))
    first = F.when(F.size(w) > 0, F.array(start)).otherwise(F.array().cast("array<int>"))
    every = F.concat(first, F.array_compact(F.transform(F.col(w), signature)))
    return df.withColumn(name, F.array_sort(F.array_distinct(every))).drop(w, c)


def printed(signatures: Column) -> Column:
    return F.array_join(F.transform(signatures, lambda x: F.lpad(F.hex(x.cast("bigint").bitwiseAND(0xFFFFFFFF)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 1.0).otherwise(common / union)


def next_documents(docs: DataFrame) -> DataFrame:
    """of, next_id, next_part, need for each distinct doc_id: the document after it (after
    the last the first) and how many of its characters are asked for. Ids are put in order
    by blocks; only one row per block meets in one task."""
    ids = docs.groupBy("doc_id").agg(
        F.max(F.floor(F.char_length("text") / 4)).alias("need"), F.min(row_key(F.col("text"))).alias("part")
    )
    blocks = ordered_blocks(ids, F.col("doc_id").asc_nulls_last())
    within = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_last())
    one = F.struct("doc_id", "part")
    linked = blocks.withColumn("next", F.lead(one).over(within))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "part")).alias("head")
    heads = blocks.groupBy("block").agg(least)
    line = Window.partitionBy(F.lit(0)).orderBy("block")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(
        "block", F.coalesce(F.lead("head").over(line), F.first("head").over(whole)).alias("following")
    )
    after = F.coalesce("next", F.struct("following.doc_id", "following.part"))
    return linked.join(heads, "block").select(
        F.col("doc_id").alias("of"), after["doc_id"].alias("next_id"), after["part"].alias("next_part"), "need"
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, signatures for each row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_signatures(rows, "text", "signatures")


def compare_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited (the text with its last quarter replaced by the start of the
    next document), signatures, edited_signatures, near_edited, near_next."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    following = staged(next_documents(rows))
    # Ids as two plain columns, so that all joins below deal rows by the same key and the
    # texts are shuffled once.
    split = lambda c: [F.coalesce(F.col(c).cast("long"), F.lit(0)), F.col(c).isNull()]
    named = lambda c, *names: [x.alias(n) for x, n in zip(split(c), names, strict=True)]
    rows = rows.select(*named("doc_id", "id", "no_id"), "text")
    following = following.select(*named("next_id", "id", "no_id"), *named("of", "of", "of_none"), "next_part", "need")
    as_next = rows.join(following, ["id", "no_id"]).where(row_key(F.col("text")).bitwiseXOR(F.col("next_part")) == 0)
    as_next = with_signatures(as_next, "text", "next_signatures").select(
        F.col("of").alias("id"), F.col("of_none").alias("no_id"),
        F.substr(F.col("text"), F.lit(1), F.col("need").cast("int")).alias("head"), "next_signatures",
    )
    as_next = as_next.dropDuplicates(["id", "no_id"])
    pairs = rows.join(as_next, ["id", "no_id"])
    pairs = pairs.withColumn("doc_id", F.when(~F.col("no_id"), F.col("id")))
    pairs = pairs.withColumn("n_chars", F.char_length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    kept = F.substr(F.col("text"), F.lit(1), (F.col("n_chars") - quarter).cast("int"))
    pairs = pairs.withColumn("edited", F.concat(kept, F.substr(F.col("head"), F.lit(1), quarter)))
    pairs = with_signatures(with_signatures(pairs, "text", "signatures"), "edited", "edited_signatures")
    return pairs.select(
        "doc_id", "n_chars", "edited", "signatures", "edited_signatures",
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )


def near_classes(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, class) and links (a, b, likeness) between classes at least that much
    alike. A class has the documents of one fingerprint and is named by its hash; documents
    without signatures are in no class."""
    prints = fingerprints(docs).where(F.size("signatures") > 0)
    members = staged(prints.select("doc_id", F.sha2(printed(F.col("signatures")), 256).alias("class"), "signatures"))
    classes = staged(members.select("class", "signatures").dropDuplicates(["class"]))
    size = F.size("signatures")
    partition = F.floor(F.log(size) / F.lit(math.log(1 / threshold)) + 1e-9)
    prefix = F.slice("signatures", F.lit(1), (size - F.ceil(size * threshold - 1e-9) + 1).cast("int"))
    index = classes.select("class", size.alias("size"), partition.alias("partition"), F.explode_outer(prefix).alias("signature"))
    left = index.select(F.col("class").alias("a"), F.col("size").alias("size_a"), "partition", "signature")
    right = index.select(
        F.col("class").alias("b"), F.col("size").alias("size_b"), "signature",
        F.explode(F.array(F.col("partition") - 1, F.col("partition"))).alias("partition"),
    )
    allowed = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * threshold - 1e-9
    once = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b")))
    pairs = left.join(right, ["partition", "signature"]).where(allowed & once).select("a", "b").distinct()
    side = lambda c: classes.select(F.col("class").alias(c), F.col("signatures").alias(f"set_{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    near = near.select("a", "b", likeness(F.col("set_a"), F.col("set_b")).alias("likeness"))
    return members.select("doc_id", "class"), near.where(F.col("likeness") >= threshold)
