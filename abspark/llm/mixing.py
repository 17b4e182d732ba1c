"""Mixing sources to target weights by systematic sampling.

Rows of a source are put in order of (size, doc_id), each is expected r = target / source
size times, and a row is taken once for every integer that the running sum r * rank + offset
crosses at it. A source has one random offset, drawn from a hash of its name and the seed, so
reruns agree. Neighbours in the order have nearly the same size, so the words taken are off
the target by at most about the largest document of the source. So that their differences
don't add up either, the two rows of each pair of neighbours change places by a hash, and of
DRAWS draws (offset and places) the one that comes nearest is kept, which matters for small
sources (balanced sampling by rejection).

Nulls and repeats: a null text has size 0; a null source is a source of its own, last in
order; rows that agree in doc_id, source and size share one draw. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abspark.llm.common import NOT_TOKEN, count_words, running_sum, staged

CEILING = 3  # no source gets more than so many times its size
DRAWS = 16  # draws tried per source
WEIGHTS = 3  # weights 1, 2, 3, repeating in the order of the sources


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: every source's words, shared by weight; a source stops
    at CEILING times its size and the excess goes to the others by weight. One row per
    source; the fixed point of that resharing is found by sorting the sources by the level
    at which they are full. Ranks and sums over them go by blocks, as there may be as many
    sources as sites."""
    sources = staged(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    name = F.col("source").asc_nulls_last()
    sources = running_sum(sources, [], [name], F.lit(1)).select(
        "source", "source_size", (F.col("source_size") * CEILING).alias("full"),
        ((F.col("upto") - 1) % WEIGHTS + 1).cast("long").alias("weight"),
    )
    sources = staged(sources)
    total = lambda value: sources.agg(F.sum(value)).scalar()
    by_level = [F.col("full") / F.col("weight"), name]
    sources = running_sum(sources, [], by_level, F.col("full")).withColumnRenamed("upto", "full_upto")
    sources = running_sum(sources, [], by_level, F.col("weight")).withColumnRenamed("upto", "weight_upto")
    whole, weights = total("source_size"), total("weight")
    # At the level where this source is full, do all sources together stay within the whole?
    before, left = F.col("full_upto") - F.col("full"), weights - F.col("weight_upto") + F.col("weight")
    is_full = before * F.col("weight") + F.col("full") * left <= whole * F.col("weight")
    sources = staged(sources.select("source", "source_size", "full", "weight", is_full.alias("is_full")))
    spent = total(F.when(F.col("is_full"), F.col("full")).otherwise(0))
    open_weights = total(F.when(F.col("is_full"), 0).otherwise(F.col("weight")))
    level = (total("source_size") - spent) / F.when(open_weights > 0, open_weights)
    target = F.when(F.col("is_full"), F.col("full").cast("double")).otherwise(level * F.col("weight"))
    return sources.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int, number: int) -> Column:
    """A number in [0, 1) for each source, seed and number of the draw."""
    name = F.concat(F.coalesce(source, F.lit("")), F.lit(f":{seed}:{number}"))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def place(source: Column, rank: Column, seed: int, number: int) -> Column:
    """The rank of a row after its pair of neighbours has or has not changed places."""
    pair = F.shiftright(rank - 1, 1)
    name = F.concat_ws(":", F.coalesce(source, F.lit("")), F.lit(seed), F.lit(number), pair)
    swap = F.when(F.substring(F.md5(name), 1, 1) < "8", 0).otherwise(1)
    return pair * 2 + (rank - 1 + swap) % 2 + 1


def draw(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, rows (how many rows of the table
    share the draw): how often each document is taken."""
    units = docs.select("doc_id", "source", count_words(F.col("text"), NOT_TOKEN).alias("size"))
    units = staged(units.groupBy("source", "size", "doc_id").agg(F.count("*").alias("rows")))
    targets = source_targets(units.select("source", (F.col("size") * F.col("rows")).alias("size")))
    targets = targets.withColumnRenamed("source", "of")
    order = [F.col("size"), F.col("doc_id").asc_nulls_last()]
    ranked = running_sum(units, ["source"], order, F.lit(1))
    ranked = staged(ranked.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of"))
    rate = F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))

    def copies_of(number: int) -> Column:
        start = offset(F.col("source"), seed, number)
        rank = place(F.col("source"), F.col("upto"), seed, number)
        return F.coalesce(F.floor(rank * rate + start) - F.floor((rank - 1) * rate + start), F.lit(0))

    numbers = range(1, DRAWS + 1)
    words = F.col("size") * F.col("rows")
    tried = ranked.groupBy("source", "target").agg(*[F.sum(copies_of(k) * words).alias(f"words_{k}") for k in numbers])
    each = [F.struct(F.abs(F.col(f"words_{k}") - F.col("target")), F.lit(k).alias("number")) for k in numbers]
    best = tried.select(F.col("source").alias("of"), F.array_min(F.array(*each))["number"].alias("number"))
    ranked = ranked.join(best, F.col("source").eqNullSafe(F.col("of")))
    copies = F.coalesce(*[F.when(F.col("number") == k, copies_of(k)) for k in numbers])
    return ranked.select(
        "doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), "rows"
    )


def mix(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The rows of docs, each as often as it is drawn; columns unchanged."""
    drawn = draw(docs, seed).select(
        F.col("doc_id").alias("of_doc"), F.col("source").alias("of_source"),
        F.col("size").alias("of_size"), "copies",
    ).where("copies > 0")
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    match = (
        F.col("row.doc_id").eqNullSafe(F.col("of_doc"))
        & F.col("row.source").eqNullSafe(F.col("of_source"))
        & (count_words(F.col("row.text"), NOT_TOKEN) == F.col("of_size"))
    )
    taken = sized.join(drawn, match).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select("row.*")
