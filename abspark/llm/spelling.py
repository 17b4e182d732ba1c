"""Spelling variants: words that differ by one inserted, deleted or replaced code point.

Neighbours are found by a relational trie frontier. The trie of all words is a table: one row
per node (a prefix) with the code points of its children, which an alphabet bounds. States
(word, node, rest of the word, edits) are joined with it level by level. A state without an
edit may leave out its next code point or take the wrong child, which makes it a one-edit
state; that one must match the rest exactly and becomes a neighbour where it ends on a word.

* Two words one edit apart share their first or their last half. So there are two tries, of
  the words and of the reversed words, and states enter each at half of their word, where the
  node is known. The root and other nodes that all words share are never joined.
* A pair is found from one side only: from the longer word, by leaving a code point out, or
  from the one with the smaller code point, by replacing it.
* Words of more than LONG code points would need a level for each of them. They hang from
  the trie as whole edges: they are keyed by two 64-bit hashes of what is left without one
  code point, and every pair met is compared exactly. That is a row per code point.

Results: a null text has no words; a null doc_id hashes as an empty one; rows that repeat count
each; an empty table gives no rows. A run of letters is deleted from by the hash of its
document and itself, so all its places in a document agree. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abspark.llm.common import new_folder, staged

MIN_LENGTH = 6  # code points of a word
MIN_COUNT = 5  # occurrences of a word
FORM_FACTOR = 5  # a form is so many times as frequent as the word
EVERY = 199  # one (document, run) in so many loses a code point
LONG = 48  # code points from which a word is one edge
HELD = 200_000  # different words a task counts before it sends them on

# Latin-1 letters, A-Z lower-cased; everything else, and what Latin-1 does not have, parts words.
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256)
)


def edited_run(run: bytes, prefix_crc: int, every: int = EVERY) -> bytes:
    """The run (Latin-1), or what is left of it when its document's hash says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix_crc)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """word, n over all documents, counted in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.record_batch([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                runs = Counter((text.as_py() or "").encode("latin-1", "replace").translate(LETTERS).split())
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in runs.items():
                    held[edited_run(run, prefix, every)] += n
                if len(held) > HELD:
                    yield sent()
                    held.clear()
        yield sent()

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- the trie
def with_reversed(words: DataFrame) -> DataFrame:
    """word and spelt: the word forwards (backwards false) and backwards (true)."""
    both = F.array(
        F.struct(F.lit(False).alias("backwards"), F.col("word").alias("spelt")),
        F.struct(F.lit(True).alias("backwards"), F.reverse("word").alias("spelt")),
    )
    return words.select("word", F.explode(both).alias("way")).select("word", "way.*")


def half(length: Column) -> Column:
    return F.floor(length / 2).cast("int")


def trie_nodes(spelt: DataFrame, first_depth: int) -> DataFrame:
    """One row per node of at least that depth that has children: depth, backwards, node,
    children (code points, sorted) and ends (those that end a word)."""
    depths = F.sequence(F.lit(first_depth), F.char_length("spelt") - 1)
    each = spelt.where(F.char_length("spelt") > first_depth).select(
        "backwards", "spelt", F.explode(depths).alias("depth")
    )
    each = each.select(
        "depth", "backwards",
        F.expr("left(spelt, depth)").alias("node"),
        F.expr("substr(spelt, depth + 1, 1)").alias("child"),
        (F.col("depth") == F.char_length("spelt") - 1).alias("is_end"),
    )
    return each.groupBy("depth", "backwards", "node").agg(
        F.array_sort(F.collect_set("child")).alias("children"),
        F.collect_set(F.when(F.col("is_end"), F.col("child"))).alias("ends"),
    )


STATE = ["word", "backwards", "node", "rest", "edits", "at_end"]


def left_out(states: DataFrame, *carried: str) -> DataFrame:
    """States, and those made of the ones without an edit by leaving out the next code point."""
    more = F.struct(F.expr("substr(rest, 2)").alias("rest"), F.lit(1).alias("edits"))
    same = F.struct("rest", "edits")
    both = F.when((F.col("edits") == 0) & (F.col("rest") != ""), F.array(same, more)).otherwise(F.array(same))
    return states.withColumn("next", F.explode(both)).select(
        *carried, "word", "backwards", "node", "next.rest", "next.edits", "at_end"
    )


def is_neighbour() -> Column:
    return (F.col("edits") == 1) & (F.col("rest") == "") & F.col("at_end")


def one_level(states: DataFrame, nodes: DataFrame) -> DataFrame:
    """States a level deeper: those whose next code point is a child go there; those without
    an edit also go to children of larger code points, with one edit."""
    nodes = nodes.select(F.col("backwards").alias("of_way"), F.col("node").alias("of_node"), "children", "ends")
    met = states.where("rest <> ''").join(
        nodes, (F.col("backwards") == F.col("of_way")) & (F.col("node") == F.col("of_node"))
    )
    met = met.withColumn("c", F.expr("substr(rest, 1, 1)"))
    taken = F.expr("""CASE WHEN edits = 0 THEN filter(children, x -> x >= c)
        WHEN array_contains(children, c) THEN array(c) END""")
    deeper = met.withColumn("child", F.explode(taken)).select(
        "word", "backwards", F.concat("node", "child").alias("node"),
        F.expr("substr(rest, 2)").alias("rest"),
        F.when(F.col("child") == F.col("c"), F.col("edits")).otherwise(F.lit(1)).alias("edits"),
        F.array_contains("ends", F.col("child")).alias("at_end"),
    )
    return left_out(deeper)


def entering(spelt: DataFrame) -> DataFrame:
    """States of all words at the node of their half, with its depth."""
    depth = half(F.char_length("spelt"))
    begun = spelt.withColumn("depth", depth).select(
        "depth", "word", "backwards", F.expr("left(spelt, depth)").alias("node"),
        F.expr("substr(spelt, depth + 1)").alias("rest"), F.lit(0).alias("edits"), F.lit(False).alias("at_end"),
    )
    return left_out(begun, "depth")


def trie_pairs(words: DataFrame) -> DataFrame:
    """a, b: pairs of words one edit apart, both at most LONG long, each in one order or both.
    The plan of a level is the same for all levels, and its depth a folder, so that Spark
    compiles it once."""
    spark = words.sparkSession
    spelt = staged(with_reversed(words.where(F.char_length("word") <= LONG)))
    bounds = spelt.agg(F.min(F.char_length("spelt")), F.max(F.char_length("spelt"))).first()
    if bounds[0] is None:
        return words.select(F.col("word").alias("a"), F.col("word").alias("b")).limit(0)
    first, last = bounds[0] // 2, bounds[1] - 1
    folder = new_folder(spark)
    trie_nodes(spelt, first).write.partitionBy("depth").parquet(f"{folder}/nodes")
    entering(spelt).repartition("depth", "backwards", "node").write.partitionBy("depth").parquet(f"{folder}/entering")
    nodes, begun = spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/entering")
    frontier = None
    for depth in range(first, last + 1):
        here = F.col("depth") == depth
        states = begun.where(here).select(*STATE)
        if frontier is not None:
            states = states.unionByName(frontier)
        reached = one_level(states, nodes.where(here))
        path = f"{folder}/reached/level={depth}"
        reached.where(is_neighbour() | (F.col("rest") != "")).write.parquet(path)
        frontier = spark.read.schema(reached.schema).parquet(path).where("rest <> ''")
    found = spark.read.schema(reached.schema).parquet(*[f"{folder}/reached/level={d}" for d in range(first, last + 1)])
    other = F.when(F.col("backwards"), F.reverse("node")).otherwise(F.col("node"))
    return found.where(is_neighbour()).select(F.col("word").alias("a"), other.alias("b"))


# ---------------------------------------------------------------- long words
def _prefix_hashes(codes: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    powers = np.full(len(codes) + 1, base, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers[:-1], out=sums[1:])
    return powers, sums


_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BASES = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))


def without_each(word: str) -> tuple[np.ndarray, list[np.ndarray], list[int]]:
    """For each place, two 64-bit hashes of the word without it, and those of the whole word."""
    codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = (codes + np.uint64(1)) * _SPREAD
    codes ^= codes >> np.uint64(29)
    left, whole = [], []
    for base in _BASES:
        powers, sums = _prefix_hashes(codes, base)
        inverse = np.uint64(pow(int(base), -1, 2**64))
        left.append(sums[:-1] + (sums[-1] - sums[1:]) * inverse)
        whole.append(int(sums[-1].view(np.int64)))
    return np.arange(len(codes)), left, whole


def long_pairs(words: DataFrame) -> DataFrame:
    """a, b: pairs one edit apart with a word longer than LONG."""

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["word", "place", "x", "y"]
        for batch in batches:
            for word in batch["word"].to_pylist():
                places, (x, y), (all_x, all_y) = without_each(word)
                # place -1: the whole word, which a longer one may become
                columns = [
                    pa.array([word] * (len(places) + 1), pa.string()),
                    pa.array(np.append(places, -1), pa.int32()),
                    pa.array(np.append(x.view(np.int64), all_x), pa.int64()),
                    pa.array(np.append(y.view(np.int64), all_y), pa.int64()),
                ]
                yield pa.record_batch(columns, names)

    long = words.where(F.char_length("word") >= LONG).select("word")
    each = staged(long.mapInArrow(variants, "word string, place int, x long, y long"))
    left = each.where("place >= 0")
    right = each.select(F.col("word").alias("b"), F.col("place").alias("at"), F.col("x").alias("bx"), F.col("y").alias("by"))
    same = (F.col("x") == F.col("bx")) & (F.col("y") == F.col("by"))
    # The same rest without the same place, or a whole word that is the rest of another.
    replaced = left.join(right, same & (F.col("place") == F.col("at")) & (F.col("word") < F.col("b")))
    deleted = left.join(right.where("at = -1"), same)
    pairs = replaced.select("word", "b").unionByName(deleted.select("word", "b")).distinct()
    one_edit = F.levenshtein("word", "b", 1) == 1
    longer = F.greatest(F.char_length("word"), F.char_length("b")) > LONG
    return pairs.where(longer & one_edit).select(F.col("word").alias("a"), "b")


def neighbours(words: DataFrame) -> DataFrame:
    """word, near: every ordered pair of the words that are one edit apart."""
    pairs = trie_pairs(words).unionByName(long_pairs(words))
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")),
                   F.struct(F.col("b").alias("word"), F.col("a").alias("near")))
    return pairs.select(F.explode(both).alias("pair")).select("pair.*").distinct()


# ---------------------------------------------------------------- groups
def roots(forms: DataFrame) -> DataFrame:
    """Add root: the last word that following form leads to. Each round doubles the steps; a
    form is several times as frequent as its word, so few rounds do and none goes in circles."""
    at = staged(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        moved = staged(at.join(onward, "root").select("word", F.col("onward").alias("root"), (F.col("onward") != F.col("root")).alias("moved")))
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return forms.join(at, "word")


def spelling_variants(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """word, form, root, n, n_near, form_n: each frequent word, the near word it is a variant
    of, the last word of the chain, and counts."""
    frequent = (F.char_length("word") >= MIN_LENGTH) & (F.col("n") >= MIN_COUNT)
    words = staged(count_words(docs, every).where(frequent))
    near = neighbours(words.select("word"))
    counted = near.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    first = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), first.alias("best"))
    joined = words.join(best, "word", "left")
    form_n = -F.col("best.less")
    is_form = form_n >= FORM_FACTOR * F.col("n")
    forms = staged(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, form_n).alias("form_n"),
    ))
    return roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
