"""Ranked lexical search: for each item the documents with the highest summed term weights.

Hybrid of term-at-a-time and document-at-a-time over a document-partitioned index:

* One pass over the texts writes postings (per document its length and its terms with their
  counts) to the shared folder; lengths and document frequencies are summed from them.
* Tasks take the postings in shards of bounded size, and the items in blocks of bounded size
  that every task gets. Within a shard the lists of an item's rare terms are summed into
  accumulators at once. The accumulators then are one more iterator with an upper bound,
  beside the long lists, inside a document-at-a-time pass: blocks of documents whose bound
  cannot beat the k-th score so far are skipped, and in the others the lists with small
  bounds are only probed for documents that can still get in.
* A shard leaves at most k documents an item; ranks are taken over those.

No list, item or document is cut: bounds only skip what provably scores too low.

Results: a document of null or termless text is not counted and never found. An item of no
terms, or of terms no document has, gives no rows. Rows of items that share an id and text
count once; texts that share an id are one item together. Documents that repeat are ranked
each; equal scores go by doc_id, nulls last. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abspark.llm.common import staged

TOP = 20
SHARD_DOCS = 65_536  # documents a task holds at a time, at most
SHARD_POSTINGS = 2_000_000  # and postings (one more document may exceed it)
BLOCK_DOCS = 4_096  # documents that are skipped together
SHORT_SHARE = 1 / 64  # terms in at most this share of a shard's documents are summed at once
ITEM_TERMS = 200_000  # terms of the items that go to every task together
VOCABULARY = 500_000  # terms of all items up to which postings of other terms are not kept

# Terms are runs of letters, digits and code points outside ASCII, A-Z in lower case. In UTF-8
# such a code point is bytes from 0x80 on, so bytes can be cut as well as code points.
TERM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TERM_BYTES).split()


# ---------------------------------------------------------------- the index
def postings(texts: DataFrame, key: str, wanted: frozenset[bytes] | None = None) -> DataFrame:
    """key, length (terms with repeats), terms, counts of every row; of wanted terms only, if
    given."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, ends, terms, counts = [], [0], [], []
            for text in batch["text"]:
                found = terms_of(text.as_py())
                length.append(len(found))
                for term, n in Counter(found).items():
                    if wanted is None or term in wanted:
                        terms.append(term)
                        counts.append(n)
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.record_batch(
                [
                    batch[key], pa.array(length, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary()).cast(pa.string())),
                    pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
                ],
                [key, "length", "terms", "counts"],
            )

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInArrow(cut, f"`{key}` {kind}, length long, terms array<string>, counts array<long>")


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times for the distinct texts of each item."""
    each = postings(items.select("item_id", "text").distinct(), "item_id")
    rows = each.select("item_id", F.explode(F.arrays_zip("terms", "counts")).alias("p"))
    return rows.groupBy("item_id", F.col("p.terms").alias("term")).agg(F.sum("p.counts").alias("times"))


def weighted(terms: DataFrame, index: DataFrame) -> DataFrame:
    """item_id, term, factor: weight of the term times its repeats in the item. Terms that no
    document has are left out."""
    n_docs = index.where("length > 0").agg(F.count("*")).scalar()
    df = (
        index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    )
    weight = F.floor(1000 * F.ln((2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    return terms.join(df, "term").select("item_id", "term", (F.col("times") * weight).alias("factor"))


# ---------------------------------------------------------------- search within a shard
@dataclass
class Shard:
    """Postings of the terms of an item block, by term and then by document. Blocks of a term:
    places in the postings and the largest score part, at term * blocks + block."""

    n_docs: int
    blocks: int
    doc: np.ndarray
    part: np.ndarray
    starts: np.ndarray
    most: np.ndarray

    @staticmethod
    def of(length: np.ndarray, mean: tuple[int, int], doc: np.ndarray, term: np.ndarray, count: np.ndarray, n_terms: int) -> Shard:
        n, total = mean
        damp = 100 - 25 + (25 * length * n) // total
        part = (1_000_000_000 * count) // (1000 * count + 12 * damp[doc])
        order = np.lexsort((doc, term))
        doc, term, part = doc[order], term[order], part[order]
        blocks = -(-len(length) // BLOCK_DOCS)
        place = term.astype(np.int64) * blocks + doc // BLOCK_DOCS
        starts = np.searchsorted(place, np.arange(n_terms * blocks + 1))
        most = np.zeros(n_terms * blocks, np.int64)
        filled = np.flatnonzero(np.diff(starts))
        if len(filled):
            most[filled] = np.maximum.reduceat(part, starts[filled])
        return Shard(len(length), blocks, doc, part, starts, most)


def accumulated(shard: Shard, terms: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time: documents of these lists and their summed scores."""
    spans = [(shard.starts[t * shard.blocks], shard.starts[(t + 1) * shard.blocks]) for t in terms]
    docs = np.concatenate([shard.doc[a:b] for a, b in spans] or [shard.doc[:0]])
    scores = np.concatenate([shard.part[a:b] * f for (a, b), f in zip(spans, factors, strict=True)] or [shard.part[:0]])
    docs, at = np.unique(docs, return_inverse=True)
    sums = np.zeros(len(docs), np.int64)
    np.add.at(sums, at, scores)
    return docs, sums


def search(shard: Shard, terms: np.ndarray, factors: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (places in the shard, which are in rank order of their ids) and scores of the
    best, highest first."""
    size = shard.starts[(terms + 1) * shard.blocks] - shard.starts[terms * shard.blocks]
    short = size <= SHORT_SHARE * shard.n_docs
    acc_docs, acc_scores = accumulated(shard, terms[short], factors[short])
    terms, factors = terms[~short], factors[~short]
    edges = np.searchsorted(acc_docs, np.arange(shard.blocks + 1) * BLOCK_DOCS)
    best_docs, best_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for block in range(shard.blocks):
        floor = best_scores[-1] if len(best_scores) == top else 0
        at = terms * shard.blocks + block
        own = slice(edges[block], edges[block + 1])
        own_most = acc_scores[own].max(initial=0)
        bounds = np.append(shard.most[at] * factors, own_most)
        if bounds.sum() <= floor:
            continue
        docs, scores = _block(shard, at, factors, bounds, acc_docs[own], acc_scores[own], floor)
        if len(docs):
            docs, scores = np.concatenate([best_docs, docs]), np.concatenate([best_scores, scores])
            kept = np.lexsort((docs, -scores))[:top]
            best_docs, best_scores = docs[kept], scores[kept]
    return best_docs, best_scores


def _block(shard, at, factors, bounds, acc_docs, acc_scores, floor) -> tuple[np.ndarray, np.ndarray]:
    """Document at a time within a block: documents that score more than the floor. Only the
    lists whose bounds together exceed it bring in documents; the accumulators (the last
    bound) are such a list."""

    def listed(i: int) -> tuple[np.ndarray, np.ndarray]:
        if i == len(at):
            return acc_docs, acc_scores
        span = slice(shard.starts[at[i]], shard.starts[at[i] + 1])
        return shard.doc[span], shard.part[span] * factors[i]

    order = np.argsort(bounds, kind="stable")
    reach = np.cumsum(bounds[order])  # what the lists up to here can add
    probed = int(np.searchsorted(reach, floor, side="right"))
    docs, scores = zip(*[listed(i) for i in order[probed:]], strict=True)
    base, last = min(d[0] for d in docs if len(d)), max(d[-1] for d in docs if len(d))
    sums = np.zeros(last - base + 1, np.int64)
    for d, s in zip(docs, scores, strict=True):
        sums[d - base] += s
    found = np.flatnonzero(sums)
    sums = sums[found]
    found = found + base
    for i in range(probed - 1, -1, -1):
        can = sums + reach[i] > floor
        found, sums = found[can], sums[can]
        if not len(found):
            break
        d, s = listed(order[i])
        if len(d):
            place = np.searchsorted(d, found)
            place[place == len(d)] = 0
            sums = sums + np.where(d[place] == found, s[place], 0)
    better = sums > floor
    return found[better], sums[better]


# ---------------------------------------------------------------- all shards
@dataclass
class ItemBlock:
    """Items with their terms as numbers of a vocabulary."""

    items: list
    spans: np.ndarray
    terms: np.ndarray
    factors: np.ndarray
    vocabulary: pa.Array


def item_block(rows: list) -> ItemBlock:
    """From rows (item_id, terms, factors)."""
    words = sorted({t for r in rows for t in r["terms"]})
    number = {w: i for i, w in enumerate(words)}
    return ItemBlock(
        [r["item_id"] for r in rows],
        np.cumsum([0, *[len(r["terms"]) for r in rows]]),
        np.array([number[t] for r in rows for t in r["terms"]], np.int64),
        np.array([f for r in rows for f in r["factors"]], np.int64),
        pa.array(words, pa.string()),
    )


def in_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, docs, size = [], 0, 0
    for batch in batches:
        ends = np.asarray(pc.list_value_length(batch["terms"]).fill_null(0)).cumsum()
        begin = 0
        while begin < len(batch):
            room = SHARD_POSTINGS - size + (ends[begin - 1] if begin else 0)
            end = min(begin + SHARD_DOCS - docs, max(int(np.searchsorted(ends, room, side="right")), begin + (not held)))
            if end > begin:
                held.append(batch.slice(begin, end - begin))
                docs += end - begin
                size += int(ends[end - 1] - (ends[begin - 1] if begin else 0))
            if end < len(batch) or docs == SHARD_DOCS:
                yield pa.Table.from_batches(held)
                held, docs, size = [], 0, 0
            begin = end
    if held:
        yield pa.Table.from_batches(held)


def best_of_shards(index: DataFrame, block: ItemBlock, item_kind: str, mean: tuple[int, int], top: int) -> DataFrame:
    """item_id, doc_id, score: the best of each shard for each item of the block."""
    sent = index.sparkSession.sparkContext.broadcast(block)
    doc_kind = index.schema["doc_id"].dataType.simpleString()
    item_type = pa.string() if item_kind == "string" else pa.int64()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for shard in in_shards(batches):
            shard = shard.take(pc.sort_indices(shard["doc_id"])).combine_chunks()
            lists = shard["terms"].combine_chunks()
            sizes = np.asarray(pc.list_value_length(lists))
            number = pc.index_in(lists.flatten(), value_set=items.vocabulary)
            known = np.asarray(number.is_valid())
            built = Shard.of(
                np.asarray(shard["length"]), mean, np.repeat(np.arange(len(sizes)), sizes)[known],
                np.asarray(number.drop_null()).astype(np.int64),
                np.asarray(shard["counts"].combine_chunks().flatten())[known], len(items.vocabulary),
            )
            at, docs, scores = [], [], []
            for i, (a, b) in enumerate(zip(items.spans[:-1], items.spans[1:], strict=True)):
                d, s = search(built, items.terms[a:b], items.factors[a:b], top)
                at += [items.items[i]] * len(d)
                docs.append(d)
                scores.append(s)
            found = pa.array(np.concatenate(docs))
            yield pa.record_batch(
                [pa.array(at, item_type), shard["doc_id"].combine_chunks().take(found), pa.array(np.concatenate(scores))],
                ["item_id", "doc_id", "score"],
            )

    return index.mapInArrow(find, f"item_id {item_kind}, doc_id {doc_kind}, score long")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of the best documents of every item."""
    spark = docs.sparkSession
    terms = staged(item_terms(items))
    kind = items.schema["item_id"].dataType.simpleString()
    kind = kind if kind == "string" else "bigint"
    words = terms.select("term").distinct().limit(VOCABULARY + 1)
    known = [r["term"].encode() for r in words.toLocalIterator()]
    wanted = frozenset(known) if len(known) <= VOCABULARY else None
    index = staged(postings(docs, "doc_id", wanted).where("length > 0"))
    factors = staged(weighted(terms, index))
    mean = index.agg(F.count("*"), F.sum("length")).first()
    blocks = max(1, -(-factors.count() // ITEM_TERMS))
    doc_kind = index.schema["doc_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {kind}, doc_id {doc_kind}, score long")
    in_block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    for number in range(blocks):
        own = factors.where(in_block == number).groupBy("item_id")
        rows = own.agg(F.collect_list("term").alias("terms"), F.collect_list("factor").alias("factors")).collect()
        if rows:
            found = found.unionByName(best_of_shards(index, item_block(rows), kind, tuple(mean), top))
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")
