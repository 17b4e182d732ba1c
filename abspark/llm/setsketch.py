"""Near-duplicates by SetSketch.

A document's set holds the hashes of its distinct shingles (all tokens as one if it has
fewer): SHINGLE tokens, or as many as the caller names. Documents with equal sets are one
node. A node's sketch has M registers K = floor(1 - log_b(h / rate)) over the smallest
exponential variate h of each register: the variates are spaced exponentially and truncated,
so sketches merge by the larger register and equal registers tell similarity. Bands of ROWS
registers put nodes into buckets.

Candidates of a bucket are checked, first by the maximum-likelihood similarity of the two
sketches (given the set sizes, which are known), then on the full sets:
 1. all pairs of a small bucket; in a large one every node against its centre, the node that
    shares most buckets, so that a group of near copies costs one check per copy;
 2. in large buckets that then still hold nodes of several components, pairs of different
    components that share a shingle in the prefix of the rarest shingles (a necessary
    condition for the similarity, with the positional bound), so no link is lost there.

A pair at the similarity threshold meets in no bucket with probability 5e-8.

Nulls, repeats: a null, empty or blank text has an empty set and is linked with nothing
(component = its doc_id); rows that repeat a doc_id are documents of their own; a component
is named by its smallest doc_id that is not null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abspark.llm.common import bounded, row_key, small_batches, staged
from abspark.llm.graph import components
from abspark.llm.hashing import mixed, shingle_sets

SHINGLE = 4  # tokens, by the contract of op10
PERCENT = 80
REGISTERS, ROWS = 128, 4
LOG_BASE, RATE = 1.02, 20.0
SMALL = 24  # buckets up to this size are compared pair by pair
MARGIN = 0.22  # estimates this far (6 standard errors) below the threshold are not verified
UNPACKED = 100_000  # shingles a task unpacks at a time (one more set may exceed it)
WANTED_BROADCAST = 300_000  # keys of documents to reread; more are joined by shuffle

_RANDOM = np.random.Generator(np.random.PCG64(77))
FACTORS = _RANDOM.integers(0, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1)
SHIFTS = _RANDOM.integers(0, 2**32, REGISTERS, dtype=np.uint32)


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of hashes."""
    low = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for at in range(0, len(shingles), 4096):
        part = (mixed(shingles[at : at + 4096]) >> np.uint64(32)).astype(np.uint32)
        rows = part[:, None] * FACTORS + SHIFTS
        np.minimum(low, ((rows ^ (rows >> np.uint32(15))) * np.uint32(0x2C1B3C6D)).min(axis=0), out=low)
    h = -np.log1p(-(low.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(LOG_BASE)), 0, 2**16 - 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


def likely_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of rows of sketches, given the set sizes. The
    chance that one register is larger is p(u - v J), with p(x) = -log_b(1 - x (b - 1) / b)
    and u, v the shares of the two sizes."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - above - below
    u = (size_a / (size_a + size_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (LOG_BASE - 1) / LOG_BASE) / np.log(LOG_BASE)
    up, down = p(u - v * grid), p(v - u * grid)
    tiny = 1e-12
    score = (
        above[:, None] * np.log(up + tiny) + below[:, None] * np.log(down + tiny)
        + equal[:, None] * np.log(np.maximum(1 - up - down, tiny))
    )
    return grid[np.arange(len(grid)), score.argmax(1)]


def node_name(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    pair = np.array([shingles.sum(dtype=np.uint64), mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)])
    return mixed(pair + np.uint64(len(shingles))).tobytes()


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, part, n_shingles, node, bands of each row."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets(batch["text"].tolist(), shingle)
            bands = []
            for s in sets:
                r = registers(s).reshape(-1, ROWS).astype(np.uint64) if len(s) else np.zeros((0, ROWS), np.uint64)
                key = r[:, 0]
                for j in range(1, ROWS):
                    key = key * np.uint64(65536) + r[:, j]
                number = np.arange(len(r), dtype=np.uint64)
                bands.append(mixed(mixed(key) + number).astype(np.int64))
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "part": batch["part"],
                "n_shingles": pd.array([len(s) for s in sets], "int64"),
                "node": [node_name(s) if len(s) else None for s in sets], "bands": bands,
            })

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("text")).alias("part"), "text")
    return narrow.mapInPandas(sketch, "doc_id long, part long, n_shingles long, node binary, bands array<bigint>")


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """node, size, sketch, shingles of the documents with the wanted keys (doc_id, part)."""

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets(batch["text"].tolist(), shingle)
            yield pd.DataFrame({
                "node": [node_name(s) for s in sets], "size": pd.array([len(s) for s in sets], "int64"),
                "sketch": [registers(s).tobytes() for s in sets], "shingles": [s.tobytes() for s in sets],
            })

    keys = bounded(wanted.select(F.col("doc_id").alias("of"), F.col("part").alias("of_part")), WANTED_BROADCAST)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("text")).alias("part"), "text")
    match = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))
    found = narrow.join(keys, match, "left_semi").select("text")
    sets = found.mapInPandas(rebuild, "node binary, size long, sketch binary, shingles binary")
    return staged(sets)


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sketches leave the threshold possible."""

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b"))
                near = likely_similarity(a, b, batch["size_a"].to_numpy(float), batch["size_b"].to_numpy(float))
                yield batch.loc[near >= PERCENT / 100 - MARGIN, ["a", "b"]]

    side = lambda c: sets.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    fits = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * PERCENT
    return both.where(fits).mapInPandas(estimate, "a binary, b binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch["set_a"], batch["set_b"], strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep[i] = 100 * common >= PERCENT * (len(x) + len(y) - common)
            yield batch.loc[keep, ["a", "b"]]

    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}"))
    return likely(pairs, sets).join(side("a"), "a").join(side("b"), "b").mapInPandas(check, "a binary, b binary")


def buckets(nodes: DataFrame) -> DataFrame:
    """node, band, members, popularity: rows of buckets with at least two nodes; the
    popularity of a node counts all it meets."""
    rows = nodes.select("node", F.explode("bands").alias("band"))
    sizes = rows.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    rows = staged(rows.join(sizes, "band"))
    popular = rows.groupBy("node").agg(F.sum("members").alias("popularity"))
    return staged(rows.join(popular, "node"))


def first_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of small buckets; pairs of node and centre of large ones."""
    small = rows.where(F.col("members") <= SMALL).groupBy("band").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    rest = F.slice("nodes", F.col("at") + 2, F.lit(SMALL))
    close = small.select("nodes", F.posexplode("nodes").alias("at", "a")).select("a", F.explode(rest).alias("b"))
    best = F.max(F.struct("popularity", "node")).alias("best")
    centres = rows.where(F.col("members") > SMALL).groupBy("band").agg(best).select("band", F.col("best.node").alias("a"))
    stars = rows.join(centres, "band").where("node <> a").select("a", F.col("node").alias("b"))
    ordered = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return staged(close.union(ordered).distinct())


def prefixes(members: DataFrame, sets: DataFrame) -> DataFrame:
    """node, label, size, shingle, holders, place, is_short: the prefixes of the sets of the
    members (node, label), in the order of the shingles' frequency."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["shingles"].str.len().to_numpy() // 8
            piece = np.cumsum(sizes) // UNPACKED
            for own in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(piece)) + 1):
                rows, n = batch.iloc[own], sizes[own]
                repeated = {c: rows[c].to_numpy().repeat(n) for c in ("node", "label")}
                values = np.frombuffer(b"".join(rows["shingles"]), np.int64)
                yield pd.DataFrame({**repeated, "size": n.repeat(n), "shingle": values})

    held = members.join(sets, "node").select("node", "label", "shingles")
    rows = staged(held.mapInPandas(unpack, "node binary, label binary, size long, shingle long"))
    shared = rows.groupBy("shingle").agg(F.count("*").alias("holders"), (F.min("label") != F.max("label")).alias("split"))
    order = Window.partitionBy("node").orderBy("holders", "shingle")
    placed = rows.join(shared, "shingle").withColumn("place", F.row_number().over(order))
    # Sets that are linked share a shingle of the short prefix of the smaller one and of the
    # long prefix of the larger one. Shingles many sets have come late in the order, so where
    # sets share a core and are not linked, the core lies beyond the short prefixes.
    prefix = lambda least: F.col("place") <= F.col("size") - least + 1
    long = prefix(F.ceil(F.col("size") * PERCENT / 100))
    short = prefix(F.ceil(2 * F.col("size") * PERCENT / (100 + PERCENT)))
    return staged(placed.where(long & F.col("split")).withColumn("is_short", short))


def prefix_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of members (node, label) of different label that may still be linked."""
    placed = prefixes(members, sets)
    side = lambda c: placed.select("shingle", "is_short", *[F.col(x).alias(f"{x}_{c}") for x in ("node", "label", "size", "place")])
    smaller, larger = side("a").where("is_short").drop("is_short"), side("b").drop("is_short")
    needed = F.ceil((F.col("size_a") + F.col("size_b")) * PERCENT / (100 + PERCENT))
    still = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) + 1
    in_turn = F.expr("size_a < size_b OR size_a = size_b AND node_a < node_b")
    fits = F.col("size_a") * 100 >= F.col("size_b") * PERCENT
    match = in_turn & fits & (F.col("label_a") != F.col("label_b")) & (still >= needed)
    met = smaller.join(larger, "shingle").where(match)
    return staged(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct())


def links(docs: DataFrame, nodes: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Verified links (a, b) between nodes that leave no two linked nodes unconnected."""
    rows = buckets(nodes)
    wanted = rows.select("node").distinct().join(nodes.select("node", "doc_id", "part"), "node")
    sets = full_sets(docs, wanted, shingle).dropDuplicates(["node"])
    found = staged(verified(first_pairs(rows), sets))
    labels = components(found)
    large = rows.where(F.col("members") > SMALL).select("node", "band").join(labels, "node", "left")
    large = large.withColumn("label", F.coalesce("label", "node"))
    split = large.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    open_nodes = staged(large.join(split, "band", "left_semi").select("node", "label").distinct())
    if open_nodes.isEmpty():
        return found
    return staged(found.union(verified(prefix_pairs(open_nodes, sets), sets)).distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, part, n_shingles, component_id, kept, group (null without a set) for each row."""
    small_batches(docs.sparkSession)
    rows = staged(sketches(docs, shingle))
    one = rows.where("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "part", "bands")).alias("one")
    )
    nodes = staged(one.select("node", "one.doc_id", "one.part", "one.bands"))
    labels = components(links(docs, nodes, shingle))
    named = nodes.select("node", "doc_id").join(labels, "node", "left")
    named = named.withColumn("label", F.coalesce("label", "node"))
    names = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_node = named.join(names, "label").select(F.col("node").alias("of"), F.col("label").alias("group"), "component_id")
    joined = rows.join(of_node, F.col("node") == F.col("of"), "left")
    # Without a set, or in a component without any id, a document stands for itself.
    component = F.coalesce("component_id", "doc_id")
    return joined.select(
        "doc_id", "part", "n_shingles", component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"), "group",
    )


def deduplicate(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component, that with the smallest doc_id; columns unchanged. Documents
    without a set stay; of rows that agree in doc_id and text one stays."""
    judged = staged(near_duplicates(docs, shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "part")).alias("first")
    best = judged.where(F.col("group").isNotNull()).groupBy("group").agg(first).select("first.doc_id", "first.part")
    kept = best.union(judged.where(F.col("group").isNull()).select("doc_id", "part"))
    kept = kept.select(F.col("doc_id").alias("of"), F.col("part").alias("of_part"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    match = F.col("row.doc_id").eqNullSafe(F.col("of")) & (row_key(F.col("row.text")) == F.col("of_part"))
    found = rows.join(kept, match, "left_semi").select("row.*")
    repeated = judged.groupBy("doc_id", "part").count().where("count > 1")
    return found if repeated.isEmpty() else found.dropDuplicates(["doc_id", "text"])
