"""Approximate nearest neighbours by multi-index hashing.

* Codes: unit vectors are centred, projected and rotated so that taking signs loses little
  (the rotations are learned on a bounded sample); BITS signs are a vector's code.
* Index: a code is cut into PARTS substrings, and each is a key of its own table. Two codes
  within a Hamming radius r agree in some substring up to r // PARTS bits (pigeonhole; the
  first r % PARTS + 1 substrings up to that, the others one less), so looking up every key
  that near in each table finds every code within the radius.
* Keys are grouped by their first bits, as many as leave about GROUP codes in a group: a
  query is sent to the groups within its reach, and compares keys, then codes, there. Large
  groups and groups with many queries are dealt out as a grid of pieces, so that no task
  holds more than PIECE of either. A pair is reported by the first substring that finds it.
* A radius so wide that a query would be sent to more groups than there are pieces of codes is
  served by comparing the query with every code instead: pieces of the points meet blocks of
  such queries, each returns the nearest of the codes within the radius. So are few queries,
  for which dealing all codes PARTS times does not pay. Both ways find the same.
* Candidates are scored on their own vectors. The first radius is one that holds about
  EXPECTED codes, estimated from the sample. A second round takes, for a query, the radius
  within which a vector as near as its last result lies with the chance that SPREAD
  (standard deviations) gives; a query without enough results widens its radius further, up
  to all codes.

Equal vectors are one entry, kept with their smallest ids: more of them than there are
results cannot matter. A query's own row never is its result.

Results: vectors that are null, zero, or hold null or non-finite components take no part, nor
do rows without id or whose vector is not of the most frequent length (ties: the shorter).
Of rows that share an id the smallest vector counts. Fewer candidates than results: all. Empty
tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abspark.llm.common import staged

TOP = 5
BITS = 256
PARTS = 16  # substrings of a code, of BITS // PARTS bits
SAMPLE = 8_192  # vectors the rotations are learned from, at most
CALIBRATION = 768  # of these, compared with each other to relate angles and distances
EXPECTED = 100  # codes the first radius should hold
SPREAD = 1.7
GROUP = 4_096
PIECE = 16_384
FEW = 4_096  # queries for which no keys are dealt
GRID = 131_072  # groups whose numbers of pieces may be broadcast
SCAN_BYTES = 64 << 20  # of the vectors (as doubles) in a piece or block of the scan
STRETCH = 16_384  # codes compared, and pairs scored, at once
ROUNDS = 30  # of the rotation


# ---------------------------------------------------------------- codes
@dataclass
class Coder:
    """mean and projection (dimensions x bits) of unit vectors; distance(angle) is about
    slope * angle + offset with deviation spread; the sample's codes give first radii."""

    mean: np.ndarray
    projection: np.ndarray
    slope: float
    offset: float
    deviation: float
    sample: np.ndarray
    n: int

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Code of each vector as words of 64 bits."""
        signs = (units(vectors) - self.mean) @ self.projection > 0
        return np.packbits(signs, axis=1).view(np.uint64)

    def first_radius(self, codes: np.ndarray) -> np.ndarray:
        """Radius that holds about EXPECTED codes of all, by the sample (its nearest code
        where the sample is too thin to say)."""
        rank = min(len(self.sample) - 1, int(EXPECTED * len(self.sample) / max(self.n, 1)))
        out = [np.partition(hamming(self.sample, c), rank)[rank] for c in codes]
        return np.array(out, np.int64)

    def radius(self, score: np.ndarray) -> np.ndarray:
        """Distance that vectors of that cosine seldom exceed."""
        angle = np.arccos(np.clip(score, -1, 1))
        far = np.ceil(self.slope * angle + self.offset + SPREAD * self.deviation)
        return np.clip(far, 0, BITS).astype(np.int64)


def units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=-1, dtype=np.int64)


def learned(sample: np.ndarray, n: int, seed: int = 11) -> Coder:
    """Rotations that bring the centred sample close to its signs, one after another until
    there are bits enough, and how distance follows the angle between vectors."""
    rng = np.random.default_rng(seed)
    unit = units(sample)
    mean = unit.mean(axis=0)
    centred = unit - mean
    width = min(sample.shape[1], BITS)
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :width]
    narrow = centred @ axes
    rotations = []
    for _ in range(-(-BITS // width)):
        turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(ROUNDS):
            left, _, right = np.linalg.svd(narrow.T @ np.where(narrow @ turn > 0, 1.0, -1.0))
            turn = left @ right
        rotations.append(axes @ turn)
    coder = Coder(mean, np.hstack(rotations)[:, :BITS], 0.0, float(BITS), 0.0, np.zeros((0, BITS // 64), np.uint64), n)
    coder.sample = coder.codes(sample)
    few, codes = unit[:CALIBRATION], coder.sample[:CALIBRATION]
    x, y = np.triu_indices(len(few), 1)
    if len(x) > 100:
        angle = np.arccos(np.clip((few @ few.T)[x, y], -1, 1))
        distance = np.bitwise_count(codes[x] ^ codes[y]).sum(axis=1).astype(float)
        near = angle <= np.quantile(angle, 0.1)
        coder.slope, coder.offset = np.polyfit(angle[near], distance[near], 1)
        coder.deviation = float(np.std(distance[near] - coder.slope * angle[near] - coder.offset))
    return coder


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (floats as they are, else doubles) of the rows that take part, one for each id."""
    floats = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), True)
    kind = "array<float>" if floats else "array<double>"
    rows = vectors.select(F.col("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    rows = rows.where(F.exists("embedding", lambda x: x != 0))
    rows = staged(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    if not floats:
        # A square that leaves the range of doubles: such a vector is taken by its largest component.
        length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
        largest = F.array_max(F.transform("embedding", F.abs))
        shrunk = F.transform("embedding", lambda x: x / largest)
        rows = rows.withColumn("embedding", F.when(length.between(1e-200, 1e200), F.col("embedding")).otherwise(shrunk))
    sizes = rows.groupBy(F.size("embedding").alias("length")).count()
    usual = sizes.orderBy(F.col("count").desc(), "length").first()
    return rows.where(F.size("embedding") == (usual["length"] if usual else 0))


def distinct_vectors(rows: DataFrame, kept: int) -> DataFrame:
    """rep, embedding, members: each vector once, with its smallest ids. Ranks are limited in
    every task before the shuffle, so a vector that very many rows share is no hot group."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    first = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= kept)
    return first.groupBy("embedding").agg(
        F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("members")
    )


def learning_sample(points: DataFrame, n: int) -> np.ndarray:
    """Vectors of the SAMPLE smallest hashes among n points. Only hashes below a bound under which
    about that many lie are ordered, as each task sends the driver its first SAMPLE rows."""
    hashed = points.select("embedding", F.xxhash64(F.col("embedding").cast("array<double>")).alias("hash"))
    share = (SAMPLE + 6 * SAMPLE**0.5) / n
    while True:
        low = hashed if share >= 1 else hashed.where(F.col("hash") < int(share * 2**64) - 2**63)
        sample = low.orderBy("hash").limit(SAMPLE).select("embedding").toPandas()
        if share >= 1 or len(sample) == SAMPLE:
            return np.stack(sample["embedding"]).astype(float)
        share *= 2


def coded(rows: DataFrame, key: str, coder: Coder, with_radius: bool) -> DataFrame:
    """key, code, keys (of the substrings) and, for queries, the first radius and the vector."""
    sent = rows.sparkSession.sparkContext.broadcast(coder)
    kind = rows.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            if not len(batch):
                continue
            flat = batch["embedding"].flatten().to_numpy(zero_copy_only=False)
            codes = model.codes(flat.reshape(len(batch), -1).astype(float))
            keys = codes.view(np.uint8).reshape(len(batch), PARTS, -1)
            keys = sum(keys[..., i].astype(np.int64) << (8 * (keys.shape[2] - 1 - i)) for i in range(keys.shape[2]))
            radius = model.first_radius(codes) if with_radius else np.zeros(len(batch), np.int64)
            yield pa.record_batch(
                [batch[key], pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * PARTS, pa.array(keys.ravel())),
                 pa.array(radius), *[batch["embedding"]] * with_radius],
                [key, "code", "keys", "radius", *["embedding"] * with_radius],
            )

    vector = rows.schema["embedding"].dataType.simpleString()
    schema = f"{key} {kind}, code binary, keys array<long>, radius long" + f", embedding {vector}" * with_radius
    return rows.select(key, "embedding").mapInArrow(encode, schema)


# ---------------------------------------------------------------- lookups
def substring_radius(radius: Column, part: Column) -> Column:
    """Bits a substring may differ in (below 0: it need not be looked up)."""
    return F.floor(radius / PARTS) - F.when(part <= radius % PARTS, 0).otherwise(1)


def within(index: DataFrame, queries: DataFrame, group_bits: int) -> DataFrame:
    """query, rep: every code of the index within the radius of the query's."""
    shift = BITS // PARTS - group_bits
    grouped = lambda df: df.select("*", F.posexplode("keys").alias("part", "key")).withColumn(
        "group", F.shiftright("key", shift).cast("int")
    )
    stored = grouped(index).select("part", "group", "rep", "code")
    asked = grouped(queries).withColumn("reach", substring_radius(F.col("radius"), F.col("part")))
    groups = F.array(*[F.lit(g) for g in range(2**group_bits)]) if group_bits <= 4 else F.sequence(F.lit(0), F.lit(2**group_bits - 1))
    asked = asked.where("reach >= 0").withColumn("group", F.explode(F.filter(
        groups, lambda g: F.bit_count(g.bitwiseXOR(F.col("group"))) <= F.col("reach")
    ))).select("part", "group", "query", "code", "radius")
    # A grid of pieces: rows of either side meet each piece of the other once. It has a row for each
    # group at most; the sides hold a query in very many groups, so they are never broadcast.
    pieces = lambda df, name: df.groupBy("part", "group").agg(F.ceil(F.count("*") / PIECE).alias(name))
    grid = pieces(stored, "rows").join(pieces(asked, "columns"), ["part", "group"])
    beside = (lambda df: df.join(F.broadcast(grid), ["part", "group"])) if PARTS << group_bits <= GRID else (
        lambda df: df.hint("merge").join(grid, ["part", "group"])
    )
    dealt = lambda df, own, other, key: beside(df).withColumn(
        own[:-1], F.pmod(F.xxhash64(key), F.col(own))
    ).withColumn(other[:-1], F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
    stored = dealt(stored, "rows", "columns", "rep").select("part", "group", "row", "column", "rep", "code")
    asked = dealt(asked, "columns", "rows", "query").select("part", "group", "row", "column", "query", "code", "radius")
    kinds = index.schema["rep"].dataType.simpleString()

    def meet(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        """Codes of one piece of a group within the radius of the queries of one piece."""
        found = {"query": [], "rep": []}
        if len(here) and len(there):
            part = int(here["part"].iloc[0])
            codes = np.frombuffer(b"".join(here["code"]), np.uint64).reshape(len(here), -1)
            keys = codes.view(np.uint8).reshape(len(here), PARTS, -1)
            reps = here["rep"].to_numpy()
            for query, code, radius in zip(there["query"], there["code"], there["radius"], strict=True):
                own = np.frombuffer(code, np.uint8).reshape(PARTS, -1)
                reach = radius // PARTS - (np.arange(PARTS) > radius % PARTS)
                near = np.flatnonzero(np.bitwise_count(keys[:, part] ^ own[part]).sum(axis=1) <= reach[part])
                near = near[hamming(codes[near], own.reshape(-1).view(np.uint64)) <= radius]
                apart = np.bitwise_count(keys[near, :part] ^ own[:part]).sum(axis=2)
                near = near[~(apart <= reach[:part]).any(axis=1)]
                found["query"].append(np.full(len(near), query))
                found["rep"].append(reps[near])
        return pd.DataFrame({k: np.concatenate(v) if v else [] for k, v in found.items()})

    by = ["part", "group", "row", "column"]
    return stored.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(meet, f"query {kinds}, rep {kinds}")


# ---------------------------------------------------------------- the scan
def by_keys(n: int, group_bits: int) -> int:
    """Widest radius at which a query meets no more groups than there are pieces of n codes
    (below 0: none)."""
    ball = np.cumsum([math.comb(group_bits, bits) for bits in range(group_bits + 1)])
    for radius in range(BITS + 1):
        reach = radius // PARTS - (np.arange(PARTS) > radius % PARTS)
        if ball[np.minimum(reach[reach >= 0], group_bits)].sum() > n / PIECE:
            return radius - 1
    return BITS


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def stretches(codes: np.ndarray, code: np.ndarray, radius: int) -> np.ndarray:
    """Places of the codes (words x codes) within the radius of one."""
    out = []
    for start in range(0, codes.shape[1], STRETCH):
        part = codes[:, start : start + STRETCH]
        # Sums of 8 bits: BITS itself becomes 0 and is looked at again.
        apart = np.bitwise_count(part ^ code[:, None]).sum(axis=0, dtype=np.uint8)
        near = np.flatnonzero(apart <= np.uint8(min(radius, 255)))
        out.append(near[hamming(part[:, near].T, code) <= radius] + start)
    return np.concatenate(out)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair of rows, added up in the order and so with the rounding of cosine()."""
    a, b = np.ascontiguousarray(a.T, float), np.ascontiguousarray(b.T, float)
    product, norm_a, norm_b = np.zeros((3, a.shape[1]))
    for x, y in zip(a, b):
        product += x * y
        norm_a += x * x
        norm_b += y * y
    return product / (np.sqrt(norm_a) * np.sqrt(norm_b))


def scanned(points: DataFrame, queries: DataFrame, coder: Coder, n: int, kept: int) -> DataFrame:
    """query, rep, score: of the codes within the radius of the query's, the kept nearest of each
    piece of the points."""
    most, asking = max(SCAN_BYTES // (8 * len(coder.mean)), 1), queries.count()
    side = min(max(2 * asking, GROUP), most)
    rows, columns = -(-n // side), -(-asking // side)
    place = lambda key, count: F.pmod(F.xxhash64(key), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    stored = points.select("rep", "embedding", place("rep", rows).alias("row"), each(columns).alias("column"))
    asked = queries.select(
        "query", "code", "radius", "embedding", place("query", columns).alias("column"), each(rows).alias("row")
    )
    sent = points.sparkSession.sparkContext.broadcast(coder)
    kinds = points.schema["rep"].dataType.simpleString()

    def meet(here: pa.Table, there: pa.Table) -> pa.Table:
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        if len(here) and len(there):
            vectors, targets = matrix(here["embedding"]).astype(float), matrix(there["embedding"])
            codes = [sent.value.codes(vectors[i : i + GROUP]) for i in range(0, len(vectors), GROUP)]
            codes = np.ascontiguousarray(np.concatenate(codes).T)
            norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
            order = np.empty(len(here), int)
            order[pc.sort_indices(here["rep"]).to_numpy()] = np.arange(len(here))
            waiting, size = [], 0
            for query, (code, radius) in enumerate(zip(there["code"].to_pylist(), there["radius"].to_pylist())):
                near = stretches(codes, np.frombuffer(code, np.uint64), radius)
                if len(near) > kept:
                    target = targets[query].astype(float)
                    score = vectors[near] @ target / (norms[near] * np.linalg.norm(target))
                    near = near[score >= np.partition(score, -kept)[-kept] - 1e-9]
                waiting.append((query, near))
                size += len(near)
                if size >= STRETCH or query == len(there) - 1:
                    asks = np.repeat([q for q, _ in waiting], [len(x) for _, x in waiting])
                    near = np.concatenate([x for _, x in waiting])
                    score = cosines(targets[asks], vectors[near])
                    best = np.lexsort((order[near], -score, asks))
                    asks, near, score = asks[best], near[best], score[best]
                    top = np.arange(len(asks)) - np.searchsorted(asks, asks) < kept
                    found.append((asks[top], near[top], score[top]))
                    waiting, size = [], 0
        asks, near, score = (np.concatenate(x) for x in zip(*found))
        return pa.table({"query": there["query"].take(asks), "rep": here["rep"].take(near), "score": score})

    by = ["row", "column"]
    pairs = stored.groupBy(*by).cogroup(asked.groupBy(*by))
    return pairs.applyInArrow(meet, f"query {kinds}, rep {kinds}, score double")


def cosine(a: str, b: str) -> Column:
    a, b = (F.col(c).cast("array<double>") for c in (a, b))
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return product / (F.sqrt(norm(a)) * F.sqrt(norm(b)))


def scored(pairs: DataFrame, vectors: DataFrame, kept: int) -> DataFrame:
    """query, rank, vec_id, score: the nearest rows behind the candidates of each query vector."""
    own = vectors.select(F.col("rep").alias("query"), F.col("embedding").alias("asked"))
    each = pairs.join(vectors, "rep").join(own, "query").select(
        "query", "members", cosine("asked", "embedding").alias("score")
    )
    rows = each.select("query", "score", F.explode("members").alias("vec_id"))
    return ranked(rows, kept)


def members(pairs: DataFrame, vectors: DataFrame, kept: int) -> DataFrame:
    """query, rank, vec_id, score: the nearest rows behind scored candidates. A row's rep has no
    larger id, so it is among the kept nearest of those, too."""
    few = ranked(pairs.withColumnRenamed("rep", "vec_id"), kept).select("query", "score", F.col("vec_id").alias("rep"))
    rows = few.join(vectors.select("rep", "members"), "rep")
    return ranked(rows.select("query", "score", F.explode("members").alias("vec_id")), kept)


def ranked(rows: DataFrame, kept: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept)


def nearest(vectors: DataFrame, is_query: Column, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that is_query (over vec_id) picks."""
    kept = top + 1  # the query's own row is among them
    rows = usable(vectors)
    points = staged(distinct_vectors(rows, kept))
    asking = staged(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding").join(
        points.select("embedding", F.col("rep").alias("query")), "embedding"
    ).select("query_id", "query"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    result = f"query_id {kind}, rank int, vec_id {kind}, score double"
    n = points.count()
    if n == 0:
        return rows.sparkSession.createDataFrame([], result)
    coder = learned(learning_sample(points, n), n)
    index = None
    group_bits = int(np.clip(np.ceil(np.log2(n / GROUP)), 4, BITS // PARTS))
    reps = asking.select("query").distinct()
    todo = staged(coded(reps.join(points.withColumnRenamed("rep", "query"), "query"), "query", coder, True))
    best = None
    while not todo.isEmpty():
        widest, parts = by_keys(n, group_bits), []
        near, far = todo.where(F.col("radius") <= widest), todo.where(F.col("radius") > widest)
        if near.count() > FEW:
            index = index or staged(coded(points, "rep", coder, False))
            parts.append(scored(within(index, near, group_bits), points, kept))
        else:
            far = todo
        if not far.isEmpty():
            parts.append(members(scanned(points, far, coder, n, kept), points, kept))
        found = staged(reduce(DataFrame.unionByName, parts))
        worst = found.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("score"))
        wider = todo.join(worst, "query").withColumn("need", F.when(
            F.col("n") < kept, F.least(F.col("radius") + BITS // 8, F.lit(BITS))
        ).otherwise(radius_of(coder)(F.col("score"))))
        again = staged(wider.where("need > radius").select("query", "code", "keys", F.col("need").alias("radius"), "embedding"))
        done = found.join(again.select("query"), "query", "left_anti")
        best = done if best is None else best.unionByName(done)
        todo = again
    if best is None:
        return rows.sparkSession.createDataFrame([], result)
    mine = asking.join(best.drop("rank"), "query").where(F.col("vec_id") != F.col("query_id"))
    mine = ranked(mine.drop("query").withColumnRenamed("query_id", "query"), top)
    return mine.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")


def radius_of(coder: Coder):
    """Coder.radius as a column expression."""

    def radius(score: Column) -> Column:
        angle = F.acos(F.greatest(F.least(score, F.lit(1.0)), F.lit(-1.0)))
        far = F.ceil(F.lit(float(coder.slope)) * angle + float(coder.offset) + SPREAD * float(coder.deviation))
        return F.greatest(F.least(far, F.lit(BITS)), F.lit(0)).cast("long")

    return radius
