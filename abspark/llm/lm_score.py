"""Language-model scores: bigrams with deleted interpolation.

P(w | v) = a2 c(v w) / c(v) + a1 c(w) / N + a0 / (V + 1), with the weights a chosen by the
frequency of the context v. The weights come from expectation-maximisation on held-out
counts: every token of the training texts is deleted from the counts in turn (one less of the
pair, the context, the token and the total). Tokens are words (A-Z lower-cased, cut at white
space) and one end per text; the context of a first token is the start of the text, which is
as frequent as the end.

Counts are over all training texts. Chunks of documents send their distinct tokens and pairs
with their counts to buckets of hashes; the buckets answer the totals; each document is then
written as the counts of its tokens and pairs, from which weights and scores are computed
without moving data again. A frequent token or pair is one entry per chunk. For the weights,
the deleted probabilities are summed over all tokens on a fixed grid of ratios.

A null or empty text is one end token; rows with a null doc_id count as training texts; rows
that repeat a doc_id are texts of their own; with no training text all counts are 0 and a0
is 1; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abspark.llm.common import row_key, staged
from abspark.llm.hashing import GRAM_FACTORS, mixed, token_hashes

CHUNK_BYTES = 16 << 20
PIECE_BYTES = 2 << 20
END, START = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
PAIR_BITS_DROPPED = np.uint64(16)  # pairs travel with 48 bits beside their bucket
STEPS = 4  # grid steps per factor of two
ROUNDS = 60
FOLDS, HELD_OUT = 7, 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def chunk_tokens(chunk: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts with their ends, context hashes, and the bounds of texts."""
    texts = chunk["text"].tolist()
    tokens, contexts, sizes = [], [], []
    begin, held = 0, 0
    for i in range(len(texts) + 1):
        more = len(texts[i] or "") if i < len(texts) else 0
        if i == len(texts) or held and held + more > PIECE_BYTES:
            words, at = token_hashes(texts[begin:i])
            count = np.diff(at) + 1
            ends = np.cumsum(count) - 1
            own = np.full(len(words) + len(count), END, np.uint64)
            is_word = np.ones(len(own), bool)
            is_word[ends] = False
            own[is_word] = words
            before = np.empty_like(own)
            before[1:] = own[:-1]
            before[ends - count + 1] = START
            tokens.append(own)
            contexts.append(before)
            sizes.append(count)
            begin, held = i, 0
        held += more
    return np.concatenate(tokens), np.concatenate(contexts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def distinct(chunk: pd.DataFrame, buckets: int):
    """Of tokens and of pairs: bucket, key within the bucket, and each occurrence's place."""
    tokens, contexts, bounds = chunk_tokens(chunk)
    pairs = mixed(contexts * GRAM_FACTORS[0] + tokens * GRAM_FACTORS[1])
    found = []
    for keys, dropped in ((tokens, np.uint64(0)), (pairs, PAIR_BITS_DROPPED)):
        values, inverse = np.unique(keys, return_inverse=True)
        found.append(((values % np.uint64(buckets)).astype(np.int64), values >> dropped, inverse))
    return found, bounds


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as their steps: the low halves as they are (they are random), the high
    halves, which are small, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    low, high = steps.astype(np.uint32).tobytes(), (steps >> np.uint64(32)).astype(np.uint32)
    planes = high.view(np.uint8).reshape(-1, 4).T  # equal bytes side by side
    return len(keys).to_bytes(8, "little") + low + zlib.compress(planes.tobytes(), 1)


def unpacked_keys(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    n = int.from_bytes(blob[:8], "little")
    low = np.frombuffer(blob, np.uint32, n, 8).astype(np.uint64)
    planes = np.frombuffer(zlib.decompress(blob[8 + 4 * n :]), np.uint8).reshape(4, n)
    high = np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.uint64)
    return np.cumsum(low + (high << np.uint64(32)), dtype=np.uint64)


def sender(buckets: int):
    def send(chunk: pd.DataFrame) -> pd.DataFrame:
        found, bounds = distinct(chunk, buckets)
        training = np.repeat(~chunk["held_out"].to_numpy(bool), np.diff(bounds))
        blobs: dict[int, list] = {}
        for kind, (bucket, key, inverse) in enumerate(found):
            counts = np.bincount(inverse, weights=training, minlength=len(key)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            numbers, at = np.unique(bucket[order], return_index=True)
            for number, own in zip(numbers.tolist(), np.split(order, at[1:]), strict=True):
                row = blobs.setdefault(number, [b"", b"", b"", b""])
                row[2 * kind] = packed_keys(key[own])
                row[2 * kind + 1] = zlib.compress(counts[own].tobytes(), 1)
        number = int(chunk["chunk"].iloc[0])
        return pd.DataFrame(
            [(b, number, *row) for b, row in blobs.items()],
            columns=["bucket", "chunk", "tokens", "token_counts", "pairs", "pair_counts"],
        )

    return send


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), np.int64) if blob else np.zeros(0, np.int64)


def totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The summed count of each key, as each sender asked, and of each distinct key."""
    values, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(values), np.int64)
    np.add.at(sums, inverse, np.concatenate(counts))
    return np.split(sums[inverse], np.cumsum([len(k) for k in keys])[:-1]), sums


def answer(sent: pd.DataFrame) -> pd.DataFrame:
    tokens, sums = totals([unpacked_keys(b) for b in sent["tokens"]], [unpacked(b) for b in sent["token_counts"]])
    pairs, _ = totals([unpacked_keys(b) for b in sent["pairs"]], [unpacked(b) for b in sent["pair_counts"]])
    pack = lambda x: zlib.compress(x.tobytes(), 1)
    out = pd.DataFrame({
        "chunk": sent["chunk"], "bucket": sent["bucket"],
        "token_counts": [pack(x) for x in tokens], "pair_counts": [pack(x) for x in pairs],
    })
    # The bucket's share of V and N goes to one of its chunks, so that it counts once.
    out["types"], out["words"] = 0, 0
    out.loc[out.index[0], ["types", "words"]] = [int((sums > 0).sum()), int(sums.sum())]
    return out


def counter(buckets: int):
    def count(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        found, bounds = distinct(chunk, buckets)
        by_number = {int(b): (t, p) for b, t, p in zip(answers["bucket"], answers["token_counts"], answers["pair_counts"], strict=True)}
        streams = []
        for kind, (bucket, key, inverse) in enumerate(found):
            counts = np.zeros(len(key), np.int64)
            order = np.argsort(bucket, kind="stable")
            numbers, at = np.unique(bucket[order], return_index=True)
            for number, own in zip(numbers.tolist(), np.split(order, at[1:]), strict=True):
                counts[own] = unpacked(by_number[number][kind])
            streams.append(counts[inverse])
        spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        out = chunk[["id", "known", "held_out"]].copy()
        out["counts"] = [zlib.compress(np.concatenate([s[a:b] for s in streams]).tobytes(), 1) for a, b in spans]
        out["types"], out["words"] = 0, 0
        out.iloc[0, out.columns.get_loc("types")] = int(answers["types"].sum())
        out.iloc[0, out.columns.get_loc("words")] = int(answers["words"].sum())
        return out

    return count


def counted(docs: DataFrame, held: Column, chunk_bytes: int) -> DataFrame:
    """Each row as the training counts of its tokens and pairs; types and words add up to V
    and N over the table."""
    whole = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = buckets = max(16, -(-whole // chunk_bytes))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNotNull().alias("known"),
        held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.select(F.pmod(F.xxhash64("id", row_key(F.col("text"))), F.lit(chunks)).alias("chunk"), "*")
    by_chunk = rows.groupBy("chunk")
    sent = by_chunk.applyInPandas(
        sender(buckets), "bucket long, chunk long, tokens binary, token_counts binary, pairs binary, pair_counts binary"
    )
    answers = sent.groupBy("bucket").applyInPandas(
        answer, "chunk long, bucket long, token_counts binary, pair_counts binary, types long, words long"
    )
    result = by_chunk.cogroup(answers.groupBy("chunk")).applyInPandas(
        counter(buckets), "id long, known boolean, held_out boolean, counts binary, types long, words long"
    )
    return staged(result)


def streams(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of tokens, pairs and contexts of a text; the start is as frequent as the end."""
    both = unpacked(blob)
    tokens, pairs = both[: len(both) // 2], both[len(both) // 2 :]
    return tokens, pairs, np.concatenate([tokens[-1:], tokens[:-1]])


def context_class(counts: np.ndarray) -> np.ndarray:
    """0 for none, then 1, 2-3, 4-7, ..."""
    size = np.zeros(len(counts), np.int64)
    some = counts > 0
    size[some] = np.floor(np.log2(counts[some])).astype(np.int64) + 1
    return size


@dataclass(frozen=True)
class Grid:
    """Classes of context frequency and steps of probabilities relative to the uniform one,
    as many as a corpus of so many words and types can have: both grow with the logarithm
    of its size, and nothing lies outside."""

    words: int
    types: int

    @property
    def classes(self) -> int:
        return max(self.words, 1).bit_length() + 1

    @property
    def lowest(self) -> int:
        """Step of the rarest word of all, or of a pair after the most frequent one."""
        return math.floor(math.log2((self.types + 1) / max(self.words, 1)) * STEPS)

    @property
    def size(self) -> int:
        """Steps up to certainty, and one for none."""
        return math.ceil(math.log2(self.types + 1) * STEPS) - self.lowest + 2

    def place(self, share: np.ndarray) -> np.ndarray:
        """Step of a probability relative to the uniform one; 0 for none."""
        place = np.zeros(len(share), np.int64)
        some = share > 0
        place[some] = np.rint(np.log2(share[some]) * STEPS).astype(np.int64) - self.lowest + 1
        return place

    def value(self, place: np.ndarray) -> np.ndarray:
        return np.where(place > 0, 2.0 ** ((place - 1 + self.lowest) / STEPS), 0.0)


def learn_weights(texts: DataFrame, words: int, types: int) -> np.ndarray:
    """Weights (class, [a2, a1, a0]) from the deleted counts of the training texts."""
    grid = Grid(words, types)
    contexts_held, size = grid.classes, grid.size

    def deleted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, int] = {}
        for batch in batches:
            cells = [np.zeros(0, np.int64)]
            for blob in batch["counts"]:
                tokens, pairs, contexts = streams(blob)
                contexts, pairs, tokens = contexts - 1, pairs - 1, tokens - 1
                cell = context_class(contexts) * size + grid.place(pairs / np.maximum(contexts, 1) * (types + 1))
                cells.append(cell * size + grid.place(tokens / max(words - 1, 1) * (types + 1)))
            values, counts = np.unique(np.concatenate(cells), return_counts=True)
            for v, n in zip(values.tolist(), counts.tolist(), strict=True):
                sums[v] = sums.get(v, 0) + n
        yield pd.DataFrame({"cell": pd.array(list(sums), "int64"), "n": pd.array(list(sums.values()), "int64")})

    training = texts.where("not held_out").select("counts")
    # The cells of the grid: a power of the logarithm of the corpus, some ten thousand.
    found = training.mapInPandas(deleted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = np.tile(np.array([0.4, 0.4, 0.2]), (contexts_held, 1))
    weights[0] = [0.0, 0.5, 0.5]
    if not len(found):
        return np.tile(np.array([0.0, 0.0, 1.0]), (contexts_held, 1))
    cell, n = found["cell"].to_numpy(), found["n"].to_numpy(float)
    of_class = cell // (size * size)
    parts = np.stack([grid.value(cell // size % size), grid.value(cell % size), np.ones(len(cell))], 1)
    seen = np.bincount(of_class, n, contexts_held)
    for _ in range(ROUNDS):
        share = parts * weights[of_class]
        share *= (n / share.sum(1))[:, None]
        new = np.stack([np.bincount(of_class, share[:, k], contexts_held) for k in range(3)], 1)
        # A little of the uniform part stays everywhere, so no text has probability 0.
        new = (new + np.array([0.0, 0.01, 0.01])) / (seen[:, None] + 0.02)
        weights = np.where(seen[:, None] > 0, new, weights)
    return weights / weights.sum(1, keepdims=True)


def score_texts(docs: DataFrame, held: Column | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.
    held marks the rows nothing is learned from."""
    texts = counted(docs, held_out(F.col("doc_id")) if held is None else held, chunk_bytes)
    types, words = texts.agg(F.sum("types"), F.sum("words")).first()
    types, words = types or 0, words or 0
    weights = learn_weights(texts, words, types)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for blob in batch["counts"]:
                tokens, pairs, contexts = streams(blob)
                a = weights[context_class(contexts)]
                p = a[:, 0] * pairs / np.maximum(contexts, 1) + a[:, 1] * tokens / max(words, 1) + a[:, 2] / (types + 1)
                base = np.log10(tokens + 1.0).sum() - len(tokens) * np.log10(words + types + 1.0)
                rows.append((len(tokens), int((tokens > 0).sum()), base, np.log10(p).sum()))
            out = pd.DataFrame(rows, columns=["n_tokens", "n_known", "base_score", "score"])
            yield pd.concat([batch[["id", "known", "held_out"]].reset_index(drop=True), out], axis=1)

    scored = texts.select("id", "known", "held_out", "counts").mapInPandas(
        score, "id long, known boolean, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        F.when(F.col("known"), F.col("id")).alias("doc_id"), "held_out", "n_tokens", "n_known",
        F.lit(words).cast("long").alias("train_tokens"), "base_score", "score",
    )
