"""Token counts: an exact histogram of encoded lengths and what follows from it.

Documents are encoded in Arrow batches (the tokenizer's ranks travel with the task, so only
the driver needs the file) and aggregated by length at once. Running sums over the histogram
then answer totals, quantiles and truncated totals for every context limit.

A null text counts as an empty one, of length 0. An empty table gives an empty histogram.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abspark.llm.common import running_sum, staged

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level BPE vocabularies of this kind cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def token_lengths(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens for each row."""
    with open(tokenizer, "rb") as file:
        ranks = file.read()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder(ranks, pattern)
        for batch in batches:
            sizes = [len(model.encode_ordinary(t)) if t else 0 for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": pd.array(sizes, "int64")})

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return narrow.mapInPandas(encode, "doc_id long, n_tokens long")


def length_histogram(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """One row per length: n_tokens, docs and tokens of that length; docs_from and
    tokens_from, of at least it; quantile, the share of documents up to it;
    truncated_tokens, what is left of all documents when each is cut at it."""
    lengths = token_lengths(docs, tokenizer, pattern)
    counted = staged(lengths.groupBy("n_tokens").agg(F.count("*").alias("docs")))
    down = [F.col("n_tokens").desc()]
    summed = running_sum(counted, [], down, F.col("docs")).withColumnRenamed("upto", "docs_from")
    tokens = F.col("n_tokens") * F.col("docs")
    summed = running_sum(summed, [], down, tokens).withColumnRenamed("upto", "tokens_from")
    whole = counted.agg(F.sum("docs").alias("all_docs"), F.sum(tokens).alias("all_tokens"))
    longer = F.col("docs_from") - F.col("docs")
    return summed.join(F.broadcast(whole)).select(
        "n_tokens", "docs", tokens.alias("tokens"), "docs_from", "tokens_from",
        ((F.col("all_docs") - longer) / F.col("all_docs")).alias("quantile"),
        (
            F.col("all_tokens") - (F.col("tokens_from") - tokens) + longer * F.col("n_tokens")
        ).alias("truncated_tokens"),
    )


def quantile_length(histogram: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least that share of the documents do not exceed."""
    return histogram.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """Tokens that remain when each document is cut at any limit, also one no document has."""
    kept = F.col("docs") * F.least("n_tokens", F.lit(limit))
    return histogram.agg(F.coalesce(F.sum(kept), F.lit(0)).alias("tokens"))
