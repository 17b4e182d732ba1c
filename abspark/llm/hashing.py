"""Vectorized hashing of texts in Arrow batches: tokens, n-grams of tokens, byte n-grams.

All hashes are 64-bit and depend on content only, so they agree between tasks and runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SEED = np.random.Generator(np.random.PCG64(20240501))
BYTE_CODE = _SEED.integers(1, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
GRAM_FACTORS = _SEED.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, each followed by a blank, and the starts of the texts
    (with the end as last one)."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return np.frombuffer(b" ".join([*parts, b""]), np.uint8), starts


def powers(of: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, of, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token (A-Z lower-cased, cut at white space), in order, and for each
    text the place of its first token (with the end as last one)."""
    data, starts = joined_bytes(texts)
    blank = SPACE[data]
    edge = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=1))
    first, last = edge[~blank[edge]], edge[blank[edge]]
    last = last[-len(first):] if len(first) else last[:0]
    code = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[LOWERED[data]] * powers(BASE, len(data)), out=code[1:])
    # Place-independent: divide by the power of the token's first byte.
    hashes = (code[last] - code[first]) * powers(BASE_INVERSE, len(data) + 1)[first]
    return mixed(hashes + (last - first).astype(np.uint64)), np.searchsorted(first, starts)


def gram_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n tokens from each place on (at places with so many)."""
    count = max(len(tokens) - n + 1, 0)
    total = np.zeros(count, np.uint64)
    for j in range(n):
        total += tokens[j : j + count] * GRAM_FACTORS[j]
    return mixed(total)


def in_pieces(texts: list[str | None], size: int = 1 << 18) -> Iterator[list[str | None]]:
    """Consecutive texts of about `size` characters together (one text at least), so that
    the arrays over a batch stay small."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        more = len(text or "")
        if i > begin and held + more > size:
            yield texts[begin:i]
            begin, held = i, 0
        held += more
    if begin < len(texts):
        yield texts[begin:]


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-token shingles of each text; of a text with fewer
    tokens, the hash of all of them; none without tokens."""
    return [s for piece in in_pieces(texts) for s in _shingle_sets(piece, n)]


def _shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    tokens, at = token_hashes(texts)
    grams = gram_hashes(tokens, n)
    sets = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= n:
            sets.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            whole = (tokens[a:b] * GRAM_FACTORS[: b - a]).sum(dtype=np.uint64)
            sets.append(mixed(np.array([whole + np.uint64(b - a)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
