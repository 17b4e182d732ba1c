"""Two-stage suffix sorting of a byte array, to a bounded depth, and common prefixes.

Stage one sorts only the suffixes that are smaller than their successors. Stage two scans
the buckets of first bytes in ascending order: the suffix before each scanned one goes to the
end of its own bucket if it is larger than its successor. A bucket is complete when its turn
comes, so each is scanned as a whole array."""

from __future__ import annotations

import numpy as np

WORD = 8


def packed(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one big-endian number (zeros beyond the end)."""
    padded = np.zeros(len(data) + WORD, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data),), ">u8", padded.tobytes(), 0, (1,)).astype(np.uint64)


def word_at(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    inside = places < len(words)
    return np.where(inside, words[np.minimum(places, len(words) - 1)], np.uint64(0))


def smaller_than_successor(data: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it: its run of equal bytes is
    followed by a larger byte. The end of the data is smaller than everything."""
    if not len(data):
        return np.zeros(0, bool)
    heads = np.flatnonzero(np.diff(data.astype(np.int16), prepend=-1))
    value = data[heads].astype(np.int16)
    follows = np.append(value[1:], -1)
    return np.repeat(value < follows, np.diff(np.append(heads, len(data))))


def sorted_directly(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their first `depth` bytes at least; each further word is only
    looked at where all before are equal."""
    order = places[np.argsort(word_at(words, places), kind="stable")]
    group = np.cumsum(np.append(0, np.diff(word_at(words, order)) != 0)) if len(order) else np.zeros(0, np.int64)
    for at in range(WORD, depth, WORD):
        alone = np.bincount(group, minlength=len(order))[group] == 1 if len(order) else np.zeros(0, bool)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        word = word_at(words, order[tied] + at)
        within = np.lexsort((word, group[tied]))
        order[tied] = order[tied][within]
        edge = np.zeros(len(order), bool)
        edge[1:] = group[1:] != group[:-1]
        word = word[within]
        differs = word[1:] != word[:-1]
        edge[tied[1:][differs]] = True
        group = np.cumsum(edge)
    return order


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in the order of their first `depth` bytes at least."""
    words, smaller = packed(data), smaller_than_successor(data)
    direct = sorted_directly(words, np.flatnonzero(smaller), depth)
    first = data[direct]
    bounds = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if len(data):
        waiting[data[-1]].append(np.array([len(data) - 1], np.int64))
    done = []
    for byte in range(256):
        fresh = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        parts = []
        while len(fresh):  # larger ones of the same byte follow those they precede in the data
            parts.append(fresh)
            before = fresh[fresh > 0] - 1
            fresh = before[data[before] == byte]
        bucket = np.concatenate([*parts, direct[bounds[byte] : bounds[byte + 1]]])
        done.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[data[before] > byte]
        if not len(before):
            continue
        goes = data[before]
        by_target = np.argsort(goes, kind="stable")
        targets, at = np.unique(goes[by_target], return_index=True)
        for target, own in zip(targets, np.split(before[by_target], at[1:]), strict=True):
            waiting[target].append(own)
    return np.concatenate(done) if done else np.zeros(0, np.int64)


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix in the order and the one before it, at
    most `depth`; 0 for the first."""
    words = packed(data)
    length = np.zeros(len(order), np.int64)
    going = np.arange(1, len(order))
    for at in range(0, depth, WORD):
        if not len(going):
            break
        left, right = order[going - 1] + at, order[going] + at
        differ = word_at(words, left) ^ word_at(words, right)
        equal = np.full(len(going), WORD, np.int64)
        some = differ != 0
        equal[some] = 7 - np.floor(np.log2(differ[some].astype(np.float64))).astype(np.int64) // 8
        equal[some] = np.where(differ[some] >= np.uint64(2**56), 0, equal[some])
        room = len(data) - np.maximum(left, right)
        length[going] = at + np.minimum(equal, np.maximum(room, 0))
        going = going[(equal == WORD) & (room >= WORD)]
    return np.minimum(length, depth)
