"""Removal of repeated passages with suffix arrays.

A byte goes if it lies in a string of SPAN bytes that also starts in a document with a
smaller doc_id. Every string of SPAN bytes has an anchor: the place of the smallest hash of
its GRAM-byte pieces. Strings are equal only if their anchors are, so the corpus is cut into
segments (an anchor with all strings that chose it) and solved by anchor:

 1. chunks of documents send the distinct hashes of their anchors to buckets of hashes; the
    buckets answer which hashes occur in more than one document, and which of them are hot
    (more than HOT places);
 2. chunks send the distinct segments of such anchors, each with its smallest and largest
    doc_id; a bucket sorts the suffixes of the differing segments of an anchor (two-stage),
    takes common prefixes of neighbours, and answers the smallest doc_id of every string.
    Strings of hot anchors are not kept together: each goes to a bucket by its own hash, and
    equal hashes give the smallest doc_id, so a hot anchor is spread over all buckets;
 3. chunks remove what a smaller document has.

A passage that occurs very often is one distinct segment per chunk, however many documents
hold it. All steps are one plan; the texts are shuffled once, by chunk.

A null or empty text has no bytes; a null doc_id is neither smaller nor larger than another,
so nothing is removed from such a row and it removes nothing; rows that repeat a doc_id do
not remove each other's bytes. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abspark.llm.common import row_key, small_batches
from abspark.llm.hashing import BASE, BASE_INVERSE, BYTE_CODE, mixed, powers
from abspark.llm.suffix_sort import common_prefixes, suffix_order

SPAN, GRAM = 50, 20
REACH = SPAN - GRAM + 1  # pieces in a string
CHUNK_BYTES = 8 << 20
HOT = 1 << 14  # places of an anchor beyond which its strings are dealt out one by one
SORTED_BYTES = 1 << 19  # of segments whose suffixes are sorted at a time
PIECE_BYTES = 1 << 18  # texts of a chunk are handled so many bytes at a time
SEGMENT = np.dtype([("key", "<u8"), ("anchor", "<u8"), ("low", "<i8"), ("high", "<i8"), ("size", "<u2")])
RUN = np.dtype([("key", "<u8"), ("doc", "<i8"), ("start", "u1"), ("length", "u1")])


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of `width` values."""
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


class Piece:
    """Some documents of a chunk: their bytes, anchors and segments."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, known: np.ndarray):
        self.ids, self.known = ids, known
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.place = np.zeros(0, np.int64)
        n = len(self.data)
        if n < SPAN:
            return
        padded = np.zeros(n + 8, np.uint8)
        padded[:n] = self.data
        words = np.ndarray((n,), "<u8", padded.tobytes(), 0, (1,))
        count = n - GRAM + 1
        grams = mixed(
            words[:count] * np.uint64(0xD6E8FEB86659FD93)
            + words[8 : 8 + count] * np.uint64(0xA0761D6478BD642F)
            + words[GRAM - 8 : GRAM - 8 + count] * np.uint64(0xE7037ED1A0B428DB)
        )
        rank = (grams >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        least = sliding(rank, REACH, np.minimum)
        # Strings that leave their document choose nothing; rows without an id neither.
        outside = np.zeros(len(least) + 1, np.int32)
        ends = self.starts[1:]
        for first, last in zip(np.maximum(ends - SPAN + 1, self.starts[:-1]), ends, strict=True):
            outside[min(first, len(least))] += 1
            outside[min(last, len(least))] -= 1
        for i in np.flatnonzero(~known):
            outside[min(self.starts[i], len(least))] += 1
            outside[min(self.starts[i + 1], len(least))] -= 1
        least[np.cumsum(outside[:-1]) > 0] = 0
        self.least = np.concatenate([np.zeros(REACH - 1, np.uint32), least, np.zeros(REACH - 1, np.uint32)])
        chosen = rank == sliding(self.least, REACH, np.maximum)
        self.place = np.flatnonzero(chosen)
        self.rank, self.anchor = rank[self.place], grams[self.place]

    def owners(self) -> np.ndarray:
        """doc_id of each anchor."""
        return self.ids[np.searchsorted(self.starts, self.place, "right") - 1]

    def cut(self, hot: np.ndarray, keep: np.ndarray | None = None) -> None:
        """Segments of the anchors (or those marked): start, number of strings, key. Each
        string of an anchor among the hot ones (sorted) is a segment of its own, once."""
        if keep is not None:
            self.place, self.rank, self.anchor = self.place[keep], self.rank[keep], self.anchor[keep]
        self.start = np.zeros(len(self.place), np.int64)
        self.strings = np.zeros(len(self.place), np.int64)
        for at in range(0, len(self.place), 1 << 16):
            own = slice(at, at + (1 << 16))
            back = self.place[own, None] - np.arange(REACH) + REACH - 1
            same = self.least[back] == self.rank[own, None]
            self.strings[own] = same.sum(1)
            self.start[own] = self.place[own] - same.argmax(1) - self.strings[own] + 1
        self.single = among(self.anchor, hot)
        if self.single.any():
            covered = np.zeros(len(self.data) + 1, np.int64)
            np.add.at(covered, self.start[self.single], 1)
            np.add.at(covered, (self.start + self.strings)[self.single], -1)
            alone, rest = np.flatnonzero(np.cumsum(covered) > 0), ~self.single
            self.single = np.repeat([False, True], [rest.sum(), len(alone)])
            self.start = np.concatenate([self.start[rest], alone])
            self.place = np.concatenate([self.place[rest], alone])
            self.anchor = np.concatenate([self.anchor[rest], np.zeros(len(alone), np.uint64)])
            self.strings = np.concatenate([self.strings[rest], np.ones(len(alone), np.int64)])
        size = self.strings + SPAN - 1
        code = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(BYTE_CODE[self.data] * powers(BASE, len(self.data)), out=code[1:])
        content = (code[self.start + size] - code[self.start]) * powers(BASE_INVERSE, len(self.data) + 1)[self.start]
        left = (self.place - self.start).astype(np.uint64)
        self.key = mixed(mixed(content + size.astype(np.uint64)) + self.anchor * np.uint64(3) + left)


def among(values: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted array."""
    if not len(ranked):
        return np.zeros(len(values), bool)
    return ranked[np.minimum(np.searchsorted(ranked, values), len(ranked) - 1)] == values


def hashes_of(blobs: pd.Series) -> np.ndarray:
    """Sorted distinct hashes of some answers."""
    return np.unique(np.frombuffer(b"".join(blobs), np.uint64))


def pieces(chunk: pd.DataFrame) -> Iterator[tuple[Piece, np.ndarray]]:
    """The documents of a chunk a piece at a time, with their rows. The order within the
    chunk does not matter to any step."""
    ids, known = chunk["id"].to_numpy(np.int64), chunk["known"].to_numpy(bool)
    begin, texts, held = 0, [], 0
    for i, text in enumerate(chunk["text"]):
        text = (text or "").encode("utf-8", "surrogatepass")
        if held and held + len(text) > PIECE_BYTES:
            yield Piece(texts, ids[begin:i], known[begin:i]), np.arange(begin, i)
            begin, texts, held = i, [], 0
        texts.append(text)
        held += len(text)
    if texts:
        yield Piece(texts, ids[begin:], known[begin:]), np.arange(begin, len(chunk))


def by_bucket(values: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Bucket numbers and the places of the values that belong to them."""
    of = (values % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    numbers, at = np.unique(of[order], return_index=True)
    yield from zip(numbers.tolist(), np.split(order, at[1:]) if len(numbers) else [], strict=True)


def anchor_sender(buckets: int):
    def send(chunk: pd.DataFrame) -> pd.DataFrame:
        hashes, owners = [], []
        for piece, _ in pieces(chunk):
            hashes.append(piece.anchor if len(piece.place) else np.zeros(0, np.uint64))
            owners.append(piece.owners() if len(piece.place) else np.zeros(0, np.int64))
        hashes, owners = np.concatenate(hashes), np.concatenate(owners)
        order = np.lexsort((owners, hashes))
        hashes, owners = hashes[order], owners[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(hashes)) - 1
        places = last - first + 1
        hashes, low, high = hashes[first], owners[first], owners[last] if len(first) else owners[:0]
        number = int(chunk["chunk"].iloc[0])
        rows = []
        for bucket, own in by_bucket(hashes, buckets):
            shared = np.packbits(low[own] != high[own]).tobytes()
            more = np.flatnonzero(places[own] > 1)
            counts = np.stack([more, places[own][more]]).astype(np.uint32).tobytes()
            rows.append((bucket, number, hashes[own].tobytes(), shared, counts))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "hashes", "shared", "counts"])

    return send


def shared_answerer(most: int):
    def answer_shared(sent: pd.DataFrame) -> pd.DataFrame:
        """To each chunk, the hashes it sent that occur in more than one document, and those
        of them with more than `most` places. Chunks hold whole documents, so a hash of two
        chunks is one of two documents (or of rows that repeat a doc_id, which the next step
        sorts out)."""
        parts = [np.frombuffer(h, np.uint64) for h in sent["hashes"]]
        flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=len(p)) for f, p in zip(sent["shared"], parts, strict=True)]
        sizes = [len(p) for p in parts]
        every, flag = np.concatenate(parts), np.concatenate(flags).astype(bool)
        ends = np.cumsum(sizes)
        places = np.ones(len(every), np.int64)
        for s, e, counts in zip(sizes, ends, sent["counts"], strict=True):
            at, count = np.frombuffer(counts, np.uint32).reshape(2, -1)
            places[e - s + at] = count
        order = np.argsort(every, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(every[order]) != 0)) if len(every) else np.zeros(0, np.int64)
        held = np.diff(np.append(first, len(every)))
        keep, hot = flag, np.zeros(len(every), bool)
        keep[order] |= np.repeat(held > 1, held)
        if len(every):
            hot[order] = np.repeat(np.add.reduceat(places[order], first) > most, held)
        hot &= keep
        cut = [slice(e - s, e) for s, e in zip(sizes, ends, strict=True)]
        return pd.DataFrame({
            "chunk": sent["chunk"], "answer": [every[c][keep[c]].tobytes() for c in cut],
            "hot": [every[c][hot[c]].tobytes() for c in cut],
        })

    return answer_shared


def segment_sender(buckets: int):
    def send(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "chunk", "heads", "body", "hot"]
        if not len(answers) or not len(chunk):
            return pd.DataFrame([], columns=columns)
        shared, hot = hashes_of(answers["answer"]), hashes_of(answers["hot"])
        found, bodies = [], {}
        for piece, _ in pieces(chunk):
            if not len(piece.place) or not len(shared):
                continue
            piece.cut(hot, among(piece.anchor, shared))
            owners = piece.owners()
            order = np.lexsort((owners, piece.key))
            if not len(order):
                continue
            first = np.flatnonzero(np.append(True, np.diff(piece.key[order]) != 0))
            last = np.append(first[1:], len(order)) - 1
            one = order[first]
            heads = np.zeros(len(one), SEGMENT)
            heads["key"], heads["anchor"] = piece.key[one], piece.anchor[one]
            heads["low"], heads["high"] = owners[order[first]], owners[order[last]]
            # A string alone is known by its hash: no bytes are sent, and its size is 0.
            heads["size"] = np.where(piece.single[one], 0, piece.strings[one] + SPAN - 1)
            data = piece.data.tobytes()
            for key, s, n in zip(heads["key"].tolist(), piece.start[one].tolist(), heads["size"].tolist(), strict=True):
                if key not in bodies:
                    bodies[key] = data[s : s + n]
            found.append(heads)
        if not found:
            return pd.DataFrame([], columns=columns)
        heads = np.concatenate(found)
        order = np.argsort(heads["key"], kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(heads["key"][order]) != 0))
        low = np.minimum.reduceat(heads["low"][order], first)
        high = np.maximum.reduceat(heads["high"][order], first)
        one = order[first]
        heads = heads[one]
        heads["low"], heads["high"] = low, high
        number = int(chunk["chunk"].iloc[0])
        of = np.where(heads["size"] == 0, heads["key"], heads["anchor"])
        # The first blob carries the hot anchors, which come back with its answer.
        rows = [
            (bucket, number, heads[own].tobytes(), zlib.compress(b"".join(map(bodies.__getitem__, heads["key"][own].tolist())), 1), b"" if k else hot.tobytes())
            for k, (bucket, own) in enumerate(by_bucket(of, buckets))
        ]
        return pd.DataFrame(rows, columns=columns)

    return send


def by_anchor(segments: np.ndarray, anchor: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """The segments some anchors at a time, about SORTED_BYTES together. Equal strings have
    equal anchors, so the parts know nothing of each other."""
    segments = segments[np.argsort(anchor[segments], kind="stable")]
    if not len(segments):
        return
    first = np.flatnonzero(np.diff(anchor[segments], prepend=-1))
    before = np.cumsum(size[segments].astype(np.int64)) - size[segments]
    part = np.repeat(before[first] // SORTED_BYTES, np.diff(np.append(first, len(segments))))
    yield from np.split(segments, np.flatnonzero(np.diff(part)) + 1)


def smallest_documents(heads: np.ndarray, bodies: list[bytes]) -> np.ndarray:
    """Runs (key, doc, start, length): for the strings of each distinct segment, in order,
    the smallest doc_id of any segment that holds the string."""
    strings = np.maximum(heads["size"].astype(np.int64) - SPAN + 1, 1)
    at = np.concatenate([[0], np.cumsum(strings)])
    doc = np.repeat(heads["low"], strings)
    _, of_anchor, held = np.unique(heads["anchor"], return_inverse=True, return_counts=True)
    differing = np.flatnonzero((held[of_anchor] > 1) & (heads["size"] > 0))
    for some in by_anchor(differing, of_anchor, heads["size"]):
        data = np.frombuffer(b"".join(bodies[i] for i in some), np.uint8)
        begins = np.concatenate([[0], np.cumsum(heads["size"][some].astype(np.int64))])[:-1]
        own = strings[some]
        within = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        place = np.repeat(begins, own) + within
        target = np.repeat(at[some], own) + within
        number = np.full(len(data), -1, np.int64)
        number[place] = target
        order = suffix_order(data, SPAN)
        order = order[number[order] >= 0]
        new = common_prefixes(data, order, SPAN) < SPAN
        first = np.flatnonzero(new)
        ranked = number[order]
        least = np.minimum.reduceat(doc[ranked], first)
        doc[ranked] = np.repeat(least, np.diff(np.append(first, len(ranked))))
    edge = np.zeros(len(doc), bool)
    edge[at[:-1]] = True
    edge[1:] |= doc[1:] != doc[:-1]
    begin = np.flatnonzero(edge)
    segment = np.searchsorted(at, begin, "right") - 1
    runs = np.zeros(len(begin), RUN)
    runs["key"], runs["doc"] = heads["key"][segment], doc[begin]
    runs["start"] = begin - at[segment]
    runs["length"] = np.append(begin[1:], len(doc)) - begin
    return runs


def answer_documents(sent: pd.DataFrame) -> pd.DataFrame:
    """To each chunk, the runs of its segments that a document before its last one has."""
    parts = [np.frombuffer(h, SEGMENT) for h in sent["heads"]]
    heads = np.concatenate(parts)
    bodies = []
    for part, body in zip(parts, sent["body"], strict=True):
        ends, body = np.cumsum(part["size"].astype(np.int64)).tolist(), zlib.decompress(body)
        bodies += [body[e - s : e] for s, e in zip(part["size"].tolist(), ends, strict=True)]
    order = np.argsort(heads["key"], kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(heads["key"][order]) != 0))
    one = order[first]
    distinct = heads[one]
    distinct["low"] = np.minimum.reduceat(heads["low"][order], first)
    runs = smallest_documents(distinct, [bodies[i] for i in one])
    answers = []
    for part in parts:
        begin, end = np.searchsorted(runs["key"], part["key"]), np.searchsorted(runs["key"], part["key"], "right")
        count = end - begin
        place = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        own = runs[place]
        answers.append(own[own["doc"] < np.repeat(part["high"], count)].tobytes())
    return pd.DataFrame({"chunk": sent["chunk"], "answer": answers, "hot": sent["hot"]})


def remover(with_text: bool):
    def remove(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        runs = np.frombuffer(b"".join(answers["answer"]), RUN) if len(answers) else np.zeros(0, RUN)
        runs = runs[np.argsort(runs["key"], kind="stable")]
        hot = hashes_of(answers["hot"]) if len(answers) else np.zeros(0, np.uint64)
        columns: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for piece, _ in pieces(chunk):
            marks = np.zeros(len(piece.data) + 1, np.int64)
            if len(piece.place) and len(runs):
                piece.cut(hot)
                begin, end = np.searchsorted(runs["key"], piece.key), np.searchsorted(runs["key"], piece.key, "right")
                count = end - begin
                own = runs[np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())]
                later = np.repeat(piece.owners(), count) > own["doc"]
                start = (np.repeat(piece.start, count) + own["start"])[later]
                np.add.at(marks, start, 1)
                np.add.at(marks, start + own["length"][later].astype(np.int64) - 1 + SPAN, -1)
            gone = np.cumsum(marks[:-1]) > 0
            for a, b in zip(piece.starts[:-1].tolist(), piece.starts[1:].tolist(), strict=True):
                out = gone[a:b]
                kept = piece.data[a:b][~out].tobytes()
                columns["n_bytes"].append(b - a)
                columns["n_removed"].append(int(out.sum()))
                columns["n_spans"].append(int((np.diff(out.astype(np.int8), prepend=0) == 1).sum()))
                columns["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                # A character that lost some of its bytes goes as a whole.
                columns["kept"].append(kept.decode("utf-8", "ignore") if with_text else None)
        out = pd.DataFrame(columns)
        out.insert(0, "others", chunk["others"].to_numpy())
        out.insert(0, "known", chunk["known"].to_numpy())
        out.insert(0, "id", chunk["id"].to_numpy())
        return out

    return remove


def remove_repeats(
    docs: DataFrame, with_text: bool = True, chunk_bytes: int = CHUNK_BYTES, others: Column | None = None, hot: int = HOT
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining text; null without
    with_text) for each row, and a text column of docs that is carried along."""
    small_batches(docs.sparkSession)
    whole = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = buckets = max(16, -(-whole // chunk_bytes))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNotNull().alias("known"),
        F.coalesce("text", F.lit("")).alias("text"), (F.lit(None) if others is None else others).cast("string").alias("others"),
    )
    chunk = F.pmod(F.xxhash64("id", row_key(F.col("text"))), F.lit(chunks))
    rows = rows.select(chunk.alias("chunk"), "id", "known", "text", "others")
    by_chunk = rows.groupBy("chunk")
    sent = by_chunk.applyInPandas(anchor_sender(buckets), "bucket long, chunk long, hashes binary, shared binary, counts binary")
    shared = sent.groupBy("bucket").applyInPandas(shared_answerer(hot), "chunk long, answer binary, hot binary")
    segments = by_chunk.cogroup(shared.groupBy("chunk")).applyInPandas(
        segment_sender(buckets), "bucket long, chunk long, heads binary, body binary, hot binary"
    )
    smallest = segments.groupBy("bucket").applyInPandas(answer_documents, "chunk long, answer binary, hot binary")
    result = by_chunk.cogroup(smallest.groupBy("chunk")).applyInPandas(
        remover(with_text),
        "id long, known boolean, others string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string",
    )
    return result.select(
        F.when(F.col("known"), F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "others"
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs with the repeated passages cut out of text (a character that lost
    some of its bytes goes as a whole) and n_chars counted anew where there is such a
    column; rows of which nothing is left go. Columns unchanged. The other columns travel
    with the text as JSON, so that the texts need no join with them."""
    names = [c for c in docs.columns if c != "text"]
    row = F.struct(F.col("text").isNull().alias("no_text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    kind = docs.select(row.alias("r")).schema["r"].dataType.simpleString()
    judged = remove_repeats(docs, others=F.to_json(row, {"ignoreNullFields": "false"}))
    judged = judged.where((F.col("n_removed") == 0) | (F.col("kept") != ""))
    judged = judged.select(F.from_json("others", kind).alias("r"), "n_removed", "kept")
    new = {"text": F.when(~F.col("r.no_text"), F.col("kept"))}
    if "n_chars" in names:
        counted = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("n_removed") == 0, F.col("r.row.n_chars")).otherwise(counted)
    return judged.select(*[new.get(c, F.col(f"r.row.`{c}`")).alias(c) for c in docs.columns])
