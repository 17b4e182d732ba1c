"""Operators on documents against brute force, over the awkward corpus."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from re import _parser as sre_parse

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from abspark.llm import decontaminate, license_scan, lm_score, mixing, setsketch, spotsigs, suffix_dedup, token_counts
from abspark.llm.suffix_sort import common_prefixes, suffix_order

WORD_BYTES = license_scan.WORD_BYTES


def words(text):
    return [w.decode() for w in (text or "").encode().translate(WORD_BYTES).split(b" ") if w]


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def test_memory_of_removal(make_docs, spark, monkeypatch):
    """Arrow batches are bounded by bytes, and no step's arrays grow with the whole chunk or
    bucket but for its hashes. Parts of any size give the same rows."""
    suffix_dedup.remove_repeats(make_docs([(1, "a", "s")]))
    long = spark.range(4_000, numPartitions=1).select(F.repeat(F.lit("x"), 8_000).alias("text"))
    sums = long.mapInPandas(lambda batches: (pd.DataFrame({"n": [b["text"].str.len().sum()]}) for b in batches), "n long")
    assert 1 < sums.count() and sums.agg(F.max("n")).first()[0] < 8 << 20

    rng = np.random.default_rng(3)
    common = "".join(map(chr, rng.integers(97, 123, 400_000)))
    texts = [common[i * 900 : i * 900 + 1_800] for i in range(440)] * 3
    texts = ["".join(t[k : k + 60] + chr(c) for k, c in zip(range(0, len(t), 60), rng.integers(97, 123, 30))) for t in texts]
    chunk = pd.DataFrame({"chunk": 0, "id": range(len(texts)), "known": True, "text": texts, "others": "{}"})

    def steps():
        shared = suffix_dedup.shared_answerer(100)(suffix_dedup.anchor_sender(16)(chunk).assign(bucket=0))
        sent = suffix_dedup.segment_sender(16)(chunk, shared)
        tracemalloc.start()
        answers = suffix_dedup.answer_documents(sent)
        answering = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        rows = suffix_dedup.remover(False)(chunk, answers)
        removing = tracemalloc.get_traced_memory()[1] - before
        tracemalloc.stop()
        return rows, answering, removing

    rows, answering, removing = steps()
    assert answering < 120e6 and removing < 35e6
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", 1 << 40)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 1 << 40)
    whole, more, _ = steps()
    assert rows["n_removed"].sum() > 0 and rows.equals(whole) and more > 2 * answering


def test_empty_tables(make_docs, spark):
    docs = make_docs([])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, bench).count() == 0
    assert suffix_dedup.remove_repeats(docs).count() == 0
    assert setsketch.near_duplicates(docs).count() == 0
    assert lm_score.score_texts(docs).count() == 0
    assert spotsigs.compare_edited(docs).count() == 0
    assert mixing.draw(docs).count() == 0
    assert license_scan.scan_licenses(docs).count() == 0
    assert token_counts.length_histogram(docs).count() == 0


# ---------------------------------------------------------------- decontamination
def test_decontamination(make_docs, corpus, spark):
    base = words(corpus[0][1])
    items = [(0, " ".join(base[20:45])), (1, "One"), (2, None), (3, ""), (4, "the of and"), (5, " ".join(base[20:45])),
             (6, corpus[6][1]), (7, " ".join(base[:9] + ["x"]))]
    rows = [*corpus, (3, "same id, other text one", "a"), (9, "one", "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        for s in range(len(w) - n + 1) if w else []:
            windows[tuple(w[s : s + n])].add(str(item))
    expected = Counter()
    for doc_id, text, _ in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                own = windows.get(tuple(w[s : s + n]))
                if own:
                    found |= own
                    hit.update(range(s, s + n))
        expected[(doc_id, len(w), len(hit), tuple(sorted(found)))] += 1
    got = decontaminate.decontaminate(make_docs(rows), bench).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == expected
    clean = decontaminate.clean(make_docs(rows), bench)
    assert clean.columns == make_docs([]).columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(k[0] for k, n in expected.items() if not k[2] for _ in range(n))


def test_long_enough_spans_share_a_fingerprint(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        span = [f"w{x}" for x in rng.integers(0, 30, 10)]
        left = [[f"w{x}" for x in rng.integers(0, 30, rng.integers(0, 20))] for _ in range(4)]
        rows.append((left[0] + span + left[1], left[2] + span + left[3]))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    df = decontaminate.with_prints(decontaminate.with_prints(df, "a", "x"), "b", "y")
    assert df.where(F.size(F.array_intersect("x", "y")) == 0).count() == 0


# ---------------------------------------------------------------- repeated passages
def removed(rows):
    """Per row: bytes, removed, runs and kept digest, by definition."""
    first = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        for s in range(len(data) - 49) if doc_id is not None else []:
            key = data[s : s + 50]
            first[key] = min(first.get(key, doc_id), doc_id)
    out = Counter()
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 49) if doc_id is not None else []:
            if first[data[s : s + 50]] < doc_id:
                gone[s : s + 50] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[(doc_id, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_repeated_passages(make_docs, corpus):
    rows = [(i, t, s) for i, t, s in corpus]
    rows += [(None, corpus[0][1], "a"), (30, corpus[6][1][500:2000], "a"), (30, corpus[6][1][500:2000], "a"), (3, "é" * 60, "b"), (99, "ab" + "é" * 60, "b")]
    docs = make_docs(rows)
    got = suffix_dedup.remove_repeats(docs, chunk_bytes=20_000)
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect())
    assert found == removed([r[:2] for r in rows])
    kept = suffix_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert len(texts) == len(rows) - sum(n for k, n in found.items() if k[1] and k[1] == k[2])


def hot_rows(count):
    """Documents that share 20 bytes (or 60) with differing text on both sides."""
    import random

    rng = random.Random(3)
    own = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    return [(3000 + i, own(40) + "!boilerplate piece!!" * (1 + 2 * (i % 2)) + own(40) + "a" * (i % 3 * 60), "h") for i in range(count)]


def test_hot_passages_by_definition(make_docs, corpus):
    rows = [*corpus, *hot_rows(60), *hot_rows(3), (None, corpus[0][1], "a"), (3, "é" * 60, "b"), (99, "ab" + "é" * 60, "b")]
    for most in (0, 1, 20):
        got = suffix_dedup.remove_repeats(make_docs(rows), chunk_bytes=5_000, hot=most)
        found = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect())
        assert found == removed([r[:2] for r in rows])


def test_hot_anchor_is_spread_over_buckets():
    rows = [r for r in hot_rows(4000) if len(r[1]) == 100]
    chunk = pd.DataFrame({"chunk": 0, "id": [r[0] for r in rows], "known": True, "text": [r[1] for r in rows]})
    shared = suffix_dedup.shared_answerer(100)(suffix_dedup.anchor_sender(16)(chunk).assign(bucket=0))
    sent = suffix_dedup.segment_sender(16)(chunk, shared)
    load = [len(h) + len(zlib.decompress(b)) for h, b in zip(sent["heads"], sent["body"])]
    assert len(load) == 16 and max(load) < 2 * sum(load) / 16


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_two_stage_sort(letters):
    rng = np.random.default_rng(letters)
    for _ in range(40):
        data = rng.integers(97, 97 + letters, int(rng.integers(0, 150))).astype(np.uint8)
        text = data.tobytes()
        order = suffix_order(data, 50)
        assert sorted(order.tolist()) == list(range(len(data)))
        keys = [text[i : i + 50] for i in order]
        assert keys == sorted(keys)
        for k, n in enumerate(common_prefixes(data, order, 50).tolist()):
            a, b = (text[order[k - 1] :][:50], text[order[k] :][:50]) if k else (b"", b"")
            assert n == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


# ---------------------------------------------------------------- near-duplicates
def shingles(text, n=4):
    w = tokens(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def components_of(rows, n=4):
    sets = [shingles(t, n) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = Counter()
    for group in groups.values():
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            out[(rows[i][0], len(sets[i]), min(ids, default=None))] += 1
    return out


def near_group(corpus, size):
    """Copies of a text with 0 to 9 words changed: links, chains and strangers in one bucket."""
    import random

    rng = random.Random(2)
    base = corpus[0][1].split()
    rows = []
    for i in range(size):
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = f"n{i}x{rng.randint(0, 9)}"
        rows.append((1000 + i, " ".join(own), "g"))
    return rows


def test_near_duplicates(make_docs, corpus):
    rows = [*corpus, *near_group(corpus, 150), (None, corpus[0][1], "a"), (None, "just a stranger with no id", "a"), (9, "one", "c")]
    docs = make_docs(rows)
    got = setsketch.near_duplicates(docs).collect()
    expected = components_of(rows)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected
    kept = setsketch.deduplicate(docs).collect()
    whole = {k[2] for k in expected if k[1] and k[2] is not None}
    ids = [r.doc_id for r in kept]
    assert sorted(i for i in ids if i is not None and shingles(dict((r[0], r[1]) for r in rows)[i])) == sorted(whole)
    assert ids.count(None) == 1


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 3000, dtype=np.uint64), rng.integers(0, 2**63, 1000, dtype=np.uint64)
    union = np.union1d(a, b)
    assert (setsketch.merged(setsketch.registers(a), setsketch.registers(b)) == setsketch.registers(union)).all()
    near = setsketch.likely_similarity(setsketch.registers(a)[None], setsketch.registers(union)[None], np.array([3000.0]), np.array([4000.0]))
    assert abs(near[0] - 0.75) < 0.15


# ---------------------------------------------------------------- language model
def test_language_model(make_docs, corpus):
    rows = [*corpus, (None, "one two", "a"), (2, "other text", "a")]
    trained = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    seq = lambda t: [*tokens(t), None]
    counts = Counter(x for i, t, _ in rows if trained(i) for x in seq(t))
    total, types = sum(counts.values()), len(counts)
    expected = sorted(
        (str(i), not trained(i), len(seq(t)), sum(counts[x] > 0 for x in seq(t)), total,
         round(sum(math.log10((counts[x] + 1) / (total + types + 1)) for x in seq(t)), 6))
        for i, t, _ in rows
    )
    got = lm_score.score_texts(make_docs(rows), chunk_bytes=4000).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_probabilities_add_up(make_docs):
    """For a context, the probabilities of all known tokens and the unknown one sum to 1."""
    rows = [(i, "a b a c a b d", "s") for i in range(8)]
    docs = make_docs(rows)
    texts = lm_score.counted(docs, F.lit(False), 1 << 20)
    types, words_ = texts.agg(F.sum("types"), F.sum("words")).first()
    weights = lm_score.learn_weights(texts, words_, types)
    pairs = {"b": 16, "c": 8}
    seen = {"a": 24, "b": 16, "c": 8, "d": 8, "end": 8}
    assert (types, words_) == (5, 64)
    w = weights[lm_score.context_class(np.array([24]))[0]]
    p = sum(w[0] * pairs.get(x, 0) / 24 + w[1] * n / 64 + w[2] / 6 for x, n in seen.items()) + w[2] / 6
    assert abs(p - 1) < 1e-9


# ---------------------------------------------------------------- fingerprints
def test_fingerprints(make_docs, corpus):
    rows = [r for r in corpus]
    got = {r.doc_id: r for r in spotsigs.compare_edited(make_docs(rows)).collect()}
    by_text = {}
    for k, (doc_id, text, _) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        r = got[doc_id]
        assert (r.n_chars, r.edited) == (len(text), edited)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(text, r.signatures) == r.signatures
    assert got[7].near_edited > 0.4 and got[1].near_next == 1.0 and got[7].near_next > 0.2


def test_fingerprint_classes(make_docs, corpus):
    rows = [*corpus, *near_group(corpus, 30)]
    members, links = spotsigs.near_classes(make_docs(rows), 0.8)
    sets = {r.doc_id: frozenset(r.signatures) for r in spotsigs.fingerprints(make_docs(rows)).collect()}
    of = {r.doc_id: r["class"] for r in members.collect()}
    expected = {
        tuple(sorted((of[a], of[b]))) for a in of for b in of
        if of[a] != of[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    }
    assert {tuple(sorted((r.a, r.b))) for r in links.collect()} == expected and expected


# ---------------------------------------------------------------- mixing
def test_mix(make_docs, corpus):
    rows = [*corpus, (7, corpus[6][1], "a")]
    docs = make_docs(rows)
    drawn = mixing.draw(docs).collect()
    assert sum(r.rows for r in drawn) == len(rows)
    whole = sum(len(tokens(t)) for _, t, _ in rows)
    targets = {r.source: (r.target, r.source_size) for r in drawn}
    assert abs(sum(t for t, _ in targets.values()) - whole) < 1e-6
    assert all(t <= 3 * n + 1e-9 for t, n in targets.values())
    for source, (target, _) in targets.items():
        own = [r for r in drawn if r.source == source]
        taken = sum(r.copies * r["size"] * r["rows"] for r in own)
        assert abs(taken - target) <= 2 * max(r["size"] * r["rows"] for r in own)
        assert all(0 <= r.copies <= 3 for r in own)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies * r.rows for r in drawn)
    assert sorted(mixed.collect(), key=repr) == sorted(mixing.mix(docs).collect(), key=repr)


# ---------------------------------------------------------------- license scan
def test_license_scan(make_docs, corpus):
    rows = [*corpus, (90, "Released under the MIT License. mit license, Apache License; CC BY cc by-SA 4.0", "a"),
            (91, "GNU General Public License gnu general public license", "a")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(make_docs(rows)).collect()}
    for doc_id, text, _ in rows:
        w = words(text)
        at = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        r = got[doc_id]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "cc-by-sa-4.0" in got[90].labels.split(",")


def written_out(parsed):
    """Texts a parsed pattern matches: every alternative, each optional part with and without."""
    texts = [""]
    for op, value in parsed:
        if op is sre_parse.LITERAL:
            some = [chr(value)]
        elif op is sre_parse.IN:
            some = [chr(v) for kind, v in value if kind is sre_parse.LITERAL]
        elif op is sre_parse.ANY:
            some = ["x"]
        elif op is sre_parse.BRANCH:
            some = [t for branch in value[1] for t in written_out(branch)]
        elif op is sre_parse.SUBPATTERN:
            some = written_out(value[3])
        else:
            assert op in (sre_parse.MAX_REPEAT, sre_parse.MIN_REPEAT)
            once = written_out(value[2])
            some = once if value[0] else ["", *once]
        texts = [t + s for t in texts for s in some]
    return texts


def test_every_way_to_write_a_rule_passes_its_gate():
    for rule in license_scan.all_rules():
        pattern = re.compile(rf"(?<= )(?:{rule.pattern})(?= )")
        for text in written_out(sre_parse.parse(rule.pattern)):
            norm = f" {text} "
            assert pattern.search(norm), (rule.name, text)
            assert any(k in norm for k in rule.keywords), (rule.name, text)
    for text, rule in (("Released under the MIT License.", "mit-grant"), ("the MIT Licence", "mit-name"), ("Creative Commons Zero", "cc0-text")):
        assert rule in license_scan.scan_text(text)[-1].split(",")


@pytest.mark.parametrize("text, label", [
    ("BSD 3-Clause License", "bsd-3-clause"), ("under the BSD-2-Clause", "bsd-2-clause"),
    ("SPDX-License-Identifier: MIT", "mit"), ("// SPDX-License-Identifier: ISC", "isc"),
    ("SPDX-License-Identifier: Zlib", "zlib"), ("SPDX-License-Identifier: Unlicense", "unlicense"),
    ("SPDX-License-Identifier: Ruby", "ruby"), ("SPDX-License-Identifier: BUSL-1.1", "busl-1.1"),
    ("license: Apache-2.0", "apache-2.0"), ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation", "gpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "epl"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License.", "apache-2.0"),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "ofl"),
    ("Redistributions of source code must retain the above copyright notice", "bsd-2-clause"),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights", "cc0-1.0"),
])
def test_real_headers_are_found(text, label):
    assert label in license_scan.scan_text(text)[5].split(",")


def test_scan_agrees_with_trying_every_rule():
    """Labels, score and rules without gates and with containment by definition."""
    rng = np.random.default_rng(2)
    said = ["MIT License", "SPDX-License-Identifier: GPL-3.0-only", "the GNU GPL v3", "Apache License 2.0", "all rights reserved",
            "BSD 3-Clause", "creative commons attribution share alike 4.0", "CC BY", "word", "license", "Apache-2.0", "public domain",
            "released under the Mozilla Public License 2.0", "free software", "gnu general public license version 2"]
    rules = license_scan.all_rules()
    for _ in range(150):
        text = " ".join(said[i] for i in rng.integers(0, len(said), rng.integers(0, 12)))
        norm, _ = license_scan.normalized(text)
        every = [(m.start(), m.end(), r) for r in rules for m in re.finditer(rf"(?<= )(?:{r.pattern})(?= )", norm)]
        every.sort(key=lambda d: (d[2].priority, d[0] - d[1], d[0], d[2].name))
        kept = []
        for d in every:
            if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
                kept.append(d)
        base = {label for phrase, label in license_scan.BASE.items() if f" {phrase} " in norm}
        miss = math.prod(1 - r.confidence for _, _, r in kept)
        got = license_scan.scan_text(text)
        assert got[5] == ",".join(sorted(base | {r.label for _, _, r in kept}))
        assert abs(got[6] - (1 - (min(miss, 0.25) if base else miss))) < 1e-12
        assert got[7] == ",".join(sorted({r.name for _, _, r in kept}))


def test_rules_suppress_contained_ones():
    found = {r.name for _, _, r in license_scan.detections(license_scan.normalized("under the GNU Lesser General Public License version 2.1")[0])}
    assert found == {"lgpl-2.1-name"}
    assert len(license_scan.all_rules()) >= 200


# ---------------------------------------------------------------- token counts
def test_token_histogram(make_docs, corpus):
    docs = make_docs(corpus)
    lengths = sorted(r.n_tokens for r in token_counts.token_lengths(docs).collect())
    rows = token_counts.length_histogram(docs).collect()
    assert [r.n_tokens for r in sorted(rows)] == sorted(set(lengths))
    for r in rows:
        assert r.docs == lengths.count(r.n_tokens)
        assert r.docs_from == sum(n >= r.n_tokens for n in lengths)
        assert r.tokens_from == sum(n for n in lengths if n >= r.n_tokens)
        assert r.truncated_tokens == sum(min(n, r.n_tokens) for n in lengths)
        assert abs(r.quantile - sum(n <= r.n_tokens for n in lengths) / len(lengths)) < 1e-12
    histogram = token_counts.length_histogram(docs)
    assert token_counts.truncated_total(histogram, 17).first()[0] == sum(min(n, 17) for n in lengths)
    assert token_counts.quantile_length(histogram, 0.5).first()[0] == lengths[math.ceil(len(lengths) / 2) - 1]


def test_shared_cores_meet_in_no_prefix(spark, make_docs):
    """Texts of 400 common and 80 own words are no near copies: the common shingles are in
    no short prefix, so nothing is joined on them; a near copy among them is found."""
    core = [f"c{i}" for i in range(400)]
    own = lambda d: [f"w{d}x{i}" for i in range(80)]
    rows = [(d, " ".join(core + own(d)), "s") for d in range(60)]
    rows.append((60, " ".join(core + own(7)[:70] + own(60)[:10]), "s"))
    docs = make_docs(rows)
    sketched = setsketch.sketches(docs).select("node", F.col("node").alias("label"))
    sets = setsketch.full_sets(docs, setsketch.sketches(docs).select("doc_id", "part"))
    placed = setsketch.prefixes(sketched, sets)
    assert placed.where("is_short AND holders > 2").isEmpty()
    judged = {r.doc_id: r.component_id for r in setsketch.near_duplicates(docs).collect()}
    assert judged == {**{d: d for d in range(60)}, 60: 7}


@pytest.mark.parametrize("words, types", [(0, 0), (1, 1), (10, 3), (5_000, 5_000), (10**15, 10**4), (10**14, 10**13)])
def test_grid_holds_all_probabilities(words, types):
    """Rarest and most frequent words and contexts of corpora of any size have steps of their own."""
    grid = lm_score.Grid(words, types)
    counts = np.minimum([1, 2, max(words // 2, 1), max(words, 1)], max(words, 1))
    counts.sort()
    share = counts / max(words, 1) * (types + 1)
    place = grid.place(share)
    assert (place >= 1).all() and (place < grid.size).all() and (np.diff(place) >= 0).all()
    assert np.allclose(np.log2(grid.value(place) / share), 0, atol=0.51 / lm_score.STEPS)
    assert lm_score.context_class(counts).max() < grid.classes <= words.bit_length() + 2


def test_a_window_in_very_many_items(spark, make_docs):
    """A template shared by all items: every document that holds it names them all."""
    template = [f"t{i}" for i in range(12)]
    n = 20_000
    bench = spark.range(n).select(F.col("id").alias("item_id"), F.concat(F.lit(" ".join(template) + " own"), "id").alias("text"))
    docs = make_docs([(1, "x " + " ".join(template) + " y", "s"), (2, " ".join(template[:9]), "s"), (3, " ".join(template), "s")])
    got = {r.doc_id: (r.n_hit, len(r["items"])) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {1: (12, n), 2: (0, 0), 3: (12, n)}


def test_targets_of_very_many_sources(spark):
    """Targets over 5,000 sources, against filling them up by hand."""
    rng = np.random.default_rng(9)
    sizes = [(f"site{i:05d}", int(n)) for i, n in enumerate(rng.integers(0, 2000, 5000))] + [(None, 777)]
    rows = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    weight = {s: i % 3 + 1 for i, (s, _) in enumerate(sizes)}
    full, left = {}, dict(sizes)
    rest = sum(left.values())
    while left:
        level = rest / sum(weight[s] for s in left)
        over = [s for s in left if 3 * left[s] <= level * weight[s]]
        if not over:
            break
        for s in over:
            full[s] = 3 * left.pop(s)
            rest -= full[s]
    expected = {**full, **{s: level * weight[s] for s in left}}
    assert rows.keys() == expected.keys()
    assert all(abs(rows[s] - expected[s]) < 1e-6 * max(expected[s], 1) for s in rows)
