"""Scores and fingerprints against plain Python over the awkward corpus."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from abspark.llm import lm_score, spotsigs, toxicity


# ---------------------------------------------------------------- SpotSigs
def chains(text, divisible):
    """Signatures of a text as (anchor, chain)."""
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in low).split(" ")
    words = [w for w in words if w]
    content = [w if w not in spotsigs.COMMON_WORDS else None for w in words]
    after = lambda i: tuple([w for w in content[i : i + spotsigs.REACH] if w][: spotsigs.CHAIN])
    found = {("", after(0))} if words else set()
    for i, w in enumerate(words):
        if content[i] is None or w in divisible:
            found.add((w, after(i + 1)))
    return found


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_by_hand(spark, make_docs, corpus):
    rows = {d: t for d, t, _ in corpus}
    ids = sorted(rows)
    text = lambda d: rows[d] or ""
    following = dict(zip(ids, [*ids[1:], ids[0]]))
    edited = {}
    for d in ids:
        quarter = len(text(d)) // 4
        edited[d] = text(d)[: len(text(d)) - quarter] + text(following[d])[:quarter]
    every = {w for t in [*map(text, ids), *edited.values()] for w in chains_words(t)}
    frame = spark.createDataFrame([(w,) for w in every], "w string")
    divisible = {r.w for r in frame.where(F.pmod(F.hash("w"), F.lit(spotsigs.EXTRA)) == 0).collect()}
    got = {r.doc_id: r for r in spotsigs.compare_edited(make_docs(corpus)).collect()}
    sets = {d: chains(text(d), divisible) for d in ids}
    for d in ids:
        own, new = sets[d], chains(edited[d], divisible)
        assert got[d].edited == edited[d]
        assert len(got[d].signatures) == len(own) and len(got[d].edited_signatures) == len(new)
        assert abs(got[d].near_edited - jaccard(own, new)) < 1e-12
        assert abs(got[d].near_next - jaccard(own, sets[following[d]])) < 1e-12
    prints = {d: tuple(got[d].signatures) for d in ids}
    assert all((prints[a] == prints[b]) == (sets[a] == sets[b]) for a in ids for b in ids)


def chains_words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text)
    return [w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in low).split(" ") if w]


# ---------------------------------------------------------------- language model
def test_interpolated_score_by_hand(make_docs, corpus, monkeypatch):
    """With given weights a score is the sum over tokens of the interpolated probability."""
    weights = np.array([[0.0, 0.5, 0.5]] + [[0.1 * k, 0.5, 0.5 - 0.1 * k] for k in (1, 2, 3, 4)] + [[0.6, 0.3, 0.1]] * 40)
    monkeypatch.setattr(lm_score, "learn_weights", lambda *_: weights)
    docs = make_docs(corpus)
    held = F.col("doc_id") % 3 == 0
    got = {r.doc_id: r for r in lm_score.score_texts(docs, held).collect()}
    cut = lambda t: [*(w.decode() for w in (t or "").encode().lower().split()), None]
    tokens, pairs, contexts = Counter(), Counter(), Counter()
    for d, t, _ in corpus:
        if d % 3:
            own = cut(t)
            tokens.update(own)
            pairs.update(zip(["START", *own[:-1]], own))
            contexts.update(["START", *own[:-1]])
    total, types = sum(tokens.values()), len(tokens)
    for d, t, _ in corpus:
        own, score = cut(t), 0.0
        for v, w in zip(["START", *own[:-1]], own):
            c = contexts[v]
            a = weights[0 if not c else int(math.log2(c)) + 1]
            score += math.log10(a[0] * pairs[v, w] / max(c, 1) + a[1] * tokens[w] / total + a[2] / (types + 1))
        assert abs(got[d].score - score) < 1e-6 * max(1, abs(score))
        assert got[d].held_out == (d % 3 == 0)


# ---------------------------------------------------------------- toxicity
def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_toxicity_score_by_hand(spark, make_docs, monkeypatch):
    """With given stems, exceptions and weights a score follows from edit distances and windows."""
    stems, ordinary, weights = {"dumm": 3.0, "dummk": 3.5, "blöd": 2.6}, frozenset({"morton"}), np.array([-2.0, 1.5, 0.3, -0.7, 0.4, -0.1])
    monkeypatch.setattr(toxicity, "learn", lambda *_: (toxicity.Lexicon(stems, ordinary), weights))
    texts = ["you stupid idiot", "you stupud idoit and Dummkopf", 'they said "idiot" to me', "the word moron is old", "morton lives here",
             "", None, "a clean text of words", "blödes Zeug, du Trottel! uglyy", "pathetic... patetic?! worthles", "no " * 50 + "scum", "dumnkopf, dumbb scumm and Dumkopff"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(make_docs([(d, t, "s") for d, t in rows]), None).collect()}

    def gap(word, term):
        """Edits if they are allowed: a letter more in terms up to 4 letters, 1 edit up to 7, 2 beyond."""
        if len(term) <= 4:
            more = term in [word[:i] + word[i + 1 :] for i in range(len(word))]
            return [0] if word == term else [1] if more else []
        n = edits(word, term)
        return [n] if n <= (1 if len(term) <= 7 else 2) else []

    def near(word, stem):
        return any(word[i] == stem[-1] and edits(word[:i], stem[:-1]) <= 1 for i in range(len(word)))

    def weight(token):
        word = token.strip(toxicity.TRIMMED).lower()
        if len(word) < 3:
            return 0.0
        gaps = [n for t in toxicity.TERMS for n in gap(word, t)]
        if gaps and (min(gaps) == 0 or word not in ordinary):
            return 5.0 - min(gaps)
        exact = max((stems.get(word[:n], 0.0) for n in toxicity.STEM_LENGTHS if len(word) >= n), default=0.0)
        return exact or max((w - 1 for s, w in stems.items() if len(s) >= 5 and word not in ordinary and near(word, s)), default=0.0)

    for d, t in rows:
        tokens = (t or "").split()
        hits = [(i, weight(x)) for i, x in enumerate(tokens) if weight(x)]
        quoted = sum(toxicity.is_quoted(tokens, i) for i, _ in hits)
        used = len(hits) - quoted
        x = [1.0, math.log1p(used), min(100 * used / (len(tokens) + 10), 10.0), math.log1p(quoted),
             max((w for _, w in hits), default=0.0), math.log1p(len(tokens))]
        assert abs(got[d] - 1 / (1 + math.exp(-(np.array(x) @ weights)))) < 1e-9
    assert toxicity.is_quoted('they said "idiot" to me'.split(), 2) and not toxicity.is_quoted("you stupid idiot".split(), 2)
