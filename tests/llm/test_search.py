"""Spelling variants, lexical search and nearest neighbours against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from abspark.llm import lexical_search, spelling, vector_search


# ---------------------------------------------------------------- spelling variants
def variant_rows(texts, every):
    counts = Counter()
    for doc_id, text in texts:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    close = {w: [v for v in words if abs(len(v) - len(w)) < 2 and near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(((-words[v], v) for v in close[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(close[w]), words.get(form[w])))
    return out


@pytest.mark.parametrize("every", [199, 3])
def test_spelling_variants(spark, make_docs, corpus, every):
    rng = random.Random(7)
    base = ["banana", "houses", "Häuser", "stéréo", "aaaaaa", "abcdefgh", "x" * 30, "ab" * 26, "q" * 200,
            "".join(rng.choice("abcd") for _ in range(500))]
    words = []
    for w in base:
        words += [w] * 40
        for _ in range(12):
            at, c = rng.randrange(len(w)), rng.choice("abéz")
            edited = rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
            words += [edited] * rng.choice([1, 5, 6, 8, 9])
    words += [w for n in (47, 48, 49, 50) for w in ["m" * n] * 5 * 6 ** (n - 47)]
    rng.shuffle(words)
    texts = [(i, " ".join(words[i::7])) for i in range(6)] + [(None, "-".join(words[6::7]).upper())]
    texts += [(i, t) for i, t, _ in corpus] + [(1, "tie-aa tieaab tieaac × ÷ tieaab")] * 5
    got = spelling.spelling_variants(make_docs([(*t, "s") for t in texts]), every)
    assert {tuple(r) for r in got.collect()} == variant_rows(texts, every)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_spelling_of_nothing(make_docs):
    assert spelling.spelling_variants(make_docs([])).count() == 0
    assert spelling.spelling_variants(make_docs([(1, None, "s"), (2, "", "s"), (3, "short", "s")])).count() == 0


def test_hashes_without_a_place():
    for word in ("abcdef", "aaaa", "é𝄞xé"):
        places, left, _ = spelling.without_each(word)
        for i in places:
            _, _, whole = spelling.without_each(word[:i] + word[i + 1 :])
            assert [int(x[i].view(np.int64)) for x in left] == whole


# ---------------------------------------------------------------- lexical search
def ranked_by_hand(texts, items, top):
    import math

    terms = lambda t: ["".join(c.lower() if c.isascii() else c for c in w)
                       for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    docs = [(d, Counter(terms(t))) for d, t in texts]
    docs = [(d, c) for d, c in docs if c]
    total, df = sum(sum(c.values()) for _, c in docs), Counter(t for _, c in docs for t in c)
    n_docs = len(docs)
    of_item = defaultdict(list)
    for item, text in dict.fromkeys(items):
        of_item[item] += terms(text)
    out = []
    for item, own in of_item.items():
        scores = []
        for d, c in docs:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t in own if t in c
            )
            scores.append((-score, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(x for x in scores if x[0] < 0)[:top])]
    return Counter(out)


@pytest.mark.parametrize("docs_held, postings_held, block, short, vocabulary, together", [
    (65_536, 2_000_000, 4_096, 1 / 64, 500_000, 200_000),
    (16, 300, 4, 1 / 3, 0, 20),
    (1_000, 50, 1, 0.0, 500_000, 1),
    (7, 2_000_000, 3, 1.0, 0, 200_000),
])
def test_lexical_search(spark, make_docs, corpus, monkeypatch, docs_held, postings_held, block, short, vocabulary, together):
    monkeypatch.setattr(lexical_search, "VOCABULARY", vocabulary)
    monkeypatch.setattr(lexical_search, "ITEM_TERMS", together)
    rng = random.Random(3)
    texts = [(i, t) for i, t, _ in corpus]
    pool = " ".join(t or "" for _, t in texts[:2] + texts[14:]).split()
    texts += [(100 + i, " ".join(rng.choices(pool, k=rng.randint(1, 60)))) for i in range(120)]
    texts += [texts[3], (40, texts[-1][1]), (41, texts[-1][1]), (7, "the of and the")]
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 25)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "nowhere"), (23, "The the THE été"), (23, "river"), items[0]]
    bench = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, rank int, terms string")
    # Functions travel to the workers by name, so what they read there is set through arguments.
    real = lexical_search.in_shards
    monkeypatch.setattr(lexical_search, "best_of_shards", small_shards(lexical_search.best_of_shards, docs_held, postings_held, block, short))
    got = lexical_search.rank_documents(make_docs([(*t, "s") for t in texts]), bench)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == ranked_by_hand(texts, items, 20)
    assert real is lexical_search.in_shards


def small_shards(real, docs_held, postings_held, block, short):
    """best_of_shards whose tasks run with small bounds."""

    def best(index, *rest):
        found = real(index, *rest)

        class Index:
            """An index whose mapInArrow sets the bounds in the worker first."""

            sparkSession, schema = index.sparkSession, index.schema

            @staticmethod
            def mapInArrow(fn, schema):
                def bounded(batches):
                    from abspark.llm import lexical_search as there

                    there.SHARD_DOCS, there.SHARD_POSTINGS = docs_held, postings_held
                    there.BLOCK_DOCS, there.SHORT_SHARE = block, short
                    yield from fn(batches)

                return index.mapInArrow(bounded, schema)

        return real(Index, *rest) if (docs_held, postings_held) != (65_536, 2_000_000) else found

    return best


def test_search_of_nothing(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical_search.rank_documents(make_docs([]), one).count() == 0
    assert lexical_search.rank_documents(make_docs([(1, "the of", "a")]), none).count() == 0


# ---------------------------------------------------------------- nearest neighbours
def brute_nearest(rows, top):
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in rows}
    out = {}
    for i in sorted(unit):
        if i % 50 == 0:
            near = sorted((-round(float(unit[i] @ v), 12), j) for j, v in unit.items() if j != i)
            out[i] = [(j, -s) for s, j in near[:top]]
    return out


def found_nearest(spark, rows, kind="array<float>"):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding {kind}, code string, rank int")
    got = defaultdict(list)
    result = vector_search.nearest(df, F.col("vec_id") % 50 == 0)
    assert result.columns == ["query_id", "rank", "vec_id", "score"]
    for r in sorted(result.collect()):
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    return got


def test_nearest_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32))
    vectors = [(i, (centres[i % 40] + 0.7 * rng.normal(size=32)).tolist()) for i in range(3000)]
    vectors = [(i, np.float32(v).tolist()) for i, v in vectors]
    expected, got = brute_nearest(vectors, 5), found_nearest(spark, vectors)
    assert expected.keys() == got.keys()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors}
    hits = 0
    for q, near in got.items():
        assert len(near) == 5 and all(abs(s - unit[q] @ unit[v]) < 1e-9 for v, s in near)
        hits += len({v for v, _ in near} & {v for v, _ in expected[q]})
    assert hits >= 0.9 * 5 * len(expected)


def test_nearest_odd_rows(spark):
    """Few rows, copies of a vector on very many ids, ties, scaled vectors, unusable rows."""
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(100, 400)] + [(50, [2.0, 4.0, 6.0]), (0, [-1.0, 0.5, 0.0]), (7, [0.0, 1.0, 1e-3])]
    bad = [(1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 2.0]), (4, [float("nan"), 1.0, 1.0]),
           (5, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (6, [1.0, 2.0]), (150, [9.0, 9.0, 9.0]), (8, [])]
    got = found_nearest(spark, rows + bad, "array<double>")
    expected = brute_nearest(rows, 5)
    assert expected.keys() == got.keys()
    for q, near in got.items():
        assert [v for v, _ in near] == [v for v, _ in expected[q]]
        assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(near, expected[q]))


def test_nearest_of_few(spark):
    assert not found_nearest(spark, [])
    assert not found_nearest(spark, [(0, [1.0, 2.0])])
    assert [v for v, _ in found_nearest(spark, [(0, [1.0, 2.0]), (3, [2.0, 1.0])])[0]] == [3]
    huge = found_nearest(spark, [(0, [1e300, 0.0]), (1, [1e300, 1e300]), (2, [1e-300, 1e-301])], "array<double>")
    assert [v for v, _ in huge[0]] == [2, 1]


def test_radius_finds_every_code(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(600, 16))
    coder = vector_search.learned(vectors, 600)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "rep long, embedding array<double>")
    index = vector_search.coded(df, "rep", coder, False)
    queries = vector_search.coded(df.where("rep % 20 = 0").withColumnRenamed("rep", "query"), "query", coder, True)
    codes = coder.codes(vectors)
    for radius in (0, 5, 16, 37, 90, 256):
        asked = queries.withColumn("radius", F.lit(radius).cast("long"))
        for bits in (4, 7):
            got = Counter(map(tuple, vector_search.within(index, asked, bits).collect()))
            expected = {(q, int(r)) for q in range(0, 600, 20) for r in np.flatnonzero(vector_search.hamming(codes, codes[q]) <= radius)}
            assert got == dict.fromkeys(expected, 1)


def test_sample_sent_to_driver_is_bounded(spark, monkeypatch):
    """However many tasks read the points, they send about SAMPLE of them to the driver."""
    monkeypatch.setattr(vector_search, "SAMPLE", 500)
    vectors = np.random.default_rng(6).normal(size=(12_000, 16))
    kind = "rep long, embedding array<double>, members array<long>"
    points = spark.createDataFrame([(i, v.tolist(), [i]) for i, v in enumerate(vectors)], kind).repartition(24)
    points = points.cache()
    expected = [r[0] for r in points.select(F.xxhash64("embedding"), "embedding").orderBy(F.xxhash64("embedding")).select("embedding").collect()]
    settings, most = spark.sparkContext._jsc.sc().conf(), "spark.driver.maxResultSize"
    old = settings.get(most, "1g")
    settings.set(most, "1m")
    try:
        sample = vector_search.learning_sample(points, len(vectors))
    finally:
        settings.set(most, old)
        points.unpersist()
    assert sample.tolist() == [list(v) for v in expected[:500]]
    few = spark.createDataFrame([(1, [1.0, 2.0])], "rep long, embedding array<double>")
    assert vector_search.learning_sample(few, 1).tolist() == [[1.0, 2.0]]
    assert len(vector_search.learning_sample(points, 10_000_000)) == 500  # a bound with too few below it


def test_scan_finds_what_keys_find(spark, monkeypatch):
    """Vectors of one direction tie; pieces hold 100 vectors."""
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(500, 16))
    vectors = np.vstack([vectors, np.outer(2.0 ** np.arange(1, 41), vectors[0]), 3.7 * vectors[20:30]])
    coder = vector_search.learned(vectors, len(vectors))
    kind = "rep long, embedding array<double>, members array<long>"
    rows = [(3 * i, v.tolist(), [3 * i] if i % 4 else [3 * i, 3 * i + 1, 3 * i + 2]) for i, v in enumerate(vectors)]
    points = spark.createDataFrame(rows, kind)
    asked = points.where("rep % 60 = 0").select(F.col("rep").alias("query"), "embedding")
    asked = vector_search.coded(asked, "query", coder, True).withColumn("radius", (F.col("query") * 7 % 257).cast("long"))
    keyed = vector_search.scored(vector_search.within(vector_search.coded(points, "rep", coder, False), asked, 4), points, 6)
    monkeypatch.setattr(vector_search, "SCAN_BYTES", 100 * 16 * 8)
    monkeypatch.setattr(vector_search, "STRETCH", 64)
    pairs = vector_search.scanned(points, asked, coder, len(vectors), 6).cache()
    assert pairs.groupBy("query").count().agg(F.max("count")).first()[0] <= 6 * 6
    columns = ["query", "rank", "vec_id", "score"]
    expected = sorted(map(tuple, keyed.select(columns).collect()))
    assert sorted(map(tuple, vector_search.members(pairs, points, 6).select(columns).collect())) == expected
    assert len({q for q, *_ in expected}) == asked.count()


def test_nearest_by_keys(spark, monkeypatch):
    """With many queries of narrow radius the keys are used, and find the same."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(30, 24))
    rows = [(i, np.float32(centres[i % 30] + 0.05 * rng.normal(size=24)).tolist()) for i in range(1500)]
    expected = found_nearest(spark, rows)
    for few in (0, 10):
        monkeypatch.setattr(vector_search, "FEW", few)
        monkeypatch.setattr(vector_search, "by_keys", lambda n, bits: 20)
        assert found_nearest(spark, rows) == expected


def test_widest_radius_by_keys():
    assert vector_search.by_keys(10_000, 4) == -1
    assert vector_search.by_keys(100_000, 5) == 5  # six substrings, one group each
    assert vector_search.by_keys(16_384 * 16 * 13, 12) == 31  # one bit off in each
    assert vector_search.by_keys(10**9, 4) == vector_search.BITS
