"""The pipeline's stages keep their promises on what the stage before kept."""

import hashlib
import re

import corpus_pipeline
from tests.llm.test_texts import components_of, near_group, removed, tokens, words


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(spark.createDataFrame(stage(spark, kept[-1], folder).collect(), docs.schema))
        assert kept[-1].columns == columns
    after = {name: {r.doc_id: r.text for r in df.collect()} for name, df in zip(["all", *names], kept)}

    # toxicity: rows only go
    assert after["toxicity"].items() <= after["all"].items() and len(after["toxicity"]) < len(after["all"])
    # near copies: equal texts leave one, and what stays is unchanged
    assert after["near_copies"].items() <= after["toxicity"].items()
    whole = [" ".join(tokens(t)) for t in after["near_copies"].values()]
    assert len(set(whole)) == len(whole)
    # repeats: bytes by definition
    before = sorted(after["near_copies"].items())
    cut = {k[0]: k for k in removed(before)}
    for doc_id, text in before:
        _, size, gone, _, sha = cut[doc_id]
        if gone == 0:
            assert after["repeats"][doc_id] == text
        elif gone == size:
            assert doc_id not in after["repeats"]
        elif hashlib.sha256(after["repeats"][doc_id].encode()).hexdigest() != sha:
            assert not text.isascii()  # a character lost some of its bytes
    # benchmark: no window of an item is left
    items = [words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9)) if w}
    for doc_id, text in after["repeats"].items():
        w = words(text)
        hit = any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
        assert hit == (doc_id not in after["benchmark"])
    # mix: documents of the stage before, none over three times
    mixed = kept[-1].collect()
    times = {}
    for r in mixed:
        assert after["benchmark"][r.doc_id] == r.text
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 3
    assert all(r.n_chars == len(r.text) for r in mixed if not re.search("\r", r.text))


def test_near_copies_share_five_word_shingles(spark, make_docs, corpus):
    def scattered(doc_id, changes):
        w = [f"w{doc_id}x{i}" for i in range(200)]
        for i in range(changes):
            w[20 + 35 * i] = f"new{i}"
        return " ".join(w)

    rows = [*[r for r in corpus if r[1] and r[1].strip()], *near_group(corpus, 60)]
    # 177/217 of the four-word shingles are common, but 171/221 of the five-word ones
    rows += [(2000, scattered(1, 0), "s"), (2001, scattered(1, 5), "s"), (2010, scattered(2, 0), "s"), (2011, scattered(2, 4), "s")]
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, make_docs(rows), "").collect()}
    assert kept == {k[2] for k in components_of(rows, 5)}
    assert {2000, 2001, 2010} <= kept and 2011 not in kept


def test_run_is_the_stages(spark, folder):
    result = corpus_pipeline.run(spark, folder)
    assert result.columns == spark.read.parquet(f"{folder}/documents.parquet").columns and result.count() > 0


def tables(spark, tmp_path, rows, labels, items):
    """A folder of the tables the pipeline reads."""
    folder = str(tmp_path)
    docs = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_run_on_empty_tables(spark, tmp_path):
    result = corpus_pipeline.run(spark, tables(spark, tmp_path, [], [], []))
    assert result.columns == ["doc_id", "text", "lang", "source", "n_chars"] and result.count() == 0


def test_run_on_nulls_and_repeats(spark, corpus, tmp_path):
    """Null ids, texts, sources and labels, rows that repeat, an item without text."""
    rows = [*corpus, *corpus[:3], (None, "a text without id but words enough", None), (None, None, None), (30, None, "a")]
    labels = [(1, 1, 0), (2, None, None), (None, 0, 1), (1, 1, 0)]
    folder = tables(spark, tmp_path, rows, labels, [(0, None), (1, ""), (2, corpus[6][1][:300]), (None, "of the and")])
    result = corpus_pipeline.run(spark, folder)
    assert result.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = result.collect()
    given = {(d, s) for d, _, s in rows}
    assert kept and {(r.doc_id, r.source) for r in kept} <= given
    assert 1 in {r.doc_id for r in kept} and 2 not in {r.doc_id for r in kept}  # 2 copies 1
