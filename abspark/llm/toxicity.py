"""Toxicity scores from a lexicon that tolerates misspellings.

Words are looked up in a lexicon trie intersected with Levenshtein automata. The lexicon is a
list of English terms (one added letter up to 4 letters, one edit up to 7, two beyond) and the
word stems, of whatever language, that labelled texts show to be far more frequent in toxic
ones (one edit before the last letter from FUZZY_STEM letters on, unless labelled clean texts
show the words so near to be usual ones; shorter stems as they are).
Fuzzy finds that labelled clean texts show to be ordinary words are excepted. Hits are weighed by a window of
words around them: in quotation marks, or after a word that mentions rather than uses a term,
a hit counts as quotation. A logistic model over hits, quotations and density, fitted on the
same labelled texts, gives the score; nothing else enters it.

Labels come from at most SAMPLE labelled documents, those with the smallest hash of their
doc_id. Labels that disagree count by their majority (ties: toxic). Without labels of both
kinds fixed weights are used. A null or empty text has no hits and gets the score of that;
rows that repeat a doc_id are scored by themselves; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abspark.llm.automaton import FuzzyLexicon
from abspark.llm.common import small_batches, staged

SAMPLE = 12_000  # labelled documents that lexicon and model are learned from
STEM_LENGTHS = (4, 5, 6, 7, 8)
FUZZY_STEM = 5  # letters from which on a stem is found with an edit
LEAST_TEXTS, LEAST_ODDS = 5, 2.5  # toxic texts with a stem, log odds against clean ones
CACHE = 200_000
REACH = 3  # words on either side of a hit that decide between quotation and abuse
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1

# English terms of abuse.
TERMS = """
    airhead asshole bastard bitch bonehead bozo brainless buffoon bullshit clown coward creep cretin
    crybaby degenerate despicable dimwit disgrace disgusting dipshit dumb dumbass dumbest dunce
    failure fatso filthy freak garbage halfwit hideous idiot idiotic idiots ignorant imbecile
    incompetent jackass jerk lame laughable loathsome loser losers lowlife maggot moron moronic
    morons nincompoop nitwit numbskull parasite pathetic pervert pigheaded psycho repulsive
    retarded ridiculous scoundrel scum scumbag shithead simpleton sleazy slob stupid stupidity
    swine thickhead trash twit ugly useless vermin vile weirdo whore wimp worthless wretch
""".split()
# Words that mention a term instead of using it.
MENTIONS = frozenset(
    "word words term terms phrase called quoted quote said says wrote mot mots terme wort begriff palabra término".split()
)
QUOTES = frozenset("\"'“”„‟«»‘’‹›`")
TRIMMED = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’‹›…–—¡¿"
DEFAULT = [-4.0, 3.0, 1.0, -0.5, 0.5, 0.0]  # weights where nothing can be learned


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def plain(token: str) -> str:
    return token.strip(TRIMMED).lower()


class Lexicon:
    """Looks words up: 0 for none, else the weight of the hit. Finds are kept in a table that
    is emptied when full. Stems in strict are found as they are only. A lexicon is sent to
    tasks as what it is built from."""

    def __init__(self, stems: dict[str, float], ordinary: frozenset[str], strict: frozenset[str] = frozenset()):
        self.stems, self.ordinary, self.strict, self.known = stems, ordinary, strict, {}
        by_edits = {0: [], 1: [], 2: []}
        for term in TERMS:
            by_edits[0 if len(term) <= 4 else 1 if len(term) <= 7 else 2].append(term)
        self.fuzzy = [FuzzyLexicon(by_edits[0], 1, added_only=True), *(FuzzyLexicon(by_edits[n], n) for n in (1, 2))]
        self.starts = FuzzyLexicon([s for s in stems if len(s) >= FUZZY_STEM and s not in strict], 1)

    def __reduce__(self):
        return Lexicon, (self.stems, self.ordinary, self.strict)

    def nearest(self, word: str) -> tuple[int, str] | None:
        return min((f for f in (x.find(word) for x in self.fuzzy) if f), default=None)

    def stem(self, word: str) -> float:
        """Weight of the strongest stem the word starts with."""
        return max((self.stems.get(word[:n], 0.0) for n in STEM_LENGTHS if len(word) >= n), default=0.0)

    def near_stem(self, word: str) -> float:
        """Weight of the strongest stem the word starts with but for an edit."""
        return max((self.stems[s] - 1 for s in self.starts.near_starts(word)), default=0.0)

    def stems_near(self, word: str) -> frozenset[str]:
        """Stems that make the word a hit by an edit alone."""
        exact = len(word) < 3 or self.nearest(word) or self.stem(word)
        return frozenset() if exact else self.starts.near_starts(word)

    def is_misspelled(self, word: str) -> bool:
        """Is the word a hit by edits alone?"""
        if len(word) < 3:
            return False
        found = self.nearest(word)
        return found[0] > 0 if found else not self.stem(word) and self.near_stem(word) > 0

    def look_up(self, word: str) -> float:
        if len(word) < 3:
            return 0.0
        found = self.nearest(word)
        if found and (found[0] == 0 or word not in self.ordinary):
            return 5.0 - found[0]
        return self.stem(word) or (0.0 if word in self.ordinary else self.near_stem(word))

    def weight(self, token: str) -> float:
        got = self.known.get(token)
        if got is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            got = self.known[token] = self.look_up(plain(token))
        return got


def is_quoted(tokens: list[str], at: int) -> bool:
    """Is the hit quoted or mentioned? An opening mark in the words up to it and a closing
    one in the words from it on, or a mentioning word just before."""
    before, after = tokens[max(at - REACH, 0) : at + 1], tokens[at : at + REACH + 1]
    opens = any(t[0] in QUOTES for t in before)
    closes = any(t.rstrip(".,;:!?")[-1:] in QUOTES for t in after)
    return opens and closes or any(plain(t) in MENTIONS for t in before[:-1])


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    tokens = (text or "").split()
    weigh = lexicon.weight
    hits = [(i, w) for i, w in enumerate(map(weigh, tokens)) if w]
    quoted = sum(is_quoted(tokens, i) for i, _ in hits)
    used = len(hits) - quoted
    density = 100 * used / (len(tokens) + 10)
    strongest = max((w for _, w in hits), default=0.0)
    return [1.0, math.log1p(used), min(density, 10.0), math.log1p(quoted), strongest, math.log1p(len(tokens))]


def stems_of(text: str | None) -> set[str]:
    words = {plain(t) for t in (text or "").split()}
    return {w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n and w[:n].isalpha()}


def labelled(docs: DataFrame, labels: DataFrame, held: Column) -> DataFrame:
    """text, toxic of the labelled documents that may be learned from, SAMPLE at most."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held)
    marks = marks.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).withColumnRenamed("doc_id", "of")
    # At most SAMPLE rows, so small enough to broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("of"))
    return staged(rows.select("text", "toxic"))


def counted(texts: DataFrame, count) -> DataFrame:
    """key, texts: in how many texts each key occurs; summed per batch before the shuffle."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every: Counter = Counter()
            for text in batch["text"]:
                every.update(count(text))
            if every:
                yield pd.DataFrame({"key": list(every), "texts": pd.array(list(every.values()), "int64")})

    return texts.select("text").mapInPandas(sums, "key string, texts long").groupBy("key").agg(F.sum("texts").alias("texts"))


def log_odds(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """How much likelier a key is in a toxic text than in a clean one, by its counts."""
    share = lambda n, of: F.ln((F.coalesce(n, F.lit(0)) + 0.5) / F.lit(float(of + 1)))
    return share(toxic, n_toxic) - share(clean, n_clean)


def learn_lexicon(texts: DataFrame) -> Lexicon:
    """Stems whose odds are high enough, and misspellings that are ordinary words. Both are
    chosen in Spark; what reaches the driver is bounded by the sample alone."""
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    toxic, clean = texts.where("toxic = 1"), texts.where("toxic = 0")
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon({}, frozenset())

    def compared(of_toxic: DataFrame, of_clean: DataFrame, how: str) -> DataFrame:
        both = of_toxic.join(of_clean.withColumnRenamed("texts", "clean_texts"), "key", how)
        return both.withColumn("odds", log_odds(F.col("texts"), F.col("clean_texts"), n_toxic, n_clean))

    frequent = counted(toxic, stems_of).where(F.col("texts") >= LEAST_TEXTS)
    telling = compared(frequent, counted(clean, stems_of), "left").where(F.col("odds") >= LEAST_ODDS)
    stems = {r["key"]: r["odds"] for r in telling.collect()}
    every = Lexicon(stems, frozenset())
    words_of = lambda text: {plain(t) for t in (text or "").split()}

    def near(text: str | None) -> set[str]:
        return set().union(*map(every.stems_near, words_of(text)))

    usual = compared(counted(toxic, near), counted(clean, near), "right").where(F.col("odds") < LEAST_ODDS)
    bare = Lexicon(stems, frozenset(), frozenset(r["key"] for r in usual.collect()))

    def misspelled(text: str | None) -> set[str]:
        return {w for w in words_of(text) if bare.is_misspelled(w)}

    seen = lambda rows: counted(rows, misspelled).where("texts >= 2")
    common = compared(seen(toxic), seen(clean), "right").where(F.col("odds") < LEAST_ODDS)
    return Lexicon(stems, frozenset(r["key"] for r in common.collect()), bare.strict)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic model by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = ridge * np.append(0.0, np.ones(len(w) - 1))
        gradient = x.T @ (y - p) - penalty * w
        curvature = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty + 1e-6)
        w += np.linalg.solve(curvature, gradient)
    return w


def learn(docs: DataFrame, labels: DataFrame, held: Column | None = None) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and weights from the labelled documents that are not held out."""
    small_batches(docs.sparkSession)
    texts = labelled(docs, labels, held_out(F.col("doc_id")) if held is None else held)
    lexicon = learn_lexicon(texts)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [features(t, lexicon) for t in batch["text"]], "toxic": batch["toxic"]})

    rows = texts.mapInPandas(look, "x array<double>, toxic int").toPandas()  # SAMPLE rows at most
    if rows["toxic"].nunique() < 2:
        return lexicon, np.array(DEFAULT)
    return lexicon, fit(np.stack(rows["x"].to_numpy()), rows["toxic"].to_numpy(float))


def score_toxicity(docs: DataFrame, labels: DataFrame, held: Column | None = None) -> DataFrame:
    """doc_id and score (0 to 1) of each row. held, over the labels, marks documents that
    nothing is learned from."""
    lexicon, weights = learn(docs, labels, held)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Lexicon(lexicon.stems, lexicon.ordinary, lexicon.strict)
        for batch in batches:
            x = np.array([features(t, own) for t in batch["text"]]).reshape(-1, len(weights))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))})

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInPandas(score, "doc_id long, score double")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs below the threshold; columns unchanged. The score is computed in an
    Arrow-batched column function here, so the rows need no join."""
    lexicon, weights = learn(docs, labels)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Lexicon(lexicon.stems, lexicon.ordinary, lexicon.strict)
        for texts in batches:
            x = np.array([features(t, own) for t in texts]).reshape(-1, len(weights))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))

    return docs.where(score(F.col("text")) < THRESHOLD)
