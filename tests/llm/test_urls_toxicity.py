"""URL filters against a plain matcher; automata, lexicon and model of the toxicity score."""

import pickle
import random
import re

from abspark.llm import toxicity, url_filter
from abspark.llm.automaton import FuzzyLexicon
from abspark.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme/at/all", "http://", "://", "HTTP://Example.NET/en/x", "https://a.example.net/en",
    "https://a.example.net/en/", "http://net", "http://net/", "http://.net/", "https://sub.example.com/de/1?x=/fr/",
    "ftp://example.com/fr/", "http://a.b.org/fr/#://", "http://example.org?/fr/", "https://examplenet/", "http://x.net\n/en/",
    "http://a.net/p?q://example.com/de/", "https://ÉXAMPLE.Org/fr/ü", "http://a.net/p?q://example.com/de/",
]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in URL_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_url_filters(spark):
    pages = spark.createDataFrame([(i, u, 1, "h") for i, u in enumerate(URLS)], "page_id long, url string, host int, rule string")
    rules = spark.createDataFrame([*URL_RULES, URL_RULES[0]], "host string, path string, action string")
    got = url_filter.judge_urls(pages, rules)
    assert {r.page_id: tuple(r)[1:] for r in got.collect()} == {i: judged(u) for i, u in enumerate(URLS)}
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_finds_the_nearest_term():
    rng = random.Random(4)
    word = lambda low: "".join(rng.choice("abc") for _ in range(rng.randint(low, 7)))
    for edits in (0, 1, 2):
        for _ in range(20):
            terms = [word(1) for _ in range(6)]
            lexicon = FuzzyLexicon(terms, edits)
            for _ in range(20):
                asked = word(0)
                near = min((distance(asked, t), t) for t in terms)
                assert lexicon.find(asked) == (near if near[0] <= edits else None)


def test_automaton_finds_added_letters_and_near_starts():
    rng = random.Random(5)
    word = lambda low: "".join(rng.choice("abc") for _ in range(rng.randint(low, 7)))
    for _ in range(40):
        terms = [word(2) for _ in range(6)]
        added, starts = FuzzyLexicon(terms, 1, added_only=True), FuzzyLexicon(terms, 1)
        for _ in range(40):
            asked = word(0)
            shorter = {asked} | {asked[:i] + asked[i + 1 :] for i in range(len(asked))}
            near = min(((int(t != asked), t) for t in terms if t in shorter), default=None)
            assert added.find(asked) == near
            begins = [asked[:i] for i in range(1, len(asked) + 1)]
            fits = lambda t: any(p[-1] == t[-1] and distance(p[:-1], t[:-1]) <= 1 for p in begins)
            assert starts.near_starts(asked) == {t for t in terms if fits(t)}


def test_misspelled_stems_and_short_terms():
    stems = {"dummk": 3.0, "cretino": 4.0}
    lexicon = toxicity.Lexicon(stems, frozenset({"dumkling"}))
    assert [lexicon.weight(w) for w in ("dummkopf", "dumnkopf", "Dumkopf,", "duummkopf", "creTjnos")] == [3.0, 2.0, 2.0, 2.0, 3.0]
    assert [lexicon.weight(w) for w in ("dumkling", "dumnopf", "dumm", "dxnnkopf")] == [0.0] * 4
    assert [lexicon.weight(w) for w in ("dumbb", "duumb", "scumm", "jerkk")] == [4.0] * 4
    strict = pickle.loads(pickle.dumps(toxicity.Lexicon(stems, frozenset(), frozenset({"dummk"}))))
    assert strict.weight("dumnkopf") == 0.0 and strict.weight("dummkopf") == 3.0 and strict.weight("cretjnos") == 3.0


def test_stems_with_usual_neighbours_are_strict(spark):
    """What labelled clean texts say often is no misspelling: such stems are found exactly."""
    texts = [("a zorbling and a quandral here", 1)] * 6 + [("the zarbling of the valley", 0)] * 8 + [("plain words", 0)] * 40
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(texts, "text string, toxic int"))
    assert {"zorbl", "zorbling"} <= lexicon.strict and "quandra" in lexicon.stems and "quandra" not in lexicon.strict
    assert lexicon.weight("zorblings") > 0 and lexicon.weight("zurblings") == 0 and lexicon.weight("quamdral") > 0


def test_lexicon_and_context():
    lexicon = toxicity.Lexicon({"réêou": 3.0}, frozenset({"oron"}))
    assert lexicon.weight("Idiot!!") == 5.0 and lexicon.weight("(idi0t)") == 4.0
    assert lexicon.weight("oron") == 0.0 and lexicon.weight("réêouable") == 3.0
    assert lexicon.weight("river") == 0.0 and lexicon.weight("scam") == 0.0
    used, quoted = toxicity.features("you are an idiot", lexicon), toxicity.features('he wrote "an idiot" there', lexicon)
    assert used[1] > 0 and used[3] == 0 and quoted[1] == 0 and quoted[3] > 0


def test_scores(make_docs, spark):
    rng = random.Random(1)
    words = "river stone cloud paper green house".split()
    rows, labels = [], []
    for i in range(300):
        own = [rng.choice(words) for _ in range(30)]
        if i % 3 == 0:
            own[rng.randrange(30)] = own[rng.randrange(30)] = "stupid"
        rows.append((i, " ".join(own), "s"))
        labels.append((i, 1, int(i % 3 == 0), "s"))
    rows += [(900, None, "s"), (901, "", "s"), (None, "stupid idiot", "s"), (0, "again stupid", "s")]
    labels += [(5, 1, None, "s"), (None, 1, 1, "s"), (7, 1, 1, "s"), (7, 1, 0, "s")]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    docs = make_docs(rows)
    got = toxicity.score_toxicity(docs, marks).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 300]
    right = sum((r.score >= toxicity.THRESHOLD) == (r.doc_id % 3 == 0) for r in held)
    assert right >= 0.97 * len(held)
    assert all(r.score < 0.5 for r in got if r.doc_id in (900, 901))
    kept = toxicity.without_toxic(docs, marks)
    assert kept.columns == docs.columns and {900, 901} <= {r.doc_id for r in kept.collect()}
    unlabelled = toxicity.score_toxicity(docs.limit(3), marks.limit(0)).collect()
    assert all(0 <= r.score <= 1 for r in unlabelled)


def test_all_telling_stems_are_kept(spark):
    """No limit drops stems: over 20,000 that only toxic texts have are all learned."""
    words = [chr(97 + i // 676) + chr(97 + i // 26 % 26) + chr(97 + i % 26) + "zq" for i in range(11_000)]
    texts = [(" ".join(words), 1)] * 6 + [("plain words of a clean text", 0)] * 8
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(texts, "text string, toxic int"))
    assert len(lexicon.stems) == 22_000 and set(words) <= set(lexicon.stems)
