import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from trafficloom.llm import toxicity as T


def slow_segments(x):
    """By definition: recursively the best segment (shortest, then first), then the rest on both sides."""
    best = max(((sum(x[a:b]), a - b, -a, (a, b)) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    a, b = best[3]
    return slow_segments(x[:a]) + [(a, b, best[0])] + [(a + b, c + b, s) for a, c, s in slow_segments(x[b:])]


def test_segments_equal_the_definition():
    rng = random.Random(4)
    for _ in range(500):
        x = [rng.choice([-7, -5, -3, -2, -1, 1, 2, 3, 4, 6]) + rng.random() / 100 for _ in range(rng.randint(0, 12))]
        assert [(a, b, round(s, 6)) for a, b, s in T.segments(x)] == [(a, b, round(s, 6)) for a, b, s in slow_segments(x)]
    assert len(T.segments([1.0, -0.5] * 100_000)) >= 1


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, d = random.Random(6), str(tmp_path_factory.mktemp("tox"))
    clean, bad = [f"w{a}{b}" for a, b in itertools.product("abcdefgh", "abcdefghij")], ["vilexa", "vilexo", "grubnik", "grubnak"]
    docs, labels = [], []
    for i in range(600):
        words = rng.choices(clean, k=rng.randint(5, 120))
        y = i % 6 == 0
        for _ in range(rng.randint(2, 6) * y):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "s", "ing"]))
        docs.append((i, " ".join(words), "x", 0.5))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, 1, int(y)))
    docs += [(9000, None, "x", 0.1), (9001, "", "x", 0.1), (9002, "vilex " * 20000, "x", 0.1), (0, docs[0][1], "x", 0.5), (9003, "... !!", "x", 1.0), (None, "waa", "x", 1.0)]
    spark.createDataFrame(docs, "doc_id long, text string, toxicity string, score double").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, docs, dict((i, y) for i, _, y in labels)


def test_held_out(spark, corpus):
    d, docs, labels = corpus
    got = T.op5_toxicity(spark, d).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    judged = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert judged and sum(p == y for p, y in judged) >= 0.95 * len(judged)
    assert [r.score for r in got if r.doc_id in (9000, 9001)] == [0.0, 0.0] and sum(r.doc_id == 0 for r in got) == 2
    assert next(r.predicted for r in got if r.doc_id == 9002) == 1


def test_terms_against_plain_counts(spark, corpus):
    d, _, _ = corpus
    train = T.training_rows(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    rows = train.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and {r.half for r in rows} == {0, 1}
    seen = {}
    for r in rows:
        words = T.tokens(r.text)
        for a, w, b in zip(["", *words], words, [*words[1:], ""]):
            seen.setdefault((w, a, b, r.toxic), set()).add(r.half)
    counts = Counter()
    for (w, _, _, y), halves in seen.items():
        for term in {w, "", *(w[:n] + "*" for n in T.PREFIXES if len(w) > n)}:
            counts.update([(term, "", y), *((term, str(h), y) for h in halves)])
    got = {r["term"]: r for r in T.term_counts(train).collect()}
    assert got.keys() == {t for t, _, _ in counts}
    for term, r in got.items():
        for h in ("", "0", "1"):
            assert (r[f"toxic{h}"], r[f"clean{h}"]) == (counts[term, h, 1], counts[term, h, 0])

    def differs(term, h):
        if term == "":
            return True
        core = term.rstrip("*")
        above = next((core[:n] + "*" for n in reversed(T.PREFIXES) if n < len(core)), "")
        a, b, x, y = counts[term, h, 1], counts[term, h, 0], counts[above, h, 1], counts[above, h, 0]
        return 2 * sum(n * math.log(n / ((a + b) * m / (x + y))) for n, m in ((a, x), (b, y)) if n) >= T.INFORMATIVE

    told = {r["term"]: [r[f"tells{h}"] for h in ("", "0", "1")] for r in T.informative_terms(T.term_counts(train)).collect()}
    want = {t: [differs(t, h) for h in ("", "0", "1")] for t in got}
    assert told == {t: x for t, x in want.items() if any(x)}
    scores = T._lexicon([(t, counts[t, "", 1], counts[t, "", 0]) for t, x in told.items() if x[0]])
    assert scores.keys() == {t for t, x in told.items() if x[0]} - {""} and min(scores["vil*"], scores["gru*"]) > 2


def test_extreme_values_of_known_law():
    rng = np.random.default_rng(3)
    n = rng.integers(5, 2000, 20_000).astype(float)
    best = (np.log(n) - 1.5 - np.log(-np.log(rng.random(len(n))))) / 2.0
    decay, log_k = T.fit_extreme_values(best, n)
    assert abs(decay - 2.0) < 0.1 and abs(log_k + 1.5) < 0.2


def test_passages(spark, corpus):
    d, _, _ = corpus
    model = T.learn(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    text = "waa wbb wcc " * 5 + "vilexa grubnik vilexo " + "wdd wee " * 5
    (a, b, _), *rest = model.passages(text)
    assert (a, b) == (15, 18) and not rest


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = T.learn(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert T.score_documents(docs, model, ["doc_id"]).first().toxicity < 0.5
    assert T.score_documents(docs.limit(0), model, ["doc_id"]).count() == 0
