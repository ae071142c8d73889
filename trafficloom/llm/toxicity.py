"""Toxic passages as maximum-scoring segments of token log-odds.

Learning: on a bounded sample of labelled documents (TRAIN_ROWS) words and their
prefixes are counted for toxic and other documents, once for each pair of neighbours. A prefix's share has a
Dirichlet prior centred on the shorter prefix's, a word's one centred on its longest
prefix's; log-odds of the posterior means score the tokens. A term belongs to the lexicon if its counts
differ from those of the next shorter prefix by the likelihood-ratio statistic G2 >= INFORMATIVE; any other
word, seen or not, takes the score of its longest prefix that does. Scores are cut off at LIMIT and lowered by DRIFT,
which makes the expected score of ordinary prose negative.

Scoring: one linear pass over a whole text finds all maximal-scoring segments. Under
ordinary prose the best of n tokens follows an extreme-value law: E = K n exp(-lambda S)
segments of score S or more are expected, with K and lambda fitted to clean
sample documents. A passage is significant if E <= SIGNIFICANT. A document's significant
passages are added up as sum(log(SIGNIFICANT / E)), and a logistic curve fitted on the
sample turns that and the best passage's -log E into the score. Both fits are cross-fitted: each half of the
sample (by a hash of the text, so copies stay together) is scored with a lexicon of the other half.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..plans.shared import bounded_batches, materialize, release

#: Most labelled documents that are learned from, whatever the size of the tables.
TRAIN_ROWS = 12_000
INFORMATIVE = 6.63
PREFIXES, CONCENTRATION, LIMIT, DRIFT, SIGNIFICANT = (3, 4, 5, 6), (50.0, 20.0, 10.0, 5.0, 3.0), 8.0, 0.7, 0.05
#: Words whose scores a worker remembers; forgetting them only costs time.
MEMORY_WORDS = 200_000
CONTEXTS_HELD = 200_000
TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in linear time.

    Candidates are kept with the sum before (left) and through them (right) and a
    link to the nearest earlier one with a smaller left sum; a new one absorbs those
    whose right sum is below its own.
    """
    kept: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for at, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        start, left = at, total
        total += s
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                kept.append((start, at + 1, left, total, j))
                break
            start, left = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, right - left) for a, b, left, right, _ in kept]


@dataclass
class ToxicityModel:
    scores: dict[str, float]  # of words, and of prefixes with a trailing *
    other: float  # of a token without any of them
    decay: float  # lambda
    log_k: float
    weights: tuple[float, float, float]

    def token_scores(self, words: list[str]) -> list[float]:
        memo = self.__dict__.setdefault("_memo", {})
        if len(memo) > MEMORY_WORDS:
            memo.clear()
        out = []
        for w in words:
            s = memo.get(w)
            if s is None:
                s = self.scores.get(w)
                for n in reversed(PREFIXES):
                    s = self.scores.get(w[:n] + "*") if s is None and len(w) > n else s
                s = memo[w] = self.other if s is None else s
            out.append(s)
        return out

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """Significant passages: first token, end token, -log E."""
        words = tokens(text)
        found = ((a, b, self.decay * s - self.log_k - np.log(max(len(words), 1))) for a, b, s in segments(self.token_scores(words)))
        return [(a, b, float(e)) for a, b, e in found if e >= -np.log(SIGNIFICANT)]

    def features(self, text: str | None) -> tuple[float, float]:
        words = tokens(text)
        best = [s for _, _, s in segments(self.token_scores(words))]
        e = self.decay * np.array(best or [0.0]) - self.log_k - np.log(max(len(words), 1))
        over = e[e >= -np.log(SIGNIFICANT)] + np.log(SIGNIFICANT)
        return float(np.clip(e.max(), -10, 30)), float(np.log1p(over.sum()))

    def score(self, text: str | None) -> float:
        if not text:
            return 0.0
        a, b = self.features(text)
        z = self.weights[0] * a + self.weights[1] * b + self.weights[2]
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, context, toxic, half: each word with its two neighbours (as a hash); what repeats among CONTEXTS_HELD of them is put out once."""
    seen: set[tuple] = set()

    def flush() -> pa.RecordBatch:
        word, context, toxic, half = zip(*seen) if seen else ((), (), (), ())
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(context, pa.int64()), pa.array(toxic, pa.int32()), pa.array(half, pa.int32())], names=["word", "context", "toxic", "half"])

    for b in batches:
        for text, y, half in zip(*(b.column(c) for c in ("text", "toxic", "half"))):
            words, y, half = tokens(text.as_py()), y.as_py(), half.as_py()
            for before, w, after in zip(["", *words], words, [*words[1:], ""]):
                seen.add((w, zlib.crc32(f"{before} {after}".encode()), y, half))
                if len(seen) >= CONTEXTS_HELD:
                    yield flush()
    yield flush()


#: Counts of the whole sample and of its two halves.
COUNTS = [(f"toxic{h}", f"clean{h}") for h in ("", "0", "1")]


def term_counts(train: DataFrame) -> DataFrame:
    """term and COUNTS: in how many contexts each word, prefix (with *) and any token ('') was seen.

    A word between the same neighbours counts once, so copies and passages that
    many documents share count like a single one.
    """
    seen = train.select("text", "toxic", "half").mapInArrow(_contexts, "word string, context long, toxic int, half int").groupBy("word", "context", "toxic").agg(F.bit_or(F.col("half") + 1).alias("halves"))
    parts = [F.lit(True), F.col("halves") != 2, F.col("halves") >= 2]
    sums = [F.count(F.when(part & (F.col("toxic") == y), 1)).alias(name) for part, names in zip(parts, COUNTS) for y, name in zip((1, 0), names)]
    words = seen.groupBy("word").agg(*sums)
    prefixes = [F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in PREFIXES]
    names = [n for pair in COUNTS for n in pair]
    terms = words.select(F.explode(F.array(F.col("word"), *prefixes, F.lit(""))).alias("term"), *names).filter("term IS NOT NULL")
    return terms.groupBy("term").agg(*(F.sum(n).alias(n) for n in names))


def informative_terms(terms: DataFrame) -> DataFrame:
    """The terms that differ from their parent, the next shorter prefix, and the root (''); with tells, tells0, tells1: by which counts."""
    core = F.rtrim("term", F.lit("*"))
    above = F.coalesce(*[F.when(F.length(core) > n, F.concat(F.substring(core, 1, n), F.lit("*"))) for n in reversed(PREFIXES)], F.lit(""))
    parents = terms.select(F.col("term").alias("above"), *(F.col(n).alias(f"of_{n}") for pair in COUNTS for n in pair))
    both = terms.withColumn("above", above).join(parents, "above")

    def differs(toxic: str, clean: str):
        a, b, x, y = (F.col(c).cast("double") for c in (toxic, clean, f"of_{toxic}", f"of_{clean}"))
        return 2 * sum(F.when(n > 0, n * F.log(n * (x + y) / (m * (a + b)))).otherwise(0.0) for n, m in ((a, x), (b, y))) >= INFORMATIVE

    tells = [(F.col("term") == "") | differs(*pair) for pair in COUNTS]
    marked = both.select("term", *(n for pair in COUNTS for n in pair), *(t.alias(f"tells{h}") for t, h in zip(tells, ("", "0", "1"))))
    return marked.filter("tells OR tells0 OR tells1")


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic, half of at most TRAIN_ROWS labelled documents that are not held out.

    The sample is the same for the same labels: the smallest hashes of doc_id. A
    document with several labels is toxic if one of them says so; of rows that repeat a doc_id the smallest text counts.
    """
    known = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # TRAIN_ROWS rows at most
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    return rows.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))


def _lexicon(rows: list) -> dict[str, float]:
    """Log-odds by term, from (term, toxic, clean), of which the term '' counts all tokens."""
    counts = {r[0]: (r[1], r[2]) for r in rows}
    toxic, clean = counts.pop("", (0, 0))
    if not toxic or not clean:
        return {}
    odds, out = {}, {}
    for term in sorted(counts, key=lambda t: (not t.endswith("*"), len(t))):  # prefixes come before what they begin
        (a, b), word = counts[term], term.rstrip("*")
        above = next((odds[p] for n in reversed(PREFIXES) if n < len(word) and (p := word[:n] + "*") in odds), 0.0)
        weight = CONCENTRATION[sum(n < len(word) for n in PREFIXES) if term.endswith("*") else -1]
        both = (a + b + 1) / (toxic + clean)
        strength = 0.1 * weight / both
        prior = np.exp(above / 2), np.exp(-above / 2)
        shares = [(n + 0.1 * weight * p * size / (toxic + clean)) / (size + strength) for n, p, size in ((a, prior[0], toxic), (b, prior[1], clean))]
        odds[term] = float(np.log(shares[0] / shares[1]))
        out[term] = float(np.clip(odds[term], -LIMIT, LIMIT) - DRIFT)
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and intercept by Newton's method, with a small ridge and balanced classes."""
    x = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(x.shape[1]), np.diag([0.02] * (x.shape[1] - 1) + [1e-4]) * len(x) * 0.01
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        w = w + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
    return w


def _profiles(halves: list[ToxicityModel]):
    """toxic, number of tokens, and the scores of all segments of each training document, by the lexicon of the other half."""

    def run(batches):
        for b in batches:
            found, sizes = [], []
            for text, half in zip(b.column("text").to_pylist(), b.column("half").to_pylist()):
                words = tokens(text)
                sizes.append(max(len(words), 1))
                found.append([s for _, _, s in segments(halves[1 - half].token_scores(words))] or [0.0])
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.float64()))], names=["toxic", "n", "scores"])

    return run


def fit_extreme_values(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(lambda, log K) of the best scores of clean documents of n tokens: S - log(n) / lambda is Gumbel; maximum likelihood over a grid."""
    fits = []
    for decay in np.linspace(0.2, 8, 196):
        z = decay * best - np.log(n)
        log_k = -np.log(np.exp(-(z - z.min())).mean()) + z.min()
        fits.append((len(z) * np.log(decay) - np.sum(z - log_k) - np.sum(np.exp(-(z - log_k))), decay, log_k))
    _, decay, log_k = max(fits)
    return float(decay), float(log_k)


def learn(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """A model from the labelled documents that are not held out; without both classes all score 0.

    What reaches the driver are the informative terms and three numbers for each of the TRAIN_ROWS documents at most.
    """
    bounded_batches(docs.sparkSession)
    train = materialize(training_rows(docs, labels), "train")
    terms = informative_terms(term_counts(train)).collect()
    lexicons = [_lexicon([(r["term"], r[toxic], r[clean]) for r in terms if r[f"tells{h}"]]) for h, (toxic, clean) in zip(("", "0", "1"), COUNTS)]
    model, *halves = (ToxicityModel(scores, -DRIFT, 1.0, 0.0, (0.0, 0.0, -40.0)) for scores in lexicons)
    if not all(lexicons):  # a class is missing, in a half at least
        halves = [model, model]
    profiles = materialize(train.select("text", "toxic", "half").mapInArrow(_profiles(halves), "toxic int, n long, scores array<double>"), "profiles")
    release(train)
    found = profiles.select("toxic", "n", F.array_max("scores")).toPandas().to_numpy(dtype=float) if model.scores else np.zeros((0, 3))
    y = found[:, 0]
    if len(y) and y.min() < y.max():
        model.decay, model.log_k = fit_extreme_values(found[y == 0, 2], found[y == 0, 1])
        e = F.transform("scores", lambda s: F.lit(model.decay) * s - F.lit(model.log_k) - F.log("n"))
        over = F.aggregate(e, F.lit(0.0), lambda total, x: total + F.greatest(x + F.lit(float(np.log(SIGNIFICANT))), F.lit(0.0)))
        rows = profiles.select("toxic", F.least(F.greatest(F.array_max(e), F.lit(-10.0)), F.lit(30.0)), F.log1p(over)).toPandas().to_numpy(dtype=float)
        model.weights = tuple(_logistic(rows[:, 1:], rows[:, 0]).tolist())
    release(profiles)
    return model


def _scored(model: ToxicityModel, names: list[str]):
    def run(batches):
        for b in batches:
            s = [model.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(s, pa.float64())], names=[*names, "toxicity"])

    return run


def score_documents(docs: DataFrame, model: ToxicityModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns of keep and toxicity (0 to 1) for every row of docs; null and empty texts score 0.

    Every row is scored by its own text alone, so repeated rows score alike and there are no ties to break.
    docs may hold further columns of any name; they are left out. An empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(*(F.col(c) for c in dict.fromkeys([*keep, text_col])))
    rows = rows if text_col == "text" else rows.withColumn("text", F.col(text_col))
    kept = StructType([docs.schema[c] for c in keep] + [StructField("toxicity", DoubleType())])
    return rows.mapInArrow(_scored(model, keep), kept)


THRESHOLD = 0.7


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for the whole of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_documents(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
