"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Words are what an expression is made of; a class's model gives each character of a word a probability after the
ORDER - 1 characters before it, by absolute discounting of that class's counts. The mass that discounting sets free goes
to a backoff distribution that both classes share: Kneser-Ney continuation counts of the shorter contexts, pooled over
the classes. So a rare expression is smoothed alike in both and says little, and an expression that only toxic
texts use stands out, in any language and with unseen endings. Evidence is the difference of the log-likelihoods under the two
models a character, of a word or of a whole text. A text's score is a logistic function of its own, of its strongest word's, in which a
single expression in a long text is not lost, and of the mean over its distinct words.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolens.llm.base import byte_texts, narrow, slices

ORDER = 5
DISCOUNT = 0.75
#: Labelled documents of each class that the model is fitted on, in expectation: a bounded sample.
SAMPLE_DOCS = 8000
#: Score from which a document is predicted toxic.
THRESHOLD = 0.7
FEATURES = ["top", "mean", "whole"]
#: Words whose evidence a worker keeps at hand.
KEPT_WORDS = 100_000

_MARKS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or c == 39 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_MARKS).split()


def padded(word: bytes) -> str:
    return "^" + word.decode("utf-8", "replace").lower() + "$"


def grams(word: str, order: int = ORDER) -> Iterator[str]:
    """Each character of a padded word but the first, behind at most order - 1 others."""
    for k in range(1, len(word)):
        yield word[max(0, k - order + 1) : k + 1]


@dataclass(frozen=True)
class ToxicityModel:
    """known: log-likelihood difference of each seen gram; context: of an unseen gram, by its context."""

    known: dict[str, float]
    context: dict[str, float]
    weights: tuple[float, ...]


def kneser_ney(counts: dict[str, tuple[int, int]], discount: float = DISCOUNT) -> tuple[dict[str, float], dict[str, float]]:
    """Differences toxic - ordinary from gram counts (ordinary, toxic), for grams and for contexts."""
    shared = _Shared(counts, discount)
    totals: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
    for gram, pair in counts.items():
        t = totals[gram[:-1]]
        for c in (0, 1):
            t[c] += pair[c]
            t[2 + c] += pair[c] > 0
    free = {}
    for context, (a, b, na, nb) in totals.items():
        free[context] = tuple((discount * n / m) if m else 1.0 for n, m in ((na, a), (nb, b)))
    known = {}
    for gram, pair in counts.items():
        context, below = gram[:-1], shared.probability(gram[1:])
        p = [max(0.0, pair[c] - discount) / totals[context][c] * bool(totals[context][c]) + free[context][c] * below if totals[context][c] else below for c in (0, 1)]
        known[gram] = math.log(p[1] / p[0])
    return known, {c: math.log(f[1] / f[0]) for c, f in free.items()}


class _Shared:
    """Interpolated continuation probabilities, pooled over both classes: how many different characters precede a gram."""

    def __init__(self, counts: dict[str, tuple[int, int]], discount: float):
        self.discount = discount
        # A gram can be the end of several longer ones, of any length, and is one gram all the same.
        every = {g[k:] for g in counts for k in range(len(g) - 1)}
        self.found = Counter(g[1:] for g in every)
        self.sums, self.kinds = Counter(), Counter()
        for g, n in self.found.items():
            self.sums[g[:-1]] += n
            self.kinds[g[:-1]] += 1
        self.memo: dict[str, float] = {"": 1.0 / max(1, len({g[-1] for g in counts}))}

    def probability(self, gram: str) -> float:
        if gram not in self.memo:
            context, below = gram[:-1], self.probability(gram[1:])
            total = self.sums.get(context, 0)
            self.memo[gram] = (max(0.0, self.found.get(gram, 0) - self.discount) + self.discount * self.kinds[context] * below) / total if total else below
        return self.memo[gram]


class Scorer:
    """Features of texts under a model, with a bounded memory of words."""

    def __init__(self, known: dict[str, float], context: dict[str, float], kept: int = KEPT_WORDS):
        self.known, self.context, self.kept, self.memory = known, context, kept, {}

    def word(self, raw: bytes) -> float:
        word, total, known, context = padded(raw), 0.0, self.known, self.context
        for gram in grams(word):
            value = known.get(gram)
            total += context.get(gram[:-1], 0.0) if value is None else value
        return total / (len(word) - 1)

    def features(self, text: bytes) -> tuple[float, float, float]:
        """The strongest word's evidence, the mean over all distinct words, and the whole text's; zeros where there are no words."""
        words, memory = Counter(words_of(text)), self.memory
        if not words:
            return 0.0, 0.0, 0.0
        top, plain, total, size = -math.inf, 0.0, 0.0, 0
        for raw, n in words.items():
            found = memory.get(raw)
            if found is None:
                found = self.word(raw), len(padded(raw)) - 1
                if len(memory) < self.kept:
                    memory[raw] = found
            value, length = found
            top = max(top, value)
            plain += value
            total += n * length * value
            size += n * length
        return top, plain / len(words), total / size


def score_of(features: tuple[float, ...], weights: tuple[float, ...]) -> float:
    x = weights[0] + sum(w * f for w, f in zip(weights[1:], features, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def logistic(rows: np.ndarray, labels: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, ...]:
    """Weights by Newton's method, intercept first; the classes weigh alike."""
    x = np.hstack([np.ones((len(rows), 1)), rows])
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - labels)) + ridge * w
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, gradient)
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, sample: int = SAMPLE_DOCS) -> ToxicityModel:
    """A model from labelled documents that `learn` (on doc_id) selects; null labels and null texts teach nothing.

    About `sample` documents of each class are taken, by the hash of their id, and a word counts once a document. The
    logistic weights come from one half of them, again by hash, under the counts of the other half; the model
    then has the counts of both. Counts are made on the executors; what reaches the driver is bounded by the sample.
    """
    marks = labels.where(learn).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    span = 1 << 40
    shares = {k: int(span * min(1.0, sample / n)) for k, n in totals.items()}
    order = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(span))
    bound = F.when(F.col("toxic") == 1, F.lit(shares.get(1, 0))).otherwise(F.lit(shares.get(0, 0)))
    picked = marks.where(order < bound)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").where(learn)
    rows = texts.join(F.broadcast(picked), "doc_id").withColumn("half", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(2)), F.lit(2)).cast("int"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = defaultdict(Counter)
        for batch in slices(batches):
            for text, toxic, half in zip(byte_texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for word in set(words_of(text)):
                    seen[2 * half + toxic].update(grams(padded(word)))
        for slot, found in seen.items():
            every = list(found.items())
            for at in range(0, len(every), 10_000):
                part = every[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([slot] * len(part), pa.int32()), pa.array([g for g, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["slot", "gram", "n"])

    counted = rows.select("text", "toxic", "half").mapInArrow(count, "slot int, gram string, n long").groupBy("gram")
    table = counted.agg(*(F.sum(F.when(F.col("slot") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4))).toArrow()
    every = table.column("gram").to_pylist()
    n0, n1, n2, n3 = (table.column(f"n{k}").to_pylist() for k in range(4))
    one_half = {g: (a, b) for g, a, b in zip(every, n0, n1, strict=True) if a or b}
    shared = docs.sparkSession.sparkContext.broadcast(kneser_ney(one_half))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in slices(batches):
            found = [scorer.features(x) for x in byte_texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([f[k] for f in found], pa.float64()) for k in range(3))], ["toxic", *FEATURES])

    seen = rows.where("half = 1").select("text", "toxic").mapInArrow(measure, "toxic int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    shared.unpersist()
    y = seen["toxic"].to_numpy()
    weights = logistic(seen[FEATURES].to_numpy(), y) if len(set(y)) == 2 else (-2.0, *[0.0] * len(FEATURES))
    known, context = kneser_ney({g: (a + c, b + d) for g, a, b, c, d in zip(every, n0, n1, n2, n3, strict=True)})
    return ToxicityModel(known, context, weights)


def toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted, top_word), one row for each input row.

    score is 0 to 1, predicted 1 from `threshold` on, top_word the strongest word's evidence. Null, empty and wordless texts
    are scored with no evidence. A model from one class or from nothing scores all texts alike and predicts 0.
    Ids are carried as they are, null and repeated ones too; other columns are ignored.
    """
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast((model.known, model.context))
    weights = model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in slices(batches):
            found = [scorer.features(x) for x in byte_texts(batch.column(1))]
            scores = [score_of(f, weights) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([f[0] for f in found], pa.float64())],
                ["doc_id", "score", "predicted", "top_word"],
            )

    return narrow(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double, predicted int, top_word double")


def accepted(docs: DataFrame, model: ToxicityModel, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, a table with a text column, that are not predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model.known, model.context))
    weights, names = model.weights, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in slices(batches):
            keep = [score_of(scorer.features(x), weights) < threshold for x in byte_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns], names)

    return docs.mapInArrow(run, docs.schema)
