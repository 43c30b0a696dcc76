"""Severity of toxic language by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w . x - t_k): one weight vector shared by all grades and rising thresholds t_0 < t_1 < ... The
features x are the logarithms of the counts of words and of words' beginnings. Weights are fitted with follow-the-regularised-leader steps and an
elastic net, so only telling words keep one; the thresholds' gaps are kept positive. The fit takes a bounded sample
of labelled documents (`Settings.sample_per_grade` of each grade, the ones whose hashed id is smallest) and then
scores every document over its whole text. The expected severity is the sum over k of P(grade > k).

Where labels only say toxic or not, `Settings.divide` makes two grades of the highest: below and from the sample's
median on of how often telling features, those that go with toxic beyond chance, occur.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, table

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    sample_per_grade: int = 1000
    least_documents: int = 3  # of the sample a feature must be in
    association: float = 5.0  # z-score of a feature's share of documents above grade 0 against its share at grade 0
    divide: bool = True
    epochs: int = 30
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.002
    rate: float = 0.02  # of the thresholds


def features(word: str) -> list[str]:
    """The word, and its beginnings of 3 to 5 letters, marked by a hyphen, that no word holds."""
    return [word, *(word[:n] + "-" for n in (3, 4, 5) if len(word) > n)]


def feature_counts(text: str) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        for f in features(word):
            out[f] += n
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def exceed(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each k."""
        weights, found = self.weights, Counter()
        for word, n in Counter(WORD.findall((text or "").lower())).items():
            if word in weights:
                found[word] += n
            if len(word) > 3 and word[:3] in self.stems:
                for f in features(word)[1:]:
                    if f in weights:
                        found[f] += n
        return _sigmoid(sum(weights[f] * np.log1p(n) for f, n in found.items()) - np.array(self.thresholds))

    @cached_property
    def stems(self) -> frozenset[str]:
        """The first three letters of all beginnings with a weight."""
        return frozenset(f[:3] for f in self.weights if f[-1] == "-")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, grades: int, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from (features, values, grade); the likelihood of a grade is the difference of two
    neighbouring cumulative probabilities."""
    z, n = np.zeros(size), np.zeros(size)
    share = np.bincount([y for *_, y in rows], minlength=grades) / max(1, len(rows))
    above = np.clip(1 - np.cumsum(share)[:-1], 1e-3, 1 - 1e-3)
    t = -np.log(above / (1 - above))  # the thresholds that fit without features
    first, gaps = t[0], np.log(np.maximum(np.diff(t), 1e-2))
    order = np.random.default_rng(11)

    def weight(z, n):
        return np.where(np.abs(z) <= s.l1, 0.0, (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for i in order.permutation(len(rows)):
            where, x, y = rows[i]
            w = weight(z[where], n[where])
            t = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
            p = _sigmoid(w @ x - t)
            low, high = (p[y] if y < grades - 1 else 0.0), (p[y - 1] if y else 1.0)
            mass = max(high - low, 1e-12)
            d_low, d_high = low * (1 - low), high * (1 - high)
            g_score = -(d_high - d_low) / mass
            g = g_score * x
            step = (np.sqrt(n[where] + g * g) - np.sqrt(n[where])) / s.alpha
            z[where] += g - step * w
            n[where] += g * g
            g_t = np.zeros(grades - 1)
            if y:
                g_t[y - 1] += d_high / mass
            if y < grades - 1:
                g_t[y] -= d_low / mass
            first -= s.rate * g_t.sum()
            gaps -= s.rate * np.exp(gaps) * np.cumsum(g_t[::-1])[::-1][1:]
    return weight(z, n), first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Learn from docs (doc_id, text) with labels (doc_id, grade: 0, 1, ...).

    Rows with a null id, text or grade do not count; a document with several grades takes the highest. None if fewer
    than two grades are left. If a grade between is missing, its threshold stands close to the next.
    """
    graded = labels.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    sizes = {r["grade"]: r["n"] for r in graded.groupBy("grade").agg(F.count("*").alias("n")).collect()}  # a row for each grade
    if len(sizes) < 2:
        return None
    share = F.lit(0.0)
    for grade, n in sizes.items():
        share = F.when(F.col("grade") == grade, min(1.0, 2 * settings.sample_per_grade / n)).otherwise(share)
    rank = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    chosen = graded.withColumn("rank", rank).where(F.col("rank") < share)  # about twice the documented bound for each grade

    def count(batches):
        for batch in batches:
            words = [feature_counts(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("grade"), batch.column("rank"), batch.column("doc_id"), pa.array(["\n".join(c) for c in words]), pa.array([[*c.values()] for c in words], pa.list_(pa.int32()))],
                names=["grade", "rank", "doc_id", "words", "counts"],
            )

    kept = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen.select(F.col("doc_id").cast("long"), "grade", "rank")), "doc_id")
    sample: dict[int, list] = {}
    seen = set()
    for r in kept.mapInArrow(lean(count), "grade int, rank double, doc_id long, words string, counts array<int>").orderBy("rank", "doc_id", "words").toLocalIterator():
        if r["doc_id"] not in seen and len(part := sample.setdefault(r["grade"], [])) < settings.sample_per_grade:
            seen.add(r["doc_id"])
            part.append((r["words"].split("\n") if r["words"] else [], r["counts"]))
    if len(sample) < 2:
        return None
    telling = _telling(sample, settings)
    place = {w: i for i, w in enumerate(telling)}
    if settings.divide and len(sample) == 2:
        top = max(sample)
        marks = {w for w, up in telling.items() if up}
        amounts = [sum(c for w, c in zip(*row) if w in marks) for row in sample[top]]
        middle = max(1, np.median(amounts))
        sample[top + 1] = [row for row, n in zip(sample[top], amounts) if n > middle]
        sample[top] = [row for row, n in zip(sample[top], amounts) if n <= middle]
        if not sample[top + 1]:
            del sample[top + 1]
    rows = []
    for grade, part in sorted(sample.items()):
        for words, counts in part:
            found = [(place[w], c) for w, c in zip(words, counts) if w in place]
            rows.append((np.array([i for i, _ in found], int), np.log1p([c for _, c in found]), grade))
    weights, thresholds = fit(rows, len(place), max(sample) + 1, settings)
    return Model({w: float(weights[i]) for w, i in place.items() if weights[i]}, tuple(map(float, thresholds)))


def _telling(sample: dict[int, list], s: Settings) -> dict[str, bool]:
    """Features whose presence goes with a grade above the lowest (true) or against it (false), beyond chance."""
    base = min(sample)
    low = Counter(w for words, _ in sample[base] for w in words)
    high = Counter(w for grade, part in sample.items() if grade > base for words, _ in part for w in words)
    n_low, n_high = len(sample[base]), sum(len(part) for grade, part in sample.items() if grade > base)
    out = {}
    for w in sorted(low.keys() | high.keys()):
        share = (low[w] + high[w]) / (n_low + n_high)
        spread = np.sqrt(share * (1 - share) * (1 / n_low + 1 / n_high))
        if low[w] + high[w] >= s.least_documents and abs(high[w] / n_high - low[w] / n_low) >= s.association * spread:
            out[w] = high[w] / n_high > low[w] / n_low
    return out


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with expected_severity (double), grade (int; the likeliest) and toxic (boolean; P(grade > 0) >= 1/2) added.

    Columns under these names are replaced. A null or empty text has severity 0, as has every text without a model.
    """
    kept = docs.drop("expected_severity", "grade", "toxic")

    def run(batches):
        for batch in batches:
            expected, grades, toxic = [], [], []
            for text in batch.column("text").to_pylist():
                p = model.exceed(text) if model is not None and text else np.zeros(1)
                expected.append(float(p.sum()))
                grades.append(int(np.argmax(-np.diff(p, prepend=1.0, append=0.0))))
                toxic.append(bool(p[0] >= 0.5))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected, pa.float64()), pa.array(grades, pa.int32()), pa.array(toxic, pa.bool_())], names=[*batch.schema.names, "expected_severity", "grade", "toxic"])

    return kept.mapInArrow(lean(run), T.StructType([*kept.schema.fields, T.StructField("expected_severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade"))
    return predict(docs, train(docs, labels)).select("doc_id", "expected_severity", "grade", "toxic")
