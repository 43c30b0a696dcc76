"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Documents become sparse vectors of hashed character 1- to 3-grams. Document frequencies cover all
training rows; the weights are fitted on a bounded sample (`Settings.sample_per_language` rows of each
language, the ones whose hashed id is smallest) with follow-the-regularised-leader and an elastic net;
a temperature fitted on a part of the sample that the weights never saw calibrates the scores.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fold, lean, shared_folder, table

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 15
    longest_gram: int = 3
    block: int = 1 << 20  # characters counted at once
    sample_per_language: int = 400
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05
    calibration_share: float = 0.25


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # languages x buckets
    bias: np.ndarray
    temperature: float
    settings: Settings


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str, settings: Settings) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of the text's character n-grams; None if it has no letter.

    Every run of other characters counts as one space; texts of any length are taken whole, in blocks that each go on
    from the last characters of the one before.
    """
    counts, size, seen = np.zeros(settings.buckets, np.int64), settings.block, False
    low, last = text.lower(), np.empty(0, np.uint64)
    for at in range(0, len(low), size):
        points = np.frombuffer(low[at : at + size].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[points]
        seen = seen or bool(letter.any())
        points = np.where(letter, points, 32).astype(np.uint64)
        points = np.concatenate((last, [32] if at == 0 else [], points, [32] if at + size >= len(low) else [])).astype(np.uint64)
        points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
        value = np.zeros(len(points), np.uint64)
        for n in range(1, settings.longest_gram + 1):
            value = value[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
            mixed = value[max(0, len(last) - n + 1) :] * np.uint64(0x9E3779B97F4A7C15)
            counts += np.bincount((mixed >> np.uint64(40)).astype(np.int64) % settings.buckets, minlength=settings.buckets)
            if len(value) <= 1:
                break
        last = points[max(0, len(points) - settings.longest_gram + 1) :] if settings.longest_gram > 1 else points[:0]
    where = np.flatnonzero(counts)
    return (where, counts[where]) if seen else None


def _vector(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    where, count = found
    value = (1 + np.log(count)) * idf[where]
    return where, value / np.sqrt((value * value).sum())


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by per-coordinate FTRL-proximal steps; the bias carries no penalty."""
    z, n = np.zeros((n_classes, s.buckets)), np.zeros((n_classes, s.buckets))
    zb, nb = np.zeros(n_classes), np.zeros(n_classes)

    def weight(z, n, l1, l2):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for i in order.permutation(len(rows)):
            where, x, y = rows[i]
            zi, ni = z[:, where], n[:, where]
            w, b = weight(zi, ni, s.l1, s.l2), weight(zb, nb, 0, 0)
            error = _softmax(w @ x + b)
            error[y] -= 1
            g = error[:, None] * x
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / s.alpha
            z[:, where], n[:, where] = zi + g - step * w, ni + g * g
            zb += error - (np.sqrt(nb + error * error) - np.sqrt(nb)) / s.alpha * b
            nb += error * error
    return weight(z, n, s.l1, s.l2), weight(zb, nb, 0, 0)


def fit_temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The divisor of the logits that makes the truth most likely."""

    def loss(t: float) -> float:
        x = logits / t
        top = x.max(1, keepdims=True)
        return float((np.log(np.exp(x - top).sum(1)) + top[:, 0] - x[np.arange(len(truth)), truth]).mean())

    return min(np.exp(np.linspace(np.log(0.05), np.log(5), 93)), key=loss) if len(truth) else 1.0


def train(docs: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Learn from every row of docs (doc_id, text, lang) whose text and lang are not null.

    Returns None if there is no such row with a letter. Ties in the sample fall by hash, then by id.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.lit(0.0)
    for lang, n in sizes.items():  # one entry for each language, not for each row
        share = F.when(F.col("lang") == lang, min(1.0, 2 * settings.sample_per_language / n)).otherwise(share)
    rank = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.withColumn("rank", rank).withColumn("sampled", F.col("rank") < share)

    def scan(batches):
        seen, total = np.zeros(settings.buckets, np.int64), 0
        for batch in batches:
            out = []
            for doc_id, text, lang, r, sampled in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang", "rank", "sampled"))):
                if (found := grams(text, settings)) is None:
                    continue
                seen[found[0]] += 1
                total += 1
                if sampled:
                    out.append((-1, 0, doc_id, lang, r, found[0].astype("<i4").tobytes(), found[1].astype("<i4").tobytes()))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema=schema)
        where = np.flatnonzero(seen)
        n = len(where) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(where, settings.buckets), pa.int32()), pa.array(np.append(seen[where], total), pa.int64()), *(pa.nulls(n, t) for t in schema.types[2:])], schema=schema
        )

    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("rank", pa.float64()), ("gram", pa.binary()), ("tf", pa.binary())])
    path = shared_folder(spark, "language-id")
    rows.mapInArrow(lean(scan), "bucket int, n long, doc_id long, lang string, rank double, gram binary, tf binary").write.parquet(path)
    scanned = spark.read.parquet(path)
    seen = np.zeros(settings.buckets + 1, np.int64)
    for r in scanned.where("bucket >= 0").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        seen[r["bucket"]] = r["n"]
    sample: dict[str, list] = {}
    for r in scanned.where("bucket < 0").orderBy("rank", "doc_id").collect():  # about twice the documented bound for each language
        if len(kept := sample.setdefault(r["lang"], [])) < settings.sample_per_language:
            kept.append((np.frombuffer(r["gram"], "<i4"), np.frombuffer(r["tf"], "<i4")))
    discard(spark, path)
    if not sample:
        return None
    languages = tuple(sorted(sample))
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    every = max(2, round(1 / settings.calibration_share))
    parts: tuple[list, list] = [], []
    for y, lang in enumerate(languages):
        for i, found in enumerate(sample[lang]):
            parts[i % every == every - 1].append((*_vector(found, idf), y))
    weights, bias = fit_ftrl(parts[0], len(languages), settings)
    logits = np.array([weights[:, w] @ x + bias for w, x, _ in parts[1]]).reshape(-1, len(languages))
    temperature = fit_temperature(logits, np.array([y for *_, y in parts[1]], int))
    return Model(languages, idf.astype("f4"), weights.astype("f4"), bias, float(temperature), settings)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score added; only the text column is looked at.

    A null text, one without a letter, or no model gives `und` with score 0. Columns that docs already has
    under these names are replaced.
    """
    kept = docs.drop("lang_pred", "score")

    def scored(batches):
        for batch in batches:
            names, scores = [], []
            for text in batch.column("text").to_pylist():
                found = grams(text, model.settings) if model is not None and text else None
                if found is None:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                where, x = _vector(found, model.idf)
                p = _softmax((model.weights[:, where] @ x + model.bias) / model.temperature)
                best = int(p.argmax())
                names.append(model.languages[best])
                scores.append(min(1.0, float(p[best])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(lean(scored), T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(fold(F.col("doc_id"), 4) != 2))
    rows = predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which some learned language holds at least half of the probability stay, unchanged and with all
    their columns, repeated rows and rows without an id among them. Null and empty texts, texts without a letter and, if
    no row has a language to learn from, all texts are undetermined and go; an empty table gives an empty result."""
    model = train(docs)
    return predict(docs, model).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= 0.5)).select(*docs.columns)
