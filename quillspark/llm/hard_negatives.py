"""Hard negatives by a vector-approximation file.

Components are integers; each dimension's range is divided into `Settings.cells` cells of even width over the bulk of its
values, with the outermost cells reaching to its smallest and largest. The file holds, for each vector, one cell number for
each dimension, and behind them the exact components. Anchors come in blocks of bounded size. For a block, two tables hold
for each dimension and cell the least and the largest product with each anchor's component, so that the sum of what is
looked up bounds a score from below and above. Only pairs whose bounds can still enter the positives found so far, or a
window of scores around a positive, are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, materialise, release, shared_folder, table

NONE = np.int64(-np.iinfo(np.int64).max)  # typed, so that it widens what it meets
#: Stands for a null id, which comes last among equal scores.
NULL_ID = np.iinfo(np.int64).max
FOUND = "anchor int, slot int, id long, score long"


@dataclass(frozen=True)
class Settings:
    scale: int = 256
    every: int = 50  # anchors are the ids divisible by it
    positives: int = 5
    negatives: int = 3
    low: int = 50  # per cent of the positive's score
    high: int = 95
    cells: int = 256
    spread: float = 4.0  # standard deviations on either side of the mean that cells of even width cover
    block: int = 1536  # anchors a pass
    rows: int = 256  # vectors looked up at once


def vectors(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """vec_id, label and q (the integer components) of the rows that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    q = F.transform("embedding", lambda x: F.floor(F.lit(float(s.scale)) * x.cast("double")))
    return rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), moved.cast("long").alias("label"), q.alias("q"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros, which change no product."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def edges(found: DataFrame, s: Settings) -> np.ndarray:
    """First value of each cell, for each dimension, and one past the last: a row of the driver for each dimension."""

    def run(batches):
        for batch in batches:
            q = batch.column("q")
            width = max([0, *q.value_lengths().to_pylist()])
            x = matrix(q, width)
            if width and len(x):
                one = [np.arange(width), np.full(width, len(x)), x.min(0), x.max(0), x.sum(0, dtype=float), (x.astype(float) ** 2).sum(0)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, one)], names=["at", "n", "least", "most", "total", "squares"])

    sums = {c: F.sum(c) for c in ("n", "total", "squares")} | {"least": F.min("least"), "most": F.max("most")}
    each = found.select("q").mapInArrow(lean(run), "at long, n long, least long, most long, total double, squares double")
    rows = sorted(each.groupBy("at").agg(*(v.alias(k) for k, v in sums.items())).collect())
    if sum(max(abs(r["least"]), abs(r["most"])) ** 2 for r in rows) * 100 >= 1 << 63:
        raise ValueError("scores of these vectors pass 64 bits")
    out = np.zeros((len(rows), s.cells + 1), np.int64)
    for r in rows:
        least, most = (min(r["least"], 0), max(r["most"], 0)) if r["n"] < rows[0]["n"] else (r["least"], r["most"])  # short vectors hold zeros
        mean = r["total"] / r["n"]
        wide = s.spread * max(0.0, r["squares"] / r["n"] - mean * mean) ** 0.5
        inner = np.linspace(max(least, mean - wide), min(most, mean + wide) + 1, s.cells - 1).astype(np.int64)
        out[r["at"]] = np.clip([least, *inner, most + 1], least, most + 1)
    return out


def index(found: DataFrame, at: np.ndarray, s: Settings = Settings()) -> DataFrame:
    """The file: vec_id, label, cells (one byte a dimension) and exact (little-endian 32- or 64-bit integers)."""
    kind = exact_type(at)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("q"), len(at))
            cells = np.empty(x.shape, np.uint8)
            for d in range(len(at)):
                cells[:, d] = np.searchsorted(at[d, 1:-1], x[:, d], "right")
            binary = (pa.array([r.tobytes() for r in m], pa.binary()) for m in (cells, x.astype(kind)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *binary], names=["vec_id", "label", "cells", "exact"])

    return found.mapInArrow(lean(run), "vec_id long, label long, cells binary, exact binary")


def exact_type(at: np.ndarray) -> str:
    return "<i4" if not at.size or np.abs(at).max() < 1 << 31 else "<i8"


class Block:
    """Some anchors: ids, labels, vectors, and the tables that bound their scores."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, at: np.ndarray):
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels, self.x, self.at = ids[order], labels[order], x[order], at

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """For each dimension, cell and anchor the least and the largest product."""
        kind = np.int32 if (np.abs(self.at).max(1, initial=0).astype(float) ** 2).sum() < 1 << 30 else np.int64
        x, first, last = self.x.T.astype(kind)[:, None, :], self.at[:, :-1, None].astype(kind), (self.at[:, 1:, None] - 1).astype(kind)
        a, b = x * first, x * last
        return np.minimum(a, b), np.maximum(a, b)


def looked_up(part: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Sums over the dimensions of part[dimension, cell]."""
    out = np.zeros((len(cells), part.shape[2]), part.dtype)
    for d in range(len(part)):
        out += part[d].take(cells[:, d], 0)
    return out


def batches_of(batches, width: int, kind: str, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            ids = part.column("vec_id").fill_null(NULL_ID).to_numpy()
            n = part.num_rows
            cells = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint8).reshape(n, width)
            exact = np.frombuffer(b"".join(part.column("exact").to_pylist()), kind).reshape(n, width)
            yield ids, part.column("label").to_numpy(), cells, exact


class Best:
    """The first k of each group by score, then id."""

    def __init__(self, groups: int, k: int):
        self.k, self.scores, self.ids = k, np.full((groups, k), NONE), np.full((groups, k), NULL_ID)

    @property
    def least(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        fits = score >= self.least[group]
        group, score, ids = group[fits], score[fits], ids[fits]
        if not len(group):
            return
        touched = np.unique(group)
        group = np.concatenate((group, np.repeat(touched, self.k)))
        score, ids = np.concatenate((score, self.scores[touched].ravel())), np.concatenate((ids, self.ids[touched].ravel()))
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        place = np.arange(len(group)) - np.searchsorted(group, group, "left")
        kept = place < self.k
        self.scores[group[kept], place[kept]], self.ids[group[kept], place[kept]] = score[kept], ids[kept]

    def batch(self, slots: int) -> pa.RecordBatch:
        group, place = np.nonzero(self.scores != NONE)
        columns = [pa.array((group // slots).astype(np.int32)), pa.array((group % slots).astype(np.int32)), pa.array(self.ids[group, place]), pa.array(self.scores[group, place])]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "slot", "id", "score"])


def exact_scores(rows: np.ndarray, anchors: np.ndarray, row: np.ndarray, column: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[slice, np.ndarray]]:
    """Integer inner products of the named pairs, some at a time."""
    for at in range(0, len(row), most):
        part = slice(at, at + most)
        yield part, np.einsum("ij,ij->i", rows[row[part]].astype(np.int64), anchors[column[part]])


def _kth(lower: np.ndarray, sure: np.ndarray, k: int) -> np.ndarray:
    """For each anchor the k-th largest lower bound among sure pairs."""
    return np.partition(np.where(sure, lower, NONE), -k, axis=0)[-k] if len(lower) >= k else np.full(lower.shape[1], NONE)


def positives(file: DataFrame, held, at: np.ndarray, s: Settings) -> DataFrame:
    """anchor, slot, id and score of the first other vectors of each anchor's label, as far as each task sees."""
    width, kind = len(at), exact_type(at)

    def run(batches):
        b = held.value
        tables = b.tables()
        spans = {n: slice(*np.searchsorted(b.labels, [n, n + 1])) for n in np.unique(b.labels).tolist()}
        of = {n: [np.ascontiguousarray(t[:, :, x]) for t in tables] for n, x in spans.items()}
        del tables
        best = Best(len(b.ids), s.positives)
        for ids, labels, cells, exact in batches_of(batches, width, kind, 16 * s.rows):
            for n in np.unique(labels).tolist():
                if n not in spans:
                    continue
                rows, span = np.flatnonzero(labels == n), spans[n]
                other = ids[rows, None] != b.ids[span]
                need = best.least[span]
                if (need == NONE).all():
                    need = np.maximum(need, _kth(looked_up(of[n][0], cells[rows]), other, s.positives))
                row, column = np.nonzero(other & (looked_up(of[n][1], cells[rows]) >= need))
                row, column = rows[row], column + span.start
                for part, score in exact_scores(exact, b.x, row, column):
                    best.add(column[part], score, ids[row[part]])
        yield best.batch(1)

    return _first(file.mapInArrow(lean(run), FOUND), s.positives)


def negatives(file: DataFrame, held, at: np.ndarray, s: Settings) -> DataFrame:
    """anchor, slot (of the positive), rank, id and score of the first vectors of other labels in each window."""
    width, kind = len(at), exact_type(at)

    def run(batches):
        b, least, most = held.value
        low, high = b.tables()
        slots = least.shape[1]
        best, fresh = Best(least.size, s.negatives), True
        for ids, labels, cells, exact in batches_of(batches, width, kind, s.rows):
            lower, upper = looked_up(low, cells), looked_up(high, cells)
            other = labels[:, None] != b.labels
            maybe = np.zeros(other.shape, bool)
            for i in range(slots):
                need = np.maximum(least[:, i], best.least[i::slots])
                if fresh:
                    need = np.maximum(need, _kth(lower, other & (lower >= least[:, i]) & (upper <= most[:, i]), s.negatives))
                maybe |= (upper >= need) & (lower <= most[:, i])
            fresh = False
            row, column = np.nonzero(maybe & other)
            for part, score in exact_scores(exact, b.x, row, column):
                r, c = row[part], column[part]
                for i in range(slots):
                    inside = (score >= least[c, i]) & (score <= most[c, i])
                    best.add(c[inside] * slots + i, score[inside], ids[r[inside]])
        yield best.batch(slots)

    return _first(file.mapInArrow(lean(run), FOUND), s.negatives)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of what the tasks found, of which each gave k at most."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for rows (vec_id, embedding, label).

    Rows with a null label, a null vector or a component that is null or not finite take no part. A row is another row than
    the anchor if its id is another; ids that repeat are rows of their own, but equal anchors count once. A null id is never
    an anchor and comes last among equal scores. Vectors of different lengths are compared as if zeros followed the shorter
    one. Scores that could pass 64 bits raise an error. An empty table gives no row, and other columns are not read.
    """
    spark = rows.sparkSession
    found = vectors(rows, s)
    at = edges(found, s)
    file = materialise(index(found, at, s), "va-file", scan=True)
    anchors = materialise(file.where(F.col("vec_id") % s.every == 0).select("vec_id", "label", "exact").distinct(), "anchors")
    folder, number = shared_folder(spark, "hard-negatives"), 0
    pending = anchors.toLocalIterator()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    while taken := [*islice(pending, s.block)]:
        x = np.frombuffer(b"".join(r["exact"] for r in taken), exact_type(at)).reshape(len(taken), len(at)).astype(np.int64)
        block = Block(np.array([r["vec_id"] for r in taken]), np.array([r["label"] for r in taken]), x, at)
        shared = spark.sparkContext.broadcast(block)
        near = positives(file, shared, at, s).toArrow()  # `positives` rows for each anchor of the block
        shared.unpersist()
        anchor, slot, ids, score = near.column("anchor").to_numpy(), near.column("rank").to_numpy() - 1, near.column("id").to_numpy(), near.column("score").to_numpy()
        least, most = np.ones((len(taken), s.positives), np.int64), np.zeros((len(taken), s.positives), np.int64)
        least[anchor, slot], most[anchor, slot] = -(-s.low * score // 100), s.high * score // 100
        shared = spark.sparkContext.broadcast((block, least, most))
        known = [*zip(anchor.tolist(), slot.tolist(), block.ids[anchor].tolist(), ids.tolist(), score.tolist())]
        about = spark.createDataFrame(known, "anchor int, slot int, anchor_id long, positive_id long, positive_score long")
        whole = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
        out = negatives(file, shared, at, s).join(F.broadcast(about), ["anchor", "slot"])
        out = out.select("anchor_id", whole("positive_id").alias("positive_id"), "rank", whole("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.coalesce(2 * spark.sparkContext.defaultParallelism).write.parquet(f"{folder}/block={number}")
        shared.unpersist()
        number += 1
    release(file, anchors)
    return spark.read.schema(schema).parquet(f"{folder}/block=*") if number else spark.createDataFrame([], schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, e.vec_id, e.label = a.label AS same, list_inner_product(a.q, e.q)::BIGINT AS score
  FROM e AS a JOIN e ON e.vec_id IS DISTINCT FROM a.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
