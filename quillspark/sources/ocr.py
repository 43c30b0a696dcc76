"""Page recognition by injected engines: words with confidence, errors as rows, and runs that can be taken up again.

No engine is part of this library. An engine is made by a function without arguments, once for each Python worker and run,
and reads one page's bytes: a list of (box, text, confidence) or (box, text), where box is a list of points.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from quillspark.functions import scalars as X

WORDS = "array<struct<text:string,x0:double,y0:double,x1:double,y1:double,confidence:double>>"
#: The confidence of a word whose engine gives none.
UNRATED = 0.5


class Engine(Protocol):
    def read(self, content: bytes) -> list[tuple]: ...


def words_of(found: list[tuple]) -> list[dict]:
    """The words of an engine's answer; entries without text or of another shape are left out."""
    out = []
    for item in found:
        if item and len(item) >= 2 and item[1]:
            xs, ys = [float(p[0]) for p in item[0]], [float(p[1]) for p in item[0]]
            out.append({"text": str(item[1]), "x0": min(xs), "y0": min(ys), "x1": max(xs), "y1": max(ys), "confidence": float(item[2]) if len(item) > 2 else UNRATED})
    return out


def _recognise(rows: DataFrame, engines: dict[str, Callable[[], Engine]], engine: str | None) -> DataFrame:
    """rows (content, and a column that names the engine unless there is one only) with words, error and seconds.

    A page that fails is read once more by a fresh engine, as engines can be left in a bad state; if that fails too, or the
    engine cannot be made, its row holds the error. Other pages of the batch are not affected.
    """
    kept = [c for c in rows.columns if c != "content"]
    schema = T.StructType([*(rows.schema[c] for c in kept), *T._parse_datatype_string(f"words {WORDS}, error string, seconds double").fields])
    only = next(iter(engines))

    def run(batches):
        made: dict[str, Engine] = {}

        def read(name: str, content: bytes) -> list[dict]:
            if name not in made:
                made.clear()  # one engine at a time; rows come in the order of their engines
                made[name] = engines[name]()
            return words_of(made[name].read(content))

        for batch in batches:
            for at in range(0, batch.num_rows, 16):  # pages are large
                part = batch.slice(at, 16)
                words, errors, seconds = [], [], []
                for name, content in zip(part.column(engine).to_pylist() if engine else [only] * part.num_rows, part.column("content").to_pylist()):
                    found, error, begun = None, None, time.perf_counter()
                    for _ in range(2):
                        try:
                            found, error = read(name, content or b""), None
                            break
                        except Exception as e:  # noqa: BLE001  an engine may fail in any way; the error is the row's result
                            error = f"{type(e).__name__}: {e}"
                            made.pop(name, None)
                    words.append(found)
                    errors.append(error)
                    seconds.append(time.perf_counter() - begun)
                kind = pa.list_(pa.struct([("text", pa.string()), *((c, pa.float64()) for c in ("x0", "y0", "x1", "y1", "confidence"))]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(words, kind), pa.array(errors, pa.string()), pa.array(seconds, pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def flat_text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def mean_confidence(words: Column) -> Column:
    return F.when(F.size(words) > 0, F.aggregate(words, F.lit(0.0), lambda a, w: a + w["confidence"]) / F.size(words)).otherwise(0.0)


def scan(pages: DataFrame, make: Callable[[], Engine]) -> DataFrame:
    """pages (content and any keys) with words, text, confidence, error and seconds instead of content. A null content is an
    empty page to the engine; a page in error has null words and text."""
    found = _recognise(pages, {"engine": make}, None)
    done = F.col("error").isNull()
    return found.withColumn("text", F.when(done, flat_text(F.col("words")))).withColumn("confidence", F.when(done, mean_confidence(F.col("words"))))


def finished(spark: SparkSession, folder: str) -> DataFrame | None:
    """What earlier runs wrote, or nothing."""
    try:
        return spark.read.parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def _missing(rows: DataFrame, keys: list[str], folder: str) -> DataFrame:
    before = finished(rows.sparkSession, folder)
    return rows if before is None else rows.join(before.where("error IS NULL").select(*keys).distinct(), keys, "left_anti")


def _latest(spark: SparkSession, keys: list[str], folder: str) -> DataFrame:
    """One row for each page: the one without an error, else one of those with."""
    rows = spark.read.parquet(folder)
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.col("error").isNotNull()).alias("r")).select("r.*")


def scan_into(pages: DataFrame, keys: list[str], folder: str, make: Callable[[], Engine]) -> DataFrame:
    """Scan into a folder of Parquet files, and return the state of every page there. Pages that an earlier run read are not
    read again, those in error are."""
    scan(_missing(pages, keys, folder), make).write.mode("append").parquet(folder)
    return _latest(pages.sparkSession, keys, folder)


def compare_into(manifest: DataFrame, keys: list[str], folder: str, engines: dict[str, Callable[[], Engine]], parts: int = 64) -> DataFrame:
    """Every row of manifest (keys, truth, content) read by every engine; what earlier runs finished is left out.

    Rows are dealt so that a task starts one engine after the other, seldom more than a few, over all shuffle partitions: small
    pages can take long, so their bytes must not join partitions. Returns backend, keys, truth,
    prediction, confidence, words, cer, wer, error and seconds of all pairs in the folder.
    """
    names = F.explode(F.array(*map(F.lit, engines)))
    pairs = _missing(manifest.select(names.alias("backend"), *keys, "truth", "content"), ["backend", *keys], folder)
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.repartition(tasks, "backend", F.pmod(F.xxhash64(*keys), F.lit(parts))).sortWithinPartitions("backend")
    found = _recognise(dealt, engines, "backend")
    text = F.when(F.col("error").isNull(), flat_text(F.col("words")))
    read = found.select("backend", *keys, "truth", text.alias("prediction"), F.when(text.isNotNull(), mean_confidence(F.col("words"))).alias("confidence"), "words", "error", "seconds")
    rated = read.withColumn("cer", X.cer(F.col("truth"), F.col("prediction"))).withColumn("wer", X.wer(F.col("truth"), F.col("prediction")))
    rated.write.mode("append").parquet(folder)
    return _latest(manifest.sparkSession, ["backend", *keys], folder)
