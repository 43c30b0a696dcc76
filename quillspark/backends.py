"""Models as injected functions. Nothing here loads a model; without one, a tier has no result.

A backend is made once in each Python worker and then called with lists of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEMS = "array<struct<type:string,value:string>>"


class Backend(Protocol):
    available: bool

    def items(self, texts: list[str]) -> list[list[tuple[str, str]]]: ...


class NoBackend:
    available = False

    def items(self, texts: list[str]) -> list[list[tuple[str, str]]]:
        return [[] for _ in texts]


def with_items(docs: DataFrame, make: Callable[[], Backend] = NoBackend, text: str = "text", most: int | None = None) -> DataFrame:
    """docs with items (type, value) that the backend finds, and items_error. Where a batch fails, its texts are tried one by
    one, so that a failure costs its own row only, which keeps the error and has no items. most: characters of a text that
    the backend can take; it sees whole texts unless that is given."""
    if not make().available:
        return docs.withColumn("items", F.array().cast(ITEMS)).withColumn("items_error", F.lit(None).cast("string"))

    @F.pandas_udf(f"items {ITEMS}, error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        backend = make()
        for part in parts:
            texts = [(t or "")[:most] for t in part]
            try:
                found = [(x, None) for x in backend.items(texts)]
            except Exception:  # noqa: BLE001  a model may fail in any way; the tier is optional
                found = [alone(backend, t) for t in texts]
            yield pd.DataFrame({"items": [[{"type": k, "value": v} for k, v in row] for row, _ in found], "error": [e for _, e in found]})

    def alone(backend: Backend, one: str):
        try:
            return backend.items([one])[0], None
        except Exception as e:  # noqa: BLE001
            return [], f"{type(e).__name__}: {e}"

    return docs.withColumn("__found", run(F.col(text))).withColumn("items", F.col("__found.items")).withColumn("items_error", F.col("__found.error")).drop("__found")


def language_or_english(text: Column, detect: Callable[[Column], Column] | None = None) -> Column:
    from quillspark.operators.classify import language

    return language(text, detect(text) if detect else F.lit(None).cast("string"))
