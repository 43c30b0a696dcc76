"""Structured Streaming forms of the operators: ingest, progress and audit."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.functions import fixed_values as V
from quillspark.operators import classify as C
from quillspark.operators import detect as D


def documents(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder that is watched for Parquet files of documents."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def redacted(docs: DataFrame) -> DataFrame:
    """Documents with category and spans; the same columns as in batch, so a stream needs no code of its own."""
    found = docs.withColumn("category", C.keyword_estimate(F.col("text")))
    return D.detect(found, C.allowed_types(C.profiles(F.col("category"))))


def status_changes(events: DataFrame, key: str, status: str, order: str) -> DataFrame:
    """Events (key: long, status: string, order: long) whose status differs from the key's last; the last one is kept as state.

    Within a batch a key's events are put in order; a key is forgotten when it reaches a terminal status.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        last = state.get[0] if state.exists else None
        out = []
        for value, place in zip(rows[status], rows[order]):
            if value != last:
                out.append((k[0], value, last, place))
            last = value
        if last in V.TERMINAL_STATUS:
            state.remove() if state.exists else None
        else:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, status, "previous", order])

    return events.groupBy(key).applyInPandasWithState(step, f"{key} long, {status} string, previous string, {order} long", "last string", "append", GroupStateTimeout.NoTimeout)


def stalled(events: DataFrame, key: str, status: str, at: str, limit: str) -> DataFrame:
    """key, status and since of keys that stay in one status, not a terminal one, for longer than limit (by event time).

    events needs a watermark on at. Each status of a key is reported once; an event that changes the status takes the timer
    back and starts another, one that repeats it does not. A key is forgotten at a terminal status and once it is reported.
    """
    wait = pd.Timedelta(limit)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = [key, status, "since"]
        if state.hasTimedOut:
            last, since = state.get
            state.remove()
            yield pd.DataFrame([(k[0], last, pd.Timestamp(since, unit="us"))], columns=columns)
            return
        last, since = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values(at, kind="stable")
        for value, when in zip(rows[status], rows[at]):
            if value != last:
                last, since = value, int(when.value // 1000)
        if last in V.TERMINAL_STATUS:
            if state.exists:
                state.remove()
        else:
            state.update((last, since))
            # A timer cannot lie before the watermark; what is due by now rings at the next one.
            state.setTimeoutTimestamp(max(since // 1000 + int(wait.total_seconds() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([], columns=columns)

    return events.groupBy(key).applyInPandasWithState(step, f"{key} long, {status} string, since timestamp", "last string, since long", "append", GroupStateTimeout.EventTimeTimeout)


def webhook_payloads(events: DataFrame, hooks: DataFrame, secret: bytes) -> DataFrame:
    """Signed payloads for active hooks that want the event (all, if they name none); `delivery` also sends them."""
    from quillspark.functions.scalars import hmac_sha256

    wants = F.when(F.size("events") > 0, F.array_distinct("events")).otherwise(F.array(F.lit("*")))
    active = hooks.where("active").select("url", F.explode(wants).alias("__key"))
    rows = events.withColumn("__key", F.explode(F.array("event", F.lit("*")))).join(active, "__key")
    body = F.to_json(F.struct("document_id", "event"))
    return rows.select("url", body.alias("body"), hmac_sha256(body, secret).alias("signature"))


def write(stream: DataFrame, folder: str, checkpoint: str):
    """Append to Parquet until what is there now has been read."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_json(row: dict) -> str:
    return json.dumps({"status": row["status"], "percent": V.STATUS_PERCENT.get(row["status"], 0)}, sort_keys=True)
