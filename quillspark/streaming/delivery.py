"""Signed notifications of a stream: one delivery for each event and hook, with retries that survive restarts."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import scalars as X

#: send(url, body, headers) returns nothing, or raises where the receiver did not take it.
Sender = Callable[[str, str, dict], None]
LOG = "delivery string, url string, body string, signature string, attempts int, due double, status string, error string"


def payloads(events: DataFrame, hooks: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """delivery, url, body and signature for every event (event_id, event, and what fields use) and every active hook (url,
    active, events, secret) that wants it: one that names it, or names none.

    The body is JSON with sorted keys; the signature (null without a secret) is its HMAC. Hooks meet events on the event's
    name or, if they want all, on a star, so no event is held against hooks that do not want it. delivery names the pair.
    """
    wants = F.when(F.size("events") > 0, F.array_distinct("events")).otherwise(F.array(F.lit("*")))
    active = hooks.where("active").select("url", F.when(F.length("secret") > 0, pads(F.col("secret"))).alias("pads"), F.explode(F.coalesce(wants, F.array(F.lit("*")))).alias("__key"))
    rows = events.withColumn("__key", F.explode(F.array("event", F.lit("*")))).join(active, "__key")
    body = X.canonical_json(fields)
    rows = rows.select(F.sha2(F.concat_ws("|", "url", F.col("event_id").cast("string")), 256).alias("delivery"), "url", "pads", body.alias("body")).dropDuplicates(["delivery"])
    return rows.withColumn("signature", padded_hmac(F.col("body"), F.col("pads"))).drop("pads")


def pads(secret: Column) -> Column:
    """The two blocks, struct(inner, outer), that HMAC-SHA256 makes of a key: all of its work that is the same for every message."""
    raw = F.encode(secret, "utf-8")
    key = F.when(F.length(raw) > 64, F.sha2(raw, 256)).otherwise(F.hex(raw))
    bytes_of = F.rpad(key, 128, "0")
    padded = lambda mask: F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(F.conv(F.substring(bytes_of, i * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(mask))), 2, "0")), ""))
    return F.named_struct(F.lit("inner"), padded(0x36), F.lit("outer"), padded(0x5C))


def padded_hmac(message: Column, blocks: Column) -> Column:
    """Hex HMAC-SHA256 of a message under a key's `pads`."""
    return F.sha2(F.concat(blocks["outer"], F.unhex(F.sha2(F.concat(blocks["inner"], F.encode(message, "utf-8")), 256))), 256)


def keyed_hmac(message: Column, secret: Column) -> Column:
    """Hex HMAC-SHA256 of a message under the row's own key."""
    return padded_hmac(message, pads(secret))


def attempt(rows: DataFrame, send: Sender, now: float, wait: float, most: int) -> DataFrame:
    """rows (delivery, url, body, signature, attempts) after one try each: sent, pending until due, or given up."""

    def run(batches):
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                headers = {"Content-Type": "application/json", "Idempotency-Key": r["delivery"]} | ({"X-Signature": r["signature"]} if r["signature"] else {})
                tries, error = r["attempts"] + 1, None
                try:
                    send(r["url"], r["body"], headers)
                except Exception as e:  # noqa: BLE001  whatever fails is tried again
                    error = f"{type(e).__name__}: {e}"
                status = "sent" if error is None else "pending" if tries < most else "given up"
                found.append(r | {"attempts": tries, "due": now + wait * 2.0 ** (tries - 1), "status": status, "error": error})
            text = {c: pa.string() for c in ("delivery", "url", "body", "signature", "status", "error")}
            names = [x.split()[0] for x in LOG.split(", ")]
            kinds = [text.get(c) or {"attempts": pa.int32(), "due": pa.float64()}[c] for c in names]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], k) for c, k in zip(names, kinds)], names=names)

    return rows.select("delivery", "url", "body", "signature", "attempts").mapInArrow(run, LOG)


def deliver(events: DataFrame, hooks: DataFrame, fields: dict[str, Column], send: Sender, folder: str, checkpoint: str, clock: Callable[[], float] = time.time, wait: float = 60.0, most: int = 5):
    """Send what a stream of events asks for; returns the writer's query, which ends when all that is there has been read.

    Each batch writes its own part of the log in folder (batch=<id>) once its sends are done: new deliveries, and pending
    ones of the batch before whose time has come; other pending ones are carried over. A batch whose part is there is not
    sent again, so a restart repeats nothing; if a run dies between sending and writing, receivers can tell by the key.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={number}/_SUCCESS")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if files.exists(path):
            return
        now = clock()
        new = payloads(batch, hooks, fields).withColumn("attempts", F.lit(0))
        last = path.getParent().getParent().suffix(f"/batch={number - 1}")
        if files.exists(last):
            pending = spark.read.schema(LOG).parquet(f"{folder}/batch={number - 1}").where("status = 'pending'")
            due = pending.where(F.col("due") <= now).select(new.columns)
            out = attempt(new.unionByName(due), send, now, wait, most).unionByName(pending.where(F.col("due") > now))
        else:
            out = attempt(new, send, now, wait, most)
        out.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log(spark, folder: str) -> DataFrame:
    """The last state of every delivery."""
    rows = spark.read.schema(LOG + ", batch int").parquet(folder)
    return rows.groupBy("delivery").agg(F.max_by(F.struct("url", "body", "signature", "attempts", "due", "status", "error"), F.struct("attempts", "batch")).alias("r")).select("delivery", "r.*")
