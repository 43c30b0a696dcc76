"""Queries over injected engines, learned corrections and deliveries, on the documents' whole texts and the events."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from quillspark.operators import geometry as G
from quillspark.plans.registry import query, table
from quillspark.sources import ocr
from quillspark.streaming import delivery


def scratch(spark, name: str) -> str:
    """A new folder below spark.checkpoint.dir; only where that is unset and Spark runs in one process, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _engine(fails: int, swaps: bool = False):
    """Makes engines that read a page as the words between its spaces, unsure of every word of odd length, and fail on pages
    whose size in bytes is divisible by `fails`."""

    def make():
        class Words:
            def read(self, content):
                if len(content) % fails == 0:
                    raise ValueError("unreadable")
                words = [w for w in content.decode().split(" ") if w]
                box = [[0, 0], [1, 0], [1, 1], [0, 1]]
                return [(box, w.replace('e', '3') if swaps else w, 0.75) if len(w) % 2 == 0 else (box, w.replace('e', '3') if swaps else w) for w in words]

        return Words()

    return make


_READ = "list_filter(string_split(text, ' '), lambda w: w <> '')"


@query(
    "ocr_scanned",
    f"SELECT doc_id, CASE WHEN strlen(text) % 7 > 0 THEN len(w) ELSE 0 END::INT AS words, CASE WHEN strlen(text) % 7 > 0 THEN md5(array_to_string(w, ' ')) END AS text_md5, "
    "CASE WHEN strlen(text) % 7 > 0 THEN round(CASE WHEN len(w) > 0 THEN list_avg(list_transform(w, lambda x: CASE WHEN length(x) % 2 = 0 THEN 0.75 ELSE 0.5 END::DOUBLE)) ELSE 0 END, 9) END AS confidence, "
    f"CASE WHEN strlen(text) % 7 = 0 THEN 'ValueError: unreadable' END AS error FROM (SELECT doc_id, text, {_READ} AS w FROM documents WHERE text IS NOT NULL)",
)
def ocr_scanned(spark, sf_dir):
    """Every document as a page, some of which no engine can read."""
    pages = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.encode("text", "utf-8").alias("content"))
    found = ocr.scan(pages, _engine(7))
    return found.select("doc_id", F.when(F.col("error").isNull(), F.size("words")).otherwise(0).alias("words"), F.md5("text").alias("text_md5"), F.round("confidence", 9).alias("confidence"), "error")


@query(
    "ocr_compared",
    f"SELECT backend, conv_id, turn, CASE WHEN ok THEN CASE WHEN backend = 'plain' THEN p ELSE replace(p, 'e', '3') END END AS prediction, NOT ok AS failed FROM "
    f"(SELECT b.backend, conv_id, turn, array_to_string({_READ}, ' ') AS p, strlen(text) % b.fails > 0 AS ok FROM conversations, (VALUES ('plain', 7), ('swapping', 5)) b(backend, fails) WHERE text IS NOT NULL)",
)
def ocr_compared(spark, sf_dir):
    """Two engines over all turns: the first run sees a half, the second adds what is missing."""
    manifest = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.col("text").alias("truth"), F.encode("text", "utf-8").alias("content"))
    folder, engines = scratch(spark, "compared"), {"plain": _engine(7), "swapping": _engine(5, swaps=True)}
    ocr.compare_into(manifest.where("conv_id % 2 = 0"), ["conv_id", "turn"], folder, engines)
    found = ocr.compare_into(manifest, ["conv_id", "turn"], folder, engines)
    return found.select("backend", "conv_id", "turn", "prediction", F.col("error").isNotNull().alias("failed"))


@query(
    "boxes_corrected",
    """WITH e AS (SELECT event_id AS k, event_type AS type, ts::DATE AS day, floor(value)::BIGINT % 7 AS v FROM events),
made AS (SELECT type, day, count(*) AS n, sum(v - k % 3) AS dx, sum(k % 5) AS dy, sum(v) AS dw, sum(-(k % 4)) AS dh FROM e WHERE k % 4 <> 0 GROUP BY ALL),
days AS (SELECT DISTINCT type, day FROM e),
known AS (SELECT d.type, d.day, coalesce(sum(m.n), 0) AS n, sum(m.dx) AS dx, sum(m.dy) AS dy, sum(m.dw) AS dw, sum(m.dh) AS dh FROM days d LEFT JOIN made m ON m.type = d.type AND m.day < d.day GROUP BY ALL),
s AS (SELECT type, day, n, greatest(-2, least(2, dx::DOUBLE / n)) AS dx, greatest(-2, least(2, dy::DOUBLE / n)) AS dy, greatest(-2, least(2, dw::DOUBLE / n)) AS dw, greatest(-2, least(2, dh::DOUBLE / n)) AS dh FROM known),
b AS (SELECT k, n, k % 560 AS x0, k % 790 AS y0, k % 560 + 40 AS x1, k % 790 + 20 AS y1, dx, dy, dw, dh FROM e JOIN s USING (type, day))
SELECT k AS event_id, n::BIGINT AS corrections, CASE WHEN n < 50 THEN x0 ELSE round(greatest(0, least(600, x0 + dx)), 2) END::DOUBLE AS x0, CASE WHEN n < 50 THEN y0 ELSE round(greatest(0, least(800, y0 + dy)), 2) END::DOUBLE AS y0,
  CASE WHEN n < 50 THEN x1 ELSE round(greatest(0, least(600, x1 + dx + dw)), 2) END::DOUBLE AS x1, CASE WHEN n < 50 THEN y1 ELSE round(greatest(0, least(800, y1 + dy + dh)), 2) END::DOUBLE AS y1 FROM (SELECT * REPLACE (CASE WHEN n < 50 THEN 0 ELSE n END AS n) FROM b)""",
)
def boxes_corrected(spark, sf_dir):
    """A box for each event, moved by what reviewers did to boxes of its type on the days before."""
    k, v = F.col("event_id"), F.floor("value") % 7
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("type"), F.to_date("ts").alias("day"), "value")
    box = lambda *c: F.struct(*(x.cast("double").alias(n) for x, n in zip(c, ("x0", "y0", "x1", "y1"))))
    ten, after_x = F.lit(10), v - k % 3 + 10
    action = F.element_at(F.array(*map(F.lit, ("approve", "expand", "shrink", "move"))), (k % 4 + 1).cast("int"))
    edits = events.select("type", "day", action.alias("action"), box(ten, ten, ten + 50, ten + 20).alias("before"), box(after_x, k % 5 + 10, after_x + 50 + v, k % 5 + 30 - k % 4).alias("after"))
    boxes = events.select("event_id", "type", "day", box(k % 560, k % 790, k % 560 + 40, k % 790 + 20).alias("box"))
    return G.corrected(boxes, edits, 600.0, 800.0, most=2.0, least=50).select("event_id", "corrections", "box.x0", "box.y0", "box.x1", "box.y1")


@query(
    "webhook_deliveries",
    """WITH h AS (SELECT * FROM (VALUES ('https://all.example', NULL, 'key one'), ('https://some.example', ['click', 'error'], NULL)) h(url, names, secret))
SELECT sha256(url || '|' || event_id) AS delivery, url, '{"event": "' || event_type || '", "id": ' || event_id || ', "user": ' || user_id || '}' AS body, secret IS NOT NULL AS signed FROM events JOIN h ON names IS NULL OR list_contains(names, event_type)""",
)
def webhook_deliveries(spark, sf_dir):
    """What two hooks are to be told of all events; a third is not active."""
    hooks = spark.createDataFrame([("https://all.example", True, [], "key one"), ("https://some.example", True, ["click", "error", "click"], None), ("https://none.example", False, [], "x")], "url string, active boolean, events array<string>, secret string")
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("event"), "user_id")
    fields = {"event": delivery.X.json_text(F.col("event")), "user": F.col("user_id"), "id": F.col("event_id")}
    return delivery.payloads(events, hooks, fields).select("delivery", "url", "body", F.col("signature").isNotNull().alias("signed"))
