import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from quillspark.sources import ocr
from quillspark.streaming import delivery


def engine(log):
    """Notes every read in a folder; fails once on 'shaky', always on 'broken', and cannot be made twice on a bad day."""

    def make():
        import os
        import uuid

        class Fake:
            def read(self, content):
                open(f"{log}/{uuid.uuid4().hex}", "w").write(content.decode())
                seen = sum(open(f"{log}/{f}").read() == content.decode() for f in os.listdir(log))
                if content == b"broken" or content == b"shaky" and seen == 1:
                    raise RuntimeError("out of order")
                box = [(1, 2), (5, 2), (5, 4), (1, 4)]
                return [(box, w, 0.9) if i == 0 else (box, w) for i, w in enumerate(content.decode().split())] + [(box, ""), None, (box,)]

        return Fake()

    return make


def test_scan_keeps_errors_and_reads_each_page_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    pages = spark.createDataFrame([(1, 1, b"two words"), (1, 2, b"shaky"), (2, 1, b"broken"), (3, 1, b""), (4, 1, None)], "doc_id long, page_number int, content binary").coalesce(1)
    folder = str(tmp_path / "scans")
    first = {(r["doc_id"], r["page_number"]): r for r in ocr.scan_into(pages, ["doc_id", "page_number"], folder, engine(str(log))).collect()}
    assert first[1, 1]["text"] == "two words" and first[1, 1]["confidence"] == pytest.approx((0.9 + ocr.UNRATED) / 2)
    assert [tuple(w) for w in first[1, 1]["words"]] == [("two", 1.0, 2.0, 5.0, 4.0, 0.9), ("words", 1.0, 2.0, 5.0, 4.0, 0.5)]
    assert first[1, 2]["text"] == "shaky" and first[1, 2]["error"] is None  # the second try
    assert first[2, 1]["error"] == "RuntimeError: out of order" and first[2, 1]["words"] is None and first[2, 1]["text"] is None
    assert first[3, 1]["text"] == first[4, 1]["text"] == "" and first[3, 1]["confidence"] == 0
    reads = len([*log.iterdir()])
    again = {(r["doc_id"], r["page_number"]): r["error"] for r in ocr.scan_into(pages.unionByName(spark.createDataFrame([(5, 1, b"new")], pages.schema)), ["doc_id", "page_number"], folder, engine(str(log))).collect()}
    assert len([*log.iterdir()]) == reads + 3  # two tries of the broken page, and the new one
    assert len(again) == 6 and [k for k, e in again.items() if e] == [(2, 1)]
    assert ocr.scan(pages.limit(0), engine(str(log))).count() == 0


def test_an_engine_that_cannot_be_made(spark):
    def make():
        raise ImportError("no such engine")

    rows = ocr.scan(spark.createDataFrame([(1, b"x")], "doc_id long, content binary"), make).collect()
    assert [r["error"] for r in rows] == ["ImportError: no such engine"]


def test_compare_adds_only_missing_pairs(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = [(i, f"word{i} good", f"word{i} good" if i % 2 else f"ward{i}") for i in range(6)] + [(9, "broken", "broken")]
    manifest = spark.createDataFrame(rows, "page long, truth string, content string").withColumn("content", F.encode("content", "utf-8"))
    engines = {"a": engine(str(log)), "b": engine(str(log))}
    ocr.compare_into(manifest.where("page < 3"), ["page"], str(tmp_path / "out"), engines)
    n = len([*log.iterdir()])
    got = {(r["backend"], r["page"]): r for r in ocr.compare_into(manifest, ["page"], str(tmp_path / "out"), engines).collect()}
    assert n == 6 and len(got) == 14 and len([*log.iterdir()]) == n + 6 + 4
    assert got["a", 1]["cer"] == 0 and got["b", 2]["wer"] == 1.0 and got["b", 2]["cer"] == pytest.approx(6 / 10) and got["a", 9]["error"] and got["a", 9]["prediction"] is None


HOOKS = [("http://a", True, [], "s" * 80), ("http://b", True, ["done"], None), ("http://c", False, [], "k"), ("http://d", True, None, "k")]


def test_signatures_and_bodies(spark):
    hooks = spark.createDataFrame(HOOKS, "url string, active boolean, events array<string>, secret string")
    events = spark.createDataFrame([(1, "done", 'q"é'), (2, "failed", None)], "event_id long, event string, note string")
    fields = {"note": delivery.X.json_text(F.col("note")), "event": delivery.X.json_text(F.col("event")), "id": F.col("event_id")}
    got = {(r["url"], json.loads(r["body"])["id"]): r for r in delivery.payloads(events, hooks, fields).collect()}
    assert sorted(got) == [("http://a", 1), ("http://a", 2), ("http://b", 1), ("http://d", 1), ("http://d", 2)]
    body = json.dumps({"note": 'q"é', "event": "done", "id": 1}, sort_keys=True)
    assert got["http://a", 1]["body"] == body
    assert got["http://a", 1]["signature"] == hmac.new(b"s" * 80, body.encode(), hashlib.sha256).hexdigest()
    assert got["http://d", 1]["signature"] == hmac.new(b"k", body.encode(), hashlib.sha256).hexdigest() and got["http://b", 1]["signature"] is None


def test_deliveries_survive_restarts(spark, tmp_path):
    """Batches, a hook that is down for a while, and restarts: everything comes once, late ones after their wait."""
    source, box = tmp_path / "in", tmp_path / "box"
    source.mkdir()
    box.mkdir()
    down = tmp_path / "down"
    down.touch()
    inbox, off = str(box), str(down)

    def send(url, body, headers):
        import os
        import uuid

        if url == "http://b" and os.path.exists(off):
            raise OSError("down")
        open(f"{inbox}/{uuid.uuid4().hex}", "w").write(f"{url} {headers['Idempotency-Key']}")

    hooks = spark.createDataFrame(HOOKS[:3], "url string, active boolean, events array<string>, secret string")
    fields = {"id": F.col("event_id")}
    clock = [1000.0]

    def run(rows):
        if rows:
            spark.createDataFrame(rows, "event_id long, event string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("event_id long, event string").parquet(str(source))
        delivery.deliver(stream, hooks, fields, send, str(tmp_path / "log"), str(tmp_path / "check"), lambda: clock[0], wait=60.0, most=3).awaitTermination(120)
        return sorted(open(f).read().split()[0] for f in box.iterdir())

    assert run([(1, "done"), (2, "failed")]) == ["http://a", "http://a"]
    assert run([]) == ["http://a", "http://a"]  # a restart without anything new
    clock[0] += 30
    assert run([(3, "failed")]) == ["http://a"] * 3  # the pending one waits
    down.unlink()
    clock[0] += 40
    assert run([(4, "done")]) == ["http://a"] * 4 + ["http://b"] * 2
    state = {(r["url"], json.loads(r["body"])["id"]): (r["status"], r["attempts"]) for r in delivery.log(spark, str(tmp_path / "log")).collect()}
    assert state["http://b", 1] == ("sent", 2) and set(state.values()) == {("sent", 1), ("sent", 2)} and len(state) == 6
    assert len({open(f).read() for f in box.iterdir()}) == len([*box.iterdir()])  # no key twice


def test_small_pages_are_rated_in_all_tasks(spark, tmp_path):
    rows = [(i, f"wörd{i} good end" * 3, f"ward{i} go od end" * 3 if i % 3 else f"wörd{i} good end" * 3) for i in range(40)]
    manifest = spark.createDataFrame(rows, "page long, truth string, content string").withColumn("content", F.encode("content", "utf-8"))
    log = tmp_path / "log"
    log.mkdir()
    got = ocr.compare_into(manifest, ["page"], str(tmp_path / "out"), {"a": engine(str(log))})
    native = got.where(F.abs(F.col("cer") - F.levenshtein("truth", "prediction") / F.length("truth")) > 1e-12)
    assert got.count() == 40 and native.count() == 0 and got.where("cer > 0").count() > 20
    assert len([*(tmp_path / "out").glob("part-*")]) > 1  # their bytes would fit one partition
