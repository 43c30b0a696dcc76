import base64
import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import scalars as X
from quillspark.operators import evaluate as E
from quillspark.operators import geometry as G
from quillspark.operators import integrity as I
from quillspark.operators import workflow as W
from quillspark.sources import io
from quillspark.streaming import pipeline as P


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_error_rates(spark):
    for t, p in [("a b c d", "a c d e"), ("one two", "one two"), ("", "x"), ("", ""), ("é ü ß", "e ü"), ("x " * 50, "y " * 40)]:
        want = edit(t.lower().split(), p.lower().split()) / len(t.split()) if t.split() else float(bool(p.split()))
        assert value(spark, X.wer(F.lit(t), F.lit(p))) == pytest.approx(want)
        want = edit(t, p) / len(t) if t else float(bool(p))
        assert value(spark, X.cer(F.lit(t), F.lit(p))) == pytest.approx(want)


def test_hashes_and_export_ids(spark):
    assert value(spark, X.hmac_sha256(F.lit("méssage"), b"k" * 70)) == hmac.new(b"k" * 70, "méssage".encode(), hashlib.sha256).hexdigest()
    for data in (b"", b"f", b"foobar", bytes(range(37))):
        assert value(spark, X.base32(F.lit(data))) == base64.b32encode(data).decode().rstrip("=")
    ids = spark.range(3).select(X.export_id("QS", F.col("id"), F.lit("2024"), b"key").alias("export_id"))
    one = ids.collect()[0][0]
    asked = spark.createDataFrame([(one,), ("XX" + one[2:],), (one[:-1] + ("A" if one[-1] != "A" else "B"),), ("nonsense",), (value(spark, X.export_id("QS", F.lit(99), F.lit("x"), b"key")),)], "export_id string")
    assert {r["export_id"]: r["result"] for r in I.decode_exports(asked, "export_id", ids, "QS", b"key").collect()} == dict(zip([r[0] for r in asked.collect()], ["found", "foreign", "invalid", "invalid", "not_in_library"]))


def test_chain_breaks_on_any_change(spark):
    rows = spark.createDataFrame([(k, i, f"e{k}{i}") for k in range(3) for i in range(4)], "k int, i int, data string")
    chain = I.build_chain(rows, "k", ["i"], "data", b"s").cache()
    assert all(r["valid"] and r["n"] == 4 for r in I.verify_chain(chain, "k", ["i"], "data", b"s").collect())
    for column in ("data", "chain_hash", "signature", "previous_hash"):
        bad = chain.withColumn(column, F.when((F.col("k") == 1) & (F.col("i") == 2), "x").otherwise(F.col(column)))
        assert {r["k"] for r in I.verify_chain(bad, "k", ["i"], "data", b"s").where("NOT valid").collect()} == {1}
    assert not any(r["valid"] for r in I.verify_chain(chain, "k", ["i"], "data", b"other").collect())


def test_boxes(spark):
    a, b = (F.struct(*(F.lit(float(v)).alias(n) for v, n in zip(x, ("x0", "y0", "x1", "y1")))) for x in ((0, 0, 10, 10), (5, 0, 15, 10)))
    assert value(spark, X.iou(a, b)) == pytest.approx(1 / 3) and value(spark, X.cover(a, b)) == 0.5
    rows = spark.createDataFrame([(1, 1, "p", (0.0, 0.0, 10.0, 10.0), 0.5, "regex"), (1, 2, "p", (0.0, 0.0, 10.0, 9.0), 0.9, "regex"), (1, 3, "q", (50.0, 0.0, 60.0, 9.0), 0.1, "regex"), (1, 4, "q", (51.0, 1.0, 55.0, 5.0), 0.9, "field_line"), (1, 5, "z", None, 0.9, "regex")], "page int, id int, kind string, box struct<x0:double,y0:double,x1:double,y1:double>, confidence double, method string")
    assert sorted(r["id"] for r in G.dedupe_boxes(rows, "page", "id").collect()) == [2, 4, 5]


def test_words_lines_and_span_boxes(spark):
    pages = spark.createDataFrame([(1, "alpha beta gamma " * 12), (2, "one")], "page long, text string")
    words = G.layout(pages).cache()
    lines = G.cluster_lines(words, "page").orderBy("page", "line").collect()
    assert " ".join(r["text"] for r in lines if r["page"] == 1).split() == ("alpha beta gamma " * 12).split()
    assert all(x["y0"] < y["y0"] for x, y in zip(lines, lines[1:]) if x["page"] == y["page"])
    spans = spark.createDataFrame([(1, 7, 6, 10), (1, 8, 2, 13), (2, 9, 0, 3)], "page long, span_id int, start int, end int")
    boxes = {r["span_id"]: r["box"] for r in G.span_boxes(G.word_spans(words, "page"), spans, "page").collect()}
    assert (boxes[7]["x0"], boxes[7]["x1"]) == (60, 100) and (boxes[8]["x0"], boxes[8]["x1"]) == (20, 130)


def test_workflow(spark):
    docs = spark.createDataFrame([(1, "needs_review", 0.5, None), (2, "needs_review", None, None), (3, "complete", 0.9, None), (4, "in_review", 0.9, ["x"])], "id long, status string, urgency_score double, risk_flags array<string>").withColumn("created_at", F.lit(None).cast("timestamp"))
    assert [r["id"] for r in W.review_queue(docs).collect()] == [4, 1, 2]
    board = W.dashboard(docs).first()
    assert (board["total"], board["complete"], board["review"], board["auto_approval_rate"], board["safeguarding_alerts"]) == (4, 1, 3, 25.0, 1)
    red = spark.createDataFrame([(1, "approved"), (1, "rejected"), (3, "pending")], "document_id long, status string")
    assert {r["id"]: r["redaction_count"] for r in W.counted(docs, red, active_only=True).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}
    names = spark.createDataFrame([("d", "a.pdf", i) for i in range(3)] + [("d", "b", 9)], "folder string, name string, i int")
    assert sorted(r["unique_name"] for r in W.unique_names(names, "folder", "name", "i").collect()) == ["a.pdf", "a_2.pdf", "a_3.pdf", "b"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"document_id": "a", "text": "x"}\n\n{"document_id": "b"}\n')
    assert io.read_manifest(spark, f"{tmp_path}/m.jsonl").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"document_id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_jsonl(spark, f"{tmp_path}/bad.jsonl", "document_id string").collect()
    (tmp_path / "d.docx").write_bytes(io.docx_bytes("\nFirst & <b>\n\nlast\n"))
    (tmp_path / "e.docx").write_bytes(b"no zip")
    got = {r["path"][-6:]: r for r in io.docx_pages(io.files(spark, str(tmp_path), ".docx")).collect()}
    assert got["d.docx"]["text"] == "First & <b>\n\nlast" and got["e.docx"]["error"] == "BadZipFile"
    up = spark.createDataFrame([("a b.pdf", bytearray(b"%PDF-1.4")), ("x.exe", bytearray(b"MZ")), ("y.png", bytearray(b"%PDF")), ("z.pdf", bytearray())], "name string, content binary")
    assert [r["problem"] for r in io.upload_problems(up).collect()] == [None, "unsupported type", "content does not match type", "empty file"]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, text string")
    io.replace_documents(rows, f"{tmp_path}/t", "doc_id")
    io.replace_documents(spark.createDataFrame([(2, "c")], "doc_id int, text string"), f"{tmp_path}/t", "doc_id")
    assert sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(1, "a"), (2, "c")]
    io.write_texts(rows, f"{tmp_path}/texts")
    io.write_jsonl(rows, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2


def test_streams_equal_batch(spark, tmp_path):
    rows = [(k % 5, ["ocr", "redaction", "ocr", "routing"][(k * 7 // 3) % 4], k) for k in range(60)]
    events = spark.createDataFrame(rows, "doc long, status string, n long")
    for part in range(3):  # three files, so state goes on from batch to batch
        events.where(f"n >= {20 * part} AND n < {20 * part + 20}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = P.status_changes(P.documents(spark, f"{tmp_path}/in", "doc long, status string, n long"), "doc", "status", "n")
    P.write(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = sorted((r["doc"], r["n"], r["status"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted((r["doc"], r["n"], r["status"]) for r in W.status_changes(events, "doc", "status", ["n"]).collect())


def test_scores(spark):
    judged = spark.createDataFrame([(True, ["a", "b"], ["b", "c"], [], 1.0, 0.5)], "category_correct_guess boolean, pii_should_be_redacted array<string>, pii_actually_redacted array<string>, false_positives array<string>, redaction_completeness double, redaction_accuracy double")
    assert E.document_score(judged).first()["score"] == pytest.approx(0.3 * 0.5 + 0.3 * 0.5 + 0.2 + 0.1 + 0.05)


def test_distance_equals_the_table_of_prefixes():
    r = random.Random(4)
    for n in range(400):
        a = r.choices("abc", k=r.randint(0, 90))
        b = r.choices("abcd", k=r.randint(0, 90)) if n % 2 else ["x" if c == "b" else c for c in a]
        row = [*range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert X.distance(a, b) == row[-1] == X.distance("".join(a), "".join(b))
