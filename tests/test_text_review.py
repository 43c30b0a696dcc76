import pytest
from pyspark.sql import functions as F

from quillspark import backends
from quillspark.operators import detect as D
from quillspark.operators import geometry as G
from quillspark.operators import review as R
from quillspark.operators import text as T
from quillspark.operators import workflow as W
from quillspark.streaming import pipeline as P

ITEMS = "array<struct<type:string,value:string,uncertain:boolean>>"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def box(*x):
    return F.struct(*(F.lit(float(v)).alias(n) for v, n in zip(x, ("x0", "y0", "x1", "y1"))))


def test_selections_and_chunks(spark):
    assert tuple(value(spark, T.selection(F.lit("a  bcd  e"), F.lit(7), F.lit(1)))) == (3, 6, "bcd")
    assert tuple(value(spark, T.found_selection(F.lit("x One\n (two) y"), F.lit("one (TWO)")))) == (2, 12, "One\n (two)")
    assert value(spark, T.found_selection(F.lit("x"), F.lit("absent"))) is None
    text = " ".join(f"Sentence number {i}." for i in range(40))
    parts = value(spark, T.chunks(F.lit(text), 100))
    assert " ".join(parts) == text and all(len(p) <= 100 for p in parts) and len(parts) < 12
    assert [tuple(h) for h in value(spark, T.highlights(F.lit("É aé éA"), "é"))] == [(0, 1, "É"), (3, 4, "é"), (5, 6, "é")]


def test_model_answers(spark):
    got = value(spark, T.repaired_json(F.lit('Sure!\n```json\n{"a": 3, "x": {"y": 1}}\n``` bye'), "a int, b string", {"a": F.lit(0), "b": F.lit("none")}))
    assert (got["a"], got["b"]) == (3, "none")
    assert value(spark, T.repaired_json(F.lit("no object"), "a int", {"a": F.lit(7)}))["a"] == 7
    rows = spark.createDataFrame([("Tel 555 123", [("phone", "555-123", False), ("nin", "AB 1", False), ("name", "Tel", True), ("x", "zz", False)])], f"t string, items {ITEMS}")
    warnings = rows.select(T.reading_warnings(F.col("t"), F.col("items"), ["nin", "phone"]).alias("w")).first()["w"]
    assert [(w["type"], w["severity"]) for w in warnings] == [("phone", "low"), ("nin", "high"), ("name", "low"), ("x", "medium")]
    rows = spark.createDataFrame([("My NAME is Jo Li", [("full_name", " jo li "), ("pcn", "absent"), ("other", "y")])], "t string, f array<struct<type:string,value:string>>")
    assert [(s["type"], s["start"], s["end"]) for s in rows.select(T.field_spans(F.col("t"), F.col("f")).alias("s")).first()["s"]] == [("person_name", 11, 16)]
    assert [value(spark, T.field_label(F.lit(x))) for x in ("Name: x", "phone 1", "other")] == ["Name", "phone", None]


def test_injected_models(spark):
    class Upper:
        available = True

        def items(self, texts):
            if any("boom" in t for t in texts):
                raise RuntimeError
            return [[("person_name", w) for w in t.split() if w.isupper()] for t in texts]

    docs = spark.createDataFrame([("see ANN now",), (None,)], "text string").coalesce(1)
    assert [len(r["items"]) for r in backends.with_items(docs).collect()] == [0, 0]
    found = backends.with_items(docs, Upper)
    assert [[i["value"] for i in r["items"]] for r in found.collect()] == [["ANN"], []]
    spans = D.detect(found.where("text IS NOT NULL"), extra=D.model_spans(F.col("text"), F.col("items"))).first()["spans"]
    assert [(s["method"], s["start"]) for s in spans] == [("llm", 4)]
    assert [len(r["items"]) for r in backends.with_items(spark.createDataFrame([("boom A",)], "text string"), Upper).collect()] == [0]
    mixed = backends.with_items(spark.createDataFrame([("boom A",), ("Good B",)], "text string").coalesce(1), Upper).orderBy("text").collect()
    assert [(len(r["items"]) > 0, r["items_error"] is None) for r in mixed] == [(True, True), (False, False)]  # a failure costs its own row
    long = "x" * 5000 + " LAST"
    seen = backends.with_items(spark.createDataFrame([(long,)], "text string"), Upper).first()["items"]
    assert "LAST" in [i["value"] for i in seen]  # whole texts


def test_boxes_of_labels_and_pages(spark):
    w, h = F.lit(100.0), F.lit(100.0)
    assert tuple(value(spark, G.normal_box(box(90, 20, -5, 10.123), w, h))) == (0, 10.12, 90, 20)
    assert value(spark, G.normal_box(box(1, 1, 3, 50), w, h)) is None and value(spark, G.normal_box(box(1, float("nan"), 30, 50), w, h)) is None
    assert tuple(value(spark, G.padded(box(10, 10, 20, 98), w, h))) == (4, 4, 26, 100)
    assert tuple(value(spark, G.corner(F.array(F.lit(0.3), F.lit(0.1), F.lit(0.1))))) == (1, True)
    lines = spark.createDataFrame([(1, 0, "Name: Jo Li", 0.0, 0.0, 110.0, 20.0), (1, 1, "Phone: none", 0.0, 30.0, 110.0, 50.0), (1, 2, "free text", 0.0, 60.0, 90.0, 80.0)], "page long, line int, text string, x0 double, y0 double, x1 double, y1 double")
    got = G.label_lines(lines, "page", {"person_name": r"^name\s*:", "phone": r"^phone\s*:"}).collect()
    assert [(r["type"], r["value"], r["box"]["x0"]) for r in got] == [("person_name", "Jo Li", 50.0)]


def test_routing_and_exports(spark):
    schema = "id long, pages int, least_box_confidence double, ocr_confidence double, transcription_confidence double, vision_complete boolean, vision_warnings int, selected_category string, category string, profiles array<string>, error string"
    rows = [(1, 1, 0.9, 0.9, None, True, 0, "", "waste", ["general_pii"], None), (2, 3, 0.5, 0.6, 0.1, False, 2, "parking", "foi_legal", ["general_pii"], None), (3, None, None, None, None, None, None, None, "waste", [], "broken")]
    got = {r["id"]: r for r in R.route(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1]["reason"], got[1]["status"]) == ("", "complete") and got[3]["status"] == "failed"
    assert got[2]["reason"].count("; ") == 7 and got[2]["status"] == "needs_review"
    out = R.export_checks(spark.createDataFrame([(1, True, None), (2, True, True)], "id int, a boolean, b boolean"), {"a": F.col("a"), "b": F.col("b")})
    assert [(r["export_allowed"], r["failed_checks"]) for r in out.collect()] == [(False, ["b"]), (True, [])]


def test_pages_and_undo(spark):
    pages = spark.createDataFrame([(1, 2, "two", "e2", 0.5, "complete", 1, 3), (1, 1, "one", "e1", None, "failed", 0, 2), (2, 1, None, "e1", None, None, None, None)], "document_id long, page_number int, text string, engine string, ocr_confidence double, vision_status string, vision_warnings int, boxes int")
    texts = {r["document_id"]: r for r in R.page_text(pages).collect()}
    assert texts[1]["text"] == "--- Page 1 ---\none\n\n--- Page 2 ---\ntwo" and texts[1]["engines"] == "e1,e2"
    summary = {r["document_id"]: r["summary"] for r in R.confidence_summary(pages).collect()}
    assert tuple(summary[1]) == (2, 0.5, 1, 1, 5) and tuple(summary[2]) == (1, 0.0, 0, 0, 0)
    docs = spark.createDataFrame([(1, "in_review"), (2, "exported")], "id long, status string")
    cand = spark.createDataFrame([(1, 9, "modify", "approved"), (2, 8, "create", "pending")], "document_id long, id long, action_type string, previous_status string")
    assert [(r["document_id"], r["reason"], r["new_status"]) for r in R.undone(cand, docs).collect()] == [(1, "undo:9", "approved")]
    red = spark.createDataFrame([(1, "x")], "id int, original_value string")
    assert R.redaction_rows(red, "admin").first()["original_value"] == "x" and R.redaction_rows(red, "public_facing").first()["original_value"] is None


def test_webhooks_tenants_and_retention(spark):
    events = spark.createDataFrame([(1, "uploaded"), (2, "complete")], "document_id long, event string")
    hooks = spark.createDataFrame([("u1", ["complete"], True), ("u2", [], True), ("u3", [], False)], "url string, events array<string>, active boolean")
    assert sorted((r["url"], r["body"]) for r in P.webhook_payloads(events, hooks, b"k").collect()) == [("u1", '{"document_id":2,"event":"complete"}'), ("u2", '{"document_id":1,"event":"uploaded"}'), ("u2", '{"document_id":2,"event":"complete"}')]
    rows = spark.createDataFrame([(1, 5), (2, None)], "id int, council_id int")
    assert [r["id"] for r in W.tenant(rows, 5).collect()] == [1] and [r["id"] for r in W.tenant(rows, None).collect()] == [2]
    docs = spark.createDataFrame([(1, "waste", "2010-01-01"), (2, "waste", "2022-01-01"), (3, "x", "2015-01-01")], "id int, category string, d string").withColumn("created_at", F.to_timestamp("d"))
    policies = spark.createDataFrame([("waste", 3)], "category string, retention_years int")
    assert sorted(r["id"] for r in W.retention_due(docs, policies, F.to_timestamp(F.lit("2024-01-01"))).collect()) == [1, 3]
    with pytest.raises(ValueError):
        W.since(docs, "created_at", F.current_timestamp(), 0)
