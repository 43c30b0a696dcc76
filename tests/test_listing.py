from pyspark.sql import functions as F

from quillspark.operators import listing as L


def test_tabs_searches_and_order(spark):
    docs = spark.createDataFrame([(1, "A.pdf", "complete", None), (22, "b.pdf", "ocr", True), (3, None, "error", False)], "id int, name string, status string, flag_needs_review boolean")
    ids = lambda rows: sorted(r["id"] for r in rows.collect())
    assert [ids(docs.where(L.in_tab(t))) for t in ("needs_review", "processed", "failed", "all")] == [[22], [1], [3], [1, 3, 22]]
    assert ids(L.search(docs, "a.P", ["name", "id"])) == [1] and ids(L.search(docs, "2", ["name", "id"])) == [22]
    red = spark.createDataFrame([(1, "pending", "regex", 0.9), (2, "pending", "regex", 0.4), (3, "approved", "regex", 0.1), (4, "pending", "manual", 0.1)], "id int, status string, method string, confidence double")
    assert [r["id"] for r in L.attention_first(red).collect()] == [2, 1, 3, 4]
    pages = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, 2), (2, 1, 5)], "document_id int, page_number int, open int")
    assert {r["document_id"]: r["page_number"] for r in L.next_page(pages, 2).collect()} == {1: 3, 2: 1}
    uses = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 0)], "k string, t int")
    assert [r["k"] for r in L.recent(uses, "k", "t", 2).collect()] == ["a", "b"]
    assert L.shuffled(docs, "id", 1).count() == 3


def test_times_engines_and_status(spark):
    rows = spark.createDataFrame([(None,), ("2024-01-01 11:59:40",), ("2024-01-01 11:30:00",), ("2024-01-01 02:00:00",), ("2023-12-01 00:00:00",)], "t string")
    now = F.to_timestamp(F.lit("2024-01-01 12:00:00"))
    assert [r[0] for r in rows.select(L.relative_time(F.to_timestamp("t"), now)).collect()] == ["—", "just now", "30m ago", "10h ago", "2023-12-01"]
    tags = spark.createDataFrame([("x main_1", "complete"), ("fb_2", "ocr"), ("off", "ocr"), ("", "ocr"), (None, "complete")], "e string, s string")
    assert [r[0] for r in tags.select(L.engine_state(F.col("e"), F.col("s"), "main_1", ["fb_1", "fb_2"], ["off"])).collect()] == ["main", "fallback", "blocked", "pending", "unknown"]
    stages = spark.createDataFrame([("a", True, False, False), ("b", True, True, False), ("c", False, False, True), ("d", False, False, False)], "stage string, done boolean, failed boolean, current boolean")
    got = L.run_status(stages, F.to_timestamp(F.lit("2024-01-01 10:30:00")), now, 2.0).orderBy("stage").collect()
    assert [r["status"] for r in got] == ["complete", "failed", "running", "pending"] and (got[0]["elapsed_hours"], got[0]["cost"]) == (1.5, 3.0)


def test_details(spark):
    docs = spark.createDataFrame([(1, 7), (2, None)], "id long, council_id int")
    pages = spark.createDataFrame([(1, 2), (1, 1)], "document_id long, page_number int")
    red = spark.createDataFrame([(5, 1, 1, "rejected"), (6, 1, 1, "pending")], "id long, document_id long, page_number int, status string")
    audit = spark.createDataFrame([(1, "t2", "b"), (1, "t1", "a")], "document_id long, timestamp string, action string")
    got = {r["id"]: r for r in L.document_detail(docs, pages, red, audit).collect()}
    assert [p["page_number"] for p in got[1]["pages"]] == [1, 2] and [a["action"] for a in got[1]["audit"]] == ["a", "b"] and got[2]["pages"] is None
    readings = spark.createDataFrame([(1, 1, 1, "old"), (1, 1, 2, "new")], "document_id long, page_number int, id int, text string")
    assert {r["page_number"]: (r["redaction_count"], r["text"]) for r in L.page_detail(pages, red, readings).collect()} == {1: (1, "new"), 2: (0, None)}
    records = spark.createDataFrame([(1, "s"), (2, "s")], "document_id long, signature string")
    assert {r["document_id"]: r["accessible"] for r in L.provenance(records, docs, 7).collect()} == {1: True, 2: False}


def test_cascade_and_datasets(spark):
    readings = spark.createDataFrame([("p", "a", 0.8), ("p", "b", 0.9), ("q", "a", 0.5), ("q", "b", 0.4), ("q", "c", 0.45), ("r", "a", 0.5), ("r", "b", 0.6), ("r", "c", 0.99)], "page string, engine string, confidence double")
    got = {r["page"]: r["engine"] for r in L.best_engine(readings, ["page"], [("a", 0.7), ("b", 0.5), ("c", 0.0)]).collect()}
    assert got == {"p": "a", "q": "a", "r": "b"}
    keys = spark.createDataFrame([("d", "t", "see Jo", [("n", "Jo"), ("p", "absent")])], "document_id string, kind string, ground_truth_text string, sensitive_items array<struct<type:string,value:string>>")
    row = L.checked_items(keys).first()
    assert [i["value"] for i in row["sensitive_items"]] == ["Jo"] and row["warnings"] == ["value not in text: p"]
    assert L.item_counts(keys, "kind").first().asDict() == {"kind": "t", "n": 1, "p": 1}
    m = spark.createDataFrame([("A/x.PNG", "t"), ("y", "u")], "image_path string, text string")
    p = spark.createDataFrame([("a/X.png", "one", 0.1, 1), ("a/x.png", "two", 0.2, 2)], "image_path string, prediction string, confidence double, n int")
    assert {r["image_path"]: r["prediction"] for r in L.predictions_for(m, p, "n").collect()} == {"A/x.PNG": "two", "y": None}
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(L.preferred(F.array(*map(F.lit, x)).cast("array<string>"), ["x", "y"])) for x in (["B", "Y"], ["c", "B"], [])] == ["y", "b", ""]
    assert one(L.manifest_key(F.lit("a\\b"), F.lit(None), F.lit(None).cast("string"))) == "a/b|1|"
    assert [one(L.document_split(F.lit(n), [1], [2], [3])) for n in (1, 2, 3, 4)] == ["train", "validation", "test", "holdout"]
