"""What must not come back in plans: work that grows faster than the tables, or that is done again for each reader of a column."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import geometry as G


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def words_of(spark, pages: int, each: int):
    """Pages of `each` words, three to a line of twenty pixels."""
    rows = [(p, n, f"w{n}", 40.0 * (n % 3), 40.0 * (n // 3), 40.0 * (n % 3) + 30, 40.0 * (n // 3) + 20) for p in range(pages) for n in range(each)]
    return spark.createDataFrame(rows[::-1], "page long, word_no int, text string, x0 double, y0 double, x1 double, y1 double")


def test_pages_are_folded_without_a_group_for_each(spark):
    words = words_of(spark, 2, 6)
    for frame in (G.cluster_lines(words, "page"), G.first_fit_lines(words, "page")):
        assert "FlatMapGroups" not in plan(frame)


def test_pages_go_on_over_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "4")
    try:
        words = words_of(spark, 5, 9)
        lines = G.cluster_lines(words, "page").orderBy("page", "line").collect()
        groups = G.first_fit_lines(words, "page").collect()
    finally:
        spark.conf.set(name, before)
    assert [(r.page, r.line, r.text, r.y0, r.x1) for r in lines] == [(p, n, f"w{3 * n} w{3 * n + 1} w{3 * n + 2}", 40.0 * n, 110.0) for p in range(5) for n in range(3)]
    assert sorted((r.page, r.word_no, r["group"]) for r in groups) == [(p, n, n // 3) for p in range(5) for n in range(9)]


def test_values_in_known_places_meet_one_line(spark):
    words = words_of(spark, 1, 90)
    text = "\n".join(f"w{3 * n} w{3 * n + 1} w{3 * n + 2}" for n in range(30))
    values = spark.createDataFrame([(0, 1, "notes", text.index("w0"), "w0"), (0, 2, "notes", text.index("w87"), "w87")], "page long, value_id int, type string, start int, value string")
    asked = spark.sparkContext.accumulator(0)

    def counted(wanted, norm):
        @F.udf("double")
        def one(a, b):
            asked.add(1 if a is not None else 0)
            return 0.0

        return one(wanted, norm)

    similarity, G.X.similarity = G.X.similarity, counted
    try:
        found = G.map_values(values, spark.createDataFrame([(0, text)], "page long, text string"), G.cluster_lines(words, "page"), "page", 4000.0, 4000.0).collect()
    finally:
        G.X.similarity = similarity
    assert {(r.value_id, r.confidence) for r in found} == {(1, 0.8), (2, 0.7)} and asked.value == 0


def test_spans_of_letters_are_found_once_and_on_all_cores(spark, tmp_path):
    from quillspark.plans import letters, registry  # noqa: F401

    spark.createDataFrame([(k, f"Customer#{k}") for k in range(20)], "c_custkey long, c_name string").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    for name in ("letters_field_labels", "letters_contact_header", "letters_medical_content", "letters_model_spans"):
        text = plan(registry.QUERIES[name](spark, str(tmp_path)))
        assert not [line for line in text.splitlines() if "Filter" in line and ("regexp" in line or "position" in line.lower())]
        assert "Repartition" in text


def test_matches_of_texts_that_hold_the_mark(spark):
    from quillspark.functions import spans as S

    rows = spark.createDataFrame([("a1b22",), ("a1\x01b22\x01",), ("",), (None,), ("x",)], "t string")
    found = [r.m for r in rows.select(S.matches(F.col("t"), "[0-9]+").alias("m")).collect()]
    assert [[tuple(m) for m in x or []] for x in found] == [[(1, 2, "1"), (3, 5, "22")], [(1, 2, "1"), (4, 6, "22")], [], [], []]
    text = plan(rows.select(S.matches(F.col("t"), "[0-9]+")))
    assert "regexp_replace" in text  # a split at a pattern compiles it for each text


def test_keys_of_hooks_are_padded_before_they_meet_events(spark):
    import hashlib
    import hmac

    from quillspark.streaming import delivery

    hooks = spark.createDataFrame([("u", True, [], "key one"), ("v", True, ["b"], "k" * 70), ("w", True, ["a", "a"], None)], "url string, active boolean, events array<string>, secret string")
    events = spark.createDataFrame([(n, "ab"[n % 2]) for n in range(6)], "event_id long, event string")
    found = delivery.payloads(events, hooks, {"id": F.col("event_id")})
    upper = plan(found).split("Join")[0]
    assert "sequence(0, 63" not in upper and "transform" not in upper
    keys = {"u": b"key one", "v": b"k" * 70}
    rows = found.collect()
    assert len(rows) == 12
    for r in rows:
        assert r.signature == (hmac.new(keys[r.url], r.body.encode(), hashlib.sha256).hexdigest() if r.url in keys else None)


def test_base_32_without_bit_strings(spark):
    import base64

    from quillspark.functions import scalars as X

    data = [bytes(range(n, 2 * n)) for n in range(0, 34)]
    rows = spark.createDataFrame([(d,) for d in data], "d binary").select(X.base32(F.col("d")).alias("b"), "d")
    assert [r.b for r in rows.collect()] == [base64.b32encode(d).decode().rstrip("=") for d in data]
    assert "split" not in plan(rows.select(X.export_id("QS", F.col("b"), F.lit(1), b"key").alias("x")))


def test_a_name_may_end_like_a_label(spark):
    from quillspark.operators import safety

    rows = spark.createDataFrame([("Shanre anin",), ("Re anin",), ("Name: Anna",), ("Dear all",), ("Anna Billow",)], "t string")
    assert [r.n for r in rows.select(safety.named(F.col("t")).alias("n")).collect()] == [True, False, False, False, True]


def test_pieces_come_with_the_cut(spark):
    from quillspark.functions import spans as S

    texts = ["One. Two!\r\n\n  Three?  ", "a\x01b. c\n", "", "\n", "é. \U0001f600! x", "\x01", "no end"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.sentences(F.col("t")).alias("s"), S.lines(F.col("t")).alias("l"), S.sentence_count(F.col("t")).alias("n"))
    for r in rows.collect():
        assert [r.t[s.start : s.end] for s in r.s] == [s.value for s in r.s] == [x for x in (v.strip() for v in __import__("re").split(r"(?<=[.!?])\s+|\n", r.t)) if x] and r.n == len(r.s)
        assert [r.t[x.start : x.end] for x in r.l] == [x.value for x in r.l] == [x.rstrip("\r") for x in r.t.split("\n")]
    assert "substring" not in plan(rows)  # it reads a text from its beginning for every piece


def test_gates_of_labels_say_the_same(spark):
    from quillspark.functions import fixed_values as V
    from quillspark.operators import detect as D

    texts = ["n.i. 1", "ani x", "in i", "NI: 3", "n.h.s", "n m s", "unhs", "Ref : 3", "refer", "reference=", "d.o.b", "do.b", "D.OB", "Direcci\u00f3n", "\u0130n\u0131: ", "Phone 1", "microphone 1", "PCN 1", "xPCN 1", "", "tale", "School 3"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", D.folded(F.col("t")))
    one = rows.select("t", F.col("low").rlike("(?U)" + "|".join(D.LABEL_GATES.values())).alias("a"), D._may_hold_label(F.col("low")).alias("b"), F.col("t").rlike(D._ci("|".join(V.LABELS.values()))).alias("c"), F.col("t").rlike(D._ci(D._any_of([*V.LABELS.values()]))).alias("d"))
    found = one.collect()
    assert all(r.a == r.b and r.c == r.d for r in found) and {r.a for r in found} == {r.c for r in found} == {True, False}


def test_texts_not_words_are_shuffled(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "c"), (None, "d  e")], "page long, text string")
    words = G.word_spans(G.layout(rows), "page")
    assert sorted(((r.page or 0), r.word_no, r.text, r.start, r.x0) for r in words.collect()) == [(0, 0, "d", 0, 0.0), (0, 1, "e", 2, 20.0), (1, 0, "a", 0, 0.0), (1, 1, "b", 2, 20.0), (3, 0, "c", 0, 0.0)]
    text = words._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert text.count("Exchange ") == 1 and text.index("Generate posexplode") < text.index("Exchange ")


def test_lines_of_a_small_table_are_not_sent_to_every_task(spark, tmp_path):
    from quillspark.plans import records, registry  # noqa: F401

    spark.createDataFrame([(k, f"Customer#{k}") for k in range(20)], "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    for name in ("boxes_mapped_values", "boxes_of_spans", "boxes_on_lines"):
        text = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "BroadcastExchange" not in text


def test_boxes_are_found_once_before_they_are_put_apart(spark):
    from quillspark.operators import safety

    boxes = spark.createDataFrame([(1, 0, 0, 10, 10), (1, 5, 5, 20, 8)], "page long, x0 long, y0 long, x1 long, y1 long")
    assert plan(safety.disjoint(boxes, "page")).count("LogicalRDD") == 1
    words = words_of(spark, 1, 6)
    pages = spark.createDataFrame([(0, 1000.0, 1000.0, 0.4, None)], "page long, width double, height double, sureness double, allowed array<string>")
    text = plan(safety.safety_masks(words, pages, "page"))
    assert not [line for line in text.splitlines() if "Filter" in line and "flatten(" in line]  # as Spark makes of a plain explode
