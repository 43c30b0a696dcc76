from pyspark.sql import functions as F

from quillspark.functions import fakes
from quillspark.operators import detect as D
from quillspark.operators import review, stages
from quillspark.sources import io
from quillspark.streaming import pipeline as P


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def modulus_11(digits):
    check = 11 - sum(int(d) * w for d, w in zip(digits, range(10, 1, -1))) % 11
    return check != 10 and (0 if check == 11 else check) == int(digits[9])


def test_fake_values_pass_the_checks_at_any_partitioning(spark):
    kinds = fakes.values(F.col("id"))
    rows = lambda n: spark.range(0, 3000, 1, n).select("id", *(v.alias(k) for k, v in kinds.items()), (D.nhs_valid(kinds["nhs_number"]) & D.nin_valid(kinds["nin"])).alias("ok"))
    one = sorted(map(tuple, rows(1).collect()))
    assert one == sorted(map(tuple, rows(7).collect()))
    at = {k: i + 1 for i, k in enumerate(kinds)}
    assert all(r[-1] and modulus_11(r[at["nhs_number"]].replace(" ", "")) and luhn(r[at["card"]].replace(" ", "")) and len(r[at["card"]]) == 19 for r in one)
    assert len({r[at["nhs_number"]] for r in one}) > 2990 and len({r[at["person_name"]] for r in one}) == len(fakes.FIRST) * len(fakes.LAST)


def test_letters_hold_their_items(spark):
    rows = fakes.with_letters(spark.range(300), "id").select("letter.*").collect()
    assert {r["type"] for r in rows} == set(fakes.LETTERS)
    assert all(i["value"] in r["text"] for r in rows for i in r["items"]) and all("{" not in r["text"] and "\0" not in r["text"] for r in rows)


def test_stage_times(spark):
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    rows = [(1, "a", at(0), 1), (1, "a", at(5), 2), (1, "b", at(10), 3), (1, "a", at(30), 4), (2, "b", at(1), 5), (None, "a", at(2), 6), (3, None, at(3), 7), (3, "b", at(3), 8)]
    events = spark.createDataFrame(rows, "k long, stage string, at string, n long").withColumn("at", F.col("at").cast("timestamp"))
    times = stages.stage_times(events, "k", "stage", "at", "n", {"a": 900, "b": 1200}, F.lit(at(50)).cast("timestamp"))
    got = {(r["k"], r["stage"], r["entered"].minute): (r["seconds"], r["late"], r["left"] is None) for r in times.collect()}
    assert got == {(1, "a", 0): (600, False, False), (1, "b", 10): (1200, False, False), (1, "a", 30): (1200, True, True), (2, "b", 1): (2940, True, True), (None, "a", 2): (2880, True, True), (3, None, 3): (0, False, False), (3, "b", 3): (2820, True, True)}
    assert [(r["k"], r["stage"]) for r in stages.sla_queue(times, "k").collect()] == [(None, "a"), (2, "b"), (3, "b"), (1, "a")]
    assert {(r["stage"], r["n"], r["late"]) for r in stages.breaches(times, "stage").collect()} == {("a", 3, 2), ("b", 3, 2), (None, 1, 0)}


def test_stalled_keys_are_reported_once(spark, tmp_path):
    """The watermark is the clock; one file is one batch."""
    source = str(tmp_path / "in")
    at = lambda m: f"2024-01-01 00:{m:02d}:00"

    def run(rows):
        frame = spark.createDataFrame(rows, "k long, status string, at string").withColumn("at", F.col("at").cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(frame.schema).parquet(source).withWatermark("at", "0 seconds")
        found = P.stalled(stream, "k", "status", "at", "10 minutes")
        query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted((r["k"], r["status"], r["since"].minute) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run([(1, "ocr", at(0)), (2, "ocr", at(0)), (3, "ocr", at(0))]) == []
    assert run([(2, "redact", at(8)), (3, "complete", at(9)), (1, "ocr", at(9))]) == []
    run([(9, "ocr", at(14))])
    assert run([(9, "ocr", at(15))]) == [(1, "ocr", 0)]  # 1 repeats its status, 2 has moved on, 3 is done
    run([(9, "ocr", at(19))])
    assert run([(2, "redact", at(20))]) == [(1, "ocr", 0), (2, "redact", 8)]


def test_redactions_from_selected_text(spark):
    words = [(1, 0, "Dear", 0.0, 0.0, 40.0, 20.0), (1, 1, "Bo", 50.0, 0.0, 70.0, 20.0), (1, 2, "Lee", 0.0, 40.0, 30.0, 60.0), (2, 0, "x", 0.0, 0.0, 10.0, 20.0)]
    frame = spark.createDataFrame([(*w, 0.9) for w in words], "page long, word_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    asked = [(1, 1, "bo  lee", None, None, "Person Name!"), (2, 1, "zz", 9, 5, ""), (3, 1, "not there", None, None, "x"), (4, 1, " B ", None, None, "x"), (5, 3, "Dear", None, None, "x"), (6, 1, "Dear", 0, 1, "x"), (7, 1, None, None, None, "x")]
    requests = spark.createDataFrame([(*a, "why") for a in asked], "request_id long, page long, selected string, start int, end int, type string, reason string")
    rows = review.create_from_text(requests, frame, "page").collect()
    got = sorted((r["request_id"], r["redaction_type"], r["original_value"], tuple(r["box"]) if r["box"] else None, r["status"], r["error"]) for r in rows)
    assert got == [
        (1, "person_name", "Bo Lee", (0.0, 40.0, 30.0, 60.0), "pending", None), (1, "person_name", "Bo Lee", (50.0, 0.0, 70.0, 20.0), "pending", None),
        (2, "manual", "Bo L", (0.0, 40.0, 10.0, 60.0), "pending", None), (2, "manual", "Bo L", (50.0, 0.0, 70.0, 20.0), "pending", None), (3, "x", None, None, None, "not on the page"), (4, "x", None, None, None, "too short"),
        (5, "x", None, None, None, "not on the page"), (6, "x", None, None, None, "too short"), (7, "x", None, None, None, "too short"),
    ]
    assert rows[0]["method"] == "text_selection" and {r["masked_value"] for r in rows} == {"[REDACTED-person_name]", "[REDACTED-manual]", None}


def test_texts_in_buckets(spark, tmp_path):
    rows = spark.range(500).selectExpr("id AS doc_id", "concat('t', id, '\n', 'x') AS text")
    io.write_texts(rows, str(tmp_path / "b"), buckets=8)
    assert len([*(tmp_path / "b").glob("bucket=*")]) == 8
    assert [tuple(r) for r in io.read_text(spark, str(tmp_path / "b"), "doc_id", 77, 8).collect()] == [(77, "t77\nx")]
    assert spark.read.parquet(str(tmp_path / "b")).count() == 500


def test_the_header_of_a_note_does_not_hang_on_the_digits_of_a_number(spark):
    ids = [254851, 364349, 1380423, 2500972]  # their numbers begin with five zeros
    rows = fakes.with_letters(spark.createDataFrame([(i,) for i in ids], "id long"), "id").select("id", F.col("letter.text").alias("text"))
    rows = rows.localCheckpoint()
    assert all("NHS Number: 000 00" in r.text for r in rows.collect())
    found = rows.select("id", F.explode_outer(D.contact_header(F.col("text"))).alias("s")).collect()
    assert sorted((r.id, r.s.type, r.s.value) for r in found) == [(i, "person_name", "Visit note") for i in ids]
