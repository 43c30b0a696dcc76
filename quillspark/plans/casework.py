"""Queries over stages of work in the events and over letters with invented values."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import fakes
from quillspark.operators import detect as D
from quillspark.operators import geometry, review, stages, workflow
from quillspark.plans.registry import query, table

DEADLINES = {"click": 3600.0, "purchase": 86400.0, "error": 7200.0}
_TIMES = """WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT user_id, event_id, event_type AS stage, ts AS entered FROM e WHERE before IS NULL OR before <> event_type),
l AS (SELECT *, lead(entered) OVER (PARTITION BY user_id ORDER BY entered, event_id) AS gone FROM s),
t AS (SELECT user_id, stage, entered, gone, epoch_us(coalesce(gone, TIMESTAMP '2024-02-01')) - epoch_us(entered) AS us, CASE stage WHEN 'click' THEN 3600 WHEN 'purchase' THEN 86400 WHEN 'error' THEN 7200 END::BIGINT AS most FROM l)
"""


def _times(spark, sf_dir):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("ts"))
    return stages.stage_times(events, "user_id", "stage", "ts", "event_id", DEADLINES, now)


@query("stage_times", _TIMES + "SELECT user_id, stage, epoch_us(entered) AS entered, us / 1000000.0::DOUBLE AS seconds, coalesce(us > most * 1000000, false) AS late FROM t")
def stage_times(spark, sf_dir):
    return _times(spark, sf_dir).select("user_id", "stage", F.unix_micros("entered").alias("entered"), "seconds", "late")


@query("stage_breaches", _TIMES + "SELECT stage, count(*) AS n, count(*) FILTER (us > most * 1000000) AS late FROM t GROUP BY 1")
def stage_breaches(spark, sf_dir):
    return stages.breaches(_times(spark, sf_dir), "stage").select("stage", "n", "late")


@query("sla_queue", _TIMES + "SELECT user_id, stage, epoch_us(entered) + most * 1000000 AS due FROM t WHERE gone IS NULL AND most IS NOT NULL")
def sla_queue(spark, sf_dir):
    return stages.sla_queue(_times(spark, sf_dir), "user_id").select("user_id", "stage", F.unix_micros("due").alias("due"))


@query(
    "work_sessions",
    "WITH e AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 6 * 3600000000, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "r AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM e) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM r GROUP BY user_id, run",
)
def work_sessions(spark, sf_dir):
    found = stages.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "6 hours")
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def _drawn(name: str, n: int, seed: str = "c_custkey") -> str:
    return f"(('0x' || left(md5('{name}:' || {seed}), 15))::BIGINT % {n})"


_FAKES = f"""WITH d AS (SELECT c_custkey, lpad({_drawn("nhs", 10**9)}::VARCHAR, 9, '0') AS nine, '4' || lpad({_drawn("card", 10**14)}::VARCHAR, 14, '0') AS fifteen,
  {fakes.FIRST}[{_drawn("first", len(fakes.FIRST))} + 1] || ' ' || {fakes.LAST}[{_drawn("last", len(fakes.LAST))} + 1] AS person_name,
  {fakes.PREFIXES}[{_drawn("nin letters", len(fakes.PREFIXES))} + 1] || lpad({_drawn("nin", 10**6)}::VARCHAR, 6, '0') || ['A', 'B', 'C', 'D'][{_drawn("nin last", 4)} + 1] AS nin FROM customer),
w AS (SELECT *, list_sum(list_transform(range(1, 10), lambda i: nine[i]::INT * (11 - i))) % 11 AS rest FROM d),
x AS (SELECT *, CASE WHEN rest = 1 THEN left(nine, 8) || (nine[9]::INT + 1) % 10 ELSE nine END AS n9 FROM w),
y AS (SELECT *, list_filter(range(0, 10), lambda c: (list_sum(list_transform(range(1, 10), lambda i: n9[i]::INT * (11 - i))) + c) % 11 = 0)[1] AS c11,
  list_filter(range(0, 10), lambda c: (list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 0 THEN fifteen[i]::INT WHEN fifteen[i]::INT > 4 THEN fifteen[i]::INT * 2 - 9 ELSE fifteen[i]::INT * 2 END)) + c) % 10 = 0)[1] AS c10 FROM x)
SELECT c_custkey, person_name, nin, left(n9, 3) || ' ' || n9[4:6] || ' ' || n9[7:9] || c11 AS nhs_number, left(fifteen, 4) || ' ' || fifteen[5:8] || ' ' || fifteen[9:12] || ' ' || fifteen[13:15] || c10 AS card, true AS valid FROM y"""


@query("fake_values", _FAKES)
def fake_values(spark, sf_dir):
    """A person's values for each customer; SQL tries check digits out, and the validators of the second detector hold too."""
    v = fakes.values(F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", *(v[k].alias(k) for k in ("person_name", "nin", "nhs_number", "card")), (D.nhs_valid(v["nhs_number"]) & D.nin_valid(v["nin"])).alias("valid"))


def _of(name: str, values: list[str]) -> str:
    return f"{values}[{_drawn(name, len(values), 'doc_id')} + 1]"


_D = lambda name, n: _drawn(name, n, "doc_id")
#: The label Re needs no word's beginning before it, so it cuts a labelled name that ends with it.
_MIXED = f"""WITH d AS (SELECT doc_id, {_D("letter", len(fakes.LETTERS))} AS kind, {_of("first", fakes.FIRST)} AS first, {_of("last", fakes.LAST)} AS last, {_of("child", fakes.FIRST)} || ' ' || {_of("last", fakes.LAST)} AS child, {_of("note", fakes.NOTES)} AS note,
  ({_D("house", 199)} + 1) || ' ' || {_of("street", fakes.STREETS)} || ' ' || {_of("kind", fakes.KINDS)} || ', ' || {_of("area", ["AB", "LS", "NE", "SW", "YO"])} || ({_D("district", 9)} + 1) || ' ' || {_D("sector", 10)} || {_of("unit", ["AA", "BD", "EF", "XY"])} AS place,
  '07700 900' || lpad({_D("phone", 1000)}::VARCHAR, 3, '0') AS phone, {_D("mail", 1000)} AS mail, lpad(({_D("day", 28)} + 1)::VARCHAR, 2, '0') || '/' || lpad(({_D("month", 12)} + 1)::VARCHAR, 2, '0') || '/' || ({_D("year", 60)} + 1940) AS dob,
  {_of("nin letters", fakes.PREFIXES)} || lpad({_D("nin", 10**6)}::VARCHAR, 6, '0') || {_of("nin last", [*"ABCD"])} AS nin, lpad({_D("ref", 10**6)}::VARCHAR, 6, '0') AS ref, lpad({_D("nhs", 10**9)}::VARCHAR, 9, '0') AS nine, '4' || lpad({_D("card", 10**14)}::VARCHAR, 14, '0') AS card
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, first || ' ' || last AS name, regexp_replace(first || ' ' || last, 're$', '') AS labelled, CASE WHEN list_sum(list_transform(range(1, 10), lambda i: nine[i]::INT * (11 - i))) % 11 = 1 THEN left(nine, 8) || (nine[9]::INT + 1) % 10 ELSE nine END AS n9 FROM d),
v AS (SELECT *, left(n9, 3) || ' ' || n9[4:6] || ' ' || n9[7:9] || list_filter(range(0, 10), lambda c: (list_sum(list_transform(range(1, 10), lambda i: n9[i]::INT * (11 - i))) + c) % 11 = 0)[1] AS nhs FROM w),
x AS (SELECT doc_id, unnest(CASE kind
  WHEN 0 THEN [['person_name', 'contact_header', 'Freedom of Information request'], ['person_name', 'field_label', labelled], ['email', 'field_label', lower(first) || '.' || lower(last) || mail || '@mail.example']]
  WHEN 1 THEN [['person_name', 'field_label', labelled], ['dob', 'field_label', dob], ['address', 'field_label', place]]
  WHEN 2 THEN [['person_name', 'contact_header', 'Housing repair'], ['person_name', 'field_label', labelled], ['phone', 'field_label', phone], ['council_ref', 'field_label', 'REF-' || ref], ['council_ref', 'field_label', ref]]
  WHEN 3 THEN [['person_name', 'contact_header', 'Visit note'], ['person_name', 'titled_name', 'Dr ' || name], ['nhs_number', 'field_label', nhs]] || CASE WHEN note IN ('asthma', 'diabetes', 'epilepsy') THEN [['medical_details', 'medical_content', 'The patient has ' || note || '.']] ELSE [] END
  WHEN 4 THEN [['person_name', 'contact_header', 'Note of concern'], ['person_name', 'dependent_name', child], ['phone', 'field_label', phone]]
  ELSE [['person_name', 'field_label', labelled], ['nin', 'field_label', nin], ['phone', 'regex', left(card, 4) || ' ' || card[5:8] || ' ' || card[9:12]], ['person_name', 'standalone_name', name]] END) AS f FROM v)
SELECT doc_id, f[1] AS type, f[2] AS method, f[3] AS value FROM x"""


@query("letters_mixed", _MIXED)
def letters_mixed(spark, sf_dir):
    """All tiers at once: a letter of one of six types before each document's whole text; what is found in the letter."""
    docs = fakes.with_letters(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id")
    docs = docs.select("doc_id", F.length("letter.text").alias("size"), F.concat("letter.text", F.lit("\nDear reader\n"), "text").alias("text"))
    docs = docs.repartition(spark.sparkContext.defaultParallelism) if docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else docs  # letters are made once, before all tiers read them
    spans = D.detect(docs).select("doc_id", "size", F.explode_outer("spans").alias("s")).where(F.col("s.start") < F.col("size"))
    return spans.select("doc_id", "s.type", "s.method", "s.value")


_LAID = """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, ws, array_to_string(ws, ' ') AS flat, array_to_string(ws[3:5], ' ') AS sel, doc_id % 2 = 1 AS given FROM d),
s AS (SELECT *, CASE WHEN given THEN 3 ELSE strpos(lower(flat), lower(sel)) - 1 END AS a0, CASE WHEN given THEN least(length(flat), 14) ELSE strpos(lower(flat), lower(sel)) - 1 + length(sel) END AS z0 FROM q),
g AS (SELECT *, CASE WHEN given THEN a0 + length(flat[a0 + 1:z0]) - length(ltrim(flat[a0 + 1:z0], ' ')) ELSE a0 END AS a, CASE WHEN given THEN a0 + length(rtrim(flat[a0 + 1:z0], ' ')) ELSE z0 END AS z FROM s WHERE length(sel) >= 2 AND (NOT given OR length(flat) > 3)),
k AS (SELECT * FROM g WHERE z - a >= 2 OR NOT given),
w AS (SELECT doc_id, flat, a, z, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM k),
p AS (SELECT *, coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM w),
h AS (SELECT *, pos // 80 AS line, pos % 80 * 10 AS x FROM p WHERE pos < z AND pos + length(w) > a)
SELECT doc_id AS request_id, any_value(flat[a + 1:z]) AS original_value, min(x + floor(greatest(a - pos, 0) / length(w) * (length(w) * 10)))::DOUBLE AS x0, (line * 40)::DOUBLE AS y0, max(x + floor(least(z - pos, length(w)) / length(w) * (length(w) * 10)))::DOUBLE AS x1 FROM h GROUP BY doc_id, line"""


@query("review_from_text", _LAID)
def review_from_text(spark, sf_dir):
    """A selection on each document's page, by its text or by offsets; what it covers of each line."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("page"), "text")
    words = geometry.layout(docs)
    third = F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), 3, 3)
    given = F.col("page") % 2 == 1
    requests = docs.select(F.col("page").alias("request_id"), "page", F.array_join(third, " ").alias("selected"), F.when(given, 14).alias("start"), F.when(given, 3).alias("end"), F.lit(" Case Ref! ").alias("type"), F.lit("asked").alias("reason"))
    found = review.create_from_text(requests, words, "page").where("error IS NULL")
    return found.select("request_id", "original_value", "box.x0", "box.y0", "box.x1")


@query("redaction_totals", "SELECT count(*) AS redactions, count(*) FILTER (l_linestatus = 'F') AS approved, count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'F') AS rejected FROM lineitem SEMI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = l_orderkey")
def redaction_totals(spark, sf_dir):
    """Lines as redactions of the orders that are done."""
    status = F.when(F.col("l_linestatus") == "F", "approved").when(F.col("l_returnflag") == "R", "rejected").otherwise("pending")
    redactions = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), status.alias("status"))
    return workflow.redaction_totals(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")), redactions)
