"""Named queries over the driver's tables, each with the SQL it must equal where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.functions import scalars as X
from quillspark.functions import spans as S
from quillspark.operators import classify as C
from quillspark.operators import detect as D
from quillspark.operators import evaluate as E
from quillspark.operators import geometry as G
from quillspark.operators import integrity as I
from quillspark.operators import review as R
from quillspark.operators import text as T
from quillspark.operators import workflow as W

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark, sf_dir: str, *columns: str) -> DataFrame:
    """Documents for work that is heavy on each row: a small table in fewer parts than the cluster has cores is dealt
    out; a large one has parts enough and is not shuffled."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    docs = docs.select(*columns) if columns else docs
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def dealt(rows: DataFrame, each: int = 4) -> DataFrame:
    """Small rows for work that is heavy on each: dealt over the cluster, however few parts their table was read in."""
    return rows.repartition(each * rows.sparkSession.sparkContext.defaultParallelism)


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return register


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# -- spans of structured types ----------------------------------------------------------------------------------------


def _sql_spans(kind: str) -> str:
    """Offsets from interlocking hits and gaps, as SQL."""
    pattern = _quoted(V.STRUCTURED[kind][0])
    return f"""
SELECT doc_id, {_quoted(kind)} AS type, g[i].len + i_hits AS start_at, g[i].len + i_hits + len(h[i]) AS end_at, h[i] AS value FROM (
  SELECT doc_id, h, i, list_transform(g, lambda x: {{'len': x}}) AS g, coalesce(list_sum(list_transform(h[1:i-1], lambda x: len(x))), 0)::BIGINT AS i_hits FROM (
    SELECT doc_id, h, list_transform(generate_series(1, len(s)), lambda k: list_sum(list_transform(s[1:k], lambda x: len(x)))::BIGINT) AS g, unnest(generate_series(1, len(h))) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, {pattern}) AS h, string_split_regex(text, {pattern}) AS s FROM documents) WHERE len(h) > 0))"""


def _spans_of(kind: str):
    def run(spark, sf_dir):
        found = F.explode(S.matches(F.col("text"), V.STRUCTURED[kind][0])).alias("m")
        rows = texts(spark, sf_dir, "doc_id", "text").where(F.col("text").rlike(V.STRUCTURED[kind][0])).select("doc_id", found)
        return rows.select("doc_id", F.lit(kind).alias("type"), F.col("m.start").cast("long").alias("start_at"), F.col("m.end").cast("long").alias("end_at"), F.col("m.value").alias("value"))

    return run


for _kind in ("email", "postcode", "nin", "council_ref"):
    query(f"spans_{_kind}", _sql_spans(_kind))(_spans_of(_kind))


@query("redact_email", f"SELECT doc_id, regexp_replace(text, {_quoted(V.STRUCTURED['email'][0])}, '[REDACTED-email]', 'g') AS redacted FROM documents")
def redact_email(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", S.redact(t, S.typed("email", S.matches(t, V.STRUCTURED["email"][0]), 0.9, "regex")).alias("redacted"))


@query("redact_documents")
def redact_documents(spark, sf_dir):
    """The structured tier with overlaps resolved, filtered by the profiles of the estimated category."""
    docs = texts(spark, sf_dir, "doc_id", "text").withColumn("category", C.keyword_estimate(F.col("text")))
    allowed = C.allowed_types(C.profiles(F.col("category")))
    found = docs.withColumn("allowed", allowed).withColumn("spans", S.by_start(S.add_free(S.none(), D.structured(F.col("text")))))
    kept = F.filter("spans", lambda s: F.array_contains(F.col("allowed"), s["type"]))
    return found.withColumn("spans", kept).select("doc_id", "category", F.size("spans").cast("long").alias("n_spans"), S.redact(F.col("text"), F.col("spans")).alias("redacted"))


@query("detect_all_tiers")
def detect_all_tiers(spark, sf_dir):
    docs = texts(spark, sf_dir, "doc_id", "text")
    found = D.detect(docs).select("doc_id", F.explode_outer("spans").alias("s"))  # explode would compute the spans twice: once to filter
    return found.where("s IS NOT NULL").select("doc_id", "s.*")


@query("identifier_spans")
def identifier_spans(spark, sf_dir):
    docs = texts(spark, sf_dir, "doc_id", "text").select("doc_id", F.explode(D.identifiers(F.col("text"))).alias("s"))
    return docs.select("doc_id", "s.*")


@query(
    "sentence_counts",
    r"SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '[\n\x01]'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> ''))::BIGINT AS n_sentences, len(string_split(text, chr(10)))::BIGINT AS n_lines FROM documents",
)
def sentence_counts(spark, sf_dir):
    t = F.col("text")
    return texts(spark, sf_dir, "doc_id", "text").select("doc_id", S.sentence_count(t).cast("long").alias("n_sentences"), F.size(F.split(t, "\n", -1)).cast("long").alias("n_lines"))


# -- classification -------------------------------------------------------------------------------------------------

_SCORE = {c: " + ".join(f"len(string_split(lower(text), {_quoted(k.lower())})) * {len(k.split())} - {len(k.split())}" for k in words) for c, words in V.CATEGORIES.items()}
_LIST = "[" + ", ".join(f"({x})" for x in _SCORE.values()) + "]"
_NAMES = "[" + ", ".join(map(_quoted, V.CATEGORIES)) + "]"


@query(
    "classify_documents",
    f"SELECT doc_id, CASE WHEN list_max(s) > 0 THEN {_NAMES}[list_position(s, list_max(s))] ELSE 'unknown' END AS category, CASE WHEN list_max(s) > 0 THEN round(list_max(s) / list_sum(s), 4) ELSE 0.0 END::DOUBLE AS confidence FROM (SELECT doc_id, {_LIST} AS s FROM documents)",
)
def classify_documents(spark, sf_dir):
    found = texts(spark, sf_dir, "doc_id", "text").select("doc_id", C.category(F.col("text")).alias("c"))
    return found.select("doc_id", "c.category", "c.confidence")


def _sql_present(words) -> str:
    return "(" + " + ".join(f"contains(lower(text), {_quoted(w.lower())})::INT" for w in words) + ")"


_ESTIMATE = f"(SELECT *, [{', '.join(_sql_present(w) for w in V.CATEGORIES.values())}] AS n FROM documents)"
_ESTIMATED = f"CASE WHEN list_max(n) > 0 THEN {_NAMES}[list_position(n, list_max(n))] ELSE 'unknown' END"


@query(
    "department_routing",
    f"SELECT department, count(*) AS n FROM (SELECT CASE c {' '.join(f'WHEN {_quoted(k)} THEN {_quoted(v)}' for k, v in V.DEPARTMENTS.items())} END AS department FROM (SELECT {_ESTIMATED} AS c FROM {_ESTIMATE})) GROUP BY 1",
)
def department_routing(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(C.department(C.keyword_estimate(F.col("text"))).alias("department"))
    return rows.groupBy("department").agg(F.count("*").alias("n"))


_FLAGS = "list_filter([" + ", ".join(f"CASE WHEN {_sql_present(w)} > 0 THEN {_quoted(k)} END" for k, w in V.RISK_KEYWORDS.items()) + "], lambda x: x IS NOT NULL)"
_MOOD = f"CASE WHEN {_sql_present(V.DISTRESS_WORDS)} > 0 THEN 'distressed' WHEN {_sql_present(V.ANGRY_WORDS)} > 0 THEN 'angry' WHEN {_sql_present(V.NEGATIVE_WORDS)} > {_sql_present(V.POSITIVE_WORDS)} THEN 'negative' WHEN {_sql_present(V.POSITIVE_WORDS)} > {_sql_present(V.NEGATIVE_WORDS)} THEN 'positive' ELSE 'neutral' END"
_BASE = "CASE category " + " ".join(f"WHEN {_quoted(k)} THEN {v}" for k, v in V.URGENCY_BASE.items()) + " ELSE 0.2 END"


def _analysed(spark, sf_dir):
    t = F.col("text")
    rows = C.once(texts(spark, sf_dir, "doc_id", "text"), category=C.keyword_estimate(t), flags=C.risk_flags(t), sentiment=C.sentiment(t))
    return rows.withColumn("urgency", C.urgency(F.col("category"), F.col("flags"), F.col("sentiment")))


_ANALYSED = f"(SELECT *, round(least(1.0, {_BASE} + 0.2 * len(flags) + CASE WHEN sentiment IN ('angry', 'distressed') THEN 0.1 ELSE 0 END), 4)::DOUBLE AS urgency FROM (SELECT *, {_ESTIMATED} AS category, {_FLAGS} AS flags, {_MOOD} AS sentiment FROM {_ESTIMATE}))"


@query("urgency_scores", f"SELECT doc_id, category, array_to_string(flags, ',') AS flags, sentiment, urgency, CASE WHEN len(flags) > 0 THEN 0.75 ELSE 0.6 END::DOUBLE AS confidence FROM {_ANALYSED}")
def urgency_scores(spark, sf_dir):
    return _analysed(spark, sf_dir).select("doc_id", "category", F.array_join("flags", ",").alias("flags"), "sentiment", "urgency", C.analysis_confidence(F.col("flags")).alias("confidence"))


@query(
    "review_queue",
    f"SELECT doc_id, category, urgency FROM {_ANALYSED} WHERE category IN ('foi_legal', 'unknown', 'children_safeguarding') ORDER BY urgency DESC NULLS LAST, doc_id LIMIT 50",
)
def review_queue(spark, sf_dir):
    rows = _analysed(spark, sf_dir)
    status = C.final_status(C.requires_review(F.col("category"), C.profiles(F.col("category"))), F.lit(None))
    rows = rows.select(F.col("doc_id").alias("id"), "category", F.col("urgency").alias("urgency_score"), status.alias("status"), F.lit(None).cast("timestamp").alias("created_at"))
    return W.review_queue(rows, limit=50).select(F.col("id").alias("doc_id"), "category", F.col("urgency_score").alias("urgency"))


@query(
    "priority_buckets",
    f"SELECT CASE WHEN urgency >= 0.8 THEN 'urgent' WHEN urgency >= 0.5 THEN 'high' ELSE 'normal' END AS bucket, count(*) AS n, max(urgency) AS most FROM {_ANALYSED} GROUP BY 1",
)
def priority_buckets(spark, sf_dir):
    return _analysed(spark, sf_dir).groupBy(C.priority_bucket(F.col("urgency")).alias("bucket")).agg(F.count("*").alias("n"), F.max("urgency").alias("most"))


_REVIEWED = "category IN ('foi_legal', 'unknown', 'children_safeguarding')"


@query(
    "dashboard",
    f"SELECT count(*) AS total, count(*) FILTER (NOT {_REVIEWED}) AS complete, count(*) FILTER ({_REVIEWED}) AS review, 0::BIGINT AS errors, count(*) FILTER (len(flags) > 0) AS safeguarding_alerts, round(100.0 * count(*) FILTER (NOT {_REVIEWED}) / count(*), 1)::DOUBLE AS auto_approval_rate, round(count(*) * 0.33::DOUBLE, 1) AS hours_saved FROM {_ANALYSED}",
)
def dashboard(spark, sf_dir):
    rows = _analysed(spark, sf_dir)
    status = C.final_status(C.requires_review(F.col("category"), C.profiles(F.col("category"))), F.lit(None))
    return W.dashboard(rows.select(status.alias("status"), F.col("flags").alias("risk_flags")))


@query("category_counts", f"SELECT category, count(*) AS n FROM {_ANALYSED} WHERE category <> 'unknown' GROUP BY 1")
def category_counts(spark, sf_dir):
    return W.category_counts(_analysed(spark, sf_dir))


_ALLOWED = {c: ",".join(sorted({t for p in ps for t in V.PROFILES[p]})) for c, ps in V.CATEGORY_PROFILES.items()}


@query("profile_types", f"SELECT category, count(*) AS n, CASE category {' '.join(f'WHEN {_quoted(k)} THEN {_quoted(v)}' for k, v in _ALLOWED.items())} END AS types FROM {_ANALYSED} GROUP BY 1")
def profile_types(spark, sf_dir):
    rows = _analysed(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))
    return rows.withColumn("types", F.array_join(C.allowed_types(C.profiles(F.col("category"))), ","))


@query("role_masking")
def role_masking(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("+1 555 "), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("phone"))
    return rows.select("c_custkey", D.visible("caseworker", F.lit("phone"), F.col("phone")).alias("caseworker"), D.visible("auditor", F.lit("phone"), F.col("phone")).alias("auditor"), D.visible("someone", F.lit("phone"), F.col("phone")).alias("someone"))


ORACLE_SQL["role_masking"] = "SELECT c_custkey, 'XXX-XXX-' || right('1555' || lpad(c_custkey::VARCHAR, 7, '0'), 4) AS caseworker, '+1 555 ' || lpad(c_custkey::VARCHAR, 7, '0') AS auditor, '[REDACTED-phone]' AS someone FROM customer"

# -- checks of identifiers --------------------------------------------------------------------------------------------

_TEN = "lpad((c_custkey * 7919 + 4000000000)::VARCHAR, 10, '0')"
_SUM = " + ".join(f"substr(v, {i + 1}, 1)::INT * {10 - i}" for i in range(9))


@query("nhs_checksum", f"SELECT c_custkey, (CASE 11 - ({_SUM}) % 11 WHEN 11 THEN 0 ELSE 11 - ({_SUM}) % 11 END) = substr(v, 10, 1)::INT AS valid FROM (SELECT c_custkey, {_TEN} AS v FROM customer)")
def nhs_checksum(spark, sf_dir):
    value = F.lpad((F.col("c_custkey") * 7919 + 4000000000).cast("string"), 10, "0")
    return table(spark, sf_dir, "customer").select("c_custkey", D.nhs_valid(value).alias("valid"))


_NIN = "chr((65 + c_custkey % 26)::INT) || chr((65 + (c_custkey * 7) % 26)::INT) || ' ' || lpad((c_custkey % 1000000)::VARCHAR, 6, '0') || chr((65 + c_custkey % 6)::INT)"


@query(
    "nin_validate",
    f"SELECT c_custkey, regexp_full_match(v, '[{V.NIN_FIRST}][{V.NIN_SECOND}][0-9]{{6}}[{V.NIN_LAST}]') AND left(v, 2) NOT IN ({', '.join(map(_quoted, V.NIN_BANNED))}) AS valid FROM (SELECT c_custkey, replace({_NIN}, ' ', '') AS v FROM customer)",
)
def nin_validate(spark, sf_dir):
    k = F.col("c_custkey")
    letter = lambda c: F.chr((65 + c).cast("int"))
    value = F.concat(letter(k % 26), letter((k * 7) % 26), F.lit(" "), F.lpad((k % 1000000).cast("string"), 6, "0"), letter(k % 6))
    return table(spark, sf_dir, "customer").select("c_custkey", D.nin_valid(value).alias("valid"))


# -- events as a workflow ---------------------------------------------------------------------------------------------


@query("status_changes", "SELECT event_id, user_id, event_type, previous FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE previous IS NULL OR previous <> event_type")
def status_changes(spark, sf_dir):
    return W.status_changes(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "user_id", "event_type", "previous")


@query("latest_event", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def latest_event(spark, sf_dir):
    return W.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("event_id").desc()]).select("user_id", "event_type", "event_id")


@query("history_page", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def history_page(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("reviewed_at"), "user_id", "event_type")
    return W.history(rows).select(F.col("id").alias("event_id"), "user_id", "event_type")


@query("recent_events", "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS GROUP BY 1")
def recent_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    newest = rows.agg(F.max("ts").alias("as_of"))
    return W.since(rows.join(F.broadcast(newest)), "ts", F.col("as_of"), 7).groupBy("event_type").agg(F.count("*").alias("n"))


_REVIEWS = "(SELECT event_id AS id, user_id AS document_id, CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'view' THEN 'create' WHEN 'click' THEN 'modify' WHEN 'error' THEN 'remove' ELSE 'undo' END AS action_type, ts AS reviewed_at, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)"


def _reviews(spark, sf_dir):
    kind = F.col("event_type")
    action = F.when(kind == "purchase", "approve").when(kind == "view", "create").when(kind == "click", "modify").when(kind == "error", "remove").otherwise("undo")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("document_id"), action.alias("action_type"), F.col("ts").alias("reviewed_at"), F.concat(F.lit("undo:"), before.cast("string")).alias("reason"))


@query(
    "undo_candidates",
    f"SELECT document_id, id, action_type FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY reviewed_at DESC, id DESC) AS n FROM {_REVIEWS} WHERE action_type <> 'undo' AND id NOT IN (SELECT before FROM {_REVIEWS} WHERE action_type = 'undo' AND before IS NOT NULL)) WHERE n = 1",
)
def undo_candidates(spark, sf_dir):
    return W.undo_candidates(_reviews(spark, sf_dir), ["approve", "create", "modify", "remove"]).select("document_id", "id", "action_type")


@query("current_state", f"SELECT document_id AS redaction_id, arg_max(action_type, (reviewed_at, id)) AS status, count(*) AS n_events FROM {_REVIEWS} GROUP BY 1")
def current_state(spark, sf_dir):
    rows = _reviews(spark, sf_dir).select(F.col("document_id").alias("redaction_id"), F.col("action_type").alias("new_status"), "reviewed_at", "id")
    return W.current_state(rows)


@query(
    "batch_progress",
    "SELECT o_orderkey AS batch_id, count(*) AS total, count(*) FILTER (l_linestatus = 'F' OR l_returnflag = 'R') AS processed, count(*) FILTER (l_returnflag = 'R') AS failed, round(100.0 * count(*) FILTER (l_linestatus = 'F' OR l_returnflag = 'R') / count(*), 1)::DOUBLE AS progress FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
)
def batch_progress(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linestatus") == "F", "complete").otherwise("ocr")
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return W.batch_progress(rows.select(F.col("o_orderkey").alias("batch_id"), status.alias("status")))


@query("index_split", "SELECT CASE WHEN (doc_id % 1000) / 1000 < 0.8 THEN 'train' WHEN (doc_id % 1000) / 1000 < 0.9 THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM documents GROUP BY 1")
def index_split(spark, sf_dir):
    return W.index_split(table(spark, sf_dir, "documents"), "doc_id").groupBy("split").agg(F.count("*").alias("n"))


# -- integrity ----------------------------------------------------------------------------------------------------------

_CHAIN = """
WITH RECURSIVE rows AS (SELECT user_id, event_id, event_type || ':' || event_id AS data, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
chain AS (SELECT user_id, event_id, n, sha256('genesis:' || data) AS chain_hash FROM rows WHERE n = 1
  UNION ALL SELECT r.user_id, r.event_id, r.n, sha256(c.chain_hash || ':' || r.data) FROM chain c JOIN rows r ON r.user_id = c.user_id AND r.n = c.n + 1)
"""


def _chain(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.concat_ws(":", "event_type", "event_id").alias("data"))
    return I.build_chain(rows, "user_id", ["ts", "event_id"], "data")


@query("audit_chain", _CHAIN + "SELECT user_id, event_id, chain_hash FROM chain")
def audit_chain(spark, sf_dir):
    return _chain(spark, sf_dir).select("user_id", "event_id", "chain_hash")


@query("audit_chain_verify", "SELECT user_id, count(*) AS n, true AS valid FROM events GROUP BY 1")
def audit_chain_verify(spark, sf_dir):
    return I.verify_chain(_chain(spark, sf_dir), "user_id", ["ts", "event_id"], "data")


# -- evaluation ---------------------------------------------------------------------------------------------------------

# Printable ASCII only, as DuckDB's edit distance counts bytes.
_PAIRS = "(SELECT a.item_id, regexp_replace(a.text, '[^ -~]', '', 'g') AS truth, regexp_replace(b.text, '[^ -~]', '', 'g') AS prediction FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)"


def _pairs(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumn("text", F.regexp_replace("text", "[^ -~]", ""))
    return b.withColumnRenamed("text", "truth").join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("prediction")), "item_id")


@query("character_errors", f"SELECT item_id, levenshtein(truth, prediction) / length(truth) AS cer FROM {_PAIRS}")
def character_errors(spark, sf_dir):
    return _pairs(spark, sf_dir).select("item_id", X.cer(F.col("truth"), F.col("prediction")).alias("cer"))


@query("word_errors")
def word_errors(spark, sf_dir):
    return _pairs(spark, sf_dir).select("item_id", X.wer(F.col("truth"), F.col("prediction")).alias("wer"), X.similarity("truth", "prediction").alias("ratio"), X.longest_common("truth", "prediction").alias("common"))


@query(
    "token_recall",
    f"SELECT item_id, len(e)::BIGINT AS expected, len(f)::BIGINT AS found, CASE WHEN len(e) = 0 THEN 1.0 ELSE len(f) / len(e) END::DOUBLE AS recall FROM (SELECT item_id, e, list_filter(e, lambda x: contains(lower(prediction), lower(x))) AS f FROM (SELECT *, regexp_extract_all(truth, '[A-Za-z]{{6,}}') AS e FROM {_PAIRS}))",
)
def token_recall(spark, sf_dir):
    found = X.token_recall(F.regexp_extract_all("truth", F.lit("[A-Za-z]{6,}"), F.lit(0)), F.col("prediction")).alias("r")
    rows = _pairs(spark, sf_dir).select("item_id", found)
    return rows.select("item_id", F.col("r.expected").cast("long").alias("expected"), F.col("r.found").cast("long").alias("found"), F.col("r.recall").alias("recall"))


@query("backend_report", f"SELECT 'bench' || item_id % 3 AS backend, count(*) AS n, round(avg(levenshtein(truth, prediction) / length(truth)), 4) AS avg_cer FROM {_PAIRS} GROUP BY 1")
def backend_report(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select(F.concat(F.lit("bench"), (F.col("item_id") % 3).cast("string")).alias("backend"), "truth", "prediction")
    return E.backend_report(rows).select("backend", "n", "avg_cer")


# -- geometry -----------------------------------------------------------------------------------------------------------

_BOXES = "(SELECT doc_id, quality + toxic AS kind, (doc_id * 37 % 500)::DOUBLE AS x0, (doc_id * 53 % 700)::DOUBLE AS y0, (doc_id * 37 % 500 + 40 + doc_id % 60)::DOUBLE AS x1, (doc_id * 53 % 700 + 20)::DOUBLE AS y1, doc_id // 40 AS page FROM labels)"


def _boxes(spark, sf_dir):
    d = F.col("doc_id")
    x, y = d * 37 % 500, d * 53 % 700
    box = F.struct(x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 40 + d % 60).cast("double").alias("x1"), (y + 20).cast("double").alias("y1"))
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).cast("string").alias("kind"), F.floor(d / 40).cast("long").alias("page"), box.alias("box"))


@query(
    "box_overlaps",
    f"SELECT a.doc_id AS a, b.doc_id AS b, i / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - i) AS iou FROM (SELECT a, b, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i FROM {_BOXES} a JOIN {_BOXES} b ON a.page = b.page AND a.doc_id < b.doc_id) WHERE i > 0",
)
def box_overlaps(spark, sf_dir):
    a, b = _boxes(spark, sf_dir), _boxes(spark, sf_dir)
    rows = a.select("page", F.col("doc_id").alias("a"), F.col("box").alias("p")).join(b.select("page", F.col("doc_id").alias("b"), F.col("box").alias("q")), "page").where("a < b")
    return rows.where(X.common_area(F.col("p"), F.col("q")) > 0).select("a", "b", X.iou(F.col("p"), F.col("q")).alias("iou"))


@query("box_dedupe")
def box_dedupe(spark, sf_dir):
    rows = _boxes(spark, sf_dir).withColumn("confidence", (F.pmod(F.xxhash64("doc_id"), F.lit(100)) / 100)).withColumn("method", F.lit("regex"))
    return G.dedupe_boxes(rows, "page", "doc_id").select("page", "doc_id", "kind")


@query("yolo_labels", f"SELECT doc_id, printf('%d %.6f %.6f %.6f %.6f', kind, (x0 + x1) / 2 / 600, (y0 + y1) / 2 / 800, (x1 - x0) / 600, (y1 - y0) / 800) AS label FROM {_BOXES}")
def yolo_labels(spark, sf_dir):
    return _boxes(spark, sf_dir).select("doc_id", X.yolo_label(F.col("kind").cast("int"), F.col("box"), F.lit(600.0), F.lit(800.0)).alias("label"))


@query("word_lines")
def word_lines(spark, sf_dir):
    """Words laid out at fixed pitch, clustered back into lines."""
    words = G.layout(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page"), "text"))
    return G.cluster_lines(words, "page").select("page", "line", "text", "x0", "y0", "x1", "y1")


# -- conversations, pages, joins ------------------------------------------------------------------------------------------


@query("conversation_text", "SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def conversation_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    return rows.select("conv_id", "turns", F.array_join(F.transform("all", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n\n").alias("text"))


@query("unlabelled_documents", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("page_warnings", "SELECT regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host, count(*) AS n, avg(length(html)) AS mean_size FROM pages GROUP BY 1")
def page_warnings(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1).alias("host")).agg(F.count("*").alias("n"), F.avg(F.length("html")).alias("mean_size"))


@query("name_search", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%00001%'")
def name_search(spark, sf_dir):
    return W.search_name(table(spark, sf_dir, "customer"), "c_name", "00001").select("c_custkey", "c_name")


# -- texts, review, geometry --------------------------------------------------------------------------------------------


@query("highlights", r"SELECT doc_id, len(regexp_extract_all(text, '(?i)the'))::BIGINT AS n FROM documents")
def highlights(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.highlights(F.col("text"), "the")).cast("long").alias("n"))


@query("chunked_text")
def chunked_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.chunks(F.col("text"))).alias("chunk", "text"))
    return rows.select("conv_id", "turn", "chunk", "text")


@query("selected_text", "SELECT doc_id, trim(substr(text, 6, 20), ' ' || chr(10) || chr(9)) AS value FROM documents")
def selected_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.selection(F.col("text"), F.lit(25), F.lit(5))["value"].alias("value"))


@query("event_props", "SELECT event_id, coalesce((props::JSON ->> 'k')::BIGINT, -1) AS k FROM events")
def event_props(spark, sf_dir):
    answer = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", T.repaired_json(answer, "k long", {"k": F.lit(-1).cast("long")})["k"].alias("k"))


_ROUTED = "(SELECT doc_id, category, (CASE WHEN length(text) > 4000 THEN 2 ELSE 1 END) AS pages, quality FROM " + _ANALYSED + " LEFT JOIN labels USING (doc_id))"


@query(
    "review_reasons",
    f"SELECT doc_id, array_to_string(list_filter([CASE WHEN pages > 1 THEN 'Multi-page document' END, CASE WHEN quality = 0 THEN 'Low OCR confidence' END, CASE WHEN {_REVIEWED} THEN 'Category requires review' END], lambda x: x IS NOT NULL), '; ') AS reason, CASE WHEN pages > 1 OR coalesce(quality = 0, false) OR {_REVIEWED} THEN 'needs_review' ELSE 'complete' END AS status FROM {_ROUTED}",
)
def review_reasons(spark, sf_dir):
    rows = _analysed(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = rows.select(
        "doc_id", "category", C.profiles(F.col("category")).alias("profiles"), F.when(F.length("text") > 4000, 2).otherwise(1).alias("pages"), F.lit(None).cast("double").alias("least_box_confidence"),
        F.when(F.col("quality") == 0, 0.5).otherwise(0.9).alias("ocr_confidence"), F.lit(None).cast("double").alias("transcription_confidence"), F.lit(True).alias("vision_complete"), F.lit(0).alias("vision_warnings"),
        F.lit("").alias("selected_category"), F.lit(None).cast("string").alias("error"),
    )
    return R.route(rows).select("doc_id", "reason", "status")


@query("tab_counts", f"SELECT count(*) AS \"all\", count(*) FILTER ({_REVIEWED}) AS needs_review, count(*) FILTER (NOT {_REVIEWED}) AS processed, 0::BIGINT AS approved, 0::BIGINT AS failed FROM {_ANALYSED}")
def tab_counts(spark, sf_dir):
    rows = _analysed(spark, sf_dir)
    status = C.final_status(C.requires_review(F.col("category"), C.profiles(F.col("category"))), F.lit(None))
    return R.tab_counts(rows.select(status.alias("status"), F.lit(False).alias("flag_needs_review")))


@query(
    "applied_reviews",
    f"SELECT id, new_status, coalesce(lag(new_status) OVER (PARTITION BY document_id ORDER BY reviewed_at, id), 'pending') AS previous_status FROM (SELECT *, CASE action_type WHEN 'approve' THEN 'approved' WHEN 'modify' THEN 'modified' WHEN 'remove' THEN 'rejected' ELSE 'pending' END AS new_status FROM {_REVIEWS})",
)
def applied_reviews(spark, sf_dir):
    rows = _reviews(spark, sf_dir).withColumnRenamed("document_id", "redaction_id")
    redactions = rows.select(F.col("redaction_id").alias("id")).distinct().withColumn("status", F.lit("pending"))
    return R.applied(redactions, rows).select("id", "new_status", "previous_status")


@query("page_regions")
def page_regions(spark, sf_dir):
    words = G.layout(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page"), "text"))
    return G.regions(words, "page")


@query("value_boxes")
def value_boxes(spark, sf_dir):
    """The third word of each item found again among the page's words, as a box."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page"), "text")
    values = items.select("page", F.col("page").alias("value_id"), F.element_at(F.split("text", r"\s+"), 3).alias("value"))
    return G.label_windows(G.layout(items), values, "page").select("page", "value_id", "first", "last", "score")


@query("value_lines")
def value_lines(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page"), "text")
    values = items.select("page", F.col("page").alias("value_id"), F.element_at(F.split("text", r"\s+"), 3).alias("value"))
    return G.lines_for_values(values, G.cluster_lines(G.layout(items), "page"), "page").select("page", "value_id", "line", "score", "needs_review")


@query("duplicate_documents", "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1").select("doc_id", "n")
