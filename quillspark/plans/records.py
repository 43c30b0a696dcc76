"""Queries over records made of orders, line items, events and labels: lists, review, workflow, evaluation, boxes, files."""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.functions import scalars as X
from quillspark.operators import classify as C
from quillspark.operators import detect as D
from quillspark.operators import evaluate as E
from quillspark.operators import geometry as G
from quillspark.operators import integrity as I
from quillspark.operators import listing as L
from quillspark.operators import review as R
from quillspark.operators import text as T
from quillspark.operators import workflow as W
from quillspark.plans.registry import dealt, query, table
from quillspark.sources import io

# Documents, pages, redactions and readings; each as SQL that both engines read alike.
DOCUMENTS = """SELECT o_orderkey AS id, o_custkey % 5 AS council_id, 'File ' || (o_orderkey % 7) || '.pdf' AS name,
 CASE o_orderkey % 6 WHEN 0 THEN 'complete' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'in_review' WHEN 3 THEN 'review_approved' WHEN 4 THEN 'failed' ELSE 'ocr' END AS status,
 o_orderkey % 4 = 0 AS flag_needs_review, o_orderdate AS created_at, (o_orderkey % 21) / 20.0 AS urgency_score,
 CASE o_orderkey % 4 WHEN 0 THEN 'parking' WHEN 1 THEN 'waste' WHEN 2 THEN 'complaint' END AS category FROM orders"""
REDACTIONS = """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS document_id, l_linenumber AS page_number,
 CASE l_partkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' ELSE 'modified' END AS status,
 CASE l_suppkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'regex' ELSE 'llm' END AS method, l_discount * 10 AS confidence, 'v' || l_partkey AS original_value FROM lineitem"""
PAGES = "SELECT l_orderkey AS document_id, l_linenumber AS page_number, l_tax * 10 AS ocr_confidence, CASE WHEN l_partkey % 3 = 0 THEN 'complete' ELSE 'pending' END AS vision_status, l_suppkey % 2 AS vision_warnings, l_linenumber % 3 AS boxes, 'page ' || l_linenumber AS text, 'engine' || (l_partkey % 2) AS engine, l_partkey % 2 AS open FROM lineitem"


def _made(spark, sf_dir, sql: str):
    """The rows of such an SQL text, with its table read from the folder."""
    name = sql.rsplit("FROM ", 1)[1].strip()
    return table(spark, sf_dir, name).selectExpr(*[c.strip() for c in _columns(sql)])


def _columns(sql: str) -> list[str]:
    """The select list, cut at the commas outside parentheses and quotes."""
    text, out, depth, quoted, last = sql.rsplit("FROM ", 1)[0].strip()[len("SELECT") :], [], 0, False, 0
    for i, c in enumerate(text):
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]


def _documents(spark, sf_dir):
    return _made(spark, sf_dir, DOCUMENTS)


def _redactions(spark, sf_dir):
    return _made(spark, sf_dir, REDACTIONS)


def _pages(spark, sf_dir):
    return _made(spark, sf_dir, PAGES)


_D, _R, _P = f"({DOCUMENTS})", f"({REDACTIONS})", f"({PAGES})"

# -- lists ----------------------------------------------------------------------------------------------------------


@query("list_tenant", f"SELECT id FROM {_D} WHERE council_id = 3")
def list_tenant(spark, sf_dir):
    return W.tenant(_documents(spark, sf_dir), 3).select("id")


@query("list_backfilled", f"SELECT council_id, count(*) AS n FROM (SELECT CASE WHEN id % 9 = 0 THEN 77 ELSE council_id END AS council_id FROM {_D}) GROUP BY 1")
def list_backfilled(spark, sf_dir):
    rows = _documents(spark, sf_dir).withColumn("council_id", F.when(F.col("id") % 9 != 0, F.col("council_id")))
    return W.backfilled(rows, 77).groupBy("council_id").agg(F.count("*").alias("n"))


@query("list_documents", f"SELECT id, name FROM {_D} ORDER BY created_at DESC, id DESC LIMIT 40 OFFSET 20")
def list_documents(spark, sf_dir):
    return W.document_list(_documents(spark, sf_dir), 20, 40).select("id", "name")


@query("list_batches", f"SELECT id FROM {_D} ORDER BY created_at DESC, id DESC LIMIT 50")
def list_batches(spark, sf_dir):
    return W.batch_list(_documents(spark, sf_dir)).select("id")


@query("list_with_total", f"SELECT id, (SELECT count(*) FROM {_D} WHERE status = 'failed') AS total FROM {_D} WHERE status = 'failed' ORDER BY id LIMIT 10 OFFSET 5")
def list_with_total(spark, sf_dir):
    rows = _documents(spark, sf_dir).where("status = 'failed'")
    return W.paged_with_total(rows, [F.col("id")], 5, 10).select("id", "total")


for _tab, _statuses in L.TABS.items():
    _flag = " OR flag_needs_review" if _tab == "needs_review" else ""
    query(f"list_tab_{_tab}", f"SELECT id FROM {_D} WHERE status IN ({', '.join(map(repr, _statuses))}){_flag}")(lambda spark, sf_dir, tab=_tab: _documents(spark, sf_dir).where(L.in_tab(tab)).select("id"))


@query("list_search", f"SELECT id FROM {_D} WHERE contains(lower(name), 'file 3') OR contains(id::VARCHAR, 'file 3')")
def list_search(spark, sf_dir):
    return L.search(_documents(spark, sf_dir), "FILE 3", ["name", "id"]).select("id")


@query("list_priority", f"SELECT count(*) FILTER (urgency_score >= 0.8) AS urgent, count(*) FILTER (urgency_score >= 0.5) AS high, count(*) FILTER (urgency_score < 0.5) AS normal FROM {_D}")
def list_priority(spark, sf_dir):
    rows = _documents(spark, sf_dir).withColumn("urgency_score", F.col("urgency_score").cast("double"))
    return rows.agg(*(F.count_if(C.priority(F.col("urgency_score"), p)).alias(p) for p in ("urgent", "high", "normal")))


_CLOSED = "status IN ('approved', 'rejected') OR method = 'manual' OR confidence >= 0.6"


@query("list_attention", f"SELECT id FROM {_R} WHERE NOT ({_CLOSED})")
def list_attention(spark, sf_dir):
    return _redactions(spark, sf_dir).where(L.needs_attention()).select("id")


@query("list_attention_first", f"SELECT id FROM {_R} ORDER BY CASE WHEN {_CLOSED} THEN 1 ELSE 0 END, id LIMIT 30")
def list_attention_first(spark, sf_dir):
    return L.attention_first(_redactions(spark, sf_dir)).limit(30).select("id")


@query("list_next_page", f"SELECT document_id, coalesce(min(page_number) FILTER (page_number > 2), min(page_number)) AS page_number FROM {_P} WHERE open > 0 GROUP BY 1")
def list_next_page(spark, sf_dir):
    return L.next_page(_pages(spark, sf_dir), 2)


@query("list_recent", "SELECT user_id, max(ts)::VARCHAR AS ts FROM events GROUP BY 1 ORDER BY max(ts) DESC, user_id LIMIT 25")
def list_recent(spark, sf_dir):
    rows = L.recent(table(spark, sf_dir, "events"), "user_id", "ts")
    return rows.select("user_id", F.col("ts").cast("string").alias("ts"))


@query(
    "list_ages",
    "SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN round(m / 60)::BIGINT || 'h ago' ELSE strftime(ts, '%Y-%m-%d') END AS age FROM (SELECT *, round((floor(epoch(TIMESTAMP '2024-01-31')) - floor(epoch(ts))) / 60)::BIGINT AS m FROM events)",
)
def list_ages(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", L.relative_time(F.col("ts"), F.lit("2024-01-31").cast("timestamp")).alias("age"))


@query("list_iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((microsecond(ts) % 1000000)::VARCHAR, 6, '0') END AS at FROM events")
def list_iso_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", W.iso(F.col("ts")).alias("at"))


@query("list_counts", f"SELECT d.id, count(r.document_id) AS redaction_count FROM {_D} d LEFT JOIN (SELECT * FROM {_R} WHERE status <> 'rejected') r ON r.document_id = d.id GROUP BY 1")
def list_counts(spark, sf_dir):
    redactions = _redactions(spark, sf_dir).drop("id")
    return W.counted(_documents(spark, sf_dir), redactions, active_only=True).select("id", "redaction_count")


@query("list_dashboard_compat", f"SELECT count(*) AS total, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status IN ('needs_review', 'in_review')) AS review, count(*) FILTER (status = 'failed') AS errors, count(*) FILTER (id % 3 <> 0) AS safeguarding_alerts, round(100.0 * count(*) FILTER (status = 'complete') / count(*) FILTER (status IN ('complete', 'needs_review', 'in_review')), 1)::DOUBLE AS auto_approval_rate, round(count(*) * 0.33, 1)::DOUBLE AS hours_saved FROM {_D}")
def list_dashboard_compat(spark, sf_dir):
    flags = F.when(F.col("id") % 3 != 0, F.array().cast("array<string>"))
    return W.dashboard(_documents(spark, sf_dir).withColumn("risk_flags", flags), mode="compat")


@query("list_status_percent", f"SELECT id, CASE status {' '.join(f'WHEN {k!r} THEN {v}' for k, v in V.STATUS_PERCENT.items())} ELSE 0 END AS percent FROM {_D}")
def list_status_percent(spark, sf_dir):
    return _documents(spark, sf_dir).select("id", C.status_percent(F.col("status")).alias("percent"))


@query("list_bands", f"SELECT id, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS band FROM {_R}")
def list_bands(spark, sf_dir):
    return _redactions(spark, sf_dir).select("id", C.confidence_band(F.col("confidence")).alias("band"))


@query("list_final_status", f"SELECT id, CASE WHEN id % 5 = 0 THEN 'failed' WHEN flag_needs_review THEN 'needs_review' ELSE 'complete' END AS final FROM {_D}")
def list_final_status(spark, sf_dir):
    return _documents(spark, sf_dir).select("id", C.final_status(F.col("flag_needs_review"), F.when(F.col("id") % 5 == 0, "broken")).alias("final"))


@query("list_engine_states", f"SELECT DISTINCT document_id, page_number, CASE engine WHEN 'engine0' THEN 'main' ELSE 'fallback' END AS state FROM {_P}")
def list_engine_states(spark, sf_dir):
    state = L.engine_state(F.col("engine"), F.lit("ocr"), "engine0", ["engine1"], ["offline"])
    return _pages(spark, sf_dir).select("document_id", "page_number", state.alias("state")).distinct()


@query(
    "list_detail",
    f"SELECT id, name, p.n AS n_pages, p.pages, r.redactions, a.n AS n_audit FROM {_D} d LEFT JOIN (SELECT document_id, count(*) AS n, string_agg(page_number::VARCHAR, ',' ORDER BY page_number) AS pages FROM {_P} GROUP BY 1) p ON p.document_id = id LEFT JOIN (SELECT document_id, string_agg(original_value, ',' ORDER BY id, status, method, confidence, original_value) AS redactions FROM {_R} GROUP BY 1) r ON r.document_id = id LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) a ON a.user_id = id",
)
def list_detail(spark, sf_dir):
    audit = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("ts").alias("timestamp"), "event_type")
    rows = L.document_detail(_documents(spark, sf_dir), _pages(spark, sf_dir), _redactions(spark, sf_dir), audit)
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long")
    joined = lambda c, f: F.array_join(F.transform(c, lambda x: x[f].cast("string")), ",")
    return rows.select("id", "name", size("pages").alias("n_pages"), joined("pages", "page_number").alias("pages"), joined("redactions", "original_value").alias("redactions"), size("audit").alias("n_audit"))


@query("list_page_detail", f"SELECT p.document_id, p.page_number, count(r.id) AS redaction_count, 'page ' || p.page_number AS reading FROM (SELECT DISTINCT document_id, page_number FROM {_P}) p LEFT JOIN (SELECT * FROM {_R} WHERE status <> 'rejected') r ON r.document_id = p.document_id AND r.page_number = p.page_number GROUP BY 1, 2")
def list_page_detail(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    readings = pages.select("document_id", "page_number", F.col("boxes").alias("id"), "text")
    rows = L.page_detail(pages.select("document_id", "page_number").distinct(), _redactions(spark, sf_dir), readings)
    return rows.select("document_id", "page_number", "redaction_count", F.col("text").alias("reading"))


@query("list_best_engine", "SELECT event_id, CASE WHEN event_id % 10 >= 8 THEN 'a' WHEN event_id % 7 >= 5 OR event_id % 7 / 10.0 > event_id % 10 / 10.0 THEN 'b' ELSE 'a' END AS engine FROM events")
def list_best_engine(spark, sf_dir):
    e = F.col("event_id")
    both = F.array(F.struct(F.lit("a").alias("engine"), (e % 10 / 10).alias("confidence")), F.struct(F.lit("b").alias("engine"), F.when(e % 7 >= 5, 0.95).otherwise(e % 7 / 10).alias("confidence")))
    readings = table(spark, sf_dir, "events").select("event_id", F.explode(both).alias("x")).select("event_id", "x.*")
    return L.best_engine(readings, ["event_id"], [("a", 0.8), ("b", 0.7)]).select("event_id", "engine")


@query("list_run_status", "SELECT c_custkey AS stage, CASE WHEN c_custkey % 5 = 0 THEN 'failed' WHEN c_custkey % 3 = 0 THEN 'complete' WHEN c_custkey % 2 = 0 THEN 'running' ELSE 'pending' END AS status, round(1.5, 3)::DOUBLE AS elapsed_hours, round(3.75, 2)::DOUBLE AS cost FROM customer")
def list_run_status(spark, sf_dir):
    k = F.col("c_custkey")
    stages = table(spark, sf_dir, "customer").select(k.alias("stage"), (k % 3 == 0).alias("done"), (k % 5 == 0).alias("failed"), (k % 2 == 0).alias("current"))
    at = lambda t: F.lit(t).cast("timestamp")
    return L.run_status(stages, at("2024-01-01 00:00:00"), at("2024-01-01 01:30:00"), 2.5)


@query("list_shuffled", f"SELECT count(*) AS n, count(DISTINCT id) AS ids FROM {_D}")
def list_shuffled(spark, sf_dir):
    return L.shuffled(_documents(spark, sf_dir), "id", 7).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


# -- review and workflow --------------------------------------------------------------------------------------------


@query("review_confidence_summary", f"SELECT document_id, count(*) AS page_count, round(avg(ocr_confidence), 4)::DOUBLE AS average_confidence, count(*) FILTER (vision_status = 'complete') AS complete_pages, sum(vision_warnings)::BIGINT AS warnings, sum(boxes)::BIGINT AS boxes FROM {_P} GROUP BY 1")
def review_confidence_summary(spark, sf_dir):
    return R.confidence_summary(_pages(spark, sf_dir)).select("document_id", "summary.*")


@query("review_page_text", f"SELECT document_id, string_agg('--- Page ' || page_number || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page_number) AS text, CASE WHEN min(engine) = max(engine) THEN min(engine) ELSE 'engine0,engine1' END AS engines FROM {_P} GROUP BY 1")
def review_page_text(spark, sf_dir):
    return R.page_text(_pages(spark, sf_dir))


@query("review_undone", f"SELECT document_id, 'undo:' || id AS reason, CASE id % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'pending' WHEN 2 THEN 'pending' ELSE 'was' END AS new_status FROM {_R} WHERE (document_id % 6) NOT IN (3)")
def review_undone(spark, sf_dir):
    action = F.element_at(F.array(*map(F.lit, ("create", "remove", "approve", "modify"))), (F.col("id") % 4 + 1).cast("int"))
    candidates = _redactions(spark, sf_dir).select("document_id", "id", action.alias("action_type"), F.lit("was").alias("previous_status"))
    return R.undone(candidates, _documents(spark, sf_dir)).select("document_id", "reason", "new_status")


@query("review_export_checks", f"SELECT id, concat_ws(',', CASE WHEN status <> 'review_approved' THEN 'approved' END, CASE WHEN flag_needs_review THEN 'unflagged' END, CASE WHEN category IS NULL THEN 'categorised' END) AS failed, status = 'review_approved' AND NOT flag_needs_review AND category IS NOT NULL AS allowed FROM {_D}")
def review_export_checks(spark, sf_dir):
    checks = {"approved": F.col("status") == "review_approved", "unflagged": ~F.col("flag_needs_review"), "categorised": F.col("category") != ""}
    return R.export_checks(_documents(spark, sf_dir), checks).select("id", F.array_join("failed_checks", ",").alias("failed"), F.col("export_allowed").alias("allowed"))


@query("review_exported", f"SELECT id, CASE WHEN status = 'review_approved' AND id % 2 = 1 THEN 'exported' ELSE status END AS status FROM {_D}")
def review_exported(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return R.exported(docs, docs.select(F.col("id").alias("document_id"), (F.col("id") % 2 == 1).alias("export_allowed"))).select("id", "status")


@query("review_actions", f"SELECT a.action, status, flag_needs_review, count(*) AS n FROM (SELECT unnest(['assign', 'flag', 'approve_release']) AS action, unnest(['in_review', 'needs_review', 'review_approved']) AS status) a, LATERAL (SELECT CASE a.action WHEN 'flag' THEN true WHEN 'approve_release' THEN false ELSE flag_needs_review END AS flag_needs_review FROM {_D}) GROUP BY 1, 2, 3")
def review_actions(spark, sf_dir):
    rows = [R.document_action(_documents(spark, sf_dir), a, 5).select(F.lit(a).alias("action"), "status", "flag_needs_review") for a in R.DOCUMENT_ACTIONS]
    return rows[0].union(rows[1]).union(rows[2]).groupBy("action", "status", "flag_needs_review").agg(F.count("*").alias("n"))


@query("review_approve_all", f"SELECT id AS redaction_id, 'approved' AS new_status, 'Approve all' AS reason FROM {_R} WHERE status = 'pending'")
def review_approve_all(spark, sf_dir):
    return R.approve_all(_redactions(spark, sf_dir)).select("redaction_id", "new_status", "reason")


@query("review_hidden_values", f"SELECT id, CASE WHEN r = 'admin' THEN original_value END AS shown, r AS role FROM {_R}, (SELECT unnest(['admin', 'auditor']) AS r)")
def review_hidden_values(spark, sf_dir):
    rows = [R.redaction_rows(_redactions(spark, sf_dir), r).select("id", F.col("original_value").alias("shown"), F.lit(r).alias("role")) for r in ("admin", "auditor")]
    return rows[0].union(rows[1])


@query("review_low_confidence", f"SELECT document_id, min(confidence) < 0.6 AS low FROM {_R} GROUP BY 1")
def review_low_confidence(spark, sf_dir):
    rows = _redactions(spark, sf_dir).groupBy("document_id").agg(F.collect_list(F.struct("confidence")).alias("boxes"))
    return rows.select("document_id", R.low_confidence(F.col("boxes")).alias("low"))


@query("review_roles", "SELECT c_custkey, c_custkey % 3 <> 2 AS may, true AS may_alone FROM customer")
def review_roles(spark, sf_dir):
    role = F.element_at(F.array(*map(F.lit, ("admin", "reviewer", "guest"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", R.may(role, ["admin", "reviewer"]).alias("may"), R.may(role, ["admin"], multi_user=False).alias("may_alone"))


@query("review_burn_plan", f"SELECT document_id, page_number, count(*) AS n, sum(id)::DOUBLE AS left_sum FROM {_R} WHERE status <> 'rejected' GROUP BY 1, 2")
def review_burn_plan(spark, sf_dir):
    box = F.struct(F.col("id").cast("double").alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"))
    rows = R.burn_plan(_redactions(spark, sf_dir).withColumn("box", box))
    return rows.select("document_id", "page_number", "n", F.aggregate("boxes", F.lit(0.0), lambda a, b: a + b["x0"]).alias("left_sum"))


@query("workflow_retention", f"SELECT id FROM {_D} WHERE created_at < (DATE '2000-01-01' - to_days((365 * CASE category WHEN 'parking' THEN 2 WHEN 'waste' THEN 4 ELSE 7 END)::INT))")
def workflow_retention(spark, sf_dir):
    policies = spark.createDataFrame([("parking", 2), ("waste", 4)], "category string, retention_years int")
    return W.retention_due(_documents(spark, sf_dir), policies, F.lit("2000-01-01").cast("timestamp")).select("id")


@query("workflow_unique_names", f"SELECT id, CASE WHEN n > 1 THEN replace(name, '.pdf', '_' || n || '.pdf') ELSE name END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY council_id, name ORDER BY id) AS n FROM {_D})")
def workflow_unique_names(spark, sf_dir):
    return W.unique_names(_documents(spark, sf_dir), "council_id", "name", "id").select("id", "unique_name")


@query("workflow_first_pages", f"SELECT count(*) AS n, count(*) FILTER (text IS NULL) AS added FROM (SELECT document_id, page_number, text FROM {_P} WHERE page_number > 1 UNION ALL SELECT id, 1, NULL FROM {_D})")
def workflow_first_pages(spark, sf_dir):
    pages = _pages(spark, sf_dir).where("page_number > 1").select("document_id", "page_number", "text")
    return io.with_first_pages(pages, _documents(spark, sf_dir)).agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("added"))


@query("workflow_migrated", f"SELECT count(*) AS n, sum(pages)::BIGINT AS pages FROM (SELECT 1 AS pages FROM {_D})")
def workflow_migrated(spark, sf_dir):
    rows = io.migrated(_documents(spark, sf_dir), {"pages": ("int", F.lit(1)), "status": ("string", F.lit("x"))})
    return rows.agg(F.count("*").alias("n"), F.sum("pages").alias("pages"))


# -- integrity ------------------------------------------------------------------------------------------------------


@query("chain_broken", "SELECT user_id, count(*) AS n, count(*) FILTER (event_id % 997 = 0) = 0 AS valid FROM events GROUP BY 1")
def chain_broken(spark, sf_dir):
    """Chains in which some rows were altered after they were hashed."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.concat_ws(":", "event_type", "event_id").alias("data"))
    chained = I.build_chain(rows, "user_id", ["ts", "event_id"], "data", b"secret")
    altered = chained.withColumn("data", F.when(F.col("event_id") % 997 == 0, F.concat("data", F.lit("!"))).otherwise(F.col("data")))
    return I.verify_chain(altered, "user_id", ["ts", "event_id"], "data", b"secret")


@query("canonical_details", "SELECT event_id, '{\"action\": \"' || event_type || '\", \"id\": ' || event_id || ', \"none\": null, \"note\": \"caf\\u00e9 \\\"' || user_id || '\\\"\\n\"}' AS json FROM events")
def canonical_details(spark, sf_dir):
    fields = {"note": X.json_text(F.concat(F.lit('café "'), F.col("user_id").cast("string"), F.lit('"\n'))), "id": F.col("event_id"), "action": X.json_text(F.col("event_type")), "none": F.lit(None)}
    return table(spark, sf_dir, "events").select("event_id", X.canonical_json(fields).alias("json"))


@query("content_hashes", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.content_hash(F.encode("text", "utf-8")).alias("hash"))


@query("upserted", f"SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE status END AS status FROM {_D}")
def upserted(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("id", "status")
    return I.upsert(docs, docs.where("id % 3 = 0").withColumn("status", F.lit("new")), "id")


_PREFIX = "QS-" + base64.b32encode(hashlib.sha256(b"7").digest()).decode()[:6]


@query("export_ids", f"SELECT c_custkey, c_custkey % 2 = 0 AS known, CASE c_custkey % 5 WHEN 0 THEN 'invalid' WHEN 1 THEN 'foreign' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'found' ELSE 'not_in_library' END END AS result, {_PREFIX!r} AS head FROM customer")
def export_ids(spark, sf_dir):
    k = F.col("c_custkey")
    rows = dealt(table(spark, sf_dir, "customer").select("c_custkey")).withColumn("ours", X.export_id("QS", F.lit("7"), k, b"key")).withColumn("other", X.export_id("XX", F.lit("7"), k, b"key"))
    value = F.when(k % 5 == 0, F.concat(F.left("ours", F.lit(22)), F.lit("0"))).when(k % 5 == 1, F.col("other")).otherwise(F.col("ours"))
    ids = rows.select("c_custkey", (k % 2 == 0).alias("known"), value.alias("export_id"), F.left("ours", F.lit(9)).alias("head"))
    exports = rows.where(k % 2 == 0).select(F.col("ours").alias("export_id"))
    return I.decode_exports(ids, "export_id", exports, "QS", b"key").select("c_custkey", "known", "result", "head")


@query("provenance_rows", f"SELECT id AS document_id, council_id = 2 AS accessible FROM {_D}")
def provenance_rows(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    records = docs.select(F.col("id").alias("document_id"), F.lit("s").alias("signature"))
    return L.provenance(records, docs, 2).select("document_id", "accessible")


# -- names and files --------------------------------------------------------------------------------------------------


@query("names_type_slugs", "SELECT c_custkey, 'customer_' || substr(c_name, 10) AS slug, CASE WHEN c_custkey % 2 = 0 THEN 'manual' ELSE 'a_b' END AS other FROM customer")
def names_type_slugs(spark, sf_dir):
    other = F.when(F.col("c_custkey") % 2 == 0, " -- ").otherwise("A b!")
    return table(spark, sf_dir, "customer").select("c_custkey", X.type_slug(F.col("c_name")).alias("slug"), X.type_slug(other).alias("other"))


@query("names_safe_files", "SELECT c_custkey, 'Customer_' || substr(c_name, 10) || '.pdf' AS name FROM customer")
def names_safe_files(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.safe_filename(F.concat(F.lit("../"), F.col("c_name"), F.lit(".pdf. "))).alias("name"))


@query("names_compact", "SELECT doc_id, regexp_replace(lower(left(text, 200)), '[^a-z0-9]', '', 'g') AS compact FROM documents WHERE lang = 'en'")
def names_compact(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", X.compact(F.left("text", F.lit(200))).alias("compact"))


@query("names_loose", "SELECT item_id, trim(regexp_replace(translate(lower(text), ',.', '  '), '\\s+', ' ', 'g')) AS loose FROM benchmark")
def names_loose(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.loose(F.col("text")).alias("loose"))


_HEADS = {"pdf": "255044462D312E37", "png": "89504E470D0A1A0A", "jpg": "FFD8FFE000104A46", "docx": "504B030414000600", "bmp": "424D000000000000", "exe": "4D5A900003000000"}


@query("files_checked", "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'content does not match type' WHEN 3 THEN 'unsupported type' WHEN 4 THEN 'empty file' ELSE NULL END AS problem, CASE c_custkey % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'jpg' WHEN 2 THEN 'png' WHEN 5 THEN 'docx' END AS kind FROM customer")
def files_checked(spark, sf_dir):
    k = (F.col("c_custkey") % 6 + 1).cast("int")
    name = F.element_at(F.array(*map(F.lit, ("a.pdf", "a.JPEG", "a.pdf", "a.exe", "a.png", "a.docx"))), k)
    head = F.element_at(F.array(*map(F.lit, (_HEADS["pdf"], _HEADS["jpg"], _HEADS["png"], _HEADS["exe"], "", _HEADS["docx"]))), k)
    rows = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), F.unhex(head).alias("content"))
    return io.upload_problems(rows).select("c_custkey", "problem", "kind")


@query("files_splits", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM customer")
def files_splits(spark, sf_dir):
    split = F.element_at(F.array(*map(F.lit, ("dev", "test", "train", "unsupervised"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return io.renamed_splits(table(spark, sf_dir, "customer").select("c_custkey", split.alias("split")))


@query("files_local_csv", "SELECT 'p' || c_custkey AS image_path, c_name AS text, CASE c_custkey % 3 WHEN 0 THEN 'validation' ELSE 'train' END AS split FROM customer WHERE c_custkey % 5 <> 0")
def files_local_csv(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit(" p"), k.cast("string")).alias("file"), F.when(k % 5 != 0, F.col("c_name")).otherwise(" ").alias("label"), F.when(k % 3 == 0, "dev").alias("split"))
    return io.local_csv(rows, ["image", "file"], ["text", "label"])


@query("files_manifest_keys", "SELECT c_custkey, 'a/b' || c_custkey || '|' || CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE c_custkey END || '|' AS key FROM customer")
def files_manifest_keys(spark, sf_dir):
    k = F.col("c_custkey")
    key = L.manifest_key(F.concat(F.lit("a\\b"), k.cast("string")), F.when(k % 2 == 1, k), F.lit(None).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", key.alias("key"))


@query("files_predictions", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'late' || c_custkey END AS prediction FROM customer")
def files_predictions(spark, sf_dir):
    manifest = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("IMG/"), F.col("c_name")).alias("image_path"))
    both = F.array(F.struct(F.lit(1).alias("n"), F.lit("early").alias("p")), F.struct(F.lit(2).alias("n"), F.lit("late").alias("p")))
    rows = manifest.where("c_custkey % 3 <> 0").select("c_custkey", F.lower("image_path").alias("image_path"), F.explode(both).alias("x"))
    predictions = rows.select("image_path", F.concat("x.p", F.col("c_custkey").cast("string")).alias("prediction"), F.lit(0.5).alias("confidence"), F.col("x.n").alias("line"))
    return L.predictions_for(manifest, predictions, "line").select("c_custkey", "prediction")


@query("files_preferred", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'alpha' ELSE '' END AS backend FROM customer")
def files_preferred(spark, sf_dir):
    names = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("Zeta"), F.lit("MAIN"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("beta"), F.lit("Alpha"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "customer").select("c_custkey", L.preferred(names, ["main", "second"]).alias("backend"))


@query("files_split_by_document", "SELECT c_custkey, CASE WHEN c_custkey % 10 < 7 THEN 'train' WHEN c_custkey % 10 = 7 THEN 'validation' WHEN c_custkey % 10 = 8 THEN 'test' ELSE 'holdout' END AS split FROM customer")
def files_split_by_document(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", L.document_split(F.col("c_custkey") % 10, [*range(7)], [7], [8]).alias("split"))


def _keys(spark, sf_dir):
    item = lambda kind, v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
    items = F.array(item("name", F.col("c_name")), item("phone", F.concat(F.lit("+1 "), F.col("c_custkey").cast("string"))), item("name", F.lit("Nobody")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.concat("c_name", F.lit(" +1 "), F.col("c_custkey").cast("string")).alias("ground_truth_text"), items.alias("sensitive_items"), (F.col("c_custkey") % 4).alias("part"))


@query("files_checked_items", "SELECT c_custkey AS document_id, 2 AS items, 'value not in text: name' AS warnings FROM customer")
def files_checked_items(spark, sf_dir):
    return L.checked_items(_keys(spark, sf_dir)).select("document_id", F.size("sensitive_items").alias("items"), F.array_join("warnings", ";").alias("warnings"))


@query("files_item_counts", "SELECT c_custkey % 4 AS part, 2 * count(*) AS name, count(*) AS phone FROM customer GROUP BY 1")
def files_item_counts(spark, sf_dir):
    return L.item_counts(_keys(spark, sf_dir), "part")


# -- texts -----------------------------------------------------------------------------------------------------------


@query("text_found_selection", "SELECT item_id, strpos(text, v) - 1 AS start_at, v AS value FROM (SELECT item_id, text, string_split(text, ' ')[2] || ' ' || string_split(text, ' ')[3] AS v FROM benchmark)")
def text_found_selection(spark, sf_dir):
    words = F.split("text", " ")
    wanted = F.concat(F.lower(words[1]), F.lit("  \n"), words[2])
    rows = table(spark, sf_dir, "benchmark").select("item_id", T.found_selection(F.col("text"), wanted).alias("s"))
    return rows.select("item_id", F.col("s.start").cast("long").alias("start_at"), "s.value")


@query("text_field_labels", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Case no' WHEN 1 THEN 'Phone' END AS label FROM customer")
def text_field_labels(spark, sf_dir):
    line = F.when(F.col("c_custkey") % 3 == 0, "Case no : 7").when(F.col("c_custkey") % 3 == 1, "  Phone 12").otherwise("none here")
    return table(spark, sf_dir, "customer").select("c_custkey", T.field_label(line).alias("label"))


@query("text_field_spans", "SELECT c_custkey, 'person_name' AS type, strpos(lower(t), lower(c_name)) - 1 AS start_at, c_name AS value FROM (SELECT *, 'From ' || lower(c_name) || ' to all' AS t FROM customer)")
def text_field_spans(spark, sf_dir):
    field = lambda kind, v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
    text = F.concat(F.lit("From "), F.lower("c_name"), F.lit(" to all"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(T.field_spans(text, F.array(field(" Full_Name", F.col("c_name")), field("ref", F.lit("absent"))))).alias("s"))
    return rows.select("c_custkey", "s.type", F.col("s.start").cast("long").alias("start_at"), "s.value")


@query("text_reading_warnings", "SELECT c_custkey, unnest(['high', 'low', 'medium']) AS severity, unnest(['pin', 'pin', 'name']) AS type FROM customer")
def text_reading_warnings(spark, sf_dir):
    item = lambda kind, v, u: F.struct(F.lit(kind).alias("type"), v.alias("value"), F.lit(u).alias("uncertain"))
    items = F.array(item("pin", F.lit("qqq"), False), item("pin", F.col("c_name"), False), item("name", F.lit("Zed"), False), item("name", F.col("c_name"), False))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(T.reading_warnings(F.concat(F.lit("I am "), F.col("c_name")), items, ["pin"])).alias("w"))
    return rows.select("c_custkey", "w.severity", "w.type")


@query("text_chunks", "SELECT c_custkey, 1 AS chunks, 'One ' || c_custkey || '. Two? Three!' AS text FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 2, 'One ' || c_custkey || '. Two?|' || repeat('x', 390) FROM customer WHERE c_custkey % 2 = 1")
def text_chunks(spark, sf_dir):
    text = F.concat(F.lit("One "), F.col("c_custkey").cast("string"), F.lit(".  Two?\n"), F.when(F.col("c_custkey") % 2 == 0, " Three!").otherwise("x" * 390))
    return table(spark, sf_dir, "customer").select("c_custkey", T.chunks(text).alias("c")).select("c_custkey", F.size("c").alias("chunks"), F.array_join("c", "|").alias("text"))


@query("text_line_of", "SELECT item_id, k AS offset_at, (CASE WHEN k >= 8 THEN 2 WHEN k >= 7 THEN 1 ELSE 0 END)::INT AS line, (CASE WHEN k >= 8 THEN 1 WHEN k >= 7 THEN NULL ELSE 0 END)::INT AS ordinal FROM benchmark, (SELECT unnest([0, 6, 7, 8, 9]) AS k)")
def text_line_of(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(*map(F.lit, (0, 6, 7, 8, 9)))).alias("offset_at"))
    at = G.line_of(F.concat(F.lit("first \n\n"), F.lit("third")), F.col("offset_at"))
    return rows.select("item_id", "offset_at", at["index"].alias("line"), at["ordinal"].alias("ordinal"))


@query("text_model_first", f"SELECT id, CASE WHEN id % 3 = 0 THEN 'waste' WHEN category IS NULL THEN 'unknown' ELSE category END AS category, (CASE WHEN id % 2 = 0 THEN 0.9 ELSE 0.1 END)::DOUBLE AS urgency FROM {_D}")
def text_model_first(spark, sf_dir):
    model = F.struct(F.when(F.col("id") % 3 == 0, "waste").otherwise("").alias("category"), F.when(F.col("id") % 2 == 0, 0.9).alias("urgency"))
    found = C.with_model(F.coalesce("category", F.lit("unknown")), F.lit(0.1), model)
    return _documents(spark, sf_dir).select("id", found.alias("f")).select("id", "f.*")


@query("text_translated", "SELECT doc_id, CASE WHEN lang IN ('fr', 'de') THEN 'EN:' || left(text, 20) ELSE left(text, 20) END AS text FROM documents")
def text_translated(spark, sf_dir):
    text = F.left("text", F.lit(20))
    return table(spark, sf_dir, "documents").select("doc_id", C.translated(text, F.col("lang"), lambda t, _: F.concat(F.lit("EN:"), t), ["fr", "de"]).alias("text"))


@query("text_language", "SELECT doc_id, CASE WHEN length(trim(text)) < 20 THEN 'en' ELSE coalesce(lang, 'en') END AS lang FROM documents")
def text_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.language(F.col("text"), F.col("lang")).alias("lang"))


# -- evaluation -----------------------------------------------------------------------------------------------------


def _cases(spark, sf_dir):
    k, name = F.col("c_custkey"), F.col("c_name")
    redacted = F.when(k % 3 == 0, F.concat(F.lit("Name: "), name)).otherwise("Name: [REDACTED-person_name] Tel: safe")
    rows = table(spark, sf_dir, "customer").select(k.alias("case_id"), redacted.alias("redacted"), F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("nin"))).alias("types"), (k % 5 == 0).alias("needs_review"), F.array(F.upper(name)).alias("expected_redacted_values"), F.array(F.lit("name:"), F.lit("Tel")).alias("expected_unredacted_labels"), F.array(F.lit("SAFE")).alias("expected_not_redacted_values"), F.array(F.lit("nhs_number")).alias("expected_redaction_types"), F.lit(False).alias("expected_needs_review"))
    return E.case_results(rows)


_PASSED = "c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 AND c_custkey % 5 <> 0"


@query("evaluation_cases", f"SELECT c_custkey AS case_id, {_PASSED} AS passed, (c_custkey % 3 = 0)::INT AS leaked, (c_custkey % 3 = 0)::INT AS lost_labels, (c_custkey % 3 = 0)::INT AS lost_values, (c_custkey % 4 = 0)::INT AS missing FROM customer")
def evaluation_cases(spark, sf_dir):
    size = lambda c, name: F.size(c).alias(name)
    return _cases(spark, sf_dir).select("case_id", "passed", size("leaked", "leaked"), size("lost_labels", "lost_labels"), size("lost_values", "lost_values"), size("missing_types", "missing"))


@query("evaluation_case_summary", f"SELECT count(*) AS cases, avg(({_PASSED})::INT)::DOUBLE AS accuracy, avg((c_custkey % 3 <> 0)::INT)::DOUBLE AS value_recall, 1 - avg((c_custkey % 3 = 0)::INT) / 2 AS label_score, avg((c_custkey % 3 <> 0)::INT)::DOUBLE AS safe_score, avg((c_custkey % 5 <> 0)::INT)::DOUBLE AS review_score, avg(({_PASSED})::INT) >= 0.85 AS accepted FROM customer")
def evaluation_case_summary(spark, sf_dir):
    return E.case_summary(_cases(spark, sf_dir))


@query("evaluation_recall_by_type", "SELECT 'nhs_number' AS type, count(*) AS expected, count(*) FILTER (c_custkey % 4 <> 0) AS found, count(*) FILTER (c_custkey % 4 <> 0) / count(*) AS recall FROM customer")
def evaluation_recall_by_type(spark, sf_dir):
    return E.recall_by_type(_cases(spark, sf_dir))


def _judged(spark, sf_dir):
    k = F.col("c_custkey")
    pii = lambda *v: F.array(*map(F.lit, v))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), (k % 2 == 0).alias("category_correct_guess"), pii("a", "b").alias("pii_should_be_redacted"), F.when(k % 4 == 0, pii("a", "b")).otherwise(pii("a", "x")).alias("pii_actually_redacted"), F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(pii("x")).alias("false_positives"), (k % 10 / 10).alias("redaction_completeness"), F.lit(1.0).alias("redaction_accuracy"))
    return E.document_score(rows)


_SCORES = "(SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 1.0 ELSE 0.5 END AS part, CASE WHEN c_custkey % 2 = 0 THEN 1.0 ELSE 0.0 END AS guess, (c_custkey % 10) / 10 AS done FROM customer)"


@query("evaluation_scores", f"SELECT id, round(0.6 * part + 0.2 * guess + 0.1 * done + 0.1, 4)::DOUBLE AS score FROM {_SCORES}")
def evaluation_scores(spark, sf_dir):
    return _judged(spark, sf_dir).select("id", "score")


@query("evaluation_score_summary", f"SELECT count(*) AS documents_evaluated, round(avg(round(0.6 * part + 0.2 * guess + 0.1 * done + 0.1, 4)), 3)::DOUBLE AS avg_overall_score, round(avg(done), 3)::DOUBLE AS avg_completeness, 1.0::DOUBLE AS avg_accuracy, round(avg(part), 3)::DOUBLE AS avg_recall, round(avg(part), 3)::DOUBLE AS avg_precision, round(avg(guess), 3)::DOUBLE AS category_accuracy, count(*) FILTER (part < 1) AS total_missed, count(*) FILTER (part < 1) AS total_false_positives FROM {_SCORES}")
def evaluation_score_summary(spark, sf_dir):
    return E.score_summary(_judged(spark, sf_dir))


@query("evaluation_product_summary", "SELECT count(*) AS case_count, avg(c_custkey % 10 / 10)::DOUBLE AS average_similarity, avg(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0.5 END)::DOUBLE AS average_required_field_recall, count(*) FILTER (c_custkey % 3 = 0) AS missed_redaction_count, 0::BIGINT AS false_positive_safe_redaction_count, 2 * count(*) AS missing_type_count, avg((c_custkey % 7 <> 0)::INT)::DOUBLE AS review_score, false AS passed_demo_threshold FROM customer")
def evaluation_product_summary(spark, sf_dir):
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "customer").select((k % 10 / 10).alias("similarity"), F.when(k % 2 == 0, 1.0).otherwise(0.5).alias("required_field_recall"), F.when(k % 3 == 0, F.array(F.lit("x"))).otherwise(none).alias("missed_redactions"), none.alias("redacted_safe_values"), F.array(F.lit("a"), F.lit("b")).alias("missing_types"), (k % 7 != 0).alias("review_ok"))
    return E.product_summary(rows)


@query("evaluation_label_counters", "SELECT count(*) AS rows, count(*) FILTER (c_custkey % 4 = 0) AS labelled, count(*) FILTER (c_custkey % 4 = 1) AS no_items, count(*) FILTER (c_custkey % 4 = 2) AS no_match, count(*) FILTER (c_custkey % 4 = 3) AS failed, sum(c_custkey % 5)::BIGINT AS boxes FROM customer")
def evaluation_label_counters(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("labelled", "no_items", "no_match", "failed"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return E.label_counters(table(spark, sf_dir, "customer").select(status.alias("status"), (F.col("c_custkey") % 5).alias("boxes")))


@query("evaluation_triggers", "SELECT avg(((c_custkey % 10 / 10.0 < 0.7) = (c_custkey % 8 / 20.0 > 0.12 OR c_custkey % 9 = 0))::INT)::DOUBLE AS accuracy FROM customer")
def evaluation_triggers(spark, sf_dir):
    k = F.col("c_custkey")
    return E.trigger_accuracy(table(spark, sf_dir, "customer").select((k % 10 / 10).alias("confidence"), (k % 8 / 20).alias("cer"), (k % 9 == 0).alias("needs_review")))


@query("evaluation_containment", "SELECT c_custkey, true AS inside, false AS apart FROM customer")
def evaluation_containment(spark, sf_dir):
    inside = E.contained_either_way(F.lit("customer"), F.col("c_name")) & E.contained_either_way(F.col("c_name"), F.lit("CUSTOMER"))
    return table(spark, sf_dir, "customer").select("c_custkey", inside.alias("inside"), E.contained_either_way(F.lit("nobody"), F.col("c_name")).alias("apart"))


@query(
    "evaluation_backends",
    "SELECT backend, count(*) AS n, 0.0::DOUBLE AS cer, 0.0::DOUBLE AS wer, 1.0::DOUBLE AS exact, count(*) FILTER (r) / (2 * count(*)) + 0.5 AS recall, count(*) FILTER (r) / count(*) AS critical_recall, count(*) FILTER (NOT r) AS critical_misses, array_to_string(list_sort(list('pin:absent' || c_custkey) FILTER (NOT r))[1:3], ',') AS first_misses, round(avg(c_custkey % 2), 4)::DOUBLE AS mapping FROM (SELECT *, 'b' || c_custkey % 3 AS backend, c_custkey % 4 <> 0 AS r FROM customer) GROUP BY 1",
)
def evaluation_backends(spark, sf_dir):
    k, item = F.col("c_custkey"), lambda kind, v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
    pin = F.when(k % 4 != 0, F.col("c_name")).otherwise(F.concat(F.lit("absent"), k.cast("string")))
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("b"), (k % 3).cast("string")).alias("backend"), F.col("c_name").alias("truth"), F.col("c_name").alias("prediction"), F.array(item("pin", pin), item("name", F.col("c_name"))).alias("items"), (k % 2).alias("mapped"))
    return E.evaluate_backend(rows, ["pin"], misses=3).withColumn("first_misses", F.array_join("first_misses", ","))


# -- boxes ----------------------------------------------------------------------------------------------------------


def _box(x0, y0, x1, y1):
    return F.struct(*(F.lit(v).cast("double").alias(n) if not hasattr(v, "cast") else v.cast("double").alias(n) for v, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"))))


@query("boxes_of_points", "SELECT c_custkey, (c_custkey % 7)::DOUBLE AS x0, 1.0::DOUBLE AS y0, (c_custkey % 7 + 4)::DOUBLE AS x1, 9.0::DOUBLE AS y1 FROM customer")
def boxes_of_points(spark, sf_dir):
    x = (F.col("c_custkey") % 7).cast("double")
    points = F.array(F.array(x + 4, F.lit(1.0)), F.array(x, F.lit(9.0)), F.array(x + 2, F.lit(3.0)))
    return table(spark, sf_dir, "customer").select("c_custkey", X.box_of(points).alias("b")).select("c_custkey", "b.*")


@query("boxes_cover", "SELECT c_custkey, greatest(0, 10 - c_custkey % 12) / 10.0 AS cover, least(c_custkey % 12, 0)::DOUBLE AS x0, (c_custkey % 12 + 10)::DOUBLE AS x1 FROM customer")
def boxes_cover(spark, sf_dir):
    x = F.col("c_custkey") % 12
    a, b = _box(0, 0, 10, 10), _box(x, 0, x + 10, 20)
    rows = table(spark, sf_dir, "customer").select("c_custkey", X.cover(a, b).alias("cover"), X.union_box(F.array(a, b)).alias("u"))
    return rows.select("c_custkey", "cover", "u.x0", "u.x1")


@query("boxes_normal", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 100.0 END::DOUBLE AS x1, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 0.0 END::DOUBLE AS x0, CASE WHEN c_custkey % 3 = 0 THEN 4.0 ELSE 0.0 END::DOUBLE AS padded_x0 FROM customer")
def boxes_normal(spark, sf_dir):
    third = F.col("c_custkey") % 3 == 0
    box = _box(F.when(third, 10.0).otherwise(200.0), 5, F.when(third, 12.0).otherwise(-7.0), 40)
    rows = table(spark, sf_dir, "customer").select("c_custkey", G.normal_box(box, F.lit(100.0), F.lit(50.0)).alias("b"), G.padded(box, F.lit(100.0), F.lit(50.0)).alias("p"))
    return rows.select("c_custkey", F.col("b.x0").alias("x0"), F.col("b.x1").alias("x1"), F.col("p.x0").alias("padded_x0"))


@query("boxes_corner", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END AS corner, c_custkey % 2 = 1 AS blended FROM customer")
def boxes_corner(spark, sf_dir):
    ink = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit(0.5), F.lit(0.2), F.lit(0.01), F.lit(0.01))).otherwise(F.array(F.lit(0.1), F.lit(0.1), F.lit(0.3), F.lit(0.2)))
    return table(spark, sf_dir, "customer").select("c_custkey", G.corner(ink).alias("c")).select("c_custkey", "c.*")


@query("boxes_corrections", "SELECT 'k' || c_custkey % 3 AS type, count(*) AS n, avg(c_custkey % 5)::DOUBLE AS dx, 0.0::DOUBLE AS dy, 2.0::DOUBLE AS dw, 1.0::DOUBLE AS dh FROM customer WHERE c_custkey % 4 <> 0 GROUP BY 1")
def boxes_corrections(spark, sf_dir):
    k = F.col("c_custkey")
    action = F.element_at(F.array(*map(F.lit, ("approve", "expand", "shrink", "move"))), (k % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("k"), (k % 3).cast("string")).alias("type"), action.alias("action"), _box(0, 0, 10, 10).alias("before"), _box(k % 5, 0, k % 5 + 12, 11).alias("after"))
    return G.corrections(rows)


@query("boxes_best_iou", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS iou, c_custkey % 2 = 0 AS mapped FROM customer")
def boxes_best_iou(spark, sf_dir):
    k = F.col("c_custkey")
    expected = table(spark, sf_dir, "customer").select(k.alias("page"), k.alias("id"), _box(0, 0, 10, 10).alias("box"))
    predicted = expected.where("id % 2 = 0").select("page", F.explode(F.array(_box(0, 0, 10, 10), _box(5, 5, 9, 9))).alias("box"))
    return E.best_iou(expected, predicted, "page").select("id", "iou", "mapped")


@query("boxes_deduped", "SELECT c_custkey AS page, 1 AS doc_id FROM customer UNION ALL SELECT c_custkey, 3 FROM customer UNION ALL SELECT c_custkey, 4 FROM customer")
def boxes_deduped(spark, sf_dir):
    """Of two like boxes the surer stays, a distant one and one without a box too."""
    row = lambda i, box, c: F.struct(F.lit(i).alias("doc_id"), F.lit("k").alias("kind"), box.alias("box"), F.lit(c).alias("confidence"), F.lit("regex").alias("method"))
    empty = F.when(F.col("c_custkey") < 0, _box(0, 0, 0, 0))
    rows = F.array(row(1, _box(0, 0, 10, 10), 0.9), row(2, _box(0, 0, 10, 9), 0.8), row(3, _box(50, 0, 60, 10), 0.5), row(4, empty, 0.1))
    boxes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.explode(rows).alias("r")).select("page", "r.*")
    return G.dedupe_boxes(boxes, "page", "doc_id").select("page", "doc_id")


@query("boxes_new", "SELECT c_custkey AS page, 2 AS id FROM customer UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_custkey % 2 = 1")
def boxes_new(spark, sf_dir):
    row = lambda i, box: F.struct(F.lit(i).alias("id"), F.lit("k").alias("kind"), box.alias("box"), F.lit(0.5).alias("confidence"), F.lit("m").alias("method"))
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"))
    candidates = pages.select("page", F.explode(F.array(row(1, _box(0, 0, 10, 10)), row(2, _box(50, 0, 60, 10)))).alias("r")).select("page", "r.*")
    existing = pages.select("page", F.when(F.col("page") % 2 == 0, "approved").otherwise("rejected").alias("status"), _box(0, 0, 10, 10).alias("box"))
    return G.new_boxes(candidates, existing, "page", "id").select("page", "id")


def _words(spark, sf_dir, text):
    """A page for each customer: its words, twenty high, forty apart for each line of the text."""
    lines = F.split(text, "\n")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.posexplode(lines).alias("row", "line"))
    words = rows.select("page", "row", F.posexplode(F.split("line", " ")).alias("n", "text"), "line")
    x = F.length(F.array_join(F.slice(F.split("line", " "), F.lit(1), F.col("n")), " ")) + F.when(F.col("n") > 0, 1).otherwise(0)
    return words.select("page", (F.col("row") * 100 + F.col("n")).cast("int").alias("word_no"), "text", *(v.cast("double").alias(c) for v, c in zip((x * 10, F.col("row") * 40, (x + F.length("text")) * 10, F.col("row") * 40 + 20), ("x0", "y0", "x1", "y1"))), F.lit(0.9).alias("confidence"))


@query("boxes_word_spans", "SELECT c_custkey AS page, 0 AS word_no, 0 AS start_at, 4 AS end_at FROM customer UNION ALL SELECT c_custkey, 1, 5, 5 + length(c_name) FROM customer UNION ALL SELECT c_custkey, 100, 6 + length(c_name), 9 + length(c_name) FROM customer")
def boxes_word_spans(spark, sf_dir):
    words = _words(spark, sf_dir, F.concat(F.lit("Dear "), F.col("c_name"), F.lit("\nbye")))
    return G.word_spans(words, "page").select("page", "word_no", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query("boxes_of_spans", "SELECT c_custkey AS page, 1 AS span_id, 50.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, (50 + 10 * length(c_name))::DOUBLE AS x1, 20.0::DOUBLE AS y1 FROM customer UNION ALL SELECT c_custkey, 1, 0.0, 40.0, 20.0, 60.0 FROM customer")
def boxes_of_spans(spark, sf_dir):
    """A span from the first line into the middle of a word of the second."""
    words = G.word_spans(_words(spark, sf_dir, F.concat(F.lit("Dear "), F.col("c_name"), F.lit("\nbye"))), "page")
    spans = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.lit(1).alias("span_id"), F.lit(5).alias("start"), (F.length("c_name") + 8).alias("end"))
    return G.span_boxes(words, spans, "page").select("page", "span_id", "box.x0", "box.y0", "box.x1", "box.y1")


@query("boxes_lines", "SELECT c_custkey AS page, 0 AS line, 'Dear ' || c_name AS text, 0.0::DOUBLE AS y0 FROM customer UNION ALL SELECT c_custkey, 1, 'bye', 40.0 FROM customer")
def boxes_lines(spark, sf_dir):
    words = _words(spark, sf_dir, F.concat(F.lit("Dear "), F.col("c_name"), F.lit("\nbye")))
    return G.cluster_lines(words, "page").select("page", "line", "text", "y0")


@query("boxes_first_fit", 'SELECT c_custkey AS page, unnest([0, 1, 100]) AS word_no, unnest([0, 0, 1]) AS "group" FROM customer')
def boxes_first_fit(spark, sf_dir):
    return G.first_fit_lines(_words(spark, sf_dir, F.concat(F.lit("Dear "), F.col("c_name"), F.lit("\nbye"))), "page")


@query("boxes_label_lines", "SELECT c_custkey AS page, 'person_name' AS type, c_name AS value, 60::DOUBLE AS x0, (10 * (6 + length(c_name)))::DOUBLE AS x1 FROM customer")
def boxes_label_lines(spark, sf_dir):
    words = _words(spark, sf_dir, F.concat(F.lit("Name: "), F.col("c_name"), F.lit("\nPhone: none\nbye")))
    found = G.label_lines(G.cluster_lines(words, "page"), "page", {"person_name": r"^Name:\s*", "phone": r"^Phone:\s*"})
    return found.select("page", "type", "value", "box.x0", "box.x1")


@query("boxes_regions", "SELECT c_custkey AS page, unnest(['header', 'body', 'footer', 'signature']) AS region, unnest([0.70, 0.80, 0.65, 0.75])::DOUBLE AS confidence, unnest([0.0, 40.0, 120.0, 120.0])::DOUBLE AS y0 FROM customer")
def boxes_regions(spark, sf_dir):
    words = _words(spark, sf_dir, F.concat(F.lit("Dear "), F.col("c_name"), F.lit("\nsome words here\nand more\nwe are yours Sincerely")))
    return G.regions(words, "page").select("page", "region", "confidence", "y0")


@query("boxes_after_closing", "SELECT c_custkey AS page, 1 AS line, c_name || '|last' AS next FROM customer")
def boxes_after_closing(spark, sf_dir):
    words = _words(spark, sf_dir, F.concat(F.lit("hello\nYours sincerely\n"), F.col("c_name"), F.lit("\nlast")))
    return G.lines_after(G.cluster_lines(words, "page"), "page").select("page", "line", F.array_join("next", "|").alias("next"))


@query("boxes_on_lines", "SELECT c_custkey AS page, 0 AS line, 1 AS item_id FROM customer")
def boxes_on_lines(spark, sf_dir):
    lines = G.cluster_lines(_words(spark, sf_dir, F.concat(F.lit("Dear "), F.col("c_name"), F.lit("\nbye"))), "page").select("page", "line", F.struct("x0", "y0", "x1", "y1").alias("box"))
    item = lambda i, box: F.struct(F.lit(i).alias("item_id"), box.alias("box"))
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.explode(F.array(item(1, _box(-3, 2, 40, 23)), item(2, _box(0, 15, 20, 50)))).alias("i")).select("page", "i.*")
    return G.boxes_on_lines(lines, items, "page")


@query(
    "boxes_mapped_values",
    "SELECT c_custkey AS page, 1 AS value_id, 44.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, (56 + 10 * length(c_name))::DOUBLE AS x1, 0.8::DOUBLE AS confidence, false AS needs_review FROM customer UNION ALL SELECT c_custkey, 2, 0.0, 554.0, 146.0, 0.7, false FROM customer UNION ALL SELECT c_custkey, 3, 0.0, 434.0, 36.0, 0.72, false FROM customer",
)
def boxes_mapped_values(spark, sf_dir):
    """A value of the first line, one of the last lines and a telling one far down are found again among the page's lines."""
    filler = "\n".join(f"{c}{c}{c} {c}{c}" for c in "abcdfghijk")
    text = F.concat(F.lit("Dear "), F.col("c_name"), F.lit(f"\n{filler}\nqqq\nmail x.y@z.example yes\nooo\nlast line here"))
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), text.alias("text"), "c_name")
    value = lambda i, kind, v: F.struct(F.lit(i).alias("value_id"), F.lit(kind).alias("type"), v.alias("value"))
    values = pages.select("page", "text", F.explode(F.array(value(1, "person_name", F.col("c_name")), value(2, "notes", F.lit("line here")), value(3, "email", F.lit("qqq")))).alias("v"))
    values = values.select("page", "v.*", (F.position(F.col("v.value"), F.col("text")) - 1).alias("start"))
    lines = G.cluster_lines(_words(spark, sf_dir, text), "page")
    return G.map_values(values, pages.select("page", "text"), lines, "page", 1000.0, 1000.0).select("page", "value_id", "box.x0", "box.y0", "box.x1", "confidence", "needs_review")


@query("reviewer_masks", "SELECT c_custkey, 'C. ' || c_custkey AS name, c_custkey || ' [REDACTED-address]' AS address, 'cu***@x.example' AS email FROM customer")
def reviewer_masks(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    seen = lambda kind, v: D.S.mask(F.lit(kind), v)
    return table(spark, sf_dir, "customer").select("c_custkey", seen("person_name", F.concat(F.lit("customer  "), k)).alias("name"), seen("address", F.concat(k, F.lit(" High Street"))).alias("address"), seen("email", F.concat(F.lit("customer"), k, F.lit("@x.example"))).alias("email"))
