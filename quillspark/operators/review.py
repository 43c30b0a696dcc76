"""Review: routing of documents, state changes, undo, export checks, and what a role gets to see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.operators import classify as C
from quillspark.functions import spans as S
from quillspark.operators import text as T
from quillspark.operators.geometry import span_boxes, word_spans

#: Action -> (status before, status after); null before means any.
TRANSITIONS = {"approve": (None, "approved"), "reject": (None, "rejected"), "modify": (None, "modified"), "create": (None, "pending"), "remove": (None, "rejected")}
#: What becomes of a document: action -> (status, flag; null leaves it as it is).
DOCUMENT_ACTIONS = {"assign": ("in_review", None), "flag": ("needs_review", True), "approve_release": ("review_approved", False)}
INVERSE = {"create": "rejected", "remove": "pending", "approve": "pending"}


def route(documents: DataFrame) -> DataFrame:
    """documents with needs_review, reason and status.

    Reads pages, least_box_confidence, ocr_confidence, transcription_confidence, vision_complete, vision_warnings,
    selected_category, category, profiles and error; each may be null.
    """
    c = F.col
    rules = {
        "Multi-page document": c("pages") > 1,
        "Low-confidence redaction": c("least_box_confidence") < V.CONFIDENCE_THRESHOLD,
        "Low OCR confidence": c("ocr_confidence") < 0.70,
        "Low transcription confidence": c("transcription_confidence") < 0.65,
        "Category requires review": C.requires_review(c("category"), c("profiles")),
        "Vision check incomplete": ~c("vision_complete"),
        "Vision warnings": c("vision_warnings") > 0,
        "Selected category differs": (c("selected_category") != "") & (c("selected_category") != c("category")),
    }
    rows = documents.withColumn("reason", C.review_reasons({k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}))
    return rows.withColumn("needs_review", F.col("reason") != "").withColumn("status", C.final_status(F.col("needs_review"), F.col("error")))


def confidence_summary(pages: DataFrame) -> DataFrame:
    """For each document, a struct of its pages' readings (document_id, ocr_confidence, vision_status, vision_warnings, boxes)."""
    summary = F.struct(
        F.count("*").alias("page_count"),
        F.round(F.coalesce(F.avg("ocr_confidence"), F.lit(0.0)), 4).alias("average_confidence"),
        F.count_if(F.col("vision_status") == "complete").alias("complete_pages"),
        F.coalesce(F.sum("vision_warnings"), F.lit(0)).alias("warnings"),
        F.coalesce(F.sum("boxes"), F.lit(0)).alias("boxes"),
    )
    return pages.groupBy("document_id").agg(summary.alias("summary"))


def page_text(pages: DataFrame) -> DataFrame:
    """One text for each document: pages in order under a header, with an empty line between; engines listed once."""
    rows = pages.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "text"))).alias("all"), F.array_join(F.sort_array(F.collect_set("engine")), ",").alias("engines"))
    part = lambda p: F.concat(F.lit("--- Page "), p["page_number"].cast("string"), F.lit(" ---\n"), F.coalesce(p["text"], F.lit("")))
    return rows.select("document_id", F.array_join(F.transform("all", part), "\n\n").alias("text"), "engines")


def applied(redactions: DataFrame, actions: DataFrame) -> DataFrame:
    """Review events for actions (redaction_id, action_type, reviewed_at, id) with the status before and after.

    The status before is the one that the redaction's event before left, or the redaction's own.
    """
    from pyspark.sql import Window

    after = C.lookup(F.col("action_type"), {k: v[1] for k, v in TRANSITIONS.items()}, "pending")
    rows = actions.withColumn("new_status", after).join(redactions.select(F.col("id").alias("redaction_id"), F.col("status").alias("__own")), "redaction_id")
    before = F.lag("new_status").over(Window.partitionBy("redaction_id").orderBy("reviewed_at", "id"))
    return rows.withColumn("previous_status", F.coalesce(before, F.col("__own"))).drop("__own")


def undone(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """Undo events for candidates (document_id, id, action_type, previous_status); none for approved or exported documents."""
    open_ = documents.where(~F.col("status").isin("review_approved", "exported")).select(F.col("id").alias("document_id"))
    status = F.when(F.col("action_type") == "modify", F.col("previous_status")).otherwise(C.lookup(F.col("action_type"), INVERSE, "pending"))
    return candidates.join(open_, "document_id", "left_semi").select("document_id", F.lit("undo").alias("action_type"), F.concat(F.lit("undo:"), F.col("id").cast("string")).alias("reason"), status.alias("new_status"))


def document_action(documents: DataFrame, action: str, user_id) -> DataFrame:
    """documents after an action of a reviewer: status, flag and, but for flagging, who it was."""
    status, flag = DOCUMENT_ACTIONS[action]
    rows = documents.withColumn("status", F.lit(status))
    rows = rows if flag is None else rows.withColumn("flag_needs_review", F.lit(flag))
    return rows if action == "flag" else rows.withColumn("reviewer_id", F.lit(user_id))


def approve_all(redactions: DataFrame) -> DataFrame:
    """Review events that approve every pending redaction (id, document_id, status)."""
    return redactions.where("status = 'pending'").select(F.col("id").alias("redaction_id"), "document_id", F.lit("approve").alias("action_type"), F.col("status").alias("previous_status"), F.lit("approved").alias("new_status"), F.lit("Approve all").alias("reason"))


def exported(documents: DataFrame, exports: DataFrame) -> DataFrame:
    """documents after exports (document_id, export_allowed): those approved go to exported if an export was allowed."""
    out = exports.where("export_allowed").select(F.col("document_id").alias("id")).distinct().withColumn("__out", F.lit(True))
    rows = documents.join(out, "id", "left")
    return rows.withColumn("status", F.when(F.col("__out") & (F.col("status") == "review_approved"), "exported").otherwise(F.col("status"))).drop("__out")


def low_confidence(boxes: Column, threshold: float = V.CONFIDENCE_THRESHOLD) -> Column:
    """Whether any box (array of struct with confidence) is less sure than the threshold."""
    return F.coalesce(F.exists(boxes, lambda b: b["confidence"] < threshold), F.lit(False))


def may(role: Column, allowed: list[str], multi_user: bool = True) -> Column:
    """Whether a role may act; without several users all may."""
    return F.coalesce(role.isin(*allowed), F.lit(False)) if multi_user else F.lit(True)


def burn_plan(redactions: DataFrame) -> DataFrame:
    """For each page, the boxes that an export covers, and their number."""
    rows = redactions.where("status <> 'rejected' AND box IS NOT NULL")
    return rows.groupBy("document_id", "page_number").agg(F.sort_array(F.collect_list("box")).alias("boxes"), F.count("*").alias("n"))


def export_checks(exports: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """exports with the checks that fail, in order, and whether the file may go out."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in checks.items())))
    return exports.withColumn("failed_checks", failed).withColumn("export_allowed", F.size("failed_checks") == 0)


def redaction_rows(redactions: DataFrame, role: str, viewers: tuple[str, ...] = ("admin", "caseworker", "reviewer", "dpo")) -> DataFrame:
    """Redactions as a role gets them: the original value only for those who may view it."""
    return redactions.withColumn("original_value", F.col("original_value") if role in viewers else F.lit(None).cast("string"))


def tab_counts(documents: DataFrame) -> DataFrame:
    """Counts behind the tabs of a document list."""
    flagged = F.coalesce(F.col("flag_needs_review"), F.lit(False)) | F.col("status").isin("needs_review", "in_review")
    return documents.agg(F.count("*").alias("all"), F.count_if(flagged).alias("needs_review"), F.count_if(F.col("status") == "complete").alias("processed"), F.count_if(F.col("status") == "review_approved").alias("approved"), F.count_if(F.col("status").isin("error", "failed")).alias("failed"))


def create_from_text(requests: DataFrame, words: DataFrame, page: str) -> DataFrame:
    """New redactions from selected text: a row for each line of the page that the selection covers, or one with an error.

    requests: request_id, page, selected (text), start and end (offsets, or null), type and reason. words: page, word_no, text,
    x0, y0, x1, y1, confidence; a page's text is its words with single spaces between. Offsets count if both are given,
    else the first place of the text. A request goes wrong that selects less than two characters, or text that the page
    does not hold. A page's words are gathered as far as a request asks for the page.
    """
    asked = words.join(requests.select(page).distinct(), page, "left_semi")
    texts = asked.groupBy(page).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_no", "text"))), lambda w: w["text"]), " ").alias("__text"))
    rows = requests.join(texts, page, "left").withColumn("__text", F.coalesce("__text", F.lit("")))
    given = F.col("start").isNotNull() & F.col("end").isNotNull()
    place = F.when(given, T.selection(F.col("__text"), F.col("start"), F.col("end"))).otherwise(T.found_selection(F.col("__text"), F.col("selected")))
    rows = rows.withColumn("__place", F.when(F.length(S.bare(F.coalesce("selected", F.lit("")))) >= 2, place))
    short = F.length(S.bare(F.coalesce("selected", F.lit("")))) < 2
    error = F.when(short | (given & (F.length("__place.value") < 2)), "too short").when(F.col("__place").isNull(), "not on the page")
    clean = F.left(F.regexp_replace(F.regexp_replace(F.lower("type"), "[^a-z0-9_]+", "_"), "^_+|_+$", ""), F.lit(40))
    rows = rows.select("request_id", page, F.when(clean != "", clean).otherwise("manual").alias("redaction_type"), "reason", "__place", error.alias("error"))
    spans = rows.where("error IS NULL").select(page, F.col("request_id").alias("span_id"), "__place.start", "__place.end")
    boxes = span_boxes(word_spans(asked, page), spans, page).select(F.col("span_id").alias("request_id"), F.struct("box.x0", "box.y0", "box.x1", "box.y1").alias("box"))
    out = rows.join(boxes, "request_id", "left")
    made = F.col("error").isNull()
    return out.select(
        "request_id", page, "redaction_type", F.when(made, F.left("__place.value", F.lit(255))).alias("original_value"), F.when(made, F.concat(F.lit("[REDACTED-"), "redaction_type", F.lit("]"))).alias("masked_value"), "box",
        F.when(made, 1.0).alias("confidence"), F.lit("text_selection").alias("method"), F.when(made, "pending").alias("status"), "reason", "error",
    )
