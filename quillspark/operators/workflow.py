"""Queues, dashboards, history, batches, review events and their states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V


def tenant(rows: DataFrame, council_id) -> DataFrame:
    """Rows of one tenant; a null tenant sees what belongs to none."""
    return rows.where(F.col("council_id").eqNullSafe(F.lit(council_id)))


def since(rows: DataFrame, column: str, as_of: Column, days: int) -> DataFrame:
    if not 1 <= days <= 365:
        raise ValueError("days must be from 1 to 365")
    return rows.where(F.col(column) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def search_name(rows: DataFrame, column: str, wanted: str) -> DataFrame:
    """Rows whose column holds the text, without regard to case."""
    return rows.where(F.contains(F.lower(F.col(column)), F.lit(wanted.lower())))


def paged(rows: DataFrame, order: list[Column], offset: int, limit: int, most: int = 100) -> DataFrame:
    """One page in a total order."""
    rows = rows.orderBy(*order)
    rows = rows.offset(offset) if offset > 0 else rows  # without it, the plan takes the top rows and sorts no more
    return rows.limit(min(max(1, limit), most))


def review_queue(documents: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """Documents to review: most urgent first, then the oldest."""
    rows = documents.where(F.col("status").isin("needs_review", "in_review"))
    return paged(rows, [F.col("urgency_score").desc_nulls_last(), F.col("created_at").asc_nulls_first(), F.col("id")], offset, limit)


def document_list(documents: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    return paged(documents, [F.col("created_at").desc_nulls_last(), F.col("id").desc()], offset, limit)


def batch_list(batches: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    return paged(batches, [F.col("created_at").desc_nulls_last(), F.col("id").desc()], offset, limit)


def paged_with_total(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page, each row with the total of all pages; the count is an aggregate beside the page, not a window over all rows."""
    total = rows.agg(F.count("*").alias("total"))  # one row
    return paged(rows, order, offset, limit).join(F.broadcast(total), how="cross")


def iso(at: Column) -> Column:
    """A timestamp in ISO 8601, with microseconds where it has any."""
    return F.when(F.date_format(at, "SSSSSS") == "000000", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def backfilled(rows: DataFrame, council_id) -> DataFrame:
    """rows with the tenant put in where there is none."""
    return rows.withColumn("council_id", F.coalesce("council_id", F.lit(council_id)))


def history(reviews: DataFrame, limit: int = 100) -> DataFrame:
    return paged(reviews, [F.col("reviewed_at").desc_nulls_last(), F.col("id").desc()], 0, limit)


def counted(documents: DataFrame, redactions: DataFrame, active_only: bool = False) -> DataFrame:
    """documents with redaction_count; redactions are summed up before the join."""
    rows = redactions.where(F.col("status") != "rejected") if active_only else redactions
    counts = rows.groupBy("document_id").agg(F.count("*").alias("redaction_count"))
    return documents.join(counts, documents["id"] == counts["document_id"], "left").drop("document_id").withColumn("redaction_count", F.coalesce("redaction_count", F.lit(0)))


def dashboard(documents: DataFrame, mode: str = "strict") -> DataFrame:
    """One row of totals. compat counts every list of risk flags as an alert, strict only those with a flag."""
    done, review = F.count_if(F.col("status") == "complete"), F.count_if(F.col("status").isin("needs_review", "in_review"))
    alert = F.col("risk_flags").isNotNull() if mode == "compat" else F.coalesce(F.size("risk_flags") > 0, F.lit(False))
    return documents.agg(
        F.count("*").alias("total"),
        done.alias("complete"),
        review.alias("review"),
        F.count_if(F.col("status").isin("error", "failed")).alias("errors"),
        F.count_if(alert).alias("safeguarding_alerts"),
        F.when(done + review > 0, F.round(100 * done / (done + review), 1)).otherwise(0.0).alias("auto_approval_rate"),
        F.round(F.count("*") * 0.33, 1).alias("hours_saved"),
    )


def redaction_totals(documents: DataFrame, redactions: DataFrame) -> DataFrame:
    """One row: how many redactions the documents (id) have, and how many of them are approved and rejected."""
    own = redactions.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return own.agg(F.count("*").alias("redactions"), F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("status") == "rejected").alias("rejected"))


def category_counts(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("category").isin(*V.CATEGORIES)).groupBy("category").agg(F.count("*").alias("n"))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def status_changes(events: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """Rows at which a key's status differs from its row before, the first included."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = events.withColumn("previous", F.lag(status).over(w)).withColumn("__first", F.row_number().over(w) == 1)
    return rows.where(F.col("__first") | ~F.col("previous").eqNullSafe(F.col(status))).drop("__first")


def batch_progress(members: DataFrame) -> DataFrame:
    """For each batch, members by state and the share that is done; members has batch_id and status."""
    done, failed = F.count_if(F.col("status").isin(*V.TERMINAL_STATUS)), F.count_if(F.col("status").isin("error", "failed"))
    return members.groupBy("batch_id").agg(F.count("*").alias("total"), done.alias("processed"), failed.alias("failed"), F.round(100 * done / F.count("*"), 1).alias("progress"))


def current_state(events: DataFrame) -> DataFrame:
    """The newest status of each redaction from its review events (redaction_id, new_status, reviewed_at, id)."""
    return events.groupBy("redaction_id").agg(F.max_by("new_status", F.struct("reviewed_at", "id")).alias("status"), F.count("*").alias("n_events"))


def undo_candidates(events: DataFrame, undoable: list[str], undo: str = "undo") -> DataFrame:
    """For each document the newest undoable event that no undo names yet; undo rows name it as undo:<id> in reason."""
    undone = events.where(F.col("action_type") == undo).select(F.regexp_extract("reason", r"undo:(\d+)", 1).try_cast("long").alias("id")).where("id IS NOT NULL").distinct()
    rows = events.where(F.col("action_type").isin(*undoable)).join(undone, "id", "left_anti")
    return latest(rows, ["document_id"], [F.col("reviewed_at").desc(), F.col("id").desc()])


def unique_names(rows: DataFrame, folder: str, name: str, order: str) -> DataFrame:
    """Names made unique in their folder by _2, _3, ... before the suffix."""
    n = F.row_number().over(Window.partitionBy(folder, name).orderBy(order))
    stem, suffix = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return rows.withColumn("unique_name", F.when(n > 1, F.concat(stem, F.lit("_"), n.cast("string"), suffix)).otherwise(F.col(name)))


def retention_due(documents: DataFrame, policies: DataFrame, as_of: Column, default_years: int = 7) -> DataFrame:
    """Documents older than their category's years of 365 days; a report, nothing is deleted."""
    years = F.coalesce("retention_years", F.lit(default_years))
    rows = documents.join(policies.select("category", "retention_years"), "category", "left")
    return rows.where(F.col("created_at") < F.dateadd(F.to_date(as_of), -365 * years)).drop("retention_years")


def index_split(rows: DataFrame, index: str, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    share = F.pmod(F.col(index), F.lit(1000)) / 1000
    return rows.withColumn("split", F.when(share < train, "train").when(share < train + validation, "validation").otherwise("test"))
