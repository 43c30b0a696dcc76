"""What lists and detail pages show: tabs, searches, details, engine states, run status, dataset checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tab -> statuses; needs_review also takes flagged documents.
TABS = {
    "needs_review": ["needs_review", "in_review"],
    "processed": ["complete", "needs_review", "in_review", "review_approved", "exported"],
    "approved": ["review_approved", "exported"],
    "failed": ["failed", "error"],
}


def in_tab(tab: str) -> Column:
    if tab not in TABS:
        return F.lit(True)
    listed = F.coalesce(F.col("status").isin(TABS[tab]), F.lit(False))
    return listed | F.coalesce(F.col("flag_needs_review"), F.lit(False)) if tab == "needs_review" else listed


def search(rows: DataFrame, wanted: str, columns: list[str]) -> DataFrame:
    """Rows of which any column, as text, holds the words, without regard to case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(wanted.lower())), F.lit(False))
    return rows.where(hit)


def needs_attention(threshold: float = 0.6) -> Column:
    """Redactions that nobody decided on, that no person made, and that are unsure."""
    return ~F.col("status").isin("approved", "rejected") & ~F.col("method").isin("manual", "text_selection") & (F.col("confidence") < threshold)


def attention_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.coalesce(needs_attention(), F.lit(False)).desc(), F.col("id"))


def next_page(pages: DataFrame, current: int) -> DataFrame:
    """For each document, the next page with work, going on at the first after the last."""
    turn = F.struct((F.col("page_number") <= current).cast("int"), F.col("page_number"))
    return pages.where("open > 0").groupBy("document_id").agg(F.min_by("page_number", turn).alias("page_number"))


def recent(rows: DataFrame, key: str, used: str, keep: int = 25) -> DataFrame:
    """The last use of each key, the most recent `keep` of them."""
    return rows.groupBy(key).agg(F.max(used).alias(used)).orderBy(F.col(used).desc(), F.col(key)).limit(keep)


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """A repeatable order that has nothing to do with the key."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key)


def relative_time(at: Column, now: Column) -> Column:
    minutes = F.round((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(at.cast("timestamp"))) / 60).cast("long")
    hours = F.round(minutes / 60).cast("long").cast("string")
    return F.when(at.isNull(), "—").when(minutes < 1, "just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago"))).when(minutes < 1440, F.concat(hours, F.lit("h ago"))).otherwise(F.date_format(at, "yyyy-MM-dd"))


def engine_state(engine: Column, status: Column, main: str, fallbacks: list[str], blocked: list[str]) -> Column:
    """The first that holds: the main engine ran, a fallback ran, it could not run, nothing ran yet, nobody knows."""
    named = lambda tags: F.coalesce(F.array_contains(F.transform(F.array(*map(F.lit, tags)), lambda t: F.contains(engine, t)), F.lit(True)), F.lit(False))
    return F.when(named([main]), "main").when(named(fallbacks), "fallback").when(named(blocked), "blocked").when(status.isin("uploaded", "preprocessing", "ocr", "redaction"), "pending").otherwise("unknown")


def document_detail(documents: DataFrame, pages: DataFrame, redactions: DataFrame, audit: DataFrame) -> DataFrame:
    """documents with their pages, redactions and audit trail as sorted arrays; each child is grouped before it is joined."""

    def grouped(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
        item = F.struct(*order, *(c for c in rows.columns if c not in (*order, "document_id")))
        return rows.groupBy(F.col("document_id").alias("id")).agg(F.sort_array(F.collect_list(item)).alias(name))

    out = documents
    for rows, name, order in ((pages, "pages", ["page_number"]), (redactions, "redactions", ["id"]), (audit, "audit", ["timestamp"])):
        out = out.join(grouped(rows, name, order), "id", "left")
    return out


def page_detail(pages: DataFrame, redactions: DataFrame, readings: DataFrame) -> DataFrame:
    """pages with the number of active redactions and the newest reading (document_id, page_number, id, text)."""
    key = ["document_id", "page_number"]
    counts = redactions.where("status <> 'rejected'").groupBy(*key).agg(F.count("*").alias("redaction_count"))
    newest = readings.groupBy(*key).agg(F.max_by("text", "id").alias("text"))
    return pages.join(counts, key, "left").join(newest, key, "left").fillna(0, ["redaction_count"])


def best_engine(readings: DataFrame, key: list[str], steps: list[tuple[str, float]]) -> DataFrame:
    """The reading an engine cascade ends with: an engine's is kept if it is sure enough, else the surer of it and the next's.

    steps are (engine, least confidence) in order; readings has engine and confidence.
    """
    place = F.lit(None).cast("int")
    least = F.lit(0.0)
    for i, (name, limit) in enumerate(steps):
        place, least = F.when(F.col("engine") == name, i).otherwise(place), F.when(F.col("engine") == name, limit).otherwise(least)
    rows = readings.withColumn("__i", place).withColumn("__ok", F.col("confidence") >= least).where("__i IS NOT NULL")
    tried = Window.partitionBy(*key).orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__before", F.coalesce(F.max(F.col("__ok").cast("int")).over(tried), F.lit(0)))
    rank = Window.partitionBy(*key).orderBy(F.col("confidence").desc(), "__i")
    return rows.where("__before = 0").withColumn("__n", F.row_number().over(rank)).where("__n = 1").drop("__i", "__ok", "__before", "__n")


def run_status(stages: DataFrame, started: Column, now: Column, hourly_rate: float) -> DataFrame:
    """stages (stage, done, failed, current) with a status, the hours since the start and what they cost."""
    hours = F.greatest((F.unix_seconds(now) - F.unix_seconds(started)) / 3600, F.lit(0.0))
    status = F.when(F.col("failed"), "failed").when(F.col("done"), "complete").when(F.col("current"), "running").otherwise("pending")
    return stages.select("stage", status.alias("status"), F.round(hours, 3).alias("elapsed_hours"), F.round(hours * hourly_rate, 2).alias("cost"))


def document_split(number: Column, train: list[int], validation: list[int], test: list[int]) -> Column:
    """The part a whole document goes to, so that one text is never on two sides."""
    return F.when(number.isin(train), "train").when(number.isin(validation), "validation").when(number.isin(test), "test").otherwise("holdout")


def checked_items(keys: DataFrame) -> DataFrame:
    """Answer keys (document_id, ground_truth_text, sensitive_items) with the items whose value stands in the text, and a
    warning for each that does not."""
    there = lambda i: F.position(i["value"], F.col("ground_truth_text")) > 0
    warning = lambda i: F.concat(F.lit("value not in text: "), i["type"])
    rows = keys.withColumn("warnings", F.transform(F.filter("sensitive_items", lambda i: ~there(i)), warning))
    return rows.withColumn("sensitive_items", F.filter("sensitive_items", there))


def item_counts(keys: DataFrame, by: str) -> DataFrame:
    """How many items of each type each group has, a column for each type."""
    return keys.select(by, F.explode("sensitive_items").alias("i")).select(by, F.col("i.type").alias("type")).groupBy(by).pivot("type").agg(F.count(F.lit(1))).fillna(0)


def manifest_key(path: Column, page: Column, box: Column) -> Column:
    return F.concat_ws("|", F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), F.coalesce(page, F.lit(1)).cast("string"), F.coalesce(box.cast("string"), F.lit("")))


def predictions_for(manifest: DataFrame, predictions: DataFrame, order: str) -> DataFrame:
    """manifest with the last prediction for its image, whose path compares without regard to case."""
    last = predictions.groupBy(F.lower("image_path").alias("__key")).agg(F.max_by(F.struct("prediction", "confidence"), order).alias("__p"))
    return manifest.withColumn("__key", F.lower("image_path")).join(last, "__key", "left").select(*manifest.columns, "__p.*")


def preferred(available: Column, preference: list[str]) -> Column:
    """The first preferred backend that is available, else the first by name, else an empty text."""
    low = F.array_distinct(F.transform(available, F.lower))
    wanted = F.array_intersect(F.array(*map(F.lit, preference)), low)
    return F.coalesce(F.try_element_at(wanted, F.lit(1)), F.try_element_at(F.sort_array(low), F.lit(1)), F.lit(""))


def provenance(records: DataFrame, documents: DataFrame, council_id) -> DataFrame:
    """Export records without their signature, and whether the tenant may open the document."""
    own = documents.where(F.col("council_id").eqNullSafe(F.lit(council_id))).select(F.col("id").alias("document_id"), F.lit(True).alias("accessible"))
    return records.drop("signature").join(own, "document_id", "left").fillna(False, ["accessible"])
