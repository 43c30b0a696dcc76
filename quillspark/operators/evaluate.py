"""Quality of extraction and redaction: error rates, recalls, scores and golden cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.functions import scalars as X


def finite_mean(c: Column) -> Column:
    """Mean of finite values, 0 if there is none."""
    c = c.cast("double")
    return F.coalesce(F.avg(F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)), F.lit(0.0))


def backend_report(rows: DataFrame) -> DataFrame:
    """For each backend, rows, mean error rates and, where there are any, mean seconds (backend, truth, prediction)."""
    mean = lambda c: F.round(finite_mean(c), 4)
    seconds = [mean(F.col("elapsed_seconds")).alias("avg_seconds")] if "elapsed_seconds" in rows.columns else []
    t, p = F.col("truth"), F.col("prediction")
    return rows.groupBy("backend").agg(F.count("*").alias("n"), mean(X.cer(t, p)).alias("avg_cer"), mean(X.wer(t, p)).alias("avg_wer"), *seconds)


def evaluate_backend(rows: DataFrame, critical: list[str], misses: int = 25) -> DataFrame:
    """Macro error rates and micro recalls (backend, truth, prediction, items: array of struct type, value; may have
    mapped: the share of boxes found), and the first misses, at most `misses`, as type:value in order."""
    values = lambda items: F.transform(items, lambda i: i["value"])
    rows = rows.withColumn("all", X.token_recall(values(F.col("items")), F.col("prediction"))).withColumn("crit", X.token_recall(values(F.filter("items", lambda i: i["type"].isin(critical))), F.col("prediction")))
    low = X.normal(F.coalesce(F.col("prediction"), F.lit("")))
    missed = F.transform(F.filter("items", lambda i: ~F.contains(low, X.normal(i["value"]))), lambda i: F.concat_ws(":", i["type"], i["value"]))
    rows = rows.withColumn("missed", missed)
    mapping = [F.round(finite_mean(F.col("mapped")), 4).alias("mapping")] if "mapped" in rows.columns else []
    ratio = lambda c: F.when(F.sum(f"{c}.expected") > 0, F.sum(f"{c}.found") / F.sum(f"{c}.expected")).otherwise(1.0)
    return rows.groupBy("backend").agg(
        F.count("*").alias("n"),
        F.round(finite_mean(X.cer(F.col("truth"), F.col("prediction"))), 4).alias("cer"),
        F.round(finite_mean(X.wer(F.col("truth"), F.col("prediction"))), 4).alias("wer"),
        F.avg((X.normal(F.col("truth")) == X.normal(F.col("prediction"))).cast("double")).alias("exact"),
        ratio("all").alias("recall"),
        ratio("crit").alias("critical_recall"),
        F.sum(F.col("crit.expected") - F.col("crit.found")).alias("critical_misses"),
        F.slice(F.sort_array(F.flatten(F.collect_list(F.slice(F.sort_array("missed"), 1, misses)))), 1, misses).alias("first_misses"),
        *mapping,
    )


def trigger_accuracy(rows: DataFrame, threshold: float = 0.70, worst: float = 0.12) -> DataFrame:
    """How often low confidence goes with a bad reading (confidence, cer, needs_review)."""
    return rows.agg(F.avg(((F.col("confidence") < threshold) == ((F.col("cer") > worst) | F.col("needs_review"))).cast("double")).alias("accuracy"))


def document_score(judged: DataFrame) -> DataFrame:
    """judged (category_correct_guess, pii_should_be_redacted, pii_actually_redacted, false_positives,
    redaction_completeness, redaction_accuracy) with recall, precision and a weighted score."""
    both = F.size(F.array_intersect("pii_should_be_redacted", "pii_actually_redacted"))
    recall = both / F.greatest(F.size(F.array_distinct("pii_should_be_redacted")), F.lit(1))
    precision = both / F.greatest(F.size(F.array_distinct("pii_actually_redacted")), F.lit(1))
    rows = judged.withColumn("pii_recall", recall).withColumn("pii_precision", precision)
    total = 0.30 * F.col("pii_recall") + 0.30 * F.col("pii_precision") + 0.20 * F.col("category_correct_guess").cast("double") + 0.10 * F.col("redaction_completeness") + 0.10 * F.col("redaction_accuracy")
    return rows.withColumn("score", F.round(total, 4))


def case_results(cases: DataFrame) -> DataFrame:
    """Golden cases (case_id, redacted, types, needs_review and the expected_* arrays) with what failed, and passed.

    A value must be gone, labels and safe values still there, each type found or its alias, the review flag equal.
    """
    has = lambda v: F.contains(F.lower("redacted"), F.lower(v))
    alias = F.create_map(*[F.lit(x) for pair in V.TYPE_ALIASES.items() for x in pair])
    typed = lambda t: F.array_contains("types", t) | F.coalesce(F.array_contains(F.col("types"), F.try_element_at(alias, t)), F.lit(False))
    rows = cases.withColumn("leaked", F.filter("expected_redacted_values", has)).withColumn("lost_labels", F.filter("expected_unredacted_labels", lambda v: ~has(v)))
    rows = rows.withColumn("lost_values", F.filter("expected_not_redacted_values", lambda v: ~has(v))).withColumn("missing_types", F.filter("expected_redaction_types", lambda t: ~typed(t)))
    clean = (F.size("leaked") == 0) & (F.size("lost_labels") == 0) & (F.size("lost_values") == 0) & (F.size("missing_types") == 0)
    return rows.withColumn("passed", clean & (F.col("needs_review") == F.col("expected_needs_review")))


def _kept(expected: str, lost: str) -> Column:
    """Share of the expected that was not lost; 1 if nothing is expected."""
    total = F.sum(F.size(expected))
    return F.when(total > 0, (total - F.sum(F.size(lost))) / total).otherwise(1.0)


def case_summary(results: DataFrame, accept: float = 0.85) -> DataFrame:
    """One row: how many cases passed and what share of values, labels, safe values and review flags was right."""
    accuracy = F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(0.0))
    return results.agg(
        F.count("*").alias("cases"),
        accuracy.alias("accuracy"),
        _kept("expected_redacted_values", "leaked").alias("value_recall"),
        _kept("expected_unredacted_labels", "lost_labels").alias("label_score"),
        _kept("expected_not_redacted_values", "lost_values").alias("safe_score"),
        F.coalesce(F.avg((F.col("needs_review") == F.col("expected_needs_review")).cast("double")), F.lit(0.0)).alias("review_score"),
        (accuracy >= accept).alias("accepted"),
    )


def recall_by_type(results: DataFrame) -> DataFrame:
    """For each expected type, the cases that expect it and how many of them have it."""
    rows = results.select(F.explode(F.array_distinct("expected_redaction_types")).alias("type"), "missing_types")
    there = F.count_if(~F.array_contains("missing_types", F.col("type")))
    return rows.groupBy("type").agg(F.count("*").alias("expected"), there.alias("found"), (there / F.count("*")).alias("recall"))


def score_summary(scores: DataFrame) -> DataFrame:
    """One row of means, to thousandths, and sums over scored documents; no row if there are none."""
    means = {"avg_overall_score": "score", "avg_completeness": "redaction_completeness", "avg_accuracy": "redaction_accuracy", "avg_recall": "pii_recall", "avg_precision": "pii_precision", "category_accuracy": "category_correct_guess"}
    rows = scores.agg(
        F.count("*").alias("documents_evaluated"),
        *(F.round(F.avg(F.col(c).cast("double")), 3).alias(name) for name, c in means.items()),
        F.sum(F.size(F.array_except("pii_should_be_redacted", "pii_actually_redacted"))).alias("total_missed"),
        F.sum(F.size("false_positives")).alias("total_false_positives"),
    )
    return rows.where("documents_evaluated > 0")


def product_summary(results: DataFrame, recall: float = 0.85) -> DataFrame:
    """One row over cases with similarity, required_field_recall, missed_redactions, redacted_safe_values, missing_types, review_ok."""
    size = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0))
    good = (F.col("required_field_recall") >= recall) & (F.size("missed_redactions") == 0) & (F.size("redacted_safe_values") == 0) & F.col("review_ok")
    mean = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    return results.agg(
        F.count("*").alias("case_count"),
        mean("similarity").alias("average_similarity"),
        mean("required_field_recall").alias("average_required_field_recall"),
        size("missed_redactions").alias("missed_redaction_count"),
        size("redacted_safe_values").alias("false_positive_safe_redaction_count"),
        size("missing_types").alias("missing_type_count"),
        mean("review_ok").alias("review_score"),
        F.coalesce(F.bool_and(good), F.lit(False)).alias("passed_demo_threshold"),
    )


def label_counters(rows: DataFrame) -> DataFrame:
    """What automatic labelling did: rows by status (labelled, no_items, no_match, failed) and the boxes it made."""
    return rows.agg(F.count("*").alias("rows"), *(F.count_if(F.col("status") == s).alias(s) for s in ("labelled", "no_items", "no_match", "failed")), F.coalesce(F.sum("boxes"), F.lit(0)).alias("boxes"))


def contained_either_way(expected: Column, found: Column) -> Column:
    """Whether one value holds the other, without regard to case."""
    a, b = F.lower(expected), F.lower(found)
    return F.contains(a, b) | F.contains(b, a)


def best_iou(expected: DataFrame, predicted: DataFrame, page: str, threshold: float = 0.35) -> DataFrame:
    """Expected boxes (id, box) with their best IoU among the page's predicted boxes, and whether that is enough."""
    pairs = expected.join(predicted.select(page, F.col("box").alias("__box")), page, "left")
    found = pairs.groupBy(page, "id").agg(F.coalesce(F.max(X.iou(F.col("box"), F.col("__box"))), F.lit(0.0)).alias("iou"))
    return found.withColumn("mapped", F.col("iou") >= threshold)
