"""Time in stages, deadlines and the queue they make; work sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stage_times(events: DataFrame, key: str, stage: str, at: str, tie: str, deadlines: dict[str, float], now: Column) -> DataFrame:
    """key, stage, entered, left (null while it lasts), seconds, due and late for every stage that a key enters.

    Events that repeat the stage a key is in do not start it anew. A stage without a deadline is never late; one that lasts
    is held against now. A key's events pass one task in order; nothing of them is gathered.
    """
    order = Window.partitionBy(key).orderBy(at, tie)
    starts = events.withColumn("__before", F.lag(stage).over(order)).where(~F.col(stage).eqNullSafe(F.col("__before")) | F.col("__before").isNull())
    rows = starts.withColumn("left", F.lead(at).over(order))
    limit = F.lit(None).cast("double")
    for name, seconds in deadlines.items():
        limit = F.when(F.col(stage) == name, float(seconds)).otherwise(limit)
    length = F.unix_micros(F.coalesce("left", now)) - F.unix_micros(at)
    due = F.timestamp_micros(F.unix_micros(at) + (limit * 1e6).cast("long"))
    return rows.select(key, stage, F.col(at).alias("entered"), "left", (length / 1e6).alias("seconds"), due.alias("due"), F.coalesce(length > limit * 1e6, F.lit(False)).alias("late"))


def sla_queue(times: DataFrame, key: str) -> DataFrame:
    """Stages that last and have a deadline, the most urgent first; ties by key."""
    return times.where("left IS NULL AND due IS NOT NULL").orderBy("due", key)


def breaches(times: DataFrame, stage: str) -> DataFrame:
    """For each stage, how often it was entered and ran late, and its mean seconds."""
    return times.groupBy(stage).agg(F.count("*").alias("n"), F.count_if("late").alias("late"), F.avg("seconds").alias("seconds"))


def sessions(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """key, start, end (of the last event) and n of each run of a key's events with pauses below gap; works on streams too."""
    grouped = events.groupBy(key, F.session_window(at, gap).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.max(at).alias("end")).select(key, F.col("w.start").alias("start"), "end", "n")
