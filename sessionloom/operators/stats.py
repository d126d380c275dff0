"""Review, capture and validation statistics. Rates without a denominator are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.text import strip

HUMAN, EXTRACTION, APPROVALS = ("approve", "approve_with_edit", "merge", "reject", "skip"), ("staged", "gate_drop"), ("approve", "approve_with_edit", "merge")


def rate(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part, whole), 6)


def review_stats(log: DataFrame) -> DataFrame:
    """One row over the two disjoint populations, human decisions and extraction events."""
    n = lambda *a: F.count_if(F.col("action").isin(*a))
    sums = log.agg(n(*HUMAN).alias("shown"), n(*APPROVALS).alias("approved"), n("reject").alias("rejected"), n("skip").alias("skipped"), n(*EXTRACTION).alias("extracted"), n("gate_drop").alias("gate_dropped"))
    return sums.withColumn("approval_rate", rate(F.col("approved"), F.col("shown"))).withColumn("decided_rate", rate(F.col("approved"), F.col("shown") - F.col("skipped"))).withColumn("gate_drop_rate", rate(F.col("gate_dropped"), F.col("extracted")))


def histogram(rows: DataFrame, column: str, label: str) -> DataFrame:
    """(label, n) by falling count, then label; nulls have the given label."""
    return rows.groupBy(F.coalesce(F.nullif(strip(F.col(column)), F.lit("")), F.lit(label)).alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def model_attribution(log: DataFrame) -> DataFrame:
    """(candidate_id, action, model): decisions with the model of the event that staged the candidate."""
    staged = log.filter("action = 'staged'").groupBy("candidate_id").agg(F.max_by("model", "ts").alias("model"))
    return log.filter(F.col("action").isin(*HUMAN)).select("candidate_id", "action").join(staged, "candidate_id", "left")


def capture_start(log: DataFrame, fallback: Column | None = None) -> DataFrame:
    """One row: the first readable stamp of the log, else the fallback, else null."""
    stamp = F.try_to_timestamp("ts", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return log.agg(F.min(stamp).alias("first")).select(F.coalesce("first", fallback if fallback is not None else F.lit(None).cast("timestamp")).alias("window_start"))


def considered(transcripts: DataFrame, start: Column, now: Column, grace_s: int = 120) -> DataFrame:
    """Transcripts (session_id, modified) inside the window, without those still being written."""
    return transcripts.filter((start.isNull() | (F.col("modified") >= start)) & (F.col("modified") <= now - F.make_dt_interval(secs=F.lit(grace_s))))


def capture_stats(sessions: DataFrame, log: DataFrame) -> DataFrame:
    """One row: how many considered sessions were captured, never logged, or logged without being queued."""
    logged = log.groupBy("session_id").agg(F.bool_or(F.coalesce("enqueued", F.lit(False))).alias("queued"))
    rows = sessions.select("session_id").distinct().join(logged, "session_id", "left")
    sums = rows.agg(F.count(F.lit(1)).alias("considered"), F.count_if(F.coalesce("queued", F.lit(False))).alias("captured"), F.count_if(F.col("queued").isNull()).alias("missed"), F.count_if(~F.coalesce("queued", F.lit(True))).alias("failed"))
    return sums.withColumn("capture_rate", rate(F.col("captured"), F.col("considered")))


def validation_counts(rows: DataFrame, valid: Column, warned: Column) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("checked"), F.count_if(~valid).alias("failed"), F.count_if(valid & warned).alias("warned"))


def outcome_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("outcome") != "dropped").alias("staged"), F.count_if(F.col("outcome") == "dropped").alias("dropped"))
