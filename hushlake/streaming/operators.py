"""Streaming operators that Structured Streaming expresses directly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.operators.findings import line_findings
from hushlake.operators.pairing import clean


def stream_findings(regions: DataFrame) -> DataFrame:
    """Findings of single lines as regions arrive; stateless."""
    found = line_findings(clean(regions))
    return found.select("session_id", "frame_id", F.col("order.r").alias("region_id"), "kind", "value", "source")


def request_dedup(requests: DataFrame, delay: str) -> DataFrame:
    """One row per request id; replays within the delay are dropped."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_id", "request_id"])


def event_counts(events: DataFrame, size: str, slide: str, delay: str) -> DataFrame:
    """Events per kind in sliding windows, emitted when a window can no longer change."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", size, slide), "kind").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "kind", "n")


def activity_sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Runs of observations without a gap, per session id."""
    grouped = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "session_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(
        "session_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n"
    )


def chain_links(requests: DataFrame, delay: str, bound: str) -> DataFrame:
    """Follow-up requests joined to the receipt they continue, within a time bound."""
    receipts = requests.select("run_id", F.col("response_id").alias("receipt"), F.col("ts").alias("receipt_ts"), F.col("step").alias("receipt_step"))
    follow = requests.filter(F.col("previous_response_id").isNotNull()).select(
        F.col("run_id").alias("_run"), "step", F.col("previous_response_id").alias("_previous"), "ts"
    )
    left = follow.withWatermark("ts", delay)
    right = receipts.withWatermark("receipt_ts", delay)
    cond = (
        (F.col("_run") == F.col("run_id"))
        & (F.col("_previous") == F.col("receipt"))
        & (F.col("receipt_ts") <= F.col("ts"))
        & (F.col("ts") <= F.col("receipt_ts") + F.expr(f"INTERVAL {bound}"))
    )
    return left.join(right, cond).select("run_id", "step", "receipt_step", "receipt")
