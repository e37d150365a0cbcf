"""Mergeable state of counters and gauges (A1 to A5): what is known of a series after a part of its samples, in one row.

A row is a (capture, snapshot, name) with its first and last value, its peak, its count and its span. The sum of a
counter's steps within a snapshot is its last value less its first, gaps bridged, so states of parts of a snapshot merge
without their samples, in any order, and a new snapshot adds rows without a look at older ones. Parts must not overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["capture_id", "snapshot", "name"]


def counter_state(samples: DataFrame) -> DataFrame:
    """State of samples (capture_id, snapshot, name, ts, seq, seconds, raw; is_counter where it is known).

    A sample without a value counts as a sample, and has no other effect but on the span."""
    seen = F.when(F.col("raw").isNotNull(), F.struct("ts", "seq", "raw"))
    kind = F.bool_or("is_counter") if "is_counter" in samples.columns else F.lit(None).cast("boolean")
    return samples.groupBy(*KEY).agg(F.count("*").alias("n"), F.min(seen).alias("first"), F.max(seen).alias("last"), F.max("raw").alias("peak"), kind.alias("is_counter"), F.min("seconds").alias("since"), F.max("seconds").alias("until"))


def merge_counter_state(states: DataFrame) -> DataFrame:
    """One row for each series and snapshot from states of parts of its samples."""
    return states.groupBy(*KEY).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("peak").alias("peak"), F.bool_or("is_counter").alias("is_counter"), F.min("since").alias("since"), F.max("until").alias("until"))


def counters_of(merged: DataFrame) -> DataFrame:
    """capture_id, name, total (A1), observed_seconds (A2), rate (A3), peak (A4), last_value (A5) of merged state.

    As with the direct operators, a total needs two samples and a counter, a peak a gauge; without is_counter both are given."""
    series = merged.groupBy("capture_id", "name").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.col("last.raw") - F.col("first.raw")), F.lit(0)).alias("steps"), F.max("peak").alias("top"), F.bool_or("is_counter").alias("is_counter"),
        F.max_by("last.raw", F.when(F.col("last").isNotNull(), F.struct("snapshot", "last.ts", "last.seq"))).alias("last_value"),
    )
    spans = merged.groupBy("capture_id", "snapshot").agg((F.max("until") - F.min("since")).alias("span")).groupBy("capture_id").agg(F.sum("span").alias("observed_seconds"))
    counts, gauge = F.coalesce("is_counter", F.lit(True)), ~F.coalesce("is_counter", F.lit(False))
    rows = series.join(spans, "capture_id").withColumn("total", F.when(counts & (F.col("n") >= 2), F.col("steps")))
    return rows.select("capture_id", "name", "total", "observed_seconds", F.when(F.col("observed_seconds") > 0, F.col("total") / F.col("observed_seconds")).alias("rate"), F.when(gauge, F.col("top")).alias("peak"), "last_value")
