"""Redo log sizing from observed write rates. Negative deltas are clamped to zero here, and only here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.functions import scalar as S
from capturelake.operators import deltas as D

WINDOW_SECONDS, SHORT_MINUTES = 900, 15


def redo_capacity(variables: DataFrame) -> DataFrame:
    """Bytes of redo log: the capacity setting, else file size times the number of files. variables: J7's result."""
    value = lambda n: F.max(F.when(F.col("name") == n, S.variable_double(F.col("value"))))
    got = variables.groupBy("capture_id").agg(value("innodb_redo_log_capacity").alias("a"), value("innodb_log_file_size").alias("b"), value("innodb_log_files_in_group").alias("c"))
    positive = lambda c: F.when(c > 0, c)
    return got.select("capture_id", F.coalesce(positive(F.col("a")), positive(F.col("b") * F.col("c"))).alias("capacity"))


def redo_sizing(samples: DataFrame, capacity: DataFrame, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """One row a capture: rates (bytes a second), minutes of writes the log holds at the peak, sizes for 15 and 60 minutes.

    samples: the written-bytes counter of each capture. capacity: capture_id, capacity."""
    delta = D.counter_delta(samples)
    peak = D.rolling_peak(delta, window_seconds).select("capture_id", "peak_rate", "full_window")
    block = D.finite_blocks(delta).groupBy("capture_id", "block").agg((F.max("seconds") - F.min("seconds")).alias("span"), F.sum(F.greatest(F.coalesce("delta", F.lit(0)), F.lit(0))).alias("bytes"))
    mean = block.groupBy("capture_id").agg((F.sum("bytes") / F.nullif(F.sum("span"), F.lit(0))).alias("mean_rate"), F.sum("bytes").alias("bytes"))
    out = capacity.join(peak.join(mean, "capture_id"), "capture_id", "full_outer")
    state = F.when(F.col("peak_rate").isNull() | F.col("mean_rate").isNull(), "rate_unavailable").when(F.col("capacity").isNull(), "config_missing").when(F.col("bytes") <= 0, "no_writes").otherwise("ok")
    minutes = F.col("capacity") / F.nullif(F.col("peak_rate"), F.lit(0.0)) / 60
    return out.withColumn("state", state).select(
        "capture_id", "state", "capacity", "mean_rate", "peak_rate", "full_window", F.when(F.col("state") == "ok", minutes).alias("minutes"),
        (F.col("peak_rate") * SHORT_MINUTES * 60).alias("size_15_min"), (F.col("peak_rate") * 3600).alias("size_1_hour"), F.when(F.col("state") == "ok", minutes < SHORT_MINUTES).alias("undersized"),
    )
