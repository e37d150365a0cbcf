"""Counters and gauges over long sample tables: deltas, rates, blocks, rolling peaks, windows and buckets.

Sample tables have the capture's keys, ``snapshot``, ``name``, an order (``ts`` and ``seq``) and ``raw``. Every operator
partitions by capture, so its windows and groups stay as small as one capture's series. The three reset policies are kept
apart on purpose: status deltas keep negatives, network deltas drop them, sizing clamps them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["capture_id", "name"]


def _in_snapshot() -> Window:
    return Window.partitionBy("capture_id", "name", "snapshot").orderBy("ts", "seq")


def counter_delta(samples: DataFrame) -> DataFrame:
    """Difference to the last value seen in the snapshot; null for its first sample. Gaps are bridged."""
    seen = F.last("raw", ignorenulls=True).over(_in_snapshot().rowsBetween(Window.unboundedPreceding, -1))
    return samples.withColumn("delta", F.col("raw") - seen)


def net_delta(samples: DataFrame) -> DataFrame:
    """Difference to the poll directly before; null if that is missing, for the first poll, and if the value fell."""
    before = F.lag(F.struct("raw", "poll_idx")).over(_in_snapshot())
    step = F.when(before["poll_idx"] == F.col("poll_idx") - 1, F.col("raw") - before["raw"])
    return samples.withColumn("delta", F.when(step >= 0, step))


def net_rate(samples: DataFrame) -> DataFrame:
    """net_delta a second; null if no time has passed."""
    gap = F.col("seconds") - F.lag("seconds").over(_in_snapshot())
    return net_delta(samples).withColumn("rate", F.when(gap > 0, F.col("delta") / gap))


def _counts(rows: DataFrame) -> Column:
    """Whether a series is a counter: if it is one in any of its samples."""
    return F.coalesce(F.bool_or("is_counter"), F.lit(False)) if "is_counter" in rows.columns else F.lit(True)


def counter_total(deltas: DataFrame) -> DataFrame:
    """A1: sum of a counter's deltas, negative ones included; null with fewer than two samples, and for gauges where
    is_counter tells them."""
    return deltas.groupBy(*SERIES).agg(F.when((F.count("*") >= 2) & _counts(deltas), F.coalesce(F.sum("delta"), F.lit(0))).alias("total"))


def observed_seconds(samples: DataFrame) -> DataFrame:
    """A2: time covered by a capture's snapshots, without the gaps between them."""
    spans = samples.groupBy("capture_id", "snapshot").agg((F.max("seconds") - F.min("seconds")).alias("span"))
    return spans.groupBy("capture_id").agg(F.sum("span").alias("observed_seconds"))


def counter_rate(samples: DataFrame) -> DataFrame:
    """A3: counter_total a second of observed_seconds; null if that is not positive.

    One shuffle by capture serves the deltas, the totals and the observed time."""
    total, seconds = counter_total(counter_delta(samples)), observed_seconds(samples)
    return total.join(seconds, "capture_id").withColumn("rate", F.when(F.col("observed_seconds") > 0, F.col("total") / F.col("observed_seconds")))


def gauge_max(samples: DataFrame) -> DataFrame:
    """A4: highest value of a gauge; null for counters where is_counter tells them."""
    gauge = ~_counts(samples) if "is_counter" in samples.columns else F.lit(True)
    return samples.groupBy(*SERIES).agg(F.when(gauge, F.max("raw")).alias("peak"))


def gauge_last(samples: DataFrame) -> DataFrame:
    """A5: last value that is not null, in the newest snapshot that has one."""
    return samples.filter("raw is not null").groupBy(*SERIES).agg(F.max_by("raw", F.struct("snapshot", "ts", "seq")).alias("last_value"))


def counter_profile(deltas: DataFrame) -> DataFrame:
    """Total, smallest, largest and mean delta; the whole mean divides by the number of columns, the first included."""
    n = F.count("delta")
    return deltas.groupBy(*SERIES).agg(F.sum("delta").alias("total"), F.min("delta").alias("low"), F.max("delta").alias("high"), F.expr("sum(delta) div (count(delta) + 1)").alias("whole_mean"), F.when(n > 0, F.sum("delta") / n).alias("mean"))


def finite_blocks(deltas: DataFrame) -> DataFrame:
    """Number of each run of deltas that are not null; a block begins at the sample before its first delta."""
    w = Window.partitionBy("capture_id", "name").orderBy("ts", "seq")
    return deltas.withColumn("block", F.sum(F.when(F.col("delta").isNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def rolling_peak(deltas: DataFrame, window_seconds: int) -> DataFrame:
    """Highest rate over a full window of at least window_seconds, or over the longest block where all are shorter.

    For each sample the anchor is the last sample of its block at least the window before it. Deltas are clamped at zero,
    and the first sample of a block (null delta) is only a left bound."""
    block = finite_blocks(deltas).withColumn("step", F.greatest(F.coalesce(F.col("delta"), F.lit(0)), F.lit(0)))
    w = Window.partitionBy("capture_id", "name", "block").orderBy("ts", "seq")
    cum = block.withColumn("cum", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    by_time = Window.partitionBy("capture_id", "name", "block").orderBy("seconds").rangeBetween(Window.unboundedPreceding, -window_seconds)
    whole = Window.partitionBy("capture_id", "name", "block")
    at = cum.withColumn("anchor", F.max(F.struct("seconds", "ts", "seq", "cum")).over(by_time)).withColumn("span", F.max("seconds").over(whole) - F.min("seconds").over(whole)).withColumn("block_total", F.sum("step").over(whole))
    gap = F.col("seconds") - F.col("anchor.seconds")
    full = F.when(gap > 0, (F.col("cum") - F.col("anchor.cum")) / gap)
    out = at.groupBy(*SERIES).agg(F.max(full).alias("full_peak"), F.max(F.struct("span", F.when(F.col("span") > 0, F.col("block_total") / F.col("span")).alias("rate"))).alias("longest"))
    return out.select(*SERIES, F.coalesce("full_peak", "longest.rate").alias("peak_rate"), F.col("full_peak").isNotNull().alias("full_window"))


def windowed_stats(samples: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Min, max, mean and count of each series within [lo, hi], bounds in either order; empty series count 0."""
    inside = F.col("seconds").between(F.least(lo, hi), F.greatest(lo, hi)) & F.col("raw").isNotNull()
    v = F.when(inside, F.col("raw"))
    return samples.groupBy(*SERIES).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.when(F.count(v) > 0, F.sum(v) / F.nullif(F.count(v), F.lit(0))).alias("mean"), F.count(v).alias("n"))


STEPS = [30, 60, 120, 300, 600, 1800, 3600]


def time_bucket_mean(samples: DataFrame) -> DataFrame:
    """Mean of each bucket; the step is chosen for each capture and buckets align to the epoch.

    The step is the first of STEPS that is at least a thirtieth of the span; series whose samples are no denser than the
    step keep their samples as they are."""
    span = samples.groupBy("capture_id").agg((F.max("seconds") - F.min("seconds")).alias("span"))
    want = F.greatest(F.lit(1), F.floor(F.col("span") / 30))
    step = F.lit(STEPS[-1])
    for s in reversed(STEPS):
        step = F.when(want <= s, F.lit(s)).otherwise(step)
    per_capture = span.withColumn("step", step)
    per_series = samples.groupBy(*SERIES).agg(F.count("*").alias("n"), (F.max("seconds") - F.min("seconds")).alias("own_span"))
    plan = per_series.join(per_capture, "capture_id").select(*SERIES, F.when((F.col("n") > 1) & (F.col("own_span") / (F.col("n") - 1) < 0.9 * F.col("step")), F.col("step")).alias("step"))
    rows = samples.join(plan, SERIES)
    bucket = F.when(F.col("step").isNull(), F.col("seconds")).otherwise(F.expr("seconds div step * step")).cast("bigint")
    return rows.filter("raw is not null").groupBy(*SERIES, bucket.alias("bucket")).agg((F.sum("raw") / F.count("raw")).alias("mean"), F.count("*").alias("n"))


def collapse_runs(states: DataFrame, keys: list[str], order: list[str], signature: str = "signature") -> DataFrame:
    """Number of each run of equal signatures; null (an absent snapshot) is a run of its own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = ~F.col(signature).eqNullSafe(F.lag(signature).over(w)) | (F.row_number().over(w) == 1)
    return states.withColumn("run_no", F.sum(F.when(changed, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def sample_axis(rows: DataFrame, keys: list[str], order: list[str], start: str, step_seconds: int = 1) -> DataFrame:
    """Samples without a clock of their own are step_seconds apart from the snapshot's start on."""
    idx = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("sample_idx", idx).withColumn("at", F.col(start) + idx * step_seconds)


def midnight_roll(samples: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Seconds since the snapshot's midnight of clock readings; a clock that falls back begins another day, and a first
    reading more than 12 hours off the snapshot's own clock belongs to the day before or after."""
    w = Window.partitionBy(*keys).orderBy(order)
    rolled = F.sum(F.when(F.col("clock") < F.lag("clock").over(w), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    off = F.first("clock").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.col("start_clock")
    shift = F.when(off > 43200, -1).when(off < -43200, 1).otherwise(0)
    return samples.withColumn("at", F.col("clock") + (rolled + shift) * 86400)


def section_scope(lines: DataFrame, keys: list[str], order: str, header: Column) -> DataFrame:
    """The last header at or before a line."""
    return lines.withColumn("section", F.last(header, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
