"""Windows and buckets of many ranges over series (A24, A25) without another look at the samples.

A series becomes one row: its times in order, its values, their running sums, and the least and greatest value of every
``BLOCK`` of them. It is written once. A window is two look-ups in the times; count and sum are differences, the extremes
come from two overlapping runs of blocks and from what is left at its ends. So a window costs the same whatever it
spans, and no join brings a sample more than once. Sums are doubles: whole values are exact up to 2 ** 53."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturelake.deploy import ship
from capturelake.operators.deltas import STEPS

BLOCK, AT_ONCE = 64, 1024
INDEX = "seconds array<long>, values array<double>, sums array<double>, low array<double>, high array<double>"


def series_index(samples: DataFrame) -> DataFrame:
    """capture_id, name, n_all, since, until (over all samples) and the arrays of those with a value: write it, and use it often."""
    ship(samples.sparkSession)
    types = ", ".join(f"{c} {samples.schema[c].dataType.simpleString()}" for c in ("capture_id", "name"))
    seen = F.when(F.col("raw").isNotNull(), F.struct(F.col("seconds").cast("long").alias("s"), F.col("raw").cast("double").alias("v")))
    whole = samples.groupBy("capture_id", "name").agg(F.count("*").alias("n_all"), F.min("seconds").cast("long").alias("since"), F.max("seconds").cast("long").alias("until"), F.array_sort(F.collect_list(seen)).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(3)]
            for v in _arrays(batch.column("values")):
                out[0].append(np.cumsum(v))
                cut = np.arange(0, len(v), BLOCK)
                out[1].append(np.minimum.reduceat(v, cut) if len(v) else v)
                out[2].append(np.maximum.reduceat(v, cut) if len(v) else v)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(_lists(c, pa.float64()) for c in out)], [*batch.schema.names, "sums", "low", "high"])

    rows = whole.select("capture_id", "name", "n_all", "since", "until", F.col("x.s").alias("seconds"), F.col("x.v").alias("values"))
    return rows.mapInArrow(run, f"{types}, n_all long, since long, until long, {INDEX}")


def _arrays(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1]) if len(column) else []


def _lists(arrays: list[np.ndarray], of: pa.DataType) -> pa.Array:
    ends = np.append(0, np.cumsum([len(a) for a in arrays]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0)]), of))


def _extremes(values: np.ndarray, blocks: np.ndarray, i: np.ndarray, j: np.ndarray, least: bool) -> np.ndarray:
    """The least (or greatest) of values[i:j] for every window; nan where it is empty."""
    pick, reduce = (np.minimum, np.nanmin) if least else (np.maximum, np.nanmax)
    levels = [blocks]
    while 2 << (len(levels) - 1) <= len(blocks):
        half = 1 << (len(levels) - 1)
        levels.append(pick(levels[-1][:-half], levels[-1][half:]))
    first, last = -(-i // BLOCK), j // BLOCK  # whole blocks inside
    whole = first < last
    out = np.full(len(i), np.inf if least else -np.inf)
    span = np.where(whole, last - first, 1)
    level = np.frexp(span.astype(np.float64))[1] - 1
    for k in np.unique(level[whole]):
        at = np.flatnonzero(whole & (level == k))
        out[at] = pick(levels[k][first[at]], levels[k][last[at] - (1 << k)])
    reach = np.arange(2 * BLOCK)
    for lo, hi in ((i, np.where(whole, first * BLOCK, j)), (np.where(whole, last * BLOCK, j), j)):
        at = lo[:, None] + reach
        edge = np.where(at < hi[:, None], values[np.minimum(at, len(values) - 1)], np.inf if least else -np.inf)
        out = pick(out, edge.min(1) if least else edge.max(1))
    return np.where(j > i, out, np.nan)


def windows_of(seconds: np.ndarray, values: np.ndarray, sums: np.ndarray, low: np.ndarray, high: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Least, greatest, mean and count of the values within each [lo, hi]."""
    if not len(seconds):
        none = np.full(len(lo), np.nan)
        return none, none, none, np.zeros(len(lo), np.int64)
    lo, hi = np.minimum(lo, hi), np.maximum(lo, hi)
    i, j = np.searchsorted(seconds, lo, "left"), np.searchsorted(seconds, hi, "right")
    n = j - i
    before = np.append(0.0, sums)
    mean = np.where(n > 0, (before[j] - before[i]) / np.maximum(n, 1), np.nan)
    return _extremes(values, low, i, j, True), _extremes(values, high, i, j, False), mean, n


def windowed_stats(index: DataFrame, windows: DataFrame) -> DataFrame:
    """A24 for many windows (capture_id, window_id, lo, hi; bounds in either order, inclusive) of every series of their captures:
    capture_id, name, window_id, low, high, mean, n. A window without samples has nulls and counts 0."""
    ship(index.sparkSession)
    window_type = windows.schema["window_id"].dataType.simpleString()
    types = ", ".join(f"{c} {index.schema[c].dataType.simpleString()}" for c in ("capture_id", "name"))
    batch_no = F.floor((F.row_number().over(Window.partitionBy("capture_id").orderBy("window_id")) - 1) / AT_ONCE)
    bundles = windows.withColumn("bundle", batch_no).groupBy("capture_id", "bundle").agg(F.collect_list(F.struct("window_id", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))).alias("w"))
    joined = index.join(bundles, "capture_id").select("capture_id", "name", "seconds", "values", "sums", "low", "high", F.col("w.window_id").alias("ids"), F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_arrays(batch.column(c)) for c in ("seconds", "values", "sums", "low", "high", "lo", "hi")]
            for row, (seconds, values, sums, low, high, lo, hi) in enumerate(zip(*parts)):
                found = windows_of(seconds, values, sums, low, high, lo, hi)
                key = [pa.array([batch.column(c)[row].as_py()] * len(lo), batch.schema.field(c).type) for c in ("capture_id", "name")]
                numbers = [pa.array(x, pa.float64(), from_pandas=True) for x in found[:3]]
                yield pa.RecordBatch.from_arrays([*key, batch.column("ids")[row].values, *numbers, pa.array(found[3], pa.int64())], ["capture_id", "name", "window_id", "low", "high", "mean", "n"])

    return joined.mapInArrow(run, f"{types}, window_id {window_type}, low double, high double, mean double, n long")


def bucket_means(index: DataFrame) -> DataFrame:
    """A25 from the index: capture_id, name, bucket, mean, n, with the steps of ``time_bucket_mean``."""
    ship(index.sparkSession)
    types = ", ".join(f"{c} {index.schema[c].dataType.simpleString()}" for c in ("capture_id", "name"))
    spans = index.groupBy("capture_id").agg((F.max("until") - F.min("since")).alias("span"))
    want = F.greatest(F.lit(1), F.floor(F.col("span") / 30))
    step = F.lit(STEPS[-1])
    for s in reversed(STEPS):
        step = F.when(want <= s, F.lit(s)).otherwise(step)
    dense = (F.col("n_all") > 1) & ((F.col("until") - F.col("since")) / (F.col("n_all") - 1) < 0.9 * F.col("step"))
    planned = index.join(spans.select("capture_id", step.alias("step")), "capture_id").select("capture_id", "name", "seconds", "sums", F.when(dense, F.col("step")).otherwise(1).cast("long").alias("step"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (seconds, sums) in enumerate(zip(_arrays(batch.column("seconds")), _arrays(batch.column("sums")))):
                width = batch.column("step")[row].as_py()
                bucket = np.floor_divide(seconds, width) * width
                ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], len(bucket) > 0)[: len(bucket)])
                n = np.diff(np.append(-1, ends))
                total = np.diff(np.append(0.0, sums[ends]))
                key = [pa.array([batch.column(c)[row].as_py()] * len(ends), batch.schema.field(c).type) for c in ("capture_id", "name")]
                yield pa.RecordBatch.from_arrays([*key, pa.array(bucket[ends], pa.int64()), pa.array(total / np.maximum(n, 1), pa.float64()), pa.array(n, pa.int64())], ["capture_id", "name", "bucket", "mean", "n"])

    return planned.mapInArrow(run, f"{types}, bucket long, mean double, n long")
