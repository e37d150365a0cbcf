"""Windows and buckets from an index against a look at every sample."""

import random

import numpy as np
from pyspark.sql import functions as F

from capturelake.operators import deltas as D
from capturelake.operators import series_index as X
from capturelake.sources.sinks import axes, series

SCHEMA = "capture_id string, name string, ts long, seq long, seconds long, raw double"


def samples(spark, n=900, seed=3):
    rng = random.Random(seed)
    rows = []
    for name, step in (("a", 7), ("b", 400)):
        at = 10_000
        for i in range(n):
            at += rng.choice([0, 1, step])
            rows.append((f"c{i % 2}", name, at, i, at, rng.choice([None, float(rng.randrange(-50, 50))]) if i % 3 else float(i)))
    return spark.createDataFrame(rows + [("c2", "a", 5, 0, 5, None)], SCHEMA)


def test_windows_equal_a_scan():
    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 65, 1000):
        seconds, values = np.sort(rng.integers(0, 300, n)), rng.integers(-99, 99, n).astype(float)
        cut = np.arange(0, n, X.BLOCK)
        low, high = (np.minimum.reduceat(values, cut), np.maximum.reduceat(values, cut)) if n else (values, values)
        lo, hi = rng.integers(-10, 320, 500), rng.integers(-10, 320, 500)
        got = X.windows_of(seconds, values, np.cumsum(values), low, high, lo, hi)
        for k in range(500):
            inside = values[(seconds >= min(lo[k], hi[k])) & (seconds <= max(lo[k], hi[k]))]
            want = (inside.min(), inside.max(), inside.mean()) if len(inside) else (np.nan,) * 3
            assert got[3][k] == len(inside) and np.allclose([g[k] for g in got[:3]], want, equal_nan=True)


def test_many_windows_equal_one_scan_each(spark):
    rows = samples(spark)
    windows = [("c0", i, 10_000 + 97 * i, 60_000 - 31 * i) for i in range(20)] + [("c1", 0, 90_000, 10_500), ("c2", 7, 0, 9), ("c9", 1, 0, 1)]
    got = X.windowed_stats(X.series_index(rows), spark.createDataFrame(windows, "capture_id string, window_id long, lo long, hi long"))
    found = {(r.capture_id, r.name, r.window_id): (r.low, r.high, r.mean and round(r.mean, 6), r.n) for r in got.collect()}
    assert len(found) == 2 * 20 + 2 + 1 and found["c2", "a", 7] == (None, None, None, 0)
    for c, i, lo, hi in windows[::4]:
        for r in D.windowed_stats(rows.filter(F.col("capture_id") == c), F.lit(lo), F.lit(hi)).collect():
            assert found[c, r.name, i] == (r.low, r.high, r.mean and round(r.mean, 6), r.n)


def test_bucket_means_equal_the_direct_ones(spark):
    rows = samples(spark)
    plain = lambda df: sorted((r.capture_id, r.name, r.bucket, round(r["mean"], 6), r.n) for r in df.collect())
    want = plain(D.time_bucket_mean(rows))
    assert want and plain(X.bucket_means(X.series_index(rows))) == want
    assert X.bucket_means(X.series_index(rows.limit(0))).count() == 0


def test_series_are_aligned_with_one_axis(spark):
    rows = [("c", "s1", 1, "x", 5), ("c", "s1", 3, "x", 6), ("c", "s1", 3, "x", 9), ("c", "s1", 2, "y", 1), ("c", "s2", 3, "y", None), ("c", "s2", 9, "z", 4), ("d", "s1", 1, "x", 7)]
    df = spark.createDataFrame(rows, "capture_id string, snapshot string, at long, label string, n int")
    assert {(r.capture_id, tuple(r.axis), tuple(r.boundaries)) for r in axes(df, "at", "snapshot").collect()} == {("c", (1, 2, 3, 3, 9), (0, 3)), ("d", (1,), (0,))}
    got = {(r.capture_id, r.label): r["values"] for r in series(df, "label", "at", "n", "snapshot").collect()}
    assert got == {("c", "x"): [5.0, None, 9.0, None, None], ("c", "y"): [None, 1.0, None, None, None], ("c", "z"): [None, None, None, None, 4.0], ("d", "x"): [7.0]}
