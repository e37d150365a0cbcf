"""Sinks: series for charts on one axis a capture, and findings, as Parquet.

A capture's axis is stored once, with the places where its snapshots begin; a series is an array of values, one for each
point of the axis, null where it has none. Only samples are moved to build them, never a grid of labels and points: each
sample gets its place on the axis by an equi-join, and gaps are filled inside the array. Files hold captures by hash, so
their number does not follow the number of captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILES = 64


def _points(rows: DataFrame, axis: str, snapshot: str | None) -> DataFrame:
    """capture_id, snapshot, at, place: the distinct points of each capture's axis, in order of snapshots and time."""
    of = F.col(snapshot) if snapshot else F.lit(0)
    points = rows.select("capture_id", of.alias("snapshot"), F.col(axis).alias("at")).distinct()
    return points.withColumn("place", F.row_number().over(Window.partitionBy("capture_id").orderBy("snapshot", "at")) - 1)


def axes(rows: DataFrame, axis: str, snapshot: str | None = None) -> DataFrame:
    """capture_id, axis (array), boundaries (array: the place of each snapshot's first point; W9)."""
    points = _points(rows, axis, snapshot)
    whole = points.groupBy("capture_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "at"))), lambda p: p["at"]).alias("axis"))
    first = points.groupBy("capture_id", "snapshot").agg(F.min("place").alias("place")).groupBy("capture_id").agg(F.array_sort(F.collect_list("place")).alias("boundaries"))
    return whole.join(first, "capture_id")


def _aligned(entries: Column, n: Column) -> Column:
    """Values of (place, value), in order of places, as an array of n; nulls in between are put in run by run."""
    before = F.concat(F.array(F.lit(-1)), F.transform(F.slice(entries, F.lit(1), F.size(entries) - 1), lambda e: e["place"]))
    nothing = lambda k: F.array_repeat(F.lit(None).cast("double"), k)
    runs = F.zip_with(entries, before, lambda e, b: F.concat(nothing(e["place"] - b - 1), F.array(e["value"])))
    return F.concat(F.flatten(runs), nothing(n - 1 - F.element_at(entries, -1)["place"]))


def series(rows: DataFrame, label: str, axis: str, value: str, snapshot: str | None = None) -> DataFrame:
    """capture_id, label, values (array of double, aligned with the capture's axis). Of rows that repeat a point of a
    series the largest value counts; a series is one label of one capture."""
    of = F.col(snapshot) if snapshot else F.lit(0)
    points = _points(rows, axis, snapshot)
    length = points.groupBy("capture_id").agg(F.count("*").cast("int").alias("n"))
    once = rows.groupBy("capture_id", label, of.alias("snapshot"), F.col(axis).alias("at")).agg(F.max(value).cast("double").alias("value"))
    placed = once.join(points, ["capture_id", "snapshot", "at"]).groupBy("capture_id", label).agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("entries"))
    return placed.join(length, "capture_id").select("capture_id", label, _aligned(F.col("entries"), F.col("n")).alias("values"))


def _by_capture(table: DataFrame, files: int, *order: str) -> DataFrame:
    return table.repartition(files, "capture_id").sortWithinPartitions("capture_id", *order)


def write_series(rows: DataFrame, label: str, axis: str, value: str, path: str, snapshot: str | None = None, files: int = FILES) -> None:
    """The series below path, and the axes beside them; readers of one capture read one file of each."""
    _by_capture(series(rows, label, axis, value, snapshot), files, label).write.mode("overwrite").parquet(f"{path}/series")
    _by_capture(axes(rows, axis, snapshot), files).write.mode("overwrite").parquet(f"{path}/axes")


def write_findings(findings: DataFrame, path: str) -> None:
    """S27"""
    findings.write.mode("overwrite").parquet(path)
