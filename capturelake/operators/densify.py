"""Common axes over long tables. Densify only what a report selects: a full grid is labels times samples a capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid(rows: DataFrame, keys: list[str], label: str, axis: list[str], axis_rows: DataFrame | None = None) -> DataFrame:
    """Every label of a capture at every point of its axis: an equi-join on the capture's keys, never a cross join.

    U1: labels are the distinct union over snapshots."""
    labels = rows.select(*keys, label).distinct()
    points = (rows if axis_rows is None else axis_rows).select(*keys, *axis).distinct()
    return points.join(labels, keys)


def densify(rows: DataFrame, keys: list[str], label: str, axis: list[str], value: Column, fill: float | int | None = None, axis_rows: DataFrame | None = None) -> DataFrame:
    """J1 (fill null), J2 and J4 (fill 0): the value of each label at each point; value aggregates repeated rows."""
    have = rows.groupBy(*keys, label, *axis).agg(value.alias("value"))
    out = grid(rows, keys, label, axis, axis_rows).join(have, [*keys, label, *axis], "left")
    return out if fill is None else out.withColumn("value", F.coalesce("value", F.lit(fill)))


def first_label_axis(rows: DataFrame, keys: list[str], snapshot: str, label: str, axis: list[str]) -> DataFrame:
    """A snapshot's axis is that of its first label."""
    first = rows.groupBy(*keys, snapshot).agg(F.min(label).alias(label))
    return rows.join(first, [*keys, snapshot, label], "left_semi").select(*keys, snapshot, *axis).distinct()


def densify_status(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All names at all samples, null where absent; a name that is a counter anywhere is one everywhere."""
    kind = rows.groupBy(*keys, "name").agg(F.bool_or("is_counter").alias("is_counter"))
    points = rows.select(*keys, "snapshot", "sample").distinct()
    have = rows.select(*keys, "name", "snapshot", "sample", "raw")
    return points.join(kind, keys).join(have, [*keys, "name", "snapshot", "sample"], "left")


def snapshot_boundaries(samples: DataFrame, keys: list[str], snapshot: str, order: list[str]) -> DataFrame:
    """Place of each snapshot's first sample on the capture's merged axis."""
    w = Window.partitionBy(*keys).orderBy(snapshot, *order)
    within = Window.partitionBy(*keys, snapshot).orderBy(*order)
    return samples.withColumn("boundary", F.row_number().over(w) - 1).withColumn("n", F.row_number().over(within)).filter("n = 1").select(*keys, snapshot, "boundary")


def append_snapshots(samples: DataFrame, keys: list[str], snapshot: str, metric: str) -> DataFrame:
    """All snapshots' samples of the metrics that the capture's first snapshot has."""
    first = samples.groupBy(*keys).agg(F.min(snapshot).alias("__first"))
    names = samples.join(first, keys).filter(F.col(snapshot) == F.col("__first")).select(*keys, metric).distinct()
    return samples.join(names, [*keys, metric], "left_semi")


def top_processes(rows: DataFrame, keys: list[str], pid: str, command: str, axis: str, cpu: str, k: int = 3, servers: tuple[str, ...] = ("mysqld", "mariadbd")) -> DataFrame:
    """K processes by mean CPU over all of the capture's sample times (absent is 0), ties to the higher pid.
    T2: the best-ranked server process is appended if it is not among them."""
    times = rows.groupBy(*keys).agg(F.count_distinct(axis).alias("n"))
    once = rows.groupBy(*keys, pid, axis).agg(F.max_by(cpu, "seq").alias(cpu), F.max_by(command, "seq").alias(command), F.max("seq").alias("seq"))
    total = once.groupBy(*keys, pid).agg(F.sum(cpu).alias("cpu_total"), F.max_by(command, F.struct(axis, "seq")).alias(command))
    mean = total.join(times, keys).withColumn("mean_cpu", F.col("cpu_total") / F.col("n")).withColumn("is_server", F.lower(command).isin(*servers))
    order = [F.desc("cpu_total"), F.desc(pid)]
    ranked = mean.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumn("own", F.row_number().over(Window.partitionBy(*keys, "is_server").orderBy(*order)))
    return ranked.filter((F.col("rank") <= k) | (F.col("is_server") & (F.col("own") == 1))).select(*keys, pid, command, "mean_cpu", "rank")


def top_labels_other(rows: DataFrame, keys: list[str], label: str, axis: str, value: str, keep: int = 16, order: str | None = None) -> DataFrame:
    """T4: the labels with the highest peaks (ties in their original order); the others are summed as 'Other (n)'."""
    peak = rows.groupBy(*keys, label).agg(F.max(value).alias("peak"), F.min(order or label).alias("first"))
    ranked = peak.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("peak"), "first", label)))
    rest = ranked.groupBy(*keys).agg(F.count_if(F.col("rank") > keep).alias("others"))
    named = ranked.join(rest, keys).select(*keys, label, F.when(F.col("rank") <= keep, F.col(label)).otherwise(F.concat(F.lit("Other ("), F.col("others").cast("string"), F.lit(")"))).alias("shown"))
    return rows.join(named, [*keys, label]).groupBy(*keys, axis, F.col("shown").alias("label")).agg(F.sum(value).alias("value"))


def order_labels(label: Column) -> list[Column]:
    """Alphabetical with 'Other' last."""
    return [(label == "Other").asc(), label.asc()]
