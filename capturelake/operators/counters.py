"""Which counters and host metrics are shown: choices over the names of each capture."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturelake.functions import scalar as S
from capturelake.functions.fixed import CATEGORIES, DEFAULT_COUNTERS, DEFAULT_SHOWN, HOST_GROUPS


def names_of(status: DataFrame) -> DataFrame:
    """capture_id, name, is_counter: a row for each name of a capture's status samples."""
    return status.groupBy("capture_id", "name").agg(F.bool_or("is_counter").alias("is_counter"))


def select_counters(names: DataFrame, which: str = "all", text: str = "") -> DataFrame:
    """All names, the counters, the gauges or those of a category, that hold a text; place is alphabetical in the capture."""
    rows = names
    if which == "counters":
        rows = rows.filter("is_counter")
    elif which == "gauges":
        rows = rows.filter("not is_counter")
    elif which != "all":
        rows = rows.filter(S.in_category(F.col("name"), *CATEGORIES[which]))
    if text:
        rows = rows.filter(F.lower("name").contains(text.lower()))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("capture_id").orderBy(F.lower("name"), "name")))


def default_counters(names: DataFrame, preferred: list[str] | None = None, shown: int = DEFAULT_SHOWN) -> DataFrame:
    """A capture's preferred names that are there and counters, in their order, then its other counters by name."""
    listed = F.array(*map(F.lit, DEFAULT_COUNTERS if preferred is None else preferred))
    first = F.nullif(F.array_position(listed, F.col("name")), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("capture_id").orderBy(first.asc_nulls_last(), "name"))
    return names.filter("is_counter").withColumn("rank", rank).filter(F.col("rank") <= shown)


def host_metric_group(host: DataFrame, keys: list[str]) -> DataFrame:
    """Host metrics as rows (metric, value) with their group."""
    metrics = [c for c in HOST_GROUPS if c in host.columns]
    rows = host.select(*keys, *metrics).unpivot(keys, metrics, "metric", "value")
    return rows.withColumn("metric_group", S.lookup(F.col("metric"), HOST_GROUPS))
