"""Thread lists: histograms, activity and query digests. A row is one thread at one sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturelake.functions import scalar as S


def active_queries(rows: DataFrame) -> DataFrame:
    """Rows with a statement whose command is not idle."""
    return rows.filter(~F.lower(F.trim(F.coalesce("command", F.lit("")))).isin("", "sleep", "daemon") & ~F.upper(F.trim(F.coalesce("info", F.lit("")))).isin("", "NULL"))


def slow_query_search(digests: DataFrame, **needles: str) -> DataFrame:
    """Rows whose columns hold the given texts, without regard to case."""
    for column, needle in needles.items():
        if needle:
            digests = digests.filter(F.lower(column).contains(needle.lower()))
    return digests


def thread_histogram(rows: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """Threads of each sample by every dimension, in one pass; empty labels are 'Other'."""
    wide = rows.select(*keys, *[S.bucket_other(F.col(d), d in ("state", "db")).alias(d) for d in dims])
    return wide.unpivot(keys, dims, "dim", "label").groupBy(*keys, "dim", "label").agg(F.count("*").alias("n"))


def thread_activity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A8"""
    age = F.coalesce(F.col("time_ms"), F.col("time_s") * 1000)
    sleeping = F.count_if(F.col("command") == "Sleep")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("total"), (F.count("*") - sleeping).alias("active"), sleeping.alias("sleeping"), F.max(age).alias("max_age_ms"),
        F.max("rows_examined").alias("max_rows_examined"), F.max("rows_sent").alias("max_rows_sent"), F.count_if(F.trim(F.coalesce("info", F.lit(""))) != "").alias("with_text"),
    )


def thread_peaks(activity: DataFrame, keys: list[str]) -> DataFrame:
    """Peaks over a capture's samples."""
    return activity.groupBy(*keys).agg(*[F.max(c).alias(f"peak_{c}") for c in ("total", "active", "sleeping", "max_age_ms", "max_rows_examined", "max_rows_sent")])


def digest_state(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A9 as mergeable state: one row for each query shape, with how slow its slowest sighting was and what was seen there.

    Partial aggregation keeps one value for each shape and task, so the shuffle grows with shapes, not with threads."""
    shape = S.normalize_query(F.col("info"))
    text = rows.withColumn("normal", shape).withColumn("fingerprint", S.query_fingerprint(F.col("normal")))
    slowest = F.struct(F.col("time_ms").isNotNull().alias("known"), F.coalesce("time_ms", F.lit(0)).alias("time_ms"), (-F.col("seq")).alias("before"))
    return text.groupBy(*keys, "fingerprint").agg(
        F.count("*").alias("sightings"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max("time_ms").alias("max_time_ms"), F.max("rows_examined").alias("max_rows_examined"),
        F.max("rows_sent").alias("max_rows_sent"), F.max_by(F.struct("user", "db", "command", "state"), slowest).alias("at"), F.max(slowest).alias("slowest"), F.min("normal").alias("normal"),
    )


def merge_digests(states: DataFrame, keys: list[str]) -> DataFrame:
    """Digest state of the sightings of several states, which must not overlap."""
    return states.groupBy(*keys, "fingerprint").agg(
        F.sum("sightings").alias("sightings"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("max_time_ms").alias("max_time_ms"), F.max("max_rows_examined").alias("max_rows_examined"),
        F.max("max_rows_sent").alias("max_rows_sent"), F.max_by("at", "slowest").alias("at"), F.max("slowest").alias("slowest"), F.min("normal").alias("normal"),
    )


def digests_of(states: DataFrame, keys: list[str]) -> DataFrame:
    return states.select(*keys, "fingerprint", "sightings", "first_seen", "last_seen", "max_time_ms", "max_rows_examined", "max_rows_sent", "at.*", S.bound_snippet(F.col("normal")).alias("snippet"))


def query_digest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each query shape; descriptive columns come from the slowest sighting, the first of equals."""
    return digests_of(digest_state(rows, keys), keys)


def top_queries(digests: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """T3, applied to merged digests only."""
    order = [F.desc_nulls_last("max_time_ms"), F.desc_nulls_last("max_rows_examined"), F.desc_nulls_last("max_rows_sent"), F.asc("fingerprint")]
    return digests.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
