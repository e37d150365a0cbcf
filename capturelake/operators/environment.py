"""Host and server facts of a capture: uptime, identity, fill ratios and panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions import scalar as S


def uptime_anchor(samples: DataFrame, variables: DataFrame) -> DataFrame:
    """Last Uptime of the newest snapshot that has one, and the start it implies; else that of the variables.

    samples: capture_id, snapshot, ts, seq, seconds, raw of Uptime. variables: capture_id, snapshot_seconds, value of Uptime."""
    live = samples.filter("raw is not null").groupBy("capture_id").agg(F.max_by(F.struct(F.col("raw").alias("uptime"), "seconds"), F.struct("snapshot", "ts", "seq")).alias("x"))
    read = variables.withColumn("u", F.col("value").try_cast("bigint")).filter("u is not null").groupBy("capture_id").agg(F.max_by(F.struct(F.col("u").alias("uptime"), F.col("snapshot_seconds").alias("seconds")), "snapshot_seconds").alias("y"))
    best = live.join(read, "capture_id", "full_outer").select("capture_id", F.coalesce("x", "y").alias("best"), F.when(F.col("x").isNotNull(), "status").otherwise("variables").alias("origin"))
    return best.select("capture_id", F.col("best.uptime").alias("uptime"), (F.col("best.seconds") - F.col("best.uptime")).alias("started"), "origin")


def os_uptime(host: DataFrame) -> DataFrame:
    """Seconds since boot at the sidecar's time (else at the last snapshot); only if positive."""
    up = F.coalesce("sidecar_seconds", "last_snapshot_seconds") - F.col("btime")
    return host.select("capture_id", F.when(up > 0, up).alias("os_uptime"))


def share(part: Column, whole: Column) -> Column:
    """A ratio between 0 and 1; null without a whole."""
    return F.when(whole > 0, F.least(F.greatest(part / F.nullif(whole, F.lit(0)), F.lit(0.0)), F.lit(1.0)))


def fill_ratios(facts: DataFrame) -> DataFrame:
    """Buffer pool fill and dirty share, table cache use, with severities. facts: one row a capture with last values."""
    fill = 1 - share(F.col("pages_free"), F.col("pages_total"))
    dirty, cache = share(F.col("pages_dirty"), F.col("pages_total")), share(F.col("open_tables"), F.col("table_open_cache"))
    return facts.select(
        "capture_id", fill.alias("buffer_fill"), dirty.alias("buffer_dirty"), S.severity_for_fraction(dirty, 0.5, 0.8).alias("dirty_severity"), cache.alias("table_cache_use"), S.severity_for_fraction(cache, 0.8, 0.95).alias("table_cache_severity"),
    )


#: A27, fixed values: settings of the server panel.
SERVER_PANEL = [
    "version", "version_comment", "server_id", "port", "datadir", "max_connections", "thread_cache_size", "table_open_cache", "table_open_cache_instances", "table_definition_cache", "innodb_buffer_pool_size",
    "innodb_buffer_pool_instances", "innodb_redo_log_capacity", "innodb_log_file_size", "innodb_log_files_in_group", "innodb_flush_log_at_trx_commit", "innodb_flush_method", "innodb_io_capacity", "innodb_io_capacity_max", "innodb_adaptive_hash_index",
    "sync_binlog", "log_bin", "binlog_format", "gtid_mode", "slow_query_log", "long_query_time", "tmp_table_size", "max_heap_table_size",
]
CLUSTER_PANEL = ["wsrep_on", "wsrep_cluster_size", "wsrep_cluster_name", "wsrep_local_state_comment"]


def panel(values: DataFrame, names: list[str]) -> DataFrame:
    """One wide row a capture; names are given, so no job looks for them. values: capture_id, name, value."""
    return values.groupBy("capture_id").agg(*[F.max(F.when(F.lower("name") == n, F.col("value"))).alias(n) for n in names])


def server_panel(variables: DataFrame) -> DataFrame:
    """Settings, distribution, and the cluster part only where replication of that kind is on."""
    wide = panel(variables, [*SERVER_PANEL, *CLUSTER_PANEL])
    kind = S.distribution(F.col("wsrep_on"), F.col("wsrep_cluster_size"), F.col("version_comment"), F.col("version"))
    on = F.coalesce(F.lower("wsrep_on").isin("on", "1"), F.lit(False))
    cluster = F.when(on, F.struct(*CLUSTER_PANEL)).alias("cluster")
    return wide.withColumn("distribution", kind).select("capture_id", "distribution", *SERVER_PANEL, cluster)


def host_panel(host: DataFrame) -> DataFrame:
    """Host facts with architecture and memory in use."""
    return host.withColumn("arch", S.known_arch(F.col("kernel"))).withColumn("mem_used_share", 1 - share(F.col("mem_available"), F.col("mem_total")))


def guess_os(lines: DataFrame) -> DataFrame:
    """First line that names a distribution."""
    return lines.filter(S.names_distro(F.col("line"))).groupBy("capture_id").agg(F.min_by("line", "line_no").alias("os"))
