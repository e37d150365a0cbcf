"""Per-capture summaries: sockets, devices, hosts, memory, network, engine status, history list, pending I/O."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PENDING = ["pending_reads", "pending_writes", "pending_writes_lru", "pending_writes_flush_list", "pending_writes_single_page", "pending_fsync_log", "pending_fsync_bp", "modified_pages"]


def socket_states(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A10: sockets of each poll by state, and whether any queue of that state held bytes."""
    return rows.groupBy(*keys, "state").agg(F.count("*").alias("n"), F.bool_or("recvq_nonzero").alias("recvq_nonzero"), F.bool_or("sendq_nonzero").alias("sendq_nonzero"))


def latch_breakdown(sites: DataFrame, capture: str, snapshot: str) -> tuple[DataFrame, DataFrame]:
    """Sites of the snapshot with most waits (the first of equals), and of all snapshots, with their share in percent."""
    by = Window.partitionBy(capture)
    per_snapshot = sites.groupBy(capture, snapshot).agg(F.sum("wait_count").alias("waits"))
    peak = per_snapshot.groupBy(capture).agg(F.min_by(snapshot, F.struct(-F.col("waits"), snapshot)).alias(snapshot))
    share = lambda df: df.withColumn("pct", F.col("wait_count") * 100 / F.sum("wait_count").over(by))
    at_peak = share(sites.join(peak, [capture, snapshot]).groupBy(capture, snapshot, "file", "line", "mutex").agg(F.sum("wait_count").alias("wait_count")))
    total = share(sites.groupBy(capture, "file", "line", "mutex").agg(F.sum("wait_count").alias("wait_count")))
    return at_peak, total


def order_latch_sites(sites: DataFrame, capture: str) -> DataFrame:
    """Place of a site in its capture."""
    return sites.withColumn("place", F.row_number().over(Window.partitionBy(capture).orderBy(F.desc("wait_count"), "file", "line", "mutex")))


def device_peaks(rows: DataFrame, capture: str) -> DataFrame:
    """Highest utilisation and queue and the device that had it; ties to the first device, floor 0."""
    best = lambda v: F.max(F.struct(F.greatest(F.coalesce(F.col(v), F.lit(0.0)), F.lit(0.0)).alias("v"), (-F.col("rank")).alias("r"), F.col("device").alias("d")))
    ranked = rows.withColumn("rank", F.dense_rank().over(Window.partitionBy(capture).orderBy("device")))
    got = ranked.groupBy(capture).agg(best("util_percent").alias("u"), best("avgqu_sz").alias("q"))
    name = lambda c: F.when(F.col(f"{c}.v") > 0, F.col(f"{c}.d"))
    return got.select(capture, F.col("u.v").alias("peak_util"), name("u").alias("util_device"), F.col("q.v").alias("peak_queue"), name("q").alias("queue_device"))


def peaks(rows: DataFrame, capture: str, columns: list[str]) -> DataFrame:
    """Highest value of each column, and the number of samples."""
    return rows.groupBy(capture).agg(*[F.max(c).alias(f"peak_{c}") for c in columns], F.count("*").alias("samples"))


def memory_extremes(rows: DataFrame, capture: str) -> DataFrame:
    """A14"""
    return rows.groupBy(capture).agg(F.min("mem_available").alias("min_available"), F.max("anon_pages").alias("max_anon"), F.max("dirty").alias("max_dirty"), F.max("swap_used").alias("max_swap"))


def network_peaks(rates: DataFrame, sockets: DataFrame, capture: str) -> DataFrame:
    """Peak rates and socket counts; zero means nothing seen."""
    peak = lambda c, name: F.nullif(F.max(F.when(F.col("name") == name, F.col(c))), F.lit(0)).alias(f"peak_{name}")
    r = rates.groupBy(capture).agg(peak("rate", "tcp_retransmits"), peak("rate", "tcp_listen_overflows"))
    s = sockets.withColumnRenamed("state", "name").groupBy(capture).agg(peak("n", "TIME_WAIT"), peak("n", "CLOSE_WAIT"))
    return r.join(s, capture, "full_outer")


def engine_metric_range(status: DataFrame, capture: str, snapshot: str, metrics: list[str]) -> DataFrame:
    """Smallest, mean and largest value of each metric over snapshots, and the severity of latch waits."""
    long = status.unpivot([capture, snapshot], metrics, "metric", "value").filter("value is not null")
    out = long.groupBy(capture, "metric").agg(F.min("value").alias("low"), (F.sum("value") / F.count("*")).alias("mean"), F.max("value").alias("high"), F.min_by(snapshot, F.struct(-F.col("value"), snapshot)).alias("worst_at"))
    sem = F.when(F.col("high") >= 500, "crit").when(F.col("high") > 0, "warn").otherwise("ok")
    return out.withColumn("severity", F.when(F.col("metric") == "semaphore_count", sem))


def hash_index_ratio(status: DataFrame, capture: str, snapshot: str) -> DataFrame:
    """Share of look-ups that the hash index served; idle snapshots are left out, the worst is the lowest."""
    total = F.col("hash_per_s") + F.col("nonhash_per_s")
    ratio = status.withColumn("ratio", F.when(total > 0, F.col("hash_per_s") * 100 / F.nullif(total, F.lit(0))))
    return ratio.groupBy(capture).agg(F.min("ratio").alias("worst"), F.min_by(snapshot, F.when(F.col("ratio").isNotNull(), F.struct("ratio", snapshot))).alias("worst_at"), F.max("ratio").alias("best"), F.max_by("hash_table_size", F.when(F.col("hash_table_size") > 0, F.col(snapshot))).alias("table_size"))


def pending_io(status: DataFrame, capture: str, snapshot: str) -> DataFrame:
    """Peak of each pending path, the snapshot of most pending writes, and the severity."""
    got = status.groupBy(capture).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(f"peak_{c}") for c in PENDING], F.min_by(snapshot, F.struct(-F.col("pending_writes"), snapshot)).alias("peak_writes_at"))
    stall = (F.col("peak_pending_writes_single_page") > 0) | (F.col("peak_pending_fsync_log") > 0)
    backlog = reduce(lambda a, b: a | b, [F.col(f"peak_{c}") > 0 for c in PENDING if c != "modified_pages"])
    return got.withColumn("severity", F.when(stall, "crit").when(backlog, "warn"))


def history_list_series(status: DataFrame, capture: str, snapshot: str) -> DataFrame:
    """In order of snapshots within a capture; a fleet's captures have no order among them."""
    return status.select(capture, snapshot, "history_list").repartition(capture).sortWithinPartitions(capture, snapshot)


def missing_collectors(files: DataFrame, capture: str) -> DataFrame:
    """Expected collectors without a parsed file in any snapshot; both network collectors count as one."""
    merged = F.when(F.col("suffix").isin("netstat", "netstat_s"), "network").otherwise(F.col("suffix"))
    have = files.filter("status <> 'failed'").select(capture, merged.alias("collector")).distinct()
    want = files.select(capture).distinct().withColumn("collector", F.explode(F.array(*[F.lit(x) for x in EXPECTED])))
    return want.join(have, [capture, "collector"], "left_anti")


EXPECTED = ["iostat", "top", "vmstat", "meminfo", "network", "variables", "innodbstatus1", "mysqladmin", "processlist"]


def unsupported_sources(files: DataFrame, capture: str) -> DataFrame:
    """First unsupported file of each collector, by snapshot and path."""
    return files.filter("status = 'unsupported'").groupBy(capture, "suffix").agg(F.min_by("path", F.struct("snapshot", "path")).alias("path"))


def top_filesystems(rows: DataFrame, capture: str, k: int = 5) -> DataFrame:
    """T5"""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(capture).orderBy(F.desc("use_pct"), "mount"))).filter(F.col("rank") <= k)


def order_net_counters(names: DataFrame, name: str = "name") -> DataFrame:
    """Place of each counter: the known ones in their order, others (99) after them."""
    from capturelake.functions.scalar import net_order

    return names.withColumn("place", net_order(F.col(name)))
