"""Summaries on lineitem (a return flag is a capture), orders (a customer group is a capture, an order a snapshot) and events."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capturelake.catalog import query
from capturelake.functions import scalar as S
from capturelake.operators import environment as E
from capturelake.operators import sizing as Z
from capturelake.operators import summaries as M
from capturelake.queries.deltas import R_SQL, S_SQL, samples


@query("""SELECT user_id AS capture_id, epoch_us(ts) // 86400000000 AS day, event_type AS state, count(*) AS n, bool_or(event_id % 3 = 0) AS recvq_nonzero, bool_or(event_id % 5 = 0) AS sendq_nonzero FROM events GROUP BY ALL""")
def socket_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).select("capture_id", F.expr("seconds div 86400").alias("day"), F.col("name").alias("state"), (F.col("seq") % 3 == 0).alias("recvq_nonzero"), (F.col("seq") % 5 == 0).alias("sendq_nonzero"))
    return M.socket_states(rows, ["capture_id", "day"])


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.groupBy((F.col("l_suppkey") % 20).alias("capture_id"), (F.col("l_orderkey") % 9).alias("snapshot"), F.concat(F.lit("f"), (F.col("l_partkey") % 5).cast("string")).alias("file"), F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("mutex")).agg(F.count("*").alias("wait_count"))


L_SQL = """WITH s AS (SELECT l_suppkey % 20 AS capture_id, l_orderkey % 9 AS snapshot, 'f' || CAST(l_partkey % 5 AS VARCHAR) AS file, l_linenumber AS line, l_linestatus AS mutex, count(*) AS wait_count FROM lineitem GROUP BY ALL),
w AS (SELECT capture_id, snapshot, sum(wait_count) AS waits FROM s GROUP BY ALL), p AS (SELECT capture_id, arg_min(snapshot, (-waits, snapshot)) AS snapshot FROM w GROUP BY ALL)"""


@query(f"{L_SQL} SELECT s.capture_id, s.snapshot, file, line, mutex, wait_count, round(wait_count * 100.0 / CAST(sum(wait_count) OVER (PARTITION BY s.capture_id) AS DOUBLE), 6) AS pct FROM s JOIN p ON s.capture_id = p.capture_id AND s.snapshot = p.snapshot")
def latch_breakdown_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.latch_breakdown(_sites(spark, sf_dir), "capture_id", "snapshot")[0].withColumn("pct", F.round("pct", 6))


T_SQL = f"{L_SQL}, t AS (SELECT capture_id, file, line, mutex, CAST(sum(wait_count) AS BIGINT) AS wait_count FROM s GROUP BY ALL)"


@query(f"{T_SQL} SELECT *, round(wait_count * 100.0 / CAST(sum(wait_count) OVER (PARTITION BY capture_id) AS DOUBLE), 6) AS pct FROM t")
def latch_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.latch_breakdown(_sites(spark, sf_dir), "capture_id", "snapshot")[1].withColumn("pct", F.round("pct", 6))


@query(f"{T_SQL} SELECT capture_id, file, line, mutex, wait_count, row_number() OVER (PARTITION BY capture_id ORDER BY wait_count DESC, file, line, mutex) AS place FROM t")
def order_latch_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = M.latch_breakdown(_sites(spark, sf_dir), "capture_id", "snapshot")[1].drop("pct")
    return M.order_latch_sites(total, "capture_id").withColumn("place", F.col("place").cast("bigint"))


@query("""WITH d AS (SELECT l_orderkey % 500 AS capture_id, l_suppkey AS device, l_quantity AS u, l_tax - 0.04 AS q FROM lineitem)
SELECT capture_id, greatest(max(u), 0) AS peak_util, CASE WHEN max(u) > 0 THEN arg_max(device, (u, -device)) END AS util_device, round(greatest(max(q), 0), 6) AS peak_queue, CASE WHEN max(q) > 0 THEN arg_max(device, (q, -device)) END AS queue_device FROM d GROUP BY ALL""")
def device_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = items.select((F.col("l_orderkey") % 500).alias("capture_id"), F.col("l_suppkey").alias("device"), F.col("l_quantity").alias("util_percent"), (F.col("l_tax") - 0.04).alias("avgqu_sz"))
    return M.device_peaks(rows, "capture_id").withColumn("peak_queue", F.round("peak_queue", 6))


@query("SELECT l_suppkey AS capture_id, max(l_quantity) AS peak_runqueue, max(l_discount) AS peak_blocked, max(l_tax) AS peak_cpu_iowait, count(*) AS samples FROM lineitem GROUP BY ALL")
def host_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("capture_id"), F.col("l_quantity").alias("runqueue"), F.col("l_discount").alias("blocked"), F.col("l_tax").alias("cpu_iowait"))
    return M.peaks(items, "capture_id", ["runqueue", "blocked", "cpu_iowait"])


@query("SELECT l_suppkey AS capture_id, min(l_extendedprice) AS min_available, max(l_quantity) AS max_anon, max(l_tax) AS max_dirty, max(l_discount) AS max_swap FROM lineitem GROUP BY ALL")
def memory_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("capture_id"), F.col("l_extendedprice").alias("mem_available"), F.col("l_quantity").alias("anon_pages"), F.col("l_tax").alias("dirty"), F.col("l_discount").alias("swap_used"))
    return M.memory_extremes(items, "capture_id")


NETWORK = {"click": "tcp_retransmits", "view": "tcp_listen_overflows"}
SOCKETS = {"click": "TIME_WAIT", "error": "CLOSE_WAIT"}


@query(f"""WITH {S_SQL}, r AS (SELECT *, lag(raw) OVER w AS r0, lag(seconds) OVER w AS s0 FROM s WINDOW w AS (PARTITION BY capture_id, name, snapshot ORDER BY ts, seq)),
n AS (SELECT capture_id, name, CASE WHEN raw >= r0 AND seconds > s0 THEN (raw - r0) / (seconds - s0) END AS rate FROM r),
a AS (SELECT capture_id, nullif(max(rate) FILTER (WHERE name = 'click'), 0) AS x, nullif(max(rate) FILTER (WHERE name = 'view'), 0) AS y FROM n GROUP BY ALL),
dd AS (SELECT capture_id, name, seconds // 86400 AS day, count(*) AS n FROM s GROUP BY ALL),
b AS (SELECT capture_id, nullif(max(n) FILTER (WHERE name = 'click'), 0) AS t, nullif(max(n) FILTER (WHERE name = 'error'), 0) AS c FROM dd GROUP BY ALL)
SELECT a.capture_id, round(x, 6) AS peak_tcp_retransmits, round(y, 6) AS peak_tcp_listen_overflows, t AS "peak_TIME_WAIT", c AS "peak_CLOSE_WAIT" FROM a JOIN b ON a.capture_id = b.capture_id""")
def network_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from capturelake.operators import deltas as D

    rows = samples(spark, sf_dir)
    polls = rows.withColumn("poll_idx", F.row_number().over(Window.partitionBy("capture_id", "name", "snapshot").orderBy("ts", "seq")))
    rates = D.net_rate(polls).withColumn("name", S.lookup(F.col("name"), NETWORK))
    sockets = rows.withColumn("state", S.lookup(F.col("name"), SOCKETS)).groupBy("capture_id", F.expr("seconds div 86400").alias("day"), "state").agg(F.count("*").alias("n"))
    out = M.network_peaks(rates, sockets, "capture_id")
    return out.withColumns({c: F.round(c, 6) for c in ("peak_tcp_retransmits", "peak_tcp_listen_overflows")})


#: engine status of an order: remainders of its key, so that zero, small and large values occur.
ENGINE = {"semaphore_count": 601, "pending_reads": 5, "pending_writes": 13, "pending_writes_lru": 7, "pending_writes_flush_list": 3, "pending_writes_single_page": 401, "pending_fsync_log": 503, "pending_fsync_bp": 11, "modified_pages": 997, "hash_table_size": 4, "hash_per_s": 17, "nonhash_per_s": 2, "history_list": 1009}
E_SQL = "WITH e AS (SELECT o_custkey % 700 AS capture_id, o_orderkey AS snapshot, " + ", ".join(f"(o_orderkey * 7 + o_custkey) % {n} AS {k}" for k, n in ENGINE.items()) + " FROM orders)"


def engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select((F.col("o_custkey") % 700).alias("capture_id"), F.col("o_orderkey").alias("snapshot"), *[((F.col("o_orderkey") * 7 + F.col("o_custkey")) % n).alias(k) for k, n in ENGINE.items()])


@query(f"""{E_SQL}, u AS (SELECT capture_id, snapshot, unnest([('semaphore_count', semaphore_count), ('pending_reads', pending_reads), ('history_list', history_list)]) AS x FROM e)
SELECT capture_id, x[1] AS metric, min(x[2]) AS low, round(avg(x[2]), 6) AS mean, max(x[2]) AS high, arg_min(snapshot, (-x[2], snapshot)) AS worst_at, CASE WHEN x[1] = 'semaphore_count' THEN CASE WHEN max(x[2]) >= 500 THEN 'crit' WHEN max(x[2]) > 0 THEN 'warn' ELSE 'ok' END END AS severity FROM u GROUP BY capture_id, x[1]""")
def engine_metric_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.engine_metric_range(engine(spark, sf_dir), "capture_id", "snapshot", ["semaphore_count", "pending_reads", "history_list"]).withColumn("mean", F.round("mean", 6))


@query(f"""{E_SQL}, r AS (SELECT *, CASE WHEN hash_per_s + nonhash_per_s > 0 THEN hash_per_s * 100 / (hash_per_s + nonhash_per_s) END AS ratio FROM e)
SELECT capture_id, round(min(ratio), 6) AS worst, arg_min(snapshot, (ratio, snapshot)) FILTER (WHERE ratio IS NOT NULL) AS worst_at, round(max(ratio), 6) AS best, arg_max(hash_table_size, snapshot) FILTER (WHERE hash_table_size > 0) AS table_size FROM r GROUP BY ALL""")
def hash_index_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.hash_index_ratio(engine(spark, sf_dir), "capture_id", "snapshot").withColumns({c: F.round(c, 6) for c in ("worst", "best")})


@query(f"{E_SQL}, p AS (SELECT capture_id, " + ", ".join(f"max({c}) AS peak_{c}" for c in M.PENDING) + ", arg_min(snapshot, (-pending_writes, snapshot)) AS peak_writes_at FROM e GROUP BY ALL) SELECT *, CASE WHEN peak_pending_writes_single_page > 0 OR peak_pending_fsync_log > 0 THEN 'crit' WHEN " + " + ".join(f"peak_{c}" for c in M.PENDING if c != "modified_pages") + " > 0 THEN 'warn' END AS severity FROM p")
def pending_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.pending_io(engine(spark, sf_dir), "capture_id", "snapshot")


@query(f"{E_SQL} SELECT capture_id, snapshot, history_list FROM e")
def history_list_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.history_list_series(engine(spark, sf_dir), "capture_id", "snapshot")


@query(f"""{R_SQL}, k AS (SELECT user_id AS capture_id, CASE WHEN user_id % 7 > 0 THEN 1000 * (user_id % 7) + 500 END AS capacity FROM events GROUP BY ALL),
ff AS (SELECT f.capture_id, coalesce(full_peak, longest[2]) AS peak, full_peak IS NOT NULL AS full_window FROM f JOIN l ON f.capture_id = l.capture_id AND f.name = l.name WHERE f.name = 'click'),
gg AS (SELECT capture_id, sum(total) / nullif(sum(span), 0) AS mean_rate, sum(total) AS bytes FROM g WHERE name = 'click' GROUP BY ALL),
x AS (SELECT k.capture_id, capacity, peak, full_window, mean_rate, bytes, CASE WHEN peak IS NULL OR mean_rate IS NULL THEN 'rate_unavailable' WHEN capacity IS NULL THEN 'config_missing' WHEN bytes <= 0 THEN 'no_writes' ELSE 'ok' END AS state
FROM k LEFT JOIN ff ON k.capture_id = ff.capture_id LEFT JOIN gg ON k.capture_id = gg.capture_id)
SELECT capture_id, state, CAST(capacity AS DOUBLE) AS capacity, round(mean_rate, 6) AS mean_rate, round(peak, 6) AS peak_rate, full_window, CASE WHEN state = 'ok' THEN round(capacity / nullif(peak, 0) / 60, 6) END AS minutes, round(peak * 900, 4) AS size_15_min, round(peak * 3600, 4) AS size_1_hour, CASE WHEN state = 'ok' THEN capacity / nullif(peak, 0) / 60 < 15 END AS undersized FROM x""")
def redo_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are the bytes written, over windows of half a day; one user in seven has no capacity set."""
    rows = samples(spark, sf_dir)
    n = F.col("capture_id") % 7
    variables = rows.select("capture_id").distinct().withColumn("x", F.explode(F.array(F.struct(F.lit("innodb_log_file_size").alias("name"), (n * 500 + 250).cast("string").alias("value")), F.struct(F.lit("innodb_log_files_in_group").alias("name"), F.when(n > 0, "2").otherwise("").alias("value"))))).select("capture_id", "x.*")
    got = Z.redo_sizing(rows.filter("name = 'click'"), Z.redo_capacity(variables), 43200)
    digits = {"mean_rate": 6, "peak_rate": 6, "minutes": 6, "size_15_min": 4, "size_1_hour": 4}
    return got.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(f"""WITH {S_SQL}, l AS (SELECT capture_id, arg_max(raw, (snapshot, ts, seq)) AS uptime, arg_max(seconds, (snapshot, ts, seq)) AS seconds FROM s WHERE name = 'click' AND capture_id % 3 > 0 GROUP BY ALL),
v AS (SELECT capture_id, max(seconds) AS seconds, capture_id * 10 AS uptime FROM s GROUP BY ALL)
SELECT v.capture_id, coalesce(l.uptime, v.uptime) AS uptime, CASE WHEN l.uptime IS NULL THEN v.seconds - v.uptime ELSE l.seconds - l.uptime END AS started, CASE WHEN l.uptime IS NULL THEN 'variables' ELSE 'status' END AS origin FROM v LEFT JOIN l ON v.capture_id = l.capture_id""")
def uptime_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    variables = rows.groupBy("capture_id").agg(F.max("seconds").alias("snapshot_seconds")).withColumn("value", (F.col("capture_id") * 10).cast("string"))
    return E.uptime_anchor(rows.filter("name = 'click' AND capture_id % 3 > 0"), variables)


@query(f"WITH {S_SQL}, h AS (SELECT capture_id, CASE WHEN capture_id % 2 = 0 THEN min(seconds) END AS a, max(seconds) AS b, min(seconds) + (capture_id % 5 - 1) * 1000 AS btime FROM s GROUP BY capture_id) SELECT capture_id, CASE WHEN coalesce(a, b) > btime THEN coalesce(a, b) - btime END AS os_uptime FROM h")
def os_uptime(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = samples(spark, sf_dir).groupBy("capture_id").agg(F.min("seconds").alias("lo"), F.max("seconds").alias("last_snapshot_seconds"))
    return E.os_uptime(host.withColumn("sidecar_seconds", F.when(F.col("capture_id") % 2 == 0, F.col("lo"))).withColumn("btime", F.col("lo") + (F.col("capture_id") % 5 - 1) * 1000))


A26_SQL = """WITH f AS (SELECT o_orderkey AS capture_id, o_custkey AS total, o_orderkey % 1000 AS free, o_orderkey % 1500 AS dirty, o_orderkey % 900 AS opened, o_custkey % 1000 AS cache FROM orders),
r AS (SELECT capture_id, CASE WHEN total > 0 THEN 1 - least(greatest(free / total, 0.0), 1.0) END AS fill, CASE WHEN total > 0 THEN least(greatest(dirty / total, 0.0), 1.0) END AS dirty, CASE WHEN cache > 0 THEN least(greatest(opened / cache, 0.0), 1.0) END AS use FROM f)"""


def _ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    facts = orders.select(F.col("o_orderkey").alias("capture_id"), F.col("o_custkey").alias("pages_total"), (F.col("o_orderkey") % 1000).alias("pages_free"), (F.col("o_orderkey") % 1500).alias("pages_dirty"), (F.col("o_orderkey") % 900).alias("open_tables"), (F.col("o_custkey") % 1000).alias("table_open_cache"))
    return E.fill_ratios(facts).withColumns({c: F.round(c, 6) for c in ("buffer_fill", "buffer_dirty", "table_cache_use")})


@query(f"{A26_SQL} SELECT capture_id, round(fill, 6) AS buffer_fill FROM r")
def buffer_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ratios(spark, sf_dir).select("capture_id", "buffer_fill")


@query(f"{A26_SQL} SELECT capture_id, round(dirty, 6) AS buffer_dirty, CASE WHEN dirty >= 0.8 THEN 'crit' WHEN dirty >= 0.5 THEN 'warn' WHEN dirty IS NOT NULL THEN 'ok' END AS dirty_severity FROM r")
def buffer_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ratios(spark, sf_dir).select("capture_id", "buffer_dirty", "dirty_severity")


@query(f"{A26_SQL} SELECT capture_id, round(use, 6) AS table_cache_use, CASE WHEN use >= 0.95 THEN 'crit' WHEN use >= 0.8 THEN 'warn' WHEN use IS NOT NULL THEN 'ok' END AS table_cache_severity FROM r")
def table_cache_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ratios(spark, sf_dir).select("capture_id", "table_cache_use", "table_cache_severity")


_PANEL = ["version", "version_comment", "max_connections", "wsrep_on", "wsrep_cluster_size"]


@query("""WITH v AS (SELECT o_custkey AS capture_id, ['version', 'version_comment', 'max_connections', 'wsrep_on', 'wsrep_cluster_size'][o_orderkey % 5 + 1] AS name, CASE o_orderkey % 5 WHEN 3 THEN CASE WHEN o_custkey % 2 = 0 THEN 'ON' ELSE 'OFF' END WHEN 1 THEN o_orderpriority || ' MariaDB' ELSE CAST(o_orderkey AS VARCHAR) END AS value FROM orders),
p AS (SELECT capture_id, max(value) FILTER (WHERE name = 'version') AS version, max(value) FILTER (WHERE name = 'version_comment') AS version_comment, max(value) FILTER (WHERE name = 'max_connections') AS max_connections, max(value) FILTER (WHERE name = 'wsrep_on') AS wsrep_on, max(value) FILTER (WHERE name = 'wsrep_cluster_size') AS size FROM v GROUP BY ALL)
SELECT capture_id, CASE WHEN wsrep_on = 'ON' AND coalesce(CAST(size AS DOUBLE), 0) > 0 THEN 'cluster' WHEN version_comment IS NOT NULL THEN 'mariadb' ELSE 'community' END AS distribution, version, version_comment, max_connections, CASE WHEN wsrep_on = 'ON' THEN size END AS cluster_size FROM p""")
def server_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = F.col("o_orderkey") % 5
    name = F.element_at(F.array(*map(F.lit, _PANEL)), (n + 1).cast("int"))
    value = F.when(n == 3, F.when(F.col("o_custkey") % 2 == 0, "ON").otherwise("OFF")).when(n == 1, F.concat("o_orderpriority", F.lit(" MariaDB"))).otherwise(F.col("o_orderkey").cast("string"))
    return E.server_panel(orders.select(F.col("o_custkey").alias("capture_id"), name.alias("name"), value.alias("value"))).select("capture_id", "distribution", "version", "version_comment", "max_connections", F.col("cluster.wsrep_cluster_size").alias("cluster_size"))


@query("SELECT p_partkey AS capture_id, CASE p_size % 4 WHEN 0 THEN 'x86_64' WHEN 1 THEN 'aarch64' END AS arch, round(1 - least(p_retailprice / 2000, 1), 6) AS mem_used_share FROM part")
def host_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    tail = F.element_at(F.array(*map(F.lit, ["x86_64", "aarch64", "sparc", "generic"])), (F.col("p_size") % 4 + 1).cast("int"))
    host = part.select(F.col("p_partkey").alias("capture_id"), F.concat(F.lit("5.15.0-88.el9."), tail).alias("kernel"), F.col("p_retailprice").alias("mem_available"), F.lit(2000.0).alias("mem_total"))
    return E.host_panel(host).select("capture_id", "arch", F.round("mem_used_share", 6).alias("mem_used_share"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'i686' END AS arch FROM part")
def known_arch(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", S.known_arch(F.concat(F.lit("4.18."), F.when(F.col("p_size") % 3 == 0, "i686").otherwise(F.col("p_brand")))).alias("arch"))


@query("WITH l AS (SELECT o_custkey AS capture_id, o_orderkey AS line_no, CASE WHEN o_orderkey % 3 = 0 THEN 'Ubuntu ' || o_orderpriority ELSE o_orderpriority END AS line FROM orders) SELECT capture_id, arg_min(line, line_no) AS os FROM l WHERE contains(line, 'Ubuntu') GROUP BY ALL")
def guess_os(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    line = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Ubuntu "), "o_orderpriority")).otherwise(F.col("o_orderpriority"))
    return E.guess_os(orders.select(F.col("o_custkey").alias("capture_id"), F.col("o_orderkey").alias("line_no"), line.alias("line")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a file: its customer the capture, its date the snapshot, its key the collector."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    suffix = F.element_at(F.array(*map(F.lit, ["iostat", "top", "vmstat", "meminfo", "netstat", "netstat_s", "variables"])), (F.col("o_orderkey") % 7 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "unsupported").otherwise("ok")
    return orders.select(F.col("o_custkey").alias("capture_id"), F.col("o_orderkey").alias("path"), (F.col("o_orderkey") % 50).alias("snapshot"), suffix.alias("suffix"), status.alias("status"))


F_SQL = "WITH f AS (SELECT o_custkey AS capture_id, o_orderkey AS path, o_orderkey % 50 AS snapshot, ['iostat', 'top', 'vmstat', 'meminfo', 'netstat', 'netstat_s', 'variables'][o_orderkey % 7 + 1] AS suffix, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'unsupported' ELSE 'ok' END AS status FROM orders)"


@query(f"{F_SQL}, h AS (SELECT DISTINCT capture_id, CASE WHEN suffix IN ('netstat', 'netstat_s') THEN 'network' ELSE suffix END AS collector FROM f WHERE status <> 'failed') SELECT c.capture_id, e.collector FROM (SELECT DISTINCT capture_id FROM f) c, (SELECT unnest({M.EXPECTED!r}) AS collector) e WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.capture_id = c.capture_id AND h.collector = e.collector)")
def missing_collectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.missing_collectors(files(spark, sf_dir), "capture_id")


@query(f"{F_SQL} SELECT capture_id, suffix, arg_min(path, (snapshot, path)) AS path FROM f WHERE status = 'unsupported' GROUP BY ALL")
def unsupported_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.unsupported_sources(files(spark, sf_dir), "capture_id")


@query("WITH d AS (SELECT l_orderkey % 300 AS capture_id, 'm' || l_suppkey AS mount, max(l_quantity) AS use_pct FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY use_pct DESC, mount) AS rank FROM d) SELECT capture_id, mount, use_pct, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def top_filesystems(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = items.groupBy((F.col("l_orderkey") % 300).alias("capture_id"), F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("mount")).agg(F.max("l_quantity").alias("use_pct"))
    return M.top_filesystems(rows, "capture_id")


#: Display names by hand, in order.
_NET_SQL = """('tcp_segs_in', 'TCP segs in/s', 1), ('tcp_segs_out', 'TCP segs out/s', 2), ('tcp_retransmits', 'TCP retransmits/s', 3), ('tcp_syn_retrans', 'TCP SYN retransmits/s', 4), ('tcp_resets_recv', 'RST received/s', 5),
('tcp_resets_sent', 'RST sent/s', 6), ('tcp_failed_conns', 'Failed connect/s', 7), ('tcp_bad_segs', 'Bad segments/s', 8), ('tcp_listen_overflows', 'Listen overflows/s', 9), ('tcp_backlog_drop', 'Backlog drops/s', 10),
('tcp_syncookies_sent', 'SYN cookies/s', 11), ('tcp_active_opens', 'Active opens/s', 12), ('tcp_passive_opens', 'Passive opens/s', 13), ('udp_pkts_in', 'UDP in/s', 14), ('udp_pkts_out', 'UDP out/s', 15),
('udp_recv_errors', 'UDP recv errors/s', 16), ('udp_rcvbuf_errors', 'UDP rcvbuf errors/s', 17), ('udp_sndbuf_errors', 'UDP sndbuf errors/s', 18), ('zeta', 'zeta', 99), ('alpha', 'alpha', 99)"""
_NET = re.findall(r"\('([a-z_]+)', '[^']*', \d+\)", _NET_SQL)
_N_SQL = f"WITH l AS (SELECT *, row_number() OVER () - 1 AS i FROM (VALUES {_NET_SQL}) v(name, label, place)), n AS (SELECT o_orderkey, l.* FROM orders JOIN l ON o_orderkey % {len(_NET)} = i)"


def _net_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", F.element_at(F.array(*map(F.lit, _NET)), (F.col("o_orderkey") % len(_NET) + 1).cast("int")).alias("name"))


@query(f"{_N_SQL} SELECT DISTINCT name, CAST(place AS BIGINT) AS place FROM n")
def order_net_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.order_net_counters(_net_names(spark, sf_dir).select("name").distinct())


@query(f"{_N_SQL} SELECT o_orderkey, label FROM n")
def net_display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _net_names(spark, sf_dir).select("o_orderkey", S.net_display_name(F.col("name")).alias("label"))


_TOKENS = [*S.SOCKET_STATES, "weird"]
_STATES = ", ".join(f"('{k}', '{v}')" for k, v in S.SOCKET_STATES.items())


@query(f"WITH n AS (SELECT o_orderkey, ({_TOKENS!r})[o_orderkey % {len(_TOKENS)} + 1] AS token FROM orders) SELECT o_orderkey, l.state FROM n LEFT JOIN (VALUES {_STATES}) l(token, state) ON l.token = n.token")
def socket_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    token = F.lower(F.element_at(F.array(*map(F.lit, _TOKENS)), (F.col("o_orderkey") % len(_TOKENS) + 1).cast("int")))
    return orders.select("o_orderkey", S.socket_state(token).alias("state"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.08 THEN 'crit' WHEN l_discount >= 0.05 THEN 'warn' ELSE 'ok' END AS severity FROM lineitem")
def severity_for_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", S.severity_for_fraction(F.col("l_discount"), 0.05, 0.08).alias("severity"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN round(o_totalprice, 4) END AS value FROM orders")
def variable_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    odd = F.element_at(F.array(*map(F.lit, ["", "NULL", "1G"])), (F.col("o_custkey") % 3 + 1).cast("int"))
    text = F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit(" "), F.round("o_totalprice", 4).cast("string"), F.lit(" "))).otherwise(odd)
    return orders.select("o_orderkey", S.variable_double(text).alias("value"))


@query("SELECT event_id, greatest(round(value, 6), 0) AS value FROM (SELECT event_id, value - 20 AS value FROM events)")
def clamp_non_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", S.clamp_non_negative(F.round(F.col("value") - 20, 6)).alias("value"))
