"""All thirty rules from capture files: generated status, variable, engine and thread files go through readers, state and facts.

Users in 97 groups are captures; a group's sum of event ids, h, gives every value of its files. Status has a first and an
eleventh sample, so ten seconds are observed. The thresholds in the SQL are written by hand, not taken from the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.catalog import query
from capturelake.sources import files as S

#: Status name -> what its step (a counter) or its value (a gauge) is scaled by.
COUNTERS = {
    "Binlog_cache_disk_use": 0.2, "Binlog_stmt_cache_disk_use": 0.2, "Innodb_buffer_pool_reads": 1, "Innodb_buffer_pool_read_requests": 300, "Innodb_buffer_pool_pages_LRU_flushed": 1, "Innodb_buffer_pool_wait_free": 1, "Questions": 5, "Aborted_connects": 0.2,
    "Select_scan": 2, "Select_full_join": 0.2, "Handler_read_rnd_next": 30000, "Com_select": 3, "Deprecated_use_i_s_processlist_count": 20, "Innodb_log_waits": 0.2, "Table_open_cache_overflows": 1, "Table_open_cache_hits": 30, "Table_open_cache_misses": 1,
    "Threads_created": 1, "Connections": 3, "Created_tmp_disk_tables": 1, "Created_tmp_tables": 3,
}
GAUGES = {"Threads_connected": 3, "Threads_running": 1.5, "Uptime": 100, "Innodb_buffer_pool_pages_free": 60, "Innodb_buffer_pool_pages_dirty": 2, "Innodb_buffer_pool_pages_total": 5, "Innodb_checkpoint_age": 1, "Innodb_checkpoint_max_age": 2, "Innodb_os_log_pending_writes": 0.04, "Innodb_os_log_pending_fsyncs": 0.04, "Open_tables": 10}
VARIABLES = {"innodb_buffer_pool_size": 30_000_000, "max_connections": 150, "innodb_lru_scan_depth": 20, "innodb_buffer_pool_instances": 0.08, "innodb_max_dirty_pages_pct": 0.9, "sync_binlog": 0.04, "server_id": 0.05, "table_open_cache": 12}
SWITCHES = ["slow_query_log", "log_bin", "gtid_mode"]
ENGINE = {"waiters": 7, "reads": 0.03, "single": 0.02, "fsync": 0.02}
#: Values that a fifth of the captures have, for branches that the scales do not reach: which fifth, and the value.
INSTEAD = {"innodb_buffer_pool_size": (0, 9_000_000_000), "Aborted_connects": (0, 1), "Handler_read_rnd_next": (1, 40), "Deprecated_use_i_s_processlist_count": (2, 5), "Threads_running": (3, 7000), "Com_select": (4, 3)}
NAMES = [*COUNTERS, *GAUGES, *VARIABLES, *SWITCHES, *ENGINE, "age"]


def _x(name: str, salt: int = 0) -> str:
    """A number from 0 to 99 for a capture and a name, in Spark and in DuckDB."""
    i = NAMES.index(name) + 40 * salt
    return f"((CAST(floor(h / {1 + i % 7}) AS BIGINT) * 37 + h * {i + 3} + {i * i + 11 * salt}) % 100)"


def _scaled(name: str, scale: float, salt: int = 0) -> str:
    x = _x(name, salt)
    fifth, value = INSTEAD.get(name, (None, None))
    if fifth is not None:
        return f"CASE WHEN h % 5 = {fifth} THEN CAST({value} AS BIGINT) ELSE CAST(floor(CASE WHEN {x} < 20 THEN 0 ELSE {x} * {scale} END) AS BIGINT) END"
    return f"CAST(floor(CASE WHEN {x} < 20 THEN 0 ELSE {x} * {scale} END) AS BIGINT)"


def _switch(name: str) -> str:
    x = _x(name)
    return f"CASE WHEN {x} < 40 THEN 'ON' WHEN {x} < 90 THEN 'OFF' END"


def _first(name: str) -> str:
    return _scaled(name, GAUGES[name], 1) if name in GAUGES else "CAST(1000 AS BIGINT)"


def _last(name: str) -> str:
    return _scaled(name, GAUGES[name], 2) if name in GAUGES else f"1000 + {_scaled(name, COUNTERS[name])}"


STATE = f"CASE WHEN {_x('age')} % 2 = 0 THEN 'Waiting for table metadata lock' ELSE 'executing' END"

#: What the files say, by hand: r_ a counter's rate, t_ its total, m_ a gauge's peak, l_ its last value, v_ a variable.
R_SQL = "WITH u AS (SELECT 'g' || (user_id % 97) AS capture_id, CAST(sum(event_id) AS BIGINT) % 99991 AS h FROM events GROUP BY ALL), f AS (SELECT capture_id, h, " + ", ".join(
    [f"{_scaled(n, s)} AS t_{n}, {_scaled(n, s)} / 10.0 AS r_{n}" for n, s in COUNTERS.items()] + [f"greatest({_first(n)}, {_last(n)}) AS m_{n}, {_last(n)} AS l_{n}" for n in GAUGES] + [f"CASE WHEN {_x(n)} < 93 THEN {_scaled(n, s)} END AS v_{n}" for n, s in VARIABLES.items()]
    + [f"{_switch(n)} AS v_{n}" for n in SWITCHES] + [f"{_scaled(n, s)} AS e_{n}" for n, s in ENGINE.items()] + [f"{_x('age')} AS age, {STATE} AS state FROM u)"]
) + """,
s AS (
SELECT capture_id, 'binlog.cache_disk_use' AS rule_id, CASE WHEN r_Binlog_cache_disk_use > 1 THEN 'crit' WHEN r_Binlog_cache_disk_use > 0 THEN 'warn' END AS severity FROM f
UNION ALL SELECT capture_id, 'binlog.stmt_cache_disk_use', CASE WHEN r_Binlog_stmt_cache_disk_use > 1 THEN 'crit' WHEN r_Binlog_stmt_cache_disk_use > 0 THEN 'warn' END FROM f
UNION ALL SELECT capture_id, 'bp.undersized', CASE WHEN v_innodb_buffer_pool_size < 268435456 THEN 'crit' WHEN v_innodb_buffer_pool_size < 1073741824 THEN 'warn' WHEN v_innodb_buffer_pool_size >= 1073741824 THEN 'ok' END FROM f WHERE m_Threads_connected >= 50 AND l_Uptime >= 3600
UNION ALL SELECT capture_id, 'bp.hit_ratio', CASE WHEN 1 - t_Innodb_buffer_pool_reads / t_Innodb_buffer_pool_read_requests < 0.99 THEN 'crit' WHEN 1 - t_Innodb_buffer_pool_reads / t_Innodb_buffer_pool_read_requests < 0.999 THEN 'warn' ELSE 'ok' END FROM f WHERE t_Innodb_buffer_pool_read_requests > 0
UNION ALL SELECT capture_id, 'bp.free_pages_low', CASE WHEN l_Innodb_buffer_pool_pages_free > v_innodb_lru_scan_depth * v_innodb_buffer_pool_instances THEN 'ok' WHEN r_Innodb_buffer_pool_pages_LRU_flushed > 0 THEN 'crit' ELSE 'warn' END FROM f WHERE r_Innodb_buffer_pool_reads > 0 AND v_innodb_lru_scan_depth IS NOT NULL AND v_innodb_buffer_pool_instances IS NOT NULL
UNION ALL SELECT capture_id, 'bp.lru_flushing', CASE WHEN r_Innodb_buffer_pool_pages_LRU_flushed > 0 THEN 'warn' END FROM f
UNION ALL SELECT capture_id, 'bp.wait_free', CASE WHEN r_Innodb_buffer_pool_wait_free > 0 THEN 'crit' END FROM f
UNION ALL SELECT capture_id, 'bp.dirty_pct', CASE WHEN 100.0 * m_Innodb_buffer_pool_pages_dirty / l_Innodb_buffer_pool_pages_total >= v_innodb_max_dirty_pages_pct THEN 'crit' WHEN 100.0 * m_Innodb_buffer_pool_pages_dirty / l_Innodb_buffer_pool_pages_total >= 0.9 * v_innodb_max_dirty_pages_pct THEN 'warn' ELSE 'ok' END FROM f WHERE l_Innodb_buffer_pool_pages_total > 0 AND v_innodb_max_dirty_pages_pct IS NOT NULL
UNION ALL SELECT capture_id, 'config.slow_log_disabled', 'warn' FROM f WHERE v_slow_query_log = 'OFF' AND r_Questions > 0
UNION ALL SELECT capture_id, 'config.max_connections_high', CASE WHEN v_innodb_buffer_pool_size / (v_max_connections / 1000.0) < 268435456 THEN 'crit' WHEN v_innodb_buffer_pool_size / (v_max_connections / 1000.0) < 1073741824 THEN 'warn' ELSE 'ok' END FROM f WHERE v_max_connections > 5000 AND v_innodb_buffer_pool_size IS NOT NULL
UNION ALL SELECT capture_id, 'config.sync_binlog_not_one', CASE WHEN v_log_bin = 'OFF' THEN 'info' WHEN v_sync_binlog = 1 THEN NULL WHEN v_sync_binlog = 0 AND v_server_id > 0 AND v_gtid_mode = 'ON' THEN 'crit' WHEN v_sync_binlog >= 0 THEN 'warn' END FROM f
UNION ALL SELECT capture_id, 'connections.saturation', CASE WHEN m_Threads_running >= 100 OR (v_max_connections > 0 AND m_Threads_connected >= 0.9 * v_max_connections) THEN 'crit' WHEN m_Threads_running >= 50 OR (v_max_connections > 0 AND m_Threads_connected >= 0.7 * v_max_connections) THEN 'warn' ELSE 'ok' END FROM f
UNION ALL SELECT capture_id, 'connections.aborted_rate', CASE WHEN r_Aborted_connects > 1 THEN 'crit' WHEN r_Aborted_connects > 0.1 THEN 'warn' WHEN r_Aborted_connects > 0 THEN 'ok' END FROM f
UNION ALL SELECT capture_id, 'innodb.flushing', CASE WHEN e_single > 0 OR e_fsync > 0 THEN 'crit' WHEN e_reads > 0 THEN 'warn' END FROM f
UNION ALL SELECT capture_id, 'innodb.semaphores', CASE WHEN e_waiters >= 500 THEN 'crit' WHEN e_waiters >= 1 THEN 'warn' END FROM f
UNION ALL SELECT capture_id, 'queryshape.select_scan', CASE WHEN r_Select_scan > 10 THEN 'crit' WHEN r_Select_scan > 0 THEN 'warn' END FROM f
UNION ALL SELECT capture_id, 'queryshape.select_full_join', CASE WHEN r_Select_full_join > 1 THEN 'crit' WHEN r_Select_full_join > 0 THEN 'warn' END FROM f
UNION ALL SELECT capture_id, 'queryshape.handler_read_rnd_next', CASE WHEN r_Com_select >= 1 AND r_Handler_read_rnd_next / r_Com_select > 1000 THEN 'crit' WHEN r_Com_select >= 1 AND r_Handler_read_rnd_next / r_Com_select > 100 THEN 'warn' WHEN r_Com_select >= 1 THEN 'ok' WHEN r_Handler_read_rnd_next > 100000 THEN 'crit' WHEN r_Handler_read_rnd_next > 10000 THEN 'warn' ELSE 'ok' END FROM f WHERE r_Handler_read_rnd_next > 0
UNION ALL SELECT capture_id, 'queryshape.is_processlist', CASE WHEN r_Deprecated_use_i_s_processlist_count > 100 THEN 'crit' WHEN r_Deprecated_use_i_s_processlist_count > 1 THEN 'warn' WHEN r_Deprecated_use_i_s_processlist_count > 0 THEN 'info' END FROM f
UNION ALL SELECT capture_id, 'queryshape.observed_slow_processlist', CASE WHEN state LIKE '%metadata lock%' THEN 'crit' ELSE 'warn' END FROM f WHERE age >= 60
UNION ALL SELECT capture_id, 'redo.checkpoint_age', CASE WHEN m_Innodb_checkpoint_age >= 0.8 * l_Innodb_checkpoint_max_age THEN 'crit' WHEN m_Innodb_checkpoint_age >= 0.5 * l_Innodb_checkpoint_max_age THEN 'warn' ELSE 'ok' END FROM f WHERE l_Innodb_checkpoint_max_age > 0
UNION ALL SELECT capture_id, 'redo.pending_writes', CASE WHEN m_Innodb_os_log_pending_writes > 0 THEN 'crit' END FROM f
UNION ALL SELECT capture_id, 'redo.pending_fsyncs', CASE WHEN m_Innodb_os_log_pending_fsyncs > 0 THEN 'crit' END FROM f
UNION ALL SELECT capture_id, 'redo.log_waits', CASE WHEN r_Innodb_log_waits > 1 THEN 'crit' WHEN r_Innodb_log_waits > 0 THEN 'warn' END FROM f
UNION ALL SELECT capture_id, 'tablecache.usage', CASE WHEN l_Open_tables >= 0.95 * v_table_open_cache THEN 'crit' WHEN l_Open_tables >= 0.8 * v_table_open_cache THEN 'warn' ELSE 'ok' END FROM f WHERE v_table_open_cache > 0
UNION ALL SELECT capture_id, 'tablecache.overflows', CASE WHEN r_Table_open_cache_overflows > 5 THEN 'crit' WHEN r_Table_open_cache_overflows > 0 THEN 'warn' END FROM f
UNION ALL SELECT capture_id, 'tablecache.miss_ratio', CASE WHEN t_Table_open_cache_misses > 0.1 * (t_Table_open_cache_hits + t_Table_open_cache_misses) THEN 'crit' WHEN t_Table_open_cache_misses > 0.01 * (t_Table_open_cache_hits + t_Table_open_cache_misses) THEN 'warn' ELSE 'ok' END FROM f WHERE t_Table_open_cache_hits + t_Table_open_cache_misses > 0
UNION ALL SELECT capture_id, 'threadcache.hit_ratio', CASE WHEN t_Threads_created > 0.3 * t_Connections THEN 'crit' WHEN t_Threads_created > 0.1 * t_Connections THEN 'warn' ELSE 'ok' END FROM f WHERE t_Connections > 0
UNION ALL SELECT capture_id, 'thread.max_queue_depth', CASE WHEN m_Threads_running >= (CASE WHEN v_max_connections > 0 THEN 0.9 * v_max_connections ELSE 200 END) THEN 'crit' WHEN m_Threads_running >= (CASE WHEN v_max_connections > 0 THEN 0.5 * v_max_connections ELSE 50 END) THEN 'warn' ELSE 'ok' END FROM f WHERE m_Threads_running > 0
UNION ALL SELECT capture_id, 'tmp.disk_ratio', CASE WHEN 2 * t_Created_tmp_disk_tables > t_Created_tmp_tables THEN 'crit' WHEN 4 * t_Created_tmp_disk_tables > t_Created_tmp_tables THEN 'warn' ELSE 'ok' END FROM f WHERE t_Created_tmp_tables > 0)
SELECT * FROM s WHERE severity IS NOT NULL"""


def _files(captures: DataFrame) -> DataFrame:
    """capture, prefix, suffix, ord, line of the four files of each capture."""
    status = lambda v: F.concat_ws("\n", F.lit("+----+----+\n| Variable_name | Value |"), *[F.format_string(f"| {n} | %d |", F.expr(v(n))) for n in (*COUNTERS, *GAUGES)])
    between = F.lit("\n".join(["| Variable_name | Value |"] * 9))
    variable = [F.when(F.expr(_x(n)) < 93, F.format_string(f"{n}\t%d", F.expr(_scaled(n, s)))) for n, s in VARIABLES.items()] + [F.concat(F.lit(f"{n}\t"), F.expr(_switch(n))) for n in SWITCHES]
    of = lambda n: F.expr(_scaled(n, ENGINE[n])).cast("int")
    engine = F.concat_ws("\n", F.lit("INNODB MONITOR OUTPUT"), F.repeat(F.lit("--Thread 7 has waited at a.cc line 5 for 0.1 seconds the semaphore:\n"), of("waiters")), F.format_string("Pending reads %d\nPending writes: LRU 0, flush list 0, single page %d\nPending flushes (fsync) log: %d; buffer pool: 0", of("reads"), of("single"), of("fsync")))
    thread = F.format_string("TS 1776790303.0 2026-04-21\n*** 1. row ***\n   User: a\nCommand: Query\n  State: %s\n   Info: ALTER TABLE t\nTime_ms: %d", F.expr(STATE), F.expr(f"{_x('age')} * 1000"))
    texts = [("mysqladmin", 0, status(_first)), ("mysqladmin", 1, between), ("mysqladmin", 2, status(_last)), ("variables", 0, F.concat_ws("\n", F.lit("Variable_name\tValue"), *variable)), ("innodbstatus1", 0, engine), ("processlist", 0, thread)]
    rows = captures.select("capture", "h", F.explode(F.array(*[F.struct(F.lit(s).alias("suffix"), F.lit(o).alias("ord"), t.alias("line")) for s, o, t in texts])).alias("x"))
    return rows.select("capture", F.lit("2026_04_21_16_51_41").alias("prefix"), "x.suffix", "x.ord", "x.line")


@query(R_SQL)
def rules_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all thirty rules for captures whose files are written, read, and rated."""
    from capturelake.plans import fleet

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    captures = events.groupBy(F.concat(F.lit("g"), F.col("user_id") % 97).alias("capture")).agg((F.sum("event_id") % 99991).alias("h"))
    root = S.shared_folder(spark)
    S.land(_files(captures), root)
    return fleet.findings(spark, root).select("capture_id", "rule_id", "severity")
