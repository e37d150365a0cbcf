"""The advisory rules as data: severity is a SQL expression over a capture's facts, null where the rule does not apply.

Facts: r_* is a counter's rate a second, t_* its total, m_* a gauge's peak, l_* its last value, v_* a variable as a number,
s_* a variable as text. A rule is extended by adding a row to RULES."""

from __future__ import annotations

from dataclasses import dataclass, field

MIB, GIB = 1 << 20, 1 << 30


@dataclass(frozen=True)
class Rule:
    id: str
    subsystem: str
    title: str
    formula: str
    severity: str
    metrics: tuple[str, ...]
    advice: tuple[str, ...]
    topic: str = field(default="")


def above(x: str, crit: str, warn: str, rest: str = "NULL") -> str:
    return f"CASE WHEN {x} > {crit} THEN 'crit' WHEN {x} > {warn} THEN 'warn' ELSE {rest} END"


def known(*names: str) -> str:
    return " AND ".join(f"{n} IS NOT NULL" for n in names)


_HIT = "(1 - t_Innodb_buffer_pool_reads / nullif(t_Innodb_buffer_pool_read_requests, 0))"
_DIRTY = "(m_Innodb_buffer_pool_pages_dirty * 100.0 / nullif(l_Innodb_buffer_pool_pages_total, 0))"
_CONNECTED = "(m_Threads_connected * 1.0 / nullif(v_max_connections, 0))"
_PER_SELECT = "(r_Handler_read_rnd_next / nullif(r_Com_select, 0))"
_MISSES = "(t_Table_open_cache_misses * 1.0 / nullif(t_Table_open_cache_hits + t_Table_open_cache_misses, 0))"
_USE = "(l_Open_tables * 1.0 / nullif(v_table_open_cache, 0))"
_THREADS = "(1 - t_Threads_created * 1.0 / nullif(t_Connections, 0))"
_DISK = "(t_Created_tmp_disk_tables * 1.0 / nullif(t_Created_tmp_tables, 0))"
_AGE = "(m_Innodb_checkpoint_age * 1.0 / nullif(l_Innodb_checkpoint_max_age, 0))"
_POOL_PER_1000 = "(v_innodb_buffer_pool_size / nullif(v_max_connections / 1000.0, 0))"

RULES: list[Rule] = [
    Rule("binlog.cache_disk_use", "Binlog Cache", "Transactions spill from the binary log cache", "Binlog_cache_disk_use/s > 0", above("r_Binlog_cache_disk_use", "1", "0"), ("r_Binlog_cache_disk_use", "v_binlog_cache_size"), ("Confirm the size of large transactions.", "Increase binlog_cache_size in steps.", "Check memory for all sessions first."), "Binary Log Caches"),
    Rule("binlog.stmt_cache_disk_use", "Binlog Cache", "Statements spill from the binary log statement cache", "Binlog_stmt_cache_disk_use/s > 0", above("r_Binlog_stmt_cache_disk_use", "1", "0"), ("r_Binlog_stmt_cache_disk_use", "v_binlog_stmt_cache_size"), ("Confirm which tables are not transactional.", "Increase binlog_stmt_cache_size."), "Binary Log Caches"),
    Rule("bp.undersized", "Buffer Pool", "Buffer pool small for a busy server", "innodb_buffer_pool_size < 1 GiB", f"CASE WHEN m_Threads_connected >= 50 AND l_Uptime >= 3600 THEN CASE WHEN v_innodb_buffer_pool_size < {256 * MIB} THEN 'crit' WHEN v_innodb_buffer_pool_size < {GIB} THEN 'warn' WHEN v_innodb_buffer_pool_size IS NOT NULL THEN 'ok' END END", ("v_innodb_buffer_pool_size", "m_Threads_connected"), ("Confirm the memory the host has left.", "Increase innodb_buffer_pool_size."), "Buffer Pool"),
    Rule("bp.hit_ratio", "Buffer Pool", "Buffer pool hit ratio", "1 - reads / read_requests", f"CASE WHEN t_Innodb_buffer_pool_read_requests > 0 AND t_Innodb_buffer_pool_reads IS NOT NULL THEN CASE WHEN {_HIT} < 0.990 THEN 'crit' WHEN {_HIT} < 0.999 THEN 'warn' ELSE 'ok' END END", ("t_Innodb_buffer_pool_reads", "t_Innodb_buffer_pool_read_requests"), ("Confirm that the pool is warm.", "Increase innodb_buffer_pool_size.", "Review the statements that read most rows."), "Buffer Pool"),
    Rule("bp.free_pages_low", "Buffer Pool", "Few free buffer pool pages", "free pages <= lru scan depth x instances", f"CASE WHEN {known('l_Innodb_buffer_pool_pages_free', 'v_innodb_lru_scan_depth', 'v_innodb_buffer_pool_instances')} AND r_Innodb_buffer_pool_reads > 0 THEN CASE WHEN l_Innodb_buffer_pool_pages_free > v_innodb_lru_scan_depth * v_innodb_buffer_pool_instances THEN 'ok' WHEN r_Innodb_buffer_pool_pages_LRU_flushed > 0 THEN 'crit' ELSE 'warn' END END", ("l_Innodb_buffer_pool_pages_free", "v_innodb_lru_scan_depth", "v_innodb_buffer_pool_instances", "r_Innodb_buffer_pool_reads"), ("Confirm free page warnings in the error log.", "Increase innodb_buffer_pool_size.", "Raise innodb_lru_scan_depth where CPU allows."), "Buffer Pool"),
    Rule("bp.lru_flushing", "Buffer Pool", "Flushing from the LRU list", "pages_LRU_flushed/s > 0", "CASE WHEN r_Innodb_buffer_pool_pages_LRU_flushed > 0 THEN 'warn' END", ("r_Innodb_buffer_pool_pages_LRU_flushed",), ("Correlate with free pages.", "Increase innodb_buffer_pool_size."), "Buffer Pool"),
    Rule("bp.wait_free", "Buffer Pool", "Queries wait for free pages", "wait_free/s > 0", "CASE WHEN r_Innodb_buffer_pool_wait_free > 0 THEN 'crit' END", ("r_Innodb_buffer_pool_wait_free",), ("Check page cleaner activity.", "Increase innodb_buffer_pool_size."), "Buffer Pool"),
    Rule("bp.dirty_pct", "Buffer Pool", "Share of dirty pages", "dirty / total pct", f"CASE WHEN {_DIRTY} >= v_innodb_max_dirty_pages_pct THEN 'crit' WHEN {_DIRTY} >= 0.9 * v_innodb_max_dirty_pages_pct THEN 'warn' WHEN {_DIRTY} IS NOT NULL AND v_innodb_max_dirty_pages_pct IS NOT NULL THEN 'ok' END", ("m_Innodb_buffer_pool_pages_dirty", "l_Innodb_buffer_pool_pages_total", "v_innodb_max_dirty_pages_pct"), ("Check the rate of writes.", "Raise innodb_io_capacity to what the disk does."), "Flushing and Dirty Pages"),
    Rule("config.slow_log_disabled", "Configuration", "Slow query log is off", "slow_query_log not ON and Questions/s > 0", "CASE WHEN s_slow_query_log IS NOT NULL AND upper(s_slow_query_log) NOT IN ('ON', '1') AND r_Questions > 0 THEN 'warn' END", ("r_Questions",), ("Confirm that no other query log is in use.", "Enable slow_query_log."), "Query Shape"),
    Rule("config.max_connections_high", "Configuration", "Memory for each thousand connections", "buffer pool size per thousand connections", f"CASE WHEN v_max_connections > 5000 THEN CASE WHEN {_POOL_PER_1000} < {256 * MIB} THEN 'crit' WHEN {_POOL_PER_1000} < {GIB} THEN 'warn' WHEN {_POOL_PER_1000} IS NOT NULL THEN 'ok' END END", ("v_max_connections", "v_innodb_buffer_pool_size"), ("Confirm the connections that are needed.", "Lower max_connections and pool them."), "Connections"),
    Rule("config.sync_binlog_not_one", "Configuration", "Binary log is not synced at commit", "sync_binlog <> 1", "CASE WHEN upper(s_log_bin) IN ('OFF', '0') THEN 'info' WHEN v_sync_binlog IS NULL OR v_sync_binlog = 1 THEN NULL WHEN v_sync_binlog = 0 AND coalesce(v_server_id, 0) <> 0 AND coalesce(upper(s_gtid_mode), '') NOT IN ('', 'OFF') THEN 'crit' ELSE 'warn' END", ("v_sync_binlog", "v_server_id"), ("Confirm what a crash may lose.", "Set sync_binlog to 1."), "Binary Log Caches"),
    Rule("connections.saturation", "Connections", "Connections near the limit", "max connected / max_connections", f"CASE WHEN {_CONNECTED} >= 0.9 OR m_Threads_running >= 100 THEN 'crit' WHEN {_CONNECTED} >= 0.7 OR m_Threads_running >= 50 THEN 'warn' WHEN {_CONNECTED} IS NOT NULL OR m_Threads_running IS NOT NULL THEN 'ok' END", ("m_Threads_connected", "v_max_connections", "m_Threads_running"), ("Check who holds idle connections.", "Raise max_connections only with memory to spare."), "Connections"),
    Rule("connections.aborted_rate", "Connections", "Aborted connects", "Aborted_connects/s", "CASE WHEN r_Aborted_connects > 1 THEN 'crit' WHEN r_Aborted_connects > 0.1 THEN 'warn' WHEN r_Aborted_connects > 0 THEN 'ok' END", ("r_Aborted_connects",), ("Check the error log for the clients.", "Validate credentials and network."), "Connections"),
    Rule("innodb.flushing", "Buffer Pool", "Flushing backlog", "pending InnoDB I/O > 0", "CASE WHEN x_pending_single_page > 0 OR x_pending_fsync_log > 0 THEN 'crit' WHEN x_pending_total > 0 THEN 'warn' END", ("x_pending_total", "x_pending_single_page", "x_pending_fsync_log"), ("Correlate with disk utilisation.", "Raise innodb_io_capacity."), "Flushing and Dirty Pages"),
    Rule("innodb.semaphores", "InnoDB Semaphores", "Threads wait for latches", "peak semaphore waiters", "CASE WHEN x_semaphores >= 500 THEN 'crit' WHEN x_semaphores >= 1 THEN 'warn' END", ("x_semaphores",), ("Inspect the sites with most waits.", "Lower concurrency on the hot structure."), "Semaphores"),
    Rule("queryshape.select_scan", "Query Shape", "Full scans of first tables", "Select_scan/s", above("r_Select_scan", "10", "0"), ("r_Select_scan",), ("Review statements without indexes.", "Add the missing indexes."), "Query Shape"),
    Rule("queryshape.select_full_join", "Query Shape", "Joins without indexes", "Select_full_join/s", above("r_Select_full_join", "1", "0"), ("r_Select_full_join",), ("Review joins without indexes.", "Add indexes on join columns."), "Query Shape"),
    Rule("queryshape.handler_read_rnd_next", "Query Shape", "Rows read by scans", "Handler_read_rnd_next per select", f"CASE WHEN r_Handler_read_rnd_next > 0 THEN CASE WHEN r_Com_select >= 1 THEN CASE WHEN {_PER_SELECT} > 1000 THEN 'crit' WHEN {_PER_SELECT} > 100 THEN 'warn' ELSE 'ok' END WHEN r_Handler_read_rnd_next > 100000 THEN 'crit' WHEN r_Handler_read_rnd_next > 10000 THEN 'warn' ELSE 'ok' END END", ("r_Handler_read_rnd_next", "r_Com_select"), ("Review the statements that scan.", "Add indexes for their filters."), "Query Shape"),
    Rule("queryshape.is_processlist", "Query Shape", "Thread list read from the information schema", "Deprecated_use_i_s_processlist_count/s", "CASE WHEN r_Deprecated_use_i_s_processlist_count > 100 THEN 'crit' WHEN r_Deprecated_use_i_s_processlist_count > 1 THEN 'warn' WHEN r_Deprecated_use_i_s_processlist_count > 0 THEN 'info' END", ("r_Deprecated_use_i_s_processlist_count",), ("Confirm which monitor asks.", "Move it to the performance schema."), "Query Shape"),
    Rule("queryshape.observed_slow_processlist", "Query Shape", "Slow active statement seen", "max observed query age >= 60 s", "CASE WHEN x_slow_age_s >= 60 THEN CASE WHEN contains(lower(x_slow_state), 'metadata lock') THEN 'crit' ELSE 'warn' END END", ("x_slow_age_s", "x_slow_sightings"), ("Correlate the fingerprint with the slow log.", "Inspect blockers before tuning the statement."), "Metadata and DDL Contention"),
    Rule("redo.checkpoint_age", "Redo Log", "Checkpoint age near its limit", "checkpoint_age / checkpoint_max_age", f"CASE WHEN {_AGE} >= 0.8 THEN 'crit' WHEN {_AGE} >= 0.5 THEN 'warn' WHEN {_AGE} IS NOT NULL THEN 'ok' END", ("m_Innodb_checkpoint_age", "l_Innodb_checkpoint_max_age"), ("Check the write rate at the peak.", "Increase the redo log."), "Redo Log"),
    Rule("redo.pending_writes", "Redo Log", "Redo writes pending", "os_log_pending_writes > 0", "CASE WHEN m_Innodb_os_log_pending_writes > 0 THEN 'crit' END", ("m_Innodb_os_log_pending_writes",), ("Check the latency of the log device.", "Move the redo log to a faster device."), "Redo Log"),
    Rule("redo.pending_fsyncs", "Redo Log", "Redo syncs pending", "os_log_pending_fsyncs > 0", "CASE WHEN m_Innodb_os_log_pending_fsyncs > 0 THEN 'crit' END", ("m_Innodb_os_log_pending_fsyncs",), ("Check the latency of syncs.", "Move the redo log to a faster device."), "Redo Log"),
    Rule("redo.log_waits", "Redo Log", "Waits for the log buffer", "Innodb_log_waits/s", above("r_Innodb_log_waits", "1", "0"), ("r_Innodb_log_waits",), ("Confirm large transactions.", "Increase innodb_log_buffer_size."), "Redo Log"),
    Rule("tablecache.usage", "Table Open Cache", "Table cache in use", "Open_tables / table_open_cache usage", f"CASE WHEN {_USE} >= 0.95 THEN 'crit' WHEN {_USE} >= 0.80 THEN 'warn' WHEN {_USE} IS NOT NULL THEN 'ok' END", ("l_Open_tables", "v_table_open_cache"), ("Check overflows and misses.", "Increase table_open_cache."), "Table Open Cache"),
    Rule("tablecache.overflows", "Table Open Cache", "Table cache overflows", "Table_open_cache_overflows/s", above("r_Table_open_cache_overflows", "5", "0"), ("r_Table_open_cache_overflows", "v_table_open_cache_instances"), ("Check the number of tables in use.", "Increase table_open_cache."), "Table Open Cache"),
    Rule("tablecache.miss_ratio", "Table Open Cache", "Table cache misses", "misses / (hits + misses) ratio", f"CASE WHEN t_Table_open_cache_hits + t_Table_open_cache_misses > 0 THEN CASE WHEN {_MISSES} > 0.10 THEN 'crit' WHEN {_MISSES} > 0.01 THEN 'warn' ELSE 'ok' END END", ("t_Table_open_cache_misses", "t_Table_open_cache_hits"), ("Check the number of tables in use.", "Increase table_open_cache."), "Table Open Cache"),
    Rule("threadcache.hit_ratio", "Thread Cache", "Threads made for new connections", "1 - Threads_created / Connections ratio", f"CASE WHEN {_THREADS} < 0.70 THEN 'crit' WHEN {_THREADS} < 0.90 THEN 'warn' WHEN {_THREADS} IS NOT NULL THEN 'ok' END", ("t_Threads_created", "t_Connections", "v_thread_cache_size"), ("Check how often clients connect.", "Increase thread_cache_size."), "Thread Cache"),
    Rule("thread.max_queue_depth", "Connections", "Running threads at the peak", "max Threads_running", "CASE WHEN m_Threads_running > 0 THEN CASE WHEN m_Threads_running >= CASE WHEN v_max_connections > 0 THEN 0.9 * v_max_connections ELSE 200 END THEN 'crit' WHEN m_Threads_running >= CASE WHEN v_max_connections > 0 THEN 0.5 * v_max_connections ELSE 50 END THEN 'warn' ELSE 'ok' END END", ("m_Threads_running", "v_max_connections"), ("Correlate with lock waits and CPU.", "Lower concurrency at the client."), "Connections"),
    Rule("tmp.disk_ratio", "Temp Tables", "Temporary tables on disk", "disk / all temporary tables ratio", f"CASE WHEN {_DISK} > 0.50 THEN 'crit' WHEN {_DISK} > 0.25 THEN 'warn' WHEN {_DISK} IS NOT NULL THEN 'ok' END", ("t_Created_tmp_disk_tables", "t_Created_tmp_tables", "v_tmp_table_size", "v_max_heap_table_size"), ("Review the statements that sort and group.", "Increase tmp_table_size and max_heap_table_size."), "Temporary Tables"),
]

#: J10, fixed values: from, to, relationship; kept where both ends fired.
EDGES: list[tuple[str, str, str]] = [
    ("bp.wait_free", "bp.free_pages_low", "supports"), ("bp.wait_free", "bp.lru_flushing", "same_pressure"), ("bp.free_pages_low", "bp.lru_flushing", "same_pressure"), ("innodb.flushing", "bp.dirty_pct", "supports"),
    ("innodb.flushing", "redo.checkpoint_age", "may_be_caused_by"), ("redo.checkpoint_age", "innodb.flushing", "may_explain"), ("redo.pending_writes", "redo.pending_fsyncs", "same_pressure"), ("tablecache.overflows", "tablecache.miss_ratio", "same_pressure"),
    ("tablecache.overflows", "tablecache.usage", "supports"), ("queryshape.select_full_join", "queryshape.handler_read_rnd_next", "supports"), ("queryshape.select_scan", "queryshape.handler_read_rnd_next", "supports"),
    ("queryshape.observed_slow_processlist", "queryshape.select_full_join", "supports"), ("queryshape.observed_slow_processlist", "queryshape.select_scan", "supports"), ("connections.saturation", "thread.max_queue_depth", "same_pressure"), ("config.max_connections_high", "connections.saturation", "may_explain"),
]

#: T9, fixed values: order of subsystems.
SUBSYSTEMS = ["Buffer Pool", "Redo Log", "InnoDB Semaphores", "Connections", "Thread Cache", "Table Open Cache", "Temp Tables", "Query Shape", "Binlog Cache", "Configuration"]

#: R31, fixed values: topic, subsystem, coverage.
TOPICS: list[tuple[str, str, str]] = [
    ("Adaptive Hash Index", "Buffer Pool", "deferred"), ("Binary Log Caches", "Binlog Cache", "covered"), ("Buffer Pool", "Buffer Pool", "covered"), ("Change Buffer", "Buffer Pool", "deferred"), ("Connections", "Connections", "covered"),
    ("Data Dictionary", "Table Open Cache", "deferred"), ("Flushing and Dirty Pages", "Buffer Pool", "covered"), ("Metadata and DDL Contention", "Query Shape", "partial"), ("Query Shape", "Query Shape", "covered"), ("Redo Log", "Redo Log", "covered"),
    ("Semaphores", "InnoDB Semaphores", "covered"), ("Table Open Cache", "Table Open Cache", "covered"), ("Temporary Tables", "Temp Tables", "covered"), ("Thread Cache", "Thread Cache", "covered"),
]


def fact_names() -> list[str]:
    """All facts that severities and metrics name."""
    import re

    text = " ".join(r.severity + " " + " ".join(r.metrics) for r in RULES)
    return sorted(set(re.findall(r"\b[rtmlvsx]_[A-Za-z_]+\b", text)))
