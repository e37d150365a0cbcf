"""Names, labels, lists and marks that must be as they are for right results. No logic."""

from __future__ import annotations

#: Files that a collection's summary tools leave beside, or instead of, capture files.
SUMMARIES = ["pt-summary.out", "pt-mysql-summary.out"]

#: Status variables that only grow, beyond the name families. All others are gauges.
COUNTERS = """
Aborted_clients Aborted_connects Binlog_cache_disk_use Binlog_cache_use Binlog_stmt_cache_disk_use Binlog_stmt_cache_use Bytes_received Bytes_sent
Connections Created_tmp_disk_tables Created_tmp_files Created_tmp_tables Delayed_errors Delayed_writes Deprecated_use_i_s_processlist_count
Error_log_expired_events Flush_commands Innodb_background_log_sync Innodb_buffer_pool_read_ahead Innodb_buffer_pool_read_ahead_evicted
Innodb_buffer_pool_read_ahead_rnd Innodb_buffer_pool_read_requests Innodb_buffer_pool_reads Innodb_buffer_pool_wait_free
Innodb_buffer_pool_write_requests Innodb_buffered_aio_submitted Innodb_data_fsyncs Innodb_data_read Innodb_data_reads Innodb_data_writes
Innodb_data_written Innodb_dblwr_pages_written Innodb_dblwr_writes Innodb_encryption_n_merge_blocks_decrypted
Innodb_encryption_n_merge_blocks_encrypted Innodb_encryption_n_rowlog_blocks_decrypted Innodb_encryption_n_rowlog_blocks_encrypted Innodb_log_waits
Innodb_log_write_requests Innodb_log_writes Innodb_master_thread_active_loops Innodb_master_thread_idle_loops Innodb_os_log_fsyncs
Innodb_os_log_written Innodb_pages_created Innodb_pages_read Innodb_pages_written Innodb_pages0_read Innodb_redo_log_capacity_resized
Innodb_row_lock_time Innodb_row_lock_waits Innodb_sampled_pages_read Innodb_sampled_pages_skipped Innodb_scan_data_size Innodb_scan_deleted_recs_size
Innodb_scan_pages_contiguous Innodb_scan_pages_disjointed Innodb_scan_pages_total_seek_distance Innodb_secondary_index_triggered_cluster_reads
Innodb_secondary_index_triggered_cluster_reads_avoided Innodb_system_rows_deleted Innodb_system_rows_inserted Innodb_system_rows_read
Innodb_system_rows_updated Innodb_truncated_status_writes Key_read_requests Key_reads Key_write_requests Key_writes Locked_connects
Max_execution_time_exceeded Max_execution_time_set Max_execution_time_set_failed Mysqlx_aborted_clients Mysqlx_bytes_received
Mysqlx_bytes_received_compressed_payload Mysqlx_bytes_received_uncompressed_frame Mysqlx_bytes_sent Mysqlx_bytes_sent_compressed_payload
Mysqlx_bytes_sent_uncompressed_frame Mysqlx_connection_accept_errors Mysqlx_connection_errors Mysqlx_connections_accepted Mysqlx_connections_closed
Mysqlx_connections_rejected Mysqlx_crud_create_view Mysqlx_crud_delete Mysqlx_crud_drop_view Mysqlx_crud_find Mysqlx_crud_insert
Mysqlx_crud_modify_view Mysqlx_crud_update Mysqlx_cursor_close Mysqlx_cursor_fetch Mysqlx_cursor_open Mysqlx_errors_sent
Mysqlx_errors_unknown_message_type Mysqlx_expect_close Mysqlx_expect_open Mysqlx_init_error Mysqlx_messages_sent Mysqlx_notice_global_sent
Mysqlx_notice_other_sent Mysqlx_notice_warning_sent Mysqlx_notified_by_group_replication Mysqlx_prep_deallocate Mysqlx_prep_execute
Mysqlx_prep_prepare Mysqlx_rows_sent Mysqlx_sessions_accepted Mysqlx_sessions_closed Mysqlx_sessions_fatal_error Mysqlx_sessions_killed
Mysqlx_sessions_rejected Mysqlx_ssl_accepts Mysqlx_ssl_finished_accepts Mysqlx_stmt_create_collection Mysqlx_stmt_create_collection_index
Mysqlx_stmt_disable_notices Mysqlx_stmt_drop_collection Mysqlx_stmt_drop_collection_index Mysqlx_stmt_enable_notices Mysqlx_stmt_ensure_collection
Mysqlx_stmt_execute_mysqlx Mysqlx_stmt_execute_sql Mysqlx_stmt_execute_xplugin Mysqlx_stmt_get_collection_options Mysqlx_stmt_kill_client
Mysqlx_stmt_list_clients Mysqlx_stmt_list_notices Mysqlx_stmt_list_objects Mysqlx_stmt_modify_collection_options Mysqlx_stmt_ping Opened_files
Opened_table_definitions Opened_tables Queries Questions Secondary_engine_execution_count Select_full_join Select_full_range_join Select_range
Select_range_check Select_scan Slow_launch_threads Slow_queries Sort_merge_passes Sort_range Sort_rows Sort_scan Ssl_accept_renegotiates Ssl_accepts
Ssl_callback_cache_hits Ssl_client_connects Ssl_connect_renegotiates Ssl_finished_accepts Ssl_finished_connects Ssl_session_cache_hits
Ssl_session_cache_misses Ssl_session_cache_overflows Ssl_session_cache_timeouts Ssl_sessions_reused Table_locks_immediate Table_locks_waited
Table_open_cache_hits Table_open_cache_misses Table_open_cache_overflows Table_open_cache_triggers_hits Table_open_cache_triggers_misses
Table_open_cache_triggers_overflows Tc_log_page_waits Threads_created
""".split()

#: P5: category -> (members, prefixes, prefixes not meant), in the order of display. Case does not count.
CATEGORIES: dict[str, tuple[list[str], list[str], list[str]]] = {
    "buffer-pool": ([], ["innodb_buffer_pool_"], ["innodb_buffer_pool_read", "innodb_buffer_pool_write"]),
    "innodb-reads": ([], ["innodb_buffer_pool_read", "innodb_data_read", "innodb_pages_read", "innodb_rows_read"], []),
    "innodb-writes": (["Innodb_rows_inserted", "Innodb_rows_updated", "Innodb_rows_deleted", "Innodb_dblwr_pages_written", "Innodb_dblwr_writes"], ["innodb_buffer_pool_write", "innodb_data_writ", "innodb_pages_written", "innodb_pages_created"], []),
    "redo-log": ([], ["innodb_os_log_", "innodb_log_", "innodb_redo_log"], []),
    "pending-io": (["Innodb_buffer_pool_pages_flushed", "Innodb_buffer_pool_wait_free"], ["innodb_data_pending_", "innodb_os_log_pending_"], []),
    "innodb-locks": ([], ["innodb_row_lock_"], []),
    "throughput": (["Questions", "Queries", "Slow_queries", "Com_stmt_execute", "Com_admin_commands"], [], []),
    "com-dml": (["Com_select", "Com_insert", "Com_insert_select", "Com_update", "Com_update_multi", "Com_delete", "Com_delete_multi", "Com_replace", "Com_replace_select", "Com_truncate", "Com_call_procedure"], [], []),
    "com-tx": (["Com_begin", "Com_commit", "Com_rollback", "Com_savepoint", "Com_release_savepoint", "Com_rollback_to_savepoint", "Com_xa_start", "Com_xa_end", "Com_xa_prepare", "Com_xa_commit", "Com_xa_rollback", "Com_xa_recover"], [], []),
    "com-ddl": ([], ["com_create_", "com_drop_", "com_alter_", "com_rename_"], []),
    "com-prep": ([], ["com_stmt_"], []),
    "handlers": ([], ["handler_"], []),
    "table-cache": (["Table_open_cache_hits", "Table_open_cache_misses", "Table_open_cache_overflows", "Opened_tables", "Opened_table_definitions", "Opened_files"], [], []),
    "open-tables": (["Open_files", "Open_streams", "Open_tables", "Open_table_definitions"], [], []),
    "tmp-tables": ([], ["created_tmp_"], []),
    "sort": ([], ["sort_"], []),
    "select": ([], ["select_"], []),
    "threads": (["Slow_launch_threads"], ["threads_"], []),
    "network": (["Bytes_received", "Bytes_sent", "Connections", "Max_used_connections", "Aborted_clients", "Aborted_connects", "Locked_connects"], ["connection_errors_"], []),
    "binlog": (["Com_show_binlog_events", "Com_show_binlogs"], ["binlog_"], []),
    "replication": ([], ["slave_", "replica_", "rpl_semi_sync_"], []),
    "myisam": ([], ["key_"], []),
    "ssl": ([], ["ssl_", "current_tls_"], []),
    "perfschema": ([], ["performance_schema_"], []),
}

#: Counters shown first, in this order, and how many are shown.
DEFAULT_COUNTERS = ["Com_select", "Com_insert", "Com_update", "Questions", "Bytes_received", "Bytes_sent"]
DEFAULT_SHOWN = 5

#: Section -> label -> canonical network counter.
NET_LABELS: dict[str, dict[str, str]] = {
    "Tcp": {
        "active connection openings": "tcp_active_opens",
        "passive connection openings": "tcp_passive_opens",
        "failed connection attempts": "tcp_failed_conns",
        "connection resets received": "tcp_resets_recv",
        "segments received": "tcp_segs_in",
        "segments sent out": "tcp_segs_out",
        "segments retransmitted": "tcp_retransmits",
        "bad segments received": "tcp_bad_segs",
        "resets sent": "tcp_resets_sent",
    },
    "TcpExt": {
        "TCPListenOverflows": "tcp_listen_overflows",
        "TCPBacklogDrop": "tcp_backlog_drop",
        "SyncookiesSent": "tcp_syncookies_sent",
        "TCPSynRetrans": "tcp_syn_retrans",
    },
    "Udp": {
        "packets received": "udp_pkts_in",
        "packets sent": "udp_pkts_out",
        "packet receive errors": "udp_recv_errors",
        "receive buffer errors": "udp_rcvbuf_errors",
        "send buffer errors": "udp_sndbuf_errors",
    },
}

#: Canonical network counter -> label, in the order of display.
NET_COUNTERS = {
    "tcp_segs_in": "TCP segs in/s",
    "tcp_segs_out": "TCP segs out/s",
    "tcp_retransmits": "TCP retransmits/s",
    "tcp_syn_retrans": "TCP SYN retransmits/s",
    "tcp_resets_recv": "RST received/s",
    "tcp_resets_sent": "RST sent/s",
    "tcp_failed_conns": "Failed connect/s",
    "tcp_bad_segs": "Bad segments/s",
    "tcp_listen_overflows": "Listen overflows/s",
    "tcp_backlog_drop": "Backlog drops/s",
    "tcp_syncookies_sent": "SYN cookies/s",
    "tcp_active_opens": "Active opens/s",
    "tcp_passive_opens": "Passive opens/s",
    "udp_pkts_in": "UDP in/s",
    "udp_pkts_out": "UDP out/s",
    "udp_recv_errors": "UDP recv errors/s",
    "udp_rcvbuf_errors": "UDP rcvbuf errors/s",
    "udp_sndbuf_errors": "UDP sndbuf errors/s",
}

#: Kernel settings that are kept.
SYSCTL = ["kernel.osrelease", "kernel.version", "crypto.fips_name", "vm.swappiness", "vm.dirty_ratio", "vm.dirty_background_ratio", "fs.file-max"]

#: P10: architectures that may end a kernel release.
ARCHES = ["x86_64", "amd64", "aarch64", "arm64", "armv7l", "armv7hl", "armv6l", "i686", "i386", "ppc64le", "ppc64", "s390x", "riscv64"]

#: Names of distributions, case counts.
DISTROS = ["Red Hat Enterprise Linux", "Rocky Linux", "Oracle Linux", "CentOS", "Ubuntu", "Debian", "Amazon Linux", "SUSE", "AlmaLinux"]

#: Marks in the first 8 KiB of a supported file. Of the lists of a collector, all marks of one must occur; a mark that
#: begins with ^ must begin a line.
MARKS: dict[str, list[list[str]]] = {
    "iostat": [["Device"]],
    "top": [["PID", "COMMAND"]],
    "variables": [["Variable_name"]],
    "vmstat": [["procs", "memory"]],
    "meminfo": [["MemTotal:", "TS "]],
    "innodbstatus1": [["INNODB MONITOR OUTPUT"], ["Status:"]],
    "mysqladmin": [["Variable_name", "+-"]],
    "processlist": [["Command", "State"]],
    "netstat": [["Active Internet"], ["Proto "], ["^tcp "], ["Netid "], ["^Netid"], ["^State "]],
    "netstat_s": [["Tcp:"], ["TcpExt:"]],
}

#: Group of each host metric.
HOST_GROUPS = {"runqueue": "procs", "blocked": "procs", "free_kb": "memory", "buff_kb": "memory", "cache_kb": "memory", "swap_in": "memory", "swap_out": "memory", "io_in": "io", "io_out": "io", "cpu_user": "cpu", "cpu_sys": "cpu", "cpu_idle": "cpu", "cpu_iowait": "cpu"}
