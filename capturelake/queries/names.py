"""Real status names by hand, with what they are, on parts: a brand is a capture, a part draws one of the names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.catalog import query
from capturelake.functions import scalar as S
from capturelake.functions.fixed import CATEGORIES
from capturelake.operators import counters as C

#: name, whether it is a counter, its categories: written out, not taken from the tables that the operators use.
KNOWN = """
    ('Questions', true, 'throughput'),
    ('questions', false, 'throughput'),
    ('Queries', true, 'throughput'),
    ('Slow_queries', true, 'throughput'),
    ('Com_select', true, 'com-dml'),
    ('Com_insert', true, 'com-dml'),
    ('Com_insert_select', true, 'com-dml'),
    ('Com_truncate', true, 'com-dml'),
    ('Com_load', true, ''),
    ('Com_admin_commands', true, 'throughput'),
    ('Com_stmt_execute', true, 'throughput,com-prep'),
    ('Com_stmt_prepare', true, 'com-prep'),
    ('Com_xa_prepare', true, 'com-tx'),
    ('Com_lock_tables', true, ''),
    ('Com_create_table', true, 'com-ddl'),
    ('Com_show_binlogs', true, 'binlog'),
    ('Handler_read_rnd_next', true, 'handlers'),
    ('Innodb_buffer_pool_pages_dirty', false, 'buffer-pool'),
    ('Innodb_buffer_pool_pages_flushed', true, 'buffer-pool,pending-io'),
    ('Innodb_buffer_pool_pages_total', false, 'buffer-pool'),
    ('Innodb_buffer_pool_read_requests', true, 'innodb-reads'),
    ('Innodb_buffer_pool_reads', true, 'innodb-reads'),
    ('Innodb_buffer_pool_wait_free', true, 'buffer-pool,pending-io'),
    ('Innodb_buffer_pool_write_requests', true, 'innodb-writes'),
    ('Innodb_data_reads', true, 'innodb-reads'),
    ('Innodb_data_written', true, 'innodb-writes'),
    ('Innodb_data_fsyncs', true, ''),
    ('Innodb_data_pending_fsyncs', false, 'pending-io'),
    ('Innodb_os_log_pending_writes', false, 'redo-log,pending-io'),
    ('Innodb_os_log_written', true, 'redo-log'),
    ('Innodb_log_waits', true, 'redo-log'),
    ('Innodb_redo_log_capacity_resized', true, 'redo-log'),
    ('Innodb_row_lock_time', true, 'innodb-locks'),
    ('Innodb_row_lock_current_waits', false, 'innodb-locks'),
    ('Innodb_rows_read', true, 'innodb-reads'),
    ('Innodb_rows_inserted', true, 'innodb-writes'),
    ('Innodb_system_rows_read', true, ''),
    ('Innodb_dblwr_writes', true, 'innodb-writes'),
    ('Innodb_pages_created', true, 'innodb-writes'),
    ('Innodb_history_list_length', false, ''),
    ('Bytes_sent', true, 'network'),
    ('Connections', true, 'network'),
    ('Locked_connects', true, 'network'),
    ('Connection_errors_internal', true, 'network'),
    ('Max_used_connections', false, 'network'),
    ('Max_used_connections_time', false, ''),
    ('Aborted_clients', true, 'network'),
    ('Threads_created', true, 'threads'),
    ('Threads_running', false, 'threads'),
    ('Slow_launch_threads', true, 'threads'),
    ('Created_tmp_tables', true, 'tmp-tables'),
    ('Sort_rows', true, 'sort'),
    ('Select_scan', true, 'select'),
    ('Table_open_cache_hits', true, 'table-cache'),
    ('Opened_tables', true, 'table-cache'),
    ('Opened_files', true, 'table-cache'),
    ('Open_tables', false, 'open-tables'),
    ('Open_streams', false, 'open-tables'),
    ('Binlog_cache_use', true, 'binlog'),
    ('Slave_open_temp_tables', false, 'replication'),
    ('Replica_open_temp_tables', false, 'replication'),
    ('Rpl_semi_sync_master_clients', false, 'replication'),
    ('Rpl_status', false, ''),
    ('Key_reads', true, 'myisam'),
    ('Ssl_accepts', true, 'ssl'),
    ('Ssl_cipher', false, 'ssl'),
    ('Tls_library_version', false, ''),
    ('Current_tls_version', false, 'ssl'),
    ('Performance_schema_users_lost', true, 'perfschema'),
    ('Mysqlx_bytes_sent', true, ''),
    ('Mysqlx_sessions', false, ''),
    ('Uptime', false, ''),
    ('Mystery_x', false, '')
"""
NAMES = re.findall(r"^    \('([^']+)'", KNOWN, re.M)
K_SQL = f"WITH k AS (SELECT *, row_number() OVER () - 1 AS i FROM (VALUES {KNOWN}) v(name, is_counter, cats)), n AS (SELECT p_partkey, p_brand AS capture_id, k.* FROM part JOIN k ON p_partkey % {len(NAMES)} = i)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % len(NAMES) + 1).cast("int"))
    return parts.select("p_partkey", F.col("p_brand").alias("capture_id"), name.alias("name"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.names_of(_parts(spark, sf_dir).withColumn("is_counter", S.is_counter(F.col("name"))))


@query(f"{K_SQL} SELECT p_partkey, name, is_counter FROM n")
def counter_or_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", "name", S.is_counter(F.col("name")).alias("is_counter"))


@query(f"{K_SQL} SELECT unnest(string_split(cats, ',')) AS category, p_partkey, name FROM n WHERE cats <> ''")
def tag_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select(F.explode(S.categories(F.col("name"))).alias("category"), "p_partkey", "name")


_KEYS = "('buffer-pool'), ('innodb-reads'), ('innodb-writes'), ('redo-log'), ('pending-io'), ('innodb-locks'), ('throughput'), ('com-dml'), ('com-tx'), ('com-ddl'), ('com-prep'), ('handlers'), ('table-cache'), ('open-tables'), ('tmp-tables'), ('sort'), ('select'), ('threads'), ('network'), ('binlog'), ('replication'), ('myisam'), ('ssl'), ('perfschema')"


@query(f"{K_SQL}, c AS (SELECT category, count(*) AS n FROM (SELECT DISTINCT unnest(string_split(cats, ',')) AS category, name FROM n) GROUP BY ALL) SELECT k.category, coalesce(c.n, 0) AS n FROM (VALUES {_KEYS}) k(category) LEFT JOIN c ON c.category = k.category")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all parts, by category; categories without a match count 0."""
    names = _parts(spark, sf_dir).select("name").distinct()
    found = names.select(F.explode(S.categories(F.col("name"))).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(k,) for k in CATEGORIES], "category string")
    return every.join(found, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


_PLACED = "row_number() OVER (PARTITION BY capture_id ORDER BY lower(name), name)"


@query(f"""{K_SQL}, d AS (SELECT DISTINCT capture_id, name, is_counter, cats FROM n)
SELECT 'all' AS choice, capture_id, name, {_PLACED} AS place FROM d WHERE contains(lower(name), 'cache')
UNION ALL SELECT 'counters', capture_id, name, {_PLACED} FROM d WHERE is_counter
UNION ALL SELECT 'gauges', capture_id, name, {_PLACED} FROM d WHERE NOT is_counter
UNION ALL SELECT 'redo-log', capture_id, name, {_PLACED} FROM d WHERE list_contains(string_split(cats, ','), 'redo-log')""")
def select_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _names(spark, sf_dir)
    out = [C.select_counters(names, which, text).select(F.lit(which).alias("choice"), "capture_id", "name", F.col("place").cast("bigint").alias("place")) for which, text in (("all", "CACHE"), ("counters", ""), ("gauges", ""), ("redo-log", ""))]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query(f"""{K_SQL}, d AS (SELECT DISTINCT capture_id, name FROM n WHERE is_counter),
r AS (SELECT *, CASE name WHEN 'Com_select' THEN 1 WHEN 'Com_insert' THEN 2 WHEN 'Com_update' THEN 3 WHEN 'Questions' THEN 4 WHEN 'Bytes_received' THEN 5 WHEN 'Bytes_sent' THEN 6 ELSE 7 END AS first FROM d)
SELECT * FROM (SELECT capture_id, name, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY first, name) AS INTEGER) AS rank FROM r) WHERE rank <= 5""")
def default_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.default_counters(_names(spark, sf_dir)).select("capture_id", "name", "rank")


@query("WITH u AS (SELECT l_orderkey, l_linenumber, unnest([('runqueue', 'procs', l_quantity), ('io_in', 'io', l_tax), ('cpu_user', 'cpu', l_discount), ('free_kb', 'memory', l_extendedprice)]) AS x FROM lineitem) SELECT x[1] AS metric, x[2] AS metric_group, count(*) AS n, round(max(x[3]), 6) AS peak FROM u GROUP BY ALL")
def host_metric_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("runqueue"), F.col("l_tax").alias("io_in"), F.col("l_discount").alias("cpu_user"), F.col("l_extendedprice").alias("free_kb"))
    rows = C.host_metric_group(items, ["l_orderkey", "l_linenumber"])
    return rows.groupBy("metric", "metric_group").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("peak"))
