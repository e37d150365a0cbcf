"""Rules on facts that events give: a user is a capture, and every fact is a scaled remainder of the sum of its event ids,
missing for some users, so that each branch of each rule fires."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.catalog import query
from capturelake.plans import findings as P
from capturelake.plans.rules import EDGES, RULES, SUBSYSTEMS, TOPICS, fact_names

#: What a fact's remainder (0 to 99) is scaled by; others by 1.
SCALE = {
    "v_innodb_buffer_pool_size": 40_000_000, "v_max_connections": 120, "l_Uptime": 400, "r_Handler_read_rnd_next": 4000, "r_Com_select": 0.3, "t_Innodb_buffer_pool_read_requests": 900, "t_Innodb_buffer_pool_reads": 0.5,
    "r_Aborted_connects": 0.02, "t_Table_open_cache_hits": 5, "t_Threads_created": 0.4, "x_semaphores": 9, "x_slow_age_s": 1.5, "v_sync_binlog": 0.03, "v_innodb_lru_scan_depth": 0.4, "v_innodb_buffer_pool_instances": 0.05, "r_Binlog_cache_disk_use": 0.02,
    "r_Binlog_stmt_cache_disk_use": 0.02, "r_Select_full_join": 0.02, "r_Select_scan": 0.2, "r_Innodb_log_waits": 0.02, "r_Table_open_cache_overflows": 0.1, "r_Deprecated_use_i_s_processlist_count": 2.0, "l_Innodb_buffer_pool_pages_total": 3,
}
TEXT = {"s_log_bin": ("ON", "OFF"), "s_gtid_mode": ("ON", "OFF"), "s_slow_query_log": ("ON", "OFF"), "x_slow_state": ("Waiting for table metadata lock", "sending data")}


def _fact(i: int, name: str, whole: str) -> str:
    """The same SQL in Spark and in DuckDB."""
    r = f"({whole} * {i + 3} + {i * i}) % 100"
    if name in TEXT:
        a, b = TEXT[name]
        return f"CASE WHEN {r} < 40 THEN '{a}' WHEN {r} < 90 THEN '{b}' END"
    low = f"CASE WHEN {r} < 20 THEN 0 ELSE {r} END"
    scale = SCALE.get(name, 1)
    value = f"CAST(floor(({low}) * {scale}) AS DOUBLE)" if name in ("v_sync_binlog", "v_innodb_buffer_pool_instances") else f"CAST(({low}) * {scale} AS DOUBLE)"
    return f"CASE WHEN {r} < 95 THEN {value} END"


FACTS = ", ".join(f"{_fact(i, n, 'h')} AS {n}" for i, n in enumerate(fact_names()))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("capture_id")).agg((F.sum("event_id") % 99991).alias("h"))
    return h.selectExpr("capture_id", *[f"{_fact(i, n, 'h')} AS {n}" for i, n in enumerate(fact_names())])


F_SQL = f"WITH h AS (SELECT user_id AS capture_id, CAST(sum(event_id) AS BIGINT) % 99991 AS h FROM events GROUP BY ALL), f AS (SELECT capture_id, {FACTS} FROM h)"


def _register(rule) -> None:
    @query(f"{F_SQL}, r AS (SELECT capture_id, {rule.severity} AS severity FROM f) SELECT * FROM r WHERE severity IS NOT NULL", name=f"rule_{rule.id.replace('.', '_')}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return P.evaluate(facts(spark, sf_dir)).filter(F.col("rule_id") == rule.id).select("capture_id", "severity")


for _rule in RULES:
    _register(_rule)

_ALL = " UNION ALL ".join(f"SELECT capture_id, '{r.id}' AS rule_id, '{r.subsystem}' AS subsystem, '{r.topic}' AS topic, {len(r.metrics)} AS metrics, {r.severity} AS severity FROM f" for r in RULES)
_EDGES = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in EDGES)
X_SQL = f"""{F_SQL}, a AS (SELECT * FROM ({_ALL}) WHERE severity IS NOT NULL),
n AS (SELECT *, CASE severity WHEN 'crit' THEN 3 WHEN 'warn' THEN 2 WHEN 'info' THEN 1 ELSE 0 END AS severity_rank, CASE WHEN severity = 'crit' OR metrics >= 2 THEN 'high' WHEN severity = 'ok' THEN 'medium' WHEN severity = 'info' THEN 'low' ELSE 'medium' END AS confidence,
  list_position({SUBSYSTEMS!r}, subsystem) AS sub FROM a),
e AS (SELECT DISTINCT x.capture_id, x.rule_id, g.to_id, g.relationship FROM n x JOIN (VALUES {_EDGES}) g(rule_id, to_id, relationship) ON g.rule_id = x.rule_id JOIN n y ON y.capture_id = x.capture_id AND y.rule_id = g.to_id),
k AS (SELECT n.*, coalesce(c.n_related, 0) AS n_related FROM n LEFT JOIN (SELECT capture_id, rule_id, count(*) AS n_related FROM e GROUP BY ALL) c ON c.capture_id = n.capture_id AND c.rule_id = n.rule_id)"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.findings_table(facts(spark, sf_dir))


@query(f"{X_SQL} SELECT capture_id, rule_id, subsystem, severity, severity_rank, confidence, n_related, metrics AS n_evidence, row_number() OVER (PARTITION BY capture_id ORDER BY sub, severity_rank DESC, rule_id) AS place FROM k")
def findings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("capture_id", "rule_id", "subsystem", "severity", "severity_rank", "confidence", F.size("related").cast("bigint").alias("n_related"), F.size("evidence").alias("n_evidence"), F.col("place").cast("bigint").alias("place"))


@query(f"{X_SQL} SELECT capture_id, rule_id, row_number() OVER (PARTITION BY capture_id ORDER BY sub, severity_rank DESC, rule_id) AS place FROM k")
def order_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("capture_id", "rule_id", F.col("place").cast("bigint").alias("place"))


@query(f"{X_SQL} SELECT * FROM e")
def related_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("capture_id", "rule_id", F.explode("related").alias("r")).select("capture_id", "rule_id", F.col("r.id").alias("to_id"), "r.relationship")


@query(f"{X_SQL}, s AS (SELECT *, severity_rank * 100 + CASE confidence WHEN 'high' THEN 30 WHEN 'medium' THEN 20 ELSE 10 END + 3 * least(metrics, 4) + 2 * least(n_related, 3) AS score FROM k WHERE severity <> 'ok'), t AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY score DESC, sub, rule_id) AS rank FROM s) SELECT capture_id, rule_id, CAST(score AS BIGINT) AS score, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 3")
def top_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_drivers(_findings(spark, sf_dir)).select("capture_id", "rule_id", F.col("score").cast("bigint").alias("score"), "rank")


@query(f"{X_SQL} SELECT capture_id, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in P.RANK) + " FROM k GROUP BY ALL")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.severity_counts(P.evaluate(facts(spark, sf_dir)))


_TOPICS = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in TOPICS)
_RULE_TOPICS = ", ".join(f"('{r.topic}', '{r.id}')" for r in RULES)


@query(f"{X_SQL}, c AS (SELECT topic, count(DISTINCT capture_id) AS captures FROM k WHERE severity IN ('crit', 'warn') GROUP BY ALL), r AS (SELECT topic, count(*) AS rules FROM (VALUES {_RULE_TOPICS}) x(topic, id) GROUP BY ALL) SELECT t.topic, t.subsystem, t.coverage, coalesce(rules, 0) AS rules, coalesce(captures, 0) AS captures FROM (VALUES {_TOPICS}) t(topic, subsystem, coverage) LEFT JOIN c ON c.topic = t.topic LEFT JOIN r ON r.topic = t.topic")
def coverage_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.coverage_map(_findings(spark, sf_dir))
