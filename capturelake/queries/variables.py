"""Variable operators on orders: a customer is a capture, ninety days a snapshot, a priority a name, a status its value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.catalog import query
from capturelake.functions import scalar as S
from capturelake.operators import variables as V

DAYS = "timestampdiff(DAY, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(o_orderdate AS TIMESTAMP_NTZ))"
_VARIABLE_SQL = """v AS (SELECT o_custkey % 200 AS capture_id, epoch_us(o_orderdate) // 86400000000 // 90 AS snapshot, CASE o_orderpriority WHEN '5-LOW' THEN 'GTID_executed' ELSE o_orderpriority END AS name, max(o_orderstatus) AS value FROM orders GROUP BY ALL),
s AS (SELECT c.capture_id, p.snapshot FROM (SELECT DISTINCT capture_id FROM v) c, (SELECT unnest(range(min(snapshot), max(snapshot) + 1)) AS snapshot FROM v) p WHERE (c.capture_id + p.snapshot) % 5 > 0),
w AS (SELECT v.* FROM v SEMI JOIN s ON v.capture_id = s.capture_id AND v.snapshot = s.snapshot WHERE (v.capture_id * 7 + v.snapshot) % 6 > 0),
g AS (SELECT capture_id, snapshot, string_agg(CASE WHEN lower(name) NOT IN ('gtid_executed', 'gtid_purged') THEN name || '=' || coalesce(value, '') END, chr(10) ORDER BY name || '=' || coalesce(value, '') COLLATE "binary") AS text FROM w GROUP BY ALL)"""
V_SQL = "WITH " + _VARIABLE_SQL.replace(' COLLATE "binary"', "")
R_SQL = f"""{V_SQL}, j AS (SELECT s.capture_id, s.snapshot, CASE WHEN g.capture_id IS NOT NULL THEN sha256(coalesce(text, '')) END AS signature FROM s LEFT JOIN g ON s.capture_id = g.capture_id AND s.snapshot = g.snapshot),
c AS (SELECT *, CASE WHEN row_number() OVER x = 1 OR signature IS DISTINCT FROM lag(signature) OVER x THEN 1 ELSE 0 END AS new FROM j WINDOW x AS (PARTITION BY capture_id ORDER BY snapshot)),
r AS (SELECT capture_id, snapshot, signature, CAST(sum(new) OVER (PARTITION BY capture_id ORDER BY snapshot) AS BIGINT) AS run_no FROM c)"""


def variables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Settings, and all snapshots (one in six has no settings)."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    name = F.when(F.col("o_orderpriority") == "5-LOW", "GTID_executed").otherwise(F.col("o_orderpriority"))
    every = orders.groupBy((F.col("o_custkey") % 200).alias("capture_id"), F.expr(f"{DAYS} div 90").alias("snapshot"), name.alias("name")).agg(F.max("o_orderstatus").alias("value"))
    lo, hi = (every.agg(f("snapshot").cast("bigint")).scalar() for f in (F.min, F.max))
    snapshots = every.select("capture_id").distinct().withColumn("snapshot", F.explode(F.sequence(lo, hi))).filter((F.col("capture_id") + F.col("snapshot")) % 5 > 0)
    kept = every.join(snapshots, ["capture_id", "snapshot"], "left_semi").filter((F.col("capture_id") * 7 + F.col("snapshot")) % 6 > 0)
    return kept, snapshots


@query(f"{V_SQL} SELECT capture_id, snapshot, sha256(coalesce(text, '')) AS signature FROM g")
def variable_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.variable_signature(variables(spark, sf_dir)[0], ["capture_id", "snapshot"])


@query(f"{R_SQL} SELECT capture_id, snapshot, signature, run_no FROM r")
def collapse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.variable_runs(*variables(spark, sf_dir), "capture_id", "snapshot").select("capture_id", "snapshot", "signature", "run_no")


@query(f"""{R_SQL}, f AS (SELECT capture_id, run_no, min(snapshot) AS snapshot FROM r WHERE signature IS NOT NULL GROUP BY ALL),
k AS (SELECT f.run_no, w.* FROM w JOIN f ON w.capture_id = f.capture_id AND w.snapshot = f.snapshot WHERE lower(name) NOT IN ('gtid_executed', 'gtid_purged'))
SELECT k.capture_id, k.snapshot, k.run_no, k.name, k.value, b.value AS old_value FROM k SEMI JOIN f ON f.capture_id = k.capture_id AND f.run_no = k.run_no - 1
LEFT JOIN k b ON b.capture_id = k.capture_id AND b.run_no = k.run_no - 1 AND b.name = k.name WHERE b.capture_id IS NULL OR k.value IS DISTINCT FROM b.value""")
def changed_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.changed_variables(*variables(spark, sf_dir), "capture_id", "snapshot")


@query(f"{V_SQL} SELECT capture_id, lower(name) AS name, arg_max(value, snapshot) AS value FROM w GROUP BY ALL")
def latest_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.latest_variable(variables(spark, sf_dir)[0], "capture_id", "snapshot")


C_SQL = """WITH o AS (SELECT p_partkey AS capture_id, CAST(5 + p_partkey % 6 AS VARCHAR) || '.' || CAST(p_size % 12 AS VARCHAR) || '.3-log' AS version, p_brand AS name, CASE WHEN p_partkey % 3 = 0 THEN 'b, A' ELSE CAST(p_size % 3 AS VARCHAR) END AS value FROM part),
d AS (SELECT DISTINCT lower(p_brand) AS name, 5 + p_size % 5 AS major, p_size % 12 AS minor, CASE WHEN p_size % 2 = 0 THEN 'a,b' ELSE CAST(p_size % 3 AS VARCHAR) END AS dv FROM part WHERE right(p_brand, 1) <> '1'),
m AS (SELECT o.capture_id, arg_max(dv, (major, minor)) AS best FROM o JOIN d ON lower(o.name) = d.name AND (major, minor) <= (CAST(split_part(version, '.', 1) AS INTEGER), CAST(split_part(version, '.', 2) AS INTEGER)) GROUP BY ALL)
SELECT o.capture_id, o.name, CASE WHEN best IS NULL THEN 'unknown' WHEN lower(value) = best OR (value = 'b, A' AND best = 'a,b') THEN 'default' ELSE 'modified' END AS status FROM o LEFT JOIN m ON o.capture_id = m.capture_id"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is a server: its key and size give the version (none without a key), its brand is a variable."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    minor = (F.col("p_size") % 12).cast("string")
    observed = part.select(F.col("p_partkey").alias("capture_id"), F.concat((F.col("p_partkey") % 6 + 5).cast("string"), F.lit("."), minor, F.lit(".3-log")).alias("version"), F.col("p_brand").alias("name"), F.when(F.col("p_partkey") % 3 == 0, "b, A").otherwise((F.col("p_size") % 3).cast("string")).alias("value"))
    defaults = part.filter("right(p_brand, 1) <> '1'").select(F.col("p_brand").alias("name"), F.concat_ws(".", (F.col("p_size") % 5 + 5).cast("string"), minor).alias("version"), F.when(F.col("p_size") % 2 == 0, "a,b").otherwise((F.col("p_size") % 3).cast("string")).alias("default_value")).distinct()
    return V.classify_variable(observed, defaults)


@query(C_SQL)
def classify_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir)


@query(f"SELECT * FROM ({C_SQL}) WHERE status = 'modified'")
def variable_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).filter("status = 'modified'")


@query("SELECT p_partkey, CAST(5 + p_partkey % 6 AS VARCHAR) || '.' || CAST(p_size % 12 AS VARCHAR) AS version, p_partkey % 6 + 5 > 8 OR (p_partkey % 6 + 5 = 8 AND p_size % 12 > 2) AS newer FROM part")
def resolve_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions cut from longer texts; newer than 8.2 by number, so 8.10 is."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    raw = F.concat_ws(".", (F.col("p_partkey") % 6 + 5).cast("string"), (F.col("p_size") % 12).cast("string"), F.lit("21-log"))
    version = S.major_version(raw)
    return part.select("p_partkey", version.alias("version"), (S.version_key(version) > S.version_key(F.lit("8.2"))).alias("newer"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND o_custkey % 3 > 0 THEN 'cluster' WHEN o_orderpriority = '1-URGENT' THEN 'percona' WHEN o_orderpriority = '2-HIGH' OR o_orderstatus = 'F' THEN 'mariadb' ELSE 'community' END AS distribution FROM orders")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    comment = F.when(F.col("o_orderpriority") == "1-URGENT", "Percona Server (GPL)").when(F.col("o_orderpriority") == "2-HIGH", "MariaDB Server").otherwise("x")
    version = F.when(F.col("o_orderstatus") == "F", "10.4.2-MariaDB").otherwise("8.0.3")
    return orders.select("o_orderkey", S.distribution(F.when(F.col("o_orderkey") % 5 == 0, "ON").otherwise("OFF"), (F.col("o_custkey") % 3).cast("string"), comment, version).alias("distribution"))


@query("""SELECT o_custkey AS capture_id, substr(sha256('host' || o_custkey || chr(10) || string_agg(x, chr(10) ORDER BY x)), 1, 12) AS fingerprint FROM (SELECT o_custkey, CAST(epoch_us(o_orderdate) // 86400000000 AS VARCHAR) || ':' || o_orderstatus || ':' || CAST(o_orderkey AS VARCHAR) AS x FROM orders) GROUP BY 1""")
def capture_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    files = orders.select(F.col("o_custkey").alias("capture_id"), F.concat(F.lit("host"), F.col("o_custkey").cast("string")).alias("hostname"), F.expr(DAYS).cast("string").alias("snapshot"), F.col("o_orderstatus").alias("suffix"), F.col("o_orderkey").alias("size"))
    return V.capture_fingerprint(files)
