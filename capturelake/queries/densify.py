"""Densify, top-k and set operators on events (a user is a capture, a day a sample) and lineitem (a supplier is a device)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.catalog import query
from capturelake.operators import densify as D
from capturelake.queries.deltas import S_SQL, samples

DAY = "seconds // 86400 AS day"


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).withColumn("day", F.expr("seconds div 86400"))


D_SQL = f"WITH {S_SQL}, e AS (SELECT *, {DAY} FROM s)"


@query(f"""{D_SQL}, f AS (SELECT capture_id, snapshot, min(name) AS name FROM e GROUP BY ALL),
x AS (SELECT DISTINCT e.capture_id, e.snapshot, e.day FROM e JOIN f ON e.capture_id = f.capture_id AND e.snapshot = f.snapshot AND e.name = f.name),
l AS (SELECT DISTINCT capture_id, name FROM e), v AS (SELECT capture_id, name, snapshot, day, max(raw) AS value FROM e GROUP BY ALL)
SELECT x.capture_id, l.name, x.snapshot, x.day, v.value FROM x JOIN l ON x.capture_id = l.capture_id
LEFT JOIN v ON v.capture_id = x.capture_id AND v.name = l.name AND v.snapshot = x.snapshot AND v.day = x.day""")
def densify_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = days(spark, sf_dir)
    axis = D.first_label_axis(rows, ["capture_id"], "snapshot", "name", ["day"])
    return D.densify(rows, ["capture_id"], "name", ["snapshot", "day"], F.max("raw"), None, axis)


@query(f"""{D_SQL}, p AS (SELECT name AS host, capture_id AS pid, day, arg_max(raw, seq) AS cpu FROM e GROUP BY ALL),
x AS (SELECT DISTINCT host, day FROM p), l AS (SELECT DISTINCT host, pid FROM p)
SELECT x.host, x.day, l.pid, coalesce(p.cpu, 0) AS value FROM x JOIN l ON x.host = l.host LEFT JOIN p ON p.host = x.host AND p.day = x.day AND p.pid = l.pid""")
def densify_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event type is a host, a user a process of it."""
    rows = days(spark, sf_dir).select(F.col("name").alias("host"), F.col("capture_id").alias("pid"), "day", "raw", "seq")
    return D.densify(rows, ["host"], "pid", ["day"], F.max_by("raw", "seq"), 0)


@query(f"""{D_SQL}, k AS (SELECT capture_id, name, bool_or(raw % 2 = 0) AS is_counter FROM e GROUP BY ALL), x AS (SELECT DISTINCT capture_id, snapshot, seq AS sample FROM e)
SELECT x.capture_id, k.name, x.snapshot, x.sample, k.is_counter, e.raw FROM x JOIN k ON x.capture_id = k.capture_id
LEFT JOIN e ON e.capture_id = x.capture_id AND e.name = k.name AND e.snapshot = x.snapshot AND e.seq = x.sample""")
def densify_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = days(spark, sf_dir).withColumn("is_counter", F.col("raw") % 2 == 0).withColumnRenamed("seq", "sample")
    return D.densify_status(rows, ["capture_id"]).select("capture_id", "name", "snapshot", "sample", "is_counter", "raw")


@query(f"""{D_SQL}, v AS (SELECT capture_id, name, day, count(*) AS n FROM e GROUP BY ALL), x AS (SELECT DISTINCT capture_id, day FROM e), l AS (SELECT DISTINCT capture_id, name FROM e)
SELECT x.capture_id, x.day, l.name, coalesce(n, 0) AS value FROM x JOIN l ON x.capture_id = l.capture_id LEFT JOIN v ON v.capture_id = x.capture_id AND v.day = x.day AND v.name = l.name""")
def densify_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.densify(days(spark, sf_dir), ["capture_id"], "name", ["day"], F.count("*"), 0)


@query(f"WITH {S_SQL}, r AS (SELECT capture_id, snapshot, row_number() OVER (PARTITION BY capture_id ORDER BY snapshot, ts, seq) - 1 AS i FROM s) SELECT capture_id, snapshot, min(i) AS boundary FROM r GROUP BY ALL")
def snapshot_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.snapshot_boundaries(samples(spark, sf_dir), ["capture_id"], "snapshot", ["ts", "seq"]).withColumn("boundary", F.col("boundary").cast("bigint"))


@query(f"WITH {S_SQL}, f AS (SELECT capture_id, min(snapshot) AS w FROM s GROUP BY ALL), n AS (SELECT DISTINCT s.capture_id, name FROM s JOIN f ON s.capture_id = f.capture_id AND snapshot = w) SELECT s.capture_id, s.name, seq, raw FROM s SEMI JOIN n ON s.capture_id = n.capture_id AND s.name = n.name")
def append_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.append_snapshots(samples(spark, sf_dir), ["capture_id"], "snapshot", "name").select("capture_id", "name", "seq", "raw")


@query(f"WITH {S_SQL} SELECT capture_id, count(DISTINCT name) AS labels FROM s GROUP BY ALL")
def union_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("capture_id", "name").distinct().groupBy("capture_id").agg(F.count("*").alias("labels"))


P_SQL = f"""{D_SQL}, p AS (SELECT name AS host, capture_id AS pid, CASE WHEN capture_id % 10 = 3 THEN 'mysqld' ELSE 'proc' || capture_id % 7 END AS command, day, raw, seq FROM e),
o AS (SELECT host, pid, day, arg_max(raw, seq) AS raw, arg_max(command, seq) AS command FROM p GROUP BY ALL), n AS (SELECT host, count(DISTINCT day) AS n FROM p GROUP BY ALL),
t AS (SELECT o.host, pid, any_value(command) AS command, sum(raw) AS total, any_value(n) AS n FROM o JOIN n ON o.host = n.host GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY total DESC, pid DESC) AS rank, row_number() OVER (PARTITION BY host, command = 'mysqld' ORDER BY total DESC, pid DESC) AS own FROM t)"""


def _processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    command = F.when(F.col("capture_id") % 10 == 3, "mysqld").otherwise(F.concat(F.lit("proc"), (F.col("capture_id") % 7).cast("string")))
    rows = days(spark, sf_dir).select(F.col("name").alias("host"), F.col("capture_id").alias("pid"), command.alias("command"), "day", "raw", "seq")
    return D.top_processes(rows, ["host"], "pid", "command", "day", "raw").withColumn("mean_cpu", F.round("mean_cpu", 6))


@query(f"{P_SQL} SELECT host, pid, command, round(total / n, 6) AS mean_cpu, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3")
def top_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _processes(spark, sf_dir).filter("rank <= 3")


@query(f"{P_SQL} SELECT host, pid, command, round(total / n, 6) AS mean_cpu, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3 OR (command = 'mysqld' AND own = 1)")
def pin_server_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _processes(spark, sf_dir)


@query("""WITH v AS (SELECT l_returnflag AS capture_id, l_suppkey AS device, epoch_us(l_shipdate) // 2592000000000 AS month, count(*) AS n FROM lineitem GROUP BY ALL),
m AS (SELECT capture_id, device, max(n) AS peak FROM v GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY peak DESC, device) AS rank FROM m), o AS (SELECT capture_id, count(*) FILTER (WHERE rank > 16) AS others FROM k GROUP BY ALL)
SELECT v.capture_id, month, CASE WHEN rank <= 16 THEN CAST(v.device AS VARCHAR) ELSE 'Other (' || others || ')' END AS label, CAST(sum(n) AS BIGINT) AS value
FROM v JOIN k ON v.capture_id = k.capture_id AND v.device = k.device JOIN o ON o.capture_id = v.capture_id GROUP BY ALL""")
def top_labels_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A return flag is a capture, a supplier a label, thirty days a sample."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    month = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(l_shipdate AS TIMESTAMP_NTZ)) div 2592000000000")
    rows = items.groupBy(F.col("l_returnflag").alias("capture_id"), F.col("l_suppkey").alias("device"), month.alias("month")).agg(F.count("*").alias("value"))
    text = rows.withColumn("order", F.col("device")).withColumn("device", F.col("device").cast("string"))
    return D.top_labels_other(text, ["capture_id"], "device", "month", "value", order="order")


@query("SELECT lang, label, row_number() OVER (PARTITION BY lang ORDER BY label = 'Other', label) AS place FROM (SELECT DISTINCT lang, CASE WHEN source = 'src3' THEN 'Other' ELSE source END AS label FROM documents)")
def order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language is a capture."""
    from pyspark.sql import Window

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = docs.select("lang", F.when(F.col("source") == "src3", "Other").otherwise(F.col("source")).alias("label")).distinct()
    return labels.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*D.order_labels(F.col("label")))).cast("bigint"))
