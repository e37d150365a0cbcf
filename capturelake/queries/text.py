"""Query digests and thread lists on documents (a document is a statement) and conversations (a turn is a thread)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.catalog import query
from capturelake.functions import scalar as S
from capturelake.operators import threads as T

NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '''([^''\\]|\\.|'''')*''', '?', 'g'), '"([^"\\]|\\.|"")*"', '?', 'g'), '\b(0x[0-9a-fA-F]+|\d+(\.\d+)?)\b', '?', 'g')"""
SNIP = "CASE WHEN length(n) > 160 THEN substr(n, 1, 157) || '...' ELSE n END"


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is a capture and user, a language a database; every fourth document is idle."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    command = F.when(F.col("doc_id") % 4 == 0, "Sleep").when(F.col("doc_id") % 4 == 1, "").otherwise("Query")
    return docs.select(
        F.col("source").alias("capture_id"), F.col("source").alias("user"), F.col("lang").alias("db"), command.alias("command"), (F.col("doc_id") % 3).cast("string").alias("state"), F.col("text").alias("info"),
        F.col("doc_id").alias("ts"), F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 5 > 0, F.col("n_chars")).alias("time_ms"), (F.col("doc_id") % 7).alias("rows_examined"), (F.col("doc_id") % 11).alias("rows_sent"),
    )


@query(f"SELECT doc_id, {NORMAL} AS normal FROM documents")
def normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", S.normalize_query(F.col("text")).alias("normal"))


@query(f"SELECT doc_id, 'q_' || substr(sha256({NORMAL}), 1, 16) AS fingerprint FROM documents")
def query_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", S.query_fingerprint(S.normalize_query(F.col("text"))).alias("fingerprint"))


@query(f"SELECT doc_id, {SNIP} AS snippet FROM (SELECT doc_id, text AS n FROM documents)")
def bound_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", S.bound_snippet(F.col("text")).alias("snippet"))


H_SQL = f"""WITH h AS (SELECT source AS capture_id, source AS "user", lang AS db, CASE doc_id % 4 WHEN 0 THEN 'Sleep' WHEN 1 THEN '' ELSE 'Query' END AS command, CAST(doc_id % 3 AS VARCHAR) AS state, text, {NORMAL} AS n, doc_id AS seq,
CASE WHEN doc_id % 5 > 0 THEN n_chars END AS time_ms, doc_id % 7 AS rows_examined, doc_id % 11 AS rows_sent FROM documents),
g AS (SELECT capture_id, 'q_' || substr(sha256(n), 1, 16) AS fingerprint, count(*) AS sightings, min(seq) AS first_seen, max(seq) AS last_seen, max(time_ms) AS max_time_ms, max(rows_examined) AS max_rows_examined, max(rows_sent) AS max_rows_sent,
arg_max({{'u': "user", 'd': db, 'c': command, 's': state}}, (time_ms IS NOT NULL, coalesce(time_ms, 0), -seq)) AS x, {SNIP.replace("n)", "min(n))").replace("(n,", "(min(n),").replace("ELSE n", "ELSE min(n)")} AS snippet FROM h WHERE command NOT IN ('', 'Sleep') GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY max_time_ms DESC NULLS LAST, max_rows_examined DESC NULLS LAST, max_rows_sent DESC NULLS LAST, fingerprint) AS rank FROM g)"""
_DIGEST = """capture_id, fingerprint, sightings, first_seen, last_seen, max_time_ms, max_rows_examined, max_rows_sent, x.u AS "user", x.d AS db, x.c AS command, x.s AS state, snippet"""


@query(f"{H_SQL} SELECT capture_id, seq FROM h WHERE command NOT IN ('', 'Sleep') AND trim(text) <> ''")
def active_query_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.active_queries(threads(spark, sf_dir)).select("capture_id", "seq")


def _digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.query_digest(T.active_queries(threads(spark, sf_dir)), ["capture_id"])


@query(f"{H_SQL} SELECT {_DIGEST} FROM g")
def query_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(spark, sf_dir)


@query(f"{H_SQL} SELECT {_DIGEST}, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10")
def top_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.top_queries(_digest(spark, sf_dir), ["capture_id"])


@query(f"{H_SQL} SELECT capture_id, fingerprint, snippet FROM g WHERE contains(lower(snippet), 'the') AND contains(lower(x.d), 'en')")
def slow_query_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.slow_query_search(_digest(spark, sf_dir), snippet="the", db="EN").select("capture_id", "fingerprint", "snippet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a sample, a turn a thread; system turns have no command, users sleep."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    command = F.when(F.col("role") == "user", "Sleep").when(F.col("role") == "system", "").otherwise(F.col("role"))
    return t.select(F.col("conv_id").alias("sample"), command.alias("command"), F.when(F.col("turn") % 3 == 0, "NULL").otherwise(F.col("turn").cast("string")).alias("state"), F.col("role").alias("user"), F.col("text").alias("info"), F.col("turn").alias("time_s"), F.when(F.col("turn") % 2 == 0, F.char_length("text").cast("bigint")).alias("time_ms"), F.col("turn").alias("rows_examined"), (F.col("turn") * 2).alias("rows_sent"))


TURN_SQL = "WITH t AS (SELECT conv_id AS sample, CASE role WHEN 'user' THEN 'Sleep' WHEN 'system' THEN '' ELSE role END AS command, CASE WHEN turn % 3 = 0 THEN 'NULL' ELSE CAST(turn AS VARCHAR) END AS state, role AS \"user\", text AS info, turn AS time_s, CASE WHEN turn % 2 = 0 THEN length(text) END AS time_ms, turn AS rows_examined, turn * 2 AS rows_sent FROM conversations)"


@query(f"{TURN_SQL}, u AS (SELECT sample, unnest([('command', CASE WHEN command = '' THEN 'Other' ELSE command END), ('state', CASE WHEN state IN ('', 'NULL') THEN 'Other' ELSE state END), ('user', \"user\")]) AS x FROM t) SELECT sample, x[1] AS dim, x[2] AS label, count(*) AS n FROM u GROUP BY ALL")
def thread_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.thread_histogram(turns(spark, sf_dir), ["sample"], ["command", "state", "user"])


A_SQL = f"""{TURN_SQL}, a AS (SELECT sample, count(*) AS total, count(*) FILTER (WHERE command <> 'Sleep') AS active, count(*) FILTER (WHERE command = 'Sleep') AS sleeping, max(coalesce(time_ms, time_s * 1000)) AS max_age_ms,
max(rows_examined) AS max_rows_examined, max(rows_sent) AS max_rows_sent, count(*) FILTER (WHERE trim(coalesce(info, '')) <> '') AS with_text FROM t GROUP BY ALL)"""


@query(f"{A_SQL} SELECT * FROM a")
def thread_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.thread_activity(turns(spark, sf_dir), ["sample"])


@query(f"{A_SQL} SELECT sample % 10 AS capture_id, max(total) AS peak_total, max(active) AS peak_active, max(sleeping) AS peak_sleeping, max(max_age_ms) AS peak_max_age_ms, max(max_rows_examined) AS peak_max_rows_examined, max(max_rows_sent) AS peak_max_rows_sent FROM a GROUP BY ALL")
def thread_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.thread_peaks(T.thread_activity(turns(spark, sf_dir), ["sample"]).withColumn("capture_id", F.col("sample") % 10), ["capture_id"])


@query("SELECT conv_id, turn, CASE WHEN trim(role) = '' THEN 'Other' ELSE trim(role) END AS role, CASE WHEN turn % 3 = 0 THEN 'Other' ELSE CAST(turn AS VARCHAR) END AS state FROM conversations")
def bucket_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    state = F.when(F.col("turn") % 3 == 0, "NULL").otherwise(F.col("turn").cast("string"))
    return t.select("conv_id", "turn", S.bucket_other(F.col("role")).alias("role"), S.bucket_other(state, True).alias("state"))


@query("""SELECT page_id, CASE WHEN h LIKE '[%' THEN regexp_extract(h, '^(\\[[^\\]]*\\])', 1) WHEN length(h) - length(replace(h, ':', '')) = 1 THEN split_part(h, ':', 1) ELSE h END AS host
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN split_part(url, '/', 3) || ':' || page_id WHEN 1 THEN '[::' || page_id || ']:33' WHEN 2 THEN 'fe80::' || page_id ELSE split_part(url, '/', 3) END AS h FROM pages)""")
def strip_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, n = F.split("url", "/")[2], F.col("page_id").cast("string")
    kind = F.col("page_id") % 4
    h = F.when(kind == 0, F.concat(host, F.lit(":"), n)).when(kind == 1, F.concat(F.lit("[::"), n, F.lit("]:33"))).when(kind == 2, F.concat(F.lit("fe80::"), n)).otherwise(host)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", S.strip_port(h).alias("host"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity + l_discount, 6) AS value FROM lineitem")
def localized_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written with a decimal comma on every other line."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = F.round(F.col("l_quantity") + F.col("l_discount"), 6).cast("string")
    written = F.when(F.col("l_linenumber") % 2 == 0, F.replace(text, F.lit("."), F.lit(","))).otherwise(text)
    return items.select("l_orderkey", "l_linenumber", S.localized_double(written).alias("value"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE epoch_us(ts) // 1000000 END AS seconds FROM events")
def epoch_to_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    sec = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    text = F.when(F.col("event_id") % 7 == 0, F.element_at(F.array(*map(F.lit, ["", "-5", "1e40", "abc"])), (F.col("event_id") % 4 + 1).cast("int"))).otherwise(sec.cast("string"))
    return events.select("event_id", F.unix_seconds(S.epoch_to_ts(text, F.timestamp_seconds(F.lit(0)))).alias("seconds"))


@query("SELECT event_id, epoch_us(ts) // 1000000 AS seconds FROM events")
def snapshot_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written as file prefixes and read again."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", (F.unix_seconds(S.snapshot_ts(F.date_format(F.col("ts").cast("timestamp"), "yyyy_MM_dd_HH_mm_ss"))) + F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") - F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp")))).alias("seconds"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id // 3 % 2 = 0 ELSE doc_id % 3 = 1 END AS equal FROM documents")
def comma_set_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets in other order and case are equal, sets with another or a repeated member are not."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.col("doc_id") % 3
    a = F.concat(F.lit("A, b,"), F.col("source"))
    b = F.when(n == 1, F.concat(F.upper("source"), F.lit(",B,,a "))).when(n == 2, F.concat(F.lit("a,b,b,"), F.col("source"))).otherwise(F.concat(F.lit("b,a,"), F.col("source"), F.when(F.floor(F.col("doc_id") / 3) % 2 == 0, "").otherwise("x")))
    return docs.select("doc_id", S.comma_set_equal(a, b).alias("equal"))
