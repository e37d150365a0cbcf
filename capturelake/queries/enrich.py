"""Enrichment functions of findings, on parts (a name is a metric or an advice text) and on facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.catalog import query
from capturelake.functions import scalar as S
from capturelake.plans import findings as P

METRICS = ["Select_scan/s", "hit ratio", "dirty pct", "state of thread", "Aborted clients", "read error", "plain", "pending syncs", "a / b", "waits per second", "Questions rate", "metadata lock"]
M_SQL = f"m AS (SELECT p_partkey, ({METRICS!r})[p_partkey % {len(METRICS)} + 1] AS name, p_size % 3 AS value FROM part)"


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, METRICS)), (F.col("p_partkey") % len(METRICS) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", name.alias("name"), (F.col("p_size") % 3).alias("value"))


@query(f"""WITH {M_SQL} SELECT p_partkey, CASE WHEN regexp_matches(lower(name), '/s|rate') THEN 'derived_rate' WHEN regexp_matches(lower(name), 'ratio|pct|%| per ') OR (contains(name, ' / ') AND NOT contains(name, '/s')) THEN 'derived_ratio'
WHEN regexp_matches(lower(name), 'state|processlist|metadata lock') THEN 'observed_state' WHEN regexp_matches(lower(name), 'error|aborted') THEN 'observed_error' ELSE 'direct_measurement' END AS kind FROM m""")
def evidence_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("p_partkey", S.evidence_kind(F.col("name")).alias("kind"))


@query(f"WITH {M_SQL} SELECT p_partkey, CASE WHEN regexp_matches(lower(name), 'wait|pending|metadata lock|single-page|error|aborted') THEN 'strong' WHEN value = 0 THEN 'weak' ELSE 'moderate' END AS strength FROM m")
def evidence_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("p_partkey", S.evidence_strength(F.col("name"), F.col("value")).alias("strength"))


SEVERITIES = ["crit", "warn", "info", "ok"]


@query(f"SELECT p_partkey, CASE WHEN p_size % 4 = 0 OR p_partkey % 4 >= 2 THEN 'high' WHEN p_size % 4 = 3 THEN 'medium' WHEN p_size % 4 = 2 THEN 'low' ELSE 'medium' END AS confidence FROM part")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.element_at(F.array(*map(F.lit, SEVERITIES)), (F.col("p_size") % 4 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", S.confidence(severity, F.col("p_partkey") % 4).alias("confidence"))


@query(f"WITH {M_SQL} SELECT p_partkey, CASE WHEN regexp_matches(lower(name), 'error|aborted') THEN 'error' WHEN regexp_matches(lower(name), 'wait|pending|overflow|miss|dirty|full_join|select_scan|scan|rnd_next|disk|metadata|flushing|saturation|semaphore') THEN 'saturation' WHEN regexp_matches(lower(name), 'checkpoint_age|ratio|usage|size|cache|utilization') THEN 'utilization' ELSE 'combined' END AS category FROM m")
def category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("p_partkey", P.category(F.lit("id"), F.col("name"), F.lit("x")).alias("category"))


ADVICE = ["Increase the pool", "Check the log", "Wait", "Move it"]


@query(f"WITH a AS (SELECT p_partkey, ({ADVICE!r})[p_partkey % 4 + 1] AS x, ({ADVICE!r})[p_size % 4 + 1] AS y FROM part), k AS (SELECT *, CASE WHEN contains(x, 'Check') THEN 'confirm' WHEN regexp_matches(x, 'Increase|Move') THEN 'mitigate' ELSE 'confirm' END AS kx, CASE WHEN contains(y, 'Check') THEN 'confirm' WHEN regexp_matches(y, 'Increase|Move') THEN 'mitigate' ELSE 'investigate' END AS ky FROM a) SELECT p_partkey, CASE WHEN kx = 'confirm' OR ky = 'confirm' THEN kx ELSE 'confirm' END AS first_kind, ky AS second_kind FROM k")
def advice_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda c: F.element_at(F.array(*map(F.lit, ADVICE)), (F.col(c) % 4 + 1).cast("int"))
    got = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", P.advice(F.array(pick("p_partkey"), pick("p_size"))).alias("a"))
    return got.select("p_partkey", F.col("a")[0]["kind"].alias("first_kind"), F.col("a")[1]["kind"].alias("second_kind"))
