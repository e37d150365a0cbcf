"""From facts to findings: severities, evidence, advice, relations, order, top drivers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capturelake.functions import scalar as S
from capturelake.plans.rules import EDGES, RULES, SUBSYSTEMS, TOPICS, fact_names

RANK = {"crit": 3, "warn": 2, "info": 1, "ok": 0}


def severity_rank(severity: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in RANK.items() for x in p])[severity]


def facts(rates: DataFrame, gauges: DataFrame, variables: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """One row a capture, with one conditional aggregate for each fact that some rule reads.

    rates: capture_id, name, total, rate (A1-A3). gauges: capture_id, name, peak, last_value (A4, A5). variables: capture_id,
    name, value (J7). extra: capture_id and x_* columns. The list of facts is fixed, so no job looks for names."""

    def wide(rows: DataFrame, prefixes: dict[str, Column]) -> DataFrame:
        cols = [F.max(F.when(F.lower("name") == n[2:].lower(), prefixes[n[0]])).alias(n) for n in fact_names() if n[0] in prefixes]
        return rows.groupBy("capture_id").agg(*cols)

    parts = [wide(rates, {"r": F.col("rate"), "t": F.col("total")}), wide(gauges, {"m": F.col("peak"), "l": F.col("last_value")}), wide(variables, {"v": S.variable_double(F.col("value")), "s": F.trim("value")})]
    if extra is not None:
        parts.append(extra)
    return reduce(lambda a, b: a.join(b, "capture_id", "full_outer"), parts)


def evaluate(facts: DataFrame) -> DataFrame:
    """capture_id, rule_id, severity, metrics (name, value) of every rule that applies: one narrow pass over the facts."""
    have = set(facts.columns)
    missing = [n for n in fact_names() if n not in have]
    full = facts.select("*", *[F.lit(None).cast("string" if n[0] == "s" or n == "x_slow_state" else "double").alias(n) for n in missing])
    found = [F.struct(F.lit(r.id).alias("rule_id"), F.expr(r.severity).alias("severity"), F.array(*[F.struct(F.lit(m).alias("name"), F.col(m).cast("double").alias("value")) for m in r.metrics]).alias("metrics")) for r in RULES]
    return full.select("capture_id", F.explode(F.array(*found)).alias("f")).select("capture_id", "f.*").filter("severity is not null")


def category(id_: Column, title: Column, formula: Column) -> Column:
    """F19"""
    text = F.concat_ws(" ", id_, title, formula)
    saturation = ["wait", "pending", "overflow", "miss", "dirty", "full_join", "select_scan", "scan", "rnd_next", "disk", "metadata", "flushing", "saturation", "semaphore"]
    return F.when(id_ == "queryshape.observed_slow_processlist", "combined").when(S.any_token(text, ["error", "aborted"]), "error").when(S.any_token(text, saturation), "saturation").when(S.any_token(text, ["checkpoint_age", "ratio", "usage", "size", "cache", "utilization"]), "utilization").otherwise("combined")


def advice(texts: Column) -> Column:
    """each text with its kind; the first is to confirm, words that mitigate or check overrule, one at least confirms."""
    mitigate, check = ["increase", "raise", "move", "lower", "grow"], ["check", "confirm", "validate", "review", "inspect", "correlate"]
    kind = lambda t, i: F.when(S.any_token(t, check), "confirm").when(S.any_token(t, mitigate), "mitigate").when(i == 0, "confirm").otherwise("investigate")
    kinds = F.transform(texts, lambda t, i: F.struct(kind(t, i).alias("kind"), t.alias("text")))
    return F.when(F.exists(kinds, lambda k: k.kind == "confirm"), kinds).otherwise(F.transform(kinds, lambda k, i: F.struct(F.when(i == 0, "confirm").otherwise(k.kind).alias("kind"), k.text.alias("text"))))


def rule_dimension(spark: SparkSession) -> DataFrame:
    rows = [(r.id, r.subsystem, r.title, r.formula, r.topic, list(r.advice)) for r in RULES]
    dim = spark.createDataFrame(rows, "rule_id string, subsystem string, title string, formula string, topic string, texts array<string>")
    return dim.select("*", category(F.col("rule_id"), F.col("title"), F.col("formula")).alias("category"), advice(F.col("texts")).alias("advice")).drop("texts")


def related(rule_id: Column, fired: Column) -> Column:
    """(id, relationship) of the edges of a rule whose other end fired too, by id. No two edges have both ends in common."""
    edges = F.array(*[F.struct(F.lit(a).alias("from"), F.lit(b).alias("id"), F.lit(c).alias("relationship")) for a, b, c in EDGES])
    kept = F.filter(edges, lambda e: (e["from"] == rule_id) & F.array_contains(fired, e["id"]))
    return F.array_sort(F.transform(kept, lambda e: F.struct(e["id"].alias("id"), e["relationship"].alias("relationship"))))


def findings_table(facts: DataFrame) -> DataFrame:
    """Findings with evidence, advice, relations and their place in the capture's report. Relations are
    looked up in the set of a capture's findings, which needs the shuffle that the order needs; rules are evaluated once."""
    spark = facts.sparkSession
    found = evaluate(facts).withColumn("fired", F.collect_set("rule_id").over(Window.partitionBy("capture_id")))
    found = found.withColumn("related", related(F.col("rule_id"), F.col("fired")))
    evidence = F.transform("metrics", lambda m: F.struct(m["name"].alias("name"), m["value"].alias("value"), S.evidence_kind(m["name"]).alias("kind"), S.evidence_strength(m["name"], m["value"]).alias("strength")))
    rows = found.join(F.broadcast(rule_dimension(spark)), "rule_id")
    rows = rows.select("capture_id", "rule_id", "subsystem", "title", "topic", "category", "severity", severity_rank(F.col("severity")).alias("severity_rank"), S.confidence(F.col("severity"), F.size("metrics")).alias("confidence"), evidence.alias("evidence"), "advice", "related")
    subsystem = F.array_position(F.array(*map(F.lit, SUBSYSTEMS)), F.col("subsystem"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("capture_id").orderBy(subsystem, F.desc("severity_rank"), "rule_id")))


def top_drivers(findings: DataFrame, k: int = 3) -> DataFrame:
    """T6"""
    score = F.col("severity_rank") * 100 + F.when(F.col("confidence") == "high", 30).when(F.col("confidence") == "medium", 20).otherwise(10) + 3 * F.least(F.size("evidence"), F.lit(4)) + 2 * F.least(F.size("related"), F.lit(3))
    subsystem = F.array_position(F.array(*map(F.lit, SUBSYSTEMS)), F.col("subsystem"))
    scored = findings.filter("severity <> 'ok'").withColumn("score", score)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("capture_id").orderBy(F.desc("score"), subsystem, "rule_id"))).filter(F.col("rank") <= k)


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings of each capture by severity, in columns that are known beforehand."""
    return findings.groupBy("capture_id").pivot("severity", list(RANK)).count().na.fill(0, list(RANK))


def coverage_map(findings: DataFrame) -> DataFrame:
    """Topics with their rules and the captures in which one of them fired."""
    topics = findings.sparkSession.createDataFrame(TOPICS, "topic string, subsystem string, coverage string")
    rules = findings.sparkSession.createDataFrame([(r.topic, r.id) for r in RULES], "topic string, rule_id string").groupBy("topic").agg(F.count("*").alias("rules"))
    fired = findings.filter("severity in ('crit', 'warn')").groupBy("topic").agg(F.count_distinct("capture_id").alias("captures"))
    return topics.join(rules, "topic", "left").join(fired, "topic", "left").select("topic", "subsystem", "coverage", F.coalesce("rules", F.lit(0)).alias("rules"), F.coalesce("captures", F.lit(0)).alias("captures"))
