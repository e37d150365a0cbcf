"""Operators on small tables: resets, gaps, ties, runs, rules."""

import re

from pyspark.sql import functions as F

from capturelake.functions import scalar as S
from capturelake.operators import deltas as D
from capturelake.operators import densify as N
from capturelake.operators import sizing as Z
from capturelake.operators import threads as T
from capturelake.operators import variables as V
from capturelake.plans import findings as P
from capturelake.plans.rules import EDGES, RULES, SUBSYSTEMS, TOPICS

SAMPLES = "capture_id long, snapshot long, name string, ts long, seq long, seconds long, raw long"


def series(spark, values, snapshot=1, name="x"):
    return spark.createDataFrame([(1, snapshot, name, i, i, i * 10, v) for i, v in enumerate(values) if v != "gap"], SAMPLES)


def test_three_reset_policies(spark):
    s = series(spark, [10, 15, 3, None, 8])
    assert [r.delta for r in D.counter_delta(s).orderBy("seq").collect()] == [None, 5, -12, None, 5]
    assert D.counter_total(D.counter_delta(s)).first().total == -2
    polls = s.withColumn("poll_idx", F.col("seq"))
    assert [r.delta for r in D.net_delta(polls).orderBy("seq").collect()] == [None, 5, None, None, None]
    assert D.rolling_peak(D.counter_delta(series(spark, [10, 15, 3, 8])), 1000).first().peak_rate == 10 / 30


def test_snapshots_reset_and_gaps_do_not_count(spark):
    s = series(spark, [1, 5]).union(series(spark, [100, 101, 103], 2).withColumn("seconds", F.col("seconds") + 5000))
    r = D.counter_rate(s).first()
    assert (r.total, r.observed_seconds, r.rate) == (7, 30, 7 / 30)
    assert D.counter_total(D.counter_delta(series(spark, [4]))).first().total is None


def test_rolling_peak_needs_a_full_window(spark):
    burst = series(spark, [0, 0, 0, 1000, 1000, 1000, 1000])
    got = D.rolling_peak(D.counter_delta(burst), 30).first()
    assert got.full_window and got.peak_rate == 1000 / 30  # not 1000 / 10
    short = D.rolling_peak(D.counter_delta(burst), 600).first()
    assert not short.full_window and short.peak_rate == 1000 / 60


def test_time_buckets(spark):
    dense = spark.createDataFrame([(1, 1, "x", i, i, i, i) for i in range(0, 1200)], SAMPLES)
    got = D.time_bucket_mean(dense).orderBy("bucket").collect()
    assert len(got) == 20 and got[0].mean == 29.5 and got[1].bucket == 60  # 1199 // 30 = 39 -> 60 s
    assert D.windowed_stats(dense, F.lit(10), F.lit(5)).first().asDict() == {"capture_id": 1, "name": "x", "low": 5, "high": 10, "mean": 7.5, "n": 6}
    assert D.windowed_stats(dense, F.lit(-5), F.lit(-1)).first().n == 0


def test_runs_and_changes(spark):
    settings = {1: "a", 2: "a", 4: "a", 5: "b", 6: "a"}
    variables = spark.createDataFrame([(1, s, n, v) for s, x in settings.items() for n, v in (("mode", x), ("gtid_executed", str(s)))], "c long, s long, name string, value string")
    snapshots = spark.createDataFrame([(1, s) for s in range(1, 7)], "c long, s long")
    runs = {r.s: r.run_no for r in V.variable_runs(variables, snapshots, "c", "s").collect()}
    assert runs == {1: 1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5}  # A A gap A B A
    changed = {(r.s, r.name, r.value, r.old_value) for r in V.changed_variables(variables, snapshots, "c", "s").collect()}
    assert changed == {(5, "mode", "b", "a"), (6, "mode", "a", "b")}


def test_versions(spark):
    seen = spark.createDataFrame([(1, "8.10.1", "x", "ON, off"), (2, "8.1", "x", "2"), (3, "5.7", "x", "1"), (4, "10.4", "X", "new ")], "capture_id long, version string, name string, value string")
    defaults = spark.createDataFrame([("x", "8.0", "1"), ("x", "8.2", "OFF,on"), ("X", "10.3", "NEW"), ("x", "10.10", "z")], "name string, version string, default_value string")
    assert {r.capture_id: r.status for r in V.classify_variable(seen, defaults).collect()} == {1: "default", 2: "modified", 3: "unknown", 4: "default"}


def test_top_processes(spark):
    rows = [("h", 1, "a", 1, 5.0, 1), ("h", 2, "b", 1, 5.0, 2), ("h", 3, "c", 1, 9.0, 3), ("h", 4, "d", 2, 8.0, 4), ("h", 5, "MySQLd", 2, 0.5, 5), ("h", 3, "c", 1, 7.0, 6)]
    df = spark.createDataFrame(rows, "host string, pid long, command string, t long, cpu double, seq long")
    got = N.top_processes(df, ["host"], "pid", "command", "t", "cpu").orderBy("rank").collect()
    assert [(r.pid, r.mean_cpu, r["rank"]) for r in got] == [(4, 4.0, 1), (3, 3.5, 2), (2, 2.5, 3), (5, 0.25, 5)]


def test_normalize(spark):
    cases = {
        "SELECT  'it''s' ,\n\"a\\\"b\" FROM `T1` WHERE x=0xFF AND y=12.5 AND t2=3": "select ? , ? from `t1` where x=? and y=? and t2=?",
        "select '" + "x" * 50000 + "'": "select ?", "select '" + "''" * 20000 + "'": "select ?", "a 'abc'def'": "a ?def'", "  ": "",
    }
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i long, q string")
    got = [r.n for r in df.select("i", S.normalize_query(F.col("q")).alias("n")).orderBy("i").collect()]
    assert got == list(cases.values())


def test_digest_takes_the_slowest_sighting(spark):
    rows = [(1, "u1", "Query", "s1", "select 1", 1, 1, None), (1, "u2", "Query", "s2", "select 2", 2, 2, 50), (1, "u3", "Query", "s3", "SELECT  3", 3, 3, 50), (1, "u4", "Sleep", "s", "select 4", 4, 4, 99), (1, "u5", "Query", "s", "NULL", 5, 5, 99)]
    df = spark.createDataFrame(rows, "c long, user string, command string, state string, info string, ts long, seq long, time_ms long").withColumn("db", F.lit("d")).withColumn("rows_examined", F.col("seq")).withColumn("rows_sent", F.lit(None).cast("long"))
    (r,) = T.query_digest(T.active_queries(df), ["c"]).collect()
    assert (r.sightings, r.user, r.state, r.first_seen, r.last_seen, r.max_time_ms, r.max_rows_examined, r.max_rows_sent) == (3, "u2", "s2", 1, 3, 50, 3, None)


def test_sizing_states(spark):
    s = spark.createDataFrame([(c, 1, "w", i, i, i * 100, c * i * 1000) for c in (1, 2) for i in range(20)] + [(3, 1, "w", i, i, i * 100, 5) for i in range(20)], SAMPLES)
    cap = spark.createDataFrame([(1, 600000.0), (3, 10.0), (4, 10.0)], "capture_id long, capacity double")
    got = {r.capture_id: r for r in Z.redo_sizing(s, cap).collect()}
    assert {k: v.state for k, v in got.items()} == {1: "ok", 2: "config_missing", 3: "no_writes", 4: "rate_unavailable"}
    assert got[1].minutes == 1000 and got[1].peak_rate == 10 and not got[1].undersized


def test_scalars(spark):
    df = spark.createDataFrame([("10.0.0.1:33", "[::1]:5", "fe80::1", "1,5", "1.5", "x" * 161)], "a string, b string, c string, d string, e string, f string")
    r = df.select(S.strip_port(F.col("a")).alias("a"), S.strip_port(F.col("b")).alias("b"), S.strip_port(F.col("c")).alias("c"), S.localized_double(F.col("d")).alias("d"), S.localized_double(F.col("e")).alias("e"), F.length(S.bound_snippet(F.col("f"))).alias("f"), S.comma_set_equal(F.lit("b, A,"), F.lit("a,B")).alias("g"), S.comma_set_equal(F.lit("a,a"), F.lit("a")).alias("h")).first()
    assert tuple(r) == ("10.0.0.1", "[::1]", "fe80::1", 1.5, 1.5, 160, True, False)


def test_rule_dimension(spark):
    ids = [r.id for r in RULES]
    assert len(ids) == len(set(ids)) == 30 and len(EDGES) == 15 and len(TOPICS) == 14
    assert all(len(r.advice) >= 2 and r.metrics and r.subsystem in SUBSYSTEMS and r.topic in {t for t, *_ in TOPICS} for r in RULES)
    assert {x for a, b, _ in EDGES for x in (a, b)} <= set(ids)
    for r in P.rule_dimension(spark).collect():
        assert any(a.kind == "confirm" for a in r.advice)


def test_findings_from_facts(spark):
    rates = spark.createDataFrame([(1, "Innodb_buffer_pool_reads", 500.0, 5.0), (1, "Innodb_buffer_pool_read_requests", 1000.0, 10.0), (1, "Innodb_buffer_pool_wait_free", 1.0, 0.1), (2, "Questions", 1.0, 1.0)], "capture_id long, name string, total double, rate double")
    gauges = spark.createDataFrame([(1, "Threads_running", 60, 3), (1, "Innodb_buffer_pool_pages_free", 5, 5)], "capture_id long, name string, peak long, last_value long")
    variables = spark.createDataFrame([(1, "innodb_lru_scan_depth", "1024"), (1, "innodb_buffer_pool_instances", "8"), (2, "slow_query_log", "OFF")], "capture_id long, name string, value string")
    table = P.findings_table(P.facts(rates, gauges, variables))
    got = {(r.capture_id, r.rule_id): r for r in table.collect()}
    assert {k: v.severity for k, v in got.items()} == {(1, "bp.hit_ratio"): "crit", (1, "bp.free_pages_low"): "warn", (1, "bp.wait_free"): "crit", (1, "connections.saturation"): "warn", (1, "thread.max_queue_depth"): "warn", (2, "config.slow_log_disabled"): "warn"}
    assert [x.id for x in got[1, "bp.wait_free"].related] == ["bp.free_pages_low"] and got[1, "bp.wait_free"].evidence[0].strength == "strong"
    assert [r.rule_id for r in P.top_drivers(table).filter("capture_id = 1").orderBy("rank").collect()][:2] == ["bp.hit_ratio", "bp.wait_free"]
    assert {r.capture_id: (r.crit, r.warn, r.ok) for r in P.severity_counts(table).collect()} == {1: (2, 3, 0), 2: (0, 1, 0)}


def test_sql_names_are_registered():
    from capturelake import catalog

    names = catalog.queries()
    assert set(catalog.oracle_sql()) <= set(names) and len(names) > 130
    assert all(re.fullmatch(r"[a-z][a-z0-9_]*", n) for n in names)


def test_a_default_is_looked_up_for_each_row_without_multiplying_it(spark):
    seen = spark.createDataFrame([(1, "8.0.3", "X", "1"), (1, "5.7.1-log", "x", "0"), (2, "5.6.1", "x", "0"), (3, "9.1", "x", "b, A"), (4, "8.0", "y", "1"), (5, None, "x", "1")], "capture_id long, version string, name string, value string")
    known = spark.createDataFrame([("x", "5.7", "0"), ("X", "8.0", "1"), ("x", "8.10", "a,b"), ("y", "8.0", None)], "name string, version string, default_value string")
    got = V.classify_variable(seen, known)
    assert sorted((r.capture_id, r.name, r.status) for r in got.collect()) == [(1, "X", "default"), (1, "x", "default"), (2, "x", "unknown"), (3, "x", "default"), (4, "y", "modified"), (5, "x", "unknown")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_status_of_variables_joins_once(spark, tmp_path):
    from capturelake.queries import variables as Q

    spark.createDataFrame([(k, f"Brand#{k % 2 + 1}{k % 5 + 1}", k % 50 + 1) for k in range(300)], "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    every, some = Q.classify_variable(spark, str(tmp_path)), Q.variable_status(spark, str(tmp_path))
    assert every.count() == 300 and sorted(map(str, some.collect())) == sorted(str(r) for r in every.collect() if r.status == "modified")
    assert some._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_a_part_without_key_has_no_version_and_no_status_but_unknown(spark, tmp_path):
    from capturelake.queries import variables as Q

    spark.createDataFrame([(None, "Brand#12", 10), (None, "Brand#12", 10), (5, "Brand#12", 10), (6, "Brand#12", 10), (5, None, 10)], "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    every, some = Q.classify_variable(spark, str(tmp_path)), Q.variable_status(spark, str(tmp_path))
    want = [(5, "Brand#12", "modified"), (5, None, "unknown"), (6, "Brand#12", "default"), (None, "Brand#12", "unknown"), (None, "Brand#12", "unknown")]
    assert sorted(map(tuple, every.collect()), key=str) == sorted(want, key=str) and [tuple(r) for r in some.collect()] == want[:1]
