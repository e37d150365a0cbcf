"""Counter and gauge operators on events: a user is a capture, a week a snapshot, an event type a counter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.catalog import query
from capturelake.deploy import written
from capturelake.functions import scalar as S
from capturelake.operators import deltas as D
from capturelake.operators import series_index as X

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """capture_id, snapshot (week number), name, ts (microseconds), seq, seconds, raw."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, CAST(ts AS TIMESTAMP_NTZ))")
    return events.select(F.col("user_id").alias("capture_id"), F.floor(us / F.lit(604800000000)).alias("snapshot"), F.col("event_type").alias("name"), us.alias("ts"), F.col("event_id").alias("seq"), F.floor(us / 1_000_000).alias("seconds"), F.round(F.col("value") * 100).cast("bigint").alias("raw"))


S_SQL = """s AS (SELECT user_id AS capture_id, CAST(floor(epoch_us(ts) / 604800000000) AS BIGINT) AS snapshot, event_type AS name, epoch_us(ts) AS ts, event_id AS seq,
        CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS seconds, CAST(round(value * 100) AS BIGINT) AS raw FROM events),
d AS (SELECT *, raw - lag(raw) OVER (PARTITION BY capture_id, name, snapshot ORDER BY ts, seq) AS delta FROM s)"""
T_SQL = f"""WITH {S_SQL},
t AS (SELECT capture_id, name, CASE WHEN count(*) >= 2 THEN coalesce(sum(delta), 0) END AS total FROM d GROUP BY ALL),
o AS (SELECT capture_id, sum(span) AS observed_seconds FROM (SELECT capture_id, snapshot, max(seconds) - min(seconds) AS span FROM s GROUP BY ALL) GROUP BY ALL)"""


@query(f"WITH {S_SQL} SELECT capture_id, name, seq, delta FROM d")
def counter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.counter_delta(samples(spark, sf_dir)).select("capture_id", "name", "seq", "delta")


@query(f"WITH {S_SQL} SELECT capture_id, snapshot, name, count(*) - count(delta) AS resets FROM d GROUP BY ALL")
def snapshot_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.counter_delta(samples(spark, sf_dir)).groupBy("capture_id", "snapshot", "name").agg((F.count("*") - F.count("delta")).alias("resets"))


@query(f"""{T_SQL}, g AS (SELECT capture_id, name, max(raw) AS peak, arg_max(raw, (snapshot, ts, seq)) AS last_value FROM s GROUP BY ALL)
SELECT t.capture_id, t.name, t.total, o.observed_seconds, CASE WHEN o.observed_seconds > 0 THEN t.total / o.observed_seconds END AS rate, g.peak, g.last_value FROM t JOIN o ON o.capture_id = t.capture_id JOIN g ON g.capture_id = t.capture_id AND g.name = t.name""")
def merged_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 to A5 from states of three parts of the samples, which merge; no part is read again."""
    from capturelake.operators import state as C

    rows = samples(spark, sf_dir)
    parts = [C.counter_state(rows.filter(F.col("seq") % 3 == i)) for i in range(3)]
    return C.counters_of(C.merge_counter_state(parts[0].unionByName(parts[1]).unionByName(parts[2])))


def _polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth event is a poll that failed, so that gaps occur."""
    from pyspark.sql import Window

    idx = F.row_number().over(Window.partitionBy("capture_id", "name", "snapshot").orderBy("ts", "seq"))
    return samples(spark, sf_dir).withColumn("poll_idx", idx).filter("seq % 5 <> 0")


N_SQL = f"""WITH {S_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY capture_id, name, snapshot ORDER BY ts, seq) AS poll_idx FROM s),
q AS (SELECT * FROM p WHERE seq % 5 <> 0),
b AS (SELECT *, lag(raw) OVER w AS r0, lag(poll_idx) OVER w AS i0, lag(seconds) OVER w AS s0 FROM q WINDOW w AS (PARTITION BY capture_id, name, snapshot ORDER BY ts, seq)),
n AS (SELECT *, CASE WHEN i0 = poll_idx - 1 AND raw >= r0 THEN raw - r0 END AS delta FROM b)"""


@query(f"{N_SQL} SELECT capture_id, name, seq, delta FROM n")
def net_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.net_delta(_polls(spark, sf_dir)).select("capture_id", "name", "seq", "delta")


@query(f"{N_SQL} SELECT capture_id, name, seq, round(CASE WHEN seconds > s0 THEN delta / (seconds - s0) END, 6) AS rate FROM n")
def net_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.net_rate(_polls(spark, sf_dir)).select("capture_id", "name", "seq", F.round("rate", 6).alias("rate"))


@query(f"{T_SQL} SELECT capture_id, name, CASE WHEN name <> 'signup' THEN CAST(total AS BIGINT) END AS total FROM t")
def counter_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups are a gauge."""
    rows = samples(spark, sf_dir).withColumn("is_counter", F.col("name") != "signup")
    return D.counter_total(D.counter_delta(rows))


@query(f"{T_SQL} SELECT capture_id, CAST(observed_seconds AS BIGINT) AS observed_seconds FROM o")
def observed_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.observed_seconds(samples(spark, sf_dir))


@query(f"{T_SQL} SELECT t.capture_id, name, CAST(total AS BIGINT) AS total, CAST(observed_seconds AS BIGINT) AS observed_seconds, round(CASE WHEN observed_seconds > 0 THEN total / observed_seconds END, 9) AS rate FROM t JOIN o ON t.capture_id = o.capture_id")
def counter_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.counter_rate(samples(spark, sf_dir)).select("capture_id", "name", "total", "observed_seconds", F.round("rate", 9).alias("rate"))


@query(f"WITH {S_SQL} SELECT capture_id, name, max(CASE WHEN name = 'signup' THEN raw END) AS peak FROM s GROUP BY ALL")
def gauge_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups are a gauge, the others counters."""
    return D.gauge_max(samples(spark, sf_dir).withColumn("is_counter", F.col("name") != "signup"))


@query(f"WITH {S_SQL} SELECT capture_id, name, arg_max(raw, (snapshot, ts, seq)) AS last_value FROM s WHERE raw IS NOT NULL GROUP BY ALL")
def gauge_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.gauge_last(samples(spark, sf_dir))


@query(f"WITH {S_SQL} SELECT capture_id, name, CAST(sum(delta) AS BIGINT) AS total, min(delta) AS low, max(delta) AS high, CAST(trunc(CAST(sum(delta) AS DOUBLE) / (count(delta) + 1)) AS BIGINT) AS whole_mean, round(CASE WHEN count(delta) > 0 THEN sum(delta) / count(delta) END, 6) AS mean FROM d GROUP BY ALL")
def counter_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.counter_profile(D.counter_delta(samples(spark, sf_dir))).withColumn("mean", F.round("mean", 6))


B_SQL = f"""WITH {S_SQL}, b AS (SELECT *, sum(CASE WHEN delta IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id, name ORDER BY ts, seq) AS block, greatest(coalesce(delta, 0), 0) AS step FROM d)"""


@query(f"{B_SQL} SELECT capture_id, name, CAST(block AS BIGINT) AS block, count(*) AS n, min(seconds) AS begins, max(seconds) AS ends FROM b GROUP BY ALL")
def finite_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = D.finite_blocks(D.counter_delta(samples(spark, sf_dir)))
    return got.groupBy("capture_id", "name", "block").agg(F.count("*").alias("n"), F.min("seconds").alias("begins"), F.max("seconds").alias("ends"))


HALF_DAY = 43200
R_SQL = f"""{B_SQL}, c AS (SELECT *, sum(step) OVER (PARTITION BY capture_id, name, block ORDER BY ts, seq) AS cum FROM b),
a AS (SELECT c.*, (SELECT max((x.seconds, x.ts, x.seq, x.cum)) FROM c x WHERE x.capture_id = c.capture_id AND x.name = c.name AND x.block = c.block AND x.seconds <= c.seconds - {HALF_DAY}) AS anchor FROM c),
g AS (SELECT capture_id, name, block, max(seconds) - min(seconds) AS span, sum(step) AS total FROM c GROUP BY ALL),
l AS (SELECT capture_id, name, max((span, CASE WHEN span > 0 THEN total / span END)) AS longest FROM g GROUP BY ALL),
f AS (SELECT capture_id, name, max(CASE WHEN anchor IS NOT NULL AND seconds > anchor[1] THEN (cum - anchor[4]) / (seconds - anchor[1]) END) AS full_peak FROM a GROUP BY ALL)"""


@query(f"{R_SQL} SELECT f.capture_id, f.name, round(coalesce(full_peak, longest[2]), 6) AS peak_rate, full_peak IS NOT NULL AS full_window FROM f JOIN l ON f.capture_id = l.capture_id AND f.name = l.name")
def rolling_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.rolling_peak(D.counter_delta(samples(spark, sf_dir)), HALF_DAY).withColumn("peak_rate", F.round("peak_rate", 6))


@query(f"{B_SQL}, c AS (SELECT *, sum(step) OVER (PARTITION BY capture_id, name, block ORDER BY ts, seq) AS cum FROM b) SELECT c.capture_id, c.name, c.seq, x.seconds AS anchor FROM c ASOF LEFT JOIN (SELECT capture_id, name, block, seconds, seconds + {HALF_DAY} AS due FROM (SELECT DISTINCT capture_id, name, block, seconds FROM c)) x ON c.capture_id = x.capture_id AND c.name = x.name AND c.block = x.block AND c.seconds >= x.due")
def asof_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    by_time = Window.partitionBy("capture_id", "name", "block").orderBy("seconds").rangeBetween(Window.unboundedPreceding, -HALF_DAY)
    return D.finite_blocks(D.counter_delta(samples(spark, sf_dir))).select("capture_id", "name", "seq", F.max("seconds").over(by_time).alias("anchor"))


W_SQL = "CASE WHEN seconds BETWEEN least(lo, hi) AND greatest(lo, hi) THEN raw END"


@query(f"WITH {S_SQL}, e AS (SELECT max(seconds) - 86400 * 10 AS lo, max(seconds) - 86400 * 20 AS hi FROM s), v AS (SELECT capture_id, name, {W_SQL} AS v FROM s, e) SELECT capture_id, name, min(v) AS low, max(v) AS high, round(sum(v) / nullif(count(v), 0), 6) AS mean, count(v) AS n FROM v GROUP BY ALL")
def windowed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    end = rows.agg(F.max("seconds")).scalar()
    return D.windowed_stats(rows, end - 86400 * 10, end - 86400 * 20).withColumn("mean", F.round("mean", 6))


BUCKET_SQL = f"""WITH {S_SQL}, c AS (SELECT capture_id, greatest(1, floor((max(seconds) - min(seconds)) / 30)) AS want FROM s GROUP BY ALL),
k AS (SELECT capture_id, CASE {' '.join(f'WHEN want <= {x} THEN {x}' for x in D.STEPS)} ELSE {D.STEPS[-1]} END AS step FROM c),
r AS (SELECT s.capture_id, name, CASE WHEN count(*) > 1 AND (max(seconds) - min(seconds)) / (count(*) - 1) < 0.9 * any_value(step) THEN any_value(step) END AS step FROM s JOIN k ON s.capture_id = k.capture_id GROUP BY ALL)
SELECT s.capture_id, s.name, CASE WHEN step IS NULL THEN seconds ELSE seconds // step * step END AS bucket, round(sum(raw) / count(raw), 6) AS mean, count(*) AS n
FROM s JOIN r ON s.capture_id = r.capture_id AND s.name = r.name WHERE raw IS NOT NULL GROUP BY ALL"""


@query(BUCKET_SQL)
def time_bucket_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.time_bucket_mean(samples(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query(BUCKET_SQL)
def bucket_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25 from a series index that is written once."""
    return X.bucket_means(written(X.series_index(samples(spark, sf_dir)))).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {S_SQL}, e AS (SELECT max(seconds) AS until FROM s), w AS (SELECT capture_id, window_id, until - 86400 * (3 * window_id + capture_id % 5) AS lo, until - 86400 * (4 * window_id + capture_id % 5 + 1) AS hi FROM (SELECT DISTINCT capture_id FROM s), (SELECT unnest(range(12)) AS window_id), e),
k AS (SELECT DISTINCT capture_id, name FROM s)
SELECT k.capture_id, k.name, w.window_id, CAST(min(raw) AS DOUBLE) AS low, CAST(max(raw) AS DOUBLE) AS high, round(sum(raw) / nullif(count(raw), 0), 6) AS mean, count(raw) AS n
FROM k JOIN w ON w.capture_id = k.capture_id LEFT JOIN s ON s.capture_id = k.capture_id AND s.name = k.name AND s.seconds BETWEEN least(lo, hi) AND greatest(lo, hi) GROUP BY ALL""")
def many_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24 for twelve windows a capture, from a series index that is written once."""
    rows = samples(spark, sf_dir)
    index = written(X.series_index(rows))
    until = index.agg(F.max("until")).scalar()
    ids = index.select("capture_id").distinct().select("capture_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("window_id"))
    day = lambda k: until - 86400 * (F.col("window_id") * k + F.col("capture_id") % 5 + (k - 3))
    windows = ids.select("capture_id", "window_id", day(3).alias("lo"), day(4).alias("hi"))
    return X.windowed_stats(index, windows).withColumn("mean", F.round("mean", 6))


@query(f"WITH {S_SQL} SELECT capture_id, seq, snapshot * 604800 + row_number() OVER (PARTITION BY capture_id, snapshot ORDER BY ts, seq) - 1 AS at FROM s")
def sample_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("start", F.col("snapshot") * 604800)
    return D.sample_axis(rows, ["capture_id", "snapshot"], ["ts", "seq"], "start").select("capture_id", "seq", "at")


@query(f"""WITH {S_SQL}, c AS (SELECT *, seconds % 86400 AS clock FROM s),
r AS (SELECT *, CASE WHEN clock < lag(clock) OVER w THEN 1 ELSE 0 END AS fell, first(clock) OVER w - 43000 AS off FROM c WINDOW w AS (PARTITION BY capture_id, snapshot ORDER BY ts, seq))
SELECT capture_id, seq, clock + (CAST(sum(fell) OVER (PARTITION BY capture_id, snapshot ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) + CASE WHEN off > 43200 THEN -1 WHEN off < -43200 THEN 1 ELSE 0 END) * 86400 AS at FROM r""")
def midnight_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("clock", F.col("seconds") % 86400).withColumn("start_clock", F.lit(43000)).withColumn("o", F.struct("ts", "seq"))
    return D.midnight_roll(rows, ["capture_id", "snapshot"], "o").select("capture_id", "seq", "at")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)
SELECT doc_id, n, last_value(CASE WHEN length(line) < 40 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS section FROM l""")
def section_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents; a line of fewer than 40 characters is a header."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return D.section_scope(lines, ["doc_id"], "n", F.when(F.char_length("line") < 40, F.col("line"))).select("doc_id", F.col("n").cast("bigint").alias("n"), "section")
