"""From capture files to facts and findings: which reader and which operator feeds which fact.

Files become mergeable states, a few rows a capture and snapshot; facts are made of merged states alone. So facts of a capture
that got a new snapshot need its old states and the new file, and none of its old files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.deploy import written
from capturelake.operators import state as C
from capturelake.operators import threads as T
from capturelake.operators import variables as V
from capturelake.plans import findings as P
from capturelake.sources import files as S
from capturelake.sources import readers as R

#: Part of a capture's state -> the collector it comes from.
PARTS = {"counters": "mysqladmin", "variables": "variables", "engine": "innodbstatus1", "queries": "processlist"}


def status_samples(status: DataFrame) -> DataFrame:
    """Rows of read_status in the form that the delta operators take."""
    return status.select("capture_id", F.col("prefix").alias("snapshot"), "name", "ts", F.col("sample_idx").alias("seq"), F.unix_seconds("ts").alias("seconds"), "raw", "is_counter")


def thread_samples(threads: DataFrame) -> DataFrame:
    """Active rows of read_threads in the form that the digest takes; of equally slow sightings the earliest counts."""
    aged = threads.withColumn("time_ms", F.coalesce("time_ms", F.col("time_s") * 1000)).withColumn("seq", F.unix_seconds("ts") * 1_000_000 + F.col("row_no"))
    return T.active_queries(aged)


def slow_queries(digests: DataFrame) -> DataFrame:
    """capture_id, x_slow_age_s, x_slow_state, x_slow_sightings: the first statement in the order of the ten slowest."""
    top = T.top_queries(digests, ["capture_id"], 1)
    return top.select("capture_id", (F.col("max_time_ms") / 1000).alias("x_slow_age_s"), F.col("state").alias("x_slow_state"), F.col("sightings").cast("double").alias("x_slow_sightings"))


def engine_facts(engine: DataFrame) -> DataFrame:
    """capture_id and the peaks of waiters and pending work over a capture's snapshots."""
    pending = sum((F.max(c) for c in ("pending_reads", "pending_writes", "pending_fsync_log", "pending_fsync_bp")), F.lit(0.0))
    return engine.groupBy("capture_id").agg(F.max("semaphore_count").alias("x_semaphores"), pending.alias("x_pending_total"), F.max("pending_writes_single_page").alias("x_pending_single_page"), F.max("pending_fsync_log").alias("x_pending_fsync_log"))


def states(spark: SparkSession, root: str, files: DataFrame, limit: int = S.SIZE_LIMIT) -> dict[str, DataFrame]:
    """Each part of the state of the captures that the files (of scan_files) belong to; unsupported files give none.

    All parts have capture_id, and are aggregated to a few rows a capture and snapshot."""
    read = {part: S.blocks(spark, root, collector, limit, True, files) for part, collector in PARTS.items()}
    return {
        "counters": C.counter_state(status_samples(R.read_status(read["counters"]))),
        "variables": R.read_variables(read["variables"]).select("capture_id", "prefix", "snapshot_ts", "name", "value"),
        "engine": R.read_engine(read["engine"]),
        "queries": T.digest_state(thread_samples(R.read_threads(read["queries"])), ["capture_id", "prefix"]),
    }


def facts_of(states: dict[str, DataFrame]) -> DataFrame:
    """All facts of the captures that have states; of a part without rows there are no facts, and its rules do not apply.

    Every part is keyed by capture and aggregated before parts meet, so the joins are of one row a capture."""
    counters = C.counters_of(C.merge_counter_state(states["counters"]))
    variables = V.latest_variable(states["variables"], "capture_id", "snapshot_ts")
    digests = T.digests_of(T.merge_digests(states["queries"].drop("prefix"), ["capture_id"]), ["capture_id"])
    extra = engine_facts(states["engine"]).join(slow_queries(digests), "capture_id", "full_outer")
    return P.facts(counters.select("capture_id", "name", "total", "rate"), counters.select("capture_id", "name", "peak", "last_value"), variables, extra)


def facts(spark: SparkSession, root: str, limit: int = S.SIZE_LIMIT) -> DataFrame:
    """All facts of every capture below root."""
    files = written(S.scan_files(spark, root))  # read once for each collector
    return facts_of({part: written(rows) for part, rows in states(spark, root, files, limit).items()})


def review(spark: SparkSession, root: str, limit: int = S.SIZE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """What became of every collector's files below root: their diagnostics (S25) and their status (S6); each file is read once.

    Diagnostics are those of the readers, and files above the limit, of an unsupported format, or passed over because a
    newer one of their kind is empty (S4, S5, S24). A file above the limit is not read, so it has failed."""
    files = written(S.scan_files(spark, root))
    whole = S.whole_files(files)
    formats = written(S.formats(files.join(whole.filter(F.col("size") <= limit).select("capture_id", "prefix", "suffix"), ["capture_id", "prefix", "suffix"], "left_semi")))
    foreign = formats.filter("format = 'unsupported'").select("capture_id", "prefix", "path", F.lit("file").alias("location"), F.lit("warning").alias("severity"), F.lit("unsupported format").alias("message"))
    said = S.oversize_files(whole, limit).select(*R.DIAGNOSTIC).unionByName(foreign).unionByName(S.sidecar_diagnostics(S.latest_sidecar(files)))
    status = None
    for collector in S.COLLECTORS:
        rows, rejects = R.read_both(collector, S.blocks(spark, root, collector, limit, True, files))
        rejects = written(rejects.select(*R.DIAGNOSTIC))
        said = said.unionByName(rejects)
        of = lambda df: df.filter(F.col("suffix") == collector)  # noqa: B023, E731
        one = S.file_status(of(files), rows, rejects, of(formats))
        status = one if status is None else status.unionByName(one)
    return said, status


def findings(spark: SparkSession, root: str, limit: int = S.SIZE_LIMIT) -> DataFrame:
    """S27 from files: the findings of every capture below root."""
    return P.findings_table(facts(spark, root, limit))
