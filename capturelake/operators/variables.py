"""Server variables: signatures, runs of equal settings, changes, defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturelake.functions import scalar as S
from capturelake.operators.deltas import collapse_runs

VOLATILE = ["gtid_executed", "gtid_purged"]


def variable_signature(variables: DataFrame, keys: list[str]) -> DataFrame:
    """order-free hash of a snapshot's settings without the volatile ones."""
    pair = F.concat_ws("=", F.col("name"), F.coalesce("value", F.lit("")))
    stable = ~F.lower("name").isin(VOLATILE)
    return variables.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.when(stable, pair))), "\n"), 256).alias("signature"))


def capture_fingerprint(files: DataFrame) -> DataFrame:
    """twelve hex digits over the host name, snapshots and file sizes; paths do not count."""
    item = F.concat_ws(":", "snapshot", "suffix", F.col("size").cast("string"))
    return files.groupBy("capture_id").agg(F.substring(F.sha2(F.concat_ws("\n", F.coalesce(F.max("hostname"), F.lit("")), F.array_join(F.array_sort(F.collect_list(item)), "\n")), 256), 1, 12).alias("fingerprint"))


def variable_runs(variables: DataFrame, snapshots: DataFrame, capture: str, snapshot: str) -> DataFrame:
    """W6 over all of a capture's snapshots, those without variables included."""
    sig = variable_signature(variables, [capture, snapshot])
    return collapse_runs(snapshots.join(sig, [capture, snapshot], "left"), [capture], [snapshot])


def changed_variables(variables: DataFrame, snapshots: DataFrame, capture: str, snapshot: str) -> DataFrame:
    """Settings of each run's first snapshot that differ from the run before, or are not in it.

    The first run, and a run behind a gap, has nothing to differ from; volatile names never count."""
    runs = variable_runs(variables, snapshots, capture, snapshot)
    first = runs.filter("signature is not null").groupBy(capture, "run_no").agg(F.min(snapshot).alias(snapshot))
    kept = variables.join(first, [capture, snapshot]).filter(~F.lower("name").isin(VOLATILE))
    before = kept.select(capture, (F.col("run_no") + 1).alias("run_no"), "name", F.col("value").alias("old_value"), F.lit(True).alias("had"))
    has_before = first.select(capture, (F.col("run_no") + 1).alias("run_no"))
    now = kept.join(has_before, [capture, "run_no"], "left_semi").join(before, [capture, "run_no", "name"], "left")
    return now.filter(F.col("had").isNull() | ~F.col("value").eqNullSafe(F.col("old_value"))).select(capture, snapshot, "run_no", "name", "value", "old_value")


def latest_variable(variables: DataFrame, capture: str, snapshot: str) -> DataFrame:
    """A name's value in the newest snapshot that has it, whatever its case."""
    return variables.groupBy(capture, F.lower("name").alias("name")).agg(F.max_by("value", snapshot).alias("value"))


def classify_variable(observed: DataFrame, defaults: DataFrame) -> DataFrame:
    """Modified, default or unknown against the default of the server's version or the highest one below it.

    observed: capture_id, version, name, value. defaults: name, version, default_value (a dimension that users supply). A name's
    defaults become one array in the order of versions, so an observed row meets one row and is never multiplied by versions.
    A name that newer versions alone document is unknown."""
    key = S.version_key(S.major_version(F.col("version")))
    seen = observed.withColumn("have", key).withColumn("n", F.lower("name"))
    known = defaults.select(F.lower("name").alias("n"), F.struct(S.version_key(F.col("version")).alias("at"), "default_value").alias("known"))
    known = known.groupBy("n").agg(F.array_sort(F.collect_list("known")).alias("known"))
    out = seen.join(known, "n", "left").withColumn("best", F.try_element_at(F.filter("known", lambda k: k["at"] <= F.col("have")), F.lit(-1)))
    a, b = F.lower(F.trim("value")), F.lower(F.trim("best.default_value"))
    same = (a == b) | S.comma_set_equal(F.col("value"), F.col("best.default_value"))
    return out.select("capture_id", "name", F.when(F.col("best").isNull(), "unknown").when(F.coalesce(same, F.lit(False)), "default").otherwise("modified").alias("status"))
