"""New capture files to typed tables, facts and findings, once each, as they land.

The stream brings names of new files; tasks read them by blocks, as in batch. Every table has a folder for each batch, and a
batch that is repeated after a failure writes its own folders again, so each file counts once. Nothing else is kept
between batches: deltas start anew with every snapshot, and state merges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from capturelake.deploy import file_system, written
from capturelake.plans import findings as P
from capturelake.plans import fleet
from capturelake.sources import files as S
from capturelake.sources import tree as T

BUCKETS = 256


def new_files(spark: SparkSession, root: str) -> DataFrame:
    """A stream of path and size of files below root, at any depth; contents are not read."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true")
    return source.load(root).select("path", F.col("length").alias("size"))


def _of_batch(rows: DataFrame, root: str) -> DataFrame:
    """Files of a batch as scan_files gives them."""
    return S.named(rows.withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1)), root)


def stream_ingest(spark: SparkSession, root: str, suffix: str, reader: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, limit: int = S.SIZE_LIMIT) -> StreamingQuery:
    """Read every file of a collector that has come since the last call and append its rows to a Parquet table.

    Files above the limit and unsupported ones are left out, plain and gzipped ones are read."""
    top = T.absolute(spark, root)

    def batch(rows: DataFrame, number: int) -> None:
        files = written(_of_batch(rows, top).filter(F.col("suffix") == suffix))
        reader(S.blocks(rows.sparkSession, top, suffix, limit, True, files)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return new_files(spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _bucket() -> Column:
    return F.pmod(F.xxhash64("capture_id"), F.lit(BUCKETS)).cast("int")


def _until(spark: SparkSession, at: str, number: int, like: DataFrame) -> DataFrame:
    """A state table's rows of batches up to a number. One that was cut off, and is not yet repeated, does not count."""
    files, where = file_system(spark, at)
    names = [x.getPath().getName() for x in files.listStatus(where)]
    done = lambda n: files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{n}/_SUCCESS"))
    held = [f"{at}/{n}" for n in names if n.startswith("batch=") and int(n[6:]) <= number and done(n)]
    return spark.read.schema(like.schema).option("basePath", at).parquet(*held)


def update(spark: SparkSession, root: str, files: DataFrame, out: str, number: int, limit: int = S.SIZE_LIMIT) -> None:
    """Take in the files (of scan_files) as a batch: their state is added, and facts and findings of the captures that they
    belong to are made anew from state alone; all other captures keep theirs. The same batch again changes nothing."""
    files = written(files)
    touched = written(files.select("capture_id").distinct().withColumn("bucket", _bucket()))
    buckets = [r.bucket for r in touched.select("bucket").distinct().collect()]  # at most BUCKETS
    parts = {}
    for part, rows in fleet.states(spark, root, files, limit).items():
        rows, at = rows.withColumn("bucket", _bucket()), f"{out}/state/{part}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/batch={number}")
        held = _until(spark, at, number, rows).filter(F.col("bucket").isin(buckets))
        parts[part] = held.join(touched.select("capture_id"), "capture_id", "left_semi")
    fleet.facts_of(parts).write.mode("overwrite").parquet(f"{out}/facts/batch={number}")
    P.findings_table(spark.read.parquet(f"{out}/facts/batch={number}")).write.mode("overwrite").parquet(f"{out}/findings/batch={number}")


def current(spark: SparkSession, out: str, table: str) -> DataFrame:
    """facts or findings as they stand: of each capture the rows of the last batch that it had files in.

    A capture that has no findings any more has none: its last batch is looked up in the facts."""
    newest = spark.read.parquet(f"{out}/facts").groupBy("capture_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/{table}").join(newest, ["capture_id", "batch"], "left_semi").drop("batch")


def stream_findings(spark: SparkSession, root: str, out: str, checkpoint: str, limit: int = S.SIZE_LIMIT) -> StreamingQuery:
    """Keep facts and findings of all captures below root up to date with the files that have come since the last call."""
    top = T.absolute(spark, root)

    def batch(rows: DataFrame, number: int) -> None:
        update(rows.sparkSession, top, _of_batch(rows, top), out, number, limit)

    return new_files(spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
