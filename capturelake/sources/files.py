"""Capture files: discovery, format, blocks and lines in file order, and landing of text files.

A capture is a folder, at any depth below the root, that holds files <YYYY_MM_DD_hh_mm_ss>-<collector>, plain or gzipped; its
name is its path from the root on, so equally named folders of two hosts are two captures. A folder with the name of a
capture file whose part files are in it, as Spark writes it, is read as one file. Nothing here opens a file on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capturelake.deploy import shared_folder  # noqa: F401
from capturelake.functions.fixed import SUMMARIES
from capturelake.functions.scalar import snapshot_ts
from capturelake.sources import blocks as B
from capturelake.sources import tree as T

#: A path from the root on: folder, snapshot, collector, and the name of a part.
NAME = r"^(?:(.*)/)?(?:file=)?(\d{4}(?:_\d\d){5})-([A-Za-z0-9_]+?)(?:\.gz)?(?:/([^/]*))?$"
#: Name of a capture that is the root itself.
ROOT = "."
COLLECTORS = ["iostat", "top", "variables", "vmstat", "meminfo", "innodbstatus1", "mysqladmin", "processlist", "netstat", "netstat_s"]
SIDECARS = ["hostname", "meminfo", "procstat", "sysctl", "top", "df", "output"]
SIZE_LIMIT = 200 << 20


def _capture(folder: Column) -> Column:
    """Name of the capture of a folder, given from the root on."""
    bare = F.regexp_replace(F.coalesce(folder, F.lit("")), "(^|/)capture=", "$1")
    return F.when(bare == "", ROOT).otherwise(bare)


def named(files: DataFrame, root: str, max_depth: int = T.MAX_DEPTH) -> DataFrame:
    """Of path, name and size below root: capture_id, prefix, suffix, path, size, snapshot_ts, folder of capture files and summaries.

    Hidden folders, and those more than max_depth below root, are left out. A summary has no prefix; it makes its folder a capture."""
    at = T.relative(root)
    rows = files.withColumn("rel", at).withColumn("folder", F.when(F.col("name").isin(SUMMARIES), F.regexp_extract("rel", r"^(?:(.*)/)?[^/]*$", 1)).otherwise(F.regexp_extract("rel", NAME, 1)))
    prefix = F.nullif(F.regexp_extract("rel", NAME, 2), F.lit(""))
    suffix = F.when(F.col("name").isin(SUMMARIES), "summary").otherwise(F.nullif(F.regexp_extract("rel", NAME, 3), F.lit("")))
    rows = rows.withColumn("prefix", prefix).withColumn("suffix", suffix).filter("suffix is not null")
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    rows = rows.filter((depth <= max_depth) & ~F.concat(F.lit("/"), F.col("folder")).contains("/."))
    return rows.select(_capture(F.col("folder")).alias("capture_id"), "prefix", "suffix", "path", "size", snapshot_ts(F.col("prefix")).alias("snapshot_ts"), "folder")


def scan_files(spark: SparkSession, root: str, max_depth: int = T.MAX_DEPTH) -> DataFrame:
    """capture_id, prefix, suffix, path, size, snapshot_ts, folder of every capture file, empty ones too; contents are not read."""
    return named(T.listing(spark, root, max_depth), T.absolute(spark, root), max_depth)


def whole_files(files: DataFrame) -> DataFrame:
    """Files of scan_files with their parts in one: capture_id, prefix, suffix, path, parts, size."""
    path = F.regexp_replace("path", r"(/(?:file=)?\d{4}(?:_\d\d){5}-[A-Za-z0-9_]+(?:\.gz)?)/[^/]*$", "$1")
    of = files.filter("prefix is not null").groupBy("capture_id", "prefix", "suffix", path.alias("path"))
    return of.agg(F.array_sort(F.collect_list(F.struct("path", "size"))).alias("parts"), F.sum("size").alias("size"))


def capture_roots(files: DataFrame) -> DataFrame:
    """The folders that hold capture files or summaries: each is a capture."""
    return files.groupBy("capture_id", "folder").agg(F.count("*").alias("files"))


def snapshots(files: DataFrame) -> DataFrame:
    """S3: a capture's snapshots by time; one without a known collector gets one made up from its earliest file."""
    known = files.filter(F.col("suffix").isin(COLLECTORS))
    real = known.groupBy("capture_id", "prefix").agg(F.min("snapshot_ts").alias("snapshot_ts"), F.array_sort(F.collect_set("suffix")).alias("collectors"))
    lone = files.join(known.select("capture_id").distinct(), "capture_id", "left_anti").groupBy("capture_id").agg(F.coalesce(F.min("prefix"), F.lit("unknown")).alias("prefix"), F.min("snapshot_ts").alias("snapshot_ts"))
    every = real.unionByName(lone.withColumn("collectors", F.array().cast("array<string>")))
    return every.withColumn("snapshot_no", F.row_number().over(Window.partitionBy("capture_id").orderBy("snapshot_ts", "prefix")))


def oversize_files(files: DataFrame, limit: int = SIZE_LIMIT) -> DataFrame:
    """A diagnostic for each file above the limit; the job goes on without it."""
    return files.filter(F.col("size") > limit).select("capture_id", "prefix", "path", F.lit("file").alias("location"), F.lit("error").alias("severity"), F.concat(F.lit("larger than "), F.lit(str(limit)), F.lit(" bytes")).alias("message"))


def blocks(spark: SparkSession, root: str, suffix: str, limit: int = SIZE_LIMIT, gate: bool = False, files: DataFrame | None = None, size: int = B.RANGE) -> DataFrame:
    """capture_id, prefix, start, path, part, sample, n, text: the samples of a collector's files (see sources.blocks).

    Files above the limit are left out; with gate, so are those whose format is not supported. A tree that was listed before
    (files) is not listed again."""
    found = (scan_files(spark, root) if files is None else files).filter(F.col("suffix") == suffix)
    rows = B.read_blocks(whole_files(found).filter(F.col("size") <= limit), limit, gate, size, T.absolute(spark, root))
    return rows.withColumn("start", snapshot_ts(F.col("prefix")))


def as_lines(blocks: DataFrame) -> DataFrame:
    """capture_id, prefix, start, path, piece (the block's first line), n, line of blocks; lines pass as they are."""
    if "text" not in blocks.columns:
        return blocks if "piece" in blocks.columns else blocks.withColumn("piece", F.lit(1).cast("long"))
    rows = blocks.select("capture_id", "prefix", "start", "path", F.col("n").alias("first"), F.posexplode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("i", "line"))
    return rows.select("capture_id", "prefix", "start", "path", F.col("first").alias("piece"), (F.col("first") + F.col("i")).alias("n"), F.rtrim("line", F.lit(" \r")).alias("line"))


def lines(spark: SparkSession, root: str, suffix: str, limit: int = SIZE_LIMIT, gate: bool = False, files: DataFrame | None = None) -> DataFrame:
    """capture_id, prefix, start, path, n, line of a collector's files, in file order; nothing is moved to number them."""
    return as_lines(blocks(spark, root, suffix, limit, gate, files))


def formats(files: DataFrame) -> DataFrame:
    """Files of collectors (from scan_files) with format: whether their first 8 KiB, which alone are read, bear the marks."""
    return B.formats(whole_files(files.filter(F.col("suffix").isin(COLLECTORS))))


def file_status(files: DataFrame, rows: DataFrame, diagnostics: DataFrame, formats: DataFrame | None = None) -> DataFrame:
    """Unsupported by its format, failed without rows, partial with a warning or an error, else ok.

    rows, diagnostics and formats have capture_id and prefix; a diagnostic that only informs does not count."""
    key = ["capture_id", "prefix"]
    n = rows.groupBy(*key).agg(F.count("*").alias("rows"))
    bad = diagnostics.groupBy(*key).agg(F.count_if(F.col("severity").isin("warning", "error")).alias("warnings"))
    out = files.select(*key, "suffix").distinct().join(n, key, "left").join(bad, key, "left")
    if formats is not None:
        out = out.join(formats.groupBy(*key).agg(F.bool_or(F.col("format") == "unsupported").alias("foreign")), key, "left")
    foreign = F.col("foreign") if formats is not None else F.lit(False)
    return out.select(*key, "suffix", F.when(foreign, "unsupported").when(F.col("rows").isNull(), "failed").when(F.col("warnings") > 0, "partial").otherwise("ok").alias("status"))


def latest_sidecar(files: DataFrame) -> DataFrame:
    """Newest non-empty file of each kind in a capture, and how many newer ones were empty."""
    side = files.filter(F.col("suffix").isin(SIDECARS))
    best = side.filter("size > 0").groupBy("capture_id", "suffix").agg(F.max_by(F.struct("path", "prefix"), F.struct("prefix", "path")).alias("best")).select("capture_id", "suffix", "best.*")
    newer = side.filter("size = 0").select("capture_id", "suffix", F.col("prefix").alias("empty_prefix"))
    skipped = best.join(newer, ["capture_id", "suffix"], "left").groupBy("capture_id", "suffix", "path", "prefix")
    return skipped.agg(F.count_if(F.col("empty_prefix") > F.col("prefix")).alias("newer_empty"))


def sidecar_diagnostics(latest: DataFrame) -> DataFrame:
    """A warning where newer files were empty."""
    text = F.concat(F.lit("fell back past "), F.col("newer_empty").cast("string"), F.lit(" newer empty file(s)"))
    return latest.filter("newer_empty > 0").select("capture_id", "prefix", "path", F.lit("file").alias("location"), F.lit("warning").alias("severity"), text.alias("message"))


def land(rows: DataFrame, root: str, cut: bool = False) -> None:
    """Write text files; rows have capture, prefix, suffix, ord and line. Each file is written by one task, in order; with cut, by as
    many as its rows call for: ranges of the order are its parts, whose names are in order too, and it is read as one file.

    A capture that is the same constant in all rows would drop out of the order, and the writer would sort anew."""
    named = rows.select(F.concat("capture", F.substring("prefix", 1, 0)).alias("capture"), F.concat("prefix", F.lit("-"), "suffix").alias("file"), "ord", "line")
    dealt = named.repartitionByRange("capture", "file", "ord") if cut else named.repartition("capture", "file")
    dealt = dealt.sortWithinPartitions("capture", "file", "ord")
    dealt.select("capture", "file", F.col("line").alias("value")).write.mode("append").partitionBy("capture", "file").text(root)
