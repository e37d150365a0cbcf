"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir). Where that is unset, a local session gets a temporary one, and
    a cluster an error: a folder of one machine would be lost with it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='capturelake-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def materialize(df: DataFrame, at: str | None = None) -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder and read it back, so a lost executor costs no recomputation.

    The files go when the application ends, unless they are in a folder (at) that somebody else looks after."""
    spark = df.sparkSession
    path = f"{at or shared_dir(spark) + '/capturelake'}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if at is None:
        files, where = _file_system(spark, path)
        files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that only the steps of one operator need: they are deleted when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{shared_dir(spark)}/capturelake/{uuid.uuid4().hex}"

    def table(self, df: DataFrame) -> DataFrame:
        return materialize(df, self.at)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        files, where = _file_system(self.spark, self.at)
        files.delete(where, True)


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], count: str, total: int, how: str = "left") -> DataFrame:
    """rows (written before: they are read twice) joined with groups, which have one row a key and the number ``count`` of
    rows that have it.

    Keys of more than a thousandth of the ``total`` rows, of which there cannot be over a thousand, are broadcast and their
    rows stay where they are. So no key brings more than a thousandth of the rows to one task."""
    most = max(total // 1000, 100)
    hot, rest = groups.filter(F.col(count) > most), groups.filter(F.col(count) <= most)
    here = rows.join(F.broadcast(hot), key)
    return here.unionByName(rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(rest, key, how))


def text_chunks(ids, texts, max_chars: int = 1 << 19):
    """Split parallel lists into runs of at most about max_chars characters, so that scratch arrays stay bounded.

    A single text longer than max_chars forms its own run; texts are never cut here."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if size and size + n > max_chars:
            yield ids[begin:i], texts[begin:i]
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield ids[begin:], texts[begin:]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package's modules to Python workers, once an application, in case they do not find them on their own."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="capturelake-")).resolve() / "capturelake.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def arrow_rows(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Texts may be long: hand fewer rows and bytes at once to Python workers than the defaults (never more than is set).

    This stays set for the session, as plans read it only when they run."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.conf.get(key, None):
        spark.conf.set(key, size)


def release() -> None:
    """Give freed memory back to the system at the end of a task, as Python workers live on for other tasks."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
