"""What a cluster needs of this package: a shared folder, and its modules in Python workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares. Where none is set, a local session gets a temporary one, and a
    cluster an error: a folder of one machine would be lost with it. The folder goes when the application ends."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.gettempdir()}"
    path = f"{at.rstrip('/')}/capturelake-{uuid.uuid4().hex}"
    files, where = file_system(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage ends here, and what reads it twice computes it once."""
    path = f"{shared_folder(df.sparkSession)}/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package's modules to Python workers, once an application, in case they do not find them on their own."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="capturelake-")).resolve() / "capturelake_core.zip"  # a name of its own: Spark takes one path for a name
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
