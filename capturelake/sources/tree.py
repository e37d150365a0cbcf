"""The tree of captures below a folder, listed by tasks.

A task lists a folder and what is below it until it has seen ``BUDGET`` entries; folders it has not come to are dealt to
tasks of the next round. So a small tree takes one job, a wide one as many rounds as it is deep at most, and the driver holds
no list of files. Where Arrow does not know the file system, the driver's Hadoop client lists, a folder at a time."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.deploy import file_system, ship, written

#: Folders below the root in which captures are looked for; entries that a task lists in a round.
MAX_DEPTH, BUDGET = 8, 20_000
SCHEMA = "path string, name string, size long, folder boolean"


def absolute(spark: SparkSession, root: str) -> str:
    """The root with its scheme, as files below it are named."""
    files, at = file_system(spark, root)
    return files.getFileStatus(at).getPath().toString().rstrip("/")


def arrow_knows(path: str) -> bool:
    try:
        fs.FileSystem.from_uri(_uri(path))
    except (ValueError, OSError, NotImplementedError):
        return False
    return True


def _uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and its name there. Local names may hold any character."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _children(folder: str) -> Iterator[tuple[str, int, bool]]:
    """Visible entries of a folder: name, size, whether it is a folder. One that cannot be read has none."""
    system, at = opened(folder)
    try:
        found = system.get_file_info(fs.FileSelector(at))
    except OSError:
        return
    for x in found:
        if not x.base_name.startswith((".", "_")):
            yield x.base_name, x.size or 0, x.type == fs.FileType.Directory


def _walk(max_depth: int, root: str, budget: int):
    """max_depth: folders of captures; what lies in them may be a file of several parts, one level below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, out = deque(batch.column(0).to_pylist()), []
            while left and len(out) < budget:
                folder = left.popleft()
                for name, size, is_folder in _children(folder):
                    path = f"{folder}/{name}"
                    if not is_folder:
                        out.append((path, name, size, False))
                    elif path[len(root) :].count("/") <= max_depth + 1:
                        left.append(path)
            out += [(path, "", 0, True) for path in left]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.bool_()))] if out else [pa.array([], t) for t in (pa.string(), pa.string(), pa.int64(), pa.bool_())], ["path", "name", "size", "folder"])

    return run


def listing(spark: SparkSession, root: str, max_depth: int = MAX_DEPTH, budget: int = BUDGET) -> DataFrame:
    """path, name and size of every visible file, empty ones too, down to folders max_depth below root and files' parts."""
    root = absolute(spark, root)
    if not arrow_knows(root):
        return _by_driver(spark, root, max_depth)
    ship(spark)
    parts, todo, n = [], spark.createDataFrame([(root,)], "path string"), 1
    while n:
        width = max(1, min(n, spark.sparkContext.defaultParallelism))
        seen = written(todo.repartition(width).mapInArrow(_walk(max_depth, root, budget), SCHEMA))
        parts.append(seen.filter("not folder").drop("folder"))
        todo = seen.filter("folder").select("path")
        n = todo.count()
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _by_driver(spark: SparkSession, root: str, max_depth: int) -> DataFrame:
    files, top = file_system(spark, root)
    left, out = deque([(top, 0)]), []
    while left:
        folder, depth = left.popleft()
        for x in files.listStatus(folder):
            name = x.getPath().getName()
            if name.startswith((".", "_")):
                continue
            if not x.isDirectory():
                out.append((x.getPath().toString(), name, x.getLen()))
            elif depth <= max_depth:
                left.append((x.getPath(), depth + 1))
    return spark.createDataFrame(out, "path string, name string, size long")


def relative(root: str):
    """Column: a path without the root before it."""
    return F.expr(f"substr(path, {len(root) + 2})")
