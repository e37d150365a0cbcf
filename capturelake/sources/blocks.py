"""Capture files as blocks of lines: a block is one sample, from its head to the next one.

Files are read by byte ranges, so a large file is the work of many tasks, and nothing is sorted or moved to find out which
sample a line belongs to. A range has the blocks that begin in it, and reads on to the end of its last one. How many lines
and heads stand before a range is a prefix sum over the ranges of a file: first every range of a file of several counts
its own (all others begin at zero), then the counts are summed up. A packed file cannot be entered in its middle and is
one range; its size is what it unpacks to. A file in several parts is read as if they were one after the other.

Each range looks at the file's first 8 KiB before anything else, so a file without the collector's marks costs no more."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturelake.deploy import ship, written
from capturelake.functions.fixed import MARKS
from capturelake.sources.tree import arrow_knows, opened

HEAD, RANGE, AHEAD, OUT, TASK = 8192, 8 << 20, 1 << 20, 2 << 20, 64 << 20
LOOK = 128  # bytes within which a head shows after the end of a range

#: Collector -> how a sample's first line begins. All others are read as blocks of whole lines, of OUT bytes or one line more.
HEADS = {"iostat": rb"\nDevice", "top": rb"\ntop - \d\d:\d\d:\d\d", "mysqladmin": rb"\n\|[ \t]*Variable_name", "processlist": rb"\nTS \d+(?:\.\d+)? ", "netstat_s": rb"\nTS \S+ "}

SCHEMA = "capture_id string, prefix string, path string, part int, sample long, n long, text string"


def supported(head: bytes, suffix: str) -> bool:
    """Whether the first bytes of a file bear its collector's marks; a mark with ^ begins a line."""
    at = b"\n" + head[:HEAD].replace(b"\r", b"")
    has = lambda mark: (b"\n" + mark[1:].encode() if mark.startswith("^") else mark.encode()) in at
    return suffix not in MARKS or any(all(map(has, marks)) for marks in MARKS[suffix])


class Parts:
    """Bytes of a file in parts; a packed file is unpacked, up to limit and one byte."""

    def __init__(self, parts: list[dict], limit: int, contents: list[bytes] | None = None):
        self.parts, self.whole, self.files = parts, None, {}
        if contents is not None or any(p["path"].endswith(".gz") for p in parts):
            raw = contents if contents is not None else [self._bytes(i, 0, p["size"]) for i, p in enumerate(parts)]
            self.whole = b"".join(self._unpacked(r, limit) if p["path"].endswith(".gz") else r for r, p in zip(raw, parts))
        self.size = len(self.whole) if self.whole is not None else sum(p["size"] for p in parts)

    @staticmethod
    def _unpacked(raw: bytes, limit: int) -> bytes:
        try:
            with gzip.open(pa.BufferReader(raw)) as f:
                return f.read(limit + 1)
        except (OSError, EOFError):  # not packed, or cut off
            return b""

    def _bytes(self, i: int, at: int, n: int) -> bytes:
        if i not in self.files:
            system, name = opened(self.parts[i]["path"])
            self.files[i] = system.open_input_file(name)
        return self.files[i].read_at(n, at)

    def read(self, at: int, n: int) -> bytes:
        if self.whole is not None:
            return self.whole[at : at + n]
        out = []
        for i, p in enumerate(self.parts):
            if n > 0 and at < p["size"]:
                out.append(self._bytes(i, at, min(n, p["size"] - at)))
                n, at = n - len(out[-1]), at + len(out[-1])
            at -= p["size"]
        return b"".join(out)

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def _heads(parts: Parts, begin: int, end: int, head: re.Pattern | None) -> tuple[bytes, list[int]]:
    """The bytes from begin on to LOOK after end, and where in them blocks begin before end."""
    data = parts.read(begin, end - begin + LOOK)
    if head is None:
        return data, []
    before = b"\n" if begin == 0 else parts.read(begin - 1, 1)
    return data, [m.start() for m in head.finditer(before + data) if m.start() < end - begin]


def _blocks(parts: Parts, begin: int, end: int, head: re.Pattern | None, lines: int, heads: int) -> Iterator[tuple[int, int, bytes]]:
    """Number, first line and bytes of the blocks that begin in a range: blocks count from 1, what stands before them is 0."""
    data, at = _heads(parts, begin, end, head)
    starts = at if begin or (at and at[0] == 0) else [0, *at]
    number = heads if begin or (at and at[0] == 0) else heads - 1
    seen = 0
    for i, start in enumerate(starts):
        number += 1
        lines += data.count(b"\n", seen, start)
        seen = start
        if i + 1 < len(starts):
            yield number, lines + 1, data[start : starts[i + 1]]
            continue
        piece, look = bytearray(data[start:]), max(end - begin - start - 1, 0)
        got = begin + len(data)
        while True:  # on to the next head, or the file's end
            found = head.search(piece, look) if head is not None else None
            if found or got >= parts.size:
                yield number, lines + 1, bytes(piece[: found.start() + 1] if found else piece)
                break
            look = max(look, len(piece) - LOOK)
            more = parts.read(got, AHEAD)
            if not more:
                yield number, lines + 1, bytes(piece)
                break
            piece += more
            got += len(more)


def _pieces(parts: Parts, begin: int, end: int, lines: int, out: int) -> Iterator[tuple[int, int, bytes]]:
    """As _blocks, of a file without heads: the lines that begin in a range, some at a time; all are sample 0."""
    data, at, got = bytearray(parts.read(begin, end - begin)), 0, end
    if begin and parts.read(begin - 1, 1) != b"\n":  # the first line is that of the range before
        at = data.find(b"\n") + 1
        if not at:
            return
        lines += 1
    while data and not data.endswith(b"\n") and got < parts.size:  # on to the end of the last line
        more = parts.read(got, AHEAD)
        stop = more.find(b"\n") + 1
        data += more[:stop] if stop else more
        got += len(more)
        if stop or not more:
            break
    while at < len(data):
        stop = data.find(b"\n", min(at + out, len(data)) - 1) + 1 or len(data)
        yield 0, lines + 1, bytes(data[at:stop])
        lines += data.count(b"\n", at, stop)
        at = stop


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines and heads of a range."""
    for batch in batches:
        lines, heads = [], []
        for row in batch.to_pylist():
            parts = Parts(row["parts"], 0)
            head = re.compile(HEADS[row["suffix"]]) if row["suffix"] in HEADS else None
            data, at = _heads(parts, row["begin"], row["end"], head)
            lines.append(data.count(b"\n", 0, row["end"] - row["begin"]))
            heads.append(len(at))
            parts.close()
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("part"), pa.array(lines, pa.int64()), pa.array(heads, pa.int64())], ["path", "part", "lines", "heads"])


def _dealt(ranges: DataFrame) -> DataFrame:
    """Ranges dealt to tasks one by one. Rows of ranges are tiny, so their number of tasks is set by the bytes behind them."""
    n, size = ranges.agg(F.count("*"), F.coalesce(F.sum(F.least(F.col("end") - F.col("begin"), F.lit(RANGE))), F.lit(0))).first()
    width = ranges.sparkSession.sparkContext.defaultParallelism
    return ranges.repartition(max(1, min(n, max(2 * width, size // TASK))))


def ranges(files: DataFrame, size: int = RANGE) -> DataFrame:
    """files (capture_id, prefix, suffix, path, parts, size) by ranges, with the lines and heads before each."""
    packed = F.exists("parts", lambda p: p["path"].endswith(".gz"))
    n = F.when(packed | (F.col("size") <= size), 1).otherwise(F.ceil(F.col("size") / size)).cast("int")
    cut = files.withColumn("n_parts", n).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    cut = cut.withColumn("begin", F.col("part").cast("long") * size).withColumn("end", F.when(F.col("part") == F.col("n_parts") - 1, F.when(packed, F.lit(1 << 62)).otherwise(F.col("size"))).otherwise((F.col("part") + 1).cast("long") * size))
    one = cut.filter("n_parts = 1").withColumn("lines", F.lit(0).cast("long")).withColumn("heads", F.lit(0).cast("long"))
    many = cut.filter("n_parts > 1")
    if many.head() is None:
        return one
    counted = _dealt(many.select("suffix", "path", "parts", "part", "begin", "end")).mapInArrow(_count, "path string, part int, lines long, heads long")
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = counted.select("path", "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("lines", "heads")])
    return one.unionByName(many.join(sums, ["path", "part"]))


def _reader(limit: int, gate: bool, out_bytes: int = OUT):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["capture_id", "prefix", "path", "part", "sample", "n", "text"]
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        out: list[list] = [[] for _ in names]
        held = 0
        for batch in batches:
            for row in batch.to_pylist():
                parts = Parts(row["parts"], limit, row.get("contents"))
                head = re.compile(HEADS[row["suffix"]]) if row["suffix"] in HEADS else None
                fine = parts.size <= limit and (not gate or supported(parts.read(0, HEAD), row["suffix"]))
                end = min(row["end"], parts.size)
                whole = _blocks(parts, row["begin"], end, head, row["lines"], row["heads"]) if head else _pieces(parts, row["begin"], end, row["lines"], out_bytes)
                for sample, n, text in whole if fine and end > row["begin"] else ():
                    for column, value in zip(out, (row["capture_id"], row["prefix"], row["path"], row["part"], sample, n, text.decode("utf-8", "replace"))):
                        column.append(value)
                    held += len(text)
                    if held >= OUT:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
                        out, held = [[] for _ in names], 0
                parts.close()
        if held or out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return run


def _with_contents(files: DataFrame, root: str) -> DataFrame:
    """Whole files by Spark's own reader, where Arrow does not know the file system: contents, in the order of parts."""
    source = files.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    held = source.select(F.col("path").alias("at"), "content")
    key = ["capture_id", "prefix", "suffix", "path"]
    whole = files.select(*key, "parts", F.explode("parts.path").alias("at")).join(held, "at").groupBy(*key, "parts").agg(F.array_sort(F.collect_list(F.struct("at", "content"))).alias("held"))
    zero = F.lit(0).cast("long")
    return whole.select(*key, "parts", F.lit(0).alias("part"), zero.alias("begin"), F.lit(1 << 62).alias("end"), zero.alias("lines"), zero.alias("heads"), F.col("held.content").alias("contents"))


def read_blocks(files: DataFrame, limit: int, gate: bool = False, size: int = RANGE, root: str | None = None) -> DataFrame:
    """capture_id, prefix, path, part (range), sample (block; 0 is what stands before the first head), n (its first line), text.

    Files of more than limit bytes, packed ones when unpacked, have no blocks; with gate, unsupported files have none."""
    ship(files.sparkSession)
    if root is not None and not arrow_knows(root):
        cut = _with_contents(files, root)
    else:
        cut = written(ranges(files, size).select("capture_id", "prefix", "suffix", "path", "parts", "part", "begin", "end", "lines", "heads"))
    return _dealt(cut).mapInArrow(_reader(limit, gate), SCHEMA)


def formats(files: DataFrame) -> DataFrame:
    """Files with format, v1 or unsupported, from the first 8 KiB of each."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for suffix, at in zip(batch.column("suffix").to_pylist(), batch.column("parts").to_pylist()):
                parts = Parts(at, HEAD)
                found.append("v1" if supported(parts.read(0, HEAD), suffix) else "unsupported")
                parts.close()
            yield pa.RecordBatch.from_arrays([batch.column("capture_id"), batch.column("prefix"), batch.column("suffix"), batch.column("path"), pa.array(found)], ["capture_id", "prefix", "suffix", "path", "format"])

    return files.select("capture_id", "prefix", "suffix", "path", "parts").mapInArrow(run, "capture_id string, prefix string, suffix string, path string, format string")
