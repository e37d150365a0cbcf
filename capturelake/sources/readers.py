"""Readers: blocks of a collector's files to typed rows. Each takes blocks() and returns rows; *_rejects give its diagnostics.

Where samples are many (devices, processes, status, threads, network counters) a block is all that a row depends on: the
``parse_*`` functions are narrow, and give the rows that cannot be used too, with the problem. ``read_both`` writes what was parsed
once, and takes rows and diagnostics from there. Places within a file are found on two levels, in a range and over the
ranges before it. The other readers look at lines; what a parser would keep while it walks a file is a window over the
lines of one file, and files are limited in size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capturelake.deploy import written
from capturelake.functions import scalar as S
from capturelake.functions.fixed import NET_LABELS, SYSCTL
from capturelake.sources.files import as_lines

KEY = ["capture_id", "prefix", "start", "path"]
TS = r"^TS (\d+(?:\.\d+)?) "


def _so_far() -> Window:
    return Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)


def _next(lines: DataFrame) -> DataFrame:
    """lines with next: the line after each, among those given. It is looked up in a line's piece, and at a piece's end in the next one that has any."""
    first = lines.groupBy("path", "piece").agg(F.min_by("line", "n").alias("first"))
    after = first.select("path", "piece", F.lead("first").over(Window.partitionBy("path").orderBy("piece")).alias("after"))
    here = lines.withColumn("next", F.lead("line").over(Window.partitionBy("path", "piece").orderBy("n")))
    return here.join(after, ["path", "piece"]).withColumn("next", F.coalesce("next", "after")).drop("after")


def _blocks(lines: DataFrame, header: Column, name: str = "block") -> DataFrame:
    """Number of the block a line is in: 0 before the first header."""
    return lines.withColumn(name, F.sum(F.when(header, 1).otherwise(0)).over(_so_far()))


def _last(value: Column) -> Column:
    return F.last(value, ignorenulls=True).over(_so_far())


def _fields(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def _after(start: Column, seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(start) + seconds)


def _stamped(lines: DataFrame) -> DataFrame:
    """Lines of files with TS marks: block, and ts floored to microseconds; a bad stamp falls back to the snapshot."""
    lines = as_lines(lines)
    marked = _blocks(lines, F.col("line").rlike(TS))
    epoch = F.regexp_extract("line", TS, 1)
    return marked.withColumn("ts", F.coalesce(_last(F.when(epoch != "", S.epoch_to_ts(epoch, F.col("start")))), F.col("start"))).filter(~F.col("line").rlike(TS))


def _collapsed(text: Column | str) -> Column:
    """Runs of white space inside lines as one space."""
    return F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")


def _settled(rows: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """rows with columns that are computed once: a filter on them is not moved below them, where it would compute them again."""
    return rows.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _numbered(rows: DataFrame, of: list[str], name: str) -> DataFrame:
    """Place of a row among those of its file with the same ``of``, from 0 on: its place in its range, and what is in the
    ranges before it. rows are read twice."""
    key = ["path", "part", *of]
    here = rows.withColumn("__here", F.row_number().over(Window.partitionBy(*key).orderBy("sample", "row")) - 1)
    before = F.sum("__n").over(Window.partitionBy("path", *of).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals = rows.groupBy(*key).agg(F.count("*").alias("__n")).select(*key, F.coalesce(before, F.lit(0)).alias("__before"))
    return here.join(totals, key).withColumn(name, (F.col("__here") + F.col("__before")).cast("int")).drop("__here", "__before")


BLOCK = ["capture_id", "prefix", "start", "path", "part", "sample"]


def parse_status(blocks: DataFrame) -> DataFrame:
    """Name and raw of every cell of every sample: what is between the first two bars, and from there to the last one."""
    rows = blocks.filter("sample > 0").select(*BLOCK, F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").startswith("|"))
    rows = rows.select(*BLOCK, F.split(F.rtrim("line", F.lit(" \t\r")), r"\|").alias("f"))
    value = F.when(F.size("f") == 4, F.btrim(F.col("f")[2], F.lit(" \t")).try_cast("bigint"))
    rows = _settled(rows, *BLOCK, cells=F.size("f"), end=F.element_at("f", -1), name=F.btrim(F.try_element_at("f", F.lit(2)), F.lit(" \t")), raw=F.coalesce(value, F.lit(0)))
    odd = (F.col("name") == "") | (F.col("name") == "Variable_name") | F.col("name").contains(" ") | F.col("name").contains("\t")
    return rows.filter((F.col("cells") > 3) & (F.col("end") == "") & ~odd).select(*BLOCK, "name", "raw")


def _status(parsed: DataFrame) -> DataFrame:
    idx = (F.col("sample") - 1).cast("int")
    return parsed.select("capture_id", "prefix", idx.alias("sample_idx"), _after(F.col("start"), idx).alias("ts"), "name", "raw", S.is_counter(F.col("name")).alias("is_counter"))


def _status_rejects(parsed: DataFrame) -> DataFrame:
    last = parsed.groupBy("path").agg(F.max("sample").alias("samples"))
    short = parsed.groupBy(*FILE, "name").agg(F.max("sample").alias("last")).join(last, "path").filter("last < samples")
    text = F.concat(F.col("name"), F.lit(" missing from "), (F.col("samples") - F.col("last")).cast("string"), F.lit(" trailing sample(s)"))
    return _of_files(short, text, "warning")


def read_status(blocks: DataFrame) -> DataFrame:
    """Samples of a file are a second apart."""
    return read_both("mysqladmin", blocks)[0]


def read_status_rejects(blocks: DataFrame) -> DataFrame:
    """Variables that the file's last samples lack."""
    return _status_rejects(parse_status(blocks))


def parse_device(blocks: DataFrame) -> DataFrame:
    """Device, util_percent, avgqu_sz of every row below a head, up to a blank line; columns are found once a head.

    Without a column that is needed, the head is the problem and its rows are left out."""
    rows = blocks.filter("sample > 0").select(*BLOCK, "n", F.split(_collapsed("text"), "\n").alias("rows"))
    head = F.transform(F.split(F.trim(F.col("rows")[0]), " "), lambda c: F.replace(c, F.lit(":"), F.lit("")))
    place = lambda names: reduce(F.coalesce, [F.nullif(F.array_position("head", n), F.lit(0)) for n in names]).cast("int")
    rows = rows.withColumn("head", head).withColumn("u", place(["%util", "util"])).withColumn("q", place(["aqu-sz", "avgqu-sz"])).withColumn("body", F.slice("rows", F.lit(2), F.size("rows")))
    blank = F.array_position(F.transform("body", lambda x: F.trim(x) == ""), True)
    rows = rows.withColumn("blank", blank.cast("int"))
    body = F.when(F.col("blank") > 0, F.slice("body", F.lit(1), F.col("blank") - 1)).otherwise(F.col("body"))
    known = F.col("u").isNotNull() & F.col("q").isNotNull()
    rows = rows.select(*BLOCK, "n", "u", "q", F.posexplode(F.when(known, body).otherwise(F.array(F.lit(None).cast("string")))).alias("row", "line"))
    rows = rows.withColumn("f", F.split(F.trim("line"), " "))
    number = lambda c: S.localized_double(F.try_element_at("f", F.col(c)))
    rows = rows.select(*BLOCK, "row", (F.col("n") + F.when(F.col("line").isNotNull(), F.col("row") + 1).otherwise(0)).alias("n"), "line", F.col("f")[0].alias("device"), number("u").alias("util_percent"), number("q").alias("avgqu_sz"))
    problem = F.when(F.col("line").isNull(), "header without utilisation or queue column").when(F.col("util_percent").isNull() | F.col("avgqu_sz").isNull(), "unreadable device row")
    return rows.withColumn("problem", problem).drop("line")


def _device(parsed: DataFrame) -> DataFrame:
    good = _numbered(parsed.filter("problem is null"), ["device"], "sample_idx")
    return good.select("capture_id", "prefix", "sample_idx", _after(F.col("start"), F.col("sample_idx")).alias("ts"), "device", "util_percent", "avgqu_sz")


def _problems(parsed: DataFrame) -> DataFrame:
    return diagnostics(parsed.filter("problem is not null"), F.col("problem"))


def read_device(blocks: DataFrame) -> DataFrame:
    """Samples of a device are a second apart, counted for each device."""
    return read_both("iostat", blocks)[0]


def read_device_rejects(blocks: DataFrame) -> DataFrame:
    """Rows of S7 that cannot be read, and heads."""
    return _problems(parse_device(blocks))


DIAGNOSTIC = ["capture_id", "prefix", "path", "location", "severity", "message"]


def diagnostics(rows: DataFrame, message: Column | str, severity: str = "warning") -> DataFrame:
    """A diagnostic for each of the rows, at its line."""
    text = message if isinstance(message, Column) else F.lit(message)
    return rows.select("capture_id", "prefix", "path", F.concat(F.lit("line "), F.col("n").cast("string")).alias("location"), F.lit(severity).alias("severity"), text.alias("message"))


def _of_files(files: DataFrame, message: Column | str, severity: str) -> DataFrame:
    """A diagnostic for each of the files (capture_id, prefix, path) as a whole."""
    text = message if isinstance(message, Column) else F.lit(message)
    return files.select("capture_id", "prefix", "path", F.lit("file").alias("location"), F.lit(severity).alias("severity"), text.alias("message"))


FILE = ["capture_id", "prefix", "path"]


def _stamp_rejects(lines: DataFrame, implicit: bool = True) -> DataFrame:
    """Stamps whose epoch cannot be read; with implicit, also files that have rows and no stamp."""
    lines = as_lines(lines)
    any_stamp, epoch = F.col("line").rlike(r"^TS \S"), F.regexp_extract("line", TS, 1)
    bad = diagnostics(lines.filter(any_stamp & ((epoch == "") | S.epoch_to_ts(epoch, F.lit(None).cast("timestamp")).isNull())), "malformed TS epoch; snapshot start used")
    if not implicit:
        return bad
    bare = lines.groupBy(*FILE).agg(F.bool_or(any_stamp).alias("stamped"), F.bool_or(F.trim("line") != "").alias("filled")).filter("filled and not stamped")
    return bad.union(_of_files(bare, "no TS marker; snapshot start used", "info"))


def read_process_rejects(blocks: DataFrame) -> DataFrame:
    """Rows of S8 without a readable pid or CPU share."""
    return _problems(parse_process(blocks))


def read_host_rejects(lines: DataFrame) -> DataFrame:
    """Data rows before any header."""
    lines = as_lines(lines)
    head = F.col("line").rlike(r"^\s*r\s+b\s")
    rows = lines.withColumn("headed", F.max(F.when(head, 1).otherwise(0)).over(_so_far()))
    return diagnostics(rows.filter((F.col("headed") == 0) & F.col("line").rlike(r"^\s*\d")), "data row before any header")


def read_memory_rejects(lines: DataFrame) -> DataFrame:
    """Why a file of S10 was rejected, and series that no sample has."""
    lines = as_lines(lines)
    rows = _memory_rows(lines)
    early = _of_files(rows.filter("block = 0").select(*FILE).distinct(), "value line before first TS marker", "error")
    seen = rows.filter("block > 0")
    none = _of_files(lines.select(*FILE).distinct().join(rows.select("path").distinct(), "path", "left_anti"), "no samples found", "error")
    whole = seen.groupBy(*FILE, "block").agg(F.count_distinct(F.when(F.col("k").isin("SwapTotal", "SwapFree"), F.col("k"))).alias("swap"))
    swap = _of_files(whole.filter("swap < 2").select(*FILE).distinct(), "sample without SwapTotal or SwapFree", "error")
    absent = seen.groupBy(*FILE).agg(F.collect_set("k").alias("keys")).select(*FILE, F.explode(F.array_except(F.array(*map(F.lit, MEMORY)), "keys")).alias("key"))
    return early.union(none).union(swap).union(_of_files(absent, F.concat(F.lit("never seen: "), F.col("key")), "warning"))


def read_variables_rejects(lines: DataFrame) -> DataFrame:
    """Repeated names of S11."""
    kept, first = _variable_rows(lines)
    return diagnostics(kept.join(first, ["path", "n"], "left_anti"), F.concat(F.lit("duplicate "), F.col("name"), F.lit("; first value kept")))


SECTIONS = ["BACKGROUND THREAD", "SEMAPHORES", "TRANSACTIONS", "FILE I/O", "INSERT BUFFER AND ADAPTIVE HASH INDEX", "LOG", "BUFFER POOL AND MEMORY", "ROW OPERATIONS"]


def read_engine_rejects(lines: DataFrame) -> DataFrame:
    """Files without any section header."""
    lines = as_lines(lines)
    bare = lines.groupBy(*FILE).agg(F.bool_or(F.trim("line").isin(SECTIONS)).alias("known")).filter("not known")
    return _of_files(bare, "no recognised section headers", "warning")


def read_threads_rejects(blocks: DataFrame) -> DataFrame:
    """Bad stamps of S15."""
    return _problems(parse_threads(blocks))


def read_sockets_rejects(lines: DataFrame) -> DataFrame:
    """Bad stamps, TCP rows without a state, and lone ESTAB rows that nothing in the file tells to be TCP or UDP."""
    rows, netstat, _ = _socket_rows(lines)
    stateless = diagnostics(rows.filter(netstat & F.lower(F.col("f")[0]).startswith("tcp") & (F.size("f") < 6)), "tcp row without state")
    doubt = rows.filter((F.col("word") == "ESTAB") & (F.col("unconn") == 0) & (F.col("tcp_word") == 0)).groupBy(*FILE).agg(F.min("n").alias("n"), F.count("*").alias("of"))
    text = F.concat(F.col("of").cast("string"), F.lit(" ESTAB row(s) taken as TCP without evidence"))
    return _stamp_rejects(lines).union(stateless).union(diagnostics(doubt, text))


def read_net_counters_rejects(blocks: DataFrame) -> DataFrame:
    """Bad stamps, files without any, and known labels without a number."""
    return _net_rejects(parse_net(blocks))


def _net_rejects(parsed: DataFrame) -> DataFrame:
    bare = parsed.groupBy(*FILE).agg(F.max("sample").alias("samples"), F.bool_or("filled").alias("filled")).filter("samples = 0 and filled")
    return _problems(parsed).union(_of_files(bare, "no TS marker; snapshot start used", "info"))


def read_env_memory_rejects(lines: DataFrame) -> DataFrame:
    """Files of S22 whose newest sample lacks core keys, and what was used instead."""
    wide = _env_samples(lines)
    newest = wide.groupBy(*FILE).agg(F.max_by("rank", "block").alias("newest"), F.max("rank").alias("best")).filter("newest < 2")
    used = F.when(F.col("best") == 2, "older complete sample used").when(F.col("best") == 1, "newest sample with MemTotal used").otherwise("newest partial sample used")
    return _of_files(newest, F.concat(F.lit("newest sample is incomplete; "), used), "warning")


def parse_process(blocks: DataFrame) -> DataFrame:
    """Pid, command and cpu_percent of the rows below a block's PID header, up to one of fewer than 12 fields; a block without
    rows is a row without a pid and without a problem, as its clock counts."""
    part = lambda i: F.regexp_extract("text", r"^top - (\d\d):(\d\d):(\d\d)", i).try_cast("int")
    rows = blocks.filter("sample > 0").select(*BLOCK, "n", (part(1) * 3600 + part(2) * 60 + part(3)).alias("clock"), F.split(_collapsed("text"), "\n").alias("rows"))
    rows = rows.withColumn("headed", F.array_position(F.transform("rows", lambda x: F.ltrim(x).startswith("PID ")), True).cast("int"))
    fields = F.transform(F.slice("rows", F.col("headed") + 1, F.size("rows")), lambda x: F.split(F.trim(x), " "))
    rows = rows.withColumn("fields", F.when(F.col("headed") > 0, fields))
    rows = rows.withColumn("end", F.array_position(F.transform("fields", lambda f: F.size(f) < 12), True).cast("int"))
    body = F.when(F.col("end") > 0, F.slice("fields", F.lit(1), F.col("end") - 1)).otherwise(F.col("fields"))
    rows = rows.select(*BLOCK, "n", "clock", "headed", F.posexplode_outer(body).alias("row", "f"))
    rows = rows.select(*BLOCK, "clock", "row", (F.col("n") + F.col("headed") + F.col("row")).alias("n"), F.col("f").isNotNull().alias("is_row"), F.col("f")[0].try_cast("int").alias("pid"), F.array_join(F.slice("f", 12, 1000), " ").alias("command"), S.localized_double(F.col("f")[8]).alias("cpu_percent"))
    problem = F.when(~F.col("is_row"), None).when(F.col("pid").isNull(), "unreadable PID").when(F.col("cpu_percent").isNull(), "unreadable %CPU")
    return rows.withColumn("problem", problem)


def _process(parsed: DataFrame) -> DataFrame:
    """Days are counted over the clocks of a file's samples, one row each."""
    from capturelake.operators.deltas import midnight_roll

    clocks = parsed.select("path", "sample", "clock", (F.unix_seconds("start") % 86400).alias("start_clock")).distinct()
    at = midnight_roll(clocks, ["path"], "sample").select("path", "sample", "at")
    midnight = F.unix_seconds("start") - F.unix_seconds("start") % 86400
    rows = parsed.filter("is_row and problem is null").join(at, ["path", "sample"])
    return rows.select("capture_id", "prefix", F.timestamp_seconds(midnight + F.col("at")).alias("ts"), "pid", "command", "cpu_percent")


def read_process(blocks: DataFrame) -> DataFrame:
    """A block's rows follow its PID header; a row of fewer than 12 fields ends it."""
    return read_both("top", blocks)[0]


#: S9, fixed values: column of the collector -> ours.
HOST = {"r": "runqueue", "b": "blocked", "free": "free_kb", "buff": "buff_kb", "cache": "cache_kb", "si": "swap_in", "so": "swap_out", "bi": "io_in", "bo": "io_out", "us": "cpu_user", "sy": "cpu_sys", "id": "cpu_idle", "wa": "cpu_iowait"}


def read_host(lines: DataFrame) -> DataFrame:
    """Of a repeated column the first counts, an absent one is 0."""
    lines = as_lines(lines)
    head = F.col("line").rlike(r"^\s*r\s+b\s")
    scoped = lines.withColumn("cols", _last(F.when(head, _fields(F.col("line"))))).filter(F.col("cols").isNotNull() & ~head & F.col("line").rlike(r"^\s*\d"))
    idx = (F.row_number().over(Window.partitionBy("path").orderBy("n")) - 1).cast("int")
    f = _fields(F.col("line"))
    value = lambda c: F.coalesce(F.try_element_at("f", F.nullif(F.array_position("cols", c), F.lit(0)).cast("int")).try_cast("double"), F.lit(0.0)).alias(HOST[c])
    return scoped.withColumn("f", f).withColumn("sample_idx", idx).select("capture_id", "prefix", "sample_idx", _after(F.col("start"), F.col("sample_idx")).alias("ts"), *map(value, HOST))


#: S10, fixed values.
MEMORY = {"MemAvailable": "mem_available", "MemFree": "mem_free", "Cached": "cached", "Buffers": "buffers", "AnonPages": "anon_pages", "Dirty": "dirty", "Slab": "slab"}


def _memory_rows(lines: DataFrame) -> DataFrame:
    key = r"^([A-Za-z_()]+):\s+(\d+)(?: kB)?"
    return _stamped(lines).filter(F.col("line").rlike(key)).withColumn("k", F.regexp_extract("line", key, 1)).withColumn("v", F.regexp_extract("line", key, 2).try_cast("double") / 1048576)


def read_memory(lines: DataFrame) -> DataFrame:
    """Gigabytes at each stamp. A file with a value before its first stamp, or a sample without swap totals, is rejected."""
    rows = _memory_rows(lines)
    early = rows.filter("block = 0").select("path").distinct()
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    wide = rows.groupBy(*KEY, "block", "ts").agg(*[F.coalesce(at(k), F.lit(0.0)).alias(c) for k, c in MEMORY.items()], at("SwapTotal").alias("swap_total"), at("SwapFree").alias("swap_free"))
    no_swap = wide.filter("swap_total is null or swap_free is null").select("path").distinct()
    good = wide.join(early, "path", "left_anti").join(no_swap, "path", "left_anti")
    return good.select("capture_id", "prefix", "ts", *MEMORY.values(), F.greatest(F.col("swap_total") - F.col("swap_free"), F.lit(0.0)).alias("swap_used"))


def _variable_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a file's first listing, which goes from its head to the next one or to what is no row, and the first place of each
    name. Both are found by aggregates: no window goes over a file's lines, and only a few rows a file are joined to them. These are
    written, so their size is known, and while they are few, no line is moved: one file may hold most of the lines."""
    lines = as_lines(lines)
    cells, head = F.split("line", "\t"), F.col("line").startswith("Variable_name\t")
    stop = head | (F.size(cells) != 2) | F.col("line").startswith("THREAD_ID\t") | F.col("line").startswith("SHOW ")
    every = written(lines.select(*KEY, "n", head.alias("head"), stop.alias("stop"), F.when(~stop, cells[0]).alias("name"), F.when(~stop, cells[1]).alias("value")))
    begin = every.filter("head").groupBy("path").agg(F.min("n").alias("begin"))
    end = every.filter("stop").join(begin, "path").filter("n > begin").groupBy("path").agg(F.min("n").alias("end"))
    listing = written(begin.join(end, "path", "left"))
    kept = every.join(listing, "path").filter("n > begin and (end is null or n < end)").select(*KEY, "n", "name", "value")
    return kept, written(kept.groupBy("path", "name").agg(F.min("n").alias("n")).select("path", "n"))


def read_variables(lines: DataFrame) -> DataFrame:
    """The first listing only; the first of equal names."""
    kept, first = _variable_rows(lines)
    return kept.join(first, ["path", "n"], "left_semi").select("capture_id", "prefix", F.col("start").alias("snapshot_ts"), "name", "value")


def read_engine(lines: DataFrame) -> DataFrame:
    """Pool instances are summed; of the sync line and the hash table size the last counts."""
    lines = as_lines(lines)
    said = lambda mark, p, i=1: F.when(F.col("line").startswith(mark), F.regexp_extract("line", p, i)).try_cast("double")
    writes = lambda i: said("Pending writes: LRU ", r"^Pending writes: LRU (\d+), flush list (\d+), single page (\d+)", i)
    fsync = lambda i: said("Pending flushes (fsync) log: ", r"^Pending flushes \(fsync\) log: (\d+); buffer pool: (\d+)", i)
    hashes = lambda i: F.when(F.col("line").contains(" hash searches/s, "), F.regexp_extract("line", r"^([\d.]+) hash searches/s, ([\d.]+) non-hash searches/s", i)).try_cast("double")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    last = lambda c: F.coalesce(F.max_by(c, F.when(c.isNotNull(), F.col("n"))), F.lit(0.0))
    return lines.groupBy("capture_id", "prefix", F.col("start").alias("snapshot_ts")).agg(
        F.count_if(F.col("line").startswith("--Thread ") & F.col("line").rlike(r"^--Thread .* has waited at ")).cast("double").alias("semaphore_count"), total(said("Pending reads", r"^Pending reads\s+(\d+)")).alias("pending_reads"),
        (total(writes(1)) + total(writes(2)) + total(writes(3))).alias("pending_writes"), total(writes(1)).alias("pending_writes_lru"), total(writes(2)).alias("pending_writes_flush_list"), total(writes(3)).alias("pending_writes_single_page"),
        last(fsync(1)).alias("pending_fsync_log"), last(fsync(2)).alias("pending_fsync_bp"), total(said("Modified db pages", r"^Modified db pages\s+(\d+)")).alias("modified_pages"), last(said("Hash table size ", r"^Hash table size (\d+)")).alias("hash_table_size"),
        last(hashes(1)).alias("hash_per_s"), last(hashes(2)).alias("nonhash_per_s"), last(said("History list length ", r"^History list length (\d+)")).alias("history_list"),
    )


def read_latch_waits(lines: DataFrame) -> DataFrame:
    """Waits by file, line and the mutex that the next line names."""
    lines = as_lines(lines)
    wait, mutex = r"^--Thread \S+ has waited at (\S+) line (\d+)", r"^Mutex at \S+, (?:Mutex )?(\S+)"
    rows = _next(lines.filter(F.trim("line") != "")).filter(F.col("line").startswith("--Thread ") & F.col("line").rlike(wait))
    return rows.groupBy("capture_id", "prefix", F.regexp_extract("line", wait, 1).alias("file"), F.regexp_extract("line", wait, 2).cast("int").alias("line"), F.regexp_extract(F.coalesce("next", F.lit("")), mutex, 1).alias("mutex")).agg(F.count("*").alias("wait_count"))


THREAD = {"User": "user", "Host": "host", "db": "db", "Command": "command", "State": "state", "Time": "time_s", "Time_ms": "time_ms", "Rows_sent": "rows_sent", "Rows_examined": "rows_examined", "Info": "info"}


def parse_threads(blocks: DataFrame) -> DataFrame:
    """The known keys of every row of a sample, the first of each, and stamps that cannot be read."""
    epoch = F.regexp_extract("text", TS, 1)
    ts = F.coalesce(F.when(epoch != "", S.epoch_to_ts(epoch, F.col("start"))), F.col("start"))
    key = r"(?md)^[ \t]*(Id|User|Host|db|Command|Time|State|Info|Time_ms|Rows_sent|Rows_examined): ?(.*)$"
    stamp = lambda x: F.regexp_extract(x, TS, 1)
    odd = lambda x: x["line"].rlike(r"^TS \S") & ((stamp(x["line"]) == "") | S.epoch_to_ts(stamp(x["line"]), F.lit(None).cast("timestamp")).isNull())
    bad = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("line"))), odd)
    asks = F.col("text").contains("\nTS ") | (F.col("sample") == 0) | (epoch != "") & S.epoch_to_ts(epoch, F.lit(None).cast("timestamp")).isNull()
    bad = F.transform(F.when(asks, bad).otherwise(F.expr("array()").cast("array<struct<i:int,line:string>>")), lambda x: F.struct(F.lit(None).cast("string").alias("text"), x["i"].alias("at")))
    rows = F.transform(F.split("text", r"(?:^|\n)\*+ \d+\. row \*+[^\n]*"), lambda x, i: F.struct(F.when(i > 0, x).alias("text"), F.lit(None).cast("int").alias("at")))
    every = blocks.select(*BLOCK, "n", ts.alias("ts"), F.posexplode(F.concat(bad, F.filter(rows, lambda x: x["text"].isNotNull()))).alias("row", "x"))
    every = every.withColumn("keys", F.regexp_extract_all("x.text", F.lit(key), F.lit(1))).withColumn("values", F.regexp_extract_all("x.text", F.lit(key), F.lit(2)))
    value = lambda k: F.rtrim(F.try_element_at("values", F.nullif(F.array_position("keys", k), F.lit(0)).cast("int")), F.lit(" \r"))
    problem = F.when(F.col("x.at").isNotNull(), "malformed TS epoch; snapshot start used")
    return every.select(*BLOCK, "ts", "row", (F.col("n") + F.coalesce("x.at", F.lit(0))).alias("n"), *[value(k).alias(c) for k, c in THREAD.items()], problem.alias("problem"))


def _threads(parsed: DataFrame) -> DataFrame:
    number = lambda c: F.when(F.col(c).try_cast("double") >= 0, F.col(c).try_cast("double")).alias(c)
    named = reduce(lambda a, b: a | b, [F.trim(F.coalesce(c, F.lit(""))) != "" for c in ("user", "host", "command", "db", "state")])
    no = F.row_number().over(Window.partitionBy("path", "ts").orderBy("sample", "row"))
    return parsed.filter("problem is null").filter(named).withColumn("row_no", no).select("capture_id", "prefix", F.date_trunc("second", "ts").alias("ts"), "row_no", "user", S.strip_port(F.col("host")).alias("host"), "db", "command", "state", *map(number, ("time_s", "time_ms", "rows_sent", "rows_examined")), "info")


def read_threads(blocks: DataFrame) -> DataFrame:
    """Numbers that cannot be read or are negative are absent; rows that name nothing are dropped."""
    return read_both("processlist", blocks)[0]


def _socket_rows(lines: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Rows with the file's evidence, and which of them are of the first and of the second layout."""
    f = _fields(F.col("line"))
    rows = _stamped(lines).filter(F.trim("line") != "").withColumn("f", f)
    proto = F.lower(F.col("f")[0])
    tcp, udp = proto.rlike("^tcp6?$"), proto.rlike("^udp6?$")
    has_state = S.socket_state(F.col("f")[1]).isNotNull() & (tcp | udp)
    netstat = (tcp | udp) & ~has_state
    first = S.socket_state(F.col("f")[0])
    whole = Window.partitionBy("path")
    word = F.upper(F.col("f")[0])
    rows = rows.withColumn("unconn", F.max((word == "UNCONN").cast("int")).over(whole)).withColumn("tcp_word", F.max(F.when(first.isNotNull() & ~word.isin("UNCONN", "ESTAB"), 1).otherwise(0)).over(whole))
    return rows.withColumn("word", word), netstat, has_state


def read_sockets(lines: DataFrame) -> DataFrame:
    """Three layouts; in a state-first file without a word of its own, whole-file evidence tells UDP from TCP."""
    rows, netstat, has_state = _socket_rows(lines)
    udp, first, word = F.lower(F.col("f")[0]).rlike("^udp6?$"), S.socket_state(F.col("f")[0]), F.col("word")
    lone_estab = F.when((F.col("unconn") == 1) & (F.col("tcp_word") == 0), "UDP").otherwise("ESTABLISHED")
    state = F.when(udp, "UDP").when(has_state, S.socket_state(F.col("f")[1])).when(netstat, F.coalesce(S.socket_state(F.try_element_at("f", F.lit(6))), F.lit("UNKNOWN"))).when(word == "ESTAB", lone_estab).otherwise(first)
    recv = F.when(netstat, F.col("f")[1]).when(has_state, F.try_element_at("f", F.lit(3))).otherwise(F.try_element_at("f", F.lit(2)))
    send = F.when(netstat, F.col("f")[2]).when(has_state, F.try_element_at("f", F.lit(4))).otherwise(F.try_element_at("f", F.lit(3)))
    known = rows.withColumn("state", state).withColumn("recv", recv).withColumn("send", send).filter("state is not null")
    return known.groupBy("capture_id", "prefix", "ts", "state").agg(F.count("*").alias("n"), F.bool_or(F.coalesce("recv", F.lit("0")) != "0").alias("recvq_nonzero"), F.bool_or(F.coalesce("send", F.lit("0")) != "0").alias("sendq_nonzero"))


def _net_labels(lines: DataFrame) -> DataFrame:
    rows = [(section, label, counter) for section, labels in NET_LABELS.items() for label, counter in labels.items()]
    return F.broadcast(lines.sparkSession.createDataFrame(rows, "section string, label string, counter string"))


def parse_net(blocks: DataFrame) -> DataFrame:
    """Known labels of every block with their number, and a row of each block for its stamp.

    A line that is not indented begins or ends a section; a label counts in the section that it belongs to."""
    epoch = F.regexp_extract("text", r"^TS (\S+) ", 1)
    rows = blocks.select(*BLOCK, "n", F.coalesce(F.when(epoch != "", S.epoch_to_ts(epoch, F.col("start"))), F.col("start")).alias("ts"), ((epoch != "") & S.epoch_to_ts(epoch, F.lit(None).cast("timestamp")).isNull()).alias("odd"), F.split("text", r"\n(?=\S)").alias("pieces"), (F.trim(F.translate("text", "\r\n\t", "   ")) != "").alias("filled"))
    sizes = F.transform("pieces", lambda x: F.size(F.split(x, "\n")))
    rows = rows.withColumn("sizes", sizes)
    before = lambda i: F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), lambda a, x: a + x)
    pieces = F.transform("pieces", lambda x, i: F.struct(F.regexp_extract(x, r"^(\S[^\n]*?):\s*(?:\n|$)", 1).alias("section"), before(i).alias("before"), F.split(x, "\n").alias("rows")))
    rows = rows.select(*BLOCK, "n", "ts", "odd", "filled", F.explode(pieces).alias("p"))
    rows = rows.select(*BLOCK, "n", "ts", "odd", "filled", "p.section", "p.before", F.posexplode("p.rows").alias("i", "line"))
    indented, stamp = F.col("line").rlike(r"^\s+\S") & (F.col("section") != ""), (F.col("before") == 0) & (F.col("i") == 0)
    front, back = r"^\s+(\d+) (.+?)\s*$", r"^\s+([^:]+?)\s*:\s*(\S*).*$"
    leads = F.col("line").rlike(front)
    label = F.when(leads, F.regexp_extract("line", front, 2)).otherwise(F.regexp_extract("line", back, 1))
    raw = F.when(leads, F.regexp_extract("line", front, 1)).otherwise(F.regexp_extract("line", back, 2)).try_cast("double")
    rows = rows.filter(indented | stamp).select(*BLOCK, (F.col("n") + F.col("before") + F.col("i")).alias("n"), "ts", "filled", (F.col("odd") & stamp).alias("odd"), F.when(indented, F.col("section")).alias("section"), F.when(indented, label).alias("label"), F.when(indented, raw).alias("raw"), stamp.alias("stamp"))
    found = rows.join(_net_labels(blocks), ["section", "label"], "left").filter(F.col("stamp") | F.col("counter").isNotNull())
    problem = F.when(F.col("odd"), "malformed TS epoch; snapshot start used").when(F.col("counter").isNotNull() & F.col("raw").isNull(), F.concat(F.lit("no number for "), F.col("label")))
    return found.select(*BLOCK, "n", "ts", "filled", "counter", "raw", problem.alias("problem"))


def _net(parsed: DataFrame) -> DataFrame:
    """Polls are counted over a file's samples that have a counter, one row each."""
    found = parsed.filter("counter is not null and raw is not null")
    polls = found.select("path", "sample").distinct().withColumn("poll_idx", F.row_number().over(Window.partitionBy("path").orderBy("sample")) - 1)
    return found.join(polls, ["path", "sample"]).select("capture_id", "prefix", "poll_idx", "ts", "counter", "raw")


def read_net_counters(blocks: DataFrame) -> DataFrame:
    """S17: 'N label' and 'Label: N' under the section that a label belongs to; a section ends with its block."""
    return read_both("netstat_s", blocks)[0]


def read_hostname(lines: DataFrame) -> DataFrame:
    """S18"""
    lines = as_lines(lines)
    good = lines.filter((F.trim("line") != "") & ~F.lower("line").rlike(r"^\s*(sudo|warning):") & ~F.col("line").contains("unable to resolve host"))
    return good.groupBy("capture_id", "prefix").agg(F.trim(F.max_by("line", "n")).alias("hostname"))


def read_sysctl(lines: DataFrame) -> DataFrame:
    """S19"""
    lines = as_lines(lines)
    key, value = F.trim(F.substring_index("line", " = ", 1)), F.trim(F.expr("substr(line, instr(line, ' = ') + 3)"))
    return lines.filter(F.col("line").contains(" = ")).select("capture_id", "prefix", "n", key.alias("key"), value.alias("value")).filter(F.col("key").isin(SYSCTL)).groupBy("capture_id", "prefix", "key").agg(F.max_by("value", "n").alias("value"))


def read_cpu_boot(lines: DataFrame) -> DataFrame:
    """Most processors of any block, last boot time."""
    rows = _stamped(lines)
    per = rows.groupBy("capture_id", "prefix", "block").agg(F.count_if(F.col("line").rlike(r"^cpu\d+ ")).alias("cpus"), F.max_by(F.regexp_extract("line", r"^btime (\d+)", 1).try_cast("bigint"), F.when(F.col("line").rlike(r"^btime \d"), F.col("n"))).alias("btime"))
    return per.groupBy("capture_id", "prefix").agg(F.max("cpus").alias("logical_cpus"), F.max_by("btime", F.when(F.col("btime").isNotNull(), F.col("block"))).alias("btime"))


def read_loadavg(lines: DataFrame) -> DataFrame:
    """From the latest header."""
    lines = as_lines(lines)
    p = r"load averages?:\s*([\d.]+),?\s+([\d.]+),?\s+([\d.]+)"
    rows = lines.filter(F.col("line").rlike(r"^top - ") & F.col("line").rlike(p)).groupBy("capture_id", "prefix").agg(F.max_by("line", "n").alias("line"))
    return rows.select("capture_id", "prefix", *[F.regexp_extract("line", p, i + 1).try_cast("double").alias(c) for i, c in enumerate(("load1", "load5", "load15"))])


ENV_CORE = ["MemTotal", "MemFree", "MemAvailable", "Buffers", "Cached", "SwapTotal", "SwapFree"]


def _env_samples(lines: DataFrame) -> DataFrame:
    key = r"^([A-Za-z_()]+):\s+(\d+)"
    rows = _stamped(lines).withColumn("k", F.regexp_extract("line", key, 1)).filter(F.col("k").isin(ENV_CORE))
    at = lambda k: F.max(F.when(F.col("k") == k, F.regexp_extract("line", key, 2).try_cast("bigint"))).alias(k)
    wide = rows.groupBy(*FILE, "block").agg(*map(at, ENV_CORE), F.count_distinct("k").alias("keys"))
    return wide.withColumn("rank", F.when(F.col("keys") == len(ENV_CORE), 2).when(F.col("MemTotal").isNotNull(), 1).otherwise(0))


def read_env_memory(lines: DataFrame) -> DataFrame:
    """The newest sample with all core keys, else with the total, else with any; the last two are a fallback."""
    best = _env_samples(lines).withColumn("no", F.row_number().over(Window.partitionBy("capture_id", "prefix").orderBy(F.desc("rank"), F.desc("block"))))
    return best.filter("no = 1").select("capture_id", "prefix", *ENV_CORE, (F.col("rank") < 2).alias("fallback"))


def read_filesystems(lines: DataFrame, k: int = 5) -> DataFrame:
    """The last listing, wrapped rows joined again, fullest first."""
    rows = _stamped(lines).withColumn("f", _fields(F.col("line"))).filter((F.trim("line") != "") & ~F.col("line").startswith("Filesystem"))
    last = rows.withColumn("lastb", F.max("block").over(Window.partitionBy("path"))).filter("block = lastb")
    before = F.lag("f").over(Window.partitionBy("path").orderBy("n"))
    whole = last.withColumn("f", F.when((F.size("f") == 5) & (F.size(before) == 1), F.concat(before, "f")).otherwise(F.col("f"))).filter(F.size("f") >= 6)
    out = whole.select("capture_id", "prefix", F.col("f")[0].alias("fs"), F.array_join(F.slice("f", 6, 100), " ").alias("mount"), F.col("f")[1].try_cast("bigint").alias("size_kb"), F.col("f")[2].try_cast("bigint").alias("used_kb"), F.replace(F.col("f")[4], F.lit("%"), F.lit("")).try_cast("double").alias("use_pct"))
    ranked = out.filter("use_pct is not null").withColumn("rank", F.row_number().over(Window.partitionBy("capture_id", "prefix").orderBy(F.desc("use_pct"), "mount")))
    return ranked.filter(F.col("rank") <= k)


#: Collector -> what parses its blocks, and what makes rows and diagnostics of that.
PARSED = {"iostat": (parse_device, _device, _problems), "top": (parse_process, _process, _problems), "mysqladmin": (parse_status, _status, _status_rejects), "processlist": (parse_threads, _threads, _problems), "netstat_s": (parse_net, _net, _net_rejects)}


def read_both(collector: str, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and diagnostics of a collector's files. Where they are parsed by blocks, files are read once: what was parsed is
    written, and both come from there."""
    if collector not in PARSED:
        rejects = REJECTS.get(collector)
        return READERS[collector](blocks), rejects(blocks) if rejects else blocks.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in DIAGNOSTIC))
    parse, rows, rejects = PARSED[collector]
    parsed = written(parse(blocks))
    return rows(parsed), rejects(parsed)


#: Collector -> reader: add a collector here.
READERS = {
    "iostat": read_device, "top": read_process, "vmstat": read_host, "meminfo": read_memory, "variables": read_variables, "innodbstatus1": read_engine, "mysqladmin": read_status, "processlist": read_threads, "netstat": read_sockets, "netstat_s": read_net_counters,
    "hostname": read_hostname, "sysctl": read_sysctl, "procstat": read_cpu_boot, "df": read_filesystems,
}

#: Collector -> its diagnostics, each with the columns DIAGNOSTIC.
REJECTS = {
    "iostat": read_device_rejects, "top": read_process_rejects, "vmstat": read_host_rejects, "meminfo": read_memory_rejects, "variables": read_variables_rejects, "innodbstatus1": read_engine_rejects, "mysqladmin": read_status_rejects,
    "processlist": read_threads_rejects, "netstat": read_sockets_rejects, "netstat_s": read_net_counters_rejects,
}
