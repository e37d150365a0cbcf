"""Readers on hand-written captures."""

from pyspark.sql import functions as F

from capturelake.sources import files as S
from capturelake.sources import readers as R
from capturelake.streaming.ingest import stream_ingest

A, B = "2026_04_21_16_51_41", "2026_04_21_16_52_11"


def capture(tmp_path, **files):
    """files: collector -> text, or a list of texts for the two snapshots."""
    at = tmp_path / "root" / "host1"
    at.mkdir(parents=True, exist_ok=True)
    for name, texts in files.items():
        for prefix, text in zip((A, B), [texts] if isinstance(texts, str) else texts, strict=False):
            if text is not None:
                (at / f"{prefix}-{name}").write_text(text)
    return str(tmp_path / "root")


def rows(spark, root, name, reader):
    return reader(S.blocks(spark, root, name)).collect()


def test_status_deltas_and_late_names(spark, tmp_path):
    sample = lambda **v: "+---+\n| Variable_name | Value |\n+---+\n" + "".join(f"| {k} | {x} |\n" for k, x in v.items())
    root = capture(tmp_path, mysqladmin=["junk | x | 1 |\n" + sample(Questions=251, Ssl_x="ON") + sample(Questions=254) + sample(Questions=451, Late=7), sample(Questions=5)])
    got = {(r.prefix, r.sample_idx, r.name): (r.raw, r.is_counter) for r in rows(spark, root, "mysqladmin", R.read_status)}
    assert got == {(A, 0, "Questions"): (251, True), (A, 0, "Ssl_x"): (0, False), (A, 1, "Questions"): (254, True), (A, 2, "Questions"): (451, True), (A, 2, "Late"): (7, False), (B, 0, "Questions"): (5, True)}
    from capturelake.operators import deltas as D

    long = R.read_status(S.blocks(spark, root, "mysqladmin")).select("capture_id", F.col("prefix").alias("snapshot"), "name", "ts", F.col("sample_idx").alias("seq"), "raw")
    profile = {r.name: r for r in D.counter_profile(D.counter_delta(long)).collect()}
    q = profile["Questions"]
    assert (q.total, q.low, q.high, q.whole_mean) == (200, 3, 197, 66)


def test_device(spark, tmp_path):
    text = "Linux\n\nDevice r/s aqu-sz %util\nsda 1,5 0,25 12,5\nsdb 1 x 3\n\nDevice r/s aqu-sz %util\nsda 1 2 50\nsdc 1 1 1\n"
    root = capture(tmp_path, iostat=text)
    got = [(r.device, r.sample_idx, r.util_percent, r.avgqu_sz) for r in rows(spark, root, "iostat", R.read_device)]
    assert sorted(got) == [("sda", 0, 12.5, 0.25), ("sda", 1, 50.0, 2.0), ("sdc", 0, 1.0, 1.0)]
    bad = rows(spark, root, "iostat", R.read_device_rejects)
    assert [(r.location, r.severity) for r in bad] == [("line 5", "warning")]


def test_top_past_midnight(spark, tmp_path):
    block = lambda clock, cpu: f"top - {clock} up 1 day\nTasks: 1\n\n  PID USER PR NI VIRT RES SHR S %CPU %MEM TIME+ COMMAND\n 7 mysql 20 0 1g 1g 1m S {cpu} 1.0 0:01 mysqld --x\n short row\n 8 a 20 0 1 1 1 S 9 1 0:01 late\n"
    at = tmp_path / "root" / "h"
    at.mkdir(parents=True)
    (at / "2026_04_21_23_59_58-top").write_text(block("23:59:59", "10,5") + block("00:00:04", "3"))
    got = [(str(r.ts), r.pid, r.command, r.cpu_percent) for r in rows(spark, str(tmp_path / "root"), "top", R.read_process)]
    assert sorted(got) == [("2026-04-21 23:59:59", 7, "mysqld --x", 10.5), ("2026-04-22 00:00:04", 7, "mysqld --x", 3.0)]


def test_vmstat_and_variables(spark, tmp_path):
    root = capture(tmp_path, vmstat="procs --\n r  b free r wa\n 1 2 300 99 7\n 3 0 1 0 0\n", variables="SHOW GLOBAL VARIABLES\n\nVariable_name\tValue\na\t1\na\t2\nb\tx y\nTHREAD_ID\tN\tV\n1\tc\td\nVariable_name\tValue\nz\t9\n")
    got = [(r.sample_idx, r.runqueue, r.blocked, r.free_kb, r.cpu_iowait, r.swap_in) for r in rows(spark, root, "vmstat", R.read_host)]
    assert sorted(got) == [(0, 1.0, 2.0, 300.0, 7.0, 0.0), (1, 3.0, 0.0, 1.0, 0.0, 0.0)]
    assert sorted((r.name, r.value) for r in rows(spark, root, "variables", R.read_variables)) == [("a", "1"), ("b", "x y")]


def test_memory_rejects_whole_files(spark, tmp_path):
    ok = "TS 1776790303.009 2026\nMemAvailable: 2097152 kB\nSwapTotal: 1048576 kB\nSwapFree: 2097152 kB\n"
    root = capture(tmp_path, meminfo=[ok + "TS 1776790304 2026\nSwapTotal: 3145728 kB\nSwapFree: 0 kB\n", "MemFree: 1 kB\n" + ok])
    got = rows(spark, root, "meminfo", R.read_memory)
    assert [(r.prefix, r.mem_available, r.swap_used) for r in sorted(got, key=lambda r: r.ts)] == [(A, 2.0, 0.0), (A, 0.0, 3.0)]
    no_swap = capture(tmp_path / "b", meminfo=ok + "TS 1776790309 2026\nMemFree: 1 kB\n")
    assert rows(spark, no_swap, "meminfo", R.read_memory) == []


def test_engine(spark, tmp_path):
    text = "--Thread 1 has waited at a.cc line 5 for 0 seconds\nMutex at 0x1, Mutex REDO created\n--Thread 2 has waited at a.cc line 5 for 0 seconds\n\nOther\nPending reads 1\nPending writes: LRU 6, flush list 6, single page 0\nPending reads 2\nHistory list length 133\nModified db pages  8524\nPending flushes (fsync) log: 1; buffer pool: 2\nPending flushes (fsync) log: 0; buffer pool: 3\n10.50 hash searches/s, 2.00 non-hash searches/s\n"
    root = capture(tmp_path, innodbstatus1=text)
    r = rows(spark, root, "innodbstatus1", R.read_engine)[0]
    assert (r.semaphore_count, r.pending_reads, r.pending_writes, r.history_list, r.modified_pages, r.pending_fsync_log, r.pending_fsync_bp, r.hash_per_s) == (2, 3, 12, 133, 8524, 0, 3, 10.5)
    assert sorted((r.file, r.line, r.mutex, r.wait_count) for r in rows(spark, root, "innodbstatus1", R.read_latch_waits)) == [("a.cc", 5, "", 1), ("a.cc", 5, "REDO", 1)]


def test_threads(spark, tmp_path):
    row = lambda n, **v: f"*************************** {n}. row ***************************\n" + "".join(f"{k:>13}: {x}\n" for k, x in v.items())
    text = "TS 1776790303.9 2026\n" + row(1, Id=1, User="app", Host="h:33", db="d", Command="Query", Time=5, State="", Info="SELECT 'TS 5 x'\nState: fake", Time_ms=-1) + row(2, Id=2, Info="x") + "TS 1776790304 2026\n" + row(1, User="b", Host="[::1]:5", Command="Sleep", Time_ms=70, Rows_sent="x")
    got = sorted(rows(spark, capture(tmp_path, processlist=text), "processlist", R.read_threads), key=lambda r: r.ts)
    assert [(r.user, r.host, r.command, r.time_s, r.time_ms, r.state) for r in got] == [("app", "h", "Query", 5.0, None, ""), ("b", "[::1]", "Sleep", None, 70.0, None)]
    assert str(got[0].ts).endswith("16:51:43") and got[0].info == "SELECT 'TS 5 x'"


def test_sockets_in_three_layouts(spark, tmp_path):
    netstat = "TS 1776790303 x\nProto Recv-Q Send-Q Local Foreign State\ntcp 0 0 a b ESTABLISHED\ntcp 3 0 a b ESTABLISHED\ntcp6 0 0 a b TIME_WAIT\nudp 0 7 a b\n"
    estab_udp = "State Recv-Q Send-Q Local Peer\nUNCONN 0 0 a b\nESTAB 0 0 a b\n"
    got = {(r.prefix, r.state): (r.n, r.recvq_nonzero, r.sendq_nonzero) for r in rows(spark, capture(tmp_path, netstat=[netstat, estab_udp]), "netstat", R.read_sockets)}
    assert got == {(A, "ESTABLISHED"): (2, True, False), (A, "TIME_WAIT"): (1, False, False), (A, "UDP"): (1, False, True), (B, "UDP"): (2, False, False)}
    mixed = capture(tmp_path / "b", netstat=["Netid State Recv-Q Send-Q Local Peer\ntcp LISTEN 0 128 a b\nudp UNCONN 0 0 a b\n", "LISTEN 0 128 a b\nESTAB 1 0 a b\n"])
    got = {(r.prefix, r.state): (r.n, r.recvq_nonzero, r.sendq_nonzero) for r in rows(spark, mixed, "netstat", R.read_sockets)}
    assert got == {(A, "LISTEN"): (1, False, True), (A, "UDP"): (1, False, False), (B, "LISTEN"): (1, False, True), (B, "ESTABLISHED"): (1, True, False)}


def test_net_counters(spark, tmp_path):
    text = "TS 1776790303 x\nTcp:\n    5 segments retransmitted\nIcmp:\n    6 segments retransmitted\nTS 1776790304 x\nTcpExt:\n    TCPListenOverflows: 9\n    segments retransmitted: 1\n    SyncookiesSent: x\nUdp:\n    7 receive buffer errors\nno section\n    8 send buffer errors\n"
    root = capture(tmp_path, netstat_s=text)
    got = rows(spark, root, "netstat_s", R.read_net_counters)
    assert sorted((r.counter, r.raw, r.poll_idx) for r in got) == [("tcp_listen_overflows", 9.0, 1), ("tcp_retransmits", 5.0, 0), ("udp_rcvbuf_errors", 7.0, 1)]
    assert [(r.location, r.severity) for r in rows(spark, root, "netstat_s", R.read_net_counters_rejects)] == [("line 10", "warning")]


def test_every_reader_says_what_it_cannot_use(spark, tmp_path):
    root = capture(
        tmp_path, iostat="Device aqu-sz %util\nsda 1\n", top="top - 10:00:00 up\n PID USER PR NI VIRT RES SHR S %CPU %MEM TIME+ COMMAND\n x m 20 0 1 1 1 S 1 1 0:01 c\n 5 m 20 0 1 1 1 S y 1 0:01 c\n", vmstat=" 1 2 3\n r  b  free\n 3 4 5\n",
        meminfo="MemFree: 1 kB\n", variables="Variable_name\tValue\na\t1\na\t2\n", innodbstatus1="nothing\n", mysqladmin="| Variable_name | Value |\n| a | 1 |\n| b | 1 |\n| Variable_name | Value |\n| a | 1 |\n",
        processlist="TS never x\n", netstat="TS 5 x\ntcp 0 0 a b\nESTAB 0 0 a b\n", netstat_s="Tcp:\n   no number here: x\n",
    )
    said = {c: sorted((r.severity, r.location, r.message) for r in rows(spark, root, c, R.REJECTS[c])) for c in R.REJECTS}
    assert {c: [(a, b) for a, b, _ in x] for c, x in said.items()} == {
        "iostat": [("warning", "line 2")], "top": [("warning", "line 3"), ("warning", "line 4")], "vmstat": [("warning", "line 1")], "meminfo": [("error", "file")], "variables": [("warning", "line 3")], "innodbstatus1": [("warning", "file")],
        "mysqladmin": [("warning", "file")], "processlist": [("warning", "line 1")], "netstat": [("warning", "line 2"), ("warning", "line 3")], "netstat_s": [("info", "file")],
    }
    assert said["mysqladmin"][0][2] == "b missing from 1 trailing sample(s)"


def test_oversize_files_are_not_read(spark, tmp_path):
    root = capture(tmp_path, iostat=["Device aqu-sz %util\nsda 1 2\n", "Device aqu-sz %util\n" + "sda 1 2\n" * 9])
    assert {r.prefix for r in R.read_device(S.blocks(spark, root, "iostat", limit=60)).collect()} == {A}
    assert S.oversize_files(S.scan_files(spark, root), 60).count() == 1


def test_status_of_files(spark, tmp_path):
    root = capture(tmp_path, iostat=["Device aqu-sz %util\nsda 1 2\nsdb x\n", "no mark\n"])
    files = S.scan_files(spark, root)
    rows, rejects = R.read_both("iostat", S.blocks(spark, root, "iostat", gate=True, files=files))
    got = S.file_status(files, rows, rejects, S.formats(files)).collect()
    assert {(r.prefix, r.status) for r in got} == {(A, "partial"), (B, "unsupported")}


def test_sidecars(spark, tmp_path):
    root = capture(
        tmp_path, hostname="sudo: unable to resolve host x\ndb7\n\n", sysctl="vm.swappiness = 1\nvm.swappiness = 10\nother = 3\nkernel.osrelease = 5.1.armv7l\n", procstat="TS 1 x\ncpu 1\ncpu0 1\ncpu1 1\nbtime 100\nTS 2 x\ncpu0 1\nbtime 101\n",
        df="TS 1 x\n/dev/old 1 1 1 99% /old\nTS 2 x\nFilesystem 1K Used Avail Use% Mounted on\n/dev/mapper/very-long\n  100 50 50 50% /data\n/dev/sda 10 9 1 90% /\n", meminfo="TS 1 x\n" + "".join(f"{k}: 5 kB\n" for k in R.ENV_CORE) + "TS 2 x\nMemTotal: 9 kB\n", top="top - 10:00:00 up, load average: 1.5, 2.5, 3.5\n",
    )
    assert rows(spark, root, "hostname", R.read_hostname)[0].hostname == "db7"
    assert sorted((r.key, r.value) for r in rows(spark, root, "sysctl", R.read_sysctl)) == [("kernel.osrelease", "5.1.armv7l"), ("vm.swappiness", "10")]
    assert [(r.logical_cpus, r.btime) for r in rows(spark, root, "procstat", R.read_cpu_boot)] == [(2, 101)]
    assert [(r.mount, r.use_pct) for r in sorted(rows(spark, root, "df", R.read_filesystems), key=lambda r: r.rank)] == [("/", 90.0), ("/data", 50.0)]
    assert [(r.MemTotal, r.fallback) for r in rows(spark, root, "meminfo", R.read_env_memory)] == [(5, False)]
    assert [(r.load1, r.load15) for r in rows(spark, root, "top", R.read_loadavg)] == [(1.5, 3.5)]


def test_discovery(spark, tmp_path):
    root = capture(tmp_path, iostat=["Device x\n", "no mark\n"], hostname=["h\n", ""], weird="x")
    (tmp_path / "root" / "host1" / "notes.txt").write_text("x")
    lone = tmp_path / "root" / "host2"
    lone.mkdir()
    (lone / f"{A}-output").write_text("x")
    files = S.scan_files(spark, root)
    assert {(r.capture_id, r.prefix, r.suffix) for r in files.collect()} == {("host1", A, "iostat"), ("host1", B, "iostat"), ("host1", A, "hostname"), ("host1", B, "hostname"), ("host1", A, "weird"), ("host2", A, "output")}
    assert {(r.capture_id, r.files) for r in S.capture_roots(files).collect()} == {("host1", 5), ("host2", 1)}
    assert {(r.capture_id, r.prefix, tuple(r.collectors)) for r in S.snapshots(files).collect()} == {("host1", A, ("iostat",)), ("host1", B, ("iostat",)), ("host2", A, ())}
    side = {(r.capture_id, r.suffix): (r.prefix, r.newer_empty) for r in S.latest_sidecar(files).collect()}
    assert [(r.severity, r.message) for r in S.sidecar_diagnostics(S.latest_sidecar(files)).collect()] == [("warning", "fell back past 1 newer empty file(s)")]
    assert side == {("host1", "hostname"): (A, 1), ("host2", "output"): (A, 0)}
    assert {(r.prefix, r.format) for r in S.formats(files).filter("suffix = 'iostat'").collect()} == {(A, "v1"), (B, "unsupported")}
    assert S.oversize_files(files, 7).count() == 2


def test_stream_reads_each_file_once(spark, tmp_path):
    sample = "+---+\n| Variable_name | Value |\n| Questions | 5 |\n"
    root = capture(tmp_path, mysqladmin=[sample, None], iostat="+- Variable_name\n")
    go = lambda: stream_ingest(spark, root, "mysqladmin", R.read_status, f"{tmp_path}/table", f"{tmp_path}/state").awaitTermination()
    go()
    assert spark.read.parquet(f"{tmp_path}/table").count() == 1
    capture(tmp_path, mysqladmin=[None, sample * 2])
    go()
    go()
    assert sorted((r.prefix, r.sample_idx) for r in spark.read.parquet(f"{tmp_path}/table").collect()) == [(A, 0), (B, 0), (B, 1)]


def _engine_files(spark, tmp_path, monkeypatch, orders):
    """orders.parquet of small files: blocks are read with a limit of 20,000 bytes."""
    from functools import partial

    from capturelake.queries import readers as Q

    spark.createDataFrame([(k, k * 7 % 40, "OFP"[k % 3], ["1-URGENT", "5-LOW"][k % 2]) for k in range(orders)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(S, "blocks", partial(S.blocks, limit=20_000))
    monkeypatch.setattr(Q, "FILE_KEYS", 400, raising=False)
    return Q


def test_engine_query_of_more_orders_than_a_file_holds(spark, tmp_path, monkeypatch):
    got = _engine_files(spark, tmp_path, monkeypatch, 2000).read_engine(spark, str(tmp_path)).collect()
    keys = {}
    for k in range(2000):
        keys.setdefault((f"c{k * 7 % 40 % 4}", k % 3 * 604800), []).append(k)
    want = {g: (len(x), sum(k % 7 for k in x), sum(k % 5 for k in x) + len(x), max(x), max(x) % 9) for g, x in keys.items()}
    assert {(r.capture_id, r.at): (r.semaphore_count, r.pending_reads, r.pending_writes, r.hash_table_size, r.pending_fsync_log) for r in got} == want


def test_latch_query_of_more_orders_than_a_file_holds(spark, tmp_path, monkeypatch):
    got = _engine_files(spark, tmp_path, monkeypatch, 2000).read_latch_waits(spark, str(tmp_path)).collect()
    want = {}
    for k in range(2000):
        at = (f"c{k * 7 % 40 % 4}", k % 3, f"f{k % 3}.cc", k % 4, "" if k % 2 else f"M{k % 5}")
        want[at] = want.get(at, 0) + 1
    assert {(r.capture_id, r.week, r.file, r.line, r.mutex): r.wait_count for r in got} == want


def test_files_without_heads_are_read_by_pieces(spark, tmp_path, monkeypatch):
    """Ranges and pieces of a few bytes give the rows that whole files give, and no piece is a whole file."""
    from capturelake.sources import blocks as B

    wait = "--Thread 1 has waited at a.cc line 5 for 0 seconds\n"
    stamp = lambda n: f"TS 177679030{n} x\n"
    root = capture(
        tmp_path, innodbstatus1=wait + "\n\nMutex at 0x1, Mutex REDO created\n" + wait * 2 + "Mutex at 0x1, Mutex é created\nPending reads 3\n" + wait, variables="x\n\nVariable_name\tValue\na\t1\nlong\t" + "v" * 90 + "\na\t2\nb\t3\n\nc\t4\nVariable_name\tValue\nd\t5",
        vmstat=" 9 9\n r  b  free\n 1 2 3\n 4 5 6\n r  b  buff\n 7 8 9\n", meminfo="".join(stamp(i) + f"MemFree: {i} kB\nSwapTotal: 9 kB\nSwapFree: 1 kB\n" for i in range(4)), netstat=stamp(1) + "ESTAB 0 0 a b\n\n" + stamp(2) + "UNCONN 0 0 a b\nESTAB 1 0 a b\n",
        df=stamp(1) + "/dev/old 9 9 9 9% /old\n" + stamp(2) + "/dev/mapper/long\n 100 50 50 50% /data\n/dev/x 10 9 1 90% /\n", procstat=stamp(1) + "cpu0 1\ncpu1 1\nbtime 5\n" + stamp(2) + "cpu0 1\nbtime 6\n",
    )
    of = {"innodbstatus1": [R.read_engine, R.read_latch_waits, R.read_engine_rejects], "variables": [R.read_variables, R.read_variables_rejects], "vmstat": [R.read_host, R.read_host_rejects], "meminfo": [R.read_memory, R.read_memory_rejects], "netstat": [R.read_sockets, R.read_sockets_rejects], "df": [R.read_filesystems], "procstat": [R.read_cpu_boot]}
    whole = {(c, i): sorted(map(str, rows(spark, root, c, f))) for c, fs in of.items() for i, f in enumerate(fs)}
    assert {r.mutex: r.wait_count for r in rows(spark, root, "innodbstatus1", R.read_latch_waits)} == {"REDO": 1, "é": 1, "": 2}
    assert sorted((r.name, r.value[:1]) for r in rows(spark, root, "variables", R.read_variables)) == [("a", "1"), ("b", "3"), ("long", "v")]
    run = B._reader
    monkeypatch.setattr(B, "_reader", lambda limit, gate: run(limit, gate, 8))
    for collector, fs in of.items():
        pieces = S.blocks(spark, root, collector, size=24)
        assert pieces.count() > 3
        for i, f in enumerate(fs):
            assert sorted(map(str, f(pieces).collect())) == whole[collector, i], (collector, i)


def test_variables_have_no_window_over_a_file(spark, tmp_path):
    root = capture(tmp_path, variables="Variable_name\tValue\nb\t1\na\t1\na\t2\nb\t3\nSHOW x\nc\t4\n")
    pieces = S.blocks(spark, root, "variables", size=16)
    got, said = R.read_variables(pieces), R.read_variables_rejects(pieces)
    assert sorted((r.name, r.value) for r in got.collect()) == [("a", "1"), ("b", "1")]
    assert sorted((r.location, r.message) for r in said.collect()) == [("line 4", "duplicate a; first value kept"), ("line 5", "duplicate b; first value kept")]
    assert not any("Window" in x._jdf.queryExecution().optimizedPlan().toString() for x in (got, said))


def test_a_file_written_by_several_tasks_is_read_as_one(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 8).select(F.lit("c").alias("capture"), F.lit(A).alias("prefix"), F.lit("variables").alias("suffix"), (3999 - F.col("id")).alias("ord"), F.concat(F.lit("v"), (3999 - F.col("id")).cast("string")).alias("line"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        S.land(rows, f"{tmp_path}/root", cut=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert S.scan_files(spark, f"{tmp_path}/root").count() > 1
    assert [r.line for r in S.lines(spark, f"{tmp_path}/root", "variables").orderBy("n").collect()] == [f"v{i}" for i in range(4000)]


def test_batches_of_the_stream_read_events_once(spark, tmp_path):
    from capturelake.queries import readers as Q

    day = "timestamp_seconds(id * 86400)"
    spark.range(60).selectExpr("id AS event_id", f"{day} AS ts", "id % 8 AS user_id", "array('click', 'view')[id % 2] AS event_type", "1.0 AS value").write.parquet(f"{tmp_path}/events.parquet")
    _, batches = Q._batches(spark, str(tmp_path))
    assert sum(b.count() for b in batches) == 60 * 3
    assert not any("events.parquet" in f for b in batches for f in b.inputFiles())


def orders_and_sql(spark, tmp_path, rows):
    """A folder with a table of orders (key, customer, status, priority), and what the SQL of read_variables makes of it."""
    import duckdb

    from capturelake.catalog import oracle_sql

    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    return str(tmp_path), sorted(db.sql(oracle_sql()["read_variables"]).fetchall(), key=str)


def test_variables_of_files_above_the_limit_of_captures_are_read(spark, tmp_path, monkeypatch):
    from capturelake.queries import readers as Q

    sf_dir, want = orders_and_sql(spark, tmp_path, [(i, i % 8, "OFP"[i % 7 % 3], f"{i % 5}-P") for i in range(600)])
    monkeypatch.setattr(S.blocks, "__defaults__", (100, *S.blocks.__defaults__[1:]))
    assert len(want) == 60 and sorted(map(tuple, Q.read_variables(spark, sf_dir).collect()), key=str) == want


def test_no_row_of_variables_ends_the_listing_or_gets_lost(spark, tmp_path):
    from capturelake.queries import readers as Q

    odd = [None, "", "a\tb", "a\nb", "a\r", "tail ", " x", "Variable_name", "THREAD_ID", "SHOW x", "\\N", "%", "%09", "+", "é", "\t", "\n"]
    rows = [(i, i % 8, "OFP"[i % 3], f"{i % 5}-P") for i in range(120)]
    rows += [(-12 - i, i % 4, f"v{i}", x) for i, x in enumerate(odd)] + [(-112 - i, i % 4, x, f"n{i}") for i, x in enumerate(odd)]
    rows += [(200 + i % 3, None, "F", f"{i}-P") for i in range(6)] + [(None, i % 4, "O", f"{i}-P") for i in range(6)] + [(None, None, "P", "x")]
    rows += [(1, 1, x, "tie") for x in ("b", "a", None)] + [(None, 1, x, "tie") for x in (None, "b")] + [(2, 1, None, "none")]
    sf_dir, want = orders_and_sql(spark, tmp_path, rows)
    assert sorted(map(tuple, Q.read_variables(spark, sf_dir).collect()), key=str) == want


def test_lines_of_variables_are_not_moved(spark, tmp_path):
    root = capture(tmp_path, variables=["Variable_name\tValue\nb\t1\na\t1\na\t2\nTHREAD_ID\tN\tV\nc\t4\n", "Variable_name\tValue\na\t3\n"])
    pieces = S.blocks(spark, root, "variables", size=16)
    got, said = R.read_variables(pieces), R.read_variables_rejects(pieces)
    assert sorted((r.prefix, r.name, r.value) for r in got.collect()) == [(A, "a", "1"), (A, "b", "1"), (B, "a", "3")]
    assert not any(mark in x._jdf.queryExecution().executedPlan().toString() for x in (got, said) for mark in ("SortMergeJoin", "hashpartitioning"))
