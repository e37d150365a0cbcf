"""Trees of captures, byte ranges, unsupported files, mergeable state and what the stream keeps up to date."""

import gzip
import random

from pyspark.sql import functions as F

from capturelake.operators import deltas as D
from capturelake.operators import state as C
from capturelake.operators import threads as T
from capturelake.plans import fleet
from capturelake.sources import files as S
from capturelake.sources import readers as R
from capturelake.sources import tree
from capturelake.streaming import ingest

A, B, C3 = "2026_04_21_16_51_41", "2026_04_21_16_52_11", "2026_04_21_16_52_41"


def status(*values):
    return "".join(f"+---+\n| Variable_name | Value |\n| Questions | {v} |\n| Threads_running | {v % 7} |\n| Select_scan | {v} |\n" for v in values)


def put(root, folder, **texts):
    at = root / folder
    at.mkdir(parents=True, exist_ok=True)
    for name, text in texts.items():
        prefix, _, suffix = name.partition("__")
        (at / f"{ {'a': A, 'b': B, 'c': C3}[prefix] }-{suffix}").write_text(text)


def test_every_root_is_a_capture_at_any_depth(spark, tmp_path):
    deep = "1/2/3/4/5/6/7/8"
    for n, folder in enumerate(["", "a/dump", "b/dump", "x/y/dump", deep, deep + "/9", ".hidden/dump", "with space/dümp+1"]):
        put(tmp_path / "r", folder, a__mysqladmin=status(10 + n, 20 + n), a__hostname=f"h{n}\n", a__iostat=f"Device aqu-sz %util\nsda 1 {n}\n")
    (tmp_path / "r" / "only").mkdir()
    (tmp_path / "r" / "only" / S.SUMMARIES[0]).write_text("x")
    root, want = str(tmp_path / "r"), {".", "a/dump", "b/dump", "x/y/dump", deep, "with space/dümp+1"}
    files = S.scan_files(spark, root)
    assert {r.capture_id: r.files for r in S.capture_roots(files).collect()} == {c: 3 for c in want} | {"only": 1}
    assert {(r.capture_id, r.prefix) for r in S.snapshots(files).collect()} == {(c, A) for c in want} | {("only", "unknown")}
    assert {r.capture_id: r.hostname for r in R.read_hostname(S.lines(spark, root, "hostname")).collect()} == {".": "h0", "a/dump": "h1", "b/dump": "h2", "x/y/dump": "h3", deep: "h4", "with space/dümp+1": "h7"}
    assert {r.capture_id for r in R.read_device(S.blocks(spark, root, "iostat")).collect()} == want
    assert {r.capture_id: r.t_Questions for r in fleet.facts(spark, root).selectExpr("capture_id", "cast(r_Questions as int) as t_Questions").collect()} == {c: 10 for c in want}
    ingest.stream_ingest(spark, root, "mysqladmin", R.read_status, f"{tmp_path}/t", f"{tmp_path}/s").awaitTermination()
    assert {r.capture_id for r in spark.read.parquet(f"{tmp_path}/t").collect()} == want


def test_a_wide_tree_is_listed_in_rounds(spark, tmp_path):
    for i in range(30):
        put(tmp_path / "r", f"{i % 5}/{i}/dump", a__hostname="h\n")
    whole = {(r.path, r.size) for r in tree.listing(spark, str(tmp_path / "r")).collect()}
    assert len(whole) == 30 and {(r.path, r.size) for r in tree.listing(spark, str(tmp_path / "r"), budget=3).collect()} == whole
    assert tree._by_driver(spark, tree.absolute(spark, str(tmp_path / "r")), 8).count() == 30


def reading(spark, root, suffix, **more):
    rows, rejects = R.read_both(suffix, S.blocks(spark, root, suffix, **more))
    return sorted(map(str, rows.collect())), sorted(map(str, rejects.collect()))


def test_ranges_of_any_size_give_the_same_rows(spark, tmp_path):
    rng = random.Random(1)
    device = "Linux\n\n" + "".join("Device r/s aqu-sz %util\n" + "".join(f"sd{d} 1 {rng.choice(['1,5', 'x', '2'])} {i}\n" for d in "abc"[: 1 + i % 3]) + "\navg-cpu\n" for i in range(40)) + "Device a b\nsda 1 2\n"
    top = "".join(f"top - {23 if i < 9 else 0:02d}:59:{i:02d} up\n\n  PID USER\n {i} m 20 0 1 1 1 S {'y' if i % 5 == 0 else i} 1 0:01 c d\n x m 20 0 1 1 1 S 1 1 0:01 c\nend\n" if i % 4 else f"top - 23:59:{i:02d} up\n" for i in range(20))
    threads = "".join(f"TS {1776790303 + i}.5 2026\n" + "".join(f"*** {n}. row ***\n User: u{n}\n Command: Query\n Info: select {i}\n" for n in range(i % 4)) + ("TS x y\n" if i % 6 == 0 else "") for i in range(30))
    net = "".join(f"TS {'bad' if i == 7 else 1776790303 + i} x\nTcp:\n    {i} segments retransmitted\nother\n    5 segments sent out\nTcpExt:\n    TCPBacklogDrop: {'x' if i == 3 else i}\n" if i % 5 else f"TS {1776790303 + i} x\n" for i in range(25))
    for folder, packed in (("h", False), ("z", True)):
        for suffix, text in (("iostat", device), ("top", top), ("mysqladmin", "junk\n" + status(*range(30))), ("processlist", threads), ("netstat_s", net)):
            at = tmp_path / folder / "r" / "d"
            at.mkdir(parents=True, exist_ok=True)
            if packed:
                with gzip.open(at / f"2026_04_21_23_59_00-{suffix}.gz", "wb") as f:
                    f.write(text.encode())
            else:
                (at / f"2026_04_21_23_59_00-{suffix}").write_text(text)
    plain = str(tmp_path / "h" / "r")
    for suffix in ("iostat", "top", "mysqladmin", "processlist", "netstat_s"):
        want = reading(spark, plain, suffix)
        assert want[0] and (want[1] or suffix == "mysqladmin")
        for size in (7, 64, 333):
            assert reading(spark, plain, suffix, size=size) == want, (suffix, size)
        got = reading(spark, str(tmp_path / "z" / "r"), suffix)
        assert [got[0], [x.replace(".gz", "").replace("/z/", "/h/") for x in got[1]]] == list(want)
    assert S.blocks(spark, str(tmp_path / "z" / "r"), "iostat", limit=len(device) - 1).count() == 0  # unpacked it is larger
    lines = S.lines(spark, plain, "netstat_s").orderBy("n").collect()
    assert [r.line for r in lines] == net.rstrip("\n").split("\n") and [r.n for r in lines] == list(range(1, len(lines) + 1))


def test_files_in_parts_are_read_as_one(spark, tmp_path):
    at = tmp_path / "r" / "capture=h" / f"file={A}-mysqladmin"
    at.mkdir(parents=True)
    text = status(*range(9))
    for i, lo in enumerate(range(0, len(text), 50)):
        (at / f"part-{i:05d}").write_text(text[lo : lo + 50])
    got = R.read_status(S.blocks(spark, str(tmp_path / "r"), "mysqladmin", size=70)).filter("name = 'Questions'").orderBy("sample_idx").collect()
    assert [(r.capture_id, r.sample_idx, r.raw) for r in got] == [("h", i, i) for i in range(9)]


def test_unsupported_files_give_nothing(spark, tmp_path):
    root = tmp_path / "r"
    put(root, "h", a__mysqladmin=status(1, 5), b__mysqladmin="| Variable_name | Value |\n| Questions | 900 |\n" * 2, a__variables="max_connections\t5\n")
    put(root, "i", a__mysqladmin="no marks\n")
    formats = {(r.capture_id, r.prefix, r.suffix): r.format for r in S.formats(S.scan_files(spark, str(root))).collect()}
    assert formats == {("h", A, "mysqladmin"): "v1", ("h", B, "mysqladmin"): "unsupported", ("h", A, "variables"): "unsupported", ("i", A, "mysqladmin"): "unsupported"}
    got = fleet.facts(spark, str(root)).collect()
    assert [(r.capture_id, r.r_Questions, r.v_max_connections) for r in got] == [("h", 4.0, None)]


def test_merged_state_equals_the_direct_operators(spark):
    rng = random.Random(7)
    rows = []
    for c in "xyz":
        for snap in range(3):
            for seq in range(rng.randrange(0, 9)):
                for name in ("Questions", "Threads_running"):
                    if rng.random() < 0.8:
                        rows.append((c, f"s{snap}", name, seq, seq, snap * 1000 + seq, rng.choice([None, rng.randrange(100)]), name == "Questions", rng.randrange(4)))
    samples = spark.createDataFrame(rows, "capture_id string, snapshot string, name string, ts long, seq long, seconds long, raw long, is_counter boolean, part int")
    direct = D.counter_rate(samples).join(D.gauge_max(samples), ["capture_id", "name"]).join(D.gauge_last(samples), ["capture_id", "name"], "left")
    order = ["capture_id", "name", "total", "observed_seconds", "rate", "peak", "last_value"]
    want = sorted(map(str, direct.select(*order).collect()))
    states = None
    for p in range(4):
        state = C.counter_state(samples.filter(F.col("part") == p))
        states = state if states is None else C.merge_counter_state(states.union(state))
    assert sorted(map(str, C.counters_of(states).select(*order).collect())) == want
    assert sorted(map(str, C.counters_of(C.counter_state(samples)).select(*order).collect())) == want


def test_merged_digests_equal_one_digest(spark):
    rng = random.Random(8)
    rows = [("c", rng.choice(["select 1", "select 2", "delete x"]), i, f"u{i % 3}", "d", "Query", "s", rng.choice([None, 5.0, 7.0]), rng.choice([None, 1.0]), 2.0, i, i % 3) for i in range(60)]
    every = spark.createDataFrame(rows, "k string, info string, ts long, user string, db string, command string, state string, time_ms double, rows_examined double, rows_sent double, seq long, part int")
    parts = [T.digest_state(every.filter(F.col("part") == p), ["k"]) for p in range(3)]
    merged = T.merge_digests(parts[0].union(parts[1]).union(parts[2]), ["k"])
    assert sorted(map(str, T.digests_of(merged, ["k"]).collect())) == sorted(map(str, T.query_digest(every, ["k"]).collect()))


def shown(spark, out, table):
    return sorted(str(r.asDict(True)) for r in ingest.current(spark, out, table).collect())


def test_the_stream_keeps_facts_and_findings_up_to_date(spark, tmp_path):
    root, out = tmp_path / "r", f"{tmp_path}/out"
    thread = "TS 1776790303.0 2026\n*** 1. row ***\n User: a\nCommand: Query\n State: x\n Info: alter table t\n Time_ms: 61000\n"
    go = lambda: ingest.stream_findings(spark, str(root), out, f"{tmp_path}/state").awaitTermination()
    put(root, "a/dump", a__mysqladmin=status(1, 50), a__variables="Variable_name\tValue\nmax_connections\t100\n")
    put(root, "b/dump", a__mysqladmin=status(3, 9))
    go()
    first = {r.capture_id: r.rule_id for r in ingest.current(spark, out, "findings").filter("rule_id like '%slow%'").collect()}
    put(root, "a/dump", b__mysqladmin=status(60, 200), b__processlist=thread)
    go()
    put(root, "c/dump", a__innodbstatus1="INNODB MONITOR OUTPUT\n--Thread 1 has waited at a.cc line 5 for 0 seconds\n")
    put(root, "a/dump", c__mysqladmin=status(7, 8), c__variables="Variable_name\tValue\nmax_connections\t50\n")
    go()
    go()
    facts = fleet.facts(spark, str(root)).select(*ingest.current(spark, out, "facts").columns)
    assert first == {} and shown(spark, out, "facts") == sorted(str(r.asDict(True)) for r in facts.collect())
    from capturelake.plans import findings as P

    assert shown(spark, out, "findings") == sorted(str(r.asDict(True)) for r in P.findings_table(facts).collect())
    assert [r.capture_id for r in ingest.current(spark, out, "findings").filter("rule_id like '%slow%'").collect()] == ["a/dump"]
    assert {r.batch for r in spark.read.parquet(f"{out}/facts").filter("capture_id = 'b/dump'").collect()} == {0}
    before = shown(spark, out, "findings")
    files = S.scan_files(spark, str(root)).filter(f"capture_id = 'c/dump' or (capture_id = 'a/dump' and prefix = '{C3}')")
    ingest.update(spark, tree.absolute(spark, str(root)), files, out, 2)  # the last batch once more
    assert shown(spark, out, "findings") == before


def test_a_review_says_what_became_of_every_file(spark, tmp_path):
    root = tmp_path / "r"
    put(root, "h", a__iostat="Device aqu-sz %util\nsda 1 2\nsdb x\n", b__iostat="Device aqu-sz %util\nsda 1 2\n", c__iostat="Device aqu-sz %util\n" + "sda 1 2\n" * 99, a__vmstat="no marks\n", a__mysqladmin="+- Variable_name\n", a__hostname="db\n", b__hostname="")
    said, status = fleet.review(spark, str(root), 400)
    assert {(r.suffix, r.prefix): r.status for r in status.collect()} == {("iostat", A): "partial", ("iostat", B): "ok", ("iostat", C3): "failed", ("vmstat", A): "unsupported", ("mysqladmin", A): "failed"}
    assert sorted((r.prefix, r.severity, r.location, r.message) for r in said.collect()) == [(A, "warning", "file", "fell back past 1 newer empty file(s)"), (A, "warning", "file", "unsupported format"), (A, "warning", "line 3", "unreadable device row"), (C3, "error", "file", "larger than 400 bytes")]
