import json
import random

import duckdb
from pyspark.sql import functions as F

from capturelake.llm.chat import OP6_SQL, levels, link, op6_chat_tool_calls

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"
SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", False), "tags": ("array", False)}, "say": {"text": ("string", True)}}


def test_link(spark):
    calls = [
        (1, 0, "x", "add", '{"b": 1.5, "a": 2}', []), (1, 2, "y", "say", '{"text": "hé \\"q\\"\\n"}', ["x"]), (1, 3, "z", "add", '{"a": "two", "c": 1}', ["y", "gone"]), (1, 4, "p", "add", "[1]", None), (1, 5, "q", "nope", "{}", []),
        (2, 1, "x", "say", '{"text": null}', []), (2, 2, "x", "say", '{"text": "late"}', []), (3, 0, "a", "say", '{"text": "1"}', ["b"]), (3, 1, "b", "say", "not json", ["a"]), (None, 0, "n", "say", '{"text": "t"}', []), (4, 0, None, "say", None, []),
    ]
    results = [(1, 1, "x", "3"), (1, 9, "x", "again"), (1, 4, "lost", "?"), (2, 3, "x", None), (None, 1, "n", "r")]
    c = spark.createDataFrame(calls, CALLS).withColumn("level", F.lit(7)).withColumn("content", F.lit("clash")).repartition(3)
    got = {(r.conv_id, r.call_id, r.status): r for r in link(c, spark.createDataFrame(results, RESULTS), SCHEMAS).collect()}
    assert len(got) == 14
    x = got[1, "x", "linked"]
    assert (x.level, x.call_turn, x.result_turn, x.valid) == (0, 0, 1, True)
    assert x.json == '{"arguments":{"a":2,"b":1.5},"call_id":"x","content":"3","name":"add"}'
    assert got[1, "y", "open"].level == 1 and json.loads(got[1, "y", "open"].json)["arguments"]["text"] == 'hé "q"\n'
    assert got[1, "z", "open"].level == 2 and sorted(got[1, "z", "open"].errors) == ["a is not integer", "unknown c"]
    assert got[1, "p", "open"].errors == ["not a JSON object"] and got[1, "q", "open"].errors == ["unknown tool"]
    assert got[1, "lost", "orphan"].valid is False and got[1, "lost", "orphan"].json == '{"call_id":"lost","content":"?"}'
    assert got[2, "x", "linked"].call_turn == 1 and got[2, "x", "linked"].errors == ["missing text"]
    assert got[3, "a", "open"].level == -1 and got[3, "b", "open"].errors == ["not a JSON object"]
    assert (None, "n", "open") in got and (None, "n", "orphan") in got and (4, None, "open") in got


def test_levels_of_a_chain(spark):
    calls = spark.createDataFrame([(1, i, f"c{i}", "say", "{}", [f"c{i - 1}"] if i else []) for i in range(6)], CALLS)
    assert {r.call_id: r.level for r in levels(calls).collect()} == {f"c{i}": i for i in range(6)}


def test_levels_have_no_greatest_depth_and_cycles_none(spark):
    chain = [(1, i, f"c{i}", "say", "{}", [f"c{i - 1}"] if i else ["c0x"]) for i in range(150)]
    several = [(2, i, f"d{i}", "say", "{}", [f"d{j}" for j in range(max(0, i - 3), i)]) for i in range(12)]  # each waits for the three before
    mixed = [(3, 0, "a", "say", "{}", []), (3, 1, "b", "say", "{}", ["a"]), (3, 2, "c", "say", "{}", ["b"]), (3, 3, "d", "say", "{}", ["a", "c"]), (3, 4, "e", "say", "{}", ["d"]), (3, 5, "f", "say", "{}", ["e", "b"])]
    cycle = [(4, 0, "a", "say", "{}", ["b"]), (4, 1, "b", "say", "{}", ["a"]), (4, 2, "c", "say", "{}", ["b"]), (4, 3, "d", "say", "{}", ["c", "e"]), (4, 4, "e", "say", "{}", []), (4, 5, "s", "say", "{}", ["s"])]
    got = {(r.conv_id, r.call_id): r.level for r in levels(spark.createDataFrame(chain + several + mixed + cycle, CALLS)).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, f"c{i}"): i for i in range(150)}
    assert {k: v for k, v in got.items() if k[0] == 2} == {(2, f"d{i}"): i for i in range(12)}
    assert [got[3, x] for x in "abcdef"] == [0, 1, 2, 3, 4, 5]
    assert [got[4, x] for x in "abcdes"] == [-1, -1, -1, -1, 0, -1]


def test_long_text_and_empty(spark):
    text = "long " * 50000
    one = spark.createDataFrame([(1, 0, "c", "say", json.dumps({"text": text}), [])], CALLS)
    none = spark.createDataFrame([], RESULTS)
    assert json.loads(link(one, none, SCHEMAS).first().json)["arguments"]["text"] == text
    assert link(spark.createDataFrame([], CALLS), none, SCHEMAS).count() == 0


def test_each_repeat_has_its_own_row(spark):
    calls = [(1, 0, "call_0", "say", '{"text": "a"}', []), (1, 2, "call_0", "say", '{"text": "b"}', []), (1, 4, "call_0", "say", '{"text": "c"}', [])]
    results = [(1, 1, "call_0", "A"), (1, 3, "call_0", "B"), (2, 1, "x", "first"), (2, 2, "x", "second")]
    got = link(spark.createDataFrame(calls, CALLS).repartition(3), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    assert sorted((r.conv_id, r.status, r.call_turn or -1, r.result_turn or -1, json.loads(r.json).get("content", "")) for r in got) == [
        (1, "linked", -1, 1, "A"), (1, "linked", 2, 3, "B"), (1, "open", 4, -1, ""), (2, "orphan", -1, 1, "first"), (2, "orphan", -1, 2, "second"),
    ]


def longest(edges: dict) -> dict:
    """Levels by plain recursion; -1 on or behind a cycle."""
    out: dict = {}
    for _ in range(len(edges) + 1):
        for c, deps in edges.items():
            real = [d for d in set(deps or []) if d in edges]
            if c not in out and all(d in out for d in real):
                out[c] = 1 + max((out[d] for d in real), default=-1)
    return {c: out.get(c, -1) for c in edges}


def test_levels_equal_plain_recursion(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for conv in range(40):
        n, late = rng.choice([1, 7, 20]), conv % 4 == 3  # in some conversations calls wait for later ones too
        edges = {f"c{i}": [f"c{rng.randrange(n if late and rng.random() < 0.1 else max(i, 1))}" for _ in range(rng.choice([0, 1, 1, 2, 3]))] if i else [] for i in range(n)}
        rows += [(conv, i, f"c{i}", "say", "{}", edges[f"c{i}"]) for i in range(n)]
        want |= {(conv, c): v for c, v in longest(edges).items()}
    calls = spark.createDataFrame(rows, CALLS).repartition(3)
    assert {(r.conv_id, r.call_id): r.level for r in levels(calls, stretch=4).collect()} == want


def test_many_calls_that_wait_for_several(spark):
    rows = [(1, i, f"c{i}", "say", "{}", [f"c{j}" for j in (i - 1, i - 2) if j >= 0]) for i in range(1500)]
    assert {r.call_id: r.level for r in levels(spark.createDataFrame(rows, CALLS)).collect()} == {f"c{i}": i for i in range(1500)}


def test_hot_identifiers_link_as_others(spark):
    calls = [(c, i, "call_0" if i % 3 else f"u{i}", "say", json.dumps({"text": str(i)}), ["u0"]) for c in (1, 2) for i in range(60)] + [(3, None, "call_0", None, None, None)]
    results = [(c, i + 1, "call_0" if i % 3 else f"u{i}", str(i)) for c in (1, 2) for i in range(0, 50)] + [(4, i % 2, "lost", None) for i in range(30)]
    c, r = spark.createDataFrame(calls, CALLS).repartition(5), spark.createDataFrame(results, RESULTS).repartition(5)
    plain, spread = (sorted(map(str, link(c, r, SCHEMAS, one_task=n).collect())) for n in (10_000, 10))
    assert len(plain) == 151 and plain == spread


def test_registered_query_equals_sql(spark, tmp_path):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(12)] + [(2, t, "user", "x") for t in (0, 2, 6, 12, 3, 7, -1)] + [(3, 0, None, None), (None, 1, "user", None), (4, None, "user", "n"), (4, 0, "system", "s"), (4, None, "assistant", "a"), (4, 3, "assistant", None)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = op6_chat_tool_calls(spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = db.sql(OP6_SQL)
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    assert sorted(str(tuple(r)) for r in got.select(*cols).collect()) == sorted(str(r) for r in db.sql(f"SELECT {','.join(cols)} FROM want").fetchall())
    assert {r.level for r in got.filter("conv_id = 1").collect()} == {0, 1, 2, 3, 4, 5}
