"""Tool-call linking for chat data, in DataFrame functions only.

Calls and results meet in a hash join on (conversation, identifier). A call may name calls it must come after; levels of
the dependency graph order calls, and a result follows its call. Arguments are checked against the tool's schema and
everything is serialised as canonical JSON: keys sorted, no spaces, nulls left out. One row leaves for each link, so no
conversation is ever gathered into one row or task.

Levels: a conversation of at most ``STRETCH`` calls is one array, settled in one pass in order of turns. In longer ones, runs of
calls that each wait for one other are shortened by pointer doubling, so a chain of any length takes a logarithmic number of
rounds; calls that wait for several are dealt by turn into stretches, a round and a pass each. Only where a call waits for a
later one, or for a cycle, its conversation's calls follow in topological order, a round a level. There is no greatest depth.

An identifier that a conversation repeats very often is numbered by a sort over ranges, so its rows are the work of many tasks.

Defined cases: where a conversation repeats an identifier, the k-th call (by turn, then name, then arguments) meets the k-th
result, and those that are left are 'open' or 'orphan' rows of their own (references by identifier mean the first call,
whose level all of them have); a call without a result is 'open', a result without a call 'orphan'; a null conversation or
identifier never links (each row stands alone); references to absent calls are ignored; calls on or behind a cycle have level
-1; arguments that are null, not JSON or not an object are invalid; an empty table gives no rows; other columns are ignored;
texts of any length pass through whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capturelake.llm.common import Scratch, join_groups, materialize, table

#: tool -> parameter -> (JSON kind, whether it is required)
Schemas = dict[str, dict[str, tuple[str, bool]]]
#: Calls of a conversation whose levels come from one pass; rows of one identifier that may be numbered in one task.
STRETCH, ONE_TASK = 1024, 10_000
_KIND = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}


def _kind_of(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Array of what is wrong with the arguments (JSON text) of a call; empty if they fit the tool's schema."""
    value = F.try_parse_json(arguments)
    out = F.array(F.lit("unknown tool"))
    for tool, params in sorted(schemas.items()):
        found = []
        for param, (kind, required) in sorted(params.items()):
            got = F.try_variant_get(value, f"$.{param}", "variant")
            if required:
                found.append(F.when(got.isNull() | F.is_variant_null(got), F.lit(f"missing {param}")))
            found.append(F.when(got.isNotNull() & ~F.is_variant_null(got) & ~_kind_of(got).isin(_KIND[kind]), F.lit(f"{param} is not {kind}")))
        keys = F.json_object_keys(arguments)
        extra = F.transform(F.array_except(F.array_sort(keys), F.array(*map(F.lit, sorted(params))).cast("array<string>")), lambda k: F.concat(F.lit("unknown "), k))
        errors = F.concat(F.filter(F.array(*found), lambda x: x.isNotNull()), F.coalesce(extra, F.array().cast("array<string>")))
        out = F.when(name == tool, errors).otherwise(out)
    return F.when(value.isNull() | (_kind_of(value) != "OBJECT"), F.array(F.lit("not a JSON object"))).otherwise(out)


def canonical(arguments: Column) -> Column:
    """JSON with sorted keys and no spaces; null where the text is not JSON."""
    return F.to_json(F.try_parse_json(arguments))


def _ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows and their number (rank, from 0) in their group by order. A sort over ranges: a group may span many tasks; rows of
    the same group before a range are counted, not moved."""
    placed = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = materialize(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    sizes = placed.groupBy(*group, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select(*group, "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(begins, [*group, "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def levels(calls: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """conv_id, call_id, level of each call (conv_id, call_id, turn, after; one row an identifier): 0 without dependencies, else
    one more than the deepest call that must come before; -1 on or behind a cycle."""
    cols = ["conv_id", "call_id", "turn", "after"]
    calls = calls.select(*cols)
    sizes = calls.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.greatest(F.coalesce(F.size("after"), F.lit(0)), F.lit(0))).alias("edges"))
    sizes = sizes.withColumn("large", (F.col("n") > stretch) | (F.col("edges") > 4 * stretch))
    with Scratch(calls.sparkSession) as scratch:
        rest = calls.limit(0)
        if sizes.agg(F.max("large")).first()[0]:
            calls = scratch.table(calls)
            calls = scratch.table(join_groups(calls, scratch.table(sizes), ["conv_id"], "n", calls.count()).select(*cols, "large"))
            calls, rest = calls.filter("not large").select(*cols), calls.filter("large").select(*cols)
        whole = calls.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "call_id", "after"))).alias("calls"))
        whole = whole.select("conv_id", "calls", F.col("calls.call_id").alias("ids"))
        places = lambda c: F.transform(c.after, lambda dep: F.array_position("ids", dep))
        # A call that waits for a later one, or for itself, gets -1: its conversation is left to the way of large ones.
        deepest = lambda found, at: F.when(F.exists(at, lambda p: p > F.size(found)), F.lit(-1)).otherwise(F.coalesce(F.array_max(F.transform(F.filter(at, lambda p: p > 0), lambda p: F.get(found, (p - 1).cast("int")))) + 1, F.lit(0)))
        found = F.aggregate(F.transform("calls", places), F.array().cast("array<int>"), lambda found, at: F.concat(found, F.array(F.coalesce(deepest(found, at), F.lit(0)))))
        odd = F.array_contains("level", -1)
        whole = materialize(whole.withColumn("level", found).select("conv_id", F.when(odd, F.col("calls")).alias("calls"), F.when(~odd, F.arrays_zip("ids", "level")).alias("settled")))
        out = whole.select("conv_id", F.explode("settled").alias("s")).select("conv_id", F.col("s.ids").alias("call_id"), "s.level")
        left = scratch.table(rest.unionByName(whole.select("conv_id", F.explode("calls").alias("c")).select("conv_id", "c.*")))
        return out if left.isEmpty() else out.union(_levels_of_large(left, stretch, scratch))


def _levels_of_large(calls: DataFrame, stretch: int, scratch: Scratch) -> DataFrame:
    """levels() of calls, without an array a conversation."""
    key = ["conv_id", "call_id"]
    named = scratch.table(calls.select(*key, F.explode("after").alias("dep")).distinct())
    asked = named.groupBy("conv_id", "dep").agg(F.count("*").alias("n"))
    there = scratch.table(asked.join(calls.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_semi"))
    edges = scratch.table(join_groups(named, there, ["conv_id", "dep"], "n", named.count(), "inner").select(*key, "dep"))
    waits = edges.groupBy(*key).agg(F.count("*").alias("waits"), F.min("dep").alias("dep"))
    nodes = scratch.table(calls.select(*key, "turn").join(waits, key, "left").select(*key, "turn", F.coalesce("waits", F.lit(0)).alias("waits"), "dep"))
    anchor = _anchors(nodes.filter("waits = 1").select(*key, "dep"), scratch)
    known = scratch.table(nodes.filter("waits = 0").select(*key, F.lit(0).alias("level")))
    several = nodes.filter("waits > 1").select(*key, "turn", "waits")
    level = known if several.isEmpty() else _several(several, edges, anchor, known, stretch, scratch)
    ends = level.select("conv_id", F.col("call_id").alias("to"), "level")
    behind = anchor.join(ends, ["conv_id", "to"]).select(*key, (F.col("level") + F.col("dist")).alias("level"))
    every = level.union(behind)
    return materialize(nodes.select(*key).join(every, key, "left").select(*key, F.coalesce("level", F.lit(-1)).alias("level")))


def _several(several: DataFrame, edges: DataFrame, anchor: DataFrame, roots: DataFrame, stretch: int, scratch: Scratch) -> DataFrame:
    """Levels of roots and of the calls that wait for several others."""
    key = ["conv_id", "call_id"]
    placed = _ranked(several, ["conv_id"], ["turn", "call_id"]).select(*key, "waits", F.col("rank").cast("long").alias("rank"))
    placed = scratch.table(placed)
    # Each edge leads to the end of a run, which is a root or such a call again; only a cycle has no end.
    end = F.struct(F.coalesce("to", "dep").alias("to"), (F.coalesce("dist", F.lit(0)) + 1).alias("dist"))
    runs = anchor.select("conv_id", F.col("call_id").alias("dep"), "to", "dist")
    mine = scratch.table(join_groups(edges, placed, key, "waits", edges.count(), "inner").select(*key, "rank", "dep"))
    left = scratch.table(mine.join(runs, ["conv_id", "dep"], "left").select(*key, "rank", end.alias("e")).select(*key, "rank", "e.*"))
    asked = left.groupBy("conv_id", "to").agg(F.count("*").alias("n"))
    at = placed.select("conv_id", F.col("call_id").alias("to"), F.col("rank").alias("to_rank")).union(roots.select("conv_id", F.col("call_id").alias("to"), F.lit(-1).cast("long")))
    left = scratch.table(join_groups(left, scratch.table(asked.join(at, ["conv_id", "to"], "left")), ["conv_id", "to"], "n", left.count()).select(*key, "rank", "to", "dist", "to_rank"))
    # A call that waits for a later one, or for a cycle, cannot be settled in order of turns.
    odd = scratch.table(left.filter("to_rank is null or to_rank >= rank").select("conv_id").distinct())
    if odd.isEmpty():
        return roots.union(_by_stretch(placed, left, stretch, scratch))
    sizes = scratch.table(left.groupBy("conv_id").agg(F.count("*").alias("n")).join(odd.withColumn("odd", F.lit(True)), "conv_id", "left"))
    left = scratch.table(join_groups(left, sizes, ["conv_id"], "n", left.count()).drop("n"))
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("n")).join(sizes.select("conv_id", "odd"), "conv_id")
    placed = scratch.table(join_groups(placed, scratch.table(sizes), ["conv_id"], "n", placed.count()).drop("n"))
    inorder = _by_stretch(placed.filter("odd is null"), left.filter("odd is null"), stretch, scratch)
    return roots.union(inorder).union(_by_round(left.filter("odd").select(*key, "to", "dist"), roots, scratch))


def _by_stretch(placed: DataFrame, left: DataFrame, stretch: int, scratch: Scratch) -> DataFrame:
    """Levels of calls that wait for earlier ones only (placed: rank in the conversation; left: their edges). Each round settles
    the next stretch of every conversation: first the calls before it are looked up, then one pass over an array of the rest."""
    key = ["conv_id", "call_id"]
    most = placed.agg(F.max("rank")).first()[0]
    done: list[DataFrame] = []
    for begin in range(0, (most if most is not None else -1) + 1, stretch):
        now = left.filter((F.col("rank") >= begin) & (F.col("rank") < begin + stretch))
        inside = now.filter(F.col("to_rank") >= begin).groupBy("conv_id", "rank").agg(F.collect_list(F.struct((F.col("to_rank") - begin).cast("int").alias("at"), "dist")).alias("inside"))
        root = now.filter("to_rank < 0").select("conv_id", "rank", F.col("dist").alias("base"))
        if done:
            earlier = reduce(DataFrame.union, done).select("conv_id", F.col("rank").alias("to_rank"), "level")
            met = now.filter((F.col("to_rank") >= 0) & (F.col("to_rank") < begin)).join(earlier, ["conv_id", "to_rank"])
            root = root.union(met.select("conv_id", "rank", F.col("level") + F.col("dist")))
        calls = placed.filter((F.col("rank") >= begin) & (F.col("rank") < begin + stretch)).select("conv_id", "rank")
        calls = calls.join(root.groupBy("conv_id", "rank").agg(F.max("base").alias("base")), ["conv_id", "rank"], "left").join(inside, ["conv_id", "rank"], "left")
        rows = calls.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.coalesce("base", F.lit(0)).cast("int").alias("base"), "inside"))).alias("calls"))
        deepest = lambda found, c: F.greatest(c.base, F.coalesce(F.array_max(F.transform(c.inside, lambda e: F.get(found, e.at) + e.dist)), F.lit(0)))
        found = F.aggregate("calls", F.array().cast("array<int>"), lambda found, c: F.concat(found, F.array(deepest(found, c).cast("int"))))
        done.append(scratch.table(rows.select("conv_id", F.posexplode(found).alias("pos", "level")).select("conv_id", (F.col("pos") + begin).cast("long").alias("rank"), "level")))
        if len(done) == 16:
            done = [scratch.table(reduce(DataFrame.union, done))]
    if not done:
        return placed.select(*key, F.lit(0).alias("level"))
    return scratch.table(placed.join(reduce(DataFrame.union, done), ["conv_id", "rank"]).select(*key, "level"))


def _by_round(left: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame:
    """Levels of the calls of left (their edges) in any order, a round a level; those on or behind a cycle are left out."""
    key = ["conv_id", "call_id"]
    done = []
    left = scratch.table(left)
    while not left.isEmpty():
        ends = known.select("conv_id", F.col("call_id").alias("to"), "level")
        met = scratch.table(left.join(ends, ["conv_id", "to"], "left").select(*key, "to", "dist", "level"))
        new = scratch.table(met.groupBy(*key).agg(F.count("*").alias("n"), F.count("level").alias("met"), F.max(F.col("level") + F.col("dist")).alias("level")).filter("n = met").select(*key, "level"))
        if new.isEmpty():  # only cycles are left, and what is behind them
            break
        done = [scratch.table(reduce(DataFrame.union, [*done, new]))]
        known = scratch.table(known.union(new))
        left = scratch.table(left.join(new.select(*key), key, "left_anti"))
    return done[0] if done else known.limit(0)


def _anchors(waits: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, call_id, to, dist: where the run of calls that wait for one other (dep) ends, and how far away. The distance
    doubles each round; a run longer than its conversation's calls is a cycle and has no end."""
    key = ["conv_id", "call_id"]
    open_ = scratch.table(waits.select(*key, F.col("dep").alias("to"), F.lit(1).alias("dist")))
    most = open_.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    ended = []
    jump = open_
    for _ in range(most.bit_length() + 1):
        total = open_.count()
        if not total:
            break
        to = jump.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("dist").alias("further"))
        held = scratch.table(open_.groupBy("conv_id", "to").agg(F.count("*").alias("n")).join(to, ["conv_id", "to"]))
        stepped = scratch.table(join_groups(open_, held, ["conv_id", "to"], "n", total))
        ended.append(stepped.filter("next is null").select(*key, "to", "dist"))
        open_ = scratch.table(stepped.filter("next is not null").select(*key, F.col("next").alias("to"), (F.col("dist") + F.col("further")).alias("dist")))
        jump = scratch.table(open_.union(ended[-1]).union(reduce(DataFrame.union, ended[:-1]))) if len(ended) > 1 else scratch.table(open_.union(ended[-1]))
    return reduce(DataFrame.union, ended) if ended else open_


def _numbered(rows: DataFrame, order: list[str], one_task: int) -> tuple[DataFrame, DataFrame | None]:
    """rows with their number (nth, from 1) among those of their identifier, and the identifiers, a thousand at most, of more
    than one_task rows and a thousandth of all; None without any."""
    key = ["conv_id", "call_id"]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n"))
    most, total = sizes.agg(F.max("n"), F.sum("n")).first()
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    bound = max(one_task, (total or 0) // 1000)
    if (most or 0) <= bound:
        return rows.withColumn("nth", nth), None
    hot = materialize(sizes.filter(F.col("n") > bound).select(*key))
    rest = rows.join(F.broadcast(hot), key, "left_anti").withColumn("nth", nth)
    spread = _ranked(rows.join(F.broadcast(hot), key, "left_semi"), key, order)
    return rest.unionByName(spread.withColumn("nth", (F.col("rank") + 1).cast("int")).drop("rank")), hot


def link(calls: DataFrame, results: DataFrame, schemas: Schemas, one_task: int = ONE_TASK) -> DataFrame:
    """calls: conv_id, turn, call_id, name, arguments, after (array of identifiers); results: conv_id, turn, call_id, content.

    Returns conv_id, call_id, status, level, call_turn, result_turn, valid, errors, json."""
    key = ["conv_id", "call_id"]
    keyed = "conv_id is not null and call_id is not null"
    one = materialize(calls.filter(keyed).groupBy(key).agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c")).select(*key, "c.turn", "c.after"))
    every, hot_calls = _numbered(calls.filter(keyed).select(*key, "turn", "name", "arguments", "after"), ["turn", "name", "arguments", "after"], one_task)
    answers, hot_answers = _numbered(results.filter(keyed).select(*key, "turn", "content"), ["turn", "content"], one_task)
    every = every.select(*key, F.col("turn").alias("call_turn"), "name", "arguments", F.lit(True).alias("called"), "nth")
    answers = answers.select(*key, F.col("turn").alias("result_turn"), "content", F.lit(True).alias("answered"), "nth")
    linked = every.hint("shuffle_hash").join(answers, [*key, "nth"], "full_outer").drop("nth")
    none = lambda kind: F.lit(None).cast(kind)
    loose_calls = calls.filter(f"not ({keyed})").select(*key, F.col("turn").alias("call_turn"), "name", "arguments", F.lit(True).alias("called"), none("long").alias("result_turn"), none("string").alias("content"), none("boolean").alias("answered"))
    loose_results = results.filter(f"not ({keyed})").select(*key, none("long").alias("call_turn"), none("string").alias("name"), none("string").alias("arguments"), none("boolean").alias("called"), F.col("turn").alias("result_turn"), "content", F.lit(True).alias("answered"))
    rows = linked.unionByName(loose_calls).unionByName(loose_results)
    level, hot = levels(one), [h for h in (hot_calls, hot_answers) if h is not None]
    if hot:  # rows of identifiers that are repeated very often stay where they are
        hot, rows = reduce(DataFrame.union, hot).distinct(), materialize(rows)
        few = F.broadcast(hot.join(level, key, "left"))
        rows = rows.join(few, key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(level, key, "left"))
    else:
        rows = rows.join(level, key, "left")
    is_call = F.col("called").isNotNull()
    errors = F.when(is_call, argument_errors(F.col("name"), F.col("arguments"), schemas))
    status = F.when(~is_call, "orphan").when(F.col("answered").isNull(), "open").otherwise("linked")
    return rows.select(
        *key, status.alias("status"), F.when(is_call, F.coalesce("level", F.lit(0))).cast("long").alias("level"),
        "call_turn", "result_turn", F.coalesce(F.size(errors) == 0, F.lit(False)).alias("valid"), errors.alias("errors"),
        F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), "call_id", "content", "name")).alias("json"),
    )


#: Turns as calls: a user's turn asks for a reply, the turn after it answers; each call comes after those two and four turns before.
REPLY: Schemas = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}}


def op6_chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of other roles (or none) are rows of their own, with status 'message'."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    named = lambda turn: F.concat(F.lit("c"), turn.cast("string"))
    calls = turns.filter("role = 'user'").select("conv_id", "turn", named(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct("turn", F.col("text").alias("prompt"))).alias("arguments"), F.array_compact(F.array(named(F.col("turn") - 2), named(F.col("turn") - 4))).alias("after"))
    results = turns.filter("role = 'assistant'").select("conv_id", "turn", named(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    linked = link(calls, results, REPLY).withColumn("errors", F.array_join("errors", "; "))
    other = turns.filter("role is null or role not in ('user', 'assistant')")
    null = F.lit(None)
    messages = other.select("conv_id", named(F.col("turn")).alias("call_id"), F.lit("message").alias("status"), null.cast("long").alias("level"), F.col("turn").alias("call_turn"), null.cast("long").alias("result_turn"), F.lit(False).alias("valid"), null.cast("string").alias("errors"), F.to_json(F.struct(F.col("text").alias("content"), "role")).alias("json"))
    return linked.unionByName(messages)


OP6_SQL = """
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations),
u AS (SELECT conv_id, turn, text AS prompt, '{' || concat_ws(',', '"prompt":' || to_json(text), '"turn":' || turn) || '}' AS args FROM t WHERE role = 'user'),
c AS (SELECT *, 'c' || turn AS call_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY args) AS k FROM u),
r AS (SELECT conv_id, turn AS result_turn, text AS content, 'c' || (turn - 1) AS call_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text NULLS FIRST) AS k FROM t WHERE role = 'assistant'),
d AS (SELECT DISTINCT conv_id, turn FROM u WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
g AS (SELECT *, CASE WHEN turn - lag(turn) OVER (PARTITION BY conv_id, abs(turn % 2) ORDER BY turn) <= 4 THEN 0 ELSE 1 END AS starts FROM d),
i AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id, abs(turn % 2) ORDER BY turn) AS run FROM g),
l AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, abs(turn % 2), run ORDER BY turn) - 1 AS level FROM i)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id,
       CASE WHEN c.k IS NULL THEN 'orphan' WHEN r.k IS NULL THEN 'open' ELSE 'linked' END AS status,
       CASE WHEN c.k IS NOT NULL THEN CAST(coalesce(l.level, 0) AS BIGINT) END AS level, c.turn AS call_turn, r.result_turn, c.k IS NOT NULL AND c.prompt IS NOT NULL AND c.turn IS NOT NULL AS valid,
       CASE WHEN c.k IS NOT NULL THEN concat_ws('; ', CASE WHEN c.prompt IS NULL THEN 'missing prompt' END, CASE WHEN c.turn IS NULL THEN 'missing turn' END) END AS errors,
       '{' || concat_ws(',', CASE WHEN c.k IS NOT NULL THEN '"arguments":' || c.args END, '"call_id":' || to_json(coalesce(c.call_id, r.call_id)),
                        '"content":' || to_json(r.content), CASE WHEN c.k IS NOT NULL THEN '"name":"reply"' END) || '}' AS json
FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id AND c.k = r.k
LEFT JOIN l ON l.conv_id = c.conv_id AND l.turn = c.turn
UNION ALL
SELECT conv_id, 'c' || turn, 'message', NULL, turn, NULL, false, NULL, '{' || CASE WHEN text IS NULL THEN '' ELSE '"content":' || to_json(text) || CASE WHEN role IS NULL THEN '' ELSE ',' END END || CASE WHEN role IS NULL THEN '' ELSE '"role":' || to_json(role) END || '}'
FROM t WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""
