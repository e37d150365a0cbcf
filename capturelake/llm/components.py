"""Connected components of a distributed edge list by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import Scratch, join_groups


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component for every end of the edges (a, b); a component is named by its smallest node.

    Each round points every node to the neighbour (or itself) with the smallest hash and contracts the edges; hashes make
    the number of rounds logarithmic in expectation, whatever the order of ids. No round collects anything to the driver."""
    left = scratch.table(edges.select("a", "b").filter("a <> b").distinct())
    nodes = scratch.table(left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct())
    label, total = nodes.select("node", F.col("node").alias("root")), nodes.count()
    while edges_left := left.count():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id"))).alias("m"), F.count("*").alias("n"))
        step = scratch.table(near.select("a", "n", F.least(F.col("m"), F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("id")))["id"].alias("to")))
        held = label.groupBy("root").agg(F.count("*").alias("of")).join(step.select(F.col("a").alias("root"), "to"), "root")
        label = scratch.table(join_groups(label, held, ["root"], "of", total).select("node", F.coalesce("to", "root").alias("root")))
        half = scratch.table(join_groups(left, step, ["a"], "n", edges_left, "inner").select("b", F.col("to").alias("ta")))
        ends = join_groups(half, step.withColumnRenamed("a", "b"), ["b"], "n", edges_left, "inner").select(F.col("ta").alias("a"), F.col("to").alias("b"))
        left = scratch.table(ends.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    name = scratch.table(label.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("n")))
    return scratch.table(join_groups(label, name, ["root"], "n", total, "inner").select("node", "component"))
