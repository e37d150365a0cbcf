import math
import random

from pyspark.sql import functions as F

from capturelake.llm.knn import Splits, Tree, top_k
import numpy as np

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k):
    good = [(i, [math.floor(np.float64(np.float32(x)) * 256) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    queries = {}
    for i, v in good:
        if i % 5 == 0:
            queries[i] = min(queries.get(i, v), v)
    for q, v in queries.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def test_tree_nodes_cover_all_points_in_tight_boxes():
    rng = np.random.default_rng(0)
    points = np.vstack([rng.normal(size=(500, 3)), np.ones((400, 3))])
    tree = Tree(np.arange(900), points, 32)
    assert sorted(np.concatenate(tree.rows).tolist()) == list(range(900))
    for n, child in enumerate(tree.first):
        if child >= 0:
            assert (tree.low[n] == tree.low[child : child + 2].min(0)).all() and (tree.high[n] == tree.high[child : child + 2].max(0)).all()
        else:
            assert len(tree.rows[n]) <= 32 or (tree.low[n] == tree.high[n]).all()


def test_splits_deal_every_point_and_corners_stay_in_their_cell():
    rng = np.random.default_rng(1)
    points = np.vstack([rng.normal(size=(300, 4)), np.ones((200, 4))])
    splits = Splits(points[::3], 8)
    cell = splits.cell(points)
    assert splits.size == 8 and set(cell.tolist()) <= set(range(8)) and len(set(cell.tolist())) > 4
    for c in set(cell.tolist()):
        assert splits.cell(points[cell == c].min(0)[None])[0] == c
    assert Splits(np.ones((50, 4)), 8).size == 1


def test_best_first_leaves_boxes_unopened():
    rng = np.random.default_rng(2)
    centre = np.repeat(np.eye(8) * 1000, 200, axis=0)
    points = centre + rng.normal(size=centre.shape)
    tree = Tree(np.arange(len(points)), points, 32)
    seen = []
    scan = tree._scan
    tree._scan = lambda q, rows, *rest: (seen.append(len(q) * len(rows)), scan(q, rows, *rest))
    got = {n: ids.tolist() for n, ids, _ in tree.search(np.full(4, -1), points[::400], np.full(4, -np.inf), 3)}
    want = np.argsort(-(points[::400] @ points.T), axis=1, kind="stable")[:, :3]
    assert [sorted(got[n]) for n in range(4)] == [sorted(w) for w in want.tolist()]
    assert sum(seen) < len(points) * 4 / 2


def test_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 6) for i in range(60)]  # ties
    rows += [(400, None), (405, []), (410, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (415, [float("nan")] * 6), (420, [float("inf")] * 6), (None, [1.0] * 6), (425, [1.0, 2.0]), (426, [1.0, 3.0]), (5, [0.25] * 6), (5, [0.25] * 6)]
    vectors = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(0)).withColumn("shard", F.lit(1)).repartition(3)
    for options in ({}, {"shard_rows": 40, "block": 10}, {"shard_rows": 20, "block": 10, "max_cells": 4}):
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(vectors, F.col("vec_id") % 5 == 0, k=4, **options).collect())
        assert got == brute(rows, 4)


def test_few_and_none(spark):
    one = spark.createDataFrame([(0, [1.0]), (1, [2.0])], SCHEMA)
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in top_k(one, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0


def test_one_id_and_one_vector_of_a_third_of_the_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(200)]
    rows += [(7, [0.5, 0.25, 0.5, 0.25])] * 100 + [(1000 + i, [0.75] * 4) for i in range(100)]
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(vectors, F.col("vec_id") % 5 == 0, shard_rows=30, block=20).collect())
    assert got == brute(rows, 5)
