"""Exact top-k by inner product with KD-trees: one over the shards, and one in each of them.

The upper tree's median splits are fitted on at most ``16 * MAX_CELLS`` vectors (those of the smallest hash) and deal every
vector into one of at most ``MAX_CELLS`` cells; a cell of more than ``shard_rows`` vectors is dealt further by a hash of its
rows, so copies of one vector or of one id spread. A task builds its shard's KD-tree (median splits of the widest dimension,
tight boxes at every node) and takes a block of queries through it best-first: the upper bound of a box for a query is the
sum over dimensions of the better of its two faces, each query opens its node of the highest bound next, and it stops where
that is below its kth score. Bounds equal to the kth score are opened, as ties go to the smaller id.

Queries search one shard of their own cell first. The kth score found there goes with them: pairs of query and cell whose
tight box (over all vectors of the cell) has a bound below it are dropped before anything is shuffled. The boxes are
broadcast; there are at most ``MAX_CELLS``.

Queries are a stated set; those that reach a shard travel in blocks of at most about ``block``, so a task holds one shard and
one block whatever the input's size. Only vectors of the same dimension are compared; dimensions that the sample lacks have
one cell and no box.

Defined cases: null ids, null vectors and vectors with null or non-finite components take no part; empty vectors neither;
rows that repeat an id are candidates each, and one query (of its smallest vector); a query is no candidate of itself;
fewer than k candidates give fewer rows; an empty table gives none. Scores are exact while they stay below 2**53."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capturelake.llm.common import arrow_rows, materialize, table

K, LEAF, SHARD_ROWS, BLOCK, MAX_CELLS = 5, 128, 8192, 8192, 4096
FOUND = "query_id long, vec_id long, score long, low array<double>, high array<double>"


class Splits:
    """Median splits of a sample: node n sends a vector to child[n] where its component axis[n] is below cut[n], else to
    child[n] + 1; leaves have axis -1 and the number of their cell in child."""

    def __init__(self, points: np.ndarray, cells: int):
        self.axis, self.cut, self.child = [-1], [0.0], [0]
        todo, made = [(-len(points), 0, np.arange(len(points)))], 1  # the largest first
        while todo and made < cells:
            _, node, at = heapq.heappop(todo)
            spread = np.ptp(points[at], axis=0) if len(at) > 1 else np.zeros(1)
            if not spread.max():
                continue
            axis = int(spread.argmax())
            x = np.sort(points[at, axis])
            cut = x[len(x) // 2] if x[len(x) // 2] > x[0] else x[x > x[0]][0]
            self.axis[node], self.cut[node], self.child[node] = axis, float(cut), len(self.axis)
            for side in (at[points[at, axis] < cut], at[points[at, axis] >= cut]):
                heapq.heappush(todo, (-len(side), len(self.axis), side))
                self.axis.append(-1), self.cut.append(0.0), self.child.append(0)
            made += 1
        ends = [n for n, axis in enumerate(self.axis) if axis < 0]
        for cell, n in enumerate(ends):
            self.child[n] = cell
        self.size = len(ends)

    def cell(self, points: np.ndarray) -> np.ndarray:
        axis, cut, child = np.array(self.axis), np.array(self.cut), np.array(self.child)
        node, open_ = np.zeros(len(points), int), np.arange(len(points))
        while len(open_ := open_[axis[node[open_]] >= 0]):
            at = node[open_]
            node[open_] = child[at] + (points[open_, axis[at]] >= cut[at])
        return child[node]


def upper_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The highest inner product that each query can have in each box."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


class Tree:
    """Nodes in an array: ``first`` is a node's first child (the second follows it) or -1, ``rows`` a leaf's row numbers;
    halves stay equal in size however many points coincide."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        self.ids, self.points = ids, points
        self.first, self.rows, boxes, todo = [-1], [np.arange(len(points))], [], 0
        while todo < len(self.rows):
            at = self.rows[todo]
            low, high = points[at].min(0), points[at].max(0)
            boxes.append((low, high))
            if len(at) > leaf and (high > low).any():
                axis, half = int((high - low).argmax()), len(at) // 2
                by = np.argpartition(points[at, axis], half)
                self.first[todo] = len(self.rows)
                self.rows[todo] = at[:0]
                self.rows += [at[by[:half]], at[by[half:]]]
                self.first += [-1, -1]
            todo += 1
        self.low, self.high = (np.array(x) for x in zip(*boxes, strict=True))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query number, ids, scores) of at most k vectors that score at least kth (each query's bound so far)."""
        each = max(1, (1 << 22) // len(self.first))
        for begin in range(0, len(queries), each):
            part = slice(begin, begin + each)
            for n, ids, score in self._best_first(query_ids[part], queries[part], kth[part], k):
                yield begin + n, ids, score

    def _best_first(self, query_ids, queries, kth, k):
        score = np.full((len(queries), k), -np.inf)
        ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        floor = kth.astype(np.float64)
        #: Bounds of the nodes that a query may open next.
        front = np.full((len(queries), len(self.first)), -np.inf)
        front[:, :1] = upper_bounds(queries, self.low[:1], self.high[:1])
        live = np.arange(len(queries))
        while len(live):
            node = front[live].argmax(1)
            bound = front[live, node]
            keep = (bound >= floor[live]) & (bound > -np.inf)
            live, node = live[keep], node[keep]
            front[live, node] = -np.inf
            for n in np.unique(node).tolist():
                q, child = live[node == n], self.first[n]
                if child >= 0:
                    front[q, child : child + 2] = upper_bounds(queries[q], self.low[child : child + 2], self.high[child : child + 2])
                else:
                    self._scan(q, self.rows[n], query_ids, queries, score, ids, floor, k)
        for n in range(len(queries)):
            ok = score[n] > -np.inf
            if ok.any():
                yield n, ids[n, ok], score[n, ok]

    def _scan(self, queries_at, rows_at, query_ids, queries, score, ids, floor, k) -> None:
        part_ids, points = self.ids[rows_at], self.points[rows_at]
        for q in np.array_split(queries_at, -(-len(queries_at) * len(part_ids) // (1 << 20))):
            got = queries[q] @ points.T
            got[query_ids[q][:, None] == part_ids] = -np.inf
            got[got < floor[q][:, None]] = -np.inf
            hit = np.flatnonzero((got > -np.inf).any(1))
            if not len(hit):
                continue
            rows = q[hit]
            s = np.hstack([score[rows], got[hit]])
            i = np.hstack([ids[rows], np.broadcast_to(part_ids, (len(rows), len(part_ids)))])
            best = np.lexsort((i, -s), axis=1)[:, :k]
            score[rows], ids[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
            floor[rows] = np.maximum(floor[rows], score[rows, k - 1])


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), np.float64).reshape(rows, -1)


def _search(k: int, boxes: bool):
    """Search a shard; with boxes, a row more has its box."""

    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        low = high = None
        if len(points):
            tree = Tree(np.asarray(points["id"]), _matrix(points["v"], len(points)))
            low, high = tree.low[0], tree.high[0]
            ids = np.asarray(queries["id"])
            for n, found, score in tree.search(ids, _matrix(queries["v"], len(queries)), np.asarray(queries["kth"], np.float64), k) if len(queries) else ():
                out[0].append(np.full(len(found), ids[n]))
                out[1].append(found)
                out[2].append(score.astype(np.int64))
        cols = [np.concatenate(c).tolist() if c else [] for c in out]
        extra = [None] * len(cols[0])
        lows, highs = list(extra), list(extra)
        if boxes and low is not None:
            cols = [[*c, None] for c in cols]
            lows, highs = [*lows, low.tolist()], [*highs, high.tolist()]
        return pa.table([*(pa.array(c, pa.int64()) for c in cols), pa.array(lows, pa.list_(pa.float64())), pa.array(highs, pa.list_(pa.float64()))], ["query_id", "vec_id", "score", "low", "high"])

    return run


def _by_dimension(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(dimension, rows, matrix of their column v)."""
    for batch in batches:
        dims = np.asarray(batch["dim"])
        for dim in np.unique(dims).tolist():
            rows = batch.filter(pa.array(dims == dim))
            yield dim, rows, np.asarray(rows["v"].flatten(), np.float64).reshape(-1, dim)


def _with_cell(rows: DataFrame, splits: dict[int, Splits]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(splits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part, v in _by_dimension(batches):
            at = shared.value[dim].cell(v) if dim in shared.value else np.zeros(len(v))
            yield part.append_column("cell", pa.array(at.astype(np.int32)))

    return rows.mapInArrow(run, "id long, v array<long>, dim int, q boolean, salt long, cell int")


def _cells_to_search(queries: DataFrame, boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """A row for each query and each cell whose box can hold a score of the query's kth or more."""
    shared = queries.sparkSession.sparkContext.broadcast(boxes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part, v in _by_dimension(batches):
            n, cell = np.arange(len(v)), np.zeros(len(v), int)
            if dim in shared.value:
                cells, low, high = shared.value[dim]
                n, at = np.nonzero(upper_bounds(v, low, high) >= np.asarray(part["kth"], np.float64)[:, None])
                cell = cells[at]
            for i in range(0, len(n), 4096):
                yield part.take(pa.array(n[i : i + 4096])).append_column("cell", pa.array(cell[i : i + 4096].astype(np.int32)))

    return queries.mapInArrow(run, "id long, v array<long>, dim int, home_cell int, home int, kth double, cell int")


def integers(vector: Column) -> Column:
    """floor(256 * x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def _fit(rows: DataFrame, max_cells: int, shard_rows: int) -> dict[int, Splits]:
    """Splits for each dimension of the sample, of about a cell for shard_rows rows in all, max_cells at most."""
    n = rows.count()
    cells = min(max_cells, max(1, -(-n // shard_rows)))
    sample = rows.select("v", "dim", F.xxhash64("id", "v").alias("h")).orderBy("h", "v").limit(16 * cells).collect() if n else []
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r.dim, []).append(r.v)
    return {dim: Splits(np.array(v, np.float64), max(1, cells * len(v) // len(sample))) for dim, v in by_dim.items()}


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, shard_rows: int = SHARD_ROWS, block: int = BLOCK, max_cells: int = MAX_CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest inner product of integers() for each query."""
    arrow_rows(vectors.sparkSession)
    rows = vectors.filter(usable(vectors[vec_col]) & vectors[id_col].isNotNull()).select(vectors[id_col].cast("long").alias("id"), integers(vectors[vec_col]).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.select("id", "v", F.size("v").alias("dim"), "q", F.monotonically_increasing_id().alias("salt"))
    splits = _fit(rows, max_cells, shard_rows)
    rows = materialize(_with_cell(rows, splits))
    key = ["dim", "cell"]
    cells = materialize(rows.groupBy(*key).agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")))
    points = rows.join(cells, key).select("id", "v", *key, F.pmod(F.xxhash64("id", "salt"), "shards").cast("int").alias("shard"))
    queries = rows.filter("q").groupBy("id").agg(F.min(F.struct("v", *key)).alias("first")).select("id", "first.*")
    queries = materialize(queries.join(cells, key).select("id", "v", *key, F.pmod(F.xxhash64("id"), "shards").cast("int").alias("shard")))

    place = [*key, "shard"]
    first = queries.select("id", "v", F.lit(float("-inf")).alias("kth"), *place)
    near = points.groupBy(*place).cogroup(first.groupBy(*place)).applyInArrow(_search(k, True), FOUND)
    # Boxes are rows of their own; the lower corner of a shard's box lies in its cell, as cells are boxes themselves.
    near = materialize(near)
    boxes = _boxes(near.filter("query_id is null"), splits)
    near = near.filter("query_id is not null").select("query_id", "vec_id", "score")
    kth = near.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n"))
    bound = F.when(F.col("n") == k, F.col("low").cast("double")).otherwise(float("-inf"))
    known = queries.join(kth, queries["id"] == kth["query_id"], "left").select("id", "v", "dim", F.col("cell").alias("home_cell"), F.col("shard").alias("home"), bound.alias("kth"))
    pairs = materialize(_cells_to_search(known, boxes))
    met = pairs.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).join(cells, key)
    each = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")
    away = pairs.join(met, key).select("id", "v", "kth", *key, "home_cell", "home", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), each)
    away = away.filter("cell <> home_cell or shard <> home").select("id", "v", "kth", *place, "block")
    there = points.join(met.drop("shards"), key).select("id", "v", *place, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    far = there.groupBy(*place, "block").cogroup(away.groupBy(*place, "block")).applyInArrow(_search(k, False), FOUND)
    near = near.union(far.select("query_id", "vec_id", "score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _boxes(shards: DataFrame, splits: dict[int, Splits]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each dimension that has splits: cells, and the lower and upper corners of their tight boxes."""
    shared = shards.sparkSession.sparkContext.broadcast(splits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for low, high in zip(batch["low"].to_pylist(), batch["high"].to_pylist(), strict=True):
                if len(low) in shared.value:
                    low, high = np.array(low), np.array(high)
                    box = found.setdefault((len(low), int(shared.value[len(low)].cell(low[None])[0])), [low, high])
                    box[:] = np.minimum(box[0], low), np.maximum(box[1], high)
        if found:
            yield pa.RecordBatch.from_pylist([{"dim": d, "cell": c, "low": b[0].tolist(), "high": b[1].tolist()} for (d, c), b in found.items()])

    partial = shards.select("low", "high").mapInArrow(run, "dim long, cell long, low array<double>, high array<double>")
    at = partial.select("dim", "cell", F.posexplode(F.arrays_zip("low", "high")).alias("n", "face"))
    faces = at.groupBy("dim", "cell", "n").agg(F.min("face.low").alias("low"), F.max("face.high").alias("high"))
    sides = faces.groupBy("dim", "cell").agg(F.sort_array(F.collect_list(F.struct("n", "low", "high"))).alias("side"))
    out: dict[int, list] = {}
    for r in sides.select("dim", "cell", "side.low", "side.high").orderBy("dim", "cell").collect():
        out.setdefault(r.dim, []).append((r.cell, r.low, r.high))
    return {dim: tuple(np.array(x) for x in zip(*rows, strict=True)) for dim, rows in out.items()}


def op3_topk_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors["vec_id"] % 50 == 0)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
