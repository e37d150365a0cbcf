"""Compression of vectors to codes: a codebook for each part of the vector, found by Lloyd's rounds over tries of parts.

Rows are read in blocks of at most ``BLOCK`` rows. In each block the parts at a position are made distinct, with the number of
rows that have them, and stand in lexicographic order, so equal prefixes are neighbours: they form a trie whose nodes of a
level are in order too, and the children of a run of nodes are a run again. A round walks each trie depth-first, a run of nodes
at a time: every node takes over its parent's squared distances to all entries and adds those of its own dimension, so a
prefix that many parts share is computed once. Leaves take the nearest entry, and add their components, times their rows, to
its sums. The stack holds a run for each level at most, whatever the size of the trie.

Tries are built and written once; a round reads them, and brings home sums of (parts * entries * dimensions) numbers, which
do not grow with the table. A block needs no row of any other, so nothing is shuffled but these sums, and a vector that a
third of all rows have is one leaf of each block.

All numbers are whole; components are cut to +-``GREATEST`` (x beyond +-4096), so that distances fit a long.

Defined cases: rows whose vector is null or holds null or non-finite components take no part; with fewer than 16 kept rows a
codebook has as many entries as there are rows; vectors of other lengths than the longest are filled up with zeros; where the
length is not a multiple of the parts, the first parts are those of floor(i * length / parts); rows without an id come after
all others when the first codebooks are chosen, and ids that repeat go by their components; repeated rows get a code each;
an empty table gives no rows; other columns are not looked at."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.llm.common import arrow_rows, join_groups, materialize, release, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
GREATEST = 1 << 24
BLOCK, RUN = 1 << 13, 1 << 11  # rows of a block of tries; nodes that are walked at once

Codebooks = list[np.ndarray]  # of each part: entries x dimensions of the part


@dataclass
class Trie:
    """Distinct rows of a block as levels of nodes: a node's value, and how many children it has. Leaves have rows."""

    values: list[np.ndarray]
    children: list[np.ndarray]  # of level d, the root's first: children[d] belongs to the nodes above values[d]
    weights: np.ndarray

    @staticmethod
    def build(parts: np.ndarray) -> tuple[Trie, np.ndarray]:
        """The trie of the rows of parts, and the leaf of each row."""
        n, width = parts.shape
        order = np.lexsort(parts.T[::-1]) if width else np.arange(n)
        rows = parts[order]
        new = np.zeros(n, bool)
        new[:1] = True
        values, children, before = [], [], np.zeros(min(n, 1), np.int64)
        for d in range(width):
            new[1:] |= rows[1:, d] != rows[:-1, d]
            at = np.flatnonzero(new)
            values.append(rows[at, d])
            children.append(np.diff(np.searchsorted(at, np.append(before, n))))
            before = at
        leaf = np.empty(n, np.int32)
        leaf[order] = np.cumsum(new) - 1
        return Trie(values, children, np.diff(np.append(np.flatnonzero(new), n))), leaf

    def walk(self, codebook: np.ndarray, run: int = RUN) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Leaves lo to hi, their squared distances to all entries, and their values, run by run and depth-first."""
        width, entries = len(self.values), len(codebook)
        if not len(self.weights):
            return
        starts = [np.append(0, np.cumsum(c)) for c in self.children]
        stack = [(0, 0, 1, np.zeros((1, entries), np.int64), np.zeros((1, 0), np.int64))]
        while stack:
            d, lo, hi, distance, path = stack.pop()
            if d == width:
                yield lo, hi, distance, path
                continue
            begin, end = int(starts[d][lo]), int(starts[d][hi])
            parent = np.repeat(np.arange(hi - lo), self.children[d][lo:hi])
            value = self.values[d][begin:end].astype(np.int64)
            for at in reversed(range(0, end - begin, run)):
                p, v = parent[at : at + run], value[at : at + run]
                step = v[:, None] - codebook[:, d]
                stack.append((d + 1, begin + at, begin + at + len(v), distance[p] + step * step, np.column_stack([path[p], v])))

    def nearest(self, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each leaf (of equally near ones the first), and its squared distance."""
        code, error = np.zeros(len(self.weights), np.int64), np.zeros(len(self.weights), np.int64)
        for lo, hi, distance, _ in self.walk(codebook):
            code[lo:hi], error[lo:hi] = distance.argmin(1), distance.min(1)
        return code, error

    def sums(self, codebook: np.ndarray) -> np.ndarray:
        """A row an entry: the rows that are nearest to it, and the sums of their components."""
        out = np.zeros((len(codebook), codebook.shape[1] + 1), np.int64)
        for lo, hi, distance, path in self.walk(codebook):
            weight = self.weights[lo:hi].astype(np.int64)
            np.add.at(out, distance.argmin(1), np.column_stack([weight, path * weight[:, None]]))
        return out


def bounds(width: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector begin, and the end of the last one."""
    return [i * width // parts for i in range(parts + 1)]


def usable(vector: Column) -> Column:
    odd = lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf"))
    return vector.isNotNull() & ~F.exists(vector, lambda x: F.coalesce(odd(x.cast("double")), F.lit(True)))


def integers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(GREATEST)), F.lit(-GREATEST)).cast("int"))


def _first(kept: DataFrame, width: int, parts: int, entries: int) -> Codebooks:
    """Codebooks of the rows with the smallest ids."""
    rows = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    whole = np.array([r.v + [0] * (width - len(r.v)) for r in rows], np.int64).reshape(len(rows), width)
    cut = bounds(width, parts)
    return [whole[:, a:b] for a, b in zip(cut, cut[1:])]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows, filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


_TRIES = "ids array<{id}>, labels array<{label}>, leaves array<array<int>>, {tries}"
_TRIE = "values array<array<int>>, children array<array<int>>, sizes array<array<int>>, weights array<array<int>>"


def _lists(rows: list[list[np.ndarray]]) -> pa.Array:
    """A row of lists for each row of arrays."""
    flat = [a for row in rows for a in row]
    inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(a) for a in flat])), pa.int32()), pa.array(np.concatenate([*flat, np.zeros(0)]).astype(np.int32)))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r) for r in rows])), pa.int32()), inner)


def _tries(kept: DataFrame, width: int, parts: int, block: int) -> DataFrame:
    """A row a block: its ids and labels, each row's leaf at each part, and the tries of all parts."""
    id_type, label_type = (kept.schema[c].dataType.simpleString() for c in ("id", "label"))
    cut = bounds(width, parts)

    def build(rows: pa.Table) -> pa.RecordBatch:
        v = _matrix(rows.column("v").combine_chunks(), width)
        built = [Trie.build(v[:, a:b]) for a, b in zip(cut, cut[1:])]
        one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column(c).combine_chunks())
        join = lambda xs: np.concatenate([*xs, np.zeros(0, np.int64)])
        columns = [one("id"), one("label"), _lists([[leaf for _, leaf in built]]), _lists([[join(t.values) for t, _ in built]]), _lists([[join(t.children) for t, _ in built]]), _lists([[np.array([len(x) for x in t.values]) for t, _ in built]]), _lists([[t.weights for t, _ in built]])]
        return pa.RecordBatch.from_arrays(columns, ["ids", "labels", "leaves", "values", "children", "sizes", "weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while len(batch):
                held.append(batch.slice(0, block - n))
                n, batch = n + len(held[-1]), batch.slice(block - n)
                if n == block:
                    yield build(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield build(pa.Table.from_batches(held))
        release()

    return kept.select("id", "label", "v").mapInArrow(run, _TRIES.format(id=id_type, label=label_type, tries=_TRIE))


def _arrays(column: pa.Array, row: int) -> list[np.ndarray]:
    """The lists of a row, as arrays."""
    lists = column[row].values
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1])


def _read(batch: pa.RecordBatch) -> Iterator[list[Trie]]:
    """The tries of every block of a batch."""
    columns = [batch.column(batch.schema.get_field_index(c)) for c in ("values", "children", "sizes", "weights")]
    for row in range(len(batch)):
        tries = []
        for values, children, sizes, weights in zip(*(_arrays(c, row) for c in columns)):
            below = np.cumsum(sizes)[:-1]
            above = np.cumsum(np.append(1, sizes)[:-1])[:-1]
            tries.append(Trie(np.split(values, below), np.split(children, above), weights) if len(sizes) else Trie([], [], weights))
        yield tries


def _round(tries: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks of the means, rounded down, of the parts nearest to each entry; unused entries stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            for block in _read(batch):
                for t, trie, book in zip(total, block, books):
                    t += trie.sums(book)
        keys = [(p, e, d) for p, t in enumerate(total) for e in range(t.shape[0]) for d in range(t.shape[1])]
        flat = np.concatenate([t.reshape(-1) for t in total])
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int32()) for i in range(3)), pa.array(flat)], ["p", "e", "d", "s"])
        release()

    rows = tries.select("values", "children", "sizes", "weights").mapInArrow(run, "p int, e int, d int, s long").groupBy("p", "e", "d").agg(F.sum("s").alias("s")).collect()
    out = [b.copy() for b in books]
    sums = {(r.p, r.e, r.d): r.s for r in rows}
    for p, book in enumerate(out):
        for e in range(len(book)):
            if n := sums.get((p, e, 0), 0):
                book[e] = [sums[p, e, d + 1] // n for d in range(book.shape[1])]
    return out


def _encode(tries: DataFrame, books: Codebooks, id_type: str, label_type: str) -> DataFrame:
    """A row of every row of every block, with its code and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, leaves = (batch.column(batch.schema.get_field_index(c)) for c in ("ids", "labels", "leaves"))
            for row, block in enumerate(_read(batch)):
                found = [trie.nearest(book) for trie, book in zip(block, books)]
                at = _arrays(leaves, row)
                codes = np.stack([code[a] for (code, _), a in zip(found, at)], 1).astype(np.uint8)
                error = sum(e[a] for (_, e), a in zip(found, at))
                yield pa.RecordBatch.from_arrays([ids[row].values, labels[row].values, pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], ["id", "label", "code", "error"])
        release()

    return tries.select("ids", "labels", "leaves", "values", "children", "sizes", "weights").mapInArrow(run, f"id {id_type}, label {label_type}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK) -> tuple[DataFrame, Codebooks]:
    """id, label, code, error of every usable vector, and the final codebooks. An index of an entry must fit a byte."""
    spark = vectors.sparkSession
    arrow_rows(spark, 1 << 13)
    assert 0 < entries <= 256
    kept = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), vectors[vec_col].alias("v")).filter(usable(F.col("v"))).select("id", "label", integers(F.col("v"), scale).alias("v"))
    width = kept.agg(F.max(F.size("v"))).first()[0] or 0
    books = _first(kept, width, parts, entries)
    tries = materialize(_tries(kept, width, parts, block))
    for _ in range(rounds):
        books = _round(tries, books)
    types = (kept.schema[c].dataType.simpleString() for c in ("id", "label"))
    return materialize(_encode(tries, books, *types)), books


def fingerprint(books: Codebooks) -> str:
    """SHA-256 of all components, by part, entry and position, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for row in b.tolist() for x in row).encode()).hexdigest()


def with_label_error(codes: DataFrame, key: str = "label", value: str = "error") -> DataFrame:
    """codes (written before: they are read twice) with the sum of value over rows of the same key; nulls are a key."""
    rows = codes.withColumn("__null", F.col(key).isNull()).withColumn("__key", F.coalesce(F.col(key).cast("string"), F.lit("")))
    groups = rows.groupBy("__key", "__null").agg(F.count("*").alias("__n"), F.sum(value).alias(f"{key}_{value}"))
    return join_groups(rows, groups, ["__key", "__null"], "__n", codes.count()).select(*codes.columns, f"{key}_{value}")


def op12_code_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return with_label_error(codes).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Rounds unrolled; every entry against every part."""
    near = "(SELECT i, p, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM (SELECT x.i, x.p, b.e, list_sum(list_transform(range(1, len(x.v) + 1), lambda k: (x.v[k] - b.v[k]) * (x.v[k] - b.v[k]))) AS dist FROM x JOIN {b} b ON b.p = x.p) GROUP BY ALL)"
    text = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS i, vec_id, label, v FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding))),
x AS MATERIALIZED (SELECT i, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS v FROM (SELECT i, v, unnest(range({PARTS})) AS p FROM k)),
b0 AS MATERIALIZED (SELECT p, i - 1 AS e, v FROM x WHERE i <= {ENTRIES})"""
    for r in range(ROUNDS):
        text += f""",
n{r} AS MATERIALIZED (SELECT x.p, n.e, x.v FROM {near.format(b=f"b{r}")} n JOIN x ON x.i = n.i AND x.p = n.p),
s{r} AS MATERIALIZED (SELECT p, e, list(m ORDER BY d) AS v FROM (SELECT p, e, d, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM (SELECT p, e, unnest(v) AS y, unnest(range(len(v))) AS d FROM n{r}) GROUP BY ALL) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.v, b.v) AS v FROM b{r} b LEFT JOIN s{r} s ON s.p = b.p AND s.e = b.e)"""
    return text + f""",
h AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, d)) AS codebooks_sha256 FROM (SELECT p, e, unnest(v) AS y, unnest(range(len(v))) AS d FROM b{ROUNDS})),
c AS (SELECT i, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM {near.format(b=f"b{ROUNDS}")} GROUP BY i)
SELECT k.vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c ON c.i = k.i CROSS JOIN h
"""


OP12_SQL = _sql()
