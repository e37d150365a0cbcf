"""Sequence packing by Karmarkar-Karp multiway differencing.

Whole windows are cut from each document first; what remains is cut into parts of at most ``part`` tokens (of every sixth
document into ``fine`` ones, which even out the windows), and blocks of parts are dealt into windows by largest differencing: the two partial partitions with the largest imbalance are merged,
the heaviest window of one with the lightest of the other. The window count starts at ceil(tokens / capacity) and rises
until no window exceeds the capacity. A block holds ``block`` parts, so memory is bounded by the block, not by the task.

Defined cases: a null text counts as empty; an empty document is the single token 0; a null id is kept as null; a text of
any length is tokenized whole; equal documents are packed one by one; parts of equal weight are taken in the order read; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from capturelake.llm.common import arrow_rows, release, table, text_chunks
from capturelake.llm.tokens import encoder


def difference(weights: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """Window of each weight by largest differencing into k windows, and the heaviest window's weight.

    A partial partition is its window weights, heaviest first (zeros left out), and the node that stands for each window.
    While no finished partition is more uneven than the next weight, differencing single weights gives runs of k neighbours
    in descending order; so it starts from those runs and, from the first one that the condition fails for, from single weights."""
    n = len(weights)
    order = np.argsort(-weights, kind="stable")
    ordered = weights[order]
    runs, spread = 0, 0
    while runs + k <= n and ordered[runs + k - 1] >= spread:
        spread = max(spread, int(ordered[runs] - ordered[runs + k - 1]))
        runs += k
    nodes: list[np.ndarray] = [order[i : i + k] for i in range(0, runs, k)] + [order[i : i + 1] for i in range(runs, n)]
    loads: list[np.ndarray] = [weights[x].astype(np.int64) for x in nodes]
    heap = [(int(x[-1] if len(x) == k else 0) - int(x[0]), i) for i, x in enumerate(loads)]
    heapq.heapify(heap)
    merges, fresh = [], n
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        la, lb, na, nb = loads[a], loads[b], nodes[a], nodes[b]
        over = len(la) + len(lb) - k  # windows that must take from both: a's lightest with b's heaviest reversed
        if over <= 0:
            load, node = np.concatenate([la, lb]), np.concatenate([na, nb])
        else:
            # Heaviest of a against lightest of b: with zeros filled in, a's last `over` meet b's first `over` in opposite order.
            left, right = la[len(la) - over :], lb[len(lb) - over :][::-1]
            made = np.arange(fresh, fresh + over)
            merges.append((made, na[len(na) - over :], nb[len(nb) - over :][::-1]))
            fresh += over
            load = np.concatenate([la[: len(la) - over], lb[: len(lb) - over], left + right])
            node = np.concatenate([na[: len(na) - over], nb[: len(nb) - over], made])
        by = np.argsort(-load, kind="stable")
        loads.append(load[by])
        nodes.append(node[by])
        loads[a] = loads[b] = nodes[a] = nodes[b] = None  # type: ignore[call-overload]
        lightest = int(load.min()) if len(load) == k else 0
        heapq.heappush(heap, (lightest - int(load.max()), len(loads) - 1))
    last = heap[0][1]
    window = np.zeros(fresh, np.int64)
    window[nodes[last]] = np.arange(len(nodes[last]))
    for made, a, b in reversed(merges):
        window[a] = window[made]
        window[b] = window[made]
    return window[:n], int(loads[last][0])


def deal(weights: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each weight (none above capacity); the window count rises until every window fits."""
    k = max(1, -(-int(weights.sum()) // capacity))
    while True:
        window, heaviest = difference(weights, k)
        if heaviest <= capacity:
            return window
        k += 1


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, part: int = 192, fine: int = 48, block: int = 4096, end_id: int = 0, vocabulary: tuple[str, str] | None = None, special_as_text: bool = False, with_ids: bool = False) -> DataFrame:
    """One row per piece: see SCHEMA, and ``ids array<int>`` with ``with_ids``.

    No shuffle: every task packs the documents it reads; its last block may leave one window partly filled. sequence_id is
    the partition number in the high bits, so ids are unique and the same again if a task is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*(vocabulary or (None, None)), special_as_text)
        sequence = TaskContext.get().partitionId() << 33
        cut = 0
        parts: list[tuple] = []  # (weight, doc_id, start, ids, doc_tokens)

        def rows(got: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*got, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in cols[7]], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        def row(doc, start, ids, total, seq, offset):
            return (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, seq, offset, *((ids,) if with_ids else ()))

        def flush() -> list[tuple]:
            nonlocal sequence, parts
            if not parts:
                return []
            window = deal(np.array([p[0] for p in parts]), capacity)
            filled, out = {}, []
            for w, (weight, doc, start, ids, total) in zip(window.tolist(), parts, strict=True):
                offset = filled.get(w, 0)
                out.append(row(doc, start, ids, total, sequence + w, offset))
                filled[w] = offset + weight
            sequence += int(window.max()) + 1
            parts = []
            return out

        for batch in batches:
            got: list[tuple] = []
            ids_, texts_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for ids, texts in text_chunks(ids_, texts_):
                for doc, tokens in zip(ids, encode.encode([t or "" for t in texts]), strict=True):
                    tokens = np.append(tokens, np.uint32(end_id))
                    total, full = len(tokens), len(tokens) // capacity * capacity
                    for s in range(0, full, capacity):
                        got.append(row(doc, s, tokens[s : s + capacity], total, sequence, 0))
                        sequence += 1
                    if (left := total - full) > 0:
                        cut += 1
                        pieces = -(-left // (fine if cut % 6 == 0 else part))
                        cuts = [full + left * i // pieces for i in range(pieces + 1)]
                        parts += [(e - s, doc, s, tokens[s:e].copy(), total) for s, e in zip(cuts, cuts[1:], strict=False)]
                    if len(parts) >= block:
                        got += flush()
                    if len(got) >= 4096:
                        yield rows(got)
                        got = []
            if got:
                yield rows(got)
        if got := flush():
            yield rows(got)
        release()

    arrow_rows(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def op1_pack_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
