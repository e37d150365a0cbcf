"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

A window of a document has as many words as a benchmark item. Only windows with so many places that hold a five-word shingle of
some item of that size, and of these only pairs with so many of the item's own, as the similarity needs are looked at. That
loses nothing: what a window and an item have in common is at most the places of the item's shingles in it. Their 64-bit
SimHash is the sign of running sums over shingles. Fingerprints within ``radius`` bits of an item's are found by blocks: of
eight blocks of eight bits, one at least differs by no more than radius // 8 bits, so looking up every block's neighbours
finds them all. Candidates are verified by exact weighted Jaccard similarity of shingles, at least ``similarity``.

The benchmark is a query set: it is read in blocks of at most ``block`` items and BLOCK_CHARS characters, each of which is
searched for in all documents, so the index that tasks hold is bounded whatever the benchmark's size. Documents are never
shuffled.

A document with fewer words than an item is one window, compared whole with the items it shares a shingle with.

Defined cases: null or wordless texts and items match nothing; an item of fewer than five words matches only a document
of exactly these words or, with ``short_inside``, these words anywhere in a document; of several windows, the most similar and then the first one is reported; repeated rows are
reported for each row, repeated items under each of their ids; empty tables give no rows; texts are read whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.llm.common import arrow_rows, release, table, text_chunks
from capturelake.llm.shingles import WORDS, overlap, shingle, words

SIMILARITY, RADIUS, BLOCK, BLOCK_CHARS = 0.8, 23, 16384, 1 << 23
TABLE = 1 << 20
_BIT = np.arange(64, dtype=np.uint64)
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _signs(s: np.ndarray) -> np.ndarray:
    return ((s[:, None] >> _BIT) & np.uint64(1)).astype(np.int32) * 2 - 1


def simhash(sums: np.ndarray) -> np.ndarray:
    """Eight bytes for each row of 64 sums."""
    return np.ascontiguousarray(np.packbits(sums > 0, axis=1))


class Index:
    """Items by their number of shingles, and the shingles of all of them."""

    def __init__(self, ids: list[int], texts: list[str], radius: int = RADIUS, n: int = WORDS, short_inside: bool = False):
        hashes, begin = words(texts)
        s, start = shingle(hashes, begin, n)
        self.ids = np.array(ids, np.int64)
        self.bags = [np.sort(s[a:b]) for a, b in zip(start[:-1], start[1:], strict=True)]
        size = np.diff(start)
        self.n, self.radius, self.sizes = n, radius, size
        self.shingles = np.unique(s)
        self.seen = np.zeros(TABLE, bool)
        self.seen[(s & np.uint64(TABLE - 1)).astype(np.int64)] = True
        order = np.argsort(s, kind="stable")
        self.sorted, self.sorted_size, self.sorted_item = s[order], np.repeat(size, size)[order], np.repeat(np.arange(len(size)), size)[order]
        near = _ONES[np.arange(256)[:, None] ^ np.arange(256)] <= radius // 8
        self.by_size = {}
        for k in np.unique(size[size > 0]).tolist():
            which = np.flatnonzero(size == k)
            prints = simhash(np.array([_signs(self.bags[i]).sum(0) for i in which]))
            self.by_size[k] = (which, prints, [near[:, prints[:, b]] for b in range(8)])

        self.short: dict[int, dict[int, list[int]]] = {}  # number of words -> their hash -> items
        for i in np.flatnonzero((np.diff(begin) > 0) & (np.diff(begin) < n)).tolist() if short_inside else []:
            own = hashes[begin[i] : begin[i + 1]]
            key = int(shingle(own, np.array([0, len(own)]), len(own))[0][0])
            self.short.setdefault(len(own), {}).setdefault(key, []).append(i)

    def hits(self, s: np.ndarray) -> np.ndarray:
        """Positions of shingles that some item has."""
        at = np.flatnonzero(self.seen[(s & np.uint64(TABLE - 1)).astype(np.int64)])
        if len(at):
            found = np.minimum(np.searchsorted(self.shingles, s[at]), len(self.shingles) - 1)
            at = at[self.shingles[found] == s[at]]
        return at

    def search(self, s: np.ndarray, at: np.ndarray, similarity: float) -> list[tuple[int, int, float]]:
        """(item number, first word, similarity) of a document with shingles s and hits at.

        Hits of an item inside a window bound what the two have in common, so they are counted first, for all windows and items
        at once: a prompt that many items share costs a sum, not a comparison with each of them."""
        lo, hi = np.searchsorted(self.sorted, s[at], "left"), np.searchsorted(self.sorted, s[at], "right")
        reach = hi - lo
        entry = np.repeat(lo - (np.cumsum(reach) - reach), reach) + np.arange(int(reach.sum()))
        place, item, of_size = np.repeat(at, reach), self.sorted_item[entry], self.sorted_size[entry]
        fresh = np.ones(len(item), bool)  # an item that has a shingle twice is hit once at a place
        fresh[1:] = (place[1:] != place[:-1]) | (item[1:] != item[:-1])
        place, item, of_size = place[fresh], item[fresh], of_size[fresh]
        best: dict[int, tuple[float, int]] = {}
        if (of_size > len(s)).any():
            count = np.bincount(item, minlength=len(self.bags))
            total = len(s) + self.sizes
            for i in np.flatnonzero((self.sizes > len(s)) & (count > 0) & (count * (1 + similarity) >= similarity * total - 1e-9)).tolist():
                if (got := overlap(np.sort(s), self.bags[i])) >= similarity:
                    best[i] = (got, 0)
        for k in np.unique(of_size[of_size <= len(s)]).tolist():
            which, prints, tables = self.by_size[k]
            own = of_size == k
            here, column = place[own], np.searchsorted(which, item[own])
            least = np.ceil(2 * k * similarity / (1 + similarity) - 1e-9)
            if len(here) < least:
                continue
            last = len(s) - k
            step = max(1, min(4096, (1 << 22) // len(which)))  # windows at once, so that windows times items stay bounded
            cover = np.zeros(len(s) + 1, np.int32)
            hit = np.unique(here)  # a place counts once for an item at most
            np.add.at(cover, np.maximum(hit - k + 1, 0), 1)
            np.add.at(cover, hit + 1, -1)
            begins = np.flatnonzero(np.cumsum(cover)[: last + 1] >= least)
            for run in np.split(begins, np.flatnonzero(np.diff(begins) > 1) + 1):
                for part in (run[i : i + step] for i in range(0, len(run), step)):
                    if len(part):
                        self._windows(s, part, k, which, prints, tables, here, column, int(least), similarity, best)
        return [(item, begin, got) for item, (got, begin) in sorted(best.items())]

    def _windows(self, s, part, k, which, prints, tables, here, column, least, similarity, best) -> None:
        """Compare the windows that begin at part (places one after the other) with the items of k shingles."""
        base, n, m = int(part[0]), len(part), len(which)
        near = (here >= base) & (here < base + n + k - 1)
        first, after = np.maximum(here[near] - k + 1 - base, 0), np.minimum(here[near] + 1 - base, n)
        change = np.bincount(first * m + column[near], minlength=(n + 1) * m) - np.bincount(after * m + column[near], minlength=(n + 1) * m)
        enough = np.cumsum(change.reshape(n + 1, m)[:n], axis=0) >= least
        w, i = np.nonzero(enough)
        if not len(w):
            return
        sums = np.zeros((n + k, 64), np.int32)
        np.cumsum(_signs(s[base : base + n + k - 1]), axis=0, out=sums[1:])
        code = simhash(sums[k : k + n] - sums[:n])
        maybe = np.zeros(len(w), bool)
        for b in range(8):
            maybe |= tables[b][code[w, b], i]
        w, i = w[maybe], i[maybe]
        far = np.bitwise_count(code.view(np.uint64)[w, 0] ^ prints.view(np.uint64)[i, 0])
        close = np.flatnonzero(far <= self.radius)
        for w, i in zip(w[close].tolist(), i[close].tolist(), strict=True):
            begin, item = base + w, int(which[i])
            got = overlap(np.sort(s[begin : begin + k]), self.bags[item])
            if got >= similarity and (item not in best or got > best[item][0]):
                best[item] = (got, begin)

    def matches(self, texts: list[str], similarity: float) -> Iterator[tuple[int, int, int, float]]:
        """(text number, item number, first word, similarity)."""
        hashes, word = words(texts)
        s, start = shingle(hashes, word, self.n)
        at = self.hits(s)
        inside: dict[int, dict[int, int]] = {}  # text number -> short item -> first word
        for m, items in self.short.items():
            g, first = shingle(hashes, word, m)
            found = np.flatnonzero(np.isin(g, np.fromiter(items, np.uint64, len(items))))
            for d, i in zip((np.searchsorted(first, found, side="right") - 1).tolist(), found.tolist(), strict=True):
                for item in items[int(g[i])]:
                    inside.setdefault(d, {}).setdefault(item, i - int(first[d]))
        owner = np.searchsorted(start, at, side="right") - 1
        for d in sorted({*owner.tolist(), *inside}):
            own, near = s[start[d] : start[d + 1]], at[owner == d] - start[d]
            whole = self.search(own, near, similarity) if len(near) else []
            for item, begin, got in whole:
                yield d, item, begin, got
            for item, begin in sorted(inside.get(d, {}).items()):
                if item not in {x[0] for x in whole}:
                    yield d, item, begin, 1.0


def indexes(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", block: int = BLOCK, radius: int = RADIUS, short_inside: bool = False) -> Iterator[Index]:
    """An index for each block of at most ``block`` items and BLOCK_CHARS characters (or one longer item); items come to the
    driver a part at a time, and only one block is there at once."""
    items = benchmark.filter(benchmark[item_text].isNotNull() & benchmark[item_id].isNotNull()).select(benchmark[item_id].cast("long").alias("item"), benchmark[item_text].cast("string").alias("text"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    parts = max(1, -(-size.n // block), -(-size.chars // BLOCK_CHARS))
    held: list[tuple[int, str]] = []
    chars = 0
    for r in items.repartition(parts, F.xxhash64("item", "text")).toLocalIterator():
        if held and (len(held) == block or chars + len(r.text) > BLOCK_CHARS):
            yield _index(held, radius, short_inside)
            held, chars = [], 0
        held.append((r.item, r.text))
        chars += len(r.text)
    if held:
        yield _index(held, radius, short_inside)


def _index(items: list[tuple[int, str]], radius: int, short_inside: bool) -> Index:
    items = sorted(items)
    return Index([i for i, _ in items], [t for _, t in items], radius, short_inside=short_inside)


MATCHES = "doc_id long, item_id long, first_word long, similarity double"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, block: int = BLOCK, short_inside: bool = False) -> DataFrame:
    """A row for each document and benchmark item that it holds: see MATCHES."""
    spark = docs.sparkSession
    arrow_rows(spark)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    out = spark.createDataFrame([], MATCHES)
    for index in indexes(benchmark, item_id, item_text, block, radius, short_inside):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for ids, texts in text_chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    got = [(ids[d], int(index.ids[i]), w, x) for d, i, w, x in index.matches([t or "" for t in texts], similarity)]
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "item_id", "first_word", "similarity"])
            release()

        out = out.union(rows.mapInArrow(run, MATCHES))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, block: int = BLOCK, short_inside: bool = False) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item."""
    arrow_rows(docs.sparkSession)
    at = docs.columns.index(text_col)
    for index in indexes(benchmark, item_id, item_text, block, radius, short_inside):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for ids, texts in text_chunks(list(range(len(batch))), batch.column(at).to_pylist()):
                    for d, *_ in index.matches([t or "" for t in texts], similarity):
                        keep[ids[d]] = False
                yield batch.filter(pa.array(keep))
            release()

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_decontaminate_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_inside=True)
