"""Near-duplicate classes by BagMinHash signatures, banding and exact multiset overlap.

1. Texts with the same multiset of five-word shingles collapse to one representative (128-bit fingerprint).
2. BagMinHash: a shingle of weight w is a Poisson process of rate 1 over each unit of weight. The weight axis is cut at
   powers of two; the process of a level (2^(i-1), 2^i] is drawn once from the shingle's hash, each of its points gets a
   place in the level by a further hash, and points beyond w are thinned out, so equal shingles of different weights share
   the points below the smaller weight. Points are drawn only up to a time that fills the signature (redrawn further where
   it doesn't), each goes to one hashed slot, and a slot keeps its earliest time: two texts agree in a slot with
   probability equal to their weighted Jaccard similarity.
3. ``bands`` bands of ``rows`` slots. First, a bucket's texts are compared with two of them: the shortest (where texts
   share a passage, it is the shortest that the others reach) and the most central (the one with the most company in all
   its buckets; for edited copies, the original). This is linear in the bucket and joins nearly all that belong together.
4. Texts of buckets that are then still in several components meet all others of other components that can be similar.
   Occurrences of shingles are ordered from rare to common; of two similar texts, the smaller has a shared one among its
   first 1/9 and the larger one among its first 1/5 (for a similarity of 0.8), and enough must be left from there on in
   both. These are exact bounds, so no pair of a bucket is lost, and texts that share only a passage too short for the
   similarity never meet.
5. A link is an exact weighted Jaccard similarity of at least ``similarity``; classes are connected components, named by
   their smallest id. What is compared is the texts' hashed occurrences, made once for texts that have company.

Keys that many rows have (copies, buckets, leads, classes) are spread: see join_groups and ``_spread``.

Defined cases: null texts and texts without words are in a class of their own; rows that repeat an id are one document
(their texts are versions of it and in one class); a row with a null id cannot be named in a class and is a class of one
whose id is null; an empty table gives no rows; very long texts are read whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capturelake.llm.common import Scratch, arrow_rows, join_groups, materialize, release, table, text_chunks
from capturelake.llm.components import components
from capturelake.llm.shingles import WORDS, shingle, words
from capturelake.llm.tokens import mix

SIMILARITY, BANDS, ROWS = 0.8, 32, 4
_GOLD = np.uint64(0x9E3779B97F4A7C15)
LEAD = 4096  # pairs of one lead in a task


def bags(texts: list[str], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each text, sorted within it, and where each text's begin."""
    s, start = shingle(*words(texts), n)
    for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
        s[a:b].sort()
    return s, start


def bag_min_hash(s: np.ndarray, start: np.ndarray, slots: int) -> np.ndarray:
    """Signature rows (float64 arrival times; infinity for empty bags) of bags as given by bags()."""
    docs = len(start) - 1
    sig = np.full((docs, slots), np.inf)
    if not len(s):
        return sig
    doc = np.repeat(np.arange(docs), np.diff(start))
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    weight, key, owner = np.diff(np.append(first, len(s))), s[first], doc[first]
    total = np.bincount(owner, weight, docs)
    levels = np.ceil(np.log2(weight)).astype(np.int64) + 1  # (0, 1], (1, 2], (2, 4], ...
    level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
    key, owner, weight = (np.repeat(x, levels) for x in (key, owner, weight))
    rate = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0)).astype(np.float64)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    seed = mix(key ^ (level.astype(np.uint64) * _GOLD))
    limit = slots * (np.log(slots) + 3) / np.maximum(total, 1)
    flat, todo = sig.reshape(-1), total > 0
    while todo.any():
        at = np.flatnonzero(todo[owner])
        time, h = np.zeros(len(at)), seed[at]
        while len(at):
            h = mix(h + _GOLD)
            time = time - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53) / rate[at]
            go = time <= limit[owner[at]]
            at, time, h = at[go], time[go], h[go]
            point = mix(h ^ np.uint64(0xD1B54A32D192ED03))
            place = low[at] + ((point >> np.uint64(32)).astype(np.float64) / 2**32 * rate[at]).astype(np.int64)
            ok = place < weight[at]
            slot = ((point & np.uint64(0xFFFFFFFF)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(flat, owner[at[ok]] * slots + slot[ok], time[ok])
        todo &= np.isinf(sig).any(1)
        limit = np.where(todo, limit * 2, limit)
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    h = np.full((len(sig), bands), 0, np.uint64) + np.arange(bands, dtype=np.uint64) * _GOLD
    for i in range(rows):
        h = mix(h ^ bits[:, :, i])
    return h.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, n: int = WORDS) -> DataFrame:
    """id, f1, f2 (fingerprint; null without words), size (shingles), keys (one for each band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in text_chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s, start = bags([t or "" for t in texts], n)
                keys = band_keys(bag_min_hash(s, start, bands * rows), bands, rows)
                size = np.diff(start)
                empty = size == 0
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s ^ np.uint64(c)), dtype=np.uint64)]) for c in (1, 2)]
                f1, f2 = ((x[start[1:]] - x[start[:-1]] + size.astype(np.uint64)).view(np.int64) for x in sums)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.reshape(-1), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(f1, pa.int64(), mask=empty), pa.array(f2, pa.int64(), mask=empty), pa.array(size, pa.int64()), keys], ["id", "f1", "f2", "size", "keys"])
        release()

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "id long, f1 long, f2 long, size long, keys array<long>")


def occurrences(s: np.ndarray) -> np.ndarray:
    """A sorted bag as a sorted set: the second, third, ... occurrence of a shingle are elements of their own."""
    at = np.arange(len(s))
    first = np.concatenate([[True], s[1:] != s[:-1]])[: len(s)]
    turn = at - np.maximum.accumulate(np.where(first, at, 0))
    return np.sort(np.where(turn > 0, mix(s ^ mix(turn.astype(np.uint64) + _GOLD)), s))


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets of occurrences overlap enough."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    if len(b) > len(a):
        a, b = b, a
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return common >= similarity * (len(a) + len(b) - common)


def hashed(texts: DataFrame, n: int = WORDS) -> DataFrame:
    """id, bag (occurrences as 8-byte numbers) of texts (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, own in text_chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s, start = bags([t or "" for t in own], n)
                made = [occurrences(s[a:b]).tobytes() for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, pa.binary())], ["id", "bag"])
        release()

    return texts.select("id", "text").mapInArrow(run, "id long, bag binary")


def _spread(pairs: DataFrame, lead: str) -> DataFrame:
    """How many parts the pairs of a lead are dealt into: lead, n, parts."""
    return pairs.groupBy(lead).agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / LEAD).cast("int"))


def verified(pairs: DataFrame, held: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """a, b of the pairs whose bags overlap by at least similarity. a may lead very many pairs: its bag goes to each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, None)
        for batch in batches:
            first, second = batch.column(2), batch.column(3)
            keep, a = [], batch.column(0).to_pylist()
            for i in range(len(a)):
                if known[0] != a[i]:
                    known = (a[i], np.frombuffer(first[i].as_buffer(), np.uint64).copy())
                keep.append(similar(known[1], np.frombuffer(second[i].as_buffer(), np.uint64), similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    parts = scratch.table(_spread(pairs, "a"))
    dealt = join_groups(pairs, parts, ["a"], "n", pairs.count(), "inner").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    with_b = dealt.join(held.select(F.col("id").alias("b"), F.col("bag").alias("bag_b")), "b")
    leads = held.join(parts, held["id"] == parts["a"]).select("a", F.col("bag").alias("bag_a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return with_b.join(leads, ["a", "part"]).select("a", "b", "bag_a", "bag_b").mapInArrow(run, "a long, b long")


def tokens(held: DataFrame) -> DataFrame:
    """id, comp, size, token: a row for each occurrence in held (id, comp, bag)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                own = np.frombuffer(batch.column(2)[i].as_buffer(), np.int64)
                which = pa.array(np.full(len(own), i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(np.full(len(own), len(own))), pa.array(own)], ["id", "comp", "size", "token"])
        release()

    return held.select("id", "comp", "bag").mapInArrow(run, "id long, comp long, size long, token long")


def possible_pairs(held: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Distinct pairs of texts in held (id, comp, bag) of different components: all that can be similar, by exact bounds.

    a is the smaller text. Occurrences that no other component has cannot be shared; they count as the rarest."""
    every = scratch.table(tokens(held))
    shared = every.groupBy("token").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token", "n")
    # ``rest``: shared occurrences from this one on, itself included, from rare to common.
    order = Window.partitionBy("id").orderBy(F.desc("n"), F.desc("token"))
    ranked = every.join(shared, "token").withColumn("rest", F.row_number().over(order)).filter(F.col("rest") >= F.col("size") * similarity - 1e-6)
    ranked = scratch.table(ranked.select("id", "comp", "size", "token", "rest"))
    a, b = (ranked.select("token", *(F.col(c).alias(f"{c}_{side}") for c in ("id", "comp", "size", "rest"))) for side in "ab")
    half = similarity / (1 + similarity)
    a = a.filter(F.col("rest_a") >= 2 * half * F.col("size_a") - 1e-6)
    ordered = F.struct("size_a", "id_a") < F.struct("size_b", "id_b")
    size = F.col("size_a") >= F.lit(similarity) * F.col("size_b")
    rest = F.least("rest_a", "rest_b") >= F.lit(half) * (F.col("size_a") + F.col("size_b")) - 1e-6
    return a.join(b, (a["token"] == b["token"]) & ordered & (F.col("comp_a") != F.col("comp_b")) & size & rest).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def _buckets(reps: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """key, id, size, n for each text and each of its buckets that holds n > 1 texts, and the number of these rows."""
    bucket = scratch.table(reps.select("id", "size", F.explode("keys").alias("key")))
    company = scratch.table(bucket.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    full = scratch.table(join_groups(bucket, company, ["key"], "n", bucket.count(), "inner"))
    return full, full.count()


def _stars(full: DataFrame, rows: int, similarity: float, scratch: Scratch) -> DataFrame:
    """Distinct pairs (lead, member) of each bucket's shortest and most central text with all others, as sizes allow."""
    central = full.groupBy("id").agg(F.sum("n").alias("central"))
    lead = full.join(central, "id").groupBy("key").agg(F.min(F.struct("size", "id")).alias("short"), F.max(F.struct("central", (-F.col("id")).alias("order"), "id", "size")).alias("mid"), F.first("n").alias("of"))
    lead = scratch.table(lead.select("key", "of", F.array(F.struct("short.id", "short.size"), F.struct("mid.id", "mid.size")).alias("leads")))
    stars = join_groups(full, lead, ["key"], "of", rows, "inner").select("id", "size", F.explode("leads").alias("lead"))
    near = F.least("size", "lead.size") >= F.lit(similarity) * F.greatest("size", "lead.size")
    pairs = stars.filter((F.col("id") != F.col("lead.id")) & near).select(F.col("lead.id").alias("a"), F.col("id").alias("b"))
    return pairs.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min("a").alias("a")).select("a", F.when(F.col("a") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b"))


def _mixed(full: DataFrame, rows: int, joined: DataFrame, scratch: Scratch) -> DataFrame:
    """id, comp of the texts in buckets that still hold several components. (A bucket of two was compared by its star.)"""
    comp = scratch.table(full.filter("n > 2").join(joined, full["id"] == joined["node"], "left").select("key", "id", F.coalesce("component", "id").alias("comp")))
    mixed = scratch.table(comp.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key", "n"))
    return join_groups(comp, mixed, ["key"], "n", rows, "inner").select("id", "comp").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, n: int = WORDS) -> DataFrame:
    """doc_id, class_id (smallest id of the class), class_size for every document."""
    arrow_rows(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
        known = texts.filter("id is not null")
        sig = scratch.table(signatures(known, "id", "text", bands, rows, n))
        total = sig.count()
        # Copies: one representative, the smallest id, for each fingerprint that repeats.
        copies = scratch.table(sig.filter("f1 is not null").groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1"))
        dealt = join_groups(sig, copies, ["f1", "f2"], "copies", total).select("id", "f1", "size", "keys", F.coalesce("rep", "id").alias("rep"), "copies")
        member = scratch.table(dealt.select("id", "rep", "copies").distinct())
        full, in_buckets = _buckets(dealt.filter("f1 is not null and id = rep"), scratch)
        held = known.join(full.select("id").distinct(), "id", "left_semi")
        repeats = not sig.groupBy("id").count().filter("count > 1").isEmpty()
        held = scratch.table(hashed(held, n).distinct() if repeats else hashed(held, n))

        tested = scratch.table(_stars(full, in_buckets, similarity, scratch))
        links = scratch.table(verified(tested, held, similarity, scratch))
        versions = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z")
        links = links.union(member.join(versions, "id").filter("rep > a").select("a", F.col("rep").alias("b")))
        joined = components(links, scratch)
        # Pairs left over by the stars: texts of buckets that are not yet in one component.
        left = scratch.table(_mixed(full, in_buckets, joined, scratch))
        if not left.isEmpty():
            met = tested.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
            pairs = possible_pairs(held.join(left, "id"), similarity, scratch)
            pairs = scratch.table(pairs.join(met, (F.least("a", "b") == met["x"]) & (F.greatest("a", "b") == met["y"]), "left_anti"))
            more = scratch.table(verified(pairs, held, similarity, scratch))
            if not more.isEmpty():
                joined = components(links.union(more), scratch)

        # A text without company is its own class. The smallest representative of a component is its smallest id.
        out = scratch.table(member.join(joined, member["rep"] == joined["node"], "left").select("id", "rep", "copies", "component"))
        alone = out.filter("copies is null and component is null").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
        rest = scratch.table(out.filter("copies is not null or component is not null").select(F.col("id").alias("doc_id"), F.coalesce("component", "rep").alias("class_id")).distinct())
        size = scratch.table(rest.groupBy("class_id").agg(F.count("*").alias("class_size")))
        rest = join_groups(rest, size, ["class_id"], "class_size", total, "inner")
        null = F.lit(None).cast("long")
        nameless = texts.filter("id is null").select(null.alias("doc_id"), null.alias("class_id"), F.lit(1).cast("long").alias("class_size"))
        return materialize(alone.unionByName(rest.select("doc_id", "class_id", "class_size")).unionByName(nameless))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of docs, all columns, for each class: that of its smallest id. Of rows that repeat this id, the one with the
    smallest text stays; rows with a null id all stay."""
    drop = near_duplicates(docs, id_col, text_col, **options).filter("doc_id <> class_id").select(F.col("doc_id").alias("__drop"))
    kept = docs.join(drop, docs[id_col] == drop["__drop"], "left_anti")
    repeated = materialize(docs.groupBy(docs[id_col].alias("__id")).agg(F.count("*").alias("__n")).filter("__n > 1 and __id is not null").select("__id"))
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, kept[id_col] == repeated["__id"], "left_anti")
    every = F.struct(*(kept[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)))
    first = kept.join(repeated, kept[id_col] == repeated["__id"]).groupBy("__id").agg(F.min_by(every, F.struct(kept[text_col])).alias("row"))
    return once.union(first.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns))))


def op10_minhash_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
