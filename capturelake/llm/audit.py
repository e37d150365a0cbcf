"""How filters of a corpus interact: what each removes at each place of every order, and what it removes alone.

Five filters look at whole texts. Four of them need counts of words, distinct words, capitals, code points and symbols, which
one pass of a byte transducer gives (``Transducer``): a table maps every byte to a class, and a second table maps the state
(the class of the byte before) and the class to the next state and its output. Bytes of UTF-8 that continue a code point are a
class of their own, so code points and words come from the same walk. As the state is the class of the last byte alone,
the walk over a buffer of many texts is one table look-up for all bytes at once. Where the table emits the end of a word, its
span goes into an open-addressing hash table; a span that finds its slot taken is compared byte by byte with the one there,
so two words count as one only if they are equal, whatever their hashes.

The fifth filter needs the whole table: a text that a smaller doc_id has. Texts meet as SHA-256 digests with their four
outcomes. Rows are counted by (doc_id, digest) first, which spreads the copies of a text, and then by digest with partial
aggregates, so a text that a third of all rows have brings a few rows to a task and no group is collected.

All that is left is a count by part, outcome of the five filters, and label: at most 32 * 4 rows a part. Every order, step
and Shapley sum is computed from it.

Defined cases: a null text is empty (it fails A and, after another one, E); a null lang is the part ''; a row without doc_id is a
row that is neither smaller nor larger than others (it never fails E, makes none fail, and has no labels); rows that repeat a
doc_id and a text are rows of their own that do not fail E because of each other; a document is good or toxic if any of
its rows in labels says so; an empty table gives no rows; other columns are not looked at."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.llm.common import arrow_rows, materialize, release, table

FILTERS = "ABCDE"
#: Fixed values of the filters: least words, least percentage of distinct words, greatest percentage of capitals, symbols.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 200, 50, 3, b"#$%&*|"
BLANKS = b" \t\n\x0b\x0c\r"
CHUNK = 1 << 22  # bytes that are walked at once; a longer text is walked alone


class Transducer:
    """Byte classes, and what a walk emits when a byte of a class follows one of another."""

    WHITE, WORD, CAPITAL, SYMBOL, CONTINUES = range(5)
    BEGINS, ENDS, POINT, CAP, SIGN = 1, 2, 4, 8, 16  # outputs, as bits

    def __init__(self, white: bytes = BLANKS, symbols: bytes = SYMBOLS):
        self.classes = np.full(256, self.WORD, np.uint8)
        self.classes[0x80:0xC0] = self.CONTINUES
        self.classes[ord("A") : ord("Z") + 1] = self.CAPITAL
        self.classes[list(symbols)] = self.SYMBOL
        self.classes[list(white)] = self.WHITE
        self.output = np.zeros((5, 5), np.uint8)
        for state in range(5):
            for seen in range(5):
                out = 0 if seen == self.CONTINUES else self.POINT
                out |= self.BEGINS if state == self.WHITE != seen else 0
                out |= self.ENDS if state != self.WHITE == seen else 0
                out |= self.CAP if seen == self.CAPITAL else 0
                out |= self.SIGN if seen == self.SYMBOL else 0
                self.output[state, seen] = out

    def walk(self, data: np.ndarray) -> np.ndarray:
        """The output at every byte; the walk starts in white space, and data ends with it."""
        seen = self.classes[data]
        step = np.empty(len(seen), np.uint8)
        step[:1] = seen[:1]
        step[1:] = seen[:-1] * 5 + seen[1:]
        return self.output.reshape(-1)[step]


def _lanes(data: np.ndarray) -> np.ndarray:
    """Eight bytes from every position on, as one number; data needs eight bytes more than are asked for."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))


_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)
_LONG = 64


def _hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A hash of each span and its owner."""
    lanes, h = _lanes(data), owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64)
    left = np.arange(len(start))
    for at in range(0, _LONG, 8):
        value = lanes[start[left] + at] & _MASK[np.minimum(size[left] - at, 8)]
        x = (h[left] ^ value) * np.uint64(0xBF58476D1CE4E5B9)
        h[left] = x ^ (x >> np.uint64(29))
        left = left[size[left] > at + 8]
        if not len(left):
            break
    for i in left:  # longer than _LONG bytes
        h[i] ^= np.uint64(int.from_bytes(hashlib.blake2b(data[start[i] : start[i] + size[i]].tobytes(), digest_size=8).digest(), "little"))
    x = h * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans at a and b, of this size each, have the same bytes."""
    lanes, same = _lanes(data), np.ones(len(a), bool)
    left = np.arange(len(a))
    for at in range(0, _LONG, 8):
        mask = _MASK[np.minimum(size[left] - at, 8)]
        ok = ((lanes[a[left] + at] ^ lanes[b[left] + at]) & mask) == 0
        same[left[~ok]] = False
        left = left[ok & (size[left] > at + 8)]
        if not len(left):
            break
    for i in left:
        same[i] = data[a[i] : a[i] + size[i]].tobytes() == data[b[i] : b[i] + size[i]].tobytes()
    return same


def distinct(data: np.ndarray, start: np.ndarray, size: np.ndarray, owner: np.ndarray, n: int, h: np.ndarray | None = None) -> np.ndarray:
    """How many different spans each of n owners has, by a hash table that compares bytes before it takes two as equal."""
    out = np.zeros(n, np.int64)
    if not len(start):
        return out
    bits = max(4, int(2 * len(start) - 1).bit_length())
    slots = np.full(1 << bits, -1, np.int32)
    slot = ((_hashes(data, start, size, owner) if h is None else h) >> np.uint64(64 - bits)).astype(np.int64)
    left = np.arange(len(start), dtype=np.int32)
    while len(left):
        at = slot[left]
        free = slots[at] < 0
        slots[at[free]] = left[free]  # of several that come at once the last stays
        there = slots[at]
        mine = there == left
        out += np.bincount(owner[left[mine]], minlength=n)
        same = (owner[there] == owner[left]) & (size[there] == size[left]) & ~mine
        ask = np.flatnonzero(same)
        same[ask] = _equal(data, start[left[ask]], start[there[ask]], size[left[ask]])
        left = left[~(mine | same)]
        slot[left] = (slot[left] + 1) & ((1 << bits) - 1)
    return out


_TRANSDUCER = Transducer()


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """words, distinct, capitals, points and symbols of each text (bytes of UTF-8)."""
    n = len(texts)
    data = np.frombuffer(b" ".join([*texts, bytes(8)]) if n else bytes(8), np.uint8)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.cumsum(size) - size
    out = _TRANSDUCER.walk(data[: int(size.sum())]) if n else np.zeros(0, np.uint8)
    total = lambda bit: np.add.reduceat((out & bit) != 0, first, dtype=np.int64) if n else np.zeros(0, np.int64)
    start, end = np.flatnonzero(out & Transducer.BEGINS), np.flatnonzero(out & Transducer.ENDS)
    owner = (np.searchsorted(first, start, "right") - 1).astype(np.int32)
    words = np.bincount(owner, minlength=n)
    return {"words": words, "distinct": distinct(data, start, (end - start).astype(np.int64), owner, n), "capitals": total(Transducer.CAP), "points": total(Transducer.POINT) - 1, "symbols": total(Transducer.SIGN)}


def _outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, part, digest of the text, and the filters A to D that it fails, as bits."""
    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)) if len(texts) else np.zeros(0, np.int64)
        run = np.cumsum(sizes) // CHUNK
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            part = [t or b"" for t in texts.slice(lo, hi - lo).to_pylist()]
            m = measure(part)
            failed = (m["words"] < MIN_WORDS) + 2 * (100 * m["distinct"] < MIN_DISTINCT * m["words"]) + 4 * (100 * m["capitals"] > MAX_CAPITALS * m["points"]) + 8 * (m["symbols"] > 0)
            digest = pa.array([hashlib.sha256(t).digest() for t in part], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), digest, pa.array(failed.astype(np.int32))], ["doc_id", "part", "digest", "failed"])
    release()


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic. Rows without an id stay where they are; an id that many rows have was counted into one row
    before, and copies of it with other texts are spread by adaptive skew joins."""
    says = lambda c, v: F.max(F.coalesce(F.col(c) == v, F.lit(False)))
    by_id = labels.filter("doc_id is not null").groupBy("doc_id").agg(says("quality", 1).alias("good"), says("toxic", 1).alias("toxic"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    named = rows.filter("doc_id is not null").join(by_id, "doc_id", "left").select(*rows.columns, flag("good"), flag("toxic"))
    return named.unionByName(rows.filter("doc_id is null").select("*", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def outcomes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (bits of A to E), good, toxic, n: all that the audit needs."""
    spark = docs.sparkSession
    arrow_rows(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seen = rows.mapInArrow(_outcomes, f"doc_id {id_type}, part string, digest binary, failed int")
    counted = seen.groupBy("doc_id", "digest", "failed", "part").agg(F.count("*").alias("n"))
    kind = ["digest", "failed", "part", "good", "toxic"]
    groups = _labelled(counted, labels).groupBy(*kind).agg(F.min("doc_id").alias("least"), F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"))
    groups = materialize(groups)  # read twice: the least id of a text, and the rows that have it
    least = groups.groupBy("digest").agg(F.min("least").alias("of_all"))
    first = F.when(F.col("least") == F.col("of_all"), F.col("first.n")).otherwise(0)
    split = groups.join(least, "digest").withColumn("stay", F.col("unnamed") + first)
    rows = split.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("failed").alias("failed"), F.col("stay").alias("n")), F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - F.col("stay")).alias("n")))).alias("x"))
    return rows.select("part", "good", "toxic", "x.failed", "x.n").filter("n > 0").groupBy("part", "failed", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(counts: DataFrame) -> DataFrame:
    """A row a part, order and step from what outcomes gives: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(i).alias("before")) for i in range(len(FILTERS))])
    bits = lambda letters: F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), F.lit(0), lambda a, x: a + _power(x))
    plan = counts.withColumn("filter_order", F.explode(orders)).withColumn("at", F.explode(steps)).select("*", F.col("at.step").alias("step"))
    plan = plan.withColumn("own", _power(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn("earlier", bits(F.substring("filter_order", F.lit(1), F.col("at.before"))))
    gone, fails = F.col("failed").bitwiseAND(F.col("earlier")) != 0, F.col("failed").bitwiseAND(F.col("own")) != 0
    count = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint").alias(name)
    rows = plan.groupBy("part", "filter_order", "step", "own").agg(
        count(~gone & ~fails, "kept"), count(~gone & fails, "removed"), count(gone & fails, "redundant"), count(F.col("failed") == F.col("own"), "unique_fails"), count(~gone & fails & F.col("good"), "good_lost"), count(~gone & fails & F.col("toxic"), "toxic_lost"),
    )
    share = rows.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return rows.join(share, ["part", "own"]).select("part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _power(letter: Column) -> Column:
    """The bit of a filter."""
    return F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(FILTERS) for x in (f, 1 << i)]), letter)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(materialize(outcomes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
m AS (SELECT text, min(doc_id) AS least FROM d GROUP BY 1),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 3 * len(w.text),
         regexp_matches(w.text, '[#$%&*|]'), coalesce(w.doc_id > least, false)] AS fails
      FROM w JOIN m ON w.text = m.text LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
s AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, x.i, y.i, z.i] AS o FROM s a, s b, s x, s y, s z WHERE len(list_distinct([a.i, b.i, x.i, y.i, z.i])) = 5),
p AS (SELECT o, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
g AS (SELECT part, filter_order, step, o[step] AS own, n, good, toxic, fails[o[step]] AS hit, list_bool_or(list_transform(o[1:step - 1], lambda i: fails[i])) AS gone,
        len(list_filter(fails, lambda x: x)) AS many FROM c, p),
r AS (SELECT part, filter_order, step, own,
        sum(CASE WHEN NOT coalesce(gone, false) AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT coalesce(gone, false) AND hit THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant, sum(CASE WHEN hit AND many = 1 THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN NOT coalesce(gone, false) AND hit AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT coalesce(gone, false) AND hit AND toxic THEN n ELSE 0 END) AS toxic_lost
      FROM g GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
