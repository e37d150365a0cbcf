"""Line deduplication by site-relative frequency.

For every host, the pages that contain a line are divided by the host's pages; lines above ``max_ratio`` are boilerplate of
that host and are dropped from its pages. A line must be on ``min_pages`` pages (two: a line that only one page has is
repeated nowhere, so it is no duplicate, however few pages the host has). Lines are compared without white space at their ends; a page counts once for a line it repeats.
Lines travel as 96 bits of hashes, never as text.

A page can hold only so many lines, so a host has at most (lines of a page / max_ratio) boilerplate lines. They are
written out first and are dealt into ``SLOTS`` slots by hash, so that a line is compared with a few keys only. Where all
hosts have at most ``BROADCAST_KEYS`` of them, they are broadcast; otherwise pages of hosts with over a thousandth of all
pages stay where they are and the others are joined by host.

Defined cases: blank lines stay; a null text stays null; a null host is the host ''; a page of which every line is
boilerplate becomes empty, unless ``keep_copies`` leaves it whole (as a copy, for near-duplicate removal to deal with);
repeated rows count as pages of their own; ties (a ratio equal to max_ratio) stay; an empty table gives no rows; other
columns pass through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.llm.common import join_groups, materialize, table

MAX_RATIO, MIN_PAGES, SLOTS, BROADCAST_KEYS = 0.1, 2, 64, 100_000
BLANK = " \t\r\f\x0b"


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(BLANK))


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def _slot(key: Column) -> Column:
    return F.pmod(key["a"], F.lit(SLOTS)).cast("int")


def _host(docs: DataFrame, host_col: str) -> Column:
    return F.coalesce(docs[host_col].cast("string"), F.lit(""))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Host, its pages, and the keys of its boilerplate lines, by slot."""
    rows = docs.select(_host(docs, host_col).alias("host"), docs[text_col].cast("string").alias("text"))
    keys = F.array_distinct(F.transform(F.filter(F.transform(F.split("text", "\n"), _bare), lambda x: x != ""), _key))
    lines = rows.select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    pages = rows.groupBy("host").agg(F.count("*").alias("pages"))
    found = lines.join(pages, "host").filter(F.col("n") > F.col("pages") * max_ratio).groupBy("host").agg(F.first("pages").alias("pages"), F.collect_list("key").alias("keys"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.filter("keys", lambda k: _slot(k) == i))
    return found.select("host", "pages", F.size("keys").alias("n_keys"), slots.alias("slots"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, keep_copies: bool = False, count_as: str | None = None, broadcast_keys: int = BROADCAST_KEYS, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with the boilerplate lines taken out of text_col; with count_as, also the number of lines dropped."""
    found = materialize(boilerplate(docs, host_col, text_col, max_ratio, min_pages))
    size = found.agg(F.coalesce(F.sum("n_keys"), F.lit(0)), F.count("*")).first()
    found = found.select(F.col("host").alias("__host"), F.col("pages").alias("__pages"), F.col("slots").alias("__slots"))
    rows = docs.withColumn("__host", _host(docs, host_col))
    if size[0] + size[1] * SLOTS <= broadcast_keys:
        joined = rows.join(F.broadcast(found), "__host", "left")
    else:
        joined = join_groups(rows, found, ["__host"], "__pages", docs.count())
    lines = F.split(F.col(text_col).cast("string"), "\n")
    drop = lambda key: F.array_contains(F.element_at("__slots", _slot(key) + 1), key)
    kept = F.filter(lines, lambda x: (_bare(x) == "") | ~drop(_key(_bare(x))))
    joined = joined.withColumn("__kept", F.when(F.col("__slots").isNotNull(), kept))
    changed = F.col("__kept").isNotNull() & (F.size("__kept") < F.size(lines))
    if keep_copies:
        changed = changed & F.exists("__kept", lambda x: _bare(x) != "")
    out = joined.withColumn("__n", F.when(changed, F.size(lines) - F.size("__kept")).otherwise(0).cast("long")).withColumn(text_col, F.when(changed, F.array_join("__kept", "\n")).otherwise(F.col(text_col)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), *([F.col("__n").alias(count_as)] if count_as else []))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), count_as="n_dropped").select("doc_id", "n_dropped", "text")


_BARE = "trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11))"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT host, line, count(*) AS n FROM (
        SELECT host, unnest(list_distinct(list_filter(list_transform(lines, lambda x: {_BARE}), lambda x: x <> ''))) AS line FROM d)
      GROUP BY 1, 2),
p AS (SELECT host, count(*) AS pages FROM d GROUP BY 1),
b AS (SELECT l.host, list(line) AS drops FROM l JOIN p ON l.host = p.host WHERE n >= {MIN_PAGES} AND n > pages * CAST({MAX_RATIO} AS DOUBLE) GROUP BY 1),
k AS (SELECT d.*, CASE WHEN drops IS NOT NULL THEN list_filter(lines, lambda x: {_BARE} = '' OR NOT list_contains(drops, {_BARE})) END AS kept
      FROM d LEFT JOIN b ON d.host = b.host),
c AS (SELECT *, coalesce(len(kept) < len(lines), false) AS changed FROM k)
SELECT doc_id, CASE WHEN changed THEN CAST(len(lines) - len(kept) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS n_dropped,
       CASE WHEN changed THEN array_to_string(kept, chr(10)) ELSE text END AS text FROM c
"""
