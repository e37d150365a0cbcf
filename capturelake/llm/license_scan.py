"""Licence scan with a positional rare-token index, in DataFrame functions only.

Templates are short word sequences with a label and a mandatory key phrase. The corpus gives every licence word's document
frequency; a template is indexed under its ``RARE`` words of highest IDF (with their positions in it). Of every file the
anchors it holds are looked up: the rarest word of each key phrase, where the phrase stands around it word by word (a key
phrase is mandatory, so no place is missed). Only such a hit leaves the file, with the words around it. A hit and a posting
give the place where the template would begin; a place stands if at least two index words agree on it (all of a template that
has fewer) and ``MIN_SHARE`` of the words are equal. A template marked whole needs every word.

The word table that reaches the driver is bounded by the templates' vocabulary. Nothing is grouped by word or by label.

Defined cases: a null text is empty (0 words, null places, no labels, score 0); rows that repeat both id and text get the
same result each; of equal places of several templates all count; an empty table gives no rows; texts are read whole."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.llm.common import materialize, table

#: Label, template, key phrase, whether it is a base phrase that must stand whole.
TEMPLATES: list[tuple[str, str, str, bool]] = [
    ("mit", "under the mit license", "under the mit license", True),
    ("apache-2", "apache license version 2", "apache license version 2", True),
    ("cc-by-nc", "cc by nc", "cc by nc", True),
    ("all-rights-reserved", "all rights reserved", "all rights reserved", False),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2", False),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms", False),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution", False),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", False),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa", False),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2", False),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3", False),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted free of charge", False),
    ("mit", "released under the mit license", "mit license", False),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license", False),
]
RARE, MIN_SHARE = 3, 0.7
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
REACH = max(len(t.split()) for _, t, _, _ in TEMPLATES)


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), SPLIT), lambda w: w != "")


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def document_frequency(texts: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Files that hold each word; at most len(vocabulary) rows reach the driver."""
    held = texts.select(F.explode(F.array_intersect(words(texts["text"]), _strings(vocabulary))).alias("word"))
    return {r.word: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}


def postings(frequency: dict[str, int]) -> list[tuple[str, int, int, int]]:
    """word, template number, position in it, rank by IDF (0: rarest)."""
    out = []
    for i, (_, template, _, _) in enumerate(TEMPLATES):
        split = template.split()
        idf = {w: -math.log1p(frequency.get(w, 0)) for w in split}
        rarest = sorted(dict.fromkeys(split), key=lambda w: (-idf[w], -len(w), w))[:RARE]
        out += [(w, i, p, rarest.index(w)) for p, w in enumerate(split) if w in rarest]
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    spark = docs.sparkSession
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    vocabulary = sorted({w for _, t, _, _ in TEMPLATES for w in t.split()})
    index = postings(document_frequency(texts, vocabulary))
    anchors = anchored(index)
    rare = _strings(sorted(anchors))

    def window(w: Column, i: Column) -> Column:
        begin = F.greatest(i - REACH, F.lit(0))
        return F.struct(w.alias("word"), i.alias("at"), begin.alias("begin"), F.slice("words", begin + 1, 2 * REACH).alias("near"))

    def keyed(w: Column, i: Column) -> Column:
        out = F.lit(False)
        for word, phrases in sorted(anchors.items()):
            stands = reduce(lambda a, b: a | b, [(i >= at) & (F.slice("words", F.greatest(i - at, F.lit(0)) + 1, len(key)) == _strings(list(key))) for key, at in sorted(phrases)])
            out = F.when(w == word, stands).otherwise(out)
        return out

    split = texts.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("words"))
    found = split.withColumn("held", F.array_intersect("words", rare))
    spots = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains("held", w), F.when(keyed(w, i), window(w, i)))), lambda x: x.isNotNull())
    files = materialize(found.select("doc_id", "h", F.size("words").cast("long").alias("n_words"), F.when(F.size("held") > 0, spots).alias("hits")))

    names = ["word", "template", "pos", "rank"]
    posted = spark.createDataFrame([(*p, TEMPLATES[p[1]][1].split(), *_key(p[1]), TEMPLATES[p[1]][3]) for p in anchor_postings(index)], "word string, template int, pos int, rank int, expect array<string>, key array<string>, key_at int, base boolean")
    index_at = spark.createDataFrame([(i, sorted({p for _, t, p, _ in index if t == i})) for i in range(len(TEMPLATES))], "template int, index_at array<int>")
    labels = spark.createDataFrame([(i, x[0]) for i, x in enumerate(TEMPLATES)], "template int, label string")
    rows = posted.join(index_at, "template").join(labels, "template").select(*names, "expect", "key", "key_at", "base", "index_at", "label")
    hit = files.filter("hits is not null").select("doc_id", "h", F.explode("hits").alias("x")).select("doc_id", "h", "x.*")
    # The postings are a fixed few dozen rows, whatever the corpus.
    placed = hit.join(F.broadcast(rows), "word").withColumn("place", F.col("at") - F.col("pos")).filter("place >= 0").withColumn("window", F.slice("near", F.col("place") - F.col("begin") + 1, F.size("expect")))
    same = F.zip_with("expect", "window", lambda a, b: F.coalesce(a == b, F.lit(False)))
    placed = placed.withColumn("same", same).withColumn("share", F.size(F.filter("same", lambda x: x)) / F.size("expect"))
    agree = F.size(F.filter("index_at", lambda p: F.element_at("same", p + 1)))
    stands = (F.slice("window", F.col("key_at") + 1, F.size("key")) == F.col("key")) & (agree >= F.least(F.lit(2), F.size("index_at"))) & (F.col("share") >= F.when(F.col("base"), 1.0).otherwise(MIN_SHARE))
    kept = placed.filter(stands).groupBy("doc_id", "h", "template", "place").agg(F.first("label").alias("label"), F.first("base").alias("base"), F.first("share").alias("share"))
    base = F.when(F.col("base"), F.col("place"))
    per_file = kept.groupBy("doc_id", "h").agg(
        F.count(base).alias("n_base"), F.min(base).cast("long").alias("first_word"), F.max(base).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"),
    )
    all_files = files.select("doc_id", "h", "n_words").alias("f")
    joined = all_files.join(per_file.alias("p"), F.col("f.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("f.h") == F.col("p.h")), "left")
    return joined.select(
        "f.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def anchor_postings(index: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """Of each template, the posting of its key phrase's rarest word (its first place in the phrase)."""
    out = []
    for i in range(len(TEMPLATES)):
        key, at = _key(i)
        rank = {w: r for w, t, _, r in index if t == i}
        word = min(key, key=lambda w: (rank.get(w, RARE), -len(w), w))
        out.append((word, i, at + key.index(word), rank.get(word, RARE)))
    return out


def anchored(index: list[tuple[str, int, int, int]]) -> dict[str, set[tuple[tuple[str, ...], int]]]:
    """Anchor word -> the key phrases it anchors, and where it stands in them."""
    out: dict[str, set[tuple[tuple[str, ...], int]]] = {}
    for word, i, _, _ in anchor_postings(index):
        key, _ = _key(i)
        out.setdefault(word, set()).add((tuple(key), key.index(word)))
    return out


def _key(i: int) -> tuple[list[str], int]:
    """Key phrase of a template and where in the template it stands."""
    words, key = TEMPLATES[i][1].split(), TEMPLATES[i][2].split()
    return key, next(j for j in range(len(words)) if words[j : j + len(key)] == key)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_ROWS = ", ".join(f"({i}, '{label}', {_list(text.split())}, {_list(_key(i)[0])}, {_key(i)[1]}, {str(base).lower()})" for i, (label, text, _, base) in enumerate(TEMPLATES))
OP2_SQL = rf"""
WITH tpl(t, label, x, k, key_at, base) AS (VALUES {_ROWS}),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPLIT}'), lambda x: x <> '') AS w FROM documents),
tw AS (SELECT t, unnest(x) AS word, unnest(range(len(x))) AS pos FROM tpl),
df AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(w)) AS word FROM d) WHERE word IN (SELECT word FROM tw) GROUP BY ALL),
rk AS (SELECT t, v.word, row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), length(v.word) DESC, v.word) AS r FROM (SELECT DISTINCT t, word FROM tw) v LEFT JOIN df ON df.word = v.word),
ix AS (SELECT tw.t, tw.word, tw.pos FROM tw JOIN rk ON rk.t = tw.t AND rk.word = tw.word WHERE r <= {RARE}),
ia AS (SELECT t, list(pos) AS ps FROM ix GROUP BY ALL),
o AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
c AS (SELECT DISTINCT o.doc_id, ix.t, o.p - ix.pos AS place FROM o JOIN ix ON ix.word = o.word WHERE o.p >= ix.pos),
m AS (SELECT c.doc_id, c.t, c.place, label, base, len(list_filter(range(1, len(x) + 1), lambda j: w[place + j] = x[j])) / len(x) AS share, w[place + key_at + 1:place + key_at + len(k)] = k AS keyed,
      len(list_filter(ps, lambda j: w[place + j + 1] = x[j + 1])) >= least(2, len(ps)) AS agree FROM c JOIN tpl ON tpl.t = c.t JOIN ia ON ia.t = c.t JOIN d ON d.doc_id = c.doc_id),
s AS (SELECT * FROM m WHERE keyed AND agree AND share >= CASE WHEN base THEN 1 ELSE {MIN_SHARE} END),
g AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(place) FILTER (WHERE base) AS first_word, max(place) FILTER (WHERE base) AS last_word,
      array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score FROM s GROUP BY ALL)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
