import re

from pyspark.sql import functions as F

from capturelake.llm.license_scan import MIN_SHARE, TEMPLATES, postings, scan

SCHEMA = "doc_id long, text string"
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    """Every template at every place of the text."""
    w = words_of(text)
    places, base_labels, labels, score = [], set(), set(), 0.0
    df = {}  # with equal frequencies the longest words are indexed, as in the fixture below
    index = postings(df)
    for t, (label, template, key, whole) in enumerate(TEMPLATES):
        x, k = template.split(), key.split()
        at = next(j for j in range(len(x)) if x[j : j + len(k)] == k)
        rare = {p for _, i, p, _ in index if i == t}
        for s in range(len(w)):
            got = [s + j < len(w) and w[s + j] == x[j] for j in range(len(x))]
            if w[s + at : s + at + len(k)] == k and sum(got) / len(x) >= (1 if whole else MIN_SHARE) and sum(got[p] for p in rare) >= min(2, len(rare)):
                labels.add(label)
                score = max(score, sum(got) / len(x))
                if whole:
                    places.append(s)
                    base_labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), round(score, 9)


TEXTS = [
    None, "", "...", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "CC-BY-NC cc by nc, CC BY NC 4.0", "under the mit license under the mit license", "mit license", "the mit of license under",
    "This work is licensed under the GNU General Public License, version 3.", "All rights reserved", "apache license version 3", "été MIT\tLicense under the\nMIT\x7fLicense ñ", "Permission is hereby granted, free of charge, to every person obtaining a copy", "version 2",
]


def test_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, "filler words " * 5000 + "under the MIT license"), (51, TEXTS[3]), (51, TEXTS[3]), (52, "license " * 3000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("h", F.lit(1)).withColumn("words", F.lit("clash")).repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in scan(docs).collect()), key=lambda x: x[0])
    want = sorted(((i, *brute(t)) for i, t in rows), key=lambda x: x[0])
    assert [x[:6] for x in got] == [x[:6] for x in want]
    assert all(set(x[5].split(",")) - {""} <= set(x[6].split(",")) and 0 <= x[7] <= 1 for x in got)
    by_id = {x[0]: x for x in got}
    assert by_id[9][6] == "gpl-3" and by_id[10][6] == "all-rights-reserved" and by_id[13][6] == "mit" and by_id[11][6] == ""


def test_base_phrases(spark):
    docs = spark.createDataFrame([(i, f"x {p} y {p}") for i, p in enumerate(BASE.values())], SCHEMA)
    got = {r.doc_id: (r.n_base, r.first_word, r.base_labels) for r in scan(docs).collect()}
    assert got == {i: (2, 1, k) for i, k in enumerate(BASE)}


def test_empty(spark):
    assert scan(spark.createDataFrame([], SCHEMA)).count() == 0
