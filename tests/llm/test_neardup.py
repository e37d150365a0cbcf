import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from capturelake.llm.common import Scratch
from capturelake.llm.components import components
from capturelake.llm.neardup import bag_min_hash, bags, keep_representatives, near_duplicates, occurrences, similar
from capturelake.llm.shingles import overlap

SCHEMA = "doc_id long, text string"


def words_of(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def brute_bag(text):
    w = words_of(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def brute_classes(rows):
    bag = {i: brute_bag(t) for i, t in rows}
    root = {i: i for i in bag}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bag)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if jaccard(bag[i], bag[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(3000))
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 12)):
            copy = base[:]
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    shared = [word() for _ in range(60)]  # a passage that many share, with endings of their own
    for _ in range(30):
        rows.append((n, " ".join(shared + [word() for _ in range(rng.randint(10, 60))])))
        n += 1
    return rows


def test_bags_equal_brute_force():
    a, b = "One two, three-four five six seven", "one two three four five six eight eight eight eight eight eight eight"
    s, start = bags([a, b, "", "just three words"])
    assert np.diff(start).tolist() == [3, 9, 0, 1]
    assert abs(overlap(s[start[0] : start[1]], s[start[1] : start[2]]) - jaccard(brute_bag(a), brute_bag(b))) < 1e-12


def test_signature_estimates_weighted_jaccard():
    rng = random.Random(0)
    base = [f"w{rng.randrange(40)}" for _ in range(400)]
    texts = [" ".join(base), " ".join(base[:300]), " ".join(base + base[:200]), "x " * 700, "x " * 350]
    s, start = bags(texts)
    sig = bag_min_hash(s, start, 4096)
    for i, j in ((0, 1), (0, 2), (1, 2), (3, 4)):
        true = jaccard(brute_bag(texts[i]), brute_bag(texts[j]))
        assert abs((sig[i] == sig[j]).mean() - true) < 0.04
    assert np.isinf(bag_min_hash(*bags([""]), 8)).all()


def test_classes_equal_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == brute_classes(rows)


def test_edge_cases(spark):
    long = " ".join(f"t{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " ,. "), (4, "Same words here"), (5, "same, WORDS here"), (6, long), (7, long + " end"), (8, "lone text of several words here"), (8, "lone text of several words here"), (9, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("clash")).withColumn("rep", F.lit(1))
    got = {(r.doc_id, r.class_id, r.class_size) for r in near_duplicates(docs).collect()}
    assert got == {(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 2), (5, 4, 2), (6, 6, 2), (7, 6, 2), (8, 8, 1), (9, 9, 1)}
    kept = keep_representatives(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 8, 9]


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    edges += [(1000, i) for i in range(1001, 1400)]  # a node with very many neighbours
    with Scratch(spark) as scratch:
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100, **{i: 1000 for i in range(1000, 1400)}}


def test_few_similar_pairs_in_a_large_bucket(spark):
    rng = random.Random(8)
    shared = [f"p{i}" for i in range(120)]
    rows = [(i, " ".join(shared + [f"w{rng.randrange(9999)}" for _ in range(rng.randint(30, 40))])) for i in range(120)]
    rows += [(200 + i, rows[i * 11 + 3][1].rsplit(" ", 2)[0] + " other end") for i in range(8)]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), bands=3, rows=1).collect()}
    assert got == brute_classes(rows) and len(set(got.values())) < len(rows)


def test_no_link_of_a_shared_passage_is_lost(spark):
    """Texts of 456 words that share 404 are just not similar; forty pairs of them are."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    shared = [word() for _ in range(404)]
    rows = []
    for i in range(200):
        own = [word() for _ in range(52)] if i % 5 else rows_own[:8] + [word() for _ in range(44)] if i else [word() for _ in range(52)]
        rows_own = own if i % 5 == 4 or i == 0 else rows_own  # noqa: F821
        rows.append((i, " ".join(shared + own)))
    truth = [(a, b) for a in range(200) for b in range(a) if jaccard(brute_bag(rows[a][1]), brute_bag(rows[b][1])) >= 0.8]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert len(truth) >= 30 and got == brute_classes(rows)


def test_hot_keys_are_spread(spark):
    """A large group of copies, and a large group around one text: more rows a key than join_groups leaves to one task."""
    base = [f"b{i}" for i in range(300)]
    rows = [(i, " ".join(base)) for i in range(400)]
    rows += [(1000 + i, " ".join(base[:290] + [f"e{i}x{j}" for j in range(10)])) for i in range(400)]
    got = {(r.doc_id, r.class_id, r.class_size) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == {(i, 0, 800) for i, _ in rows}


def test_null_ids_and_versions(spark):
    text = " ".join(f"t{i}" for i in range(50))
    other = " ".join(f"u{i}" for i in range(50))
    docs = spark.createDataFrame([(None, text), (None, text), (1, text), (2, text), (3, other), (3, other), (3, text), (4, other)], SCHEMA)
    got = sorted(((r.doc_id, r.class_id, r.class_size) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, None, 1), (None, None, 1), (1, 1, 4), (2, 1, 4), (3, 1, 4), (4, 1, 4)], key=str)
    assert sorted([(r.doc_id, r.text) for r in keep_representatives(docs).collect()], key=str) == sorted([(None, text), (None, text), (1, text)], key=str)


def test_similar_equals_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        a = [f"w{rng.randrange(12)}" for _ in range(rng.randint(1, 40))]
        b = a[:]
        for _ in range(rng.randint(0, 3)):
            b[rng.randrange(len(b)) : rng.randrange(len(b)) + 1] = ["x"]
        s, start = bags([" ".join(a), " ".join(b)], 1)
        one, two = Counter(a), Counter(b)
        if b:
            assert similar(occurrences(s[: start[1]]), occurrences(s[start[1] :]), 0.8) == (jaccard(one, two) >= 0.8)
