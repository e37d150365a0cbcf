import random
import re
from collections import Counter
from itertools import permutations

import numpy as np

from capturelake.llm.audit import Transducer, audit, distinct, measure, outcomes

SCHEMA = "doc_id long, text string, lang string, n int, part string"
LABELS = "doc_id long, quality int, toxic int, good string"


def fails(text, again):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    caps = sum("A" <= c <= "Z" for c in text)
    return frozenset(f for f, bad in zip("ABCDE", [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * caps > 3 * len(text), any(c in "#$%&*|" for c in text), again]) if bad)


def brute(docs, labels):
    good, toxic = {i for i, q, _, _ in labels if q == 1 and i is not None}, {i for i, _, t, _ in labels if t == 1 and i is not None}
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    rows = [(p or "", fails(t or "", i is not None and i > least[t or ""]), i) for i, t, p, *_ in docs]
    out, shapley = {}, Counter()
    for part in {p for p, _, _ in rows}:
        for order in map("".join, permutations("ABCDE")):
            for step, own in enumerate(order, 1):
                here = [(f, i) for p, f, i in rows if p == part]
                alive = [(f, i) for f, i in here if not f & set(order[: step - 1])]
                gone = [(f, i) for f, i in alive if own in f]
                shapley[part, own] += len(gone)
                out[part, order, step] = [len(alive) - len(gone), len(gone), sum(own in f for f, _ in here) - len(gone), sum(f == {own} for f, _ in here), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)]
    return sorted((p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items())


def found(spark, docs, labels):
    return sorted(map(tuple, audit(outcomes(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS))).collect()))


def test_measures_equal_regular_expressions():
    rng = random.Random(3)
    texts = ["", " ", "a", " A b\tB\n", "é Éa b", "日本 語語　x", "\x00\x1f\x7f %", "x" * 200 + " " + "x" * 200 + " " + "x" * 199 + "y", "𝄞 𝄞 a\x85b"]
    texts += ["".join(rng.choice("abAB é日 \t\r#\x0b") for _ in range(rng.randrange(400))) for _ in range(200)]
    got = measure([t.encode() for t in texts])
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert [int(got[c][k]) for c in ("words", "distinct", "capitals", "points", "symbols")] == [len(w), len(set(w)), sum("A" <= c <= "Z" for c in t), len(t), sum(c in "#$%&*|" for c in t)]


def test_walk_emits_a_begin_and_an_end_for_every_word():
    out = Transducer().walk(np.frombuffer("a  é ".encode(), np.uint8))
    assert np.flatnonzero(out & Transducer.BEGINS).tolist() == [0, 3] and np.flatnonzero(out & Transducer.ENDS).tolist() == [1, 5]


def test_equal_hashes_do_not_make_words_equal():
    data = np.frombuffer(b"ab cd ab ab" + bytes(9), np.uint8)
    start, size, owner = np.array([0, 3, 6, 9]), np.array([2, 2, 2, 2]), np.array([0, 0, 0, 1], np.int32)
    for h in (np.zeros(4, np.uint64), np.full(4, 0xFFFFFFFFFFFFFFFF, np.uint64)):
        assert distinct(data, start, size, owner, 2, h).tolist() == [2, 1]


def test_audit_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    docs = []
    for i in range(60):
        text = " ".join(rng.choice(words[: rng.choice([3, 90, 300])]) for _ in range(rng.choice([5, 250, 400])))
        text = text.upper() if rng.random() < 0.3 else text
        docs.append((i, text + rng.choice(["", " #1", " |"]), rng.choice(["en", "de", None, ""]), 0, "x"))
    copies = [(100 + i, docs[i % 7][1], "en", 1, "y") for i in range(30)]
    odd = [(200, None, "fr", 0, None), (201, "", "fr", 0, None), (None, docs[0][1], "en", 0, None), (None, "", None, 0, None), (3, docs[3][1], "de", 0, None), (3, docs[3][1], "en", 0, None), (5, "other", "en", 0, None), (300, "é" * 50000 + " A", "xx", 0, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1]), "z") for i in range(0, 220, 2)] + [(2, 1, 1, "z"), (None, 1, 1, "z")]
    every = docs + copies + odd
    assert found(spark, every, labels) == brute(every, labels)


def test_empty_tables(spark):
    assert found(spark, [], []) == []
    got = found(spark, [(1, "a", None, 0, None)], [])
    assert len(got) == 600 and {r[0] for r in got} == {""} and got == brute([(1, "a", None, 0, None)], [])


def test_a_text_of_many_rows_stays_in_small_groups(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 'copy', concat('t', id)) as text", "'en' as lang")
    counts = outcomes(docs, spark.createDataFrame([], LABELS)).collect()
    assert sum(r.n for r in counts) == 4000 and sum(r.n for r in counts if r.failed & 16) == 1333
