import math
import random
from collections import defaultdict

import numpy as np

from capturelake.llm.compress import Trie, bounds, compress, fingerprint, with_label_error

SCHEMA = "vec_id long, embedding array<float>, label int, code int, error string"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [max(-(1 << 24), min(1 << 24, math.floor(float(np.float32(x)) * 4096))) for x in v], lab) for i, v, lab, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in kept), default=0)
    kept = [(i, v + [0] * (width - len(v)), lab, v) for i, v, lab in kept]
    cut = bounds(width, parts)
    cells = [[tuple(v[a:b]) for a, b in zip(cut, cut[1:])] for _, v, _, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][3]))[:entries]
    books = [[cells[k][p] for k in order] for p in range(parts)]

    def near(p, x):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            at = defaultdict(list)
            for c in cells:
                at[near(p, c[p])[0]].append(c[p])
            books[p] = [tuple(sum(x) // len(at[e]) for x in zip(*at[e])) if at[e] else b for e, b in enumerate(books[p])]
    out, by_label = [], defaultdict(int)
    for (i, _, lab, _), c in zip(kept, cells):
        found = [near(p, c[p]) for p in range(parts)]
        out.append((i, "".join("%02x" % e for e, _ in found), sum(d for _, d in found), lab))
        by_label[lab] += out[-1][2]
    return sorted(((i, c, e, by_label[lab]) for i, c, e, lab in out), key=str), books


def found(spark, rows, **more):
    codes, books = compress(spark.createDataFrame(rows, SCHEMA), **more)
    out = with_label_error(codes).select("id", "code", "error", "label_error").collect()
    return sorted(map(tuple, out), key=str), books


def equal(spark, rows, **more):
    got, books = found(spark, rows, **more)
    want, entries = brute(rows)
    assert got == want
    assert fingerprint(books) == fingerprint([np.array(e, np.int64).reshape(len(e), -1) for e in entries])


def test_tries_hold_every_row_and_share_prefixes():
    rng = np.random.default_rng(2)
    rows = rng.integers(-3, 3, (500, 4))
    trie, leaf = Trie.build(rows)
    whole = np.vstack([path for *_, path in trie.walk(np.zeros((1, 4), np.int64), run=7)])
    assert (whole == np.unique(rows, axis=0)).all() and (whole[leaf] == rows).all() and trie.weights.sum() == 500
    assert [len(v) for v in trie.values] == [len(np.unique(rows[:, : d + 1], axis=0)) for d in range(4)]
    book = rng.integers(-3, 3, (5, 4))
    plain = ((whole[:, None] - book) ** 2).sum(2)
    code, error = trie.nearest(book)
    assert (code == plain.argmin(1)).all() and (error == plain.min(1)).all()


def test_runs_are_walked_in_order_and_depth_first():
    rows = np.array([[a, b, c] for a in range(4) for b in range(4) for c in range(4)])
    trie, _ = Trie.build(rows)
    spans = [(lo, hi) for lo, hi, *_ in trie.walk(np.zeros((2, 3), np.int64), run=3)]
    assert spans[0][0] == 0 and spans[-1][1] == 64 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_codes_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(24)], rng.choice([None, 1, 2]), 0, "x") for i in rng.sample(range(900), 300)]
    rows += [(1000 + i, rows[0][1], 3, 0, "x") for i in range(150)]  # one vector is a third of all
    equal(spark, rows)
    equal(spark, rows, block=17)


def test_ties_go_to_the_first_entry_and_sums_are_rounded_down(spark):
    rows = [(i, [(-1 if i % 2 else 1) * (i % 5) / 4096] * 8, 1, 0, None) for i in range(40)]
    equal(spark, rows)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None, 1, 0, None), (2, [None] * 8, 1, 0, None), (3, [inf] * 8, 1, 0, None), (4, [nan] + [0.0] * 7, 1, 0, None), (5, [], None, 0, None), (6, [0.5] * 11, 2, 0, None), (7, [-0.25] * 3, 2, 0, None), (7, [-0.25] * 3, 2, 0, None), (None, [0.1] * 11, None, 0, None), (8, [1e30] * 8, 1, 0, None)]
    got, _ = found(spark, rows)
    assert len(got) == 6 and [r[0] for r in got].count(7) == 2
    equal(spark, rows)
    assert found(spark, rows[:4])[0] == [] and found(spark, [])[0] == []
