import random
from collections import Counter

from pyspark.sql import functions as F

from capturelake.llm.decontam import Index, contaminated, keep_clean
from tests.llm.test_neardup import brute_bag, jaccard, words_of

SCHEMA, ITEMS = "doc_id long, text string", "item_id long, text string"


def brute(rows, items, similarity=0.8):
    """Best window of each document for each item, all windows of the item's size looked at."""
    out = {}
    for d, text in rows:
        w = words_of(text)
        for i, item in items:
            n = len(words_of(item))
            if not n or n < 5 and n != len(w):
                continue
            for s in range(len(w) - n + 1):
                got = jaccard(brute_bag(" ".join(w[s : s + n])), brute_bag(item))
                if got >= similarity and got > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (got, s)
    return {(d, i, s, round(x, 9)) for (d, i), (x, s) in out.items()}


def data():
    rng = random.Random(4)
    word = lambda: "w" + str(rng.randrange(400))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 60)))) for i in range(20)] + [(90, "tiny item"), (91, None), (92, ""), (93, "Repeated Item of six words here"), (94, "repeated item of six words here")]
    rows = []
    for d in range(60):
        text = [word() for _ in range(rng.randint(0, 150))]
        if d % 3 == 0:
            item = words_of(items[rng.randrange(20)][1])
            if d % 2:
                item[rng.randrange(len(item))] = "edited"
            at = rng.randrange(len(text) + 1)
            text[at:at] = item * (1 + d % 2)
        rows.append((d, (" ".join(text)).title()))
    return rows + [(100, None), (101, ""), (102, "Tiny, ITEM!"), (103, "a tiny item"), (104, "x repeated item of six words here y")], items


def test_equals_brute_force(spark):
    rows, items = data()
    docs, bench = spark.createDataFrame(rows, SCHEMA).withColumn("item_id", F.lit(5)).repartition(3), spark.createDataFrame(items, ITEMS)
    got = {(r.doc_id, r.item_id, r.first_word, round(r.similarity, 9)) for r in contaminated(docs, bench).collect()}
    assert got == brute(rows, items) and len(got) > 10
    assert {(r.doc_id, r.item_id, r.first_word, round(r.similarity, 9)) for r in contaminated(docs, bench, block=6).collect()} == got
    kept = keep_clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {x[0] for x in got}


def test_long_text_and_repeats(spark):
    item = " ".join(f"k{i}" for i in range(40))
    long = " ".join(f"z{i % 999}" for i in range(60000)) + " " + item
    docs = spark.createDataFrame([(1, long), (1, long), (2, "clean")], SCHEMA)
    got = contaminated(docs, spark.createDataFrame([(7, item)], ITEMS)).collect()
    assert [(r.doc_id, r.item_id, r.first_word, r.similarity) for r in got] == [(1, 7, 60000, 1.0)] * 2


def test_empty(spark):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ITEMS)
    docs = spark.createDataFrame([(1, "a b c d e f")], SCHEMA)
    assert contaminated(none, spark.createDataFrame([(1, "a b")], ITEMS)).count() == 0
    assert contaminated(docs, items).count() == 0 and keep_clean(docs, items).count() == 1


def test_documents_shorter_than_the_item(spark):
    item = [f"k{i}" for i in range(59)]
    rows = [(1, " ".join(item[:-1])), (2, " ".join(item[2:])), (3, " ".join(item[:30])), (4, " ".join(item)), (5, " ".join(item[:48])), (6, " ".join(item[:49]))]
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(7, " ".join(item)), (8, "other text of six words here")], ITEMS)
    want = {(d, 7, 0, round(jaccard(brute_bag(t), brute_bag(" ".join(item))), 9)) for d, t in rows if d not in (3,)}
    want = {x for x in want if x[3] >= 0.8}
    assert {x[0] for x in want} == {1, 2, 4, 5, 6}
    assert {(r.doc_id, r.item_id, r.first_word, round(r.similarity, 9)) for r in contaminated(docs, bench).collect()} == want
    assert [r.doc_id for r in keep_clean(docs, bench).collect()] == [3]


def test_short_items_inside_documents(spark):
    docs = spark.createDataFrame([(1, "a Tiny, item and a tiny item"), (2, "tiny thing item"), (3, "tiny item"), (4, "tiny"), (5, None), (6, "one two three four five")], SCHEMA)
    bench = spark.createDataFrame([(90, "tiny item"), (91, "TINY ITEM"), (92, "two three four five"), (93, "")], ITEMS)
    got = sorted(tuple(r) for r in contaminated(docs, bench, short_inside=True).collect())
    assert got == [(1, 90, 1, 1.0), (1, 91, 1, 1.0), (3, 90, 0, 1.0), (3, 91, 0, 1.0), (6, 92, 1, 1.0)]
    assert sorted(r.doc_id for r in keep_clean(docs, bench, short_inside=True).collect()) == [2, 4, 5]


def test_a_prompt_that_all_items_share_is_cheap():
    """Items with a common prompt, and documents that hold the prompt alone: none matches, and none is compared with all items."""
    import time

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    prompt = [word() for _ in range(30)]
    items = [" ".join(prompt + [word() for _ in range(20)]) for _ in range(4000)]
    index = Index(list(range(4000)), items)
    around = lambda middle: " ".join([word() for _ in range(90)] + middle + [word() for _ in range(90)])
    docs = [around(prompt) for _ in range(10)]
    began = time.perf_counter()
    assert list(index.matches(docs, 0.8)) == []
    assert time.perf_counter() - began < 1
    assert [(i, w) for _, i, w, _ in index.matches([around(items[7].split())], 0.8)] == [(7, 90)]
    near = items[9].split()
    near[40] = "other"  # five shingles of 46 differ
    assert [(i, w, round(x, 4)) for _, i, w, x in index.matches([around(near)], 0.8)] == [(9, 90, round(41 / 51, 4))]


def test_search_equals_every_window_and_item():
    rng = random.Random(2)
    for trial in range(40):
        words_of = ["w%d" % i for i in range(rng.choice([3, 12, 60]))]
        items = [" ".join(rng.choice(words_of) for _ in range(rng.randrange(5, 14))) for _ in range(30)]
        doc = " ".join(rng.choice(words_of) for _ in range(rng.randrange(4, 60))) + " " + rng.choice(items) + " " + rng.choice(words_of)
        got = {(i, w, round(x, 9)) for _, i, w, x in Index(list(range(30)), items, radius=64).matches([doc], 0.8)}
        grams = lambda t: [tuple(t[i : i + 5]) for i in range(len(t) - 4)]
        s, want = grams(doc.split()), set()
        for i, text in enumerate(items):
            bag = Counter(grams(text.split()))
            k, best = sum(bag.values()), None
            for w in range(max(len(s) - k, 0) + 1):
                own = Counter(s[w : w + k])
                x = sum((own & bag).values()) / sum((own | bag).values())
                if x >= 0.8 and (best is None or x > best[1]):
                    best = (w, x)
            if best:
                want.add((i, best[0], round(best[1], 9)))
        assert got == want
