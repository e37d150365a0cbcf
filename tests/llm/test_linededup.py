from collections import Counter

from pyspark.sql import functions as F

from capturelake.llm.linededup import BLANK, MAX_RATIO, drop_boilerplate

SCHEMA = "doc_id long, source string, text string"


def brute(rows, max_ratio=MAX_RATIO, keep_copies=False):
    pages = Counter(s or "" for _, s, _ in rows)
    held = Counter((s or "", line) for _, s, t in rows for line in {x.strip(BLANK) for x in (t or "").split("\n")} - {""})
    drop = {k for k, n in held.items() if n > 1 and n > max_ratio * pages[k[0]]}
    out = []
    for i, s, t in rows:
        if t is not None:
            lines = t.split("\n")
            kept = [x for x in lines if not x.strip(BLANK) or (s or "", x.strip(BLANK)) not in drop]
            if not keep_copies or any(x.strip(BLANK) for x in kept):
                t = "\n".join(kept)
        out.append((i, t))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None, f"All rights reserved\nown line {i}\n\n  menu \nfooter {i % 3}" + ("\nrare" if i % 40 == 0 else "") + "\ntwice\ntwice" * (i % 2)) for i in range(200)]
    rows += [(300, "s1", None), (301, "s1", ""), (302, "s1", "menu\nAll rights reserved"), (303, "lonely", "menu\nx"), (304, "s2", "menu\nonly own"), (304, "s2", "menu\nonly own")]
    rows += [(400, "s0", "menu\n" + "\n".join(f"line {i}" for i in range(20000)))]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("host", F.lit(1)).withColumn("keys", F.lit(2)).repartition(3)
    for options in ({}, {"keep_copies": True}, {"broadcast_keys": 0}):
        got = drop_boilerplate(docs, **options)
        assert got.columns == docs.columns
        options.pop("broadcast_keys", None)
        assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == brute(rows, **options)


def test_small_hosts_white_space_and_null_ids(spark):
    rows = [(1, "a", "menu \r\nown words"), (2, "a", "\tmenu\nother words"), (3, "b", "menu\nalone"), (None, "a", None), (None, "c", "x\ny"), (4, "d", "same"), (4, "d", "same")]
    got = drop_boilerplate(spark.createDataFrame(rows, SCHEMA), count_as="n")
    assert sorted([(r.doc_id, r.text, r.n) for r in got.collect()], key=str) == sorted([(1, "own words", 1), (2, "other words", 1), (3, "menu\nalone", 0), (None, None, 0), (None, "x\ny", 0), (4, "", 1), (4, "", 1)], key=str)


def test_empty(spark):
    assert drop_boilerplate(spark.createDataFrame([], SCHEMA), count_as="n").columns == ["doc_id", "source", "text", "n"]
    assert drop_boilerplate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_least_number_of_pages(spark):
    docs = spark.createDataFrame([(1, "h", "a\nx"), (2, "h", "a\ny"), (3, "h", "z")], SCHEMA)
    texts = lambda **more: {r.doc_id: r.text for r in drop_boilerplate(docs, **more).collect()}
    assert texts() == {1: "x", 2: "y", 3: "z"} and texts(min_pages=3) == {1: "a\nx", 2: "a\ny", 3: "z"}
