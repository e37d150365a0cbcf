import random
from collections import Counter

import corpus_pipeline
from capturelake.llm.langid import train
from capturelake.llm.tokens import encoder
from tests.llm.test_decontam import brute as brute_leaks
from tests.llm.test_langid import SAMPLES
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_neardup import brute_classes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def data():
    rng = random.Random(9)
    rows = []
    item = " ".join(rng.choice(SAMPLES["en"].split()) + str(i) for i in range(25))
    for i in range(90):
        lang = list(SAMPLES)[i % 3]
        body = " ".join(rng.choice(SAMPLES[lang].split()) + ("" if rng.random() < 0.6 else f" n{rng.randrange(500)}") for _ in range(40))
        rows.append((i, ("menu of the site\n" if i % 2 else "") + body + (f"\n{item}" if i % 11 == 0 else ""), lang, f"s{i % 2}", 1))
    rows += [(200 + i, rows[i * 3][1] + " end", rows[i * 3][2], rows[i * 3][3], 1) for i in range(12)] + [(300, None, "en", "s0", 0), (301, "12 34", "en", None, 0), (302, "", "en", "s1", 0)]
    return rows, [(1, item), (2, "never seen item words in any of the texts")]


def test_equals_brute_force(spark, tmp_path):
    rows, items = data()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = train(docs)
    langs, scores = model.predict([r[1] for r in rows])
    kept = [r for r, x, s in zip(rows, langs, scores, strict=True) if x != "und" and s >= 0.4]
    kept = dict(brute_lines([(r[0], r[3], r[1]) for r in kept]))
    classes = brute_classes(list(kept.items()))
    kept = {i: t for i, t in kept.items() if classes[i] == i}
    leaked = {d for d, *_ in brute_leaks(list(kept.items()), items)}
    kept = {i: t for i, t in kept.items() if i not in leaked}
    assert leaked and len(kept) < 90
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
    assert dict(total) == {i: len(encoder().whole(t)) + 1 for i, t in kept.items()}


def test_stages_keep_columns(spark, tmp_path):
    rows, items = data()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def lengths(spark, at, docs, items):
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    total = Counter()
    for r in corpus_pipeline.run(spark, str(at)).collect():
        total[r.doc_id] += r.length
    return dict(total)


def test_empty_tables(spark, tmp_path):
    rows, items = data()
    assert lengths(spark, tmp_path / "a", spark.createDataFrame([], SCHEMA), items) == {}
    assert len(lengths(spark, tmp_path / "b", spark.createDataFrame(rows[:30], SCHEMA), [])) > 20


def test_repeats_and_clashing_columns(spark, tmp_path):
    """Rows that repeat an id leave one; columns with names that the stages use themselves change nothing."""
    rows, items = data()
    docs = spark.createDataFrame(rows[:40], SCHEMA)
    plain = lengths(spark, tmp_path / "a", docs, items)
    odd = docs.selectExpr("*", "7 AS id", "'x' AS spans", "-1 AS root", "'h' AS host", "0.5D AS score", "'l' AS line", "3 AS token", "1 AS n")
    assert lengths(spark, tmp_path / "b", odd, items) == plain
    assert lengths(spark, tmp_path / "c", docs.union(docs.filter("doc_id = 3")), items).keys() == plain.keys()
