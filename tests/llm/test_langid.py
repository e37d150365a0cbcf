import numpy as np
from pyspark.sql import functions as F

from capturelake.llm.langid import Model, features, identify, keep_identified, learnable, presence, train

SCHEMA = "doc_id long, text string, lang string"
SAMPLES = {
    "en": "the cat and the dog went with their friends to this house that was there when they had been",
    "de": "der hund und die katze sind nicht mit dem mann auf das haus gegangen weil sie schon schlafen",
    "fr": "le chat et le chien sont dans la maison avec des amis qui ne sont pas encore venus pour elle",
}


def rows(n=240):
    out = []
    for i in range(n):
        lang = list(SAMPLES)[i % 3]
        words = SAMPLES[lang].split()
        out.append((i, " ".join(words[(i * 7 + k * (i % 5 + 1)) % len(words)] for k in range(4 + i % 9)), lang))
    return out


def test_kernel_is_presence_overlap():
    x, has = presence(["abc", "abc abc", "xyz", "12 !", ""])
    k = features(x) @ features(x).T
    assert has.tolist() == [True, True, True, False, False]
    assert np.allclose(np.diag(k)[:3], 1) and k[0, 1] > 0.6 > k[0, 2]


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    model = train(docs, max_train=90)
    got = identify(docs, model).join(docs, "doc_id").withColumn("held", ~learnable(F.col("doc_id"))).filter("held").collect()
    assert len(got) > 50 and sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_are_not_used(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    other = docs.withColumn("lang", F.when(learnable(F.col("doc_id")), F.col("lang")).otherwise("zz"))
    a, b = train(docs), train(other)
    assert a.languages == b.languages == ["de", "en", "fr"] and np.array_equal(a.weights, b.weights)


def test_edge_cases(spark):
    long = SAMPLES["fr"] * 3000
    extra = [(1000, None, "en"), (1001, "", "en"), (1002, "123 %%", "en"), (1003, long, None), (1003, long, None), (1004, "日本", None)]
    docs = spark.createDataFrame(rows() + extra, SCHEMA).withColumn("score", F.lit("clash")).withColumn("id", F.lit(0))
    model = train(docs)
    got = [(r.doc_id, r.lang_pred) for r in identify(docs, model).filter("doc_id >= 1000").orderBy("doc_id").collect()]
    assert got[:5] == [(1000, "und"), (1001, "und"), (1002, "und"), (1003, "fr"), (1003, "fr")] and got[5][1] in model.languages
    kept = keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert {1000, 1001, 1002}.isdisjoint(r.doc_id for r in kept.collect()) and kept.filter("doc_id = 1003").count() == 2


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert train(none).languages == [] and identify(none, train(none)).count() == 0
    docs = spark.createDataFrame([(1, "some text", None)], SCHEMA)
    assert identify(docs, train(docs)).first().lang_pred == "und"
    one = Model.fit(np.packbits(presence(["abc def"])[0] > 0, axis=1), ["xx"])
    assert one.predict(["anything", None])[0] == ["xx", "und"]


def test_equals_plain_kernel_ridge_regression():
    """With all training rows as landmarks the Nystrom features are exact: the same values as the dual form gives."""
    train_rows, labels = zip(*[(t, lang) for _, t, lang in rows(90)], strict=True)
    first = {t: n for n, t in reversed(list(enumerate(train_rows)))}  # equal rows would make the kernel singular
    own = sorted(first.values())
    x = presence([train_rows[n] for n in own])[0]
    y = [labels[n] for n in own]
    model = Model.fit(np.packbits(x > 0, axis=1), y, landmarks=len(own), ridge=1e-3)
    k = features(x).astype(np.float64) @ features(x).T.astype(np.float64) + 1  # the bias is one more feature, of value 1
    gold = np.where(np.array(y)[:, None] == np.array(sorted(set(y))), 1.0, -1.0)
    dual = np.linalg.solve(k + 1e-3 * len(own) * np.eye(len(own)), gold)
    other = presence([t for _, t, _ in rows(150)[90:]] + ["the dog and other words", "ein anderes haus"])[0]
    want = (features(other) @ features(x).T + 1) @ dual
    got = features(other) @ model.weights[:-1] + model.weights[-1]
    assert np.abs(got - want).max() < 1e-2 and (got.argmax(1) == want.argmax(1)).all()
