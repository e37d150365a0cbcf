import zlib

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

from capturelake.llm.packing import deal, difference, pack
from capturelake.llm.tokens import LONG, TextEncoder, encoder, spans_hash

TEXTS = [
    None, "", " ", "a", " a", "a  b", "a\n b", "a \n b", "line\nnext\n\nthird", "a b", "x\0 y", "end ", "\n", "<|endoftext|> a", "été ç ñ — “quoted” 5 o'clock it's", "a　b", "tab\tand  spaces \r\n here", "日本語 テキスト 混ぜる", "1234 5678 ,.;", "emoji 😀 ok",
]
SCHEMA = "doc_id long, text string"


def test_encoder_equals_the_tokenizer():
    e = encoder()
    texts = [t or "" for t in TEXTS] + [" ".join(f"word{i % 97} of" for i in range(4000))]
    for got, text in zip(e.encode(texts), texts, strict=True):
        assert got.tolist() == e.whole(text).tolist(), text
    for text in texts:  # alone, and once more from the table
        assert e.encode([text])[0].tolist() == e.whole(text).tolist()


def test_long_text_is_encoded_in_runs():
    e = encoder()
    text = "one two, three four " * (LONG // 12)
    assert len(text) > LONG
    assert e.encode([text])[0].tolist() == e.whole(text).tolist()


def test_special_tokens_are_those_of_the_plain_call():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for text in ["<|endoftext|> a", "a <|endoftext|>b", "<|endoftext|><|endoftext|>", " <|endoftext|>  x\n", "<|endoftext", "x\n<|endoftext|>\n y"]:
        want = plain.encode(text, add_special_tokens=False).ids
        assert encoder().encode([text, "b"])[0].tolist() == encoder().whole(text).tolist() == want
    assert encoder(special_as_text=True).encode(["<|endoftext|> a"])[0].tolist() == [27, 91, 437, 1659, 5239, 91, 29, 257]


def thue_morse(flip: int) -> str:
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(1024))


def test_pieces_with_equal_hashes_keep_their_ids():
    texts = [thue_morse(0), thue_morse(1), "x " + thue_morse(0) + " " + thue_morse(1)]
    e = TextEncoder(encoder().json_path, path("byte_bpe_50k.tiktoken"))
    for got, text in zip(e.encode(texts), texts, strict=True):
        assert got.tolist() == e.whole(text).tolist()
    buf = np.frombuffer("".join(texts[:2]).encode(), np.uint8)
    one, two = spans_hash(buf, np.array([0, 1024]), np.array([1024, 2048]))
    assert one != two
    clash = TextEncoder(encoder().json_path, path("byte_bpe_50k.tiktoken"))
    clash.hash = lambda buf, s, e: (e - s).astype(np.uint64)  # pieces of one length all collide
    for text in ["one two six ten owl cat", "dog is a bee", "one dog"]:
        assert clash.encode([text, text])[1].tolist() == clash.whole(text).tolist()


def plain_differencing(weights, k):
    """Loads of largest differencing, from single weights, with all k windows written out."""
    parts = [(w, [w] + [0] * (k - 1)) for w in weights]
    while len(parts) > 1:
        parts.sort(key=lambda p: -p[0])
        (_, a), (_, b), *rest = parts
        load = sorted((x + y for x, y in zip(sorted(a, reverse=True), sorted(b))), reverse=True)
        parts = [*rest, (load[0] - load[-1], load)]
    return parts[0][1]


def test_differencing_equals_the_plain_form():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n, k = int(rng.integers(5, 120)), int(rng.integers(2, 20))
        w = rng.choice(10**6, n, replace=False) + 1  # no ties
        w[rng.random(n) < 0.3] //= 50
        window, heaviest = difference(w, k)
        want = plain_differencing(w.tolist(), k)
        assert sorted(np.bincount(window, w, minlength=k).astype(int).tolist(), reverse=True) == want and heaviest == want[0]


def test_ties_and_null_ids(spark):
    window, heaviest = difference(np.array([5] * 12), 4)
    assert heaviest == 15 and np.bincount(window).tolist() == [3, 3, 3, 3]
    rows = [(None, "one two"), (None, None), (1, "one two"), (1, "one two")]
    got = pack(spark.createDataFrame(rows, SCHEMA).coalesce(1), capacity=8).collect()
    assert sorted((r.doc_id or -1, r.length) for r in got) == [(-1, 1), (-1, 3), (1, 3), (1, 3)]


def test_differencing_is_balanced_and_complete():
    rng = np.random.default_rng(1)
    for n, k in ((1, 1), (5, 7), (40, 4), (300, 33)):
        w = rng.integers(1, 193, n)
        window, heaviest = difference(w, k)
        load = np.bincount(window, w, minlength=k)
        assert load.sum() == w.sum() and load.max() == heaviest and window.max() < k
    load = np.bincount(deal(w, 1024), w)
    assert load.max() <= 1024


def test_windows_rise_until_they_fit():
    assert np.bincount(deal(np.array([6, 6, 6]), 10)).tolist() == [1, 1, 1]


@pytest.mark.parametrize("partitions", [1, 3])
def test_pieces_rebuild_every_document(spark, partitions):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, " ".join(f"w{i}" for i in range(3000))), (101, "same"), (101, "same")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("sequence_id", F.lit("clash")).repartition(partitions)
    got = pack(docs, capacity=64, part=20, block=16, with_ids=True).collect()
    whole = {i: [*encoder().whole(t or ""), 0] for i, t in rows}
    by_doc, by_sequence = {}, {}
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, ids in whole.items():
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        copies = 2 if i == 101 else 1
        assert sum(len(p.ids) for p in pieces) == copies * len(ids) and {p.doc_tokens for p in pieces} == {len(ids)}
        if copies == 1:
            assert sum((p.ids for p in pieces), []) == [int(x) for x in ids]
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64


def test_little_padding(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 40 + cast(id * 37 % 900 as int)), x -> 'word'), ' ')").alias("text")).coalesce(1)
    got = pack(docs).groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.sum("n"), F.count("*")).first()
    assert got[0] / (got[1] * 1024) > 0.97


def test_empty(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0
