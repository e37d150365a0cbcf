"""Language identification with a blended-spectrum string kernel, Nystrom landmarks and kernel ridge regression.

Kernel: the weighted number of character n-grams (1 to 3, hashed, letters only, lower case) present in both texts, scaled
to 1 for equal texts. Landmarks are a part of the training rows; one-versus-rest ridge regression runs on the landmark
features. As scores are linear in presence, the landmarks' presence rows and the regression weights are multiplied once,
and a batch of texts is scored by one matrix product.

Training rows: at most ``max_train`` labelled rows, an equal number of each language, those with the smallest hash of
their id and text (rows that repeat both are one). Every text is read whole, in training and in scoring. Where there are more
languages than max_train, one row of each is learned from.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text where there is no training
row; with one language, that language is predicted. Repeated rows are scored one by one; a row with a null id is scored,
never learned from, and not held out; an empty table gives no rows.
Ties go to the language that sorts first."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capturelake.llm.common import arrow_rows, release, table, text_chunks

SIZES = (1 << 9, 1 << 12, 1 << 14)  # hash buckets of 1-, 2- and 3-grams
WEIGHTS = (0.5, 1.0, 2.0)
WIDTH = sum(SIZES)
SHARPNESS = 6.0  # of the softmax that turns regression values into a score
UNDETERMINED = "und"
HASHES = 1 << 40


@functools.cache
def _letters() -> np.ndarray:
    """A letter's own code, else that of a space."""
    out = np.full(0x110000, 32, np.uint32)
    code = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]
    out[code] = code
    return out


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of n-gram presence (0 or 1) for each text, and whether it has a letter."""
    raw = [t.lower().encode("utf-32-le", "replace") for t in texts]
    code = _letters()[np.frombuffer(b"\x20\0\0\0".join([b"", *(r + b"\x20\0\0\0" for r in raw), b""]), np.uint32)]
    size = np.array([len(r) // 4 + 2 for r in raw])
    row = np.repeat(np.arange(len(texts)), size)
    code = code[: len(row) + 1]
    out = np.zeros((len(texts), WIDTH), np.float32)
    flat, base = out.reshape(-1), row * WIDTH
    letter = code[:-1] != 32 if len(code) > len(row) else code != 32
    has = np.bincount(row, letter[: len(row)], len(texts)) > 0
    a, b, c = code[: len(row)], np.append(code[1 : len(row)], 32), np.append(code[2 : len(row)], [32, 32])[: len(row)]
    b, c = b[: len(row)].astype(np.uint32), c.astype(np.uint32)
    two = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)
    three = two * np.uint32(0xC2B2AE3D) ^ c * np.uint32(0x27D4EB2F)
    at = 0
    for h, n in zip((a * np.uint32(0x9E3779B1), two, three), SIZES, strict=True):
        flat[base + at + ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - (n - 1).bit_length())).astype(np.int64)] = 1
        at += n
    return out, has


@functools.cache
def _scale() -> np.ndarray:
    return np.sqrt(np.repeat(np.array(WEIGHTS, np.float32), SIZES))


def features(x: np.ndarray) -> np.ndarray:
    """Presence, weighted and scaled so that the product of two rows is their kernel."""
    x = x * _scale()
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


class Model:
    """languages, and a matrix of WIDTH rows and a column for each language; bias as the last row."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    @staticmethod
    def fit(bits: np.ndarray, labels: list[str], landmarks: int = 256, ridge: float = 1e-4) -> Model:
        """bits: packed presence rows. They are unpacked a few at a time."""
        languages = sorted(set(labels))
        if not languages:
            return Model([], np.zeros((WIDTH + 1, 0), np.float32))

        def rows(which: np.ndarray) -> np.ndarray:
            return features(np.unpackbits(bits[which], axis=1)[:, :WIDTH].astype(np.float32))

        mark = rows(np.unique(np.linspace(0, len(bits) - 1, min(landmarks, len(bits))).astype(int)))
        value, vector = np.linalg.eigh((mark @ mark.T).astype(np.float64))
        root = vector / np.sqrt(np.maximum(value, 1e-6))  # kernel between landmarks, to the power -1/2
        phi = np.vstack([(rows(np.arange(i, min(i + 128, len(bits)))) @ mark.T).astype(np.float64) @ root for i in range(0, len(bits), 128)])
        phi = np.hstack([phi, np.ones((len(phi), 1))])
        y = np.where(np.array(labels)[:, None] == np.array(languages), 1.0, -1.0)
        w = np.linalg.solve(phi.T @ phi + ridge * len(phi) * np.eye(phi.shape[1]), phi.T @ y)
        return Model(languages, np.vstack([mark.T @ (root @ w[:-1]), w[-1:]]).astype(np.float32))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        x, has = presence([t or "" for t in texts])
        f = (features(x) @ self.weights[:-1] + self.weights[-1]).astype(np.float64)
        e = np.exp(SHARPNESS * (f - f.max(1, keepdims=True)))
        top = f.argmax(1)
        score = np.where(has, 1 / e.sum(1), 0.0)
        return [self.languages[i] if h else UNDETERMINED for i, h in zip(top, has, strict=True)], score


def _batches(ids: list, texts: list) -> Iterator[tuple[list, list]]:
    for a, b in text_chunks(ids, texts):
        for i in range(0, len(a), 64):
            yield a[i : i + 64], b[i : i + 64]


def learnable(id_col: Column) -> Column:
    """Rows that may be learned from: the others are held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 != 1, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", may_learn: Column | None = None, max_train: int = 2000) -> Model:
    """Fit on at most max_train rows; what reaches the driver is a packed presence row for each."""
    arrow_rows(docs.sparkSession)
    may_learn = learnable(docs[id_col]) if may_learn is None else may_learn
    known = docs[lang_col].isNotNull() & docs[text_col].isNotNull() & docs[id_col].isNotNull()
    rows = docs.filter(may_learn & known).select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"), F.pmod(F.xxhash64(docs[id_col].cast("string"), docs[text_col].cast("string")), F.lit(HASHES)).alias("h"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row a language
    if not counts:
        return Model.fit(np.zeros((0, WIDTH // 8), np.uint8), [])
    each = max(1, max_train // len(counts))
    # Four times the rows wanted pass a threshold on the hash, so no task ever ranks more of a language than that.
    most = docs.sparkSession.createDataFrame([(r.lang, int(HASHES * min(1.0, (4 * each + 100) / r.n))) for r in counts], "lang string, most long")
    few = rows.join(F.broadcast(most), "lang").filter(F.col("h") < F.col("most"))
    chosen = few.select("lang", "h").distinct().withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("n") <= each).select("lang", "h")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _batches(list(range(len(batch))), batch.column(1).to_pylist()):
                x, _ = presence([t or "" for t in texts])
                part = batch.slice(at[0], len(at))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([r.tobytes() for r in np.packbits(x > 0, axis=1)], pa.binary())], ["lang", "h", "bits"])
        release()

    # At most `each` hashes a language; rows that repeat one are equal and count once.
    packed = rows.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "text", "h").mapInArrow(pack, "lang string, h long, bits binary")
    got = packed.groupBy("lang", "h").agg(F.min("bits").alias("bits")).collect()
    got.sort(key=lambda r: (r.h, r.lang))
    bits = np.array([np.frombuffer(r.bits, np.uint8) for r in got], np.uint8).reshape(len(got), -1)
    return Model.fit(bits, [r.lang for r in got])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    arrow_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            for ids, texts in _batches(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lang, score = m.predict(texts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])
        release()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.4, languages: set[str] | None = None) -> DataFrame:
    """The rows of docs, all columns, whose language is known with a score of at least min_score (and is wanted)."""
    arrow_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights))
    at = docs.columns.index(text_col)
    wanted: Callable[[str], bool] = (lambda x: x != UNDETERMINED) if languages is None else languages.__contains__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            keep: list[bool] = []
            for _, texts in _batches(list(range(len(batch))), batch.column(at).to_pylist()):
                lang, score = m.predict(texts)
                keep += [wanted(x) and s >= min_score for x, s in zip(lang, score, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(docs))
    return out.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")
