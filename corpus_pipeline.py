"""Corpus preparation: language ID, line dedup, near-dedup, decontamination and packing, in this order.

Every stage takes the rows that the one before it kept, written as Parquet and read again.

Defined cases: a null text, or one without a letter, goes with the first stage; a null id stays (it cannot be named in a class
of near duplicates); of rows that repeat an id, one stays; a null source is the source ''; an empty table gives no rows; other
columns of documents pass through all stages but the last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from capturelake.llm.common import materialize, table
from capturelake.llm.decontam import keep_clean
from capturelake.llm.langid import keep_identified, train
from capturelake.llm.linededup import drop_boilerplate
from capturelake.llm.neardup import keep_representatives
from capturelake.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the model learns from the rows of docs that are not held out."""
    return keep_identified(docs, train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source. Copies of a document stay whole for the next stage, which
    keeps one of them; without that, none of their text would be left."""
    return drop_boilerplate(docs, keep_copies=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every class of near duplicates."""
    return keep_representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"), short_inside=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: SQL has no string kernel, MinHash or tokenizer; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
