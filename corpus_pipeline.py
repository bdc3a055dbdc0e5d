"""From raw documents to packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` and returns the rows it keeps; each result is written as Parquet below the
shared folder and read again as the next stage's documents. All stages but the last return the columns of documents.

1. ``language``: documents whose language is rejected (no letter, or unlike all learned languages) go.
2. ``near_duplicates``: of documents alike in 80 % of their five-word shingles, the one with the least id stays.
3. ``repeated_passages``: bytes covered by a string of 200 bytes that starts elsewhere, too, are cut from the texts.
4. ``mixing``: documents are emitted floor(rate) times and once more by a hash-seeded draw, to reach source targets.
5. ``packing``: words are packed in sequences of several permitted lengths; one row per piece.

Null and empty texts are rejected by the first stage. A text that loses all its bytes stays as an empty document, and
has one row without bin at the end. Of repeated rows the second stage keeps one. Very long texts pass whole. Stages name their own
columns by random words, so other columns may have any name and pass through to the last. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxtable.llm import langid, mixing, neardup, packing, repeats
from voxtable.llm.common import settle, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs, words=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.drop_repeats(docs, length=200)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("mixing", mix_sources), ("packing", pack_sequences)]

# Character models, sketches and suffix arrays cannot be expressed in SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        settle(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
