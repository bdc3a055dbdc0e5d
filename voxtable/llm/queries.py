"""Queries of the operators over whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.llm import hmm, jaccard, langid, media, mixing, neardup, packing, phrases, quality, repeats, spelling, tokens, vectors
from voxtable.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            CHECKS[name] = sql
        return fn
    return add


@query("op1_token_counts")
def op1(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


@query("op2_top_k", vectors.TOP_SQL)
def op2(spark, sf_dir):
    rows = vectors.clean_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256.0)
    return vectors.top_k(rows.filter(F.col("id") % 50 == 0), rows, 5)


@query("op4_quality")
def op4(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_packing")
def op6(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op7_media")
def op7(spark, sf_dir):
    return media.media_report(table(spark, sf_dir, "documents"))


@query("op9_mixing", mixing.MIX_SQL)
def op9(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


@query("op10_language")
def op10(spark, sf_dir):
    return langid.language_report(table(spark, sf_dir, "documents"))


@query("op8_near_duplicates", neardup.NEAR_SQL)
def op8(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


@query("op5_lm_scores")
def op5(spark, sf_dir):
    return hmm.score(table(spark, sf_dir, "documents"))


@query("op3_repeated_bytes")
def op3(spark, sf_dir):
    return repeats.repeat_report(table(spark, sf_dir, "documents"))


@query("op11_phrases", phrases.PHRASE_SQL)
def op11(spark, sf_dir):
    return phrases.mine_phrases(table(spark, sf_dir, "documents", "text", "lang"))


@query("op12_spelling")
def op12(spark, sf_dir):
    return spelling.variants(spelling.count_words(table(spark, sf_dir, "documents", "doc_id", "text"), slip=97))


@query("op13_jaccard_join", jaccard.JOIN_SQL)
def op13(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"), words=5, percent=80)
