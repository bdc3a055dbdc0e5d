"""Splits and samples that repeat exactly.

Both are filters on the row's own hash: the cut-off hash is found from per-prefix counts, so
slice rows are neither sorted nor shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voxtable.functions.hashing import order_key
from voxtable.operators.ordered import hash_cutoff, hash_cutoffs


def split_sizes(n: Column, val: float, test: float) -> tuple[Column, Column]:
    """``(n_val, n_test)``: rounded half to even, then cut so that training keeps a case."""
    n_test = F.bround(n * F.lit(float(test)))
    n_val = F.bround(n * F.lit(float(val)))
    n_val = F.least(n_val, F.greatest(F.lit(0), n - n_test - 1))
    n_test = F.least(n_test, F.greatest(F.lit(0), n - n_val - 1))
    return n_val.cast("long"), n_test.cast("long")


def split_cases(df: DataFrame, key: str | Column = "case_id", val: float = 0.15, test: float = 0.15,
                seed: int = 42, out: str = "split") -> DataFrame:
    """Adds the split of each row; a case is never in two of them."""
    key = F.col(key) if isinstance(key, str) else key
    h = order_key(seed, key)
    cases = df.select(key.alias("_key")).distinct().select(order_key(seed, "_key").alias("_h"))
    n_val, n_test = split_sizes(F.count(F.lit(1)), val, test)
    ends = hash_cutoffs(cases, "_h", n_test, n_test + n_val).scalar()
    test_end, val_end = (F.get(ends, F.lit(i)) for i in range(2))
    return df.withColumn(out, F.when(h <= test_end, "test").when(h <= val_end, "val").otherwise("train"))


def members(slices: DataFrame, split: DataFrame, name: str, key: str = "case_id") -> DataFrame:
    """Rows of the cases of one split; ``split`` has one row per case."""
    return slices.join(split.where(F.col("split") == name).select(key), key, "left_semi")


def sample_slices(slices: DataFrame, positive_only: bool = True, neg_per_pos: float | None = None,
                  seed: int = 0, flag: str = "has_lesion", id_cols: Sequence[str] = ("case_id", "z")) -> DataFrame:
    """All positives with ``min(n_neg, int(ratio * n_pos))`` negatives, or one of the plain modes."""
    if neg_per_pos is None:
        return slices.where(flag) if positive_only else slices
    keyed = slices.withColumn("_h", order_key(seed, *id_cols))
    pos, neg = F.col(flag), ~F.col(flag)
    n = slices.agg(F.least(F.count_if(neg), F.floor(F.lit(float(neg_per_pos)) * F.count_if(pos))).alias("n")).scalar()
    cut = hash_cutoff(keyed.where(neg).select("_h"), "_h", F.max(n)).scalar()
    return keyed.where(pos | (F.col("_h") <= cut)).drop("_h")


def class_weight(df: DataFrame, flag: str = "has_lesion") -> DataFrame:
    """``n_neg / max(1, n_pos)``."""
    pos = F.count_if(F.col(flag))
    return df.agg(pos.alias("n_pos"), F.count_if(~F.col(flag)).alias("n_neg"),
                  (F.count_if(~F.col(flag)) / F.greatest(F.lit(1), pos)).alias("pos_weight"))
