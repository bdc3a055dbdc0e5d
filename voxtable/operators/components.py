"""Connected foreground components of slice masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from voxtable.functions import arrays as A
from voxtable.functions.memory import release

LABELLED = 1 << 17       # pixels labelled at once; a dozen arrays of that size are alive then
COMPONENT = (StructType().add("seed", IntegerType()).add("size", IntegerType())
             .add("cy", DoubleType()).add("cx", DoubleType()))


def label_stack(masks: np.ndarray) -> np.ndarray:
    """Label ``(n, h, w)`` masks: each pixel gets the smallest flat index of its component.

    All slices of a batch are relaxed together; following a label to its own label doubles
    the reach of every round.
    """
    n, h, w = masks.shape
    none = h * w
    own = np.broadcast_to(np.arange(none).reshape(h, w), masks.shape)
    lab = np.where(masks, own, none)
    while True:
        pad = np.pad(lab, ((0, 0), (1, 1), (1, 1)), constant_values=none)
        near = np.minimum.reduce([pad[:, 1:-1, 1:-1], pad[:, :-2, 1:-1], pad[:, 2:, 1:-1],
                                  pad[:, 1:-1, :-2], pad[:, 1:-1, 2:]])
        near = np.where(masks, near, none).reshape(n, -1)
        table = np.concatenate([near, np.full((n, 1), none)], axis=1)
        nxt = np.take_along_axis(table, near, axis=1).reshape(masks.shape)
        if np.array_equal(nxt, lab):
            return lab
        lab = nxt


def _describe(lab: np.ndarray) -> list[dict]:
    flat = lab.ravel()
    w = lab.shape[1]
    on = np.nonzero(flat < flat.size)[0]
    seeds, group, size = np.unique(flat[on], return_inverse=True, return_counts=True)
    cy = np.bincount(group, on // w) / size if len(on) else []
    cx = np.bincount(group, on % w) / size if len(on) else []
    return [{"seed": int(s), "size": int(c), "cy": float(y), "cx": float(x)}
            for s, c, y, x in zip(seeds, size, cy, cx)]


@F.pandas_udf(ArrayType(COMPONENT))
def _components(it: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for mask, h, w in it:
        out = [None] * len(mask)
        for (hh, ww), at in pd.DataFrame({"h": h, "w": w}).groupby(["h", "w"]).groups.items():
            for block in A.pixel_blocks(mask.index.get_indexer(at), hh * ww, LABELLED):
                stack = np.stack([np.asarray(mask.iloc[i]) > 0 for i in block]).reshape(-1, hh, ww)
                for i, lab in zip(block, label_stack(stack)):
                    out[i] = _describe(lab)
        yield pd.Series(out, dtype=object)
    release()


def with_components(slices: DataFrame, mask: str = "pred", out: str = "components",
                    min_size: int = 1) -> DataFrame:
    """4-connected components of each slice as an array; ``seed`` is the first pixel row-major."""
    found = _components(F.col(mask), F.col("h").cast("int"), F.col("w").cast("int"))
    return slices.withColumn(out, F.filter(found, lambda c: c["size"] >= min_size))


def components(slices: DataFrame, mask: str = "pred", min_size: int = 1) -> DataFrame:
    """One row per component."""
    s = with_components(slices.select("case_id", "z", "h", "w", mask), mask, "_c", min_size)
    return s.select("case_id", "z", F.explode("_c").alias("_c")).select("case_id", "z", "_c.*")


def largest(found):
    """Biggest component of an array; the first one row-major wins a tie."""
    return F.array_max(F.transform(found, lambda c: F.struct(
        c["size"].alias("size"), (-c["seed"]).alias("rank"), c["seed"].alias("seed"), c["cy"].alias("cy"), c["cx"].alias("cx"))))


def centroid_inside(found, box):
    """Whether the biggest component's centroid lies in the inclusive truth box."""
    c = largest(found)
    inside = (c["cy"] >= box["y0"]) & (c["cy"] <= box["y1"]) & (c["cx"] >= box["x0"]) & (c["cx"] <= box["x1"])
    return F.coalesce(inside, F.lit(False))


def centroid_hits(slices: DataFrame, pred: str = "pred", truth: str = "mask", min_size: int = 10) -> DataFrame:
    """Per positive slice: does the biggest predicted blob point into the truth box."""
    s = slices.withColumn("_t", A.bounds(truth, "w")).where(F.col("_t").isNotNull())
    s = with_components(s, pred, "_c", min_size)
    return s.select("case_id", "z", centroid_inside(F.col("_c"), F.col("_t")).alias("hit"))


def false_positives(slices: DataFrame, pred: str = "pred", truth: str = "mask", min_size: int = 10) -> DataFrame:
    """Per case: slices and components predicted on slices without truth."""
    s = with_components(slices.where(~A.any_positive(truth)), pred, "_c", min_size)
    n = F.size("_c").cast("long")
    return s.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_negative_slices"),
                                    F.count_if(n > 0).alias("fp_slices"), F.sum(n).alias("fp_components"))
