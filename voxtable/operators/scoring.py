"""User-supplied array functions over slice rows: scorers and seeded augmentation."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from voxtable.functions import arrays as A
from voxtable.functions.hashing import as_unit, order_key
from voxtable.functions.memory import release

# Ranges of the random changes.
MAX_ROTATION_DEG = 15.0
MAX_SCALE = 0.1
GAMMA = (0.8, 1.25)
FLIP = 0.5


def score_slices(slices: DataFrame, make_scorer: Callable[[], Callable[[np.ndarray], np.ndarray]],
                 out: str = "prob", seconds: str | None = None) -> DataFrame:
    """Probability map of each slice from a user function ``(n, h, w) -> (n, h, w)``.

    ``make_scorer`` runs once per task, so a model is loaded once and not once per slice.  A call gets
    slices of one frame size, as many as fit the pixel budget.  ``seconds`` names a column for the time of the call, dealt
    equally to its slices; loading is not counted.
    """
    times = [StructField(seconds, DoubleType())] if seconds else []
    schema = StructType([*slices.schema.fields, StructField(out, ArrayType(DoubleType())), *times])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make_scorer()
        for batch in batches:
            frames = pd.DataFrame({c: batch.column(c).to_pandas() for c in ("h", "w")})
            for (h, w), rows in frames.groupby(["h", "w"]).groups.items():
                for block in A.pixel_blocks(rows, h * w):
                    part = batch.take(pa.array(block))          # other columns stay as they came
                    stack = np.stack([np.asarray(p, dtype=float) for p in part.column("pixels").to_pandas()]).reshape(-1, h, w)
                    begun = time.perf_counter()
                    maps = np.asarray(score(stack), dtype=float).reshape(len(stack), -1)
                    share = (time.perf_counter() - begun) / len(stack)
                    ends = np.arange(len(maps) + 1, dtype=np.int32) * maps.shape[1]
                    found = [pa.ListArray.from_arrays(pa.array(ends), pa.array(maps.ravel()))]
                    if seconds:
                        found.append(pa.array(np.full(len(maps), share)))
                    yield pa.RecordBatch.from_arrays([*part.columns, *found], names=schema.names)
        release()
    return slices.mapInArrow(run, schema)


def _sample(img: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Values at real coordinates, blending four pixels; outside counts as zero."""
    h, w = img.shape
    pad = np.pad(img, 1)
    y = np.clip(ys + 1, 0, h + 0.999999)
    x = np.clip(xs + 1, 0, w + 0.999999)
    y0, x0 = y.astype(int), x.astype(int)
    fy, fx = y - y0, x - x0
    inside = (ys > -1) & (ys < h) & (xs > -1) & (xs < w)
    return inside * ((1 - fy) * ((1 - fx) * pad[y0, x0] + fx * pad[y0, x0 + 1])
                     + fy * ((1 - fx) * pad[y0 + 1, x0] + fx * pad[y0 + 1, x0 + 1]))


def rotate_scale(img: np.ndarray, mask: np.ndarray, degrees: float, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rotate and scale about the centre in normalised coordinates; the mask stays binary."""
    h, w = img.shape
    gy, gx = np.meshgrid((np.arange(h) + 0.5) * 2 / h - 1, (np.arange(w) + 0.5) * 2 / w - 1, indexing="ij")
    c, s = np.cos(np.radians(degrees)) / scale, np.sin(np.radians(degrees)) / scale
    ys = ((s * gx + c * gy) + 1) * h / 2 - 0.5
    xs = ((c * gx - s * gy) + 1) * w / 2 - 0.5
    yr, xr = np.rint(ys).astype(int), np.rint(xs).astype(int)
    inside = (yr >= 0) & (yr < h) & (xr >= 0) & (xr < w)
    moved = np.where(inside, mask[np.clip(yr, 0, h - 1), np.clip(xr, 0, w - 1)], 0)
    return _sample(img, ys, xs), moved


def augment(slices: DataFrame, seed: int = 0, flips: bool = True, affine: bool = True,
            gamma: bool = True) -> DataFrame:
    """Random flips, rotation with scale, and gamma; ``has_lesion`` is taken from the new mask.

    Every draw hashes ``(seed, case, z)``, so a retried task repeats it.
    """
    def draw(name: str):
        return as_unit(order_key(seed, F.lit(name), "case_id", "z"))
    s = slices
    if flips:
        for name, flip in (("h", A.flip_horizontal), ("v", A.flip_vertical)):
            on = draw(f"flip_{name}") < FLIP
            s = s.withColumns({c: F.when(on, flip(c, "h", "w")).otherwise(F.col(c)) for c in ("pixels", "mask")})
    if affine:
        s = s.withColumns({"_deg": (2 * draw("angle") - 1) * MAX_ROTATION_DEG,
                           "_scale": 1 + (2 * draw("scale") - 1) * MAX_SCALE})
        schema = StructType(s.schema.fields)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                moved = [rotate_scale(np.reshape(p, (h, w)), np.reshape(m, (h, w)), a, k) for p, m, h, w, a, k in
                         zip(pdf["pixels"], pdf["mask"], pdf["h"], pdf["w"], pdf["_deg"], pdf["_scale"])]
                yield pdf.assign(pixels=[i.ravel() for i, _ in moved], mask=[m.ravel() for _, m in moved])
        s = s.mapInPandas(run, schema).drop("_deg", "_scale")
    if gamma:
        s = s.withColumn("pixels", A.gamma_curve("pixels", GAMMA[0] + (GAMMA[1] - GAMMA[0]) * draw("gamma")))
    return s.withColumn("has_lesion", A.any_positive("mask"))
