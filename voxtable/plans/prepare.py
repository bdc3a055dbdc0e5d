"""Volume preparation from catalogued series to masked, normalised slices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from voxtable.functions import arrays as A
from voxtable.operators import volumes as V
from voxtable.operators.catalog import group_phases, pair_phases

Keep = Callable[[DataFrame, str], DataFrame]
SLICE = ["z", "h", "w", "pixels"]


def _outcome(pairs: DataFrame) -> DataFrame:
    return pairs.select("case_id", F.when(F.col("reason").isNull(), "saved").otherwise("skipped").alias("status"),
                        "reason")


def _finish(painted: DataFrame, crop: bool, margin: int) -> DataFrame:
    """Normalise a stored table of painted slices, and cut it by the window of its masks."""
    out = V.normalise_intensity(painted)
    return V.crop_to_roi(out, window=V.roi(painted, margin)) if crop else out


def contrast_pairs(series: DataFrame, slices: DataFrame, boxes3d: DataFrame, post_rank: int = 2) -> DataFrame:
    """Baseline and pass per patient with the first reason that rules the patient out.

    Reasons in order: a phase is missing, no annotation, a phase without slices, phases that differ in shape.
    Pixels are not read here.
    """
    pairs = pair_phases(group_phases(series), post_rank).withColumnRenamed("patient_id", "case_id")
    noted = boxes3d.select("case_id").distinct().withColumn("_noted", F.lit(True))
    shape = slices.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("h"), F.max("w").alias("w"))
    shape = shape.select("folder", F.struct("n", "h", "w").alias("_s"))
    pairs = (pairs.join(noted, "case_id", "left")
             .join(shape.toDF("pre_folder", "_pre"), "pre_folder", "left")
             .join(shape.toDF("post_folder", "_post"), "post_folder", "left"))
    reason = (F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("_noted").isNull(), "no_boxes")
              .when(F.col("_pre").isNull() | F.col("_post").isNull(), "missing_phase")
              .when(~F.col("_pre").eqNullSafe(F.col("_post")), "shape_mismatch"))
    return pairs.select("case_id", "pre_folder", "post_folder", reason.alias("reason"))


def as_planned(df: DataFrame, _: str) -> DataFrame:
    return df


def prepare_contrast(series: DataFrame, slices: DataFrame, boxes3d: DataFrame, post_rank: int = 2, crop: bool = False,
                     margin: int = V.CROP_MARGIN, keep: Keep = as_planned) -> tuple[DataFrame, DataFrame]:
    """Subtract the baseline from the chosen pass, paint the boxes and normalise.

    ``series`` has ``patient_id, description, folder``, ``slices`` has ``folder`` and the slice
    columns, ``boxes3d`` is 1-based inclusive per ``case_id`` (the patient).  Nothing runs here: the result is a plan.
    Its passes over the subtracted slices repeat their joins; ``keep=stored`` writes what several passes read.
    """
    pairs = keep(contrast_pairs(series, slices, boxes3d, post_rank), "pairs")
    good = pairs.where(F.col("reason").isNull())

    def phase(column: str) -> DataFrame:
        key = good.select(F.col(column).alias("folder"), "case_id")
        return slices.select("folder", *SLICE).join(key, "folder").drop("folder")
    diff = V.subtract_phases(phase("pre_folder"), phase("post_folder"))
    painted = keep(V.paint_boxes(diff, V.boxes_from_1based(boxes3d)), "subtracted")
    return _finish(painted, crop, margin), _outcome(pairs)


def annotation_boxes(boxes2d: DataFrame, margin: int = 2) -> DataFrame:
    """Half-open boxes per patient and view, without duplicates; the mark's slice is widened by ``margin`` both ways."""
    b = boxes2d.where(F.col("patient_id").isNotNull() & (F.col("view") != ""))
    b = b.select("patient_id", F.lower("view").alias("view_key"), (F.col("slice") - margin).alias("z0"),
                 (F.col("slice") + margin + 1).alias("z1"), F.col("y").alias("y0"), (F.col("y") + F.col("height")).alias("y1"),
                 F.col("x").alias("x0"), (F.col("x") + F.col("width")).alias("x1"))
    return b.distinct()


def prepare_boxes(slices: DataFrame, boxes2d: DataFrame, margin: int = 2, crop: bool = True,
                  skip_empty: bool = True, crop_margin: int = V.CROP_MARGIN,
                  keep: Keep = as_planned) -> tuple[DataFrame, DataFrame]:
    """Single-phase volumes with masks from 2-D boxes of the same patient and view.

    ``slices`` carry ``case_id`` (the series), ``patient_id`` and ``view_key``.  ``keep`` as in :func:`prepare_contrast`.
    """
    painted = keep(V.paint_boxes(slices, annotation_boxes(boxes2d, margin), on=["patient_id", "view_key"]), "painted")
    cases = painted.groupBy("case_id").agg(F.max(A.any_positive("mask")).alias("_any"))
    reason = F.when(~F.col("_any"), "no_boxes") if skip_empty else F.lit(None).cast("string")
    cases = cases.select("case_id", reason.alias("reason"))
    cases = keep(cases, "cases")
    kept = painted.join(cases.where(F.col("reason").isNull()).select("case_id"), "case_id")
    return _finish(kept, crop, crop_margin), _outcome(cases)
