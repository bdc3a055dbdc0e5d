"""Whole runs in one call: volumes from catalogued series, and an evaluation with its reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, functions as F

from voxtable.functions import arrays as A
from voxtable.operators import evaluation as E
from voxtable.operators import volumes as V
from voxtable.operators.scoring import score_slices
from voxtable.plans.prepare import prepare_contrast
from voxtable.session import scratch_scope, stored
from voxtable.sources import tables as T
from voxtable.sources import volumes as SV

REPORT, CASES = "eval_report", "eval_per_case"


def run_preparation(series: DataFrame, slices: DataFrame, boxes3d: DataFrame, path: str, source: str, root: str,
                    post_rank: int = 2, crop: bool = False, margin: int = V.CROP_MARGIN, force: bool = False,
                    parameters: Mapping[str, Any] | None = None, revision: str | None = None) -> dict[str, Any]:
    """Prepare, write and describe contrast volumes; returns the run's record.

    A folder whose manifest is there holds a finished run and is left alone unless ``force``.  The manifest comes last, with
    the number of patients left out and the warnings of what was written.
    """
    spark = slices.sparkSession
    finished = None if force else SV.read_manifest(spark, path)
    if finished is not None:
        return finished[0]
    with scratch_scope(spark):
        made, outcome = prepare_contrast(series, slices, boxes3d, post_rank, keep=stored)
        skipped = outcome.where(F.col("status") == "skipped").count()
        warnings = SV.write_volumes(made, path, crop=crop, mode="overwrite", margin=margin)
        record = {"post_rank": post_rank, "crop": crop, **dict(parameters or {}), "skipped": skipped}
        SV.write_manifest(SV.read_volumes(spark, path), path, source, record, root, warnings, revision)
    return SV.read_manifest(spark, path)[0]


def predict_masks(slices: DataFrame, make_scorer: Callable[[], Callable[[np.ndarray], np.ndarray]],
                  threshold: float = 0.5, size: int | None = None) -> DataFrame:
    """``pred`` and ``seconds`` per slice: scored at ``size x size``, judged at the slice's own size."""
    if not size:
        s = score_slices(slices, make_scorer, seconds="seconds")
        return s.withColumn("pred", A.at_least("prob", threshold)).drop("prob")
    own = slices.withColumns({"_h": F.col("h"), "_w": F.col("w"), "_pixels": F.col("pixels"), "_mask": F.col("mask")})
    s = score_slices(V.resize(own, size), make_scorer, seconds="seconds")
    s = s.withColumn("prob", V.bilinear_array("prob", *[F.col(c).cast("int") for c in ("h", "w", "_h", "_w")]))
    s = s.withColumns({"pixels": F.col("_pixels"), "mask": F.col("_mask"), "h": F.col("_h"), "w": F.col("_w")})
    return s.withColumn("pred", A.at_least("prob", threshold)).drop("_h", "_w", "_pixels", "_mask", "prob")


def run_evaluation(slices: DataFrame, make_scorer: Callable[[], Callable[[np.ndarray], np.ndarray]], path: str,
                   threshold: float = 0.5, size: int | None = None, hit_iou: float = 0.1, min_component: int = 10,
                   resamples: int = 10_000, seed: int = 0, about: Mapping[str, str] | None = None) -> DataFrame:
    """Score slices with a truth mask, evaluate their cases, write both reports; returns the cases as written.

    ``eval_per_case`` is a CSV table with the eleven fields of a case, ``eval_report`` one JSON line: what was asked, counts,
    an interval per metric, and times.  Slices are scored once; a table without cases is refused.
    """
    kept = ["case_id", "z", "h", "w", "pixels", "mask"]
    spark = slices.sparkSession
    with scratch_scope(spark):
        predicted = predict_masks(slices.select(*kept), make_scorer, threshold, size)
        cases = stored(E.evaluate_cases(predicted, hit_iou, min_component), "cases")
        if cases.isEmpty():
            raise ValueError("no slices to evaluate")
        T.write_csv(cases.orderBy("case_id"), f"{path}/{CASES}", single_file=True)
        entry = F.struct("metric", F.struct("mean", "lo", "hi", "n"))
        metrics = E.cohort_report(cases, resamples, seed=seed).agg(F.map_from_entries(F.collect_list(entry)).alias("metrics"))
        asked = {"threshold": threshold, "hit_iou": hit_iou, "min_component": min_component, **dict(about or {})}
        report = E.cohort_timing(cases).select(*[F.lit(v).alias(k) for k, v in asked.items()], "*",
                                               metrics.scalar().alias("metrics"))
        T.write_report(report, f"{path}/{REPORT}")
    return T.read_csv(spark, f"{path}/{CASES}", cases.schema)
