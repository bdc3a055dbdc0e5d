"""Queries for whole runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from voxtable.functions.numeric import rounded
from voxtable.operators import volumes as V
from voxtable.plans import prepare_queries as Q
from voxtable.plans import runs as R
from voxtable.plans.evaluation_queries import BOOT, CASES, LONG, recursive
from voxtable.plans.registry import query
from voxtable.plans.views import r6, slices, study, with_views
from voxtable.plans.volume_queries import DEPTHS
from voxtable.session import scratch_path
from voxtable.sources import tables as T
from voxtable.sources import volumes as SV

LEVEL = 0.97
#: The study with the prediction of the run's scorer instead of its own.
SCORED = f""", scored AS (
  SELECT * REPLACE (CASE WHEN 1.0 / (1.0 + exp(-30.0 * v)) >= {LEVEL} THEN 1 ELSE 0 END AS p) FROM study)"""
SCORED_CASES = SCORED + CASES.replace("FROM study", "FROM scored")


def sigmoid_scorer():
    return lambda stack: 1.0 / (1.0 + np.exp(-30.0 * stack))


def evaluated(spark, d):
    """The cases of a run, and where its reports are."""
    path = scratch_path(spark, "evaluation")
    return R.run_evaluation(study(spark, d), sigmoid_scorer, path, threshold=LEVEL, min_component=3, resamples=2000), path


@query("evaluation_run_cases", recursive(SCORED_CASES + f"""
SELECT case_id, n_slices, n_positive_slices, n_negative_slices, {r6('dice')} AS dice, {r6('iou')} AS iou,
       {r6('sensitivity_iou')} AS sensitivity_iou, {r6('sensitivity_centroid')} AS sensitivity_centroid, fp_slices, fp_components,
       true AS timed FROM ev""", "study"))
def _(spark, d):
    """The CSV that the run wrote."""
    c = evaluated(spark, d)[0]
    return c.withColumns({m: rounded(m) for m in ("dice", "iou", "sensitivity_iou", "sensitivity_centroid")}).withColumn(
        "timed", F.col("seconds") > 0).drop("seconds")


_BOOT = BOOT.format(long=LONG, seed=0, reps=2000)
_LAST = _BOOT.rindex("SELECT metric,")


@query("evaluation_run_report", recursive(SCORED_CASES + ", " + _BOOT[:_LAST] + f"""
SELECT b.*, CAST({LEVEL} AS DOUBLE) AS threshold, (SELECT count(*) FROM ev) AS n_patients,
       (SELECT CAST(sum(n_slices) AS BIGINT) FROM ev) AS n_slices FROM ({_BOOT[_LAST:]}) b""", "study"))
def _(spark, d):
    """The JSON report that the run wrote, a row per metric."""
    r = T.read_report(spark, f"{evaluated(spark, d)[1]}/{R.REPORT}",
                      "threshold double, n_patients long, n_slices long, "
                      "metrics map<string, struct<mean: double, lo: double, hi: double, n: long>>")
    r = r.select("threshold", "n_patients", "n_slices", F.explode("metrics").alias("metric", "m"))
    return r.select("metric", "threshold", "n_patients", "n_slices", *[rounded(F.col(f"m.{c}")).alias(c) for c in ("mean", "lo", "hi")], "m.n")


@query("preparation_run", with_views(Q.DIFF + """,
sl AS (SELECT case_id, z, sum(m) AS n FROM diff GROUP BY case_id, z)
SELECT case_id, count(*) AS depth, CAST(sum(n) AS BIGINT) AS lesion_voxels, count(*) FILTER (n > 0) AS lesion_slices,
  (SELECT count(*) FROM outcome WHERE reason IS NULL) AS n_cases, (SELECT count(*) FROM outcome WHERE reason IS NOT NULL) AS skipped,
  (SELECT count(*) FROM outcome WHERE reason IS NULL)
    + (SELECT count(*) FROM (SELECT case_id FROM sl GROUP BY case_id HAVING sum(n) = 0)) AS n_warnings
FROM sl GROUP BY case_id""", "voxels", "boxes3d"))
def _(spark, d):
    """Two calls: the second one finds a finished run."""
    path = scratch_path(spark, "run")
    for _run in range(2):
        run = R.run_preparation(*Q.two_phase(spark, d), path, source=f"{d}/embeddings.parquet", root=d)
    rows = SV.read_manifest(spark, path)[1].where("kind = 'case'")
    return rows.select("case_id", F.get("shape", F.lit(0)).alias("depth"), "lesion_voxels", "lesion_slices",
                       F.lit(run["n_cases"]).cast("long").alias("n_cases"),
                       F.lit(run["parameters"]["skipped"]).cast("long").alias("skipped"),
                       F.lit(run["n_warnings"]).cast("long").alias("n_warnings"))


@query("pinned_cases", with_views(DEPTHS + """
SELECT c.case_id, c.depth, CAST(c.depth // 3 AS INTEGER) AS forced_slice, count(*) AS n_slices
FROM cases c JOIN slices s USING (case_id) GROUP BY ALL""", "slices"))
def _(spark, d):
    """Pinned without cutting: every slice stays."""
    s = slices(spark, d)
    cases = V.case_table(s).select("case_id", "depth", F.floor(F.col("depth") / 3).cast("int").alias("centre"))
    whole, pinned = V.cut_slab(s, cases, slim=False)
    n = whole.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_slices"))
    return pinned.join(n, "case_id").select("case_id", "depth", "forced_slice", "n_slices")
