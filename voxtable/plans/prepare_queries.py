"""Queries for the two preparation jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.functions import arrays as A
from voxtable.functions.numeric import rounded
from voxtable.plans import prepare as P
from voxtable.plans.registry import query
from voxtable.plans.views import boxes3d, r6, slices, table, with_views
from voxtable.session import stored


def two_phase(spark, d):
    """Every case split into a baseline (even z) and a pass (odd z)."""
    s = slices(spark, d)
    phase = F.when(F.col("z") % 2 == 0, "pre").otherwise("post")
    s = s.select("case_no", F.concat_ws("/", F.col("case_id"), phase).alias("folder"), "h", "w",
                 F.floor(F.col("z") / 2).cast("int").alias("z"), "pixels")
    s = stored(s, "phases")
    no = F.col("case_no")
    series = (table(spark, d, "embeddings").select(F.col("label").alias("case_no")).distinct()
              .withColumn("phase", F.explode(F.array(F.lit("pre"), F.lit("post")))))
    text = (F.when(F.col("phase") == "pre", "ax dyn pre").when(no == 9, "ax t1 tse +c").otherwise("Ph2/ax 3d dyn"))
    case = F.concat(F.lit("case_"), no)
    series = series.select(case.alias("patient_id"), F.concat_ws("/", case, F.col("phase")).alias("folder"),
                           text.alias("description"))
    boxes = boxes3d(spark, d).where(F.col("case_id") != "case_6")
    return series, s, boxes


OUTCOME = """, cnt AS (SELECT case_id, case_no, count(*) AS n FROM slices GROUP BY ALL),
outcome AS (SELECT case_id, CASE WHEN case_no = 9 THEN 'missing_phase' WHEN case_no = 6 THEN 'no_boxes'
  WHEN n % 2 = 1 THEN 'shape_mismatch' END AS reason FROM cnt)"""
DIFF = OUTCOME + """, diff AS (
  SELECT a.case_id, a.z // 2 AS z, a.y, a.x, greatest(b.v - a.v, 0.0) AS v,
    CAST(EXISTS (SELECT 1 FROM boxes3d k WHERE k.case_id = a.case_id AND a.z // 2 >= greatest(s0 - 1, 0) AND a.z // 2 < s1
      AND a.y >= greatest(r0 - 1, 0) AND a.y < r1 AND a.x >= greatest(c0 - 1, 0) AND a.x < c1) AS INTEGER) AS m
  FROM voxels a JOIN voxels b ON a.case_id = b.case_id AND b.z = a.z + 1 AND a.y = b.y AND a.x = b.x
  WHERE a.z % 2 = 0 AND a.case_id IN (SELECT case_id FROM outcome WHERE reason IS NULL))"""
NORMED = """, pct AS (SELECT case_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM {src} GROUP BY case_id),
clp AS (SELECT s.*, least(greatest(v, lo), hi) AS c FROM {src} s JOIN pct USING (case_id)),
st AS (SELECT case_id, avg(c) AS mean, stddev_pop(c) AS sd FROM clp GROUP BY case_id),
nm AS (SELECT clp.*, (c - mean) / (sd + 1e-8) AS n FROM clp JOIN st USING (case_id))"""


@query("contrast_outcome", with_views(OUTCOME + """
SELECT case_id, CASE WHEN reason IS NULL THEN 'saved' ELSE 'skipped' END AS status, reason FROM outcome""", "slices"))
def _(spark, d):
    return P.prepare_contrast(*two_phase(spark, d))[1]


@query("contrast_volumes", with_views(DIFF + NORMED.format(src="diff") + f"""
SELECT case_id, CAST(z AS INTEGER) AS z, {r6('sum(n)')} AS total, {r6('max(n)')} AS top, CAST(sum(m) AS BIGINT) AS lesion_voxels
FROM nm GROUP BY case_id, z""", "voxels", "boxes3d"))
def _(spark, d):
    s = P.prepare_contrast(*two_phase(spark, d))[0]
    return s.select("case_id", "z", rounded(A.total("pixels")).alias("total"),
                    rounded(F.array_max("pixels")).alias("top"), A.positive_count("mask").alias("lesion_voxels"))


def single_phase(spark, d):
    s = slices(spark, d)
    no = F.col("case_no")
    s = s.withColumns({"patient_id": F.concat(F.lit("P"), F.floor(no / 2)),
                       "view_key": F.when(no % 2 == 0, "lcc").otherwise("rmlo")}).drop("case_no", "vec_id")
    s = stored(s, "views")
    b = table(spark, d, "embeddings").select(F.col("label").alias("c")).distinct()
    c = F.col("c")
    patient = F.concat(F.lit("P"), F.floor(c / 2)).alias("patient_id")
    one = b.select(patient, F.when(c % 2 == 0, "LCC").when(c == 5, "rcc").otherwise("RMLO").alias("view"),
                   (3 + c).alias("slice"), (c % 4).alias("x"), (c % 3).alias("y"), F.lit(3).alias("width"), F.lit(2).alias("height"))
    two = b.select(patient, F.lit("LCC").alias("view"), F.lit(20).alias("slice"), F.lit(5).alias("x"),
                   F.lit(5).alias("y"), F.lit(10).alias("width"), F.lit(10).alias("height"))
    return s, one.unionByName(two)


ANNOTATED = """, bx AS (
  SELECT 'P' || c // 2 AS patient, CASE WHEN c % 2 = 0 THEN 'lcc' WHEN c = 5 THEN 'rcc' ELSE 'rmlo' END AS view,
         3 + c AS s, c % 4 AS x, c % 3 AS y, 3 AS w, 2 AS h FROM (SELECT DISTINCT label AS c FROM embeddings)
  UNION SELECT 'P' || c // 2, 'lcc', 20, 5, 5, 10, 10 FROM (SELECT DISTINCT label AS c FROM embeddings)),
vm AS (SELECT v.*, CAST(EXISTS (SELECT 1 FROM bx WHERE patient = 'P' || case_no // 2
    AND view = CASE WHEN case_no % 2 = 0 THEN 'lcc' ELSE 'rmlo' END AND v.z >= greatest(s - 2, 0) AND v.z < s + 3
    AND v.y >= bx.y AND v.y < bx.y + h AND v.x >= bx.x AND v.x < bx.x + w) AS INTEGER) AS m FROM voxels v),
keep AS (SELECT case_id FROM vm GROUP BY case_id HAVING sum(m) > 0),
src AS (SELECT vm.* FROM vm JOIN keep USING (case_id))"""


@query("annotated_volumes", with_views(ANNOTATED + NORMED.format(src="src") + f""",
win AS (SELECT case_id, greatest(min(z) FILTER (m = 1) - 1, 0) AS z0, max(z) FILTER (m = 1) + 1 AS z1,
  greatest(min(y) FILTER (m = 1) - 1, 0) AS y0, max(y) FILTER (m = 1) + 1 AS y1,
  greatest(min(x) FILTER (m = 1) - 1, 0) AS x0, max(x) FILTER (m = 1) + 1 AS x1 FROM src GROUP BY case_id)
SELECT case_id, CAST(z - z0 AS INTEGER) AS z, CAST(z0 AS INTEGER) AS off_z, CAST(y0 AS INTEGER) AS off_y, CAST(x0 AS INTEGER) AS off_x,
  {r6('sum(n)')} AS total, count(*) AS n_pixels, CAST(sum(m) AS BIGINT) AS lesion_voxels
FROM nm JOIN win USING (case_id) WHERE z BETWEEN z0 AND z1 AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1
GROUP BY ALL""", "voxels"))
def _(spark, d):
    s = P.prepare_boxes(*single_phase(spark, d), crop_margin=1)[0]
    return s.select("case_id", "z", "off_z", "off_y", "off_x", rounded(A.total("pixels")).alias("total"),
                    F.size("pixels").cast("long").alias("n_pixels"), A.positive_count("mask").alias("lesion_voxels"))


@query("annotated_outcome", with_views(ANNOTATED + """
SELECT case_id, CASE WHEN sum(m) > 0 THEN 'saved' ELSE 'skipped' END AS status,
       CASE WHEN sum(m) > 0 THEN NULL ELSE 'no_boxes' END AS reason FROM vm GROUP BY case_id""", "voxels"))
def _(spark, d):
    return P.prepare_boxes(*single_phase(spark, d))[1]
