"""Queries over slices, boxes and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.functions import arrays as A
from voxtable.functions.hashing import as_unit, order_key
from voxtable.functions.numeric import percent_of, rounded
from voxtable.operators import volumes as V
from voxtable.plans.registry import query
from voxtable.plans.views import boxes3d, r6, slices, study, table, with_views
from voxtable.session import stored

DEPTHS = """, cases AS (SELECT case_id, CAST(count(*) AS INTEGER) AS depth FROM slices GROUP BY case_id)"""
BOX01 = """, b01 AS (
  SELECT case_id, greatest(s0 - 1, 0) AS z0, s1 AS z1, greatest(r0 - 1, 0) AS y0, r1 AS y1,
         greatest(c0 - 1, 0) AS x0, c1 AS x1 FROM boxes3d)"""
PAINTED = BOX01 + """, painted AS (
  SELECT v.*, EXISTS (SELECT 1 FROM b01 b WHERE b.case_id = v.case_id AND v.z >= b.z0 AND v.z < b.z1
     AND v.y >= b.y0 AND v.y < b.y1 AND v.x >= b.x0 AND v.x < b.x1) AS inside FROM voxels v)"""


@query("slice_order", with_views("SELECT case_id, vec_id, z FROM slices", "slices"))
def _(spark, d):
    e = table(spark, d, "embeddings").select(
        F.concat(F.lit("case_"), F.col("label")).alias("case_id"), "vec_id",
        F.col("vec_id").cast("string").alias("instance"))
    return V.order_slices(e, "case_id").select("case_id", "vec_id", "z")


@query("voxel_round_trip", with_views(f"""
SELECT case_id, z, y, x, {r6('v')} AS v FROM voxels""", "voxels"))
def _(spark, d):
    vox = V.to_voxels(slices(spark, d).select("case_id", "z", "h", "w", "pixels"), v="pixels")
    again = V.to_slices(vox, w=8)
    return V.to_voxels(again, v="pixels").select("case_id", "z", "y", "x", rounded("v").alias("v"))


@query("boxes_one_based", with_views(BOX01 + " SELECT * FROM b01", "boxes3d"))
def _(spark, d):
    return V.boxes_from_1based(boxes3d(spark, d))


@query("boxes_with_margin", with_views(DEPTHS + """
SELECT b.case_id, greatest(slice - 2, 0) AS z0, least(slice + 3, depth) AS z1, y AS y0, y + height AS y1,
       x AS x0, x + width AS x1
FROM (SELECT 'case_' || (c_custkey % 10) AS case_id, c_nationkey AS slice, CAST(c_custkey % 97 AS INTEGER) AS x,
             CAST(c_custkey % 89 AS INTEGER) AS y, 10 + c_nationkey % 7 AS width, 8 + c_nationkey % 5 AS height FROM customer) b
JOIN cases USING (case_id)""", "slices"))
def _(spark, d):
    key = F.col("c_custkey")
    b = table(spark, d, "customer").select(
        F.concat(F.lit("case_"), key % 10).alias("case_id"), F.col("c_nationkey").alias("slice"),
        (key % 97).cast("int").alias("x"), (key % 89).cast("int").alias("y"),
        (10 + F.col("c_nationkey") % 7).alias("width"), (8 + F.col("c_nationkey") % 5).alias("height"))
    b = b.join(V.case_table(slices(spark, d)).select("case_id", "depth"), "case_id")
    return V.boxes_from_2d(b, F.col("depth"))


@query("painted_masks", with_views(PAINTED + """
SELECT case_id, z, CAST(count(*) FILTER (inside) AS BIGINT) AS lesion_voxels,
       CAST(coalesce(sum(y * 8 + x) FILTER (inside), 0) AS BIGINT) AS index_sum
FROM painted GROUP BY case_id, z""", "voxels", "boxes3d"))
def _(spark, d):
    s = V.paint_boxes(slices(spark, d), V.boxes_from_1based(boxes3d(spark, d)))
    at = F.transform("mask", lambda m, i: (m * i).cast("long"))
    return s.select("case_id", "z", A.positive_count("mask").alias("lesion_voxels"),
                    A.total(at).cast("long").alias("index_sum"))


@query("voxel_box_range_join", with_views(PAINTED + f"""
SELECT case_id, y, x, count(*) AS n, {r6('sum(v)')} AS v_sum FROM painted WHERE inside GROUP BY case_id, y, x""",
                                          "voxels", "boxes3d"))
def _(spark, d):
    hit = V.pixels_in_boxes(slices(spark, d), V.boxes_from_1based(boxes3d(spark, d)))
    return hit.groupBy("case_id", "y", "x").agg(F.count(F.lit(1)).alias("n"),
                                                rounded(F.sum("v")).alias("v_sum"))


@query("mask_union", with_views(PAINTED + """
SELECT case_id, z, CAST(count(*) FILTER (inside OR (v > 0.15 AND vec_id % 3 = 0)) AS BIGINT) AS union_voxels,
       CAST(count(*) FILTER (inside) AS BIGINT) AS box_voxels
FROM painted GROUP BY case_id, z""", "voxels", "boxes3d"))
def _(spark, d):
    s = V.paint_boxes(study(spark, d), V.boxes_from_1based(boxes3d(spark, d)), out="boxed")
    return s.select("case_id", "z", A.positive_count(A.union_masks("mask", "boxed")).alias("union_voxels"),
                    A.positive_count("boxed").alias("box_voxels"))


@query("phase_subtraction", with_views(f"""
SELECT a.case_id, a.z, a.y, a.x, {r6('greatest(b.v - a.v, 0.0)')} AS v
FROM voxels a JOIN voxels b ON b.case_id = a.case_id AND b.z = a.z + 1 AND b.y = a.y AND b.x = a.x""", "voxels"))
def _(spark, d):
    pre = slices(spark, d).select("case_id", "z", "h", "w", "pixels")
    post = pre.withColumn("z", F.col("z") - 1)
    diff = V.subtract_phases(pre, post)
    return V.to_voxels(diff, v="pixels").select("case_id", "z", "y", "x", rounded("v").alias("v"))


NORM = """, pct AS (
  SELECT case_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM voxels GROUP BY case_id),
clipped AS (SELECT v.*, least(greatest(v, lo), hi) AS c FROM voxels v JOIN pct USING (case_id)),
stats AS (SELECT case_id, avg(c) AS mean, stddev_pop(c) AS std FROM clipped GROUP BY case_id),
normed AS (SELECT k.*, (c - mean) / (std + 1e-8) AS n FROM clipped k JOIN stats USING (case_id))"""


@query("intensity_stats", with_views(NORM + f"""
SELECT case_id, {r6('lo')} AS lo, {r6('hi')} AS hi, {r6('mean')} AS mean, {r6('std')} AS std
FROM pct JOIN stats USING (case_id)""", "voxels"))
def _(spark, d):
    return V.intensity_stats(slices(spark, d)).select(
        "case_id", *[rounded(c).alias(c) for c in ("lo", "hi", "mean", "std")])


@query("intensity_normalise", with_views(NORM + f"""
SELECT case_id, z, y, x, {r6('n')} AS v FROM normed""", "voxels"))
def _(spark, d):
    n = V.normalise_intensity(stored(slices(spark, d).select("case_id", "z", "h", "w", "pixels"), "slices"))
    return V.to_voxels(n, v="pixels").select("case_id", "z", "y", "x", rounded("v").alias("v"))


WINDOW = """, pct AS (
  SELECT {key}, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM voxels GROUP BY {key})
SELECT case_id, z, y, x, CAST(trunc(255 * least(greatest((v - lo) / greatest(hi - lo, 1e-6), 0.0), 1.0)) AS INTEGER) AS shown
FROM voxels JOIN pct USING ({key})"""


@query("display_window_stack", with_views(WINDOW.format(key="case_id"), "voxels"))
def _(spark, d):
    s = V.display_window(slices(spark, d).select("case_id", "z", "h", "w", "pixels")).drop("pixels")
    return V.to_voxels(s, shown="shown")


@query("display_window_slice", with_views(WINDOW.format(key="case_id, z"), "voxels"))
def _(spark, d):
    s = V.display_window(slices(spark, d).select("case_id", "z", "h", "w", "pixels"), per="slice").drop("pixels")
    return V.to_voxels(s, shown="shown")


@query("max_projection", with_views(f"""
SELECT case_id, y, x, {r6('max(v)')} AS v FROM voxels GROUP BY case_id, y, x""", "voxels"))
def _(spark, d):
    return V.mip(slices(spark, d)).select("case_id", "y", "x", rounded("v").alias("v"))


# A window of margin 1 around the voxels above 0.35, which leaves part of the frame out.
ROI = """, hot AS (SELECT *, v > 0.35 AS m FROM voxels),
roi AS (
  SELECT case_id, CAST(coalesce(greatest(min(z) FILTER (m) - 1, 0), 0) AS INTEGER) AS z0,
    CAST(coalesce(least(max(z) FILTER (m) + 2, max(z) + 1), max(z) + 1) AS INTEGER) AS z1,
    CAST(coalesce(greatest(min(y) FILTER (m) - 1, 0), 0) AS INTEGER) AS y0,
    CAST(coalesce(least(max(y) FILTER (m) + 2, 8), 8) AS INTEGER) AS y1,
    CAST(coalesce(greatest(min(x) FILTER (m) - 1, 0), 0) AS INTEGER) AS x0,
    CAST(coalesce(least(max(x) FILTER (m) + 2, 8), 8) AS INTEGER) AS x1 FROM hot GROUP BY case_id)"""


def hot_slices(spark, d):
    return slices(spark, d).select("case_id", "z", "h", "w", "pixels").withColumn("mask", A.above("pixels", 0.35))


@query("roi_window", with_views(ROI + " SELECT * FROM roi", "voxels"))
def _(spark, d):
    return V.roi(hot_slices(spark, d), margin=1)


@query("roi_crop", with_views(ROI + f"""
SELECT case_id, CAST(z - z0 AS INTEGER) AS z, CAST(y - y0 AS INTEGER) AS y, CAST(x - x0 AS INTEGER) AS x,
       z0 AS off_z, y0 AS off_y, x0 AS off_x, {r6('v')} AS v, CAST(m AS INTEGER) AS m
FROM hot JOIN roi USING (case_id) WHERE z >= z0 AND z < z1 AND y >= y0 AND y < y1 AND x >= x0 AND x < x1""", "voxels"))
def _(spark, d):
    c = V.crop_to_roi(hot_slices(spark, d), margin=1)
    return V.to_voxels(c, v="pixels", m="mask").select(
        "case_id", "z", "y", "x", "off_z", "off_y", "off_x", rounded("v").alias("v"), "m")


SLAB = DEPTHS + """, meta AS (
  SELECT case_id, depth, depth // 3 AS centre, 2 AS off_z, 1 AS off_y, 3 AS off_x FROM cases),
cut AS (
  SELECT *, greatest(centre - 12, 0) AS lo, least(centre + 13, depth) AS hi FROM meta)"""


def slab(spark, d, source=slices):
    s = source(spark, d)
    cases = V.case_table(s).select(
        "case_id", "depth", F.floor(F.col("depth") / 3).cast("int").alias("centre"),
        F.lit(2).alias("off_z"), F.lit(1).alias("off_y"), F.lit(3).alias("off_x"))
    return V.cut_slab(s, cases)


@query("slab_cases", with_views(SLAB + """
SELECT case_id, CAST(hi - lo AS INTEGER) AS depth, CAST(off_z + lo AS INTEGER) AS off_z, off_y, off_x,
       CAST(centre - lo AS INTEGER) AS forced_slice, CAST(off_z + depth AS INTEGER) AS source_n_slices FROM cut""", "slices"))
def _(spark, d):
    return slab(spark, d)[1]


@query("slab_slices", with_views(SLAB + """
SELECT case_id, vec_id, CAST(z - lo AS INTEGER) AS z FROM slices JOIN cut USING (case_id) WHERE z >= lo AND z < hi""",
                                 "slices"))
def _(spark, d):
    return slab(spark, d)[0].select("case_id", "vec_id", "z")


@query("slice_strip", with_views(SLAB + """
, vox AS (SELECT v.case_id, z - lo AS z, y, x, v FROM voxels v JOIN cut USING (case_id) WHERE z >= lo AND z < hi),
pct AS (SELECT case_id, quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.99) AS p99 FROM vox GROUP BY case_id),
best AS (SELECT case_id, arg_max(z, v) AS z FROM vox GROUP BY case_id),
rows AS (SELECT * FROM vox UNION ALL SELECT case_id, NULL AS z, y, x, max(v) AS v FROM vox GROUP BY case_id, y, x)
SELECT case_id, CAST(v.z AS INTEGER) AS z, CAST(v.z + off_z + lo AS INTEGER) AS index, CAST(b.z AS INTEGER) AS best_position,
       coalesce(v.z = b.z, false) AS is_best,
       CAST(sum(trunc(255 * least(greatest((v - p1) / greatest(p99 - p1, 1e-6), 0.0), 1.0))) AS BIGINT) AS brightness
FROM rows v JOIN cut USING (case_id) JOIN pct USING (case_id) JOIN best b USING (case_id)
GROUP BY ALL""", "voxels"))
def _(spark, d):
    s, meta = slab(spark, d)
    top = s.groupBy("case_id").agg(F.max_by("z", F.array_max("pixels")).alias("best_slice"))
    best = top.join(meta.select("case_id", "off_z"), "case_id").select(
        "case_id", (F.col("best_slice") + F.col("off_z")).alias("best_slice"))
    strip = V.slice_strip(s, meta, best, project=True)
    return strip.select("case_id", "z", "index", "best_position", "is_best",
                        A.total("shown").cast("long").alias("brightness"))


def resize_sql(n: int) -> str:
    """Each target pixel is the weighted sum of its four neighbours."""
    return f""", axis AS (
  SELECT t, CAST(floor(src) AS INTEGER) AS i0, least(CAST(floor(src) AS INTEGER) + 1, 7) AS i1, src - floor(src) AS f
  FROM (SELECT t, greatest((t + 0.5) * 8 / CAST({n} AS DOUBLE) - 0.5, 0.0) AS src FROM range({n}) r(t)) q),
taps AS (SELECT t, i0 AS i, 1 - f AS wt FROM axis UNION ALL SELECT t, i1, f FROM axis),
resized AS (
  SELECT case_id, z, a.t AS y, b.t AS x, sum(v * a.wt * b.wt) AS v
  FROM voxels s JOIN taps a ON a.i = s.y JOIN taps b ON b.i = s.x GROUP BY ALL)"""


@query("bilinear_resize", with_views(resize_sql(4) + f"""
SELECT case_id, z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {r6('v')} AS v FROM resized""", "voxels"))
def _(spark, d):
    s = V.resize(slices(spark, d).select("case_id", "z", "h", "w", "pixels"), 4)
    return V.to_voxels(s, v="pixels").select("case_id", "z", "y", "x", rounded("v").alias("v"))


@query("bilinear_enlarge", with_views(resize_sql(11) + f"""
SELECT case_id, z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {r6('v')} AS v FROM resized""", "voxels"))
def _(spark, d):
    s = V.resize(slices(spark, d).select("case_id", "z", "h", "w", "pixels"), 11)
    return V.to_voxels(s, v="pixels").select("case_id", "z", "y", "x", rounded("v").alias("v"))


@query("nearest_resize", with_views("""
SELECT s.case_id, s.z, CAST(a.t AS INTEGER) AS y, CAST(b.t AS INTEGER) AS x, s.m
FROM study s JOIN range(5) a(t) ON s.y = (a.t * 8) // 5 JOIN range(5) b(t) ON s.x = (b.t * 8) // 5""", "study"))
def _(spark, d):
    s = V.resize(study(spark, d).select("case_id", "z", "h", "w", "pixels", "mask"), 5)
    return V.to_voxels(s.drop("pixels"), m="mask")


@query("flips", with_views(f"""
SELECT a.case_id, a.z, a.y, a.x, {r6('b.v')} AS flipped_h, {r6('c.v')} AS flipped_v
FROM voxels a JOIN voxels b ON b.case_id = a.case_id AND b.z = a.z AND b.y = a.y AND b.x = 7 - a.x
JOIN voxels c ON c.case_id = a.case_id AND c.z = a.z AND c.y = 7 - a.y AND c.x = a.x""", "voxels"))
def _(spark, d):
    s = slices(spark, d).select("case_id", "z", "h", "w", A.flip_horizontal("pixels", "h", "w").alias("fh"),
                                A.flip_vertical("pixels", "h", "w").alias("fv"))
    return V.to_voxels(s, flipped_h="fh", flipped_v="fv").withColumns(
        {c: rounded(c) for c in ("flipped_h", "flipped_v")})


@query("gamma_jitter", with_views(f""", r AS (
  SELECT case_id, z, min(v) AS lo, greatest(max(v) - min(v), 1e-6) AS span,
         0.8 + 0.45 * (('0x' || substr(md5('11|' || case_id || '|' || z), 1, 7))::BIGINT / CAST(268435456 AS DOUBLE)) AS g
  FROM voxels GROUP BY case_id, z)
SELECT case_id, z, y, x, {r6('pow(least(greatest((v - lo) / span, 0.0), 1.0), g) * span + lo')} AS v
FROM voxels JOIN r USING (case_id, z)""", "voxels"))
def _(spark, d):
    g = 0.8 + 0.45 * as_unit(order_key(11, "case_id", "z"))
    s = slices(spark, d).select("case_id", "z", "h", "w", A.gamma_curve("pixels", g).alias("pixels"))
    return V.to_voxels(s, v="pixels").withColumn("v", rounded("v"))


@query("box_percent", """
SELECT c_custkey, round_even(100.0 * (c_custkey % 97) / CAST(448 AS DOUBLE), 2) AS left_pct,
       round_even(100.0 * (c_custkey % 89) / CAST(448 AS DOUBLE), 2) AS top_pct,
       round_even(100.0 * (10 + c_nationkey % 7) / CAST(448 AS DOUBLE), 2) AS width_pct,
       round_even(100.0 * (8 + c_nationkey % 5) / CAST(448 AS DOUBLE), 2) AS height_pct FROM customer""")
def _(spark, d):
    k, n, side = F.col("c_custkey"), F.col("c_nationkey"), F.lit(448)
    return table(spark, d, "customer").select(
        "c_custkey", percent_of(k % 97, side).alias("left_pct"), percent_of(k % 89, side).alias("top_pct"),
        percent_of(10 + n % 7, side).alias("width_pct"), percent_of(8 + n % 5, side).alias("height_pct"))


@query("thresholds", with_views("""
SELECT case_id, z, count(*) FILTER (prob >= 0.75) AS n_at_least, count(*) FILTER (prob > 0.75) AS n_above
FROM study GROUP BY case_id, z""", "study"))
def _(spark, d):
    return study(spark, d).select(
        "case_id", "z", A.positive_count(A.at_least("prob", 0.75)).alias("n_at_least"),
        A.positive_count(A.above("prob", 0.75)).alias("n_above"))
