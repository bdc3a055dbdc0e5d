"""Queries for data-quality rules, sinks and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.functions import arrays as A
from voxtable.operators import quality as Q
from voxtable.plans.registry import query
from voxtable.plans.views import r6, study, table, with_views
from voxtable.session import scratch_path, stored
from voxtable.sources import tables as T
from voxtable.sources import volumes as SV


def faulty(spark, d):
    """Study slices with one kind of fault per case number."""
    s = study(spark, d).select("case_id", "case_no", "z", "h", "w", "pixels", "mask")
    no, z = F.col("case_no"), F.col("z")

    def at_first(a, value):
        return F.transform(a, lambda v, i: F.when(i == 0, value).otherwise(v))
    px = (F.when((no == 0) & (z % 4 == 0), at_first("pixels", F.lit(float("nan"))))
          .when((no == 1) & (z % 5 == 0), at_first("pixels", F.lit(70000.0)))
          .when(no == 2, F.transform("pixels", lambda v: F.lit(0.5))).otherwise(F.col("pixels")))
    mk = (F.when((no == 3) & (z % 6 == 0), at_first("mask", F.lit(7)))
          .when(no == 4, F.transform("mask", lambda v: F.lit(0)))
          .when((no == 5) & (z % 7 == 0), F.slice("mask", 1, 63)).otherwise(F.col("mask")))
    return s.withColumns({"pixels": px, "mask": mk}).withColumn("z", F.when(no == 6, z + 1).otherwise(z))


@query("volume_rules", with_views("""
, d AS (SELECT case_id, case_no, count(*) AS depth, count(*) FILTER (z % 4 = 0) AS q4, count(*) FILTER (z % 5 = 0) AS q5,
        count(*) FILTER (z % 7 = 0) AS q7 FROM slices GROUP BY ALL),
w AS (SELECT *, case_id || ': in-plane size is 8x8, below 128' AS msg FROM d)
SELECT case_id, 'non_finite' AS rule, 'error' AS severity,
  case_id || ': ' || CASE case_no WHEN 0 THEN q4 ELSE q5 END || ' of ' || depth * 64 || ' pixels are no usable numbers' AS message FROM d WHERE case_no IN (0, 1)
UNION ALL SELECT case_id, 'constant', 'warning', case_id || ': all pixels are equal' FROM d WHERE case_no = 2
UNION ALL SELECT case_id, 'in_plane', 'warning', msg FROM w WHERE case_no IN (2, 4) OR case_no > 6
UNION ALL SELECT case_id, 'mask_values', 'error', case_id || ': mask has values other than 0 and 1: [0, 1, 7]' FROM d WHERE case_no = 3
UNION ALL SELECT case_id, 'empty_mask', 'warning', case_id || ': no pixel is marked' FROM d WHERE case_no = 4
UNION ALL SELECT case_id, 'mask_shape', 'error', case_id || ': mask and pixels differ in size on ' || q7 || ' slice(s)' FROM d WHERE case_no = 5
UNION ALL SELECT case_id, 'not_3d', 'error', case_id || ': slices are missing, repeated or differ in shape: (' || depth || ', 8, 8)' FROM d WHERE case_no = 6
""", "slices"))
def _(spark, d):
    return Q.validate_volumes(stored(faulty(spark, d), "faulty"))


SUMMARY = """, sl AS (SELECT case_id, z, sum(m) AS n FROM study GROUP BY case_id, z),
sm AS (SELECT case_id, count(*) AS depth, CAST(sum(n) AS BIGINT) AS lesion_voxels, count(*) FILTER (n > 0) AS lesion_slices,
       round_even(count(*) FILTER (n > 0) / CAST(count(*) AS DOUBLE), 4) AS lesion_slice_fraction FROM sl GROUP BY case_id)"""


@query("volume_summary", with_views(SUMMARY + " SELECT *, 8 AS h, 8 AS w FROM sm", "study"))
def _(spark, d):
    return Q.summarise_volumes(study(spark, d))


@query("volume_sink", with_views("""
, box AS (SELECT case_id, greatest(min(z) - 2, 0) AS z0, least(max(z) + 3, (SELECT max(z) + 1 FROM slices s WHERE s.case_id = study.case_id)) AS z1,
    greatest(min(y) - 2, 0) AS y0, least(max(y) + 3, 8) AS y1, greatest(min(x) - 2, 0) AS x0, least(max(x) + 3, 8) AS x1
  FROM study WHERE m = 1 GROUP BY case_id)
SELECT b.case_id, count(DISTINCT z) AS n_slices, count(*) AS voxels, CAST(sum(m) AS BIGINT) AS lesion_voxels,
  CAST(z0 AS INTEGER) AS off_z, CAST(y0 AS INTEGER) AS off_y, CAST(x0 AS INTEGER) AS off_x
FROM study s JOIN box b ON b.case_id = s.case_id AND z >= z0 AND z < z1 AND y >= y0 AND y < y1 AND x >= x0 AND x < x1
GROUP BY ALL""", "study"))
def _(spark, d):
    path = scratch_path(spark, "volumes")
    s = stored(study(spark, d).select("case_id", "z", "h", "w", "pixels", "mask"), "study")
    SV.write_volumes(s, path, margin=2)
    v = SV.read_volumes(spark, path)
    return v.groupBy("case_id", "off_z", "off_y", "off_x").agg(
        F.count(F.lit(1)).alias("n_slices"), F.sum(F.size("pixels").cast("long")).alias("voxels"),
        F.sum(A.positive_count("mask")).alias("lesion_voxels"))


@query("slice_bank", with_views("""
SELECT s.case_id, s.z, any_value(f.has_lesion) AS has_lesion, CAST(sum(s.m) AS BIGINT) AS bank_voxels
FROM study s JOIN (SELECT case_id, z, bool_or(m = 1) AS has_lesion FROM study GROUP BY case_id, z) f USING (case_id, z)
WHERE s.y % 2 = 0 AND s.x % 2 = 0 GROUP BY s.case_id, s.z""", "study"))
def _(spark, d):
    path = scratch_path(spark, "bank")
    SV.build_slice_bank(study(spark, d), path, ["embeddings"], size=4)
    return SV.read_slice_bank(spark, path).select("case_id", "z", "has_lesion",
                                                  A.positive_count("mask").alias("bank_voxels"))


@query("manifest", with_views(SUMMARY + """
SELECT 'case' AS kind, case_id, depth, lesion_voxels, lesion_slices, lesion_slice_fraction,
       (SELECT count(*) FROM sm) AS n_cases, CAST(0 AS BIGINT) AS n_warnings FROM sm""", "study"))
def _(spark, d):
    path = scratch_path(spark, "prepared")
    warnings = SV.write_volumes(study(spark, d).select("case_id", "z", "h", "w", "pixels", "mask"), path,
                                crop=False).where(F.col("rule") != "in_plane")
    SV.write_manifest(SV.read_volumes(spark, path), path, source=f"{d}/embeddings.parquet",
                      parameters={"crop": False}, root=d, warnings=warnings)
    run, rows = SV.read_manifest(spark, path)
    return rows.select("kind", "case_id", F.get("shape", F.lit(0)).alias("depth"), "lesion_voxels", "lesion_slices",
                       "lesion_slice_fraction", F.lit(run["n_cases"]).cast("long").alias("n_cases"),
                       F.lit(run["n_warnings"]).cast("long").alias("n_warnings"))


# ---- plain tables -----------------------------------------------------------------------

PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


@query("csv_scan", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def _(spark, d):
    path = scratch_path(spark, "csv")
    T.write_csv(table(spark, d, "part"), path)
    return T.read_csv(spark, path, PART)


@query("csv_scan_inferred", "SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def _(spark, d):
    path = scratch_path(spark, "csv")
    T.write_csv(table(spark, d, "part"), path)
    return T.read_csv(spark, path)


@query("pooled_tables", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def _(spark, d):
    """Two halves whose columns come in a different order."""
    p = table(spark, d, "part")
    a, b = scratch_path(spark, "half"), scratch_path(spark, "half")
    T.write_csv(p.where("p_size <= 25"), a)
    T.write_csv(p.where("p_size > 25").select(*reversed(p.columns)), b)
    return T.read_tables(spark, [a, b], PART)


@query("trimmed_header", "SELECT p_partkey, p_name, p_size FROM part")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return T.trim_header(p.toDF(*[f" {c}  " for c in p.columns]))


@query("csv_report", f"""
SELECT o_orderpriority, count(*) AS n, {r6('sum(o_totalprice)', 2)} AS total FROM orders GROUP BY o_orderpriority""")
def _(spark, d):
    path = scratch_path(spark, "report")
    o = table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    T.write_csv(o, path, single_file=True)
    return T.read_csv(spark, path, "o_orderpriority string, n long, total double")


@query("json_report", f"""
SELECT count(*) AS n_orders, {r6('sum(o_totalprice)', 2)} AS total, {r6('max(o_totalprice)', 2)} AS top FROM orders""")
def _(spark, d):
    path = scratch_path(spark, "summary")
    o = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n_orders"),
                                      F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_totalprice").alias("top"))
    T.write_report(o, path)
    return T.read_report(spark, path, "n_orders long, total double, top double")



@query("write_once", "SELECT n_nationkey, n_name FROM nation")
def _(spark, d):
    """The second write finds finished output and leaves it alone."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    path = scratch_path(spark, "once")
    T.write_once(n, path)
    T.write_once(n.withColumn("n_name", F.lit("never written")), path)
    return spark.read.parquet(path)
