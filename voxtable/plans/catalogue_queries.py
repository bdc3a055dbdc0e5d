"""Queries over the series catalogue, annotations and file names."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.functions import text as T
from voxtable.operators import catalog as C
from voxtable.plans.registry import query
from voxtable.plans.views import boxes2d, headers, series, table, with_views

ROOT = "/data/site"


def stored(spark, d):
    """Series already on disk: the ones whose number appears as a part key."""
    return table(spark, d, "part").select(F.concat(F.lit("S"), F.col("p_partkey")).alias("series_uid"))


@query("text_filter", with_views("""
SELECT series_uid, patient_id, description FROM series
WHERE contains(lower(coalesce(description, '')), 'dyn')""", "series"))
def _(spark, d):
    return (series(spark, d).where(T.contains_text("description", "DYN"))
            .select("series_uid", "patient_id", "description"))


@query("modality_membership", with_views("""
SELECT modality, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM series
WHERE modality IN ('SEG', 'RTSTRUCT') GROUP BY modality""", "series"))
def _(spark, d):
    return (series(spark, d).where(F.col("modality").isin(list(C.SEGMENTATION_MODALITIES)))
            .groupBy("modality").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes")))


@query("skip_existing", with_views("""
SELECT series_uid, patient_id, size_bytes FROM series s
WHERE NOT EXISTS (SELECT 1 FROM part p WHERE 'S' || p.p_partkey = s.series_uid)""", "series"))
def _(spark, d):
    return (C.not_existing(series(spark, d), stored(spark, d))
            .select("series_uid", "patient_id", "size_bytes"))


@query("annotated_series", with_views("""
SELECT series_uid, patient_id FROM series s
WHERE EXISTS (SELECT 1 FROM boxes2d b WHERE b.patient_id = s.patient_id)""", "series", "boxes2d"))
def _(spark, d):
    return C.annotated_only(series(spark, d), boxes2d(spark, d)).select("series_uid", "patient_id")


@query("study_segmentations", with_views("""
SELECT g.series_uid, g.study_uid, g.modality FROM series g
WHERE g.modality IN ('SEG', 'RTSTRUCT')
  AND g.study_uid IN (SELECT study_uid FROM series WHERE modality = 'MR' AND description IS NOT NULL)
  AND g.series_uid NOT IN (SELECT 'S' || p_partkey FROM part)""", "series"))
def _(spark, d):
    s = series(spark, d)
    have = s.where((F.col("modality") == "MR") & F.col("description").isNotNull())
    return (C.segmentations_of(s, have, stored(spark, d))
            .select("series_uid", "study_uid", "modality"))


@query("view_keys", with_views("SELECT series_no, patient_id, view_key FROM headers", "headers"))
def _(spark, d):
    return keyed_headers(spark, d).select("series_no", "patient_id", "view_key")


def keyed_headers(spark, d):
    h = headers(spark, d)
    return h.withColumn("view_key", T.view_key(
        "image_laterality", "laterality", T.nested_frame_laterality("shared_groups"), "view_position"))


BOX_MATCH = """
SELECT h.series_no, h.patient_id, h.view_key, count(b.patient_id) AS n_boxes{extra}
FROM headers h {kind} JOIN boxes2d b
  ON b.patient_id = h.patient_id AND lower(b.view) = h.view_key AND h.view_key <> ''
GROUP BY h.series_no, h.patient_id, h.view_key"""


@query("series_box_match", with_views(BOX_MATCH.format(kind="", extra="""
   , min(b.slice) AS first_slice, max(b.slice) AS last_slice,
   CAST(sum(b.width * b.height) AS BIGINT) AS box_area"""), "headers", "boxes2d"))
def _(spark, d):
    return C.match_boxes(keyed_headers(spark, d), boxes2d(spark, d)).select(
        "series_no", "patient_id", "view_key", "n_boxes", "first_slice", "last_slice", "box_area")


@query("series_box_match_keep_empty", with_views(BOX_MATCH.format(kind="LEFT", extra=""),
                                                 "headers", "boxes2d"))
def _(spark, d):
    return C.match_boxes(keyed_headers(spark, d), boxes2d(spark, d), skip_empty=False).select(
        "series_no", "patient_id", "view_key", "n_boxes")


@query("patient_ids", "SELECT DISTINCT 'P' || user_id AS patient_id FROM events")
def _(spark, d):
    return series(spark, d).select("patient_id").distinct()


RANKED = """, ranked AS (
  SELECT *, CASE WHEN regexp_matches(lower(coalesce(description, '')), '\\bph\\s*(\\d)\\b')
       THEN CAST(regexp_extract(lower(description), '\\bph\\s*(\\d)\\b', 1) AS INTEGER)
     WHEN lower(description) LIKE '%1st%' THEN 1 WHEN lower(description) LIKE '%2nd%' THEN 2
     WHEN lower(description) LIKE '%3rd%' THEN 3 WHEN lower(description) LIKE '%4th%' THEN 4
     WHEN lower(description) LIKE '%pre%' THEN 0 WHEN lower(description) LIKE '%dyn%' THEN 0 END AS rank
  FROM series)"""


@query("phase_rank", with_views(RANKED + """
SELECT series_uid, description, coalesce(rank, -1) AS rank FROM ranked""", "series"))
def _(spark, d):
    return series(spark, d).select("series_uid", "description",
                                   F.coalesce(T.phase_rank("description"), F.lit(-1)).alias("rank"))


@query("phase_groups", with_views(RANKED + """
SELECT patient_id, rank, max(folder) AS folder FROM ranked WHERE rank IS NOT NULL
GROUP BY patient_id, rank""", "series"))
def _(spark, d):
    maps = C.phase_map(C.group_phases(series(spark, d)))
    return maps.select("patient_id", F.explode("phases").alias("rank", "folder"))


@query("phase_pairs", with_views(RANKED + """
SELECT patient_id, max(folder) FILTER (rank = 0) AS pre_folder, max(folder) FILTER (rank = 2) AS post_folder,
       CASE WHEN count(*) FILTER (rank = 0) = 0 OR count(*) FILTER (rank = 2) = 0 THEN 'missing_phase' END AS reason
FROM ranked WHERE rank IS NOT NULL GROUP BY patient_id""", "series"))
def _(spark, d):
    return C.pair_phases(C.group_phases(series(spark, d)), post_rank=2)


@query("first_patients_by_appearance", """
SELECT 'P' || user_id AS patient_id FROM events GROUP BY user_id ORDER BY min(event_id), 1 LIMIT 20""")
def _(spark, d):
    return C.first_patients(series(spark, d), 20, "series_no")


@query("first_patients_by_id", """
SELECT DISTINCT 'P' || user_id AS patient_id FROM events ORDER BY 1 LIMIT 20""")
def _(spark, d):
    return C.first_patients(series(spark, d), 20)


@query("budgeted_selection", """
SELECT o_orderkey, size_bytes FROM (
  SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS size_bytes,
         coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (
           ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM orders) q WHERE 5000000 + used < 200000000000""")
def _(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("size_bytes"))
    return C.within_budget(o, "o_orderkey", "size_bytes", 200_000_000_000, used_bytes=5_000_000)


@query("series_selection", with_views("""
, cand AS (
  SELECT s.* FROM series s
  WHERE contains(lower(coalesce(description, '')), 'dyn')
    AND patient_id IN (SELECT patient_id FROM boxes2d)
    AND patient_id IN (SELECT DISTINCT patient_id FROM boxes2d ORDER BY patient_id LIMIT 40)
    AND series_uid NOT IN (SELECT 'S' || p_partkey FROM part)),
run AS (
  SELECT *, coalesce(sum(size_bytes) OVER (ORDER BY series_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM cand)
SELECT series_uid, patient_id, size_bytes FROM run WHERE used < 20000000 ORDER BY series_no LIMIT 300""",
                                      "series", "boxes2d"))
def _(spark, d):
    return C.select_series(
        series(spark, d), existing=stored(spark, d), boxes=boxes2d(spark, d), text="dyn",
        max_bytes=20_000_000, max_rows=300, max_patients=40,
    ).select("series_uid", "patient_id", "size_bytes")


NAMES = """names AS (
  SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'SOB_B_TA-14-4659.png' ELSE
    'SOB_' || CASE WHEN p_size <= 25 THEN 'B' ELSE 'M' END || '_' || substr(p_type, 1, 2) || '-' || p_size || '-'
    || p_partkey || '-' || CASE p_partkey % 4 WHEN 0 THEN 40 WHEN 1 THEN 100 WHEN 2 THEN 200 ELSE 400 END
    || '-' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || '.png' END AS name FROM part),
parsed AS (
  SELECT p_partkey, name, split_part(split_part(name, '-', 1), '_', 3) AS tumor_type,
    split_part(name, '-', 2) AS patient_id, split_part(name, '-', 3) AS image_id,
    split_part(name, '-', 4) AS magnification, replace(split_part(name, '-', 5), '.png', '') AS image_number,
    split_part(name, '_', 2) = 'B' AS is_benign
  FROM names WHERE split_part(name, '-', 5) <> '')"""


def histology_names(spark, d):
    k = F.col("p_partkey")
    full = F.concat(
        F.lit("SOB_"), F.when(F.col("p_size") <= 25, "B").otherwise("M"), F.lit("_"),
        F.substring("p_type", 1, 2), F.lit("-"), F.col("p_size"), F.lit("-"), k, F.lit("-"),
        F.element_at(F.array(F.lit(40), F.lit(100), F.lit(200), F.lit(400)), (k % 4 + 1).cast("int")),
        F.lit("-"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(".png"))
    return table(spark, d, "part").select(
        "p_partkey", F.when(k % 13 == 0, "SOB_B_TA-14-4659.png").otherwise(full).alias("name"))


@query("histology_names", "WITH " + NAMES + " SELECT * FROM parsed")
def _(spark, d):
    return C.image_catalogue(histology_names(spark, d))


@query("catalogue_summary", "WITH " + NAMES + """
SELECT count(*) AS n_images, count(*) FILTER (is_benign) AS n_benign, count(*) FILTER (NOT is_benign) AS n_malignant,
       count(DISTINCT tumor_type) AS n_tumor_types, count(DISTINCT patient_id) AS n_patients FROM parsed""")
def _(spark, d):
    return C.catalogue_summary(C.image_catalogue(histology_names(spark, d)))


PATHS = f"""paths AS (
  SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '{ROOT}/' ELSE '/elsewhere/' END
         || regexp_replace(url, '^https?://', '') AS path FROM pages)"""


def page_paths(spark, d):
    base = F.when(F.col("page_id") % 2 == 0, ROOT + "/").otherwise("/elsewhere/")
    return table(spark, d, "pages").select(
        "page_id", F.concat(base, F.regexp_replace("url", "^https?://", "")).alias("path"))


@query("path_scrub", f"WITH {PATHS} SELECT page_id, regexp_replace(path, '^{ROOT}/', '') AS path FROM paths")
def _(spark, d):
    return page_paths(spark, d).withColumn("path", T.scrub_path("path", ROOT))


@query("case_keys", f"""WITH {PATHS}
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'case_' || page_id
  ELSE regexp_replace(regexp_replace(path, '^.*/', ''), '(.*)\\.[^.]*$', '\\1') END AS case_id FROM paths""")
def _(spark, d):
    stored_id = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("case_"), F.col("page_id"))) \
        .when(F.col("page_id") % 3 == 1, "")
    return page_paths(spark, d).select("page_id", T.case_key(stored_id, "path").alias("case_id"))
