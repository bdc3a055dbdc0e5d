"""Queries over predictions: overlap, components, case and cohort evaluation, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.functions import arrays as A
from voxtable.functions.numeric import rounded
from voxtable.operators import components as K
from voxtable.operators import evaluation as E
from voxtable.operators import overlap as O
from voxtable.operators import tiles as T
from voxtable.operators import volumes as V
from voxtable.plans.registry import query
from voxtable.plans.views import predictions, r6, slices, study, table, with_views
from voxtable.plans.volume_queries import NORM, resize_sql
from voxtable.session import stored

MASSES = """, sl AS (
  SELECT case_id, case_no, z, vec_id, CAST(sum(p * m) AS DOUBLE) AS i, CAST(sum(p) AS DOUBLE) AS ps, CAST(sum(m) AS DOUBLE) AS ts
  FROM study GROUP BY ALL)"""
SOFT = """, sl AS (
  SELECT case_id, z, sum(prob * m) AS i, sum(prob) AS ps, CAST(sum(m) AS DOUBLE) AS ts FROM study GROUP BY ALL)"""
DICE_S, IOU_S = "(2 * i + 1e-6) / (ps + ts + 1e-6)", "(i + 1e-6) / (ps + ts - i + 1e-6)"
DICE_P = "CASE WHEN ps + ts > 0 THEN 2 * i / (ps + ts) ELSE 0.0 END"
IOU_P = "CASE WHEN ps + ts - i > 0 THEN i / (ps + ts - i) ELSE 0.0 END"


def rounded_all(df, *names):
    return df.withColumns({n: rounded(n) for n in names})


@query("localisation_report", with_views(NORM + f""",
hit AS (SELECT case_id, z, y, x, CASE WHEN n > 1.0 THEN 1 ELSE 0 END AS p,
               CASE WHEN v > 0.15 AND vec_id % 3 = 0 THEN 1 ELSE 0 END AS m FROM normed),
sl AS (SELECT case_id, z, CAST(sum(p * m) AS DOUBLE) AS i, CAST(sum(p) AS DOUBLE) AS ps, CAST(sum(m) AS DOUBLE) AS ts,
       (max(x) FILTER (p = 1) - min(x) FILTER (p = 1) + 1) * (max(y) FILTER (p = 1) - min(y) FILTER (p = 1) + 1) AS area
  FROM hit GROUP BY case_id, z)
SELECT case_id, count(*) AS n_slices, count(*) FILTER (ts > 0) AS n_positive,
       {r6(f'avg({DICE_P}) FILTER (ts > 0)')} AS dice, {r6(f'avg({IOU_P}) FILTER (ts > 0)')} AS iou,
       {r6('avg(area)')} AS mean_box_area
FROM sl GROUP BY case_id""", "voxels"))
def _(spark, d):
    s = stored(study(spark, d).select("case_id", "z", "h", "w", "pixels", "mask"), "study")
    s = V.normalise_intensity(s).withColumn("pred", A.above("pixels", 1.0))
    s = O.plain_overlap(s).withColumn("_b", A.bounds("pred", "w"))
    area = (F.col("_b.x1") - F.col("_b.x0") + 1) * (F.col("_b.y1") - F.col("_b.y0") + 1)
    pos = F.col("t_sum") > 0
    return s.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_slices"), F.count_if(pos).alias("n_positive"),
        rounded(F.avg(F.when(pos, F.col("dice")))).alias("dice"),
        rounded(F.avg(F.when(pos, F.col("iou")))).alias("iou"), rounded(F.avg(area)).alias("mean_box_area"))


@query("overlap_smooth", with_views(MASSES + f"""
SELECT case_id, z, {r6(DICE_S)} AS dice, {r6(IOU_S)} AS iou FROM sl""", "study"))
def _(spark, d):
    return rounded_all(O.overlap(study(spark, d)).select("case_id", "z", "dice", "iou"), "dice", "iou")


@query("overlap_plain", with_views(MASSES + f"""
SELECT case_id, z, {r6(DICE_P)} AS dice, {r6(IOU_P)} AS iou, {IOU_P} >= 0.1 AS hit FROM sl""", "study"))
def _(spark, d):
    s = O.plain_overlap(study(spark, d)).select("case_id", "z", "dice", "iou", (F.col("iou") >= 0.1).alias("hit"))
    return rounded_all(s, "dice", "iou")


POOLED = f"""
SELECT {{by}}{r6(f'sum({DICE_S})')} AS dice_sum, {r6(f'sum({IOU_S})')} AS iou_sum, count(*) AS count,
       {r6(f'avg({DICE_S})')} AS dice, {r6(f'avg({IOU_S})')} AS iou FROM sl {{where}} {{group}}"""
POOLED_COLS = ("dice_sum", "iou_sum", "dice", "iou")


@query("pooled_scores", with_views(MASSES + POOLED.format(by="", where="WHERE ts > 0", group=""), "study"))
def _(spark, d):
    parts = O.pooled_scores(study(spark, d), by=["case_id"])
    return rounded_all(O.merge_scores(parts), *POOLED_COLS)


@query("pooled_scores_with_empty", with_views(MASSES + POOLED.format(
    by="case_id, ", where="", group="GROUP BY case_id"), "study"))
def _(spark, d):
    return rounded_all(O.pooled_scores(study(spark, d), by=["case_id"], ignore_empty=False), *POOLED_COLS)


@query("micro_macro_mean", with_views(MASSES + f""",
per AS (SELECT case_id, avg({DICE_P}) AS dice, avg({IOU_P}) AS iou FROM sl WHERE ts > 0 GROUP BY case_id)
SELECT {r6(f'avg({DICE_P})')} AS dice_micro, {r6(f'avg({IOU_P})')} AS iou_micro,
       (SELECT {r6('avg(dice)')} FROM per) AS dice_macro, (SELECT {r6('avg(iou)')} FROM per) AS iou_macro
FROM sl WHERE ts > 0""", "study"))
def _(spark, d):
    return rounded_all(E.micro_macro(study(spark, d)), "dice_micro", "iou_micro", "dice_macro", "iou_macro")


@query("tversky", with_views(SOFT + f""",
t AS (SELECT case_id, avg((i + 1e-6) / (i + 0.3 * (ps - i) + 0.7 * (ts - i) + 1e-6)) AS tv FROM sl GROUP BY case_id)
SELECT case_id, {r6('tv')} AS tversky, {r6('pow(greatest(1 - tv, 1e-6), 0.75)')} AS focal_tversky FROM t""", "study"))
def _(spark, d):
    return rounded_all(O.tversky(study(spark, d), by=["case_id"]), "tversky", "focal_tversky")


@query("soft_losses", with_views(SOFT + f""",
b AS (SELECT case_id, avg(greatest(10 * v, 0.0) - 10 * v * m + ln(1 + exp(-abs(10 * v)))) AS bce FROM study GROUP BY case_id),
q AS (SELECT case_id, avg({DICE_S}) AS soft_dice FROM sl GROUP BY case_id)
SELECT case_id, {r6('bce')} AS bce, {r6('soft_dice')} AS soft_dice,
       {r6('0.5 * bce + 0.5 * (1 - soft_dice)')} AS loss FROM b JOIN q USING (case_id)""", "study"))
def _(spark, d):
    s = study(spark, d).withColumn("logit", F.transform("pixels", lambda v: v * 10.0))
    return rounded_all(O.soft_losses(s, by=["case_id"]), "bce", "soft_dice", "loss")


@query("box_xywh", with_views("""
SELECT case_id, z, min(x) AS x, min(y) AS y, CAST(max(x) - min(x) + 1 AS INTEGER) AS w,
       CAST(max(y) - min(y) + 1 AS INTEGER) AS h FROM study WHERE m = 1 GROUP BY case_id, z""", "study"))
def _(spark, d):
    return O.bounding_box(study(spark, d))


@query("box_corners", with_views("""
SELECT case_id, z, min(y) AS r0, min(x) AS c0, max(y) AS r1, max(x) AS c1
FROM study WHERE p = 1 GROUP BY case_id, z""", "study"))
def _(spark, d):
    return O.bounding_box(study(spark, d), mask="pred", style="corners")


COMPONENTS = """, px AS (SELECT case_id, z, y * 8 + x AS i, y, x FROM study WHERE p = 1),
reach(case_id, z, i, s) AS (
  SELECT case_id, z, i, i FROM px
  UNION
  SELECT b.case_id, b.z, b.i, r.s FROM reach r
  JOIN px a ON a.case_id = r.case_id AND a.z = r.z AND a.i = r.i
  JOIN px b ON b.case_id = a.case_id AND b.z = a.z AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
lab AS (SELECT case_id, z, i, min(s) AS seed FROM reach GROUP BY case_id, z, i),
comps AS (
  SELECT case_id, z, seed, CAST(count(*) AS INTEGER) AS size, avg(i // 8) AS cy, avg(i % 8) AS cx
  FROM lab GROUP BY case_id, z, seed)"""


def recursive(body: str, *names: str) -> str:
    return with_views(body, *names).replace("WITH ", "WITH RECURSIVE ", 1)


@query("components", recursive(COMPONENTS + f"""
SELECT case_id, z, seed, size, {r6('cy')} AS cy, {r6('cx')} AS cx FROM comps WHERE size >= 2""", "study"))
def _(spark, d):
    return rounded_all(K.components(study(spark, d), min_size=2), "cy", "cx")


@query("components_tiled", recursive(COMPONENTS + f"""
SELECT case_id, z, CAST(seed AS BIGINT) AS seed, CAST(size AS BIGINT) AS size, {r6('cy')} AS cy, {r6('cx')} AS cx FROM comps""",
                                     "study"))
def _(spark, d):
    tiles = T.cut_tiles(study(spark, d), tile=(3, 2))
    return rounded_all(T.tiled_components(tiles), "cy", "cx")


TARGET = """, target AS (SELECT case_id, z, min(y) AS r0, max(y) AS r1, min(x) AS c0, max(x) AS c1
  FROM study WHERE m = 1 GROUP BY case_id, z),
big AS (SELECT *, row_number() OVER (PARTITION BY case_id, z ORDER BY size DESC, seed) AS rn FROM comps WHERE size >= 3),
centre AS (
  SELECT t.case_id, t.z, coalesce(b.cy BETWEEN r0 AND r1 AND b.cx BETWEEN c0 AND c1, false) AS hit
  FROM target t LEFT JOIN big b ON b.case_id = t.case_id AND b.z = t.z AND b.rn = 1)"""


@query("centroid_hits", recursive(COMPONENTS + TARGET + " SELECT * FROM centre", "study"))
def _(spark, d):
    return K.centroid_hits(study(spark, d), min_size=3)


@query("false_positives", recursive(COMPONENTS + """,
neg AS (SELECT case_id, z FROM study GROUP BY case_id, z HAVING sum(m) = 0),
n AS (SELECT g.case_id, g.z, count(c.seed) AS k FROM neg g LEFT JOIN comps c ON c.case_id = g.case_id AND c.z = g.z AND c.size >= 3
  GROUP BY g.case_id, g.z)
SELECT case_id, count(*) AS n_negative_slices, count(*) FILTER (k > 0) AS fp_slices, CAST(sum(k) AS BIGINT) AS fp_components
FROM n GROUP BY case_id""", "study"))
def _(spark, d):
    return K.false_positives(study(spark, d), min_size=3)


CASES = COMPONENTS + TARGET + MASSES + f""", kc AS (
  SELECT s.case_id, s.z, count(c.seed) AS k FROM sl s LEFT JOIN comps c ON c.case_id = s.case_id AND c.z = s.z AND c.size >= 3
  GROUP BY s.case_id, s.z),
ev AS (
  SELECT s.case_id, any_value(case_no) AS case_no, count(*) AS n_slices, count(*) FILTER (ts > 0) AS n_positive_slices,
    count(*) FILTER (ts = 0) AS n_negative_slices,
    avg({DICE_P}) FILTER (ts > 0) AS dice, avg({IOU_P}) FILTER (ts > 0) AS iou,
    avg(CASE WHEN {IOU_P} >= 0.1 THEN 1.0 ELSE 0.0 END) FILTER (ts > 0) AS sensitivity_iou,
    avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (ts > 0) AS sensitivity_centroid,
    count(*) FILTER (ts = 0 AND k > 0) AS fp_slices, CAST(coalesce(sum(k) FILTER (ts = 0), 0) AS BIGINT) AS fp_components
  FROM sl s JOIN kc USING (case_id, z) LEFT JOIN centre USING (case_id, z) GROUP BY s.case_id)"""


def evaluated(spark, d):
    return E.evaluate_cases(study(spark, d), min_component=3)


@query("case_evaluation", recursive(CASES + f"""
SELECT case_id, n_slices, n_positive_slices, n_negative_slices, {r6('dice')} AS dice, {r6('iou')} AS iou,
       {r6('sensitivity_iou')} AS sensitivity_iou, {r6('sensitivity_centroid')} AS sensitivity_centroid, fp_slices, fp_components
FROM ev""", "study"))
def _(spark, d):
    return rounded_all(evaluated(spark, d), *E.CASE_METRICS)


HASH = "('0x' || substr(md5({}), 1, 7))::BIGINT"
BOOT = f"""long AS (
  {{long}}),
vals AS (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY md5('{{seed}}|' || k)) - 1 AS pos,
         count(*) OVER (PARTITION BY metric) AS n FROM long WHERE value IS NOT NULL),
draws AS (SELECT metric, r, {HASH.format("'{seed}|' || r || '|' || pos")} % n AS pos FROM vals, range({{reps}}) t(r)),
means AS (SELECT metric, r, avg(value) AS m FROM draws JOIN vals USING (metric, pos) GROUP BY metric, r)
SELECT metric, {r6('(SELECT avg(value) FROM long l WHERE l.metric = means.metric)')} AS mean,
  {r6('quantile_cont(m, 0.025)')} AS lo, {r6('quantile_cont(m, 0.975)')} AS hi,
  (SELECT count(value) FROM long l WHERE l.metric = means.metric) AS n
FROM means GROUP BY metric"""
LONG = " UNION ALL ".join(
    f"SELECT case_id AS k, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM ev" for m, e in {
        "dice": "dice", "iou": "iou", "sensitivity_iou": "sensitivity_iou",
        "sensitivity_centroid": "sensitivity_centroid", "fp_components_per_volume": "fp_components",
        "fp_slice_rate": "CASE WHEN n_negative_slices > 0 THEN fp_slices / CAST(n_negative_slices AS DOUBLE) END"}.items())


@query("cohort_report", recursive(CASES + ", " + BOOT.format(long=LONG, seed=0, reps=10000), "study"))
def _(spark, d):
    return rounded_all(E.cohort_report(stored(evaluated(spark, d), "cases")), "mean", "lo", "hi")


@query("bootstrap_interval", "WITH " + BOOT.format(seed=3, reps=2000, long="""
  SELECT 'P' || user_id AS k, event_type AS metric, CASE WHEN count(*) > 3 THEN avg(value) END AS value
  FROM events GROUP BY user_id, event_type"""))
def _(spark, d):
    e = table(spark, d, "events").withColumn("k", F.concat(F.lit("P"), F.col("user_id")))
    per = e.groupBy("k", F.col("event_type").alias("metric")).agg(
        F.when(F.count(F.lit(1)) > 3, F.avg("value")).alias("value"))
    per = stored(per, "values")
    return rounded_all(E.bootstrap_ci(per, "value", key="k", by=["metric"], resamples=2000, seed=3), "mean", "lo", "hi")


@query("cohort_timing", with_views(f""", ev AS (
  SELECT case_id, count(*) AS n_slices, count(*) * 0.005 + any_value(case_no) * 0.01 AS seconds FROM slices GROUP BY case_id)
SELECT count(*) AS n_patients, CAST(sum(n_slices) AS BIGINT) AS n_slices, {r6('avg(seconds)')} AS seconds_mean,
  {r6('max(seconds)')} AS seconds_max, {r6('1000 * sum(seconds) / sum(n_slices)')} AS ms_per_slice,
  {r6('median(CAST(seconds AS DOUBLE))')} AS seconds_median FROM ev""", "slices"))
def _(spark, d):
    cases = slices(spark, d).groupBy("case_id").agg(F.count(F.lit(1)).alias("n_slices"), F.max("case_no").alias("no"))
    cases = cases.withColumn("seconds", F.col("n_slices") * 0.005 + F.col("no") * 0.01)
    return rounded_all(E.cohort_timing(cases), "seconds_mean", "seconds_max", "ms_per_slice", "seconds_median")


SCORES = """, sc AS (SELECT case_id, z, round(max(v), 2) AS score, bool_or(m = 1) AS has_lesion FROM study GROUP BY case_id, z)"""


def scores(spark, d):
    """Slice scores at two decimals, so that ties happen."""
    return study(spark, d).select("case_id", "z", F.round(F.array_max("pixels"), 2).alias("score"),
                                  A.any_positive("mask").alias("has_lesion"))


PAIRS = """, auc AS (
  SELECT a.case_id, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) / count(*) AS auc
  FROM sc a JOIN sc b ON a.case_id = b.case_id AND a.has_lesion AND NOT b.has_lesion GROUP BY a.case_id)"""


@query("ranking_metrics", with_views(SCORES + PAIRS + f""",
o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, z) AS rn FROM sc),
f AS (SELECT case_id, min(rn) AS rank FROM o WHERE has_lesion GROUP BY case_id)
SELECT count(*) AS n_patients, {r6('avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END)')} AS top1,
  {r6('avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END)')} AS top3, {r6('median(rank)')} AS median_rank,
  (SELECT {r6('avg(auc)')} FROM auc) AS auc FROM f""", "study"))
def _(spark, d):
    return rounded_all(E.ranking_metrics(stored(scores(spark, d), "scores")), "top1", "top3", "median_rank", "auc")


@query("case_auc", with_views(SCORES + PAIRS + f" SELECT case_id, {r6('auc')} AS auc FROM auc", "study"))
def _(spark, d):
    return rounded_all(E.auc(scores(spark, d), ["case_id"], "has_lesion", "score"), "auc")


@query("best_slice", with_views(SCORES + """,
o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, z) AS rn FROM sc)
SELECT case_id, z, 'segmentation_confidence' AS slice_selector FROM o WHERE rn = 1""", "study"))
def _(spark, d):
    return E.best_slice(scores(spark, d))


@query("best_slice_modes", with_views("""
, m AS (SELECT case_id, case_no, z, round(avg(v), 3) AS c FROM study GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY c DESC, z) AS rn FROM m)
SELECT case_id, CASE WHEN case_no % 3 = 0 THEN case_no + 1 ELSE z END AS z,
       CASE WHEN case_no % 3 = 0 THEN 'pinned' ELSE 'classifier' END AS slice_selector FROM o WHERE rn = 1""", "study"))
def _(spark, d):
    s = study(spark, d).withColumn("rank_score", F.round(A.total("pixels") / F.size("pixels"), 3))
    no = F.col("case_no")
    pins = s.groupBy("case_id").agg(F.max("case_no").alias("case_no")).select(
        "case_id", F.when(no % 3 == 0, no + 1).alias("forced_slice"))
    return E.best_slice(s, pins, classifier="rank_score")


@query("localise", with_views(resize_sql(4) + """
, prob4 AS (SELECT case_id, z, y, x, 1.0 / (1.0 + exp(-30.0 * v)) AS v FROM resized),
meta AS (SELECT case_id, case_no, CAST(count(*) AS INTEGER) AS depth FROM slices GROUP BY ALL),
mx AS (SELECT case_id, z, max(v) AS c FROM prob4 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY c DESC, z) AS rn FROM mx),
win AS (
  SELECT case_id, case_no, depth, CASE WHEN case_no % 4 = 0 THEN case_no + 5 ELSE z END AS z FROM o JOIN meta USING (case_id) WHERE rn = 1),
ax AS (SELECT t, CAST(floor(src) AS INTEGER) AS i0, least(CAST(floor(src) AS INTEGER) + 1, 3) AS i1, src - floor(src) AS f
  FROM (SELECT t, greatest((t + 0.5) * 4 / CAST(8 AS DOUBLE) - 0.5, 0.0) AS src FROM range(8) r(t)) q),
tp AS (SELECT t, i0 AS i, 1 - f AS wt FROM ax UNION ALL SELECT t, i1, f FROM ax),
up AS (SELECT p.case_id, a.t AS y, b.t AS x, sum(v * a.wt * b.wt) AS v
  FROM prob4 p JOIN win w ON w.case_id = p.case_id AND w.z = p.z JOIN tp a ON a.i = p.y JOIN tp b ON b.i = p.x GROUP BY ALL),
bx AS (SELECT case_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM up WHERE v >= 0.97 GROUP BY case_id)
SELECT w.case_id, c >= 0.97 AS lesion_detected, case_no % 4 = 0 AS slice_preselected,
  CASE WHEN case_no % 4 = 0 THEN 'pinned' ELSE 'segmentation_confidence' END AS slice_selector,
  round(c, 6) AS confidence, CAST(w.z + 2 AS INTEGER) AS best_slice,
  CAST(CASE WHEN c >= 0.97 THEN coalesce(x0, -1) ELSE -1 END AS INTEGER) AS x, CAST(CASE WHEN c >= 0.97 THEN coalesce(y0, -1) ELSE -1 END AS INTEGER) AS y,
  CAST(CASE WHEN c >= 0.97 THEN coalesce(x1 - x0 + 1, -1) ELSE -1 END AS INTEGER) AS w, CAST(CASE WHEN c >= 0.97 THEN coalesce(y1 - y0 + 1, -1) ELSE -1 END AS INTEGER) AS h,
  CAST(CASE WHEN c >= 0.97 THEN coalesce(x0 + 20, -1) ELSE -1 END AS INTEGER) AS full_x, CAST(CASE WHEN c >= 0.97 THEN coalesce(y0 + 10, -1) ELSE -1 END AS INTEGER) AS full_y,
  CAST(CASE WHEN case_no % 2 = 0 THEN 176 ELSE depth END AS INTEGER) AS n_slices
FROM win w JOIN mx ON mx.case_id = w.case_id AND mx.z = w.z LEFT JOIN bx ON bx.case_id = w.case_id""", "voxels"))
def _(spark, d):
    """Maps at 4 x 4, native frame 8 x 8; every fourth case pins its slice."""
    s = slices(spark, d)
    small = V.resize(s.select("case_id", "z", "h", "w", "pixels"), 4)
    small = small.withColumn("prob", F.transform("pixels", lambda v: 1.0 / (1.0 + F.exp(-30.0 * v))))
    no = F.col("no")
    cases = V.case_table(s, F.max("case_no").alias("no")).select(
        "case_id", "h", "w", "depth", F.lit(2).alias("off_z"), F.lit(10).alias("off_y"), F.lit(20).alias("off_x"),
        F.when(no % 4 == 0, no + 5).alias("forced_slice"), F.when(no % 2 == 0, F.lit(176)).alias("source_n_slices"))
    r = E.localise(small, cases, threshold=0.97)

    def field(box, f):
        return F.coalesce(F.col(f"{box}.{f}"), F.lit(-1))
    return r.select("case_id", "lesion_detected", "slice_preselected", "slice_selector",
                    F.round("confidence", 6).alias("confidence"), "best_slice",
                    *[field("box", f).alias(f) for f in ("x", "y", "w", "h")],
                    field("box_full_frame", "x").alias("full_x"), field("box_full_frame", "y").alias("full_y"),
                    "n_slices")


@query("full_frame_boxes", with_views("""
, meta AS (SELECT case_id, case_no, CAST(count(*) AS INTEGER) AS depth FROM slices GROUP BY ALL)
SELECT s.case_id, CAST(z + case_no AS INTEGER) AS best_slice, min(x) AS box_x, min(y) AS box_y,
  CAST(min(x) + 7 AS INTEGER) AS full_x, CAST(min(y) + 3 * case_no AS INTEGER) AS full_y,
  CAST(CASE WHEN case_no % 2 = 0 THEN 176 ELSE depth END AS INTEGER) AS n_slices
FROM study s JOIN meta USING (case_id, case_no) WHERE m = 1 GROUP BY s.case_id, z, case_no, depth""", "study"))
def _(spark, d):
    s = study(spark, d)
    b = O.bounding_box(s).select("case_id", F.col("z").alias("best_slice"), F.col("x").alias("box_x"),
                                 F.col("y").alias("box_y"))
    no = F.col("no")
    cases = V.case_table(s, F.max("case_no").alias("no")).select(
        "case_id", "depth", no.alias("off_z"), (3 * no).alias("off_y"), F.lit(7).alias("off_x"),
        F.when(no % 2 == 0, F.lit(176)).alias("source_n_slices"))
    return V.to_full_frame(b, cases)


@query("curated_cases", with_views(MASSES + f""",
o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, z) AS rn FROM sl WHERE ts > 0)
SELECT case_id, z, {r6(IOU_P)} AS iou, CAST(ts AS BIGINT) AS lesion_voxels FROM o WHERE rn = 1
ORDER BY {IOU_P} DESC, case_id LIMIT 3""", "study"))
def _(spark, d):
    return E.curate_cases(study(spark, d)).select("case_id", "z", rounded("iou").alias("iou"),
                                                  F.col("t_sum").cast("long").alias("lesion_voxels"))


@query("smoothed_curve", f"""
WITH ok AS (SELECT user_id AS run, event_id AS epoch, CAST(round(value * 100) AS DOUBLE) AS val_dice FROM events WHERE event_type <> 'error'),
sm AS (SELECT *, avg(val_dice) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS smoothed FROM ok)
SELECT run, epoch, val_dice, {r6('smoothed')} AS smoothed, smoothed > coalesce(max(smoothed) OVER (
  PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0) AS is_best FROM sm""")
def _(spark, d):
    e = table(spark, d, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("epoch"),
        F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.round(F.col("value") * 100)).alias("val_dice"))
    return rounded_all(E.smooth_curve(e), "smoothed")


@query("class_metrics", with_views(f"""
, c AS (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) AS n FROM predictions),
f AS (SELECT *, 2.0 * tp / (2 * tp + fp + fn) AS f1, 2.0 * tn / (2 * tn + fp + fn) AS f0 FROM c)
SELECT {r6('(tp + tn) / n')} AS accuracy, {r6('tp / (tp + fp)')} AS precision_1, {r6('tp / (tp + fn)')} AS recall_1,
  {r6('(f1 * (tp + fn) + f0 * (tn + fp)) / n')} AS f1_weighted,
  (SELECT {r6('sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) / count(*)')}
   FROM predictions a JOIN predictions b ON a.label = 1 AND b.label = 0) AS roc_auc
FROM f""", "predictions"))
def _(spark, d):
    return rounded_all(E.class_metrics(predictions(spark, d)), "accuracy", "precision_1", "recall_1",
                       "f1_weighted", "roc_auc")
