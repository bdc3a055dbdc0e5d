import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import box, slice_table
from voxtable.operators import evaluation as E

# Published per-case results of 28 cases (slices, negative slices, Dice, false components).
GOLDEN = """
184 178 0.6516905310076219 309
166 160 0.2812390462112813 254
160 147 0.2945447101584477 212
176 146 0.7400551139563099 205
176 124 0.409185799110175 231
208 181 0.720875588682307 280
176 160 0.27295335920938246 237
162 154 0.3141366109449057 257
176 135 0.6867791721989067 185
160 146 0.42728399882871687 219
208 169 0.6911853293293339 228
176 159 0.6373418995913629 237
176 154 0.5280385204737932 244
144 100 0.5989661849086354 159
176 158 0.392941367554694 250
208 191 0.4756101569529935 241
160 144 0.6063450687546772 207
196 168 0.7099515539022795 240
160 128 0.6186131548915396 178
160 140 0.6675790666033233 226
112 55 0.7527007024211014 74
176 163 0.27738508208141865 275
146 118 0.7355248842479316 174
156 138 0.4892843447326918 177
176 160 0.5817054579686864 250
176 155 0.31505090843384714 221
176 144 0.5220216705176327 210
156 141 0.5386806829806865 241
"""
# Published Dice by epoch; the loss is not a number from epoch 13 on.
CURVE = [0.450560, 0.501714, 0.513069, 0.532401, 0.565809, 0.551603, 0.581866, 0.558320, 0.560842, 0.592473,
         0.591059, 0.615445, 0.612527, 0.614482] + [0.0] * 16


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(f"c{i:02d}", int(n), int(g), float(d), int(c)) for i, (n, g, d, c) in
            enumerate(line.split() for line in GOLDEN.strip().splitlines())]
    return spark.createDataFrame(rows, "case_id string, n_slices long, n_negative_slices long, dice double, fp_components long")


def test_published_means_and_interval(spark, golden):
    r = E.bootstrap_ci(golden, "dice").first()
    assert r.n == 28 and r.mean == pytest.approx(0.5334882130948101)
    assert (r.lo, r.hi) == pytest.approx((0.47289, 0.59292), abs=0.004)
    f = E.bootstrap_ci(golden, "fp_components").first()
    assert f.mean == pytest.approx(222.17857142857142) and (f.lo, f.hi) == pytest.approx((204.68, 237.36), abs=1.0)
    assert golden.agg(F.sum("n_slices")).first()[0] == 4782


def test_bootstrap_drops_missing_values_and_keeps_empty_groups(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 3.0), ("c", "x", None), ("d", "x", float("nan")), ("a", "y", None)],
                               "case_id string, metric string, v double")
    got = {r.metric: r for r in E.bootstrap_ci(df, "v", by=["metric"], resamples=400).collect()}
    assert got["x"].n == 2 and got["x"].mean == 2.0 and 1.0 <= got["x"].lo <= got["x"].hi <= 3.0
    assert got["y"].n == 0 and got["y"].mean is None and got["y"].lo is None


def test_bootstrap_does_not_depend_on_partitions(golden):
    a, b = (E.bootstrap_ci(golden.repartition(n), "dice", resamples=700, seed=4).first() for n in (1, 9))
    assert a == b


def under_broadcasts(df):
    """Lines of the plan that lie below a broadcast."""
    out, edge = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-*"))
        edge = None if edge is not None and at <= edge else edge
        if edge is not None:
            out.append(line)
        elif "BroadcastExchange" in line:
            edge = at
    return out


def test_bootstrap_never_broadcasts_its_draws(spark):
    df = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("case_id"), (F.col("id") % 7).alias("metric"),
                                  F.rand(1).alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        held, dealt = (E.bootstrap_ci(df, "v", by=["metric"], resamples=60, held_values=n) for n in (3000, 2999))
        assert any("_block" in line for line in under_broadcasts(held))
        for plan in (held, dealt):
            assert not any("Range" in line for line in under_broadcasts(plan)), plan
        key = lambda r: r.metric
        for a, b in zip(sorted(held.collect(), key=key), sorted(dealt.collect(), key=key), strict=True):
            assert (a.metric, a.n) == (b.metric, b.n) and (a.mean, a.lo, a.hi) == pytest.approx((b.mean, b.lo, b.hi), rel=1e-12)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bootstrap_by_plain_counting(spark):
    rows = [(f"c{i}", m, float((i * 37 + j) % 101)) for j, (m, n) in enumerate((("x", 5000), ("y", 40))) for i in range(n)]
    df = spark.createDataFrame(rows, "case_id string, metric string, v double")
    got = {r.metric: r for r in E.bootstrap_ci(df, "v", by=["metric"], resamples=40, seed=6).collect()}

    def md5(*parts):
        return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    for m in ("x", "y"):
        vals = [v for _, v in sorted((md5(6, c), v) for c, own, v in rows if own == m)]
        means = [np.mean([vals[int(md5(6, r, i)[:7], 16) % len(vals)] for i in range(len(vals))]) for r in range(40)]
        assert (got[m].lo, got[m].hi) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])), rel=1e-9)


def test_case_row_by_hand(spark):
    truth, pred = np.zeros((3, 12, 12), int), np.zeros((3, 12, 12), int)
    truth[0, 2:6, 2:6] = 1
    pred[0, 2:6, 2:4] = 1
    pred[1, 0:4, 0:4] = 1            # false alarm of 16 pixels
    pred[2, 0, 0] = 1                # too small to count
    t = slice_table(spark, ("a", np.zeros(truth.shape), truth, pred), ("none", np.zeros((2, 12, 12))))
    got = {r.case_id: r for r in E.evaluate_cases(t, min_component=4).collect()}
    a = got["a"]
    assert (a.n_slices, a.n_positive_slices, a.n_negative_slices, a.fp_slices, a.fp_components) == (3, 1, 2, 1, 1)
    assert a.dice == pytest.approx(16 / 24) and a.iou == pytest.approx(0.5)
    assert a.sensitivity_iou == 1.0 and a.sensitivity_centroid == 1.0
    n = got["none"]
    assert n.dice is None and n.sensitivity_centroid is None and n.fp_components == 0


def test_auc_matches_all_pairs_with_ties(spark):
    rng = np.random.default_rng(0)
    rows = [(k, bool(rng.random() < .3), float(np.round(rng.normal(), 1))) for k in "ab" for _ in range(400)]
    rows += [("one", True, 0.5), ("one", True, 0.7)]
    got = {r.k: r.auc for r in E.auc(spark.createDataFrame(rows, "k string, y boolean, s double"), ["k"], "y", "s").collect()}
    for k in "ab":
        pos = [s for c, y, s in rows if c == k and y]
        neg = [s for c, y, s in rows if c == k and not y]
        wins = np.mean([(p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)])
        assert got[k] == pytest.approx(wins)
    assert got["one"] is None


def test_ranking_skips_cases_without_a_lesion(spark):
    rows = [("a", 0, .9, False), ("a", 1, .9, True), ("a", 2, .1, False), ("b", 0, .2, False), ("b", 1, .8, True), ("c", 0, .5, False)]
    r = E.ranking_metrics(spark.createDataFrame(rows, "case_id string, z int, score double, has_lesion boolean"), k=2).first()
    assert (r.n_patients, r.top1, r.top2, r.median_rank) == (2, 0.5, 1.0, 1.5)
    assert r.auc == pytest.approx((0.75 + 1.0) / 2)


def test_best_slice_ties_go_to_the_lowest_slice(spark):
    s = spark.createDataFrame([("a", 3, .5), ("a", 1, .5), ("a", 2, .4), ("b", 0, .1)], "case_id string, z int, score double")
    pins = spark.createDataFrame([("a", None), ("b", 7)], "case_id string, forced_slice int")
    got = {r.case_id: (r.z, r.slice_selector) for r in E.best_slice(s, pins).collect()}
    assert got == {"a": (1, "segmentation_confidence"), "b": (7, "pinned")}


def localised(spark, prob, threshold, **meta):
    p = spark.createDataFrame([("c", z, 2, 2, m) for z, m in enumerate(prob)],
                              "case_id string, z int, h int, w int, prob array<double>")
    row = {"h": 4, "w": 4, "depth": len(prob), "off_z": 10, "off_y": 20, "off_x": 30, "forced_slice": None,
           "source_n_slices": None, **meta}
    cases = spark.createDataFrame([("c", *row.values())], "case_id string, " + ", ".join(f"{k} int" for k in row))
    return E.localise(p, cases, threshold).first()


def test_localise_maps_the_box_to_the_full_frame(spark):
    r = localised(spark, [[0.1] * 4, [0.0, 0.9, 0.0, 0.9]], 0.5)
    assert r.lesion_detected and r.best_slice == 11 and r.n_slices == 2 and not r.slice_preselected
    assert tuple(r.box) == (2, 0, 2, 4) and tuple(r.box_full_frame) == (32, 20, 2, 4)


def test_a_detection_can_have_no_box(spark):
    """Odd enlargement samples between map pixels, so the peak is not reached at native size."""
    r = localised(spark, [[0.9, 0.0, 0.0, 0.0]], 0.9, h=1, w=1)
    assert r.lesion_detected and r.box is None and r.box_full_frame is None


def test_pinned_slice_below_threshold(spark):
    r = localised(spark, [[0.1] * 4, [0.9] * 4], 0.5, forced_slice=0, source_n_slices=176)
    assert not r.lesion_detected and r.box is None and r.best_slice == 10
    assert r.slice_preselected and r.slice_selector == "pinned" and r.n_slices == 176


def test_a_pinned_slice_without_prediction_stops_the_job(spark):
    with pytest.raises(Exception, match="no prediction for the chosen slice 7 of case c"):
        localised(spark, [[0.1] * 4], 0.5, forced_slice=7)


def test_auc_of_wide_margins_uses_many_buckets(spark):
    df = spark.createDataFrame([(float(10 ** e) * s, int(s * e > 3)) for e in range(1, 9) for s in (-1, 1)], "s double, y int")
    assert E.auc(df, [], "y", "s").first()["auc"] == 1.0


@pytest.mark.parametrize("width", [4, 1 << 16])
def test_published_curve_keeps_its_best_epoch(spark, width):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(CURVE, 1)], "run string, epoch int, val_dice double")
    got = E.smooth_curve(df, width=width).orderBy("epoch").collect()
    best, want = -1.0, []
    for i in range(len(CURVE)):
        m = np.mean(CURVE[max(0, i - 2):i + 1])
        want.append((pytest.approx(m), m > best))
        best = max(best, m)
    assert [(r.smoothed, r.is_best) for r in got] == want
    assert [r.epoch for r in got if r.is_best][-1] == 14


def test_nan_epochs_do_not_fill_the_window(spark):
    vals = [0.3, float("nan"), 0.6, 0.9, 0.0]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(vals)], "run string, epoch int, val_dice double")
    got = [(r.epoch, round(r.smoothed, 6)) for r in E.smooth_curve(df).orderBy("epoch").collect()]
    assert got == [(0, 0.3), (2, 0.45), (3, 0.6), (4, 0.5)]


def test_weighted_f1_differs_from_class_one(spark):
    rows = [(1.0, 1.0, .9)] * 33 + [(1.0, 0.0, .4)] + [(0.0, 0.0, .2)] * 51 + [(0.0, 1.0, .8)]
    r = E.class_metrics(spark.createDataFrame(rows, "label double, prediction double, score double")).first()
    assert round(100 * r.accuracy, 2) == 97.67 and round(100 * r.precision_1, 2) == 97.06
    assert round(100 * r.recall_1, 2) == 97.06 and round(100 * r.f1_weighted, 2) == 97.67


def test_curated_cases(spark):
    big = box(2, 8, 8, 0, 4, 0, 4)
    big[1, :] = 0
    big[1, 0:2, 0:2] = 1
    half = big.copy()
    half[0, 2:] = 0
    t = slice_table(spark, ("best", np.zeros(big.shape), big, big), ("half", np.zeros(big.shape), big, half),
                    ("empty", np.zeros(big.shape), big * 0, big))
    got = [(r.case_id, r.z, r.iou) for r in E.curate_cases(t, 3).collect()]
    assert got == [("best", 0, 1.0), ("half", 0, 0.5)]


def test_auc_leaves_out_rows_without_score(spark):
    rows = [("a", True, 0.9), ("a", False, 0.1), ("a", True, None), ("a", False, None), ("a", False, float("nan")),
            ("b", True, None)]
    df = spark.createDataFrame(rows, "case_id string, y boolean, s double")
    got = {r.case_id: r.auc for r in E.auc(df, ["case_id"], "y", "s").collect()}
    assert got == {"a": 1.0, "b": None}
