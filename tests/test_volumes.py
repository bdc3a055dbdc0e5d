from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import box, slice_table
from voxtable.functions import arrays as A
from voxtable.operators import components as K
from voxtable.operators import scoring as G
from voxtable.operators import volumes as V


def stack(df, column="pixels", h=None, w=None):
    rows = df.orderBy("case_id", "z").collect()
    return np.array([np.reshape(r[column], (h or r.h, w or r.w)) for r in rows])


def test_slices_are_ordered_by_number_not_by_text(spark):
    f = spark.createDataFrame([("s", "10"), ("s", "9"), ("s", "1"), ("t", "7")], "series_uid string, instance string")
    got = {(r.series_uid, r.instance): r.z for r in V.order_slices(f).collect()}
    assert got == {("s", "1"): 0, ("s", "9"): 1, ("s", "10"): 2, ("t", "7"): 0}


def test_painted_boxes_match_array_slicing(spark):
    rng = np.random.default_rng(0)
    t = slice_table(spark, ("a", np.zeros((6, 9, 7))), ("b", np.zeros((3, 5, 5))))
    rows, want = [], {"a": np.zeros((6, 9, 7), int), "b": np.zeros((3, 5, 5), int)}
    for i in range(60):
        c = "ab"[i % 2]
        s = rng.integers(0, 6, 3)
        e = s + rng.integers(0, 5, 3)
        rows.append((c, *[int(x) for x in (s[0], e[0], s[1], e[1], s[2], e[2])]))
        lo = np.maximum(s - 1, 0)
        if i >= 8:
            continue
        want[c][lo[0]:e[0], lo[1]:e[1], lo[2]:e[2]] = 1
    cols = "case_id string, start_slice int, end_slice int, start_row int, end_row int, start_col int, end_col int"
    boxes = spark.createDataFrame(rows[:8], cols)
    got = V.paint_boxes(t.drop("mask"), V.boxes_from_1based(boxes))
    for c in "ab":
        assert (stack(got.where(F.col("case_id") == c), "mask") == want[c]).all()


def test_start_zero_is_held_at_the_frame(spark):
    b = spark.createDataFrame([("c", 0, 2, 0, 3, 1, 4)],
                              "case_id string, start_slice int, end_slice int, start_row int, end_row int, start_col int, end_col int")
    assert V.boxes_from_1based(b).first() == ("c", 0, 2, 0, 3, 0, 4)


def test_many_equal_boxes_cost_one_run_per_row(spark):
    b = spark.createDataFrame([("c", 0, 1, 0, 2, 0, 3 + i % 4) for i in range(500)],
                              "case_id string, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int")
    cases = spark.createDataFrame([("c", 1, 8, 8)], "case_id string, depth int, h int, w int")
    assert sorted(tuple(r) for r in V.box_runs(b, cases).collect()) == [("c", 0, 0, 0, 6), ("c", 0, 1, 0, 6)]


def test_normalise_matches_numpy(spark):
    rng = np.random.default_rng(2)
    v = rng.gamma(1.0, 50.0, (5, 6, 7))
    got = stack(V.normalise_intensity(slice_table(spark, ("a", v))))
    lo, hi = np.percentile(v, [1, 99])
    c = np.clip(v, lo, hi)
    assert np.allclose(got, (c - c.mean()) / (c.std() + 1e-8), atol=1e-9)


def test_large_case_tables_take_the_salted_join(spark, monkeypatch):
    v = np.random.default_rng(7).normal(size=(9, 4, 4))
    m = box(9, 4, 4, 1, 2, 1, 3)
    t = slice_table(spark, ("a", v, m), ("b", v * 3, m))

    def run():
        return stack(V.crop_to_roi(V.normalise_intensity(t), margin=1))
    small = run()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert np.allclose(run(), small)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_missing_instances_name_their_series(spark):
    f = spark.createDataFrame([("s", "1"), ("s", None)], "series_uid string, instance string")
    with pytest.raises(Exception, match="no instance number in series s"):
        V.order_slices(f).collect()


def test_approximate_normalise_is_close(spark):
    v = np.random.default_rng(2).gamma(1.0, 50.0, (5, 6, 7))
    t = slice_table(spark, ("a", v))
    a, b = stack(V.normalise_intensity(t, approximate=True)), stack(V.normalise_intensity(t))
    assert np.abs(a - b).max() < 0.5


def test_crop_keeps_margin_and_offset(spark):
    m = np.zeros((8, 10, 12), int)
    m[3:5, 4:6, 7] = 1
    v = np.arange(m.size, dtype=float).reshape(m.shape)
    c = V.crop_to_roi(slice_table(spark, ("a", v, m)), margin=2)
    r = c.orderBy("z").first()
    assert (r.off_z, r.off_y, r.off_x) == (1, 2, 5)
    assert (stack(c) == v[1:7, 2:8, 5:10]).all() and (stack(c, "mask") == m[1:7, 2:8, 5:10]).all()


def test_crop_of_an_empty_mask_changes_nothing(spark):
    v = np.random.default_rng(0).random((3, 4, 5))
    c = V.crop_to_roi(slice_table(spark, ("a", v)))
    assert np.allclose(stack(c), v) and c.select("off_z", "off_y", "off_x").distinct().first() == (0, 0, 0)


def test_slab_shifts_offset_and_pins_the_centre(spark):
    m = np.zeros((30, 2, 2), int)
    m[20] = 1
    t = slice_table(spark, ("a", np.zeros((30, 2, 2)), m))
    meta = spark.createDataFrame([("a", 30, 20, 4, 5, 6)], "case_id string, depth int, centre int, off_z int, off_y int, off_x int")
    s, c = V.cut_slab(t, meta, slab=3)
    r = c.first()
    assert (r.depth, r.off_z, r.forced_slice, r.source_n_slices) == (7, 21, 3, 34)
    pinned = s.where(F.col("z") == r.forced_slice).first()
    assert s.count() == 7 and sum(pinned.mask) > 0, "the pinned slice lies on the lesion"


def test_slab_outside_the_volume_names_the_case(spark):
    t = slice_table(spark, ("deep", np.zeros((3, 2, 2))))
    meta = spark.createDataFrame([("deep", 3, 9, 0, 0, 0)], "case_id string, depth int, centre int, off_z int, off_y int, off_x int")
    with pytest.raises(Exception, match="the centre of deep, slice .*, is not among its 3 slices"):
        V.cut_slab(t, meta)[0].collect()


def brute_bilinear(img, oh, ow):
    h, w = img.shape
    out = np.zeros((oh, ow))
    for y in range(oh):
        for x in range(ow):
            sy, sx = max(0, (y + .5) * h / oh - .5), max(0, (x + .5) * w / ow - .5)
            y0, x0 = int(sy), int(sx)
            y1, x1, fy, fx = min(y0 + 1, h - 1), min(x0 + 1, w - 1), sy - int(sy), sx - int(sx)
            out[y, x] = ((1 - fy) * ((1 - fx) * img[y0, x0] + fx * img[y0, x1])
                         + fy * ((1 - fx) * img[y1, x0] + fx * img[y1, x1]))
    return out


def test_resize_of_mixed_shapes(spark):
    rng = np.random.default_rng(5)
    a, b = rng.random((2, 6, 9)), rng.random((3, 11, 4))
    t = slice_table(spark, ("a", a, (a > .5).astype(int)), ("b", b, (b > .5).astype(int)))
    r = V.resize(t, 5)
    for c, v in (("a", a), ("b", b)):
        got = r.where(F.col("case_id") == c)
        assert np.allclose(stack(got), [brute_bilinear(s, 5, 5) for s in v])
        ys, xs = [i * v.shape[1] // 5 for i in range(5)], [i * v.shape[2] // 5 for i in range(5)]
        assert (stack(got, "mask") == (v[:, ys][:, :, xs] > .5)).all()


def flood(mask):
    seen, out = np.zeros(mask.shape, bool), []
    for s in zip(*np.nonzero(mask)):
        if seen[s]:
            continue
        q, px = deque([s]), []
        seen[s] = True
        while q:
            y, x = q.popleft()
            px.append((y, x))
            for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= n[0] < mask.shape[0] and 0 <= n[1] < mask.shape[1] and mask[n] and not seen[n]:
                    seen[n] = True
                    q.append(n)
        out.append((s[0] * mask.shape[1] + s[1], len(px), np.mean([p[0] for p in px]), np.mean([p[1] for p in px])))
    return sorted(out)


@pytest.mark.parametrize("density", [0.2, 0.55, 0.7])
def test_components_match_flood_fill(spark, density):
    rng = np.random.default_rng(int(density * 100))
    a, b = rng.random((4, 17, 23)) < density, rng.random((2, 9, 9)) < density
    t = slice_table(spark, ("a", np.zeros(a.shape), None, a.astype(int)), ("b", np.zeros(b.shape), None, b.astype(int)))
    got = {}
    for r in K.components(t).collect():
        got.setdefault((r.case_id, r.z), []).append((r.seed, r["size"], r.cy, r.cx))
    for c, v in (("a", a), ("b", b)):
        for z in range(len(v)):
            assert np.allclose(sorted(got[(c, z)]), flood(v[z]))


def test_spiral_is_one_component():
    m = np.array([[1, 1, 1, 1, 1], [0, 0, 0, 0, 1], [1, 1, 1, 0, 1], [1, 0, 0, 0, 1], [1, 1, 1, 1, 1]], bool)
    lab = K.label_stack(m[None])[0]
    assert set(lab[m]) == {0}


def test_centroid_rule_uses_the_biggest_component(spark):
    truth, pred = box(1, 12, 12, 0, 4, 0, 4), box(1, 12, 12, 6, 11, 6, 11)
    pred[0, 1:3, 1:3] = 1
    t = slice_table(spark, ("far", np.zeros((1, 12, 12)), truth, pred), ("near", np.zeros((1, 12, 12)), truth, truth))
    got = {r.case_id: r.hit for r in K.centroid_hits(t, min_size=2).collect()}
    assert got == {"far": False, "near": True}


def test_flips_and_gamma(spark):
    v = np.random.default_rng(1).normal(size=(2, 3, 4))
    t = slice_table(spark, ("a", v)).withColumns({
        "fh": A.flip_horizontal("pixels", "h", "w"), "fv": A.flip_vertical("pixels", "h", "w"),
        "same": A.gamma_curve("pixels", F.lit(1.0))})
    assert np.allclose(stack(t, "fh"), v[:, :, ::-1]) and np.allclose(stack(t, "fv"), v[:, ::-1])
    assert np.allclose(stack(t, "same"), v)


def test_augmentation_repeats_and_relabels(spark):
    rng = np.random.default_rng(4)
    v, m = rng.normal(size=(6, 8, 8)), np.zeros((6, 8, 8), int)
    m[0, 0, 0] = 1                       # a corner pixel can leave the frame
    m[1:4, 3:5, 3:5] = 1
    t = slice_table(spark, ("a", v, m))
    one, two = (G.augment(t.repartition(n), seed=9) for n in (1, 5))
    assert np.allclose(stack(one), stack(two)) and (stack(one, "mask") == stack(two, "mask")).all()
    assert all(r.has_lesion == (sum(r.mask) > 0) for r in one.collect())
    assert set(np.unique(stack(one, "mask"))) <= {0, 1}


def test_identity_affine_keeps_the_image():
    img = np.random.default_rng(0).random((5, 6))
    moved, mask = G.rotate_scale(img, (img > .5).astype(int), 0.0, 1.0)
    assert np.allclose(moved, img) and (mask == (img > .5)).all()


def test_strip_leaves_out_single_and_deep_cases(spark):
    t = slice_table(spark, ("one", np.ones((1, 2, 2))), ("ok", np.arange(12.).reshape(3, 2, 2)), ("deep", np.ones((42, 2, 2))))
    cases = V.case_table(t, F.lit(5).alias("off_z"))
    best = spark.createDataFrame([(c, 99) for c in ("one", "ok", "deep")], "case_id string, best_slice int")
    got = V.slice_strip(t, cases, best).orderBy("z").collect()
    assert [(r.case_id, r["index"], r.is_best) for r in got] == [("ok", 5, False), ("ok", 6, False), ("ok", 7, True)]


def test_scorer_is_made_once_per_task_and_sees_stacks(spark):
    def make():
        return lambda s: s * 0 + s.max(axis=(1, 2), keepdims=True)
    v = np.arange(24.).reshape(2, 3, 4)
    t = slice_table(spark, ("a", v))
    got = stack(G.score_slices(t.select("case_id", "z", "h", "w", "pixels"), make), "prob")
    assert (got[:, 0, 0] == [11, 23]).all()
