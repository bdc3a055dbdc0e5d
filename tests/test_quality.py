import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import box, slice_table
from voxtable.operators import quality as Q
from voxtable.session import path_exists
from voxtable.sources import volumes as SV

SIDE = 130


def legit(depth=5, side=SIDE, seed=0):
    return np.random.default_rng(seed).normal(size=(depth, side, side))


def findings(spark, *cases, **kw):
    return {(r.case_id, r.rule, r.severity) for r in Q.validate_volumes(slice_table(spark, *cases), **kw).collect()}


def test_sound_cases_have_no_findings(spark):
    v = legit()
    assert findings(spark, ("c", v, box(5, SIDE, SIDE, 10, 20, 10, 20))) == set()


def test_each_contract_is_reported_by_name(spark):
    v, m = legit(4, 6), box(4, 6, 6, 1, 3, 1, 3)
    inf, big, odd = v.copy(), v.copy(), m.copy()
    inf[2, 1, 1] = np.inf
    big[0, 0, 0] = 70000.0
    odd[1, 2, 2] = 7
    t = slice_table(spark, ("inf", inf, m), ("big", big, m), ("odd", v, odd), ("gap", v, m), ("short", v, m), ("side", v, m))
    t = t.where(~((F.col("case_id") == "gap") & (F.col("z") == 1)))
    t = t.withColumn("mask", F.when((F.col("case_id") == "short") & (F.col("z") == 0), F.slice("mask", 1, 5)).otherwise(F.col("mask")))
    t = t.withColumn("h", F.when((F.col("case_id") == "side") & (F.col("z") == 0), 5).otherwise(F.col("h")))
    got = {r.case_id: (r.rule, r.severity) for r in Q.validate_volumes(t).collect()}
    assert got == {"inf": ("non_finite", "error"), "big": ("non_finite", "error"), "odd": ("mask_values", "error"),
                   "gap": ("not_3d", "error"), "short": ("mask_shape", "error"), "side": ("not_3d", "error")}


def test_empty_axis(spark):
    t = spark.createDataFrame([("c", 0, 0, 4, [], [])],
                              "case_id string, z int, h int, w int, pixels array<double>, mask array<int>")
    assert Q.validate_volumes(t).first().rule == "empty_axis"


def test_smells_only_warn(spark):
    v, m = legit(4, 6), box(4, 6, 6, 1, 3, 1, 3)
    got = findings(spark, ("small", v, m), ("empty", v), ("flat", v * 0 + 0.5, m))
    assert got == {("small", "in_plane", "warning"), ("empty", "in_plane", "warning"), ("flat", "in_plane", "warning"),
                   ("empty", "empty_mask", "warning"), ("flat", "constant", "warning")}


def test_small_frames_pass_when_cut_on_purpose(spark):
    assert findings(spark, ("c", legit(4, 6), box(4, 6, 6, 1, 3, 1, 3)), expect_full_frame=False) == set()


def test_the_threshold_stays_far_below_real_frames():
    assert Q.MIN_IN_PLANE < 448 / 3


def test_up_to_eight_mask_values_are_quoted(spark):
    m = np.arange(36).reshape(1, 6, 6)
    msg = Q.validate_volumes(slice_table(spark, ("c", legit(1, 6), m))).first().message
    assert msg == "c: mask has values other than 0 and 1: [0, 1, 2, 3, 4, 5, 6, 7] ..."


def test_summary_counts_slices_and_voxels(spark):
    m = np.zeros((20, 12, 12), int)
    m[4:8, 1:11, 1:11] = 1
    r = Q.summarise_volumes(slice_table(spark, ("c", np.zeros(m.shape), m))).first()
    assert (r.depth, r.h, r.w, r.lesion_slices, r.lesion_voxels, r.lesion_slice_fraction) == (20, 12, 12, 4, 400, 0.2)


@pytest.mark.parametrize("fault", ["inf", "mask", "shape"])
def test_a_broken_slice_is_never_written(spark, scratch, fault):
    v, m = legit(4, 6), box(4, 6, 6, 1, 3, 1, 3)
    if fault == "inf":
        v[3, 2, 2] = np.inf
    if fault == "mask":
        m[2, 2, 2] = 7
    t = slice_table(spark, ("fine", legit(4, 6), box(4, 6, 6, 1, 3, 1, 3)), ("case_042", v, m))
    if fault == "shape":
        t = t.withColumn("mask", F.when(F.col("case_id") == "case_042", F.slice("mask", 1, 5)).otherwise(F.col("mask")))
    with pytest.raises(Q.VolumeContractError, match="case_042"):
        SV.write_volumes(t, f"{scratch}/out", crop=False)
    assert not path_exists(spark, f"{scratch}/out/_SUCCESS")


def test_write_read_and_manifest_round_trip(spark, scratch):
    v, m = legit(4, 6), box(4, 6, 6, 1, 3, 1, 3)
    out = f"{scratch}/out"
    assert SV.read_manifest(spark, out) is None, "an unfinished run has no manifest"
    w = SV.write_volumes(slice_table(spark, ("a", v, m), ("b", v)), out, crop=False)
    params = {"crop": False, "boxes": f"{scratch}/raw/boxes.csv", "nested": {"list": [f"{scratch}/x", "plain", 3]}}
    SV.write_manifest(SV.read_volumes(spark, out), out, f"{scratch}/raw/series", params, root=scratch,
                      warnings=w, revision="abc1234")
    run, rows = SV.read_manifest(spark, out)
    assert run["n_cases"] == 2 and run["source"] == "raw/series" and run["output_dir"] == "out"
    assert run["parameters"] == {"crop": False, "boxes": "raw/boxes.csv", "nested": {"list": ["x", "plain", 3]}}
    assert run["generated_at"].endswith("+00:00") and run["revision"] == "abc1234"
    case = rows.where("kind = 'case' and case_id = 'a'").first()
    assert case["shape"] == [4, 6, 6] and case.lesion_voxels == 16
    assert run["n_warnings"] == rows.where("kind = 'warning'").count() == 3
    back = SV.read_volumes(spark, out).where("case_id = 'a'").orderBy("z").collect()
    assert np.allclose([r.pixels for r in back], v.reshape(4, -1).astype("float32"))


def test_manifest_strings_below_the_root_are_relative():
    given = {"none": None, "away": "/elsewhere/x", "longer": "/rest/x", "root": "/r", "deep": [{"a": "/r/b/c"}, 3],
             "back": "/r\\d\\e", "quoted": '/r/a"b'}
    want = {"none": None, "away": "/elsewhere/x", "longer": "/rest/x", "root": ".", "deep": [{"a": "b/c"}, 3],
            "back": "d/e", "quoted": 'a"b'}
    assert SV.portable(given, "/r/") == want


def test_a_case_with_a_gap_is_never_published(spark, scratch):
    out = f"{scratch}/gap"
    t = slice_table(spark, ("a", legit(4, 6))).where("z <> 2")
    with pytest.raises(Q.VolumeContractError, match="a: "):
        SV.write_volumes(t, out, crop=False)
    assert not path_exists(spark, out)
    SV.write_volumes(slice_table(spark, ("a", legit(4, 6))), out, crop=False)
    with pytest.raises(FileExistsError):
        SV.write_volumes(slice_table(spark, ("a", legit(4, 6))), out, crop=False)
    SV.write_volumes(slice_table(spark, ("b", legit(3, 6))), out, crop=False, mode="overwrite")
    assert SV.read_volumes(spark, out).count() == 3


def test_slice_bank_is_reused_until_the_request_changes(spark, scratch):
    t = slice_table(spark, ("a", legit(3, 6), box(3, 6, 6, 0, 4, 0, 4)))
    out = f"{scratch}/bank"
    assert SV.build_slice_bank(t, out, ["a"], size=3)
    assert not SV.build_slice_bank(t, out, ["a"], size=3)
    assert SV.build_slice_bank(t, out, ["a"], size=3, force=True)
    assert SV.build_slice_bank(t, out, ["a"], size=4)
    assert SV.build_slice_bank(t, out, ["a", "b"], size=4)
    r = SV.read_slice_bank(spark, out).first()
    assert len(r.pixels) == len(r.mask) == 16 and r.has_lesion


def test_a_broken_rebuild_is_not_taken_for_a_finished_bank(spark, scratch):
    out = f"{scratch}/bank"
    t = slice_table(spark, ("a", np.ones((2, 4, 4))))
    assert SV.build_slice_bank(t, out, ["a"], size=3)
    unread = t.withColumn("h", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        SV.build_slice_bank(unread, out, ["a", "b"], size=3)
    assert not SV.build_slice_bank(t, out, ["a"], size=3)           # nothing was touched yet
    bad = t.withColumn("pixels", F.slice("pixels", 1, 5))
    with pytest.raises(Exception, match="reshape"):
        SV.build_slice_bank(bad, out, ["a", "b"], size=3)
    assert SV.build_slice_bank(t, out, ["a"], size=3)
    assert SV.read_slice_bank(spark, out).count() == 2
