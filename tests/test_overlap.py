import numpy as np
import pytest

from helpers import box, slice_table
from voxtable.operators import overlap as O


def table(spark, pred, truth):
    return slice_table(spark, ("c", np.zeros(pred.shape), truth, pred))


def test_dice_exceeds_iou_between_the_extremes(spark):
    r = O.overlap(table(spark, box(1, 8, 8, 2, 6, 2, 6), box(1, 8, 8, 0, 4, 0, 4))).first()
    assert r.dice == pytest.approx(0.25, abs=1e-6)
    assert r.iou == pytest.approx(4 / 28, abs=1e-6)


def test_disjoint_boxes_score_nothing(spark):
    r = O.overlap(table(spark, box(1, 8, 8, 5, 8, 5, 8), box(1, 8, 8, 0, 3, 0, 3))).first()
    assert r.dice < 1e-3 and r.iou < 1e-3


def test_identity_scores_one(spark):
    m = box(1, 8, 8, 1, 5, 1, 5)
    r = O.overlap(table(spark, m, m)).first()
    assert r.dice == pytest.approx(1) and r.iou == pytest.approx(1)


def test_empty_against_empty(spark):
    t = table(spark, box(1, 8, 8, 0, 0, 0, 0), box(1, 8, 8, 0, 0, 0, 0))
    assert O.overlap(t).first().dice == pytest.approx(1)
    assert O.plain_overlap(t).first().dice == 0.0
    p = O.pooled_scores(t).first()
    assert p["count"] == 0 and p.dice is None and p.dice_sum == 0.0


def test_predicting_nothing_scores_zero(spark):
    truth = box(2, 8, 8, 0, 4, 0, 4)
    truth[0] = 0
    p = O.pooled_scores(table(spark, np.zeros((2, 8, 8), int), truth)).first()
    assert p["count"] == 1 and p.dice_sum < 1e-3


def test_pooled_parts_equal_the_whole(spark):
    t = table(spark, box(3, 8, 8, 2, 6, 2, 6), box(3, 8, 8, 0, 4, 0, 4))
    whole = O.pooled_scores(t).first()
    parts = O.pooled_scores(t.where("z = 0")).unionByName(O.pooled_scores(t.where("z > 0")))
    merged = O.merge_scores(parts).first()
    assert merged.dice == pytest.approx(whole.dice) and merged["count"] == whole["count"]


def test_tversky_with_equal_weights_is_dice(spark):
    t = table(spark, box(1, 8, 8, 2, 6, 2, 6), box(1, 8, 8, 0, 4, 0, 4))
    r = O.tversky(t, prob="pred", alpha=0.5, beta=0.5).first()
    assert r.tversky == pytest.approx(0.25, abs=1e-6)
    assert r.focal_tversky == pytest.approx(0.75 ** 0.75, abs=1e-6)


def test_soft_losses_against_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3, 4, 5))
    m = (rng.random((3, 4, 5)) < 0.3).astype(int)
    r = O.soft_losses(slice_table(spark, ("c", v, m)), logit="pixels").first()
    p = 1 / (1 + np.exp(-v))
    bce = -(m * np.log(p) + (1 - m) * np.log(1 - p)).mean()
    axes = (1, 2)
    dice = ((2 * (p * m).sum(axes) + 1e-6) / (p.sum(axes) + m.sum(axes) + 1e-6)).mean()
    assert r.bce == pytest.approx(bce) and r.soft_dice == pytest.approx(dice)
    assert r.loss == pytest.approx(0.5 * bce + 0.5 * (1 - dice))


def test_bounding_box_styles(spark):
    t = table(spark, box(1, 8, 8, 2, 5, 1, 7), box(2, 8, 8, 0, 0, 0, 0)[:1])
    assert O.bounding_box(t, "pred").select("x", "y", "w", "h").first() == (1, 2, 6, 3)
    assert O.bounding_box(t, "pred", "corners").select("r0", "c0", "r1", "c1").first() == (2, 1, 4, 6)
    assert O.bounding_box(t, "mask").count() == 0
