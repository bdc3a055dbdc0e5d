import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import slice_table
from voxtable.operators import components as K
from voxtable.operators import tiles as T


def spiral(n):
    m = np.zeros((n, n), int)
    y, x, dy, dx = 0, 0, 0, 1
    m[0, 0] = 1
    while True:
        for _ in range(2):                          # go on, or turn once
            a, b = y + dy, x + dx
            c, d = a + dy, b + dx
            free = 0 <= a < n and 0 <= b < n and not m[a, b] and not (0 <= c < n and 0 <= d < n and m[c, d])
            if free:
                break
            dy, dx = dx, -dy
        if not free:
            return m
        y, x = a, b
        m[y, x] = 1


def rows(df):
    return sorted((r.case_id, r.z, r.seed, r.size, round(r.cy, 9), round(r.cx, 9)) for r in df.collect())


@pytest.mark.parametrize("tile", [(4, 4), (1, 1), (3, 7), (64, 64)])
def test_tiles_give_the_components_of_whole_frames(spark, tile):
    rng = np.random.default_rng(6)
    noise = (rng.random((3, 17, 21)) < 0.55).astype(int)
    turned = np.stack([spiral(23), np.ones((23, 23), int), np.zeros((23, 23), int), np.eye(23, dtype=int)])
    comb = np.zeros((1, 9, 40), int)
    comb[:, -1], comb[:, :, ::2] = 1, 1             # teeth that only meet in the last row
    t = slice_table(spark, ("a", noise, None, noise), ("b", turned, None, turned), ("c", comb, None, comb))
    for least in (1, 3):
        assert rows(T.tiled_components(T.cut_tiles(t, tile=tile), least)) == rows(K.components(t, min_size=least))


def test_the_spiral_is_one_component():
    assert spiral(23).sum() > 200


def test_labels_merge_over_long_chains():
    rng = np.random.default_rng(1)
    chain = rng.permutation(5000)
    label, root = T.merge_labels(chain[:-1], chain[1:])
    assert len(label) == 5000 and (root == 0).all()
    label, root = T.merge_labels(np.array([7, 9, 4, 30]), np.array([9, 12, 5, 30]))
    assert dict(zip(label.tolist(), root.tolist())) == {7: 7, 9: 7, 12: 7, 4: 4, 5: 4, 30: 30}


def test_null_and_empty_masks(spark):
    t = spark.createDataFrame([("a", 0, 2, 2, [1, None, 0, 1]), (None, 0, 2, 2, [1, 1, 1, 1]), ("e", 0, 0, 0, [])],
                              "case_id string, z int, h int, w int, pred array<int>")
    got = T.tiled_components(T.cut_tiles(t, tile=(1, 2)))
    assert sorted(((r.case_id, r.seed, r["size"]) for r in got.collect()), key=str) == sorted(
        [("a", 0, 1), ("a", 3, 1), (None, 0, 4)], key=str)


def test_plan_has_no_loop_and_one_group_per_frame(spark):
    t = slice_table(spark, ("a", np.zeros((2, 6, 6)), None, np.ones((2, 6, 6), int)))
    jobs = T.tiled_components(T.cut_tiles(t, tile=(2, 2)).withColumn("extra", F.lit(1)).drop("extra"))
    assert [(r.seed, r["size"]) for r in jobs.orderBy("z").collect()] == [(0, 36), (0, 36)]
