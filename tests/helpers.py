"""Small slice tables from numpy arrays."""

import numpy as np

SCHEMA = "case_id string, z int, h int, w int, pixels array<double>, mask array<int>, pred array<int>"


def slice_rows(case, volume, mask=None, pred=None):
    volume = np.asarray(volume, float)
    depth, h, w = volume.shape
    mask = np.zeros(volume.shape, int) if mask is None else np.asarray(mask)
    pred = np.zeros(volume.shape, int) if pred is None else np.asarray(pred)
    return [(case, z, h, w, volume[z].ravel().tolist(), mask[z].ravel().tolist(), pred[z].ravel().tolist())
            for z in range(depth)]


def slice_table(spark, *cases):
    rows = [r for c in cases for r in slice_rows(*c)]
    return spark.createDataFrame(rows, SCHEMA)


def box(n, h, w, y0, y1, x0, x1):
    m = np.zeros((n, h, w), int)
    m[:, y0:y1, x0:x1] = 1
    return m
