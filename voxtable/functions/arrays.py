"""Row-local functions over row-major pixel arrays.

They stay inside one slice row, so none of them moves data between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, functions as F

from voxtable.functions.numeric import clip

PIXEL_BUDGET = 1 << 21      # pixels that an Arrow function stacks at once, whatever the session's batch size


def pixel_blocks(positions, pixels: int, budget: int = PIXEL_BUDGET) -> Iterator[np.ndarray]:
    """``positions`` in runs of at most ``budget`` pixels, one slice of ``pixels`` at least."""
    positions = np.asarray(positions)
    step = max(1, budget // max(1, int(pixels)))
    for a in range(0, len(positions), step):
        yield positions[a:a + step]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    A column captured by a lambda is evaluated again for every element, which would make a
    per-pixel function quadratic; a lambda variable is only read.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(a: Column | str) -> Column:
    return _c(a).cast("array<double>")


def total(a: Column | str) -> Column:
    return F.aggregate(doubles(a), F.lit(0.0), lambda s, v: s + v)


def product_sum(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def positive_count(a: Column | str) -> Column:
    return F.size(F.filter(_c(a), lambda v: v > 0)).cast("long")


def any_positive(a: Column | str) -> Column:
    return F.exists(_c(a), lambda v: v > 0)


def at_least(a: Column | str, threshold: float) -> Column:
    """Mask of ``value >= threshold``; the detection rule."""
    return F.transform(_c(a), lambda v: (v >= F.lit(threshold)).cast("int"))


def above(a: Column | str, threshold: float) -> Column:
    """Mask of ``value > threshold``; the rule used when scoring a training epoch."""
    return F.transform(_c(a), lambda v: (v > F.lit(threshold)).cast("int"))


def clipped_difference(post: Column | str, pre: Column | str) -> Column:
    """``max(post - pre, 0)`` per pixel."""
    return F.zip_with(doubles(post), doubles(pre), lambda a, b: F.greatest(a - b, F.lit(0.0)))


def union_masks(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: F.greatest(x, y))


def _rows(a: Column, h: Column, w: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), h - 1), lambda y: F.slice(a, (y * w + 1).cast("int"), w))


def image_rows(a: Column | str, h: Column | str, w: Column | str) -> Column:
    """``array<array<..>>``: one inner array per image row."""
    return let(_c(a), lambda v: _rows(v, _c(h), _c(w)))


def flip_horizontal(a: Column | str, h: Column | str, w: Column | str) -> Column:
    return F.flatten(F.transform(image_rows(a, h, w), lambda r: F.reverse(r)))


def flip_vertical(a: Column | str, h: Column | str, w: Column | str) -> Column:
    return F.flatten(F.reverse(image_rows(a, h, w)))


def crop(a: Column | str, w: Column | str, y0: Column, y1: Column, x0: Column, x1: Column) -> Column:
    """Half-open window ``[y0, y1) x [x0, x1)`` of a row-major image."""
    w = _c(w)
    return let(_c(a), lambda v: F.flatten(F.transform(
        F.sequence(y0, y1 - 1),
        lambda y: F.slice(v, (y * w + x0 + 1).cast("int"), (x1 - x0).cast("int")))))


def gamma_curve(a: Column | str, gamma: Column) -> Column:
    """Power curve applied on the slice's own min-max range; the range itself is kept."""
    def curve(v):
        lo, hi = F.array_min(v), F.array_max(v)
        args = F.struct(lo.alias("lo"), F.greatest(hi - lo, F.lit(1e-6)).alias("span"), gamma.alias("g"))
        return let(args, lambda p: F.transform(
            v, lambda e: F.pow(clip((e - p["lo"]) / p["span"], 0.0, 1.0), p["g"]) * p["span"] + p["lo"]))
    return let(doubles(a), curve)


def percentile_of(a: Column | str, q: float) -> Column:
    """Exact percentile of one array with linear interpolation between order statistics."""
    def pick(s):
        pos = F.lit(float(q)) * (F.size(s) - 1)
        lo, hi = F.floor(pos).cast("int"), F.ceil(pos).cast("int")
        return F.get(s, lo) + (F.get(s, hi) - F.get(s, lo)) * (pos - lo)
    return let(F.array_sort(doubles(a)), pick)


def display_bytes(a: Column | str, lo: Column, hi: Column) -> Column:
    """Stretch ``[lo, hi]`` to 0..255 and truncate."""
    args = F.struct(lo.alias("lo"), F.greatest(hi - lo, F.lit(1e-6)).alias("span"))
    return let(args, lambda p: F.transform(
        doubles(a), lambda v: (clip((v - p["lo"]) / p["span"], 0.0, 1.0) * 255).cast("int")))


def standard_scores(a: Column | str, lo: Column, hi: Column, mean: Column, std: Column) -> Column:
    """``(clip(v) - mean) / (std + 1e-8)`` for every pixel."""
    args = F.struct(lo.alias("lo"), hi.alias("hi"), mean.alias("m"), (std + F.lit(1e-8)).alias("s"))
    return let(args, lambda p: F.transform(
        doubles(a), lambda v: (clip(v, p["lo"], p["hi"]) - p["m"]) / p["s"]))


def bounds(mask: Column | str, w: Column | str) -> Column:
    """Inclusive ``(y0, x0, y1, x1)`` of the positive pixels of one slice, null when empty."""
    w = _c(w)
    on = F.array_compact(F.transform(_c(mask), lambda v, i: F.when(v > 0, i)))

    def box(at):
        return F.when(F.size(at) > 0, let(
            F.transform(at, lambda i: F.pmod(i, w)),
            lambda cols: F.struct(
                F.floor(F.get(at, F.lit(0)) / w).cast("int").alias("y0"),
                F.array_min(cols).cast("int").alias("x0"),
                F.floor(F.element_at(at, -1) / w).cast("int").alias("y1"),
                F.array_max(cols).cast("int").alias("x1"))))
    return let(on, box)


def box_xywh(b: Column) -> Column:
    """``(x, y, w, h)`` with inclusive width from :func:`bounds`."""
    return F.when(b.isNotNull(), F.struct(
        b["x0"].alias("x"), b["y0"].alias("y"),
        (b["x1"] - b["x0"] + 1).alias("w"), (b["y1"] - b["y0"] + 1).alias("h")))
