"""Scalar helpers on double columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPS = 1e-6


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Round half up; ``+ 0`` turns a negative zero into a plain zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def clip(c: Column, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.greatest(F.least(c, hi), lo)


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def log_loss_from_logit(logit: Column, target: Column) -> Column:
    """Binary cross-entropy of a logit, in the form that cannot overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def dice_smooth(inter: Column, p: Column, t: Column, eps: float = EPS) -> Column:
    return (2.0 * inter + F.lit(eps)) / (p + t + F.lit(eps))


def iou_smooth(inter: Column, p: Column, t: Column, eps: float = EPS) -> Column:
    return (inter + F.lit(eps)) / (p + t - inter + F.lit(eps))


def dice_plain(inter: Column, p: Column, t: Column) -> Column:
    return ratio_or_zero(2.0 * inter, p + t)


def iou_plain(inter: Column, p: Column, t: Column) -> Column:
    return ratio_or_zero(inter.cast("double"), p + t - inter)


def tversky_smooth(tp: Column, p: Column, t: Column, alpha: float = 0.3, beta: float = 0.7,
                   eps: float = EPS) -> Column:
    """``(TP+e) / (TP + a*FP + b*FN + e)`` with FP = P - TP and FN = T - TP."""
    return (tp + eps) / (tp + alpha * (p - tp) + beta * (t - tp) + eps)


def percent_of(c: Column, whole: Column) -> Column:
    return F.bround(100.0 * c / whole, 2)
