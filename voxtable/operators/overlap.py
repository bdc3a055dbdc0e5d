"""Overlap of predicted and true masks, hard and soft.

Every per-slice number is computed inside the slice row; only the averages shuffle, after a
partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voxtable.functions import arrays as A
from voxtable.functions import numeric as N


def masses(slices: DataFrame, pred: str = "pred", truth: str = "mask") -> DataFrame:
    """Adds ``inter``, ``p_sum`` and ``t_sum``; works for masks and for probabilities."""
    return slices.withColumns({"inter": A.product_sum(pred, truth), "p_sum": A.total(pred),
                               "t_sum": A.total(truth)})


def _ipt() -> tuple[Column, Column, Column]:
    return F.col("inter"), F.col("p_sum"), F.col("t_sum")


def overlap(slices: DataFrame, pred: str = "pred", truth: str = "mask", eps: float = N.EPS) -> DataFrame:
    """Per-slice Dice and IoU with ``eps`` in both terms (empty against empty scores 1)."""
    return masses(slices, pred, truth).withColumns(
        {"dice": N.dice_smooth(*_ipt(), eps), "iou": N.iou_smooth(*_ipt(), eps)})


def plain_overlap(slices: DataFrame, pred: str = "pred", truth: str = "mask") -> DataFrame:
    """Per-slice Dice and IoU without ``eps`` (an empty denominator scores 0)."""
    return masses(slices, pred, truth).withColumns(
        {"dice": N.dice_plain(*_ipt()), "iou": N.iou_plain(*_ipt())})


def pooled_scores(slices: DataFrame, by: Sequence[str] = (), pred: str = "pred", truth: str = "mask",
                  eps: float = N.EPS, ignore_empty: bool = True) -> DataFrame:
    """``dice_sum, iou_sum, count`` and their means, which are null when nothing is scored."""
    s = overlap(slices, pred, truth, eps)
    keep = F.col("t_sum") > 0 if ignore_empty else F.lit(True)
    out = s.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(keep, F.col("dice"))), F.lit(0.0)).alias("dice_sum"),
        F.coalesce(F.sum(F.when(keep, F.col("iou"))), F.lit(0.0)).alias("iou_sum"),
        F.count_if(keep).alias("count"))
    n = F.col("count")
    return out.withColumns({"dice": F.when(n > 0, F.col("dice_sum") / n),
                            "iou": F.when(n > 0, F.col("iou_sum") / n)})


def merge_scores(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pool partial ``dice_sum, iou_sum, count`` rows; equal to scoring everything at once."""
    out = parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("dice_sum", "iou_sum", "count")])
    n = F.col("count")
    return out.withColumns({"dice": F.when(n > 0, F.col("dice_sum") / n),
                            "iou": F.when(n > 0, F.col("iou_sum") / n)})


def tversky(slices: DataFrame, by: Sequence[str] = (), prob: str = "prob", truth: str = "mask",
            alpha: float = 0.3, beta: float = 0.7, gamma: float = 0.75, eps: float = N.EPS) -> DataFrame:
    """Mean Tversky index per group, and its focal form taken after that mean."""
    s = masses(slices, prob, truth)
    out = s.groupBy(*by).agg(F.avg(N.tversky_smooth(*_ipt(), alpha, beta, eps)).alias("tversky"))
    return out.withColumn("focal_tversky", F.pow(F.greatest(1.0 - F.col("tversky"), F.lit(eps)), F.lit(gamma)))


def soft_losses(slices: DataFrame, by: Sequence[str] = (), logit: str = "logit", truth: str = "mask",
                bce_weight: float = 0.5, eps: float = N.EPS) -> DataFrame:
    """Cross-entropy over all pixels, mean soft Dice over slices, and their blend."""
    losses = F.zip_with(A.doubles(logit), A.doubles(truth), N.log_loss_from_logit)
    s = slices.withColumn("_prob", F.transform(A.doubles(logit), N.sigmoid)).withColumn("_bce", A.total(losses))
    s = masses(s, "_prob", truth)
    out = s.groupBy(*by).agg(
        (F.sum("_bce") / F.sum(F.size(logit))).alias("bce"),
        F.avg(N.dice_smooth(*_ipt(), eps)).alias("soft_dice"))
    return out.withColumn("loss", bce_weight * F.col("bce") + (1.0 - bce_weight) * (1.0 - F.col("soft_dice")))


def bounding_box(slices: DataFrame, mask: str = "mask", style: str = "xywh") -> DataFrame:
    """Box of each slice as ``x, y, w, h`` (inclusive width) or ``r0, c0, r1, c1``; empty slices drop out."""
    b = slices.select("case_id", "z", A.bounds(mask, "w").alias("_b")).where(F.col("_b").isNotNull())
    if style == "xywh":
        return b.select("case_id", "z", A.box_xywh(F.col("_b")).alias("_x")).select("case_id", "z", "_x.*")
    return b.select("case_id", "z", F.col("_b.y0").alias("r0"), F.col("_b.x0").alias("c0"),
                    F.col("_b.y1").alias("r1"), F.col("_b.x1").alias("c1"))
