"""Case and cohort evaluation, ranking, localisation and curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxtable.functions import arrays as A
from voxtable.functions import numeric as N
from voxtable.functions.hashing import as_int, order_key
from voxtable.operators.components import centroid_inside, with_components
from voxtable.operators.ordered import (
    before_buckets, best_before, exact_percentiles, hash_index, rejoin, rolling_mean, row_index)
from voxtable.operators.overlap import plain_overlap
from voxtable.operators.volumes import bilinear_array
from voxtable.session import stored

CASE_METRICS = ["dice", "iou", "sensitivity_iou", "sensitivity_centroid"]
LOOKUP = 1 << 12            # positions of a group whose values one row holds while cases are drawn
HELD_VALUES = 1 << 23       # values that a bootstrap broadcasts, 64 MB
SCORE_BUCKETS = 1 << 20     # a unit of score near zero; buckets widen with the score, so none takes all large ones


# ---- cases and cohort -------------------------------------------------------------------

def slice_evaluation(slices: DataFrame, hit_iou: float = 0.1, min_component: int = 10,
                     pred: str = "pred", truth: str = "mask") -> DataFrame:
    """Per slice: overlap, both hit rules and the number of predicted components."""
    s = with_components(plain_overlap(slices, pred, truth), pred, "_c", min_component)
    s = s.withColumn("_box", A.bounds(truth, "w"))
    return s.withColumns({
        "positive": F.col("_box").isNotNull(),
        "hit_iou": F.col("iou") >= hit_iou,
        "hit_centroid": F.col("_box").isNotNull() & centroid_inside(F.col("_c"), F.col("_box")),
        "n_components": F.size("_c").cast("long"),
    }).drop("_c", "_box")


def evaluate_cases(slices: DataFrame, hit_iou: float = 0.1, min_component: int = 10,
                   pred: str = "pred", truth: str = "mask") -> DataFrame:
    """One row per case; overlap fields are null for a case without positive slices.

    Slices that carry ``seconds`` (see :func:`~voxtable.operators.scoring.score_slices`) give the case's scoring time.
    """
    time = [F.sum("seconds").alias("seconds")] if "seconds" in slices.columns else []
    s = slice_evaluation(slices, hit_iou, min_component, pred, truth)
    pos, neg = F.col("positive"), ~F.col("positive")

    def mean_if(c: Column) -> Column:
        return F.avg(F.when(pos, c.cast("double")))
    return s.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_slices"), F.count_if(pos).alias("n_positive_slices"),
        F.count_if(neg).alias("n_negative_slices"),
        mean_if(F.col("dice")).alias("dice"), mean_if(F.col("iou")).alias("iou"),
        mean_if(F.col("hit_iou")).alias("sensitivity_iou"),
        mean_if(F.col("hit_centroid")).alias("sensitivity_centroid"),
        F.count_if(neg & (F.col("n_components") > 0)).alias("fp_slices"),
        F.coalesce(F.sum(F.when(neg, F.col("n_components"))), F.lit(0)).alias("fp_components"), *time)


def micro_macro(slices: DataFrame, pred: str = "pred", truth: str = "mask") -> DataFrame:
    """Mean over positive slices against mean of the case means."""
    s = plain_overlap(slices, pred, truth).where(F.col("t_sum") > 0)
    per_case = s.groupBy("case_id").agg(
        *[f(c).alias(f"{c}_{n}") for c in ("dice", "iou") for n, f in (("sum", F.sum), ("avg", F.avg))],
        F.count(F.lit(1)).alias("n"))
    return per_case.agg(
        (F.sum("dice_sum") / F.sum("n")).alias("dice_micro"), (F.sum("iou_sum") / F.sum("n")).alias("iou_micro"),
        F.avg("dice_avg").alias("dice_macro"), F.avg("iou_avg").alias("iou_macro"))


def bootstrap_ci(df: DataFrame, value: str, key: str = "case_id", by: Sequence[str] = (),
                 resamples: int = 10_000, alpha: float = 0.05, seed: int = 0, held_values: int = HELD_VALUES) -> DataFrame:
    """Percentile bootstrap of the mean with whole cases as the resampling unit.

    Draw ``i`` of resample ``r`` takes the case at position ``hash(seed, r, i) mod n``, so the
    interval does not depend on partitioning.  Nulls and NaN are dropped first; a group
    without values keeps its row with ``n = 0``.  Up to ``held_values`` values of all groups are broadcast, eight
    bytes each; more are met by a shuffle of the draws.
    """
    by = list(by)
    flat = df.withColumn("_all", F.lit(0)) if not by else df
    k = by or ["_all"]
    clean = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    rows = flat.select(*k, F.col(key).alias("_k"), clean.alias("_v"))
    groups = rows.groupBy(*k).agg(F.avg("_v").alias("mean"), F.count("_v").alias("n"))
    vals = rows.where(F.col("_v").isNotNull()).withColumn("_h", order_key(seed, "_k"))
    vals = rejoin(hash_index(vals, k, "_h", out="_pos").select(*k, "_pos", "_v"), groups.select(*k, "n"), k)
    # Values of ``LOOKUP`` positions share a row, so what a draw looks up is as small as the numbers themselves.
    block = F.floor(F.col("_pos") / LOOKUP)
    vals = vals.groupBy(*k, "n", block.alias("_block")).agg(F.sort_array(F.collect_list(F.struct("_pos", "_v"))).alias("_a"))
    vals = stored(vals.select(*k, "n", "_block", F.transform("_a", lambda x: x["_v"]).alias("_a")), "resampled")
    # Draw (r, i) is hashed once and serves every group that has an i-th draw, whatever its size. All draws of a resample
    # come from one task, so a broadcast join needs no shuffle before the sums.
    sizes = F.sort_array(F.collect_set("n"))
    sizes = vals.agg(sizes.alias("s")).scalar()
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = df.sparkSession.range(0, resamples, 1, min(resamples, tasks)).select(F.col("id").alias("_r"), sizes.alias("_sizes"))
    most = F.array_max("_sizes")
    draws = draws.select("_r", "_sizes", F.explode(F.when(most > 0, F.sequence(F.lit(0).cast("long"), most - 1))).alias("_i"))
    draws = draws.select("_r", F.filter("_sizes", lambda s: s > F.col("_i")).alias("_sizes"),
                         as_int(order_key(seed, "_r", "_i")).alias("_h"))
    draws = draws.select("_r", "_h", F.explode("_sizes").alias("n")).select(
        "_r", "n", F.coalesce(F.pmod("_h", "n"), F.lit(-1)).alias("_pos"))
    draws = draws.select("_r", "n", F.floor(F.col("_pos") / LOOKUP).alias("_block"), (F.col("_pos") % LOOKUP).cast("int").alias("_at"))
    # The planner takes the draws for as few rows as there are resamples, so it is told which side is the small one.
    held = vals.agg(F.sum(F.size("_a"))).first()[0] or 0
    vals = F.broadcast(vals) if held <= held_values else vals.hint("merge")
    means = draws.join(vals, ["n", "_block"]).groupBy(*k, "_r").agg(F.avg(F.get("_a", "_at")).alias("_m"))
    ends = F.percentile("_m", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))   # over ``resamples`` means
    ci = means.groupBy(*k).agg(ends.alias("_e"))
    return (rejoin(groups, ci, k, "left")
            .select(*k, "mean", F.get("_e", F.lit(0)).alias("lo"), F.get("_e", F.lit(1)).alias("hi"), "n")
            .drop("_all"))


def cohort_report(cases: DataFrame, resamples: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Confidence interval of each case metric, one row per metric."""
    rate = F.when(F.col("n_negative_slices") > 0, F.col("fp_slices") / F.col("n_negative_slices"))
    wide = cases.select("case_id", *[F.col(c).cast("double").alias(c) for c in CASE_METRICS],
                        F.col("fp_components").cast("double").alias("fp_components_per_volume"),
                        rate.alias("fp_slice_rate"))
    names = [*CASE_METRICS, "fp_components_per_volume", "fp_slice_rate"]
    return bootstrap_ci(wide.unpivot("case_id", names, "metric", "value"), "value", by=["metric"],
                        resamples=resamples, alpha=alpha, seed=seed)


def cohort_timing(cases: DataFrame, seconds: str = "seconds") -> DataFrame:
    """Totals and scoring times of a cohort; ``seconds`` is measured by whoever scored it."""
    med = exact_percentiles(cases, [], seconds, [0.5], out="_p")
    return cases.agg(
        F.count(F.lit(1)).alias("n_patients"), F.sum("n_slices").alias("n_slices"),
        F.avg(seconds).alias("seconds_mean"), F.max(seconds).alias("seconds_max"),
        (1000 * F.sum(seconds) / F.sum("n_slices")).alias("ms_per_slice"),
    ).withColumn("seconds_median", med.select(F.get("_p", F.lit(0))).scalar())


# ---- ranking ----------------------------------------------------------------------------

def auc(df: DataFrame, keys: Sequence[str], label: str, score: str, out: str = "auc") -> DataFrame:
    """Area under the ROC curve per key with ties counted half; null when a class is absent.

    Rows are folded to distinct scores, and the negatives below each score are accumulated
    over score buckets, then inside a bucket.  Rows without score or label do not take part.
    """
    flat = df if keys else df.withColumn("_all", F.lit(0))
    k = list(keys) or ["_all"]
    value, truth = F.col(score).cast("double"), F.col(label)
    # Rows without score or label keep their key in the result, by a line without score that counts nothing.
    usable = value.isNotNull() & ~F.isnan(value) & truth.isNotNull()
    pos = truth.cast("double") == 1.0
    g = flat.groupBy(*k, F.when(usable, value).alias("_s")).agg(
        F.count_if(usable & pos).alias("_p"), F.count_if(usable & ~pos).alias("_n"))
    spread = F.signum("_s") * F.log1p(F.abs("_s"))                     # never decreases with the score
    g = g.withColumn("_b", F.coalesce(F.floor(spread * SCORE_BUCKETS), F.lit(0)))
    tot = before_buckets(g.groupBy(*k, "_b").agg(F.sum("_n").alias("_bn")), k, "_bn", "_below")
    inside = W.partitionBy(*k, "_b").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    g = rejoin(g, tot, [*k, "_b"]).withColumn(
        "_lower", F.col("_below") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    sums = g.groupBy(*k).agg(F.sum(F.col("_p") * (F.col("_lower") + F.col("_n") / 2)).alias("_w"),
                             F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    pairs = F.col("_p").cast("double") * F.col("_n")
    return sums.select(*k, F.when(pairs > 0, F.col("_w") / pairs).alias(out)).drop("_all")


def first_hit_rank(scores: DataFrame) -> DataFrame:
    """Rank of the best positive slice of each case by score, lower ``z`` first on ties.

    It is one plus the rows that beat that slice, so no case has to be sorted.
    """
    order = F.struct(F.col("score").alias("s"), (-F.col("z")).alias("z"))
    top = scores.where("has_lesion").groupBy("case_id").agg(F.max(order).alias("_top"))
    s = scores.select("case_id", "z", "score").join(top, "case_id")
    return s.groupBy("case_id").agg((F.count_if(order > F.col("_top")) + 1).alias("rank"))


def ranking_metrics(scores: DataFrame, k: int = 3) -> DataFrame:
    """Top-1, top-k, median rank and mean AUC over cases that have a positive slice.

    The exact median counts distinct ranks, at most as many as the deepest case has slices.
    """
    ranks = first_hit_rank(scores)
    areas = auc(scores, ["case_id"], "has_lesion", "score")
    return ranks.agg(
        F.count(F.lit(1)).alias("n_patients"),
        F.avg((F.col("rank") == 1).cast("double")).alias("top1"),
        F.avg((F.col("rank") <= k).cast("double")).alias(f"top{k}"),
        F.percentile("rank", F.lit(0.5)).alias("median_rank"),
    ).withColumn("auc", areas.agg(F.avg("auc")).scalar())


def best_slice(scores: DataFrame, cases: DataFrame | None = None, classifier: str | None = None) -> DataFrame:
    """The slice to report per case: pinned, else best classifier score, else best confidence."""
    rank_by = F.col(classifier or "score")
    best = scores.groupBy("case_id").agg(F.max_by("z", F.struct(rank_by, -F.col("z"))).alias("_z"))
    how = F.lit("classifier" if classifier else "segmentation_confidence")
    if cases is None or "forced_slice" not in cases.columns:
        return best.select("case_id", F.col("_z").alias("z"), how.alias("slice_selector"))
    pin = F.col("forced_slice")
    return best.join(cases.select("case_id", "forced_slice"), "case_id", "left").select(
        "case_id", F.coalesce(pin, "_z").alias("z"),
        F.when(pin.isNotNull(), "pinned").otherwise(how).alias("slice_selector"))


def localise(predictions: DataFrame, cases: DataFrame, threshold: float = 0.5,
             classifier: str | None = None) -> DataFrame:
    """One localisation record per case.

    ``predictions`` holds a probability map per slice at the model's size (``h, w, prob``) and
    ``cases`` the native frame (``h, w, depth``) with offsets.  Only the reported slice is
    brought to native size, so a detection can still have no box.  A pinned slice without a prediction
    stops the job and names the case.
    """
    score = predictions.select("case_id", "z", F.array_max("prob").alias("score"),
                               *([classifier] if classifier else []))
    pick = best_slice(score, cases, classifier)
    lost = F.raise_error(F.concat(F.lit("no prediction for the chosen slice "), F.col("z").cast("string"),
                                  F.lit(" of case "), F.col("case_id").cast("string")))
    win = pick.join(predictions.select("case_id", "z", "h", "w", "prob"), ["case_id", "z"], "left")
    win = win.withColumn("prob", F.coalesce("prob", lost.cast(predictions.schema["prob"].dataType)))
    meta = cases.select("case_id", F.col("h").alias("_h"), F.col("w").alias("_w"), "depth", "off_z",
                        "off_y", "off_x", "forced_slice", "source_n_slices")
    win = win.join(meta, "case_id")
    native = bilinear_array("prob", F.col("h").cast("int"), F.col("w").cast("int"),
                            F.col("_h").cast("int"), F.col("_w").cast("int"))
    conf = F.array_max("prob")
    win = win.withColumn("_n", native).withColumn("confidence", conf)
    win = win.withColumn("_box", F.when(F.col("confidence") >= threshold, A.box_xywh(
        A.bounds(A.at_least("_n", threshold), "_w"))))
    box = F.col("_box")
    full = F.when(box.isNotNull(), F.struct((box["x"] + F.col("off_x")).alias("x"),
                                            (box["y"] + F.col("off_y")).alias("y"), box["w"].alias("w"),
                                            box["h"].alias("h")))
    return win.select(
        "case_id", (F.col("confidence") >= threshold).alias("lesion_detected"),
        F.col("forced_slice").isNotNull().alias("slice_preselected"), "slice_selector", "confidence",
        (F.col("z") + F.col("off_z")).alias("best_slice"), box.alias("box"), full.alias("box_full_frame"),
        F.coalesce("source_n_slices", "depth").alias("n_slices"))


def curate_cases(slices: DataFrame, n: int = 3, pred: str = "pred", truth: str = "mask") -> DataFrame:
    """The ``n`` cases with the best IoU on the slice where their true mask is largest."""
    s = plain_overlap(slices, pred, truth).where(F.col("t_sum") > 0)
    top = s.groupBy("case_id").agg(F.max_by(F.struct("z", "iou", "t_sum"),
                                            F.struct("t_sum", -F.col("z"))).alias("_t"))
    return top.select("case_id", "_t.z", "_t.iou", "_t.t_sum").orderBy(F.desc("iou"), "case_id").limit(n)


# ---- curves -----------------------------------------------------------------------------

def smooth_curve(curves: DataFrame, run: str = "run", epoch: str = "epoch", value: str = "val_dice",
                 window: int = 3, width: int = 1 << 16) -> DataFrame:
    """Mean of the last ``window`` scored epochs, and whether it beats every earlier mean.

    Epochs whose value is NaN are not scored: they are left out and do not fill a window.
    """
    ok = curves.where(F.col(value).isNotNull() & ~F.isnan(value))
    seq = row_index(ok, [run], epoch, out="_i", width=width)
    sm = rolling_mean(seq, [run], "_i", value, window, out="smoothed", width=width)
    out = best_before(sm, [run], "_i", "smoothed", out="_prev", width=width)
    return out.withColumn("is_best", F.col("smoothed") > F.coalesce("_prev", F.lit(-1.0))).drop("_i", "_prev")


# ---- classifier metrics -----------------------------------------------------------------

def class_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction",
                  score: str | None = "score") -> DataFrame:
    """Accuracy, precision and recall of class 1, support-weighted F1, and ROC area.

    The confusion table (classes squared) is the only thing that is grouped.
    """
    conf = predictions.groupBy(F.col(label).cast("double").alias("l"),
                               F.col(prediction).cast("double").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = conf.select("n", F.explode(F.array(
        F.struct(F.col("l").alias("c"), F.lit(1).alias("s"), F.lit(0).alias("q"),
                 (F.col("l") == F.col("p")).cast("int").alias("t")),
        F.struct(F.col("p").alias("c"), F.lit(0).alias("s"), F.lit(1).alias("q"), F.lit(0).alias("t")))).alias("e"))
    per = sides.groupBy(F.col("e.c").alias("c")).agg(
        F.sum(F.col("n") * F.col("e.s")).alias("sup"), F.sum(F.col("n") * F.col("e.q")).alias("prd"),
        F.sum(F.col("n") * F.col("e.t")).alias("tp"))
    prec, rec = N.ratio_or_zero(F.col("tp"), F.col("prd")), N.ratio_or_zero(F.col("tp"), F.col("sup"))
    per = per.withColumns({"prec": prec, "rec": rec}).withColumn(
        "f1", N.ratio_or_zero(2 * F.col("prec") * F.col("rec"), F.col("prec") + F.col("rec")))
    one = F.col("c") == 1.0
    out = per.agg(
        (F.sum("tp") / F.sum("sup")).alias("accuracy"),
        F.coalesce(F.max(F.when(one, F.col("prec"))), F.lit(0.0)).alias("precision_1"),
        F.coalesce(F.max(F.when(one, F.col("rec"))), F.lit(0.0)).alias("recall_1"),
        (F.sum(F.col("f1") * F.col("sup")) / F.sum("sup")).alias("f1_weighted"))
    if score is None:
        return out
    return out.withColumn("roc_auc", auc(predictions, [], label, score).select("auc").scalar())
