"""Choosing series and annotations from catalogue tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from voxtable.functions.text import contains_text, parse_histology_name, phase_rank
from voxtable.operators.ordered import running_sum

# Modalities that carry segmentations.
SEGMENTATION_MODALITIES = ("SEG", "RTSTRUCT")


def not_existing(series: DataFrame, existing: DataFrame, key: str = "series_uid") -> DataFrame:
    """Rows whose key is not stored yet."""
    return series.join(existing.select(key), key, "left_anti")


def annotated_only(series: DataFrame, boxes: DataFrame, key: str = "patient_id") -> DataFrame:
    """Rows of patients that occur in the annotation table."""
    return series.join(boxes.select(key).distinct(), key, "left_semi")


def first_patients(df: DataFrame, n: int, order: str | None = None,
                   key: str = "patient_id") -> DataFrame:
    """The first ``n`` keys by first appearance along ``order``, or by key when it is None."""
    if order is None:
        return df.select(key).distinct().orderBy(key).limit(n)
    seen = df.groupBy(key).agg(F.min(order).alias("_first"))
    return seen.orderBy("_first", key).limit(n).select(key)


def within_budget(df: DataFrame, order: str, size: str, max_bytes: int, used_bytes: int = 0,
                  width: int | None = None) -> DataFrame:
    """Rows in order while the bytes used before the row stay below the cap.

    The row that crosses the cap is still taken.
    """
    room = max_bytes - used_bytes
    kw = {"width": width} if width else {}
    return (running_sum(df, [], order, size, "_used", before=True, stop_at=room, **kw)
            .where(F.col("_used") < F.lit(room)).drop("_used"))


def select_series(series: DataFrame, existing: DataFrame | None = None, boxes: DataFrame | None = None,
                  text: str | None = None, modalities: Sequence[str] | None = None,
                  max_bytes: int | None = None, max_rows: int | None = None,
                  max_patients: int | None = None, order_by: str = "series_no",
                  used_bytes: int = 0) -> DataFrame:
    """Which series to fetch: filters, annotation and storage checks, then the budgets."""
    out = series
    if max_patients is not None:
        # Patients come from the annotation table; without an order of its own, its ids decide.
        source = series if boxes is None else boxes
        order = order_by if boxes is not None and order_by in boxes.columns else None
        out = out.join(first_patients(source, max_patients, order), "patient_id", "left_semi")
    if boxes is not None:
        out = annotated_only(out, boxes)
    if text is not None:
        out = out.where(contains_text("description", text))
    if modalities is not None:
        out = out.where(F.col("modality").isin(list(modalities)))
    if existing is not None:
        out = not_existing(out, existing)
    if max_bytes is not None:
        out = within_budget(out, order_by, "size_bytes", max_bytes, used_bytes)
    if max_rows is not None:
        out = out.orderBy(order_by).limit(max_rows)
    return out


def segmentations_of(catalogue: DataFrame, stored: DataFrame, existing: DataFrame | None = None,
                     modalities: Sequence[str] = SEGMENTATION_MODALITIES) -> DataFrame:
    """Segmentation series that share a study with any stored series.

    A semi join: each segmentation comes out once, however many series its study has.
    """
    segs = catalogue.where(F.col("modality").isin(list(modalities)))
    segs = segs.join(stored.select("study_uid").distinct(), "study_uid", "left_semi")
    return not_existing(segs, existing) if existing is not None else segs


def group_phases(series: DataFrame) -> DataFrame:
    """``(patient_id, rank, folder)``; the last folder by name wins a repeated rank."""
    ranked = series.withColumn("rank", phase_rank("description"))
    return (ranked.where(F.col("rank").isNotNull() & F.col("patient_id").isNotNull())
            .groupBy("patient_id", "rank").agg(F.max("folder").alias("folder")))


def phase_map(phases: DataFrame) -> DataFrame:
    """One row per patient with a ``rank -> folder`` map (at most ten ranks)."""
    return phases.groupBy("patient_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("rank", "folder")))).alias("phases"))


def pair_phases(phases: DataFrame, post_rank: int = 2) -> DataFrame:
    """Baseline and chosen pass per patient, with the skip reason when one is absent."""
    def pick(r):
        return F.max(F.when(F.col("rank") == r, F.col("folder")))
    out = phases.groupBy("patient_id").agg(pick(0).alias("pre_folder"), pick(post_rank).alias("post_folder"))
    return out.withColumn("reason", F.when(
        F.col("pre_folder").isNull() | F.col("post_folder").isNull(), "missing_phase"))


def box_groups(boxes: DataFrame) -> DataFrame:
    """Boxes folded to one row per patient and view."""
    b = boxes.where(F.col("patient_id").isNotNull()).withColumn("view_key", F.lower("view"))
    return b.where(F.col("view_key") != "").groupBy("patient_id", "view_key").agg(
        F.count(F.lit(1)).alias("n_boxes"),
        F.min("slice").alias("first_slice"), F.max("slice").alias("last_slice"),
        F.sum((F.col("width") * F.col("height")).cast("long")).alias("box_area"))


def match_boxes(series: DataFrame, boxes: DataFrame, skip_empty: bool = True) -> DataFrame:
    """Series with what the boxes of their patient and view amount to.

    Boxes are folded per (patient, view) first, so a busy key does not multiply rows.
    """
    out = series.join(box_groups(boxes), ["patient_id", "view_key"], "inner" if skip_empty else "left")
    return out.withColumn("n_boxes", F.coalesce("n_boxes", F.lit(0)))


def image_catalogue(names: DataFrame, name: str = "name") -> DataFrame:
    """Parsed histology names; names with too few parts are dropped."""
    return (names.withColumn("_p", parse_histology_name(name)).where(F.col("_p").isNotNull())
            .select("*", "_p.*").drop("_p"))


def catalogue_summary(catalogue: DataFrame) -> DataFrame:
    return catalogue.agg(
        F.count(F.lit(1)).alias("n_images"),
        F.count_if(F.col("is_benign")).alias("n_benign"),
        F.count_if(~F.col("is_benign")).alias("n_malignant"),
        F.count_distinct("tumor_type").alias("n_tumor_types"),
        F.count_distinct("patient_id").alias("n_patients"))
