"""Data-quality rules of volumes: broken contracts stop a write, smells only warn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxtable.functions import arrays as A

# Smallest full-frame side, first magnitude that overflows a half float,
# how many offending mask values are quoted, decimals of the slice fraction.
MIN_IN_PLANE = 128
HALF_FLOAT_LIMIT = 65520.0
QUOTED_VALUES = 8
FRACTION_DIGITS = 4


class VolumeContractError(ValueError):
    """A volume breaks a contract the later steps rely on."""


Z_RUN = 1024            # slices of a case that are reduced together first


def bad_number(v: Column) -> Column:
    """Whether a pixel is missing, no number, or too large for a half float."""
    return v.isNull() | F.isnan(v) | (F.abs(v) >= F.lit(HALF_FLOAT_LIMIT))


def odd_value(m: Column) -> Column:
    """Whether a mask value is missing or neither 0 nor 1."""
    return m.isNull() | ((m != 0) & (m != 1))


def array_size(c: str) -> Column:
    """Length of an array, -1 where there is none."""
    return F.when(F.col(c).isNull(), -1).otherwise(F.size(c))


def _smallest(values: Column) -> Column:
    """One value more than is quoted, to know whether there are others."""
    return F.slice(F.array_sort(F.array_distinct(values)), 1, QUOTED_VALUES + 1)


def case_checks(slices: DataFrame) -> DataFrame:
    """Everything the rules and the summaries need, per case, in one scan.

    Arrays are reduced inside their row, rows to runs of slices and runs to cases, so that a deep case is no task of its
    own. Missing pixels, masks, elements, sizes and slice numbers count as faults, never as sound.
    """
    finite = F.filter(A.doubles("pixels"), lambda v: ~bad_number(v))
    odd = F.coalesce(F.exists("mask", odd_value), F.lit(True))
    area = F.col("h").cast("long") * F.col("w")
    # All distinct values of a mask with an odd one are quoted, as text once they are sorted as numbers.
    values = F.when(odd & F.col("mask").isNotNull(), _smallest(F.col("mask"))).otherwise(F.slice("mask", 1, 0))
    s = slices.select(
        "case_id", "z", "h", "w", F.floor(F.col("z") / Z_RUN).alias("_run"),
        F.greatest(array_size("pixels"), F.lit(0)).cast("long").alias("np"),
        (~array_size("pixels").eqNullSafe(area)).alias("bad_shape"),
        (~array_size("mask").eqNullSafe(array_size("pixels"))).alias("bad_mask"),
        F.coalesce(F.size("pixels") - F.size(finite), F.lit(0)).cast("long").alias("bad"),
        F.array_min(finite).alias("lo"), F.array_max(finite).alias("hi"),
        F.coalesce(A.positive_count("mask"), F.lit(0)).alias("lesion"), odd.alias("odd"), values.alias("values"))
    runs = s.groupBy("case_id", "_run").agg(
        F.count(F.lit(1)).alias("depth"), F.count_distinct("z").alias("zs"), F.min("z").alias("zmin"), F.max("z").alias("zmax"),
        F.min("h").alias("h"), F.max("h").alias("hmax"), F.min("w").alias("w"), F.max("w").alias("wmax"),
        F.count_if("bad_shape").alias("bad_shape"), F.count_if("bad_mask").alias("bad_mask_shape"),
        F.sum("bad").alias("non_finite"), F.sum("np").alias("voxels"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.sum("lesion").alias("lesion_voxels"), F.count_if(F.col("lesion") > 0).alias("lesion_slices"),
        F.count_if("odd").alias("odd_slices"), _smallest(F.flatten(F.collect_list("values"))).alias("values"))
    fold = {**dict.fromkeys(("zmin", "h", "w", "lo"), F.min), **dict.fromkeys(("zmax", "hmax", "wmax", "hi"), F.max)}
    return runs.groupBy("case_id").agg(
        *[fold.get(c, F.sum)(c).alias(c) for c in runs.columns if c not in ("case_id", "_run", "values")],
        _smallest(F.flatten(F.collect_list("values"))).alias("values"))


def validate_volumes(slices: DataFrame, expect_full_frame: bool = True) -> DataFrame:
    """``(case_id, rule, severity, message)``, one row per finding.

    Per case only the first broken contract is reported; warnings are looked at when none is.
    """
    return findings(case_checks(slices), expect_full_frame)


def findings(checks: DataFrame, expect_full_frame: bool = True) -> DataFrame:
    """:func:`validate_volumes` from the result of :func:`case_checks`."""
    col = F.col
    name = F.concat(F.coalesce(col("case_id"), F.lit("(no name)")), F.lit(": "))
    shape = F.format_string("(%d, %d, %d)", col("depth"), col("hmax"), col("wmax"))

    def found(cond: Column, rule: str, severity: str, *message) -> Column:
        text = F.concat(name, *[F.lit(m) if isinstance(m, str) else m.cast("string") for m in message])
        return F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
                                     text.alias("message")))
    ragged = ((col("bad_shape") > 0) | (col("h") != col("hmax")) | (col("w") != col("wmax"))
              | (col("zmin") != 0) | (col("zmax") + 1 != col("depth"))
              | (col("zs") != col("depth")))
    ragged = F.coalesce(ragged, F.lit(True))
    empty = (col("depth") == 0) | (col("hmax") == 0) | (col("wmax") == 0)
    quoted = F.concat(
        F.lit("["), F.array_join(F.slice("values", 1, QUOTED_VALUES).cast("array<string>"), ", ", "null"), F.lit("]"),
        F.when(F.size("values") > QUOTED_VALUES, " ...").otherwise(""))
    contract = F.coalesce(
        found(ragged, "not_3d", "error", "slices are missing, repeated or differ in shape: ", shape),
        found(col("bad_mask_shape") > 0, "mask_shape", "error", "mask and pixels differ in size on ",
              col("bad_mask_shape"), " slice(s)"),
        found(empty, "empty_axis", "error", "nothing along an axis of ", shape),
        found(col("non_finite") > 0, "non_finite", "error", col("non_finite"), " of ",
              col("voxels"), " pixels are no usable numbers"),
        found(col("odd_slices") > 0, "mask_values", "error", "mask has values other than 0 and 1: ", quoted))
    small = F.lit(expect_full_frame) & (F.least("h", "w") < MIN_IN_PLANE)
    warnings = F.array_compact(F.array(
        found(col("hi") == col("lo"), "constant", "warning", "all pixels are equal"),
        found(small, "in_plane", "warning", "in-plane size is ", col("h"), "x", col("w"), ", below ",
              F.lit(MIN_IN_PLANE)),
        found(col("lesion_voxels") == 0, "empty_mask", "warning", "no pixel is marked")))
    rows = F.when(contract.isNotNull(), F.array(contract)).otherwise(warnings)
    return checks.select("case_id", F.explode(rows).alias("_r")).select("case_id", "_r.*")


def require_sound(report: DataFrame) -> DataFrame:
    """The report, if no contract is broken; else names a case."""
    broken = report.where(F.col("severity") == "error").orderBy("case_id").limit(1).collect()
    if broken:
        raise VolumeContractError(broken[0]["message"])
    return report


def require_valid(slices: DataFrame, expect_full_frame: bool = True) -> DataFrame:
    """The warnings of a valid set; raises and names a case when a contract is broken."""
    return require_sound(validate_volumes(slices, expect_full_frame))


def summaries(checks: DataFrame) -> DataFrame:
    """Shape, lesion voxels, lesion slices and their fraction per case, from the result of :func:`case_checks`."""
    part = F.bround(F.col("lesion_slices") / F.col("depth"), FRACTION_DIGITS)
    return checks.select("case_id", "depth", F.col("hmax").alias("h"), F.col("wmax").alias("w"), "lesion_voxels",
                         "lesion_slices", part.alias("lesion_slice_fraction"))


def summarise_volumes(slices: DataFrame) -> DataFrame:
    """:func:`summaries` of slices; pixels are not read."""
    s = slices.select("case_id", "h", "w", A.positive_count("mask").alias("n"))
    return summaries(s.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("depth"), F.max("h").alias("hmax"), F.max("w").alias("wmax"),
        F.sum("n").alias("lesion_voxels"), F.count_if(F.col("n") > 0).alias("lesion_slices")))
