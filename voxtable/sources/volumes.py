"""Volume tables on disk: prepared slices, the fixed-size slice bank and the run manifest."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Mapping
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxtable.functions import arrays as A
from voxtable.operators import quality as Q
from voxtable.operators.volumes import crop_to_roi, resize
from voxtable.session import move_path, path_exists, remove_path, stored

MANIFEST = "_manifest"      # hidden from readers of the slices beside it
CHECKS = "_checks"          # likewise
BANK_INDEX = "bank_index"
CONTRACT = "volume contract: "


def guarded(slices: DataFrame) -> DataFrame:
    """Slices whose pixels stop the job, naming the case, when a slice breaks a contract.

    These checks ride along with the write, so an expensive preparation runs once and a broken
    slice aborts it at once; those of whole cases follow on the written rows.
    """
    n = Q.array_size("pixels")
    bad = F.size(F.filter(A.doubles("pixels"), Q.bad_number))

    def stop(*message) -> Column:
        name = F.coalesce(F.col("case_id"), F.lit("(no name)"))
        text = F.concat(F.lit(CONTRACT), name, F.lit(": "), *[
            F.lit(m) if isinstance(m, str) else F.coalesce(m.cast("string"), F.lit("null")) for m in message])
        return F.raise_error(text).cast("array<float>")
    checked = (
        F.when(~n.eqNullSafe(F.col("h").cast("long") * F.col("w")), stop("slice ", F.col("z"), " has ", n, " pixels, not h times w"))
        .when(~Q.array_size("mask").eqNullSafe(n), stop("mask and pixels differ in size on slice ", F.col("z")))
        .when(n == 0, stop("nothing along an axis of slice ", F.col("z")))
        .when(bad > 0, stop(bad, " pixels of slice ", F.col("z"), " are no usable numbers"))
        .when(F.exists("mask", Q.odd_value),
              stop("mask has values other than 0 and 1: ",
                   F.slice(F.array_sort(F.array_distinct("mask")), 1, Q.QUOTED_VALUES)))
        .otherwise(F.col("pixels").cast("array<float>")))
    return slices.withColumn("pixels", checked)


def write_volumes(slices: DataFrame, path: str, crop: bool = True, mode: str = "error",
                  margin: int = 16) -> DataFrame:
    """Crop, check, cast and write slices; returns the warnings found in what was written.

    Raises :class:`~voxtable.operators.quality.VolumeContractError` on a broken contract.  The slices go to a folder
    beside ``path`` and take that name only when their cases are whole, so nothing broken is ever found there.
    What was written is scanned once; the numbers of every case are kept in the folder for the manifest.
    ``mode`` is ``error`` or ``overwrite``; what is overwritten is put aside first and goes when the new folder has its name.  Slices of a case go to the same files; the rebalance step splits a deep
    case and joins small ones, so files come out at the session's advisory size.
    """
    if mode not in ("error", "overwrite"):
        raise ValueError(f"mode {mode!r} is neither error nor overwrite")
    spark, path = slices.sparkSession, path.rstrip("/")
    if mode == "error" and path_exists(spark, path):
        raise FileExistsError(path)
    s = slices if "mask" in slices.columns else slices.withColumn("mask", F.transform("pixels", lambda v: F.lit(0)))
    if crop:
        s = crop_to_roi(s, margin)
    else:
        s = s.withColumns({c: F.lit(0) for c in ("off_z", "off_y", "off_x") if c not in s.columns})
    s = guarded(s).withColumn("mask", F.col("mask").cast("array<tinyint>"))
    side = f"{path}.unchecked-{uuid.uuid4().hex}"
    try:
        s.hint("rebalance", "case_id").write.parquet(side)
        Q.case_checks(read_volumes(spark, side)).write.parquet(f"{side}/{CHECKS}")
        Q.require_sound(Q.findings(spark.read.parquet(f"{side}/{CHECKS}"), expect_full_frame=not crop))
    except Exception as e:
        remove_path(spark, side)
        found = re.search(re.escape(CONTRACT) + r"([^\n]*)", str(e))
        if found:
            raise Q.VolumeContractError(found.group(1)) from e
        raise
    replace_path(spark, side, path)
    return Q.findings(read_checks(spark, path), expect_full_frame=not crop).where(F.col("severity") == "warning")


def replace_path(spark: SparkSession, new: str, path: str) -> None:
    """Give ``new`` the name ``path``; a folder of that name is put aside first, and back if that fails."""
    aside = f"{path}.replaced-{uuid.uuid4().hex}" if path_exists(spark, path) else None
    if aside:
        move_path(spark, path, aside)
    try:
        move_path(spark, new, path)
    except Exception:
        if aside:
            move_path(spark, aside, path)
        raise
    if aside:
        remove_path(spark, aside)


def read_checks(spark: SparkSession, path: str) -> DataFrame:
    """The numbers of every case as scanned after the write of ``path``."""
    return spark.read.parquet(f"{path.rstrip('/')}/{CHECKS}")


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


BANK_COLUMNS = ("case_id", "z", "h", "w", "pixels", "mask")


def _fingerprint(slices: DataFrame, sources: list[str]) -> str:
    """A digest of the source list and of all slices, in any order of rows."""
    row = [F.xxhash64(*BANK_COLUMNS, F.lit(seed)) for seed in (1, 2)]
    marks = slices.agg(F.count(F.lit(1)), *[F.bit_xor(h) for h in row]).first()
    return hashlib.sha256("\n".join([*sources, *map(str, marks)]).encode()).hexdigest()


def build_slice_bank(slices: DataFrame, path: str, sources: list[str], size: int = 256,
                     force: bool = False) -> bool:
    """Write all slices at ``size x size`` with ``has_lesion``; true when it (re)built.

    A finished bank of the same size, source list and slices is kept unless ``force``; that the slices are the same is seen
    from a digest of them, which costs one scan.  The index goes before a rebuild and is written after the slices, so a broken
    build is never taken for a finished one.
    """
    spark = slices.sparkSession
    index = f"{path}/{BANK_INDEX}"
    want = (size, _fingerprint(slices, sources))
    if not force and path_exists(spark, f"{index}/_SUCCESS"):
        have = spark.read.json(index).first()
        if (have["image_size"], have["slices_sha256"] if "slices_sha256" in have else None) == want:
            return False
    s = resize(slices.select(*BANK_COLUMNS, A.any_positive("mask").alias("has_lesion")), size)
    s = s.withColumns({"pixels": F.col("pixels").cast("array<float>"), "mask": F.col("mask").cast("array<tinyint>")})
    remove_path(spark, index)
    s.write.mode("overwrite").parquet(f"{path}/slices")
    row = {"image_size": size, "slices_sha256": want[1], "n_sources": len(sources)}
    spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()]).write.mode("overwrite").json(index)
    return True


def read_slice_bank(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/slices")


# ---- manifest ---------------------------------------------------------------------------

def portable(record: Mapping[str, Any], root: str) -> dict[str, Any]:
    """A record whose strings below ``root`` are given relative to it, with forward slashes; others stay.

    Works on the JSON text, so strings are found at any depth.
    """
    top = re.escape(json.dumps(root.rstrip("/\\"))[1:-1])
    below = re.compile(rf'"{top}(?:(?:/|\\\\)+([^"]*))?"')
    return json.loads(below.sub(lambda m: '"' + ((m[1] or "").replace("\\\\", "/") or ".") + '"', json.dumps(dict(record))))


def write_manifest(slices: DataFrame, path: str, source: str, parameters: Mapping[str, Any], root: str,
                   warnings: DataFrame | None = None, revision: str | None = None) -> str:
    """Describe a finished volume folder.  Call it after the data write: no manifest means no finished run.

    Per-case summaries come from the scan that followed the write, or from one scan of ``slices`` if the folder has none. They
    are written by the executors as one JSON line per case beside the run's own line, so the driver holds the parameters only.
    """
    spark = slices.sparkSession
    there = path_exists(spark, f"{path.rstrip('/')}/{CHECKS}/_SUCCESS")
    checks = read_checks(spark, path) if there else stored(Q.case_checks(slices), "checks")
    run = {"generated_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "revision": revision,
           **portable({"source": source, "output_dir": path, "parameters": dict(parameters)}, root)}
    cases = Q.summaries(checks)
    shape = F.array("depth", "h", "w").alias("shape")
    line = F.to_json(F.struct(F.lit("case").alias("kind"), "case_id", shape, "lesion_voxels", "lesion_slices",
                              "lesion_slice_fraction"))
    lines = cases.select(line.alias("value"))
    n_warn = F.lit(0).cast("long")
    if warnings is not None:
        n_warn = warnings.agg(F.count(F.lit(1))).scalar()
        lines = lines.unionByName(warnings.select(F.to_json(F.struct(
            F.lit("warning").alias("kind"), "case_id", "message")).alias("value")))
    head = spark.range(1).select(F.to_json(F.struct(
        F.lit("run").alias("kind"), F.lit(json.dumps(run)).alias("run"),
        cases.agg(F.count(F.lit(1))).scalar().alias("n_cases"), n_warn.alias("n_warnings"))).alias("value"))
    out = f"{path.rstrip('/')}/{MANIFEST}"
    lines.unionByName(head).write.mode("overwrite").text(out)
    return out


MANIFEST_SCHEMA = ("kind string, run string, n_cases long, n_warnings long, case_id string, shape array<long>, "
                   "lesion_voxels long, lesion_slices long, lesion_slice_fraction double, message string")


def read_manifest(spark: SparkSession, path: str) -> tuple[dict[str, Any], DataFrame] | None:
    """The run record and the per-case rows, or None for a folder whose run did not finish."""
    where = f"{path.rstrip('/')}/{MANIFEST}"
    if not path_exists(spark, f"{where}/_SUCCESS"):
        return None
    rows = spark.read.schema(MANIFEST_SCHEMA).json(where)
    head = rows.where(F.col("kind") == "run").first()
    run = {**json.loads(head["run"]), "n_cases": head["n_cases"], "n_warnings": head["n_warnings"]}
    return run, rows.where(F.col("kind") != "run").drop("run", "n_cases", "n_warnings")
