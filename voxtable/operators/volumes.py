"""Volumes as slice rows: ordering, boxes, subtraction, normalisation, cropping, resizing.

Pixel arrays stay in their slice row.  Only narrow per-case numbers are joined back, by
equi-joins whose strategy the planner picks by measured size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from voxtable.functions import arrays as A
from voxtable.functions import bits
from voxtable.operators.ordered import exact_percentiles, row_index

# Clip percentiles, crop margin, slab half-width, strip depth limits.
CLIP_PERCENTILES = (0.01, 0.99)
CROP_MARGIN = 16
SLAB = 12
STRIP_MIN, STRIP_MAX = 2, 41

Z_RUN = 16              # slices that share one list of box corners

BOX = ["z0", "z1", "y0", "y1", "x0", "x1"]


# ---- slices and voxels ------------------------------------------------------------------

def order_slices(files: DataFrame, key: str = "series_uid", instance: str = "instance") -> DataFrame:
    """Dense 0-based ``z`` from the instance number, compared as a number.

    A file without a usable number stops the job and names its series.
    """
    number = F.col(instance).try_cast("long")
    name = F.coalesce(F.col(key).cast("string"), F.lit("(no name)"))
    lost = F.raise_error(F.concat(F.lit("a file has no instance number in series "), name)).cast("long")
    n = files.withColumn("_i", F.coalesce(number, lost))
    return row_index(n, [key], "_i", out="z").withColumn("z", F.col("z").cast("int")).drop("_i")


def to_voxels(slices: DataFrame, **values: str) -> DataFrame:
    """One row per pixel; ``values`` maps output columns to array columns (``v="pixels"``)."""
    values = values or {"v": "pixels"}
    names = list(values)
    zipped = F.arrays_zip(*[F.col(values[n]).alias(n) for n in names])
    keep = [c for c in slices.columns if c not in values.values() and c not in ("h",)]
    out = slices.select(*keep, F.posexplode(zipped).alias("_i", "_s"))
    w = F.col("w")
    return out.select(*[c for c in keep if c != "w"], F.floor(F.col("_i") / w).cast("int").alias("y"),
                      F.pmod("_i", w).cast("int").alias("x"), *[F.col("_s")[n].alias(n) for n in names])


def to_slices(voxels: DataFrame, w: int, value: str = "v", out: str = "pixels") -> DataFrame:
    """Row-major arrays from voxels; a group is one slice, so its size is the frame's area."""
    pairs = F.array_sort(F.collect_list(F.struct((F.col("y") * w + F.col("x")).alias("i"), F.col(value).alias("v"))))
    return voxels.groupBy("case_id", "z").agg(
        (F.max("y") + 1).alias("h"), F.lit(w).alias("w"), F.transform(pairs, lambda s: s["v"]).alias(out))


def case_table(slices: DataFrame, *extra: Column) -> DataFrame:
    """Depth and frame size per case."""
    return slices.groupBy("case_id").agg(
        F.count(F.lit(1)).cast("int").alias("depth"), F.max("h").alias("h"), F.max("w").alias("w"), *extra)


# ---- boxes ------------------------------------------------------------------------------

def boxes_from_1based(boxes: DataFrame) -> DataFrame:
    """1-based inclusive bounds to 0-based half-open; a start of 0 is held at 0."""
    def start(c):
        return F.greatest(F.col(c) - 1, F.lit(0))
    return boxes.select("case_id", start("start_slice").alias("z0"), F.col("end_slice").alias("z1"),
                        start("start_row").alias("y0"), F.col("end_row").alias("y1"),
                        start("start_col").alias("x0"), F.col("end_col").alias("x1"))


def boxes_from_2d(boxes: DataFrame, depth: Column, margin: int = 2) -> DataFrame:
    """A box on one slice, extended by ``margin`` slices each way and clamped to the depth."""
    z = F.col("slice")
    return boxes.select("case_id", F.greatest(z - margin, F.lit(0)).alias("z0"),
                        F.least(z + 1 + margin, depth).alias("z1"),
                        F.col("y").alias("y0"), (F.col("y") + F.col("height")).alias("y1"),
                        F.col("x").alias("x0"), (F.col("x") + F.col("width")).alias("x1"))


def box_runs(boxes: DataFrame, cases: DataFrame) -> DataFrame:
    """Boxes as image-row runs ``(case_id, z, y, x0, x1)`` inside the frame.

    Runs that share a start are merged, so a slice has at most ``h * w`` of them whatever
    the number of boxes.
    """
    b = boxes.distinct().join(cases.select("case_id", "depth", "h", "w"), "case_id")
    b = b.select("case_id", F.greatest("z0", F.lit(0)).alias("z0"), F.least("z1", "depth").alias("z1"),
                 F.greatest("y0", F.lit(0)).alias("y0"), F.least("y1", "h").alias("y1"),
                 F.greatest("x0", F.lit(0)).alias("x0"), F.least("x1", "w").alias("x1"))
    b = b.where((F.col("z1") > F.col("z0")) & (F.col("y1") > F.col("y0")) & (F.col("x1") > F.col("x0")))
    b = b.select("case_id", F.explode(F.sequence("z0", F.col("z1") - 1)).alias("z"), "y0", "y1", "x0", "x1")
    b = b.select("case_id", "z", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"), "x0", "x1")
    return b.groupBy("case_id", "z", "y", "x0").agg(F.max("x1").alias("x1"))


@F.pandas_udf(ArrayType(IntegerType()))
def _paint(h: pd.Series, w: pd.Series, z: pd.Series, zs: pd.Series, ys: pd.Series, xs: pd.Series, steps: pd.Series) -> pd.Series:
    out = []
    for rows, cols, at, zz, y, x, step in zip(h, w, z, zs, ys, xs, steps):
        count = np.zeros((rows + 1, cols + 1), dtype=np.int64)
        if zz is not None:
            zz, y, x, step = (np.asarray(v, dtype=np.int64) for v in (zz, y, x, step))
            begun = zz <= at
            np.add.at(count, (np.minimum(y[begun], rows), np.minimum(x[begun], cols)), step[begun])
        # Two running sums turn the steps at the corners into the number of boxes over each pixel.
        out.append((count.cumsum(axis=0).cumsum(axis=1)[:rows, :cols] > 0).astype(np.int32).ravel())
    return pd.Series(out)


def corner_steps(boxes: DataFrame, frames: DataFrame, on: Sequence[str]) -> DataFrame:
    """``on, _zb, _steps``: boxes as steps of +1 and -1 at their corners, per run of ``Z_RUN`` slices.

    A box has eight corners in every run it reaches, whatever its size; equal corners are summed, so a run has no
    more of them than pixel corners.  ``frames`` bounds the boxes by ``depth, h, w`` per ``on``.
    """
    b = boxes.select(*on, *BOX).distinct().join(frames.select(*on, "depth", "h", "w"), list(on))
    b = b.select(*on, F.greatest("z0", F.lit(0)).alias("z0"), F.least("z1", "depth").alias("z1"),
                 F.greatest("y0", F.lit(0)).alias("y0"), F.least("y1", "h").alias("y1"),
                 F.greatest("x0", F.lit(0)).alias("x0"), F.least("x1", "w").alias("x1"))
    b = b.where((F.col("z1") > F.col("z0")) & (F.col("y1") > F.col("y0")) & (F.col("x1") > F.col("x0")))
    b = b.withColumn("_zb", F.explode(F.sequence(F.floor(F.col("z0") / Z_RUN), F.floor((F.col("z1") - 1) / Z_RUN))))
    base = F.col("_zb") * Z_RUN
    first, last = F.greatest(F.col("z0") - base, F.lit(0)), F.col("z1") - base
    corners = [F.struct(z.cast("int").alias("z"), F.col(y).cast("int").alias("y"), F.col(x).cast("int").alias("x"),
                        F.lit(sz * sy * sx).alias("s"))
               for z, sz in ((first, 1), (last, -1)) for y, sy in (("y0", 1), ("y1", -1)) for x, sx in (("x0", 1), ("x1", -1))]
    c = b.select(*on, "_zb", F.explode(F.array(*corners)).alias("_c")).where(F.col("_c.z") < Z_RUN)
    c = c.groupBy(*on, "_zb", "_c.z", "_c.y", "_c.x").agg(F.sum("_c.s").alias("s")).where(F.col("s") != 0)
    return c.groupBy(*on, "_zb").agg(F.collect_list(F.struct("z", "y", "x", "s")).alias("_steps"))


def paint_boxes(slices: DataFrame, boxes: DataFrame, out: str = "mask", on: Sequence[str] = ("case_id",)) -> DataFrame:
    """Mask of every slice: 1 where the pixel lies in any half-open box of the same ``on``."""
    on = list(on)
    frames = slices.groupBy(*on).agg((F.max("z") + 1).alias("depth"), F.max("h").alias("h"), F.max("w").alias("w"))
    steps = corner_steps(boxes, frames, on)
    joined = slices.withColumn("_zb", F.floor(F.col("z") / Z_RUN)).join(steps, [*on, "_zb"], "left")
    inside = F.pmod("z", F.lit(Z_RUN)).cast("int")
    painted = _paint(F.col("h").cast("int"), F.col("w").cast("int"), inside,
                     *[F.col(f"_steps.{c}") for c in ("z", "y", "x", "s")])
    kept = [c for c in slices.columns if c != out]
    return joined.withColumn(out, painted).select(*kept, out)


def pixels_in_boxes(slices: DataFrame, boxes: DataFrame, value: str = "pixels") -> DataFrame:
    """``case_id, z, y, x, v`` of the pixels inside any box: marked in their slice row, and only hits leave it."""
    s = paint_boxes(slices.select("case_id", "z", "h", "w", value), boxes, out="_in")
    hit = F.filter(F.transform(F.arrays_zip(F.col(value).alias("v"), F.col("_in").alias("m")),
                               lambda e, i: F.struct(i.alias("i"), e["v"].alias("v"), e["m"].alias("m"))), lambda e: e["m"] > 0)
    s = s.select("case_id", "z", "w", F.explode(hit).alias("_e"))
    return s.select("case_id", "z", F.floor(F.col("_e.i") / F.col("w")).cast("int").alias("y"),
                    F.pmod("_e.i", "w").cast("int").alias("x"), F.col("_e.v").alias("v"))


def voxels_in_boxes(voxels: DataFrame, boxes: DataFrame, cases: DataFrame) -> DataFrame:
    """Voxels inside any box: a range join on top of equal case, slice and image row.

    For tables that hold voxels only; slices are better served by :func:`pixels_in_boxes`, which moves no voxels.
    """
    runs = box_runs(boxes, cases).withColumnsRenamed({"case_id": "_c", "z": "_z", "y": "_y"})
    on = ((F.col("case_id") == F.col("_c")) & (F.col("z") == F.col("_z")) & (F.col("y") == F.col("_y"))
          & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")))
    return voxels.join(runs, on, "left_semi")


# ---- intensities ------------------------------------------------------------------------

def subtract_phases(pre: DataFrame, post: DataFrame) -> DataFrame:
    """``max(post - pre, 0)`` slice by slice; keys are ``(case_id, z)``."""
    p = pre.select("case_id", "z", F.col("pixels").alias("_pre"))
    return post.join(p, ["case_id", "z"]).withColumn(
        "pixels", A.clipped_difference("pixels", "_pre")).drop("_pre")


def intensity_stats(slices: DataFrame, low: float = CLIP_PERCENTILES[0],
                    high: float = CLIP_PERCENTILES[1], approximate: bool = False) -> DataFrame:
    """Clip levels of each case, and mean and population deviation after clipping."""
    if approximate:
        pct = (slices.select("case_id", F.explode("pixels").alias("_v")).groupBy("case_id")
               .agg(F.percentile_approx("_v", F.array(F.lit(low), F.lit(high)), F.lit(10_000)).alias("pct")))
    else:
        pct = exact_percentiles(slices, ["case_id"], "pixels", [low, high], is_array=True)
    levels = pct.select("case_id", F.get("pct", F.lit(0)).alias("lo"), F.get("pct", F.lit(1)).alias("hi"))
    part = slices.select("case_id", "pixels").join(levels, "case_id").select(
        "case_id", "lo", "hi", bits.clipped_moments(A.doubles("pixels"), "lo", "hi").alias("_m"))
    sums = part.groupBy("case_id").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"),
                                       *[F.sum(f"_m.{c}").alias(c) for c in ("n", "s1", "s2")])
    shift = F.col("s1") / F.col("n")
    return sums.select("case_id", "lo", "hi", ((F.col("lo") + F.col("hi")) / 2 + shift).alias("mean"),
                       F.sqrt(F.greatest(F.col("s2") / F.col("n") - shift * shift, F.lit(0.0))).alias("std"))


def normalise_intensity(slices: DataFrame, low: float = CLIP_PERCENTILES[0],
                        high: float = CLIP_PERCENTILES[1], approximate: bool = False) -> DataFrame:
    """Clip to the case's own percentiles, then standardise with the clipped mean and deviation."""
    stats = intensity_stats(slices, low, high, approximate)
    out = slices.join(stats, "case_id")
    return out.withColumn("pixels", A.standard_scores(
        "pixels", F.col("lo"), F.col("hi"), F.col("mean"), F.col("std"))).drop("lo", "hi", "mean", "std")


def display_window(slices: DataFrame, per: str = "stack") -> DataFrame:
    """Pixels as bytes 0..255; one window per case keeps brightness steady across slices."""
    lo, hi = CLIP_PERCENTILES
    if per == "slice":
        return slices.withColumn("shown", A.display_bytes(
            "pixels", A.percentile_of("pixels", lo), A.percentile_of("pixels", hi)))
    win = exact_percentiles(slices, ["case_id"], "pixels", [lo, hi], out="_w", is_array=True)
    out = slices.join(win, "case_id")
    return out.withColumn("shown", A.display_bytes(
        "pixels", F.get("_w", F.lit(0)), F.get("_w", F.lit(1)))).drop("_w")


def _highest(keys: Sequence[str], value: str):
    """Element-wise maximum of a stream of slices, one frame in memory."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, first = None, None
        for b in batches:
            first = b if first is None else first
            for a in b.column(value):
                frame = a.values.to_numpy(zero_copy_only=False)
                top = frame.copy() if top is None else np.fmax(top, frame)
        yield pa.RecordBatch.from_arrays(
            [*(first.column(c).slice(0, 1) for c in (*keys, "h", "w")), pa.array([top], pa.list_(pa.float64()))],
            names=[*keys, "h", "w", value])
    return fold


def projection(slices: DataFrame, value: str = "pixels", run: int = Z_RUN) -> DataFrame:
    """Maximum-intensity projection of each case as one frame ``case_id, h, w, value``.

    Runs of slices are folded first, then the runs of a case; frames are read one by one, so neither has to fit in memory.
    """
    s = slices.select("case_id", F.floor(F.col("z") / run).alias("_run"), "h", "w", F.col(value).cast("array<double>").alias(value))
    kind, of = slices.schema["case_id"].dataType.simpleString(), {c: slices.schema[c].dataType.simpleString() for c in "hw"}
    tail = f"h {of['h']}, w {of['w']}, {value} array<double>"
    runs = s.groupBy("case_id", "_run").applyInArrow(
        _highest(["case_id", "_run"], value), f"case_id {kind}, _run long, {tail}")
    return runs.drop("_run").groupBy("case_id").applyInArrow(_highest(["case_id"], value), f"case_id {kind}, {tail}")


def mip(slices: DataFrame, value: str = "pixels") -> DataFrame:
    """``case_id, y, x, v`` of :func:`projection`."""
    return to_voxels(projection(slices, value), v=value)


# ---- cropping and cutting ---------------------------------------------------------------

def roi(slices: DataFrame, margin: int = CROP_MARGIN) -> DataFrame:
    """Window around the mask of each case, half-open and clamped; the full frame when empty."""
    b = slices.select("case_id", "z", "h", "w", A.bounds("mask", "w").alias("_b"))
    hit = F.col("_b").isNotNull()
    g = b.groupBy("case_id").agg(
        F.min(F.when(hit, F.col("z"))).alias("za"), F.max(F.when(hit, F.col("z"))).alias("zb"),
        F.min("_b.y0").alias("ya"), F.max("_b.y1").alias("yb"),
        F.min("_b.x0").alias("xa"), F.max("_b.x1").alias("xb"),
        (F.max("z") + 1).alias("depth"), F.max("h").alias("_h"), F.max("w").alias("_w"))

    def lo(c):
        return F.coalesce(F.greatest(F.col(c) - margin, F.lit(0)), F.lit(0)).cast("int")

    def hi(c, size):
        return F.coalesce(F.least(F.col(c) + margin + 1, F.col(size)), F.col(size)).cast("int")
    return g.select("case_id", lo("za").alias("z0"), hi("zb", "depth").alias("z1"),
                    lo("ya").alias("y0"), hi("yb", "_h").alias("y1"),
                    lo("xa").alias("x0"), hi("xb", "_w").alias("x1"))


def crop_to_roi(slices: DataFrame, margin: int = CROP_MARGIN, window: DataFrame | None = None) -> DataFrame:
    """Slices cut to the window of :func:`roi`, with ``off_z, off_y, off_x`` of the cut.

    Pass ``window`` when it was computed from a cheaper table with the same masks.
    """
    s = slices.join(roi(slices, margin) if window is None else window, "case_id")
    s = s.where((F.col("z") >= F.col("z0")) & (F.col("z") < F.col("z1")))
    win = [F.col(c) for c in ("y0", "y1", "x0", "x1")]
    return (s.withColumns({"pixels": A.crop("pixels", "w", *win), "mask": A.crop("mask", "w", *win)})
            .withColumns({"z": F.col("z") - F.col("z0"), "h": F.col("y1") - F.col("y0"),
                          "w": F.col("x1") - F.col("x0")})
            .withColumnsRenamed({"z0": "off_z", "y0": "off_y", "x0": "off_x"}).drop("z1", "y1", "x1"))


def cut_slab(slices: DataFrame, cases: DataFrame, centre: str = "centre",
             slab: int = SLAB, slim: bool = True) -> tuple[DataFrame, DataFrame]:
    """Slices within ``slab`` of each case's centre, and the shifted case rows.

    A case whose centre lies outside its depth stops the job and is named.  Without ``slim`` all slices stay where they are and the
    centre is only pinned, unchecked, as the slice to report.
    """
    c = F.col(centre)
    if not slim:
        return slices, cases.withColumn("forced_slice", c).drop(centre)
    inside = (c >= 0) & (c < F.col("depth"))
    msg = F.concat(F.lit("the centre of "), F.col("case_id"), F.lit(", slice "), c.cast("string"),
                   F.lit(", is not among its "), F.col("depth").cast("string"), F.lit(" slices"))
    lo = F.when(inside, F.greatest(c - slab, F.lit(0))).otherwise(F.raise_error(msg).cast("int"))
    cut = cases.withColumn("_lo", lo).withColumn("_hi", F.least(c + slab + 1, F.col("depth")))
    s = slices.join(cut.select("case_id", "_lo", "_hi"), "case_id")
    s = (s.where((F.col("z") >= F.col("_lo")) & (F.col("z") < F.col("_hi")))
         .withColumn("z", F.col("z") - F.col("_lo")).drop("_lo", "_hi"))
    meta = cut.withColumns({
        "source_n_slices": F.col("off_z") + F.col("depth"), "forced_slice": c - F.col("_lo"),
        "off_z": F.col("off_z") + F.col("_lo"), "depth": F.col("_hi") - F.col("_lo"),
    }).drop("_lo", "_hi", centre)
    return s, meta


def to_full_frame(df: DataFrame, cases: DataFrame) -> DataFrame:
    """Shift ``best_slice`` and the box by the case's crop offset; prefer the source depth."""
    meta = cases.select("case_id", "off_z", "off_y", "off_x", "source_n_slices", "depth")
    out = df.join(meta, "case_id")
    return out.withColumns({
        "best_slice": F.col("best_slice") + F.col("off_z"),
        "full_x": F.col("box_x") + F.col("off_x"), "full_y": F.col("box_y") + F.col("off_y"),
        "n_slices": F.coalesce("source_n_slices", "depth"),
    }).drop("off_z", "off_y", "off_x", "source_n_slices", "depth")


# ---- resizing ---------------------------------------------------------------------------

def _axis(n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    src = np.maximum((np.arange(n_out) + 0.5) * n_in / n_out - 0.5, 0.0)
    lo = np.floor(src).astype(int)
    return lo, np.minimum(lo + 1, n_in - 1), src - lo


def bilinear(stack: np.ndarray, h: int, w: int) -> np.ndarray:
    """Half-pixel-centred bilinear resize of the last two axes, one axis at a time."""
    lo, hi, f = _axis(stack.shape[-2], h)
    rows = stack[..., lo, :] * (1 - f)[:, None] + stack[..., hi, :] * f[:, None]
    lo, hi, f = _axis(stack.shape[-1], w)
    return rows[..., lo] * (1 - f) + rows[..., hi] * f


def nearest(stack: np.ndarray, h: int, w: int) -> np.ndarray:
    ys = np.arange(h) * stack.shape[-2] // h
    xs = np.arange(w) * stack.shape[-1] // w
    return stack[..., ys[:, None], xs]


def _resizer(kind: str):
    how = {"bilinear": bilinear, "nearest": nearest}[kind]

    @F.pandas_udf(ArrayType(DoubleType()))
    def resize_array(it: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, h, w, th, tw in it:
            out = [None] * len(a)
            shapes = pd.DataFrame({"h": h, "w": w, "th": th, "tw": tw})
            for (ih, iw, oh, ow), at in shapes.groupby(["h", "w", "th", "tw"]).groups.items():
                for block in A.pixel_blocks(a.index.get_indexer(at), max(ih * iw, oh * ow)):
                    stack = np.stack([np.asarray(a.iloc[i], dtype=float) for i in block]).reshape(-1, ih, iw)
                    for i, row in zip(block, how(stack, oh, ow).reshape(len(block), -1)):
                        out[i] = row
            yield pd.Series(out, dtype=object)
    return resize_array


bilinear_array = _resizer("bilinear")
nearest_array = _resizer("nearest")


def resize(slices: DataFrame, size: int) -> DataFrame:
    """Slices at ``size x size``: bilinear pixels, nearest mask kept binary."""
    dims = [F.col("h").cast("int"), F.col("w").cast("int"), F.lit(size), F.lit(size)]
    out = slices.withColumn("pixels", bilinear_array("pixels", *dims))
    if "mask" in slices.columns:
        m = nearest_array(A.doubles("mask"), *dims)
        out = out.withColumn("mask", F.transform(m, lambda v: (v > 0.5).cast("int")))
    return out.withColumns({"h": F.lit(size), "w": F.lit(size)})


# ---- review strip -----------------------------------------------------------------------

def slice_strip(slices: DataFrame, cases: DataFrame, best: DataFrame,
                max_slices: int = STRIP_MAX, project: bool = False) -> DataFrame:
    """Windowed slices of shallow cases with their full-frame index and the scored one marked.

    ``best`` has ``(case_id, best_slice)`` in full-frame indexing.  Cases with one slice or
    more than ``max_slices`` have nothing to browse and are left out.  ``project`` adds a row per case with the
    maximum projection in the same window; its ``z`` and ``index`` are null and it is never marked.
    """
    meta = cases.where(F.col("depth").between(STRIP_MIN, max_slices)).select("case_id", "depth", "off_z")
    meta = meta.join(best.select("case_id", "best_slice"), "case_id").withColumn(
        "best_position", F.greatest(F.least(F.col("best_slice") - F.col("off_z"), F.col("depth") - 1), F.lit(0)))
    s = slices.join(meta, "case_id")
    win = exact_percentiles(s, ["case_id"], "pixels", list(CLIP_PERCENTILES), out="_w", is_array=True)
    rows = s.select("case_id", "z", "h", "w", F.col("pixels").cast("array<double>").alias("pixels"), "off_z", "best_position")
    if project:
        seen = projection(s).join(meta.select("case_id", "off_z", "best_position"), "case_id")
        rows = rows.unionByName(seen, allowMissingColumns=True)
    shown = rows.join(win, "case_id").withColumn("shown", A.display_bytes(
        "pixels", F.get("_w", F.lit(0)), F.get("_w", F.lit(1))))
    return shown.select("case_id", "z", "h", "w", "pixels", "best_position", "shown",
                        (F.col("z") + F.col("off_z")).alias("index"),
                        F.coalesce(F.col("z") == F.col("best_position"), F.lit(False)).alias("is_best"))
