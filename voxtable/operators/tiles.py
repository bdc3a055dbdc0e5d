"""Connected components of frames too large for one task: tiles are labelled alone, then joined at their borders.

1. Every tile labels its own components; a label is the flat index, in the whole frame, of the component's first pixel.
2. Tiles send the labels along their inner borders. Two labels that face each other across a border are the same component.
3. The pairs of a frame, distinct labels only, are merged by union-find; what is not merged keeps its label.
4. Sizes and coordinate sums are added per merged label.

That is one pass over the pixels and one shuffle of border pixels, whatever the shape of a component. A task holds a tile, and
one task per frame the label pairs of its inner borders, which grow with the border length and not with the area.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtable.functions import arrays as A
from voxtable.operators.components import label_stack
from voxtable.operators.ordered import rejoin

TILE = (512, 512)
FRAME = ["case_id", "z"]


def cut_tiles(slices: DataFrame, mask: str = "pred", tile: tuple[int, int] = TILE) -> DataFrame:
    """``case_id, z, h, w, y0, x0, th, tw, mask``: frames as tiles of at most ``tile`` pixels."""
    high, wide = tile
    s = slices.select(*FRAME, F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), F.col(mask).alias("mask"))
    for size, start, step in (("h", "y0", high), ("w", "x0", wide)):
        s = s.where(F.col(size) > 0).withColumn(start, F.explode(F.sequence(F.lit(0), F.col(size) - 1, F.lit(step))))
    s = s.withColumns({"th": F.least(F.col("h") - F.col("y0"), F.lit(high)), "tw": F.least(F.col("w") - F.col("x0"), F.lit(wide))})
    y, x = F.col("y0"), F.col("x0")
    return s.withColumn("mask", A.crop("mask", "w", y, y + F.col("th"), x, x + F.col("tw")))


def _label_tile(mask: np.ndarray, w: int, y0: int, x0: int) -> np.ndarray:
    """Frame-wide labels of a tile's pixels, -1 outside components."""
    local = label_stack(mask[None])[0].astype(np.int64)
    width = mask.shape[1]
    at = np.minimum(local, mask.size - 1)
    return np.where(mask, (y0 + at // width) * w + x0 + at % width, -1)


def _tile_parts(label: np.ndarray, h: int, w: int, y0: int, x0: int) -> tuple[dict, dict]:
    """Sums per label, and the labels along the borders the tile shares with others."""
    th, tw = label.shape
    y, x = np.nonzero(label >= 0)
    own, place, size = np.unique(label[y, x], return_inverse=True, return_counts=True)
    sums = {"label": own, "size": size.astype(np.int64),
            "sy": np.bincount(place, y, len(own)).astype(np.int64) + y0 * size,
            "sx": np.bincount(place, x, len(own)).astype(np.int64) + x0 * size}
    # Borders are named by direction (0 upright, 1 level) and by the coordinate behind them.
    lines = [(0, x0, label[:, 0], y0), (0, x0 + tw, label[:, -1], y0), (1, y0, label[0], x0), (1, y0 + th, label[-1], x0)]
    edges = {"way": [], "line": [], "at": [], "edge": []}
    for way, line, values, start in lines:
        if 0 < line < (w, h)[way]:
            on = np.flatnonzero(values >= 0)
            for name, column in (("way", np.full(len(on), way)), ("line", np.full(len(on), line)), ("at", on + start),
                                 ("edge", values[on])):
                edges[name].append(column.astype(np.int64))
    return sums, {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in edges.items()}


def _structs(rows: list[dict]) -> pa.Array:
    sizes = [len(next(iter(r.values()))) for r in rows]
    fields = {k: np.concatenate([r[k] for r in rows]) for k in rows[0]}
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
        [pa.array(v, pa.int64()) for v in fields.values()], names=list(fields)))


def label_tiles(tiles: DataFrame) -> DataFrame:
    """``case_id, z, parts, edges`` of every tile: its components, and the labels along inner borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                h, w, y0, x0, th, tw = (b.column(c)[i].as_py() for c in ("h", "w", "y0", "x0", "th", "tw"))
                values = b.column("mask")[i].values.to_numpy(zero_copy_only=False)
                mask = (np.nan_to_num(values.astype(float)) > 0).reshape(th, tw)
                sums, edges = _tile_parts(_label_tile(mask, w, y0, x0), h, w, y0, x0)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(i, 1) for c in FRAME), _structs([sums]), _structs([edges])],
                    names=[*FRAME, "parts", "edges"])

    keys = ", ".join(f"{c} {tiles.schema[c].dataType.simpleString()}" for c in FRAME)
    return tiles.select(*FRAME, "h", "w", "y0", "x0", "th", "tw", "mask").mapInArrow(
        run, f"{keys}, parts array<struct<label:bigint,size:bigint,sy:bigint,sx:bigint>>, "
             "edges array<struct<way:bigint,line:bigint,at:bigint,edge:bigint>>")


def merge_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(label, root)``: the least label that each label of the pairs is connected with."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[:len(a)], place[len(a):]
    parent = np.arange(len(nodes))
    while True:
        low, high = np.minimum(parent[x], parent[y]), np.maximum(parent[x], parent[y])
        if (low == high).all():
            return nodes, nodes[parent]
        np.minimum.at(parent, high, low)                  # hang roots on smaller ones,
        while (parent[parent] != parent).any():           # then let every label point to its root
            parent = parent[parent]


def _roots(edges: DataFrame) -> DataFrame:
    """``case_id, z, label, root`` of the labels that meet others across a border."""
    facing = edges.groupBy(*FRAME, "way", "line", "at").agg(F.min("edge").alias("a"), F.max("edge").alias("b"))
    pairs = facing.where(F.col("a") < F.col("b")).select(*FRAME, "a", "b").distinct()

    def run(table: pa.Table) -> pa.Table:
        label, root = merge_labels(table.column("a").to_numpy(), table.column("b").to_numpy())
        keys = {c: pa.array([table.column(c)[0].as_py()] * len(label), table.schema.field(c).type) for c in FRAME}
        return pa.table({**keys, "label": pa.array(label), "root": pa.array(root)})

    keys = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in FRAME)
    return pairs.groupBy(*FRAME).applyInArrow(run, f"{keys}, label long, root long")


def tiled_components(tiles: DataFrame, min_size: int = 1) -> DataFrame:
    """``case_id, z, seed, size, cy, cx`` per 4-connected component of frames given as tiles (see :func:`cut_tiles`).

    ``seed`` is the component's first pixel row-major, as a flat index into the frame.
    """
    labelled = label_tiles(tiles)
    parts = labelled.select(*FRAME, F.explode("parts").alias("_p")).select(*FRAME, "_p.*")
    edges = labelled.select(*FRAME, F.explode("edges").alias("_e")).select(*FRAME, "_e.*")
    named = rejoin(parts, _roots(edges), [*FRAME, "label"], "left").withColumn("seed", F.coalesce("root", "label"))
    whole = named.groupBy(*FRAME, "seed").agg(F.sum("size").alias("size"), F.sum("sy").alias("sy"), F.sum("sx").alias("sx"))
    return whole.where(F.col("size") >= min_size).select(
        *FRAME, "seed", "size", (F.col("sy") / F.col("size")).alias("cy"), (F.col("sx") / F.col("size")).alias("cx"))
