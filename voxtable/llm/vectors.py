"""Exact top-k inner products with multi-resolution segment statistics.

A vector is cut into segments at two resolutions. For segments of width w with means m and deviations s,
``|q - x|^2 >= sum w ((m_q - m_x)^2 + (s_q - s_x)^2)``, and with the norms known this is the upper bound
``q . x <= sum w (m_q m_x + s_q s_x)`` on the inner product. Bounds are taken coarse to fine against the k-th best exact
score so far; only survivors get their exact product.

Queries and candidates are packed in blocks of bounded size; each pair of blocks is one row of an equi-join on the
query block, and yields at most k rows per query, which a window then merges. The queries are a stated set against all
rows.

Vectors that are null, or hold null or non-finite components, take no part. Vectors of different lengths are not
compared. Repeated rows are candidates each; a repeated query id asks once, with its smallest vector; a candidate with
the query's own id is left out. Products beyond 64 bits are held at the limits of ``long``. Only the id and the vector are read,
so other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtable.llm.common import parts_for, stored

QUERY_BLOCK, ROW_BLOCK = 1024, 8192
LEVELS = (8, 32)            # segments per vector, coarse to fine
FIRST = 4                   # candidates per query looked at to start, times k


def clean_vectors(df: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """``id, v``: floor(scale * component) of the vectors that take part."""
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite)
            .select(F.col(key).cast("long").alias("id"),
                    F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v")))


def _summary(x: np.ndarray, segments: int) -> np.ndarray:
    """Root-width-scaled means and deviations of the segments, so that a dot product of two rows is the bound."""
    if x.shape[1] == 0:
        return np.zeros((len(x), 1))
    out = []
    for part in np.array_split(x, min(segments, x.shape[1]), axis=1):
        w = part.shape[1] ** 0.5
        out += [part.mean(axis=1) * w, part.std(axis=1) * w]
    return np.stack(out, axis=1)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of one query with rows."""
    top = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, len(q))
    if top < 2 ** 53:
        return (x @ q).astype(np.int64)
    low, high = -2 ** 63, 2 ** 63 - 1
    ints = [int(c) for c in q]
    return np.array([min(high, max(low, sum(a * int(b) for a, b in zip(ints, row)))) for row in x], np.int64)


def best_in_block(qid, q, cid, x, k) -> list[tuple[int, int, int]]:
    """``(query, candidate, score)`` of the k best candidates of every query, ties to the smaller id."""
    found, order = [], np.argsort(cid, kind="stable")
    cid, x = cid[order], x[order]
    coarse, fine = ((_summary(q, n), _summary(x, n)) for n in LEVELS)
    bound = coarse[0] @ coarse[1].T
    slack = 1 + 1e-9 * (1 + np.abs(bound).max(initial=0))
    start = min(len(cid), FIRST * k)
    for i in range(len(qid)):
        own = cid != qid[i]
        first = np.argpartition(-bound[i], start - 1)[:start]
        first = first[own[first]]
        seen = _exact(q[i], x[first])
        floor = np.sort(seen)[-k] if len(seen) >= k else None
        left = own if floor is None else own & (bound[i] + slack >= floor)
        rows = np.flatnonzero(left)
        if floor is not None:
            rows = rows[fine[1][rows] @ fine[0][i] + slack >= floor]
        scores = _exact(q[i], x[rows])
        top = np.lexsort((cid[rows], ~scores))[:k] if len(rows) else []
        found += [(int(qid[i]), int(cid[rows[j]]), int(scores[j])) for j in top]
    return found


def _blocks(rows: DataFrame, count: int, size: int, name: str) -> DataFrame:
    """``name, dim, ids, rows``: vectors of one length packed by hash of the id, and in runs of ``size`` at most."""
    block = F.pmod(F.xxhash64("id"), F.lit(parts_for(count, size))).cast("int")
    keyed = rows.withColumn(name, block).withColumn("dim", F.size("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, dim = b.column(name).to_numpy(), b.column("dim").to_numpy()
            ids = b.column("id").to_numpy()
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(dim, dtype=np.int64)])
            pair = block.astype(np.int64) << 32 | dim
            cuts = [0, *(np.flatnonzero(np.diff(pair)) + 1), len(pair)]
            out = []
            for a, z in zip(cuts[:-1], cuts[1:]):
                for s in range(a, z, size):
                    e = min(z, s + size)
                    out.append((int(block[s]), int(dim[s]), ids[s:e].tobytes(), flat[ends[s]:ends[e]].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                    names=[name, "dim", "ids", "rows"])

    return (keyed.repartition(name).sortWithinPartitions(name, "dim").select(name, "dim", "id", "v")
            .mapInArrow(pack, f"{name} int, dim int, ids binary, rows binary"))


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``queries(id, v)`` against ``rows(id, v)``."""
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    n_q, n_r = queries.count(), rows.count()
    asked = _blocks(queries, n_q, QUERY_BLOCK, "qb").select(
        "qb", "dim", F.col("ids").alias("qids"), F.col("rows").alias("qrows"))
    held = stored(_blocks(rows, n_r, ROW_BLOCK, "cb"), "vector-blocks")
    spread = held.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(parts_for(n_q, QUERY_BLOCK) - 1))))
    pairs = spread.join(asked, ["qb", "dim"]).select("dim", "qids", "qrows", "ids", "rows")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, qids, qrows, ids, vectors in zip(*[c.to_pylist() for c in b.columns]):
                q, x = np.frombuffer(qrows).reshape(-1, dim) if dim else None, None
                qid, cid = np.frombuffer(qids, np.int64), np.frombuffer(ids, np.int64)
                q = q if dim else np.zeros((len(qid), 0))
                x = np.frombuffer(vectors).reshape(-1, dim) if dim else np.zeros((len(cid), 0))
                found = best_in_block(qid, q, cid, x, k)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)],
                                                     names=["query_id", "vec_id", "score"])

    near = pairs.repartition(F.xxhash64("qids"), F.xxhash64("ids")).mapInArrow(
        search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


TOP_SQL = """
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM (SELECT * FROM clean WHERE vec_id % 50 = 0) q JOIN clean c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
