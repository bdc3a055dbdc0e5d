"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct word shingles. Every register holds an exponentially spaced truncated minimum,
``floor(1 - log_b(least exponential))``: registers of two sets merge by maximum, and two registers agree the likelier
the more alike the sets are. Runs of registers are the bands.

* Equal sets (by a digest of 128 bits) are one *class*; only classes go on, and a number of their own names them.
* Members of a band bucket are compared as :mod:`rounds` says: pairs of small buckets and of centres, then blocks. Each pair
  is judged by the likelihood of its (larger, smaller, equal) register counts given both set sizes, maximised jointly over
  the similarity; pairs for which the threshold is hopeless go, all others are confirmed on full sets.

With 32 bands of 4 registers, a pair at similarity 0.8 shares no bucket with probability 5e-8.

Null and empty texts have the empty set, link with nothing and are kept. Texts with fewer words than a shingle have
their whole word sequence as one shingle. Repeated rows are equal sets. Very long texts are sketched whole. Of a component the
report keeps the rows whose ``doc_id`` is the component's (null ids match null), the stage exactly one row: the least
``doc_id``, nulls last, then the least hash of the text, then one of equal rows. Only ``doc_id`` and ``text`` are read; the
stage's own columns start with two underscores and a random word, so other columns may have any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import bounded, release, settle, stored
from voxtable.llm.rounds import connect
from voxtable.llm.shingles import class_sets, digests, mixed, shingle_sets

BANDS, PER_BAND = 32, 4
REGISTERS = BANDS * PER_BAND
BASE, RATE, TOP = 1.001, 20.0, 65534          # spacing, rate and range of the register values
DOUBT = 16.0                                   # log likelihood by which the threshold must be beaten to drop a pair
_STEP = 1 << 15

_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(1, 2 ** 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2 ** 63, REGISTERS, dtype=np.uint64)
_BAND_MUL = _rng.integers(1, 2 ** 63, (BANDS, PER_BAND), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of every set, ``uint16``; the empty set has zeros."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    least = np.full((len(ends), REGISTERS), 2 ** 64 - 1, np.uint64)
    rows = np.flatnonzero(ends > starts)
    i = 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(ends[rows], starts[rows[i]] + _STEP, side="right")))
        for a in range(starts[rows[i]], ends[rows[j - 1]], _STEP if j == i + 1 else 1 << 62):
            z = min(ends[rows[j - 1]], a + _STEP) if j == i + 1 else ends[rows[j - 1]]
            part, cuts = hashes[a:z], (starts[rows[i:j]] - a if j > i + 1 else np.zeros(1, np.int64))
            own = rows[i:j]
            with np.errstate(over="ignore"):
                for k in range(REGISTERS):
                    low = np.minimum.reduceat(part * _MUL[k] + _ADD[k], cuts)
                    least[own, k] = np.minimum(least[own, k], low)
        i = j
    exponential = -np.log1p(-(least.astype(np.float64) + 1.0) / 2.0 ** 64 * (1 - 2.0 ** -52)) / RATE
    value = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype(np.uint16)
    value[ends == starts] = 0
    return value


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; equal keys of different bands do not meet."""
    parts = regs.reshape(len(regs), BANDS, PER_BAND).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mixed((parts * _BAND_MUL).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)


def _agree(x):
    """Probability that the register of the set with relative surplus ``x`` is the larger one."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def likelihoods(larger, smaller, n_a, n_b, grid: int = 41):
    """``(similarities, log likelihoods)`` per pair, over a grid up to the largest similarity their sizes allow."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    sim = np.minimum(u / v, v / u) * np.linspace(0, 1, grid)[None, :]
    p = np.maximum(_agree(u - v * sim), 1e-12)
    q = np.maximum(_agree(v - u * sim), 1e-12)
    same = np.maximum(1 - p - q, 1e-12)
    equal = REGISTERS - larger - smaller
    return sim, larger[:, None] * np.log(p) + smaller[:, None] * np.log(q) + equal[:, None] * np.log(same)


def judge(a, b, n_a, n_b, threshold):
    """``(estimate, possible)``: likeliest similarity and whether the threshold is still possible."""
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    n_a, n_b = n_a.astype(float), n_b.astype(float)
    fits = np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9
    sim, logs = likelihoods(larger, smaller, n_a, n_b)
    over = np.where(sim >= threshold - 0.03, logs, -np.inf).max(axis=1)
    estimate = sim[np.arange(len(sim)), logs.argmax(axis=1)]
    return estimate, fits & (logs.max(axis=1) - over <= DOUBT)


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, text_key, n, digest, regs, row`` of every whole text; digest and registers are null for empty sets.

    ``row`` numbers the rows; it is fixed only once the result is stored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text", 4 << 20):
            ends, hashes = shingle_sets(b.column("text"), words)
            regs = registers(ends, hashes)
            digest = digests(ends, hashes)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(np.diff(ends, prepend=0)), pa.array(digest, pa.binary()),
                 pa.array([r.tobytes() if d else None for r, d in zip(regs, digest)], pa.binary())],
                names=["doc_id", "text_key", "n", "digest", "regs"])
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(
        run, f"doc_id {kind}, text_key long, n long, digest binary, regs binary").withColumn(
        "row", F.monotonically_increasing_id())


def _banded(classes: DataFrame) -> DataFrame:
    """``key, band, id, n``: a row per class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            regs = _stack(b.column("regs"))
            keys = band_keys(regs)
            take = np.repeat(np.arange(b.num_rows), BANDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows)),
                 b.column("id").take(pa.array(take)), b.column("n").take(pa.array(take))], names=["key", "band", "id", "n"])

    return classes.select("id", "n", "regs").mapInArrow(run, "key long, band int, id long, n long")


def _stack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """``a, b, estimate`` of the pairs the registers leave possible."""
    side = classes.select("id", "n", "regs")
    both = (pairs.join(side.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra")), "a")
            .join(side.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                p = b.slice(s, 4096)
                estimate, ok = judge(_stack(p.column("ra")), _stack(p.column("rb")), p.column("na").to_numpy(),
                                     p.column("nb").to_numpy(), threshold)
                yield pa.RecordBatch.from_arrays([p.column("a"), p.column("b"), pa.array(estimate)],
                                                 names=["a", "b", "estimate"]).filter(pa.array(ok))

    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long, estimate double")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs(doc_id long, text)``."""
    return _grouped(docs, words, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """:func:`near_duplicates` with ``text_key``, ``one``: whether the row is its component's kept one, and ``equal`` to it."""
    threshold = percent / 100
    docs = docs.select("doc_id", "text")
    sketched = stored(sketch(docs, words), "sketches")
    regs = F.first("regs").alias("regs")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "row")).alias("best")
    classes = stored(sketched.filter("digest is not null").groupBy("digest").agg(best, F.first("n").alias("n"), regs)
                     .withColumn("id", F.monotonically_increasing_id()), "classes")
    buckets = stored(_banded(classes), "buckets")
    several = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = stored(buckets.join(several, "key"), "shared")

    def fits(table: pa.Table):
        regs, n, band = _stack(table.column("regs")), table.column("n").to_numpy(), table.column("band")[0].as_py()

        def test(x, y):
            # Mates meet in their first common band only.
            same = (regs[y] == regs[x]).reshape(len(y), BANDS, PER_BAND).all(axis=2)
            ok = same.argmax(axis=1) == band
            ok[ok] = judge(np.broadcast_to(regs[x], (ok.sum(), REGISTERS)), regs[y[ok]], np.full(ok.sum(), n[x]), n[y[ok]],
                           threshold)[1]
            return ok

        return test

    labels = connect(shared, percent, lambda x, y: F.lit(True), lambda pairs: _likely(pairs, classes, threshold),
                     lambda ids: class_sets(docs, ids, classes, words),
                     lambda rows: rows.join(classes.select("id", "regs"), "id"), fits)
    settle(docs.sparkSession)
    named = classes.join(labels, classes["id"] == labels["node"], "left").select(
        "digest", "best", F.coalesce("component", "id").alias("component"))
    named = stored(named, "components")
    least = named.groupBy("component").agg(F.min("best").alias("kept"))
    component = stored(named.select("digest", "component").join(least, "component").select("digest", "kept"), "kept")
    out = sketched.select("doc_id", "text_key", "n", "digest", "row").join(
        component.withColumnRenamed("kept", "k"), "digest", "left")
    alone = F.col("digest").isNull()
    out = out.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("k.doc_id")))
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
                      (alone | (F.col("row") == F.col("k.row"))).alias("one"),
                      (F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("text_key") == F.col("k.text_key"))).alias("equal"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates: that with the least ``doc_id``; columns as given.

    A row goes by its ``doc_id`` and its text, so other texts under the same id, or under a null one, stay. Of rows that
    repeat both one stays.
    """
    own_id, own_key = (f"__neardup_{uuid.uuid4().hex[:8]}_{k}" for k in ("id", "key"))
    report = _grouped(docs, words, percent).filter("not one")
    report = stored(report.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key), "equal").distinct(),
                    "dropped").withColumnRenamed("equal", f"{own_id}_equal")

    def rows(found, how):
        same = docs["doc_id"].eqNullSafe(found[own_id]) & (F.xxhash64(docs["text"]) == found[own_key])
        return docs.join(found, same, how)

    again = rows(report.filter(F.col(f"{own_id}_equal")), "left_semi").withColumn(own_key, F.xxhash64("text"))
    return rows(report, "left_anti").unionByName(again.dropDuplicates(["doc_id", own_key]).drop(own_key))


# Pairs by shared shingles, one text per set, then reachability; for small tables.
NEAR_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w
         ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM worded),
classes AS (SELECT s, min(doc_id) AS id FROM sets WHERE len(s) > 0 GROUP BY s),
one AS MATERIALIZED (SELECT id, len(s) AS n, unnest(s) AS g FROM classes),
links AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b FROM one a JOIN one b ON a.g = b.g AND a.id <> b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT id AS a, id AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
named AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
SELECT t.doc_id, len(t.s)::BIGINT AS n_shingles, coalesce(n.component_id, t.doc_id) AS component_id,
       t.doc_id = coalesce(n.component_id, t.doc_id) AS kept
FROM sets t LEFT JOIN classes c ON c.s = t.s LEFT JOIN named n ON n.id = c.id"""
