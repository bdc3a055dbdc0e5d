"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives log rates of byte classes and word shapes. Per class, count, sums and products of the features are
summed by Spark; the driver shrinks the two small covariances, towards the pooled one and towards a sphere, and caches
their Cholesky factors. The score is the logistic of the log-density difference plus the log prior odds.

Null and empty texts have the statistics of no bytes and get a score. Repeated label rows of a document count once,
the highest quality winning; null labels are ignored. Without training rows of one class, the score is that of the
other class (0.5 without any). Very long texts are read whole. Only ``doc_id`` and ``text``, and of the labels ``doc_id`` and
``quality``, are read, so other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import bounded, hash_rest, stored

FEATURES = ("size", "upper", "lower", "digit", "space", "line", "stop", "mark", "shout", "sign", "wide", "words",
            "hard_ends", "runs")
POOL, SPHERE = 0.1, 0.02          # shrinkage towards the pooled covariance and towards a multiple of unity
_CLASSES = 10


def _byte_classes() -> np.ndarray:
    """Class of each byte: 0 space, 1 line, 2 upper, 3 lower, 4 digit, 5 stop, 6 mark, 7 shout, 8 sign, 9 non-ASCII."""
    kind = np.full(256, 8, np.uint8)
    kind[[9, 11, 12, 13, 32]], kind[10] = 0, 1
    kind[65:91], kind[97:123], kind[48:58] = 2, 3, 4
    kind[[ord(c) for c in ".,"]] = 5
    kind[[ord(c) for c in ";:-'\"()"]] = 6
    kind[[ord(c) for c in "!?"]] = 7
    kind[128:] = 9
    return kind


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text, over all its bytes."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    raw = np.frombuffer(raw, np.uint8)[ends[0]:ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    kind = _byte_classes()[raw]

    def per_text(flag):
        total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return (total[ends[1:]] - total[ends[:-1]]).astype(float)

    n = np.diff(ends).astype(float)
    count = [per_text(kind == k) for k in range(_CLASSES)]
    gap = kind <= 1
    first = np.ones(len(raw), bool)
    first[1:] = gap[:-1]
    first[ends[:-1][ends[:-1] < len(raw)]] = True
    last = np.ones(len(raw), bool)
    last[:-1] = gap[1:]
    last[ends[1:][ends[1:] > 0] - 1] = True
    same = np.zeros(len(raw), bool)
    same[1:] = raw[1:] == raw[:-1]
    odd = (kind == 7) | (kind == 8)
    words = per_text(first & ~gap)
    rate = [np.log((c + 0.5) / (n + 10)) for c in
            (count[2], count[3], count[4], count[0], count[1], count[5], count[6], count[7], count[8], count[9], words,
             per_text(last & odd), per_text(same & odd))]
    return np.stack([np.log1p(n), *rate], axis=1)


def featurise(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the features of each whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text", 8 << 20):
            x = text_features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x[:, i]) for i in range(x.shape[1])]],
                                             names=["doc_id", *FEATURES])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{f} double" for f in FEATURES))


class Discriminant:
    """Means, log determinants and Cholesky factors of both classes."""

    def __init__(self, stats: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float = POOL,
                 sphere: float = SPHERE):
        self.counts = {c: stats[c][0] if c in stats else 0.0 for c in (0, 1)}
        self.parts = {}
        if min(self.counts.values()) == 0:
            return
        means = {c: s / n for c, (n, s, _) in stats.items()}
        covs = {c: p / n - np.outer(means[c], means[c]) for c, (n, _, p) in stats.items()}
        pooled = sum(self.counts[c] * covs[c] for c in (0, 1)) / sum(self.counts.values())
        for c in (0, 1):
            cov = (1 - pool) * covs[c] + pool * pooled
            d = len(cov)
            cov = (1 - sphere) * cov + (sphere * np.trace(cov) / d + 1e-9) * np.eye(d)
            root = np.linalg.cholesky(cov)
            self.parts[c] = (means[c], np.linalg.inv(root), 2 * np.log(np.diag(root)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            n = sum(self.counts.values())
            return np.full(len(x), self.counts[1] / n if n else 0.5)
        dens = {}
        for c, (mean, inverse, logdet) in self.parts.items():
            z = (x - mean) @ inverse.T
            dens[c] = -0.5 * ((z * z).sum(axis=1) + logdet) + np.log(self.counts[c])
        return 1 / (1 + np.exp(-np.clip(dens[1] - dens[0], -700, 700)))


def fit(features: DataFrame, labels: DataFrame, **shrink) -> Discriminant:
    """Fit on the rows of ``features`` that ``labels(doc_id, quality)`` covers."""
    known = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("_y"))
    rows = features.join(known, "doc_id")
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(f).alias(f"s_{f}") for f in FEATURES]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p_{i}_{j}") for i, j in pairs]
    stats = {}
    for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n"), *sums).collect():   # two rows
        p = np.zeros((d, d))
        for i, j in pairs:
            p[i, j] = p[j, i] = r[f"p_{i}_{j}"]
        stats[int(r["_y"])] = (float(r["n"]), np.array([r[f"s_{f}"] for f in FEATURES]), p)
    return Discriminant(stats, **shrink)


def score_quality(docs: DataFrame, labels: DataFrame, train=None) -> DataFrame:
    """``doc_id, held_out, score, predicted``; labels of rows where ``train`` is false are not learned from."""
    train = hash_rest("doc_id", 3) != 1 if train is None else train
    features = stored(featurise(docs), "quality-features")
    model = fit(features.filter(train), labels.select("doc_id", "quality").filter(train))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(f).to_numpy(zero_copy_only=False) for f in FEATURES], axis=1)
            p = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    scored = features.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", (~train).alias("held_out"), "score", "predicted")
