import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from util import AWKWARD, DOCS, by_id, docs_table

from voxtable.llm import quality
from voxtable.llm.common import table

SF = "/root/testdata/sf0.01"


def by_hand(text):
    """Features of one text, counted byte by byte."""
    raw = (text or "").encode()
    kinds = [quality._byte_classes()[b] for b in raw]
    gap = [k <= 1 for k in kinds]
    n = len(raw)
    words = sum(not gap[i] and (i == 0 or gap[i - 1]) for i in range(n))
    hard = sum(kinds[i] in (7, 8) and (i == n - 1 or gap[i + 1]) for i in range(n))
    same = sum(i > 0 and kinds[i] in (7, 8) and raw[i] == raw[i - 1] for i in range(n))
    counts = [kinds.count(k) for k in (2, 3, 4, 0, 1, 5, 6, 7, 8, 9)] + [words, hard, same]
    return [np.log1p(n)] + [np.log((c + 0.5) / (n + 10)) for c in counts]


def test_features_match_counting_by_hand():
    texts = AWKWARD[:4] + ["AB! cd\nef?? 12*** é."] + AWKWARD[6:]
    got = quality.text_features(pa.array(texts))
    for row, text in zip(got, texts):
        # A run may not reach over the border of two texts, except as equal neighbouring bytes of the first place.
        assert np.allclose(row, by_hand(text)), text


def test_density_is_the_gaussian_one():
    rng = np.random.default_rng(1)
    data = {0: rng.normal(0, 1, (300, 3)), 1: rng.normal(1, 2, (500, 3))}
    model = quality.Discriminant({c: (len(x), x.sum(0), x.T @ x) for c, x in data.items()}, pool=0, sphere=0)
    x = rng.normal(0, 2, (20, 3))
    logs = []
    for c in (0, 1):
        cov = np.cov(data[c].T, bias=True) + 1e-9 * np.eye(3)
        d = x - data[c].mean(0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.log(np.linalg.det(cov)))
                    + np.log(len(data[c])))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_held_out_accuracy(spark):
    labels = table(spark, SF, "labels")
    got = quality.score_quality(table(spark, SF, "documents"), labels)
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97
    assert got.count() == 1000 and all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_labels_have_no_influence(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    swapped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (by_id(quality.score_quality(docs, x)) for x in (labels, swapped))
    assert np.allclose([r["score"] for r in a], [r["score"] for r in b])


def test_awkward_rows_and_missing_labels(spark):
    docs = docs_table(spark, AWKWARD).withColumn("score", F.lit("mine"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in quality.score_quality(docs, none).collect()] == [0.5] * len(AWKWARD)
    one = spark.createDataFrame([(i, 1, 0) for i in range(len(AWKWARD))] + [(0, None, 0), (0, 1, 0)], none.schema)
    assert {r["score"] for r in quality.score_quality(docs, one).collect()} == {1.0}
    both = spark.createDataFrame([(i, i % 2, 0) for i in range(len(AWKWARD))], none.schema)
    assert all(0 <= r["score"] <= 1 for r in quality.score_quality(docs, both).collect())
    assert quality.score_quality(spark.createDataFrame([], DOCS), one).count() == 0
