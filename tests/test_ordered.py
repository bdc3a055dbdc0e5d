import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtable.functions.hashing import order_key
from voxtable.operators import ordered as R


@pytest.fixture(scope="module")
def hot(spark):
    """One key owns most rows; values repeat."""
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(5)}", i * 3 + rnd.randrange(3), rnd.randrange(50))
            for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k string, o long, v long").repartition(6)


def by_key(rows):
    out = {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        out.setdefault(k, []).append((o, v))
    return out


@pytest.mark.parametrize("width", [7, 1 << 16])
def test_row_index(hot, width):
    rows, df = hot
    got = {(r.k, r.o): r.idx for r in R.row_index(df, ["k"], "o", width=width).collect()}
    want = {(k, o): i for k, seq in by_key(rows).items() for i, (o, _) in enumerate(seq)}
    assert got == want


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_sum(hot, keys):
    rows, df = hot
    got = {r.o: r.running for r in R.running_sum(df, keys, "o", "v", width=50).collect()}
    want = {}
    groups = by_key(rows) if keys else by_key([("", o, v) for _, o, v in rows])
    for seq in groups.values():
        total = 0
        for o, v in seq:
            total += v
            want[o] = total
    assert got == want


def test_running_sum_stops_early(hot):
    rows, df = hot
    got = R.running_sum(df, [], "o", "v", before=True, width=50, stop_at=500).where("running < 500").count()
    total = n = 0
    for _, _, v in sorted(rows, key=lambda r: r[1]):
        n += total < 500
        total += v
    assert got == n


def test_rolling_mean_and_best_before_cross_buckets(hot):
    rows, df = hot
    df = R.row_index(df, ["k"], "o", width=1000)
    sm = R.rolling_mean(df, ["k"], "idx", "v", 3, width=4)
    got = {(r.k, r.o): (r.smoothed, r.best) for r in R.best_before(sm, ["k"], "idx", "smoothed", "best", width=4).collect()}
    for k, seq in by_key(rows).items():
        best = None
        for i, (o, _) in enumerate(seq):
            mean = np.mean([v for _, v in seq[max(0, i - 2):i + 1]])
            assert got[(k, o)][0] == pytest.approx(mean)
            assert (got[(k, o)][1] is None) if best is None else got[(k, o)][1] == pytest.approx(best)
            best = mean if best is None else max(best, mean)


@pytest.mark.parametrize("n", [0, 1, 17, 500, 3000])
def test_hash_cutoff_picks_exactly_n(hot, n):
    _, df = hot
    keyed = df.select(order_key(1, "k", "o").alias("h"))
    cut = R.hash_cutoff(keyed, "h", F.least(F.lit(n), F.count(F.lit(1)))).first().cutoff
    assert keyed.where(F.col("h") <= cut).count() == n


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_percentiles_with_and_without_snapping(spark, accuracy):
    """At accuracy 20 keys above 200 rows go through the bracket; results stay exact."""
    rng = np.random.default_rng(0)
    data = {"hot": np.round(rng.exponential(100, 6000), 3), "flat": np.full(500, 2.5), "few": rng.normal(size=9)}
    df = spark.createDataFrame([(k, float(v), i) for k, a in data.items() for i, v in enumerate(a)], "k string, v double, i int")
    qs = [0.01, 0.5, 0.99]
    got = R.exact_percentiles(df.repartition(7), ["k"], "v", qs, accuracy=accuracy).collect()
    for r in got:
        assert r.pct == pytest.approx(np.percentile(data[r.k], [1, 50, 99]).tolist(), abs=1e-12)
    assert len(got) == 3


def test_snapping_leaves_few_distinct_values(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    got = R.exact_percentiles(df, [], "v", [0.25, 0.75], accuracy=1000).first().pct
    want = np.percentile(np.arange(200_000) * 7919 % 200_003, [25, 75])
    assert got == pytest.approx(want.tolist(), abs=1e-9)


def test_null_keys_and_orders_keep_their_rows(spark):
    rows = [("a", 1, 1.0), ("a", None, 2.0), (None, 5, 3.0), (None, 7, 4.0)]
    df = spark.createDataFrame(rows, "k string, o long, v double")
    assert R.row_index(df, ["k"], "o").count() == 4
    got = {(r.k, r.o): r.running for r in R.running_sum(df, ["k"], "o", "v").collect()}
    assert got[(None, 5)] == 3.0 and got[(None, 7)] == 7.0 and len(got) == 4
    assert R.best_before(df, ["k"], "o", "v").count() == 4


def test_rolling_mean_over_windows_wider_than_a_bucket(spark):
    df = spark.createDataFrame([("a", i, float(i * i % 7)) for i in range(30)], "k string, i long, v double")
    got = {r.i: r.smoothed for r in R.rolling_mean(df, ["k"], "i", "v", 6, width=2).collect()}
    v = [float(i * i % 7) for i in range(30)]
    assert all(got[i] == pytest.approx(np.mean(v[max(0, i - 5):i + 1])) for i in range(30)) and len(got) == 30


def test_results_do_not_depend_on_partitions(spark, hot):
    _, df = hot
    a = R.row_index(df.repartition(1), ["k"], "o", width=64).orderBy("o").collect()
    b = R.row_index(df.repartition(13, "v"), ["k"], "o", width=64).orderBy("o").collect()
    assert a == b
