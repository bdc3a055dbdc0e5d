import numpy as np

from voxtable.llm import vectors


def brute(rows, k):
    clean = [(i, [int(np.floor(256.0 * c)) for c in v]) for i, v in rows
             if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for i in sorted({i for i, _ in clean if i % 50 == 0}):
        q = min(v for j, v in clean if j == i)
        scored = [(-sum(a * b for a, b in zip(q, v)), j) for j, v in clean if j != i and len(v) == len(q)]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return out


def run(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string, id string, label int")
    clean = vectors.clean_vectors(df, "vec_id", "embedding", 256.0)
    return sorted(map(tuple, vectors.top_k(clean.filter("id % 50 = 0"), clean, k).collect()))


def wide(rows):
    return [(i, v, "x", "y", 1) for i, v in rows]


def test_matches_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 5)
    monkeypatch.setattr(vectors, "ROW_BLOCK", 40)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 16))
    rows = [(i, [float(c) for c in np.float32(centres[i % 4] + rng.normal(0, 0.2, 16))]) for i in range(700)]
    assert run(spark, wide(rows)) == brute(rows, 5)


def test_ties_repeats_nulls_and_lengths(spark):
    rows = [(i, [1.0, 0.5, -0.25]) for i in range(120)]                     # all equal: smaller ids win
    rows += [(0, [1.0, 0.5, -0.25]), (3, [1.0, 0.5, -0.25]), (200, None), (201, [1.0, None, 0.0]),
             (202, [float("nan"), 0.0, 0.0]), (203, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]),
             (250, [2.0, 2.0]), (251, [1.0, 3.0]), (300, []), (301, []), (350, [0.0, 0.0, 0.0])]
    assert run(spark, wide(rows)) == brute(rows, 5)


def test_fewer_candidates_than_k_and_empty(spark):
    rows = [(0, [1.0]), (1, [2.0]), (50, [-1.0])]
    assert run(spark, wide(rows)) == brute(rows, 5)
    assert run(spark, wide([(1, [1.0])])) == [] and run(spark, []) == []


def test_bound_is_never_below_the_product():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(50, 13)), rng.normal(size=(60, 13))
    for n in vectors.LEVELS + (1, 5):
        assert (vectors._summary(a, n) @ vectors._summary(b, n).T + 1e-9 >= a @ b.T).all()


def test_large_components_stay_exact(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 1.0]), (2, [-1e30, 1.0]), (3, [1e7, 1e7])]
    got = run(spark, wide(rows))
    assert [r[2] for r in got] == [1, 3, 2] and got[0][3] == 2 ** 63 - 1 and got[2][3] == -2 ** 63
