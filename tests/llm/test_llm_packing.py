from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from util import AWKWARD, DOCS, docs_table

from voxtable.llm import packing

CAPS = (8, 16, 32)


def check_plan(counts, caps):
    runs, bins = packing.plan_bins(counts, caps, 2)
    capacity = {first + i: (cap, used) for first, n, cap, used in bins for i in range(n)}
    placed, content = defaultdict(set), defaultdict(list)
    for length, rank, n, first, offset in runs:
        for i in range(n):
            assert rank + i not in placed[length]
            placed[length].add(rank + i)
            content[first + i].append((offset, length))
    assert {k: set(range(v)) for k, v in counts.items()} == dict(placed)
    assert set(content) == set(capacity)
    for b, items in content.items():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at == capacity[b][1] and capacity[b][0] == min(c for c in caps if c >= at)
    return sum(c for c, _ in capacity.values())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), min_size=1))
def test_plan_places_every_piece_once_in_the_least_bin(counts):
    check_plan(counts, CAPS)


def test_plan_wastes_little_and_handles_huge_counts():
    counts = {n: 1_000_000 // n for n in range(1, 2049)}
    runs, bins = packing.plan_bins(counts)
    used, room = sum(n * u for _, n, _, u in bins), sum(n * c for _, n, c, _ in bins)
    assert used == sum(k * v for k, v in counts.items()) and room < 1.01 * used
    assert len(runs) < 100_000


def test_plan_prefers_the_least_cost_size():
    assert [b[2] for b in packing.plan_bins({5: 1}, CAPS, 1)[1]] == [8]
    assert packing.plan_bins({8: 4}, CAPS, 4)[1] == [(0, 1, 32, 32)]          # one large bin costs less than four


def test_pieces_are_whole_and_bins_do_not_overlap(spark):
    texts = AWKWARD + ["w " * n for n in (1, 7, 300, 300, 300, 4100)]
    docs = docs_table(spark, texts).withColumn("length", F.lit(-1)).withColumn("rank", F.lit("x"))
    rows = packing.pack(docs).collect()
    total = defaultdict(int)
    for r in rows:
        total[r["doc_id"]] += r["length"]
    assert dict(total) == {i: len([w for w in packing_words(t)]) for i, t in enumerate(texts)}
    spans = defaultdict(list)
    for r in rows:
        if r["length"] == 0:
            assert r["bin_id"] is None and r["capacity"] is None
            continue
        spans[r["bin_id"]].append((r["bin_offset"], r["length"], r["capacity"], r["bin_used"]))
    for items in spans.values():
        at = 0
        for offset, length, cap, used in sorted(items):
            assert offset == at
            at += length
        assert at == used <= cap


def packing_words(text):
    import re
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def test_repeated_rows_and_reruns(spark):
    docs = docs_table(spark, ["a b c"] * 500, ids=[1] * 250 + list(range(250)))
    a = sorted(map(tuple, packing.pack(docs).collect()), key=str)
    assert len(a) == 500 and a == sorted(map(tuple, packing.pack(docs.repartition(7)).collect()), key=str)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("tokens, most", [(5000, 2048), (2048, 2048), (0, 0)])
def test_own_token_column(spark, tokens, most):
    docs = spark.createDataFrame([(1, tokens)], "doc_id long, n long")
    rows = packing.pack(docs, F.col("n")).collect()
    assert sum(r["length"] for r in rows) == tokens and max(r["length"] for r in rows) == most
