"""The Jaccard join against a comparison of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_neardup import brute
from util import AWKWARD, docs_table

from voxtable.llm import jaccard, rounds
from voxtable.llm.common import table


def check(spark, rows, words=5, percent=80):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "key", "n", "c")})
    got = sorted(map(tuple, jaccard.jaccard_components(docs, words, percent).collect()))
    assert got == sorted(r[:3] for r in brute(rows, words, percent))


@pytest.mark.parametrize("words, sf", [(5, "0.001")])
def test_matches_all_pairs(spark, words, sf):
    docs = table(spark, f"/root/testdata/sf{sf}", "documents").select("doc_id", "text").collect()
    check(spark, [tuple(r) for r in docs], words)


def near_copies(rng, base, count, most, start):
    rows = []
    for i in range(count):
        copy = list(base)
        for _ in range(rng.randrange(most)):
            copy[rng.randrange(len(copy))] = f"y{rng.randrange(10 ** 6)}"
        rows.append((start - i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("small, block, shrink", [(8, 512, 2), (2, 6, 10 ** 9)])
def test_chains_groups_and_thresholds(spark, monkeypatch, small, block, shrink):
    monkeypatch.setattr(rounds, "SMALL", small)
    monkeypatch.setattr(rounds, "BLOCK", block)
    monkeypatch.setattr(rounds, "SHRINK", shrink)
    monkeypatch.setattr(jaccard, "COUNTERS", 8)                # few counters: another order, the same result
    monkeypatch.setattr(jaccard, "RANGE_SHINGLES", 100)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows, word = [], list(base)
    for i in range(30):                                        # a chain whose ends have little in common
        word = list(word)
        word[rng.randrange(60)] = f"x{i}"
        rows.append((100 + i, " ".join(word)))
    rows += near_copies(rng, base[::-1], 50, 8, 1000)
    rows += [(2000 + i, " ".join(base[:k])) for i, k in enumerate(range(40, 60))]
    rows += [(5000 + i, t) for i, t in enumerate(AWKWARD * 2)] + [(1, "A b"), (2, "a B"), (3, "a"), (4, "a b c")]
    check(spark, rows, *((1, 75) if shrink == 2 else (2, 80)))


def test_no_link_is_lost_between_members_of_one_group(spark, monkeypatch):
    # All texts share their rare words, so sizes and prefixes are equal, and differ in frequent ones only.
    monkeypatch.setattr(jaccard, "frequency_levels", lambda docs, words: np.zeros(1 << jaccard.COUNTERS, np.uint8))
    ends = [f"t{i}" for i in range(12)]
    base = " ".join(f"w{i}" for i in range(60))
    check(spark, [(i, f"{base} {e}") for i, e in enumerate(ends)] + [(50, base), (51, base + " t1 t2")], 1)


def test_stored_tables_grow_with_a_group_of_near_copies(spark, monkeypatch):
    sizes = {}

    def counting(df, name):
        from voxtable.session import stored
        out = stored(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    for module in (jaccard, rounds):
        monkeypatch.setattr(module, "stored", counting)
    found = []
    base = [f"w{i}" for i in range(100)]
    for count in (200, 400):
        sizes.clear()
        docs = spark.createDataFrame(near_copies(random.Random(1), base, count, 6, 9000), "doc_id long, text string")
        got = jaccard.jaccard_components(docs, 2).collect()
        assert len(got) == count
        found.append(dict(sizes))
    for name in found[1]:
        assert found[1][name] <= 2.5 * max(found[0].get(name, 0), 200), name       # 200 documents, then 400


def test_prefix_order_puts_frequent_shingles_last():
    ends, hashes = np.array([5, 5, 8]), np.array([1 << 50, 2 << 50, 3 << 50, 4 << 50, 5 << 50] + [1 << 50, 7 << 50, 9 << 50], np.uint64)
    levels = np.zeros(1 << jaccard.COUNTERS, np.uint8)
    levels[(np.uint64(1 << 50) >> np.uint64(64 - jaccard.COUNTERS))] = 9
    stops, first = jaccard.prefixes(ends, hashes, levels, 80)
    assert stops.tolist() == [2, 2, 3] and first.tolist() == [2 << 50, 3 << 50, 7 << 50]


def test_null_and_repeated_ids(spark):
    copy, near = " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i}" for i in range(79))
    rows = [(3, near), (7, copy), (7, "unlike text of its own here"), (None, copy), (9, "twice is twice and that is it"),
            (9, "twice is twice and that is it"), (None, None), (None, "nobody else has this text at all")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted(
        [(3, 3), (7, 3), (7, 7), (None, 3), (9, 9), (9, 9), (None, None), (None, None)], key=str)
    assert jaccard.jaccard_components(docs_table(spark, ["a"]).limit(0)).count() == 0
