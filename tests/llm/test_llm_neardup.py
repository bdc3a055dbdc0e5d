import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from util import AWKWARD, DOCS, by_id, docs_table

from voxtable.llm import neardup, rounds
from voxtable.llm.common import table
from voxtable.llm.graph import components


def brute(rows, words, percent):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else
                    {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    root[max(a, b, key=lambda x: rows[x][0])] = min(a, b, key=lambda x: rows[x][0])
    return [(rows[i][0], len(sets[i]), rows[find(i)][0], rows[i][0] == rows[find(i)][0]) for i in range(len(rows))]


def check(spark, rows, words=2, percent=80):
    docs = docs_table(spark, [t for _, t in rows], ids=[i for i, _ in rows]).withColumn("id", F.lit("x"))
    got = sorted(map(tuple, neardup.near_duplicates(docs, words, percent).collect()))
    assert got == sorted(brute(rows, words, percent))


@pytest.mark.parametrize("words, sf", [(2, "0.001"), (5, "0.001"), (2, "0.01")])
def test_matches_all_pairs(spark, words, sf):
    docs = table(spark, f"/root/testdata/sf{sf}", "documents").select("doc_id", "text").collect()
    check(spark, [tuple(r) for r in docs], words)


def test_chains_groups_and_thresholds(spark, monkeypatch):
    monkeypatch.setattr(rounds, "BLOCK", 7)
    monkeypatch.setattr(rounds, "SMALL", 3)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows, word = [], list(base)
    for i in range(40):                                   # a chain whose ends have little in common
        word = list(word)
        word[rng.randrange(60)] = f"x{i}"
        rows.append((100 + i, " ".join(word)))
    for i in range(60):                                   # near copies of one text, all different
        copy = list(base[::-1])
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(60)] = f"y{rng.randrange(1000)}"
        rows.append((1000 - i, " ".join(copy)))
    rows += [(5000 + i, t) for i, t in enumerate(AWKWARD * 2)] + [(1, "A b"), (2, "a B"), (3, "a"), (4, "a b c")]
    check(spark, rows)
    check(spark, rows, words=1, percent=75)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2 ** 63, 3000, dtype=np.uint64)
    for shared in (0, 900, 1500, 1900):
        a, b = np.unique(pool[:1500]), np.unique(pool[1500 - shared:3000 - shared] if shared < 1500 else pool[:1500])
        ra = neardup.registers(np.array([len(a)]), a)
        rb = neardup.registers(np.array([len(b)]), b)
        union = np.union1d(a, b)
        assert (neardup.registers(np.array([len(union)]), union) == neardup.merge(ra, rb)).all()
        true = len(np.intersect1d(a, b)) / len(union)
        estimate, ok = neardup.judge(ra, rb, np.array([len(a)]), np.array([len(b)]), 0.8)
        assert abs(estimate[0] - true) < 0.15 and ok[0] == (true > 0.5)


def test_registers_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(8)
    sizes = [3, 0, 500, 1, 90, 0, 2000]
    ends = np.cumsum(sizes)
    hashes = rng.integers(0, 2 ** 63, ends[-1], dtype=np.uint64)
    whole = neardup.registers(ends, hashes)
    monkeypatch.setattr(neardup, "_STEP", 64)
    assert (neardup.registers(ends, hashes) == whole).all() and not whole[1].any()


def test_shingles_of_short_texts():
    ends, hashes = neardup.shingle_sets(pa.array(["a b", "A B", "a", "a b c", None, "a b a b a b"]), 2)
    sizes = np.diff(np.concatenate([[0], ends]))
    assert list(sizes) == [1, 1, 1, 2, 0, 2] and hashes[0] == hashes[1] != hashes[2]


def test_components_of_paths_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 4000), (4000, 4500),
                                                                                          (4500, 5000), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(300)} == {1000}
    assert got[5000] == got[4500] == got[4000] == 4000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    docs = docs_table(spark, ["a b c d e f g h i j"] * 3 + ["other words"] + [None, ""], ids=[5, 3, 4, 9, 1, 2])
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in by_id(kept)] == [1, 2, 3, 9]
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_stage_tells_rows_of_a_null_or_repeated_id_apart(spark):
    copy = " ".join(f"w{i}" for i in range(40))
    rows = [(5, copy), (None, copy), (None, "a text of its own that nobody else has"), (7, copy), (7, "another clean text here"),
            (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], DOCS)
    left = sorted(((r["doc_id"], r["text"]) for r in neardup.drop_near_duplicates(docs).collect()), key=str)
    assert left == sorted([rows[0], rows[2], rows[4], rows[5]], key=str)


def test_one_row_of_a_component_stays_whatever_its_ids(spark):
    copy, near = " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i}" for i in range(79))
    lone, lone_near = " ".join(f"v{i}" for i in range(80)), " ".join(f"v{i}" for i in range(79))
    twice = "a clean text that occurs twice under one id"
    rows = [(3, near), (7, copy), (7, "unlike text of its own here"), (None, lone), (None, lone), (None, lone_near),
            (9, twice), (9, twice), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], DOCS)
    left = [(r["doc_id"], r["text"]) for r in neardup.drop_near_duplicates(docs).collect()]
    named = [x for x in left if x[1] not in (lone, lone_near)]
    assert sorted(named, key=str) == sorted([rows[0], rows[2], rows[6], rows[8], rows[9]], key=str)
    assert len(left) == len(named) + 1
    report = neardup.near_duplicates(docs).collect()
    assert len(report) == len(rows) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in report)
    assert sorted(r["component_id"] for r in report if r["doc_id"] == 7) == [3, 7]


def test_a_pair_goes_only_if_the_threshold_is_hopeless():
    n, between = np.array([1000]), 0
    for k in range(neardup.REGISTERS // 2):                  # k registers larger, k smaller
        a, b = np.ones((1, neardup.REGISTERS), np.uint16), np.ones((1, neardup.REGISTERS), np.uint16)
        a[0, :k], b[0, k:2 * k] = 2, 2
        sim, logs = neardup.likelihoods(np.array([k]), np.array([k]), n.astype(float), n.astype(float))
        lost = logs.max() - logs[sim >= 0.8 - 0.03].max()
        between += 12 < lost <= 16
        assert neardup.judge(a, b, n, n, 0.8)[1][0] == (lost <= 16)
    assert between
