"""Spelling variants against a comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from util import AWKWARD, docs_table
from voxtable.llm import spelling


def plain_counts(rows, shortest=5, least=3, slip=97):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda x: x[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= shortest and c >= least}


def is_near(x, y):
    x, y = sorted((x, y), key=len)
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1:] == x for i in range(len(y)))


def plain_variants(n):
    near = {w: [v for v in n if v != w and is_near(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.collect()))


def corpus(letters, seed, docs=80):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(60)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rng.randint(0, 120)):
            w = rng.choice(base)
            at, r = rng.randrange(len(w)), rng.random()
            if r < .2:
                w = w[:at] + w[at + 1:]
            elif r < .4:
                w = w[:at] + rng.choice(letters) + w[at:]
            elif r < .6:
                w = w[:at] + rng.choice(letters) + w[at + 1:]
            words.append(w)
        rows.append((rng.choice([i, i, None]), rng.choice([" ", ", ", "-", "7", "漢"]).join(words)))
    return rows + list(enumerate(AWKWARD))


@pytest.mark.parametrize("letters, slip", [("abcdefgÉé×ÿ", 97), ("aab", 7), ("ABCde", 3)])
def test_equals_all_pairs(spark, letters, slip):
    rows = corpus(letters, 11)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counted = spelling.count_words(docs, slip=slip)
    n = plain_counts(rows, slip=slip)
    assert {r["word"]: r["n"] for r in counted.collect()} == n
    assert found(spelling.variants(counted)) == plain_variants(n)


def test_large_blocks_and_small_slabs(spark, monkeypatch):
    rng = random.Random(2)
    n = {"".join(rng.choice("abc") for _ in range(rng.randint(5, 7))): rng.randint(3, 60) for _ in range(900)}
    n |= {"pre" + x + "fix" * 30: rng.randint(3, 9) for x in ("", "a", "b", "ab", "ba", "abc", "abb")}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    want = plain_variants(n)
    for block, cells in ((4, 200), (50, 5000), (100_000, 1 << 22)):
        monkeypatch.setattr(spelling, "BLOCK", block)
        monkeypatch.setattr(spelling, "CELLS", cells)
        assert found(spelling.variants(words)) == want


def test_checksum_of_joined_halves():
    import numpy as np
    words = [b"a", b"abcdef", "éÿ".encode(), b"z" * 64, b"z" * 65, b"y" * 900]
    ids = [None, 0, 17, 2 ** 40, -5]
    codes = np.tile(np.arange(len(words)), len(ids))
    got = spelling.slip_hashes(ids, np.arange(len(ids) + 1) * len(words), codes, words)
    want = [zlib.crc32(f"{'' if i is None else i}:".encode() + w) for i in ids for w in words]
    assert got.tolist() == want


def test_empty_and_clashing_columns(spark):
    docs = docs_table(spark, ["hello hello hello hallo hallo hallo", None, ""])
    wide = docs.withColumns({c: F.lit(3) for c in ("word", "n", "m", "key", "block", "root")})
    assert [r["word"] for r in spelling.variants(spelling.count_words(wide)).orderBy("word").collect()] == ["hallo", "hello"]
    assert spelling.variants(spelling.count_words(docs.limit(0))).count() == 0


def test_chain_of_forms(spark):
    n = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "bbbbbc": 200, "lonely": 5}
    got = {r["word"]: r["root"] for r in spelling.variants(
        spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got == {w: "bbbbbc" for w in n if w != "lonely"} | {"lonely": "lonely"}
