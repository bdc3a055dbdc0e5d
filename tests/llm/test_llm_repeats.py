import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from util import AWKWARD, DOCS, by_id, docs_table

from voxtable.llm import repeats
from voxtable.llm.bwt import END, collection_bwt, repeated_starts
from voxtable.llm.common import table


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=9), min_size=1, max_size=8))
def test_bwt_matches_sorted_suffixes(strings):
    rows = []
    for i, s in enumerate(strings):
        for k in range(len(s) + 1):
            rows.append((s[len(s) - k:], i, k, s[len(s) - k - 1] if k < len(s) else END))
    # Ends are smaller than symbols and ordered by string.
    rows.sort(key=lambda r: ([x + 1000 for x in r[0]] + [r[1]]))
    common = [0]
    for a, b in zip(rows, rows[1:]):
        n = 0
        while n < min(len(a[0]), len(b[0])) and a[0][n] == b[0][n]:
            n += 1
        common.append(n)
    flat = np.array([x for s in strings for x in s], np.int32)
    got = collection_bwt(flat, np.array([len(s) for s in strings]))
    assert list(zip(*[c.tolist() for c in got])) == [(r[3], r[1], r[2], c) for r, c in zip(rows, common)]


def test_repeated_starts_of_strings():
    strings = [[1, 2, 3, 4], [9, 1, 2, 3], [2, 3], [5, 5, 5]]
    got = repeated_starts(np.concatenate(strings), np.array([4, 4, 2, 3]), 2)
    assert sorted(zip(*[x.tolist() for x in got])) == [(0, 3), (0, 4), (1, 2), (1, 3), (2, 2), (3, 2), (3, 3)]


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, length=200):
    docs = docs_table(spark, texts).withColumn("anchor", F.lit("mine"))
    got = [tuple(r)[1:] for r in by_id(repeats.repeat_report(docs, length))]
    assert got == brute(texts, length)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_matches_all_windows(spark, sf):
    rows = by_id(table(spark, f"/root/testdata/sf{sf}", "documents").select("doc_id", "text"))
    check(spark, [r["text"] for r in rows])


@pytest.mark.parametrize("many", [4096, 1])
def test_shared_passages_periods_and_edges(spark, monkeypatch, many):
    monkeypatch.setattr(repeats, "MANY", many)
    monkeypatch.setattr(repeats, "BUCKET", 50)
    rng = random.Random(7)

    def letters(n):
        return "".join(rng.choice("abcdeé ") for _ in range(n))

    passage = letters(600)
    texts = [letters(rng.randrange(40)) + passage[a:a + n] + letters(rng.randrange(60))
             for a, n in [(rng.randrange(300), rng.randrange(20, 300)) for _ in range(80)]]
    texts += ["ab" * 300, "x" * 500, "x" * 199, "x" * 200, letters(199) * 2, letters(200) * 2, *AWKWARD]
    check(spark, texts)
    check(spark, texts[:40] + texts[80:], length=20)
    check(spark, texts[:10], length=3)


def test_blocks_of_long_texts(spark, monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh") for _ in range(3000))
    text = text + text[500:1700] + "z" * 10 + text[100:299]
    monkeypatch.setattr(repeats, "BLOCK", 700)
    blocks = [x for a in range(0, len(text) - 199, 700) for x in
              zip(*[c.tolist() for c in repeats.anchors(np.frombuffer(text[a:a + 899].encode(), np.uint8), 200)])]
    assert sum(high - low + 1 for _, _, low, high in blocks) == len(text) - 199
    check(spark, [text, "q" + text[200:420]])


def test_anchor_is_the_leftmost_least_gram():
    raw = np.frombuffer(("ab" * 40 + "The quick brown fox jumps over it all day long " * 5).encode(), np.uint8)
    h, place, low, high = repeats.anchors(raw, 40)
    gram = repeats.sizes_for(40)[0]
    assert low[0] == 0 and high[-1] == len(raw) - 40 and (low[1:] == high[:-1] + 1).all()
    assert ((low <= place) | (place >= low)).all() and (place - low <= 40 - gram).all() and (place >= high).all()


def test_repeated_rows_null_ids_and_empty_table(spark):
    long = "".join(chr(97 + (i * i) % 23) for i in range(300))
    docs = spark.createDataFrame([(1, long), (1, long), (1, "other"), (None, None)], "doc_id long, text string")
    rows = repeats.repeat_report(docs).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in rows) == [(0, 0), (5, 0), (300, 300), (300, 300)]
    assert repeats.repeat_report(spark.createDataFrame([], DOCS)).count() == 0


def test_stage_cuts_whole_characters(spark):
    rng = random.Random(3)
    shared = "".join(rng.choice("éüabc") for _ in range(250))
    docs = docs_table(spark, ["ß start " + shared + " end", "x" + shared + "yé", None, "short"])
    out = by_id(repeats.drop_repeats(docs))
    assert [r["text"] for r in out] == ["ß start  end", "xyé", None, "short"]
    assert repeats.drop_repeats(docs).columns == docs.columns


def test_texts_with_one_checksum_are_told_apart(spark):
    found, pair = {}, None
    for i in range(400_000):                              # equal checksums stay equal under a common end
        t = f"{i * 7919 % 1_000_003} " + "q" * (i % 41)
        other = found.setdefault(zlib.crc32(t.encode()), t)
        if len(other) != len(t):
            pair = [t, other]
            break
    assert pair
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdefg ") for _ in range(260))
    texts = [t + shared for t in pair]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    got = sorted(tuple(r)[1:] for r in repeats.repeat_report(docs).collect())
    assert got == sorted(brute(texts, 200))


def test_copies_of_a_text_have_one_list_of_spans(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefg ") for _ in range(300)) for _ in range(3)]
    rows = [(None, texts[0])] * 60 + [(5, texts[0])] + [(i, texts[1] + texts[2][:250]) for i in (5, 5)] + [(9, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spans = repeats.repeated_spans(docs)
    assert spans.count() == 3
    assert spans.selectExpr("max(size(spans))").first()[0] <= 300
    got = sorted(tuple(r)[1:] for r in repeats.repeat_report(docs).collect())
    assert got == sorted(brute([t for _, t in rows], 200))
