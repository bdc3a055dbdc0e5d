"""Phrases against a plain count of every n-gram."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from util import AWKWARD, docs_table
from voxtable.llm import phrases


def plain(rows, least, longest=5, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    f = {k: v for k, v in f.items() if v >= least}
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        inside = any(g == lang and len(q) > len(p) and 100 * b >= 100 * a
                     and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), b in f.items())
        if inside:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


def corpus(seed=5, docs=60):
    rng = random.Random(seed)
    words = ["Ärger", "the", "of", "New", "york", "a", "b", "c", "d-e", "漢字", "x y", "Z"]
    marks = [" ", "  ", "\t", " ", " ", " ", ", ", ".\n", "; "]
    rows = []
    for i in range(docs):
        text = "".join(rng.choice(words[:rng.randint(2, 12)]) + rng.choice(marks) for _ in range(rng.randint(1, 90)))
        rows.append((text, rng.choice(["en", "de", None])))
    rows += [("new York city of the new york city", "en")] * 9
    return rows + [(t, l) for t in AWKWARD for l in ("en", None, "und")]


def mined(spark, rows, **args):
    docs = docs_table(spark, [r[0] for r in rows], [r[1] for r in rows])
    return sorted(map(tuple, phrases.mine_phrases(docs, **args).collect()))


@pytest.mark.parametrize("least, top", [(2, 2000), (5, 7)])
def test_equals_plain_count(spark, least, top):
    rows = corpus()
    assert mined(spark, rows, least=least, top=top) == plain(rows, least, top=top)


def test_small_chunks_and_ranges(spark, monkeypatch):
    rows = corpus(6)
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 300)
    monkeypatch.setattr(phrases, "RANGE_ENTRIES", 50)
    assert mined(spark, rows, least=3) == plain(rows, 3)


def test_equal_fingerprints_are_told_apart():
    import numpy as np
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 40, 900).astype(np.int32)
    hashed = rng.integers(0, 2 ** 63, 40).astype(np.uint64)[codes]
    old, phrases.BITS = phrases.BITS, 5                       # 32 fingerprints for all windows
    try:
        for m in (2, 3):
            prints, counts, places = phrases._grams(codes, hashed, m, np.arange(len(codes) - m + 1))
            got = Counter()
            for c, p in zip(counts.tolist(), places.tolist()):
                got[tuple(codes[p:p + m].tolist())] += c
            assert len(got) == len(counts)
            assert got == Counter(tuple(codes[i:i + m].tolist()) for i in range(len(codes) - m + 1))
            assert len(set(prints.tolist())) <= 32
    finally:
        phrases.BITS = old


def test_fingerprint_collisions_over_chunks_do_not_count(spark):
    docs = docs_table(spark, ["p q r s " * 4] * 3, ["en"] * 3)
    chunks = phrases.stored(phrases._chunks(docs), "chunks")
    entries = phrases._words(chunks, 3).collect()
    # The same entries with all fingerprints equal: everything is read back, and text alone decides.
    rows = [(0, r["chunk"], r["m"], bytes(len(r["prints"])), r["counts"], r["places"]) for r in entries]
    frequent = phrases._frequent(spark.createDataFrame(rows, phrases.ENTRY), 13)
    found = phrases._counted(phrases._texts(chunks, frequent, 3), 1)
    assert {r["phrase"]: r["f"] for r in found.collect()} == dict.fromkeys("pqrs", 12)


def test_products_beyond_64_bits(spark):
    rows = [(10 ** 12 + 7, 10 ** 13 + 9, 10 ** 12 + 33, 10 ** 12 + 90), (100, 10 ** 17, 100, 101), (100, 100, 100, 100)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = df.select(F.expr("cast(1000 * cast(a as decimal(18,0)) as decimal(19,0)) * cast(n as decimal(19,0))"
                           " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))").alias("s")).collect()
    assert [int(x["s"]) for x in got] == [1000 * a * n // (l * r) for a, n, l, r in rows]


def test_empty_and_clashing_columns(spark):
    docs = docs_table(spark, ["a b c"] * 3 + [None, ""])
    assert phrases.mine_phrases(docs.limit(0), least=1).count() == 0
    wide = docs.withColumns({c: F.lit("z") for c in ("chunk", "codes", "n", "phrase", "m", "rank")})
    assert {r["phrase"] for r in phrases.mine_phrases(wide, least=3).collect()} == {"a b c"}


@pytest.mark.parametrize("kind", ["u1", "i4", "i8"])
def test_packed_numbers_come_back(kind):
    import numpy as np
    rng = np.random.default_rng(9)
    top = np.iinfo(kind).max
    for values in (np.zeros(0, kind), np.array([top], kind), rng.integers(0, top, 1000).astype(kind)):
        assert phrases._unpacked(phrases._packed(values), kind).tolist() == values.tolist()
    places = np.array([3, 4, 900, 70_000], np.int64)
    assert phrases._unpacked_column([phrases._packed_places(places)] * 2, "places").tolist() == places.tolist() * 2
    prints = phrases._mixed(rng.integers(0, 2 ** 63, 50).astype(np.uint64), 2)
    assert phrases._unpacked_column([phrases._packed_prints(prints)], "prints").tolist() == prints.tolist()


def test_languages_fill_their_chunks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 2000)
    langs = ["en", "de", "fr", "es"]
    docs = docs_table(spark, [f"w{i:03d} " * 20 for i in range(160)], [langs[i % 4] for i in range(160)]).coalesce(1)
    rows = phrases._chunks(docs).collect()
    # 16,000 bytes, 4,000 of each language: a chunk of each language for every 2,000 bytes would be 32.
    assert len(rows) <= 3 * len(langs)
    assert sum(r["n"] for r in rows) == 160 * 20


def test_many_languages_do_not_pile_up(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 100)
    rows = [(f"a b{i % 7} a b{i % 7}", f"l{i % 60}") for i in range(300)]
    assert mined(spark, rows, least=2) == plain(rows, 2)


def test_what_travels_is_packed(spark):
    rng = random.Random(1)
    text = " ".join(f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(60_000))
    chunks = phrases.stored(phrases._chunks(docs_table(spark, [text], ["en"])), "chunks")
    chunk = chunks.first()
    assert sum(len(chunk[c]) for c in ("codes", "words", "ends")) < 2.5 * chunk["n"]         # 4 bytes a code before
    words = phrases.stored(phrases._frequent(phrases._words(chunks, 2), 1), "words")
    entries = phrases._longer(chunks, words, range(2, 3), 2).collect()
    codes = phrases._unpacked(chunk["codes"])
    pairs = len(set(zip(codes[:-1].tolist(), codes[1:].tolist())))
    assert sum(len(r[c]) for r in entries for c in ("prints", "counts", "places")) < 8 * pairs     # 16 before
    assert sum(r["size"] for r in words.collect()) == len(set(codes.tolist()))
