import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from util import AWKWARD, DOCS, by_id, docs_table

from voxtable.llm import hmm
from voxtable.llm.common import table


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0D]+", low) + [None]


def small_model(states=3, classes=5, seed=1):
    rng = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return hmm.Hmm(norm(rng.random(states)), norm(rng.random((states, states))), norm(rng.random((states, classes))))


def paths(model, seq):
    """Probability of every state path."""
    for path in itertools.product(range(len(model.start)), repeat=len(seq)):
        p = model.start[path[0]]
        for t, (s, o) in enumerate(zip(path, seq)):
            p *= model.emit[o, s] * (model.move[path[t - 1], s] if t else 1)
        yield path, p


def test_forward_and_expected_counts_match_all_paths():
    model = small_model()
    seqs = [[0, 1, 4], [2], [3, 3, 0, 1, 4], [1, 1]]
    sizes = np.array([len(s) for s in seqs])
    codes = np.concatenate(seqs).astype(np.int32)
    starts = np.cumsum(sizes) - sizes
    want = [math.log(sum(p for _, p in paths(model, s))) for s in seqs]
    assert np.allclose(model.forward(codes, starts, sizes), want)
    logs, start, move, emit = model.expected(codes, starts, sizes)
    s0, m0, e0 = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for seq, w in zip(seqs, want):
        for path, p in paths(model, seq):
            p /= math.exp(w)
            s0[path[0]] += p
            for t, s in enumerate(path):
                e0[s, seq[t]] += p
                if t:
                    m0[path[t - 1], s] += p
    assert logs == pytest.approx(sum(want), rel=1e-5)
    assert np.allclose(start, s0, atol=1e-5) and np.allclose(move, m0, atol=1e-5) and np.allclose(emit, e0, atol=1e-5)


def test_long_sequences_stay_finite():
    model = small_model()
    codes = np.tile(np.arange(5, dtype=np.int32), 20_000)
    assert np.isfinite(model.forward(codes, np.array([0]), np.array([len(codes)]))).all()


def test_likelihood_rises_and_words_have_whole_probability(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").withColumn("train", F.lit(True))
    counts = hmm.stored(hmm.word_counts(docs), "w")
    vocab = hmm.vocabulary(counts, docs.count())
    encoded = hmm.stored(hmm.encode(docs, spark.sparkContext.broadcast(vocab)), "e")
    model, seen = hmm.Hmm.first(vocab.prior, 4), []
    for _ in range(4):
        model, logs = hmm.baum_welch(encoded, model, vocab.smooth)
        seen.append(logs)
    assert seen == sorted(seen) and seen[-1] > seen[0]
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)
    assert vocab.n == sum(len(tokens(r["text"])) for r in docs.collect())


def check_contract(docs, rows):
    """Everything but the model's own score, counted by hand."""
    import zlib
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    train = Counter(t for i, x in texts.items() if zlib.crc32(str(i).encode()) % 10 for t in tokens(x))
    n, v = sum(train.values()), len(train)
    for r in rows:
        own = tokens(texts[r["doc_id"]])
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert (r["n_tokens"], r["train_tokens"]) == (len(own), n)
        assert r["n_known"] == sum(train[t] > 0 for t in own)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[t] + .1) / (n + .1 * (v + 1))) for t in own))


@pytest.mark.parametrize("head", [28_000, 50])
def test_contract_columns_and_better_than_base(spark, monkeypatch, head):
    monkeypatch.setattr(hmm, "HEAD", head)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = by_id(hmm.score(docs))
    assert len(rows) == 1000
    check_contract(docs, rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_one_state_is_the_class_unigram(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = hmm.score(docs, states=1, rounds=1).collect()
    assert all(abs(r["score"] - r["base_score"]) < 0.05 * r["n_tokens"] for r in rows)


def test_awkward_rows_and_empty_table(spark):
    docs = docs_table(spark, AWKWARD).withColumn("train", F.lit("mine")).withColumn("c", F.lit(1))
    rows = by_id(hmm.score(docs))
    check_contract(docs, rows)
    assert rows[0]["score"] == pytest.approx(rows[6]["score"]) and rows[1]["n_tokens"] == 1
    assert hmm.score(spark.createDataFrame([], DOCS)).count() == 0
    nothing = hmm.score(docs, train=F.lit(False)).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"]) for r in nothing} == {(0, 0, 0.0)}


def test_cut_training_documents(spark, monkeypatch):
    monkeypatch.setattr(hmm, "CUT", 16)
    assert list(hmm._stretches(np.array([3, 40, 16]))) == [3, 16, 16, 8, 16]
    docs = docs_table(spark, ["a b " * 50, "c"] * 4)
    assert all(np.isfinite(r["score"]) for r in hmm.score(docs).collect())


def test_long_training_documents_stay_whole(spark, monkeypatch):
    model, rng = small_model(), np.random.default_rng(5)
    sizes = np.array([3, 50, 16, 33, 1, 32])
    codes = rng.integers(0, 5, sizes.sum()).astype(np.int32)
    whole = model.expected(codes, np.cumsum(sizes) - sizes, sizes)
    monkeypatch.setattr(hmm, "CUT", 16)
    monkeypatch.setattr(hmm, "VECTOR_BYTES", 0)
    monkeypatch.setattr(hmm, "LONG", 20)
    monkeypatch.setattr(hmm, "LONG_TOKENS", 60)
    for a, b in zip(whole, model.expected(codes, np.cumsum(sizes) - sizes, sizes)):
        assert np.allclose(a, b, rtol=1e-5)
    assert whole[1].sum() == pytest.approx(len(sizes), rel=1e-5)
    # The same by a round over chunks: one start a document, a transition between all its tokens.
    rows = [(1, [True] * len(sizes), sizes.tolist(), bytearray(codes.astype(np.uint16).tobytes()))]
    encoded = spark.createDataFrame(rows, "chunk long, train array<boolean>, sizes array<int>, codes binary")
    made, logs = hmm.baum_welch(encoded, model, np.full(5, 0.1))
    want = hmm.Hmm.from_counts(*whole[1:], np.full(5, 0.1))
    assert logs == pytest.approx(whole[0], rel=1e-5)
    assert np.allclose(made.start, want.start, atol=1e-5) and np.allclose(made.move, want.move, atol=1e-5)


def test_long_documents_of_several_chunks_are_scored_together(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").repartition(2)
    want = {r["doc_id"]: r for r in hmm.score(docs).collect()}
    for name, value in (("LONG", 40), ("LONG_TOKENS", 2000), ("VECTOR_BYTES", 1 << 14), ("CUT", 128), ("CHUNK_BYTES", 1 << 14)):
        monkeypatch.setattr(hmm, name, value)
    got = {r["doc_id"]: r for r in hmm.score(docs).collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert r["score"] == pytest.approx(want[i]["score"], rel=1e-3) and r["n_tokens"] == want[i]["n_tokens"]


def test_head_is_all_words_of_the_counts_that_fit(spark, monkeypatch):
    counts = spark.createDataFrame([("a", 9), ("b", 5), ("c", 5), ("d", 5), ("e", 1)], "word string, c long")
    for head, names in ((1, ["a"]), (3, ["a"]), (4, ["a", "b", "c", "d"]), (99, ["a", "b", "c", "d", "e"]), (0, [])):
        monkeypatch.setattr(hmm, "HEAD", head)
        vocab = hmm.vocabulary(counts, 2)
        assert list(vocab.head) == names and vocab.n == 27 and vocab.distinct == 6
