"""The whole pipeline against a version without Spark."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_llm_mixing import expected_targets
from test_llm_neardup import brute as near_brute
from util import AWKWARD, DOCS, docs_table

import corpus_pipeline
from voxtable.llm import langid
from voxtable.llm.common import table

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def cut_repeats(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for text, r in zip(texts, raws):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = True
        at, kept = 0, []
        for ch in text or "":
            n = len(ch.encode())
            if not gone[at:at + n].all():
                kept.append(ch)
            at += n
        out.append("".join(kept))
    return out


def plain(rows, model):
    """``doc_id -> words in the mix`` by brute force; rows are (doc_id, text, source)."""
    judged = model.identify([t for _, t, _ in rows])["rejected"].tolist()
    rows = [r for r, out in zip(rows, judged) if not out]
    kept = [x[3] for x in near_brute([(i, t) for i, t, _ in rows], 5, 80)]
    rows = [r for r, keep in zip(rows, kept) if keep]
    rows = [(i, t, s) for (i, _, s), t in zip(rows, cut_repeats([t for _, t, _ in rows]))]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    targets = expected_targets(dict(sizes))
    out = {}
    for i, t, s in rows:
        rate = targets[s] / sizes[s] if sizes[s] else 0.0
        u = int(hashlib.md5(f"mix-1|{i}".encode()).hexdigest()[:13], 16) / 16 ** 13
        n = math.floor(rate) + (u < rate - math.floor(rate))
        if n:
            out[i] = n * len(words(t))
    return out


def test_matches_brute_force(spark):
    docs = table(spark, SF, "documents")
    model = langid.train(docs)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.orderBy("doc_id").collect()]
    got = defaultdict(int)
    packed = corpus_pipeline.run(spark, SF).collect()
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert dict(got) == plain(rows, model)
    room = defaultdict(int)
    for r in packed:
        if r["bin_id"] is not None:
            room[r["bin_id"], r["capacity"], r["bin_used"]] += r["length"]
    assert all(used == n <= cap for (_, cap, used), n in room.items())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_awkward_and_empty_tables(spark, name, stage):
    docs = docs_table(spark, AWKWARD, langs=["en", None] * 5, sources=["a", None] * 5)
    out = stage(spark, docs, SF)
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.columns == docs.columns
    out.collect()
    assert stage(spark, spark.createDataFrame([], DOCS), SF).count() == 0
