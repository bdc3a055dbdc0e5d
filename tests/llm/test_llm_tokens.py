import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from util import AWKWARD, DOCS, by_id, docs_table

from voxtable.llm import tokens
from voxtable.llm.common import table

PIECES = ["▁", "a", "b", "▁a", "ab", "▁ab", "ba", "abab", "▁the", "the", "t", "h", "e", "é", "aa", "aaa"]


def forward(scores, byte, word):
    """Every segmentation's best score, without a trie."""
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        wide = len(word[i - 1].encode())
        options = [(best[i - 1][0] + byte * wide, -(-best[i - 1][1] + wide))]
        options += [(best[j][0] + scores[word[j:i]], best[j][1] - 1) for j in range(i) if word[j:i] in scores]
        best.append(max(options))
    return -best[-1][1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abthe éx漢", min_size=1, max_size=12).map(lambda w: re.sub(r"\s", "", w)), min_size=1, unique=True))
def test_trie_matches_plain_forward(words):
    counter = tokens.Counter(PIECES)
    words = [w for w in words if w]
    got = counter.many(words)
    assert list(got) == [forward(counter.scores, counter.byte, "▁" + w) for w in words]
    assert list(got) == [counter.one("▁" + w) for w in words]


def test_long_words_do_not_depend_on_the_border():
    counter = tokens.Counter(PIECES)
    for n in (tokens.LONG - 2, tokens.LONG - 1, tokens.LONG, 3 * tokens.LONG):
        word = ("abthe" * n)[:n]
        assert counter.many([word, "a"])[0] == forward(counter.scores, counter.byte, "▁" + word)


def test_whole_vocabulary_on_whole_texts(spark):
    counter = tokens.Counter(tokens.load_pieces(tokens.default_vocabulary()))
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = {r["doc_id"]: r for r in tokens.count_tokens(docs).collect()}
    for r in docs.limit(40).collect():
        words = re.findall("[^\x20\x09-\x0D]+", r["text"])
        assert got[r["doc_id"]]["n_tokens"] == sum(counter.one("▁" + w) for w in words)
        assert (got[r["doc_id"]]["n_pretokens"], got[r["doc_id"]]["n_distinct"]) == (len(words), len(set(words)))


def test_agrees_with_a_unigram_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    pieces = tokens.load_pieces(tokens.default_vocabulary())
    counter = tokens.Counter(pieces)
    own = tokenizers.models.Unigram([("<unk>", 0.0), *[(p, s) for p, s in counter.scores.items()]], 0, False)
    for word in ("the", "reading", "Internationalisation", "thanedble", "ofreshedou"):
        assert counter.one("▁" + word) == len(own.tokenize("▁" + word))


def test_awkward_rows(spark):
    rows = by_id(tokens.count_tokens(docs_table(spark, AWKWARD)))
    assert [r["n_tokens"] for r in rows[1:4]] == [0, 0, 0] and rows[0]["n_tokens"] == rows[6]["n_tokens"] > 0
    assert rows[4]["n_pretokens"] == 1 and rows[4]["n_tokens"] > 0 and rows[5]["n_pretokens"] == 3000
    assert tokens.count_tokens(spark.createDataFrame([], DOCS)).count() == 0
