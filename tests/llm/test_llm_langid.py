import numpy as np
import pytest
from pyspark.sql import functions as F
from util import AWKWARD, DOCS, by_id, docs_table

from voxtable.llm import langid
from voxtable.llm.common import stored, table

SF = "/root/testdata/sf0.01"


def grams_of(text):
    clean = "".join(c.lower() if c.isalpha() else " " for c in text)
    clean = "   " + " ".join(clean.split()) + " " if clean.split() else "   "
    return [clean[i - 3:i + 1] for i in range(3, len(clean))]


def plain_kn(texts_by_lang):
    """Interpolated Kneser-Ney with dictionaries, straight from the definition."""
    counts = {}
    for lang, texts in texts_by_lang.items():
        for t in texts:
            for g in grams_of(t):
                counts.setdefault(lang, {}).setdefault(g, 0)
                counts[lang][g] += 1
    size = len({g[-1] for c in counts.values() for g in c})

    def prob(lang, g):
        top = counts[lang]
        levels = {4: top}
        for n in (3, 2, 1):
            levels[n] = {}
            for h in levels[n + 1]:
                levels[n][h[1:]] = levels[n].get(h[1:], 0) + 1
        p = 1 / (size + 1)
        for n in (1, 2, 3, 4):
            level = levels[n]
            ones, twos = (sum(v == k for v in level.values()) for k in (1, 2))
            d = min(0.95, max(0.1, ones / (ones + 2 * twos) if ones else 0.5))
            own = {h: v for h, v in level.items() if h[:-1] == g[4 - n:3]}
            if own:
                total = sum(own.values())
                p = max(own.get(g[4 - n:], 0) - d, 0) / total + d * len(own) / total * p
        return p

    return prob


@pytest.fixture(scope="module")
def tiny():
    texts = {"en": ["the thing then", "a hen, the ten!"], "xx": ["zzo ozz zo", "ozo é zoz"]}
    rows = {}
    for lang, ts in texts.items():
        for t in ts:
            for g in grams_of(t):
                rows[lang, g] = rows.get((lang, g), 0) + 1
    keys = sorted(rows)
    model = langid.Model(["en", "xx"], np.array([[ord(c) for c in g] for _, g in keys], np.int64),
                         np.array([["en", "xx"].index(k[0]) for k in keys]), np.array([rows[k] for k in keys]))
    return texts, model


def test_cross_entropy_matches_the_definition(tiny):
    texts, model = tiny
    prob = plain_kn(texts)
    asked = ["the hen", "zo the", "unseen Q", "é", "", None, "12 !", "  the ", "ten" * 50]
    ce, n, letters = model.cross_entropies(asked)
    for i, t in enumerate(asked):
        g = grams_of(t or "")
        assert letters[i] == any(c.isalpha() for c in t or "")
        if letters[i]:
            assert n[i] == len(g)
            for j, lang in enumerate(model.langs):
                assert ce[i, j] == pytest.approx(-np.mean([np.log(prob(lang, x)) for x in g]), rel=1e-4)


def test_probabilities_sum_to_one(tiny):
    _, model = tiny
    alphabet = sorted({ord(c) for c in "the thing then a hen the ten zzo ozz zo ozo é zoz "})
    for context in ("the", "zzo", "qqq", "   "):
        parts = [np.full(len(alphabet) + 1, ord(c)) for c in context] + [np.array([*alphabet, 0x9999])]
        total = np.exp(model._logs(4, parts).astype(float)).sum(axis=0)
        assert np.allclose(total, 1, atol=1e-4), context


def test_held_out_accuracy_and_awkward_rows(spark):
    docs = table(spark, SF, "documents")
    rows = langid.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert sum(r["rejected"] for r in rows) < 10 and all(0 <= r["score"] <= 1 for r in rows)
    model = langid.train(docs)
    odd = by_id(docs_table(spark, AWKWARD).withColumn("score", F.lit(7))
                .withColumn("r", langid.identified(docs, model)).select("doc_id", "r.*"))
    assert [r["lang_pred"] for r in odd[1:4]] == ["und"] * 3 and all(r["rejected"] for r in odd[1:4])
    assert odd[9]["lang_pred"] == "und" and odd[0]["lang_pred"] in model.langs
    assert odd[4]["rejected"]                                       # five thousand x


def test_training_reads_neither_held_out_rows_nor_other_columns(spark):
    docs = table(spark, SF, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    other = docs.withColumn("lang", F.when(held, F.lit("qq")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    cols = ["doc_id", "lang_pred", "rejected"]
    assert by_id(langid.language_report(docs).select(cols)) == by_id(langid.language_report(other).select(cols))


def test_nothing_to_learn_from(spark):
    docs = docs_table(spark, AWKWARD, langs=[None] * len(AWKWARD))
    assert {r["lang_pred"] for r in langid.language_report(docs).collect()} == {"und"}
    assert langid.language_report(spark.createDataFrame([], DOCS)).count() == 0


def test_filter_keeps_columns_and_clean_rows(spark):
    docs = table(spark, SF, "documents").withColumn("rejected", F.lit("mine"))
    kept = langid.keep_identified(docs.unionByName(docs_table(spark, [None, "!!"], ids=[-1, -2])
                                                   .withColumn("rejected", F.lit("mine"))))
    assert kept.columns == docs.columns and kept.count() >= 995 and kept.filter("doc_id < 0").count() == 0


def test_one_unlike_document_does_not_move_the_limits(spark):
    docs = table(spark, SF, "documents")
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz    "))

    def noise(n):
        return "".join(rng.choice(letters, n))

    german = " ".join(r["text"] for r in docs.filter("lang = 'de'").orderBy("doc_id").limit(40).collect())
    plain = langid.train(docs)
    lengths = np.array([50, 300, 2000, 20_000])
    for first in (-1, -40):                                         # counted or held back, by the hash of id and text
        added = docs_table(spark, [noise(20_000), german[:20_000]], ids=[first, first - 1])
        model = langid.train(docs.unionByName(added))
        assert np.allclose(model.highest(lengths), plain.highest(lengths), rtol=0.1)
        got = model.identify([noise(n) for n in lengths])
        assert got["rejected"].all(), got
        kept = langid.keep_identified(docs.unionByName(added))
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert first not in ids and len(ids) >= 990


def test_few_languages_move_no_texts(spark):
    rows = [(i, "word%d " % i * 40, ["en", "de"][i % 2], "s") for i in range(400)]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "texts")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        plan = langid._training_rows(docs.select("doc_id", "text", "lang"), 3000)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
