import math

import pytest
from pyspark.sql import functions as F
from util import DOCS, by_id, docs_table

from voxtable.llm import mixing
from voxtable.llm.common import stored


def expected_targets(sizes, share=1.5, limit=2.0, weights=(5, 2, 1)):
    """Resharing by hand: hold what is above its limit, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    held, left = {}, set(order)
    while True:
        rest = share * sum(sizes.values()) - sum(held.values())
        total = sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * rest / total > limit * sizes[s] + 1e-9]
        if not over:
            return held | {s: weight[s] * rest / total for s in left}
        held |= {s: limit * sizes[s] for s in over}
        left -= set(over)


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 3, "d": 40, None: 500}, {"x": 7}, {"Z": 0, "a": 5, "é": 900},
    {f"s{i}": (i * 37) % 101 + 1 for i in range(25)}])
def test_targets_match_resharing_by_hand(spark, sizes):
    rows = [(s, n) for s, total in sizes.items() for n in (total // 2, total - total // 2)]
    got = {r["source"]: r["target"] for r in
           mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = expected_targets(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s]) and got[s] <= 2 * sizes[s] + 1e-9
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_report_is_near_targets_and_repeats(spark):
    texts = ["w " * (1 + i % 7) for i in range(6000)]
    docs = docs_table(spark, texts, sources=[("hot", "b", None)[0 if i % 3 else 1 + i % 2] for i in range(6000)])
    a = by_id(mixing.mix_report(docs))
    assert a == by_id(mixing.mix_report(docs.repartition(13)))
    for source in ("hot", "b", None):
        own = [r for r in a if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 0.05 * own[0]["target"]
        rate = own[0]["target"] / own[0]["source_size"]
        assert {r["copies"] for r in own} <= {math.floor(rate), math.floor(rate) + 1}
    assert all(r["taken"] <= 2 * r["size"] for r in a)


def test_mix_emits_copies_with_columns_as_given(spark):
    docs = docs_table(spark, ["a b", None, "", "c"], sources=["x", "x", None, "y"]).withColumn("rate", F.lit("mine"))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_report(docs).collect()}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in copies.items() if v} and {r["rate"] for r in out.collect()} == {"mine"}


def test_empty_and_wordless_tables(spark):
    assert mixing.mix_report(spark.createDataFrame([], DOCS)).count() == 0
    rows = mixing.mix_report(docs_table(spark, [None, "", " "])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 3


def test_rows_without_an_id_of_their_own_draw_alone(spark):
    rows = [(None if i % 2 else 10_000 + i, "w " * 4, "s") for i in range(6000)] + [(7, "w " * (3 + i % 2), "s") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    a, b = mixing.mix_report(docs).collect(), mixing.mix_report(docs.repartition(3)).collect()
    for got in (a, b):
        assert abs(sum(r["taken"] for r in got) - got[0]["target"]) < 0.02 * got[0]["target"]
    same = [sorted((r["doc_id"] or 0, r["size"], r["copies"]) for r in x) for x in (a, b)]
    assert same[0] == same[1] and len(a) == 8000
    taken = sum(r["n"] for r in mixing.mix(docs).groupBy("text").count().selectExpr("count * size(split(trim(text), ' ')) as n").collect())
    assert taken == sum(r["taken"] for r in a)


def test_few_repeated_ids_move_no_texts(spark):
    rows = [(i % 399, "word%d " % i * 40, "s") for i in range(400)] + [(None, "no id", "s")]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, source string"), "texts")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        made = mixing.with_seed(docs, F.md5("text"))
        plan = made._jdf.queryExecution().executedPlan().toString()
        seeds = [r.seed for r in made.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(seeds) == len(set(seeds)) == 401
    joins = [line for line in plan.splitlines() if "LeftAnti" in line or "LeftSemi" in line]
    assert joins and all("Broadcast" in line for line in joins)
