"""Queries for splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.functions import arrays as A
from voxtable.functions.hashing import hash_split
from voxtable.functions.numeric import rounded
from voxtable.operators import sampling as S
from voxtable.plans.registry import query
from voxtable.plans.views import ROW_KEY, r6, study, table, with_views

SPLIT = """keys AS (SELECT DISTINCT o_custkey AS k FROM orders),
ord AS (SELECT k, row_number() OVER (ORDER BY md5('42|' || k)) AS rn, count(*) OVER () AS n FROM keys),
sizes AS (SELECT any_value(n) AS n, CAST(round_even(any_value(n) * 0.15, 0) AS BIGINT) AS t,
  CAST(round_even(any_value(n) * 0.15, 0) AS BIGINT) AS v0 FROM ord),
fit AS (SELECT n, least(v0, greatest(0, n - t - 1)) AS v, t FROM sizes),
split AS (SELECT k, CASE WHEN rn <= least(t, greatest(0, fit.n - v - 1)) THEN 'test'
  WHEN rn <= least(t, greatest(0, fit.n - v - 1)) + v THEN 'val' ELSE 'train' END AS split FROM ord, fit)"""


@query("case_split", f"WITH {SPLIT} SELECT o_orderkey, o_custkey, split FROM orders JOIN split ON k = o_custkey")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return S.split_cases(o, "o_custkey")


@query("split_members", f"""WITH {SPLIT}
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT k FROM split WHERE split = 'val')""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    split = S.split_cases(o.select("o_custkey").distinct(), "o_custkey")
    return S.members(o, split, "val", key="o_custkey")


FLAGGED = """, fl AS (SELECT case_id, z, bool_or(m = 1) AS has_lesion FROM study GROUP BY case_id, z)"""


def flagged(spark, d):
    return study(spark, d).select("case_id", "z", A.any_positive("mask").alias("has_lesion"))


@query("slice_positivity", with_views(FLAGGED + " SELECT * FROM fl", "study"))
def _(spark, d):
    return flagged(spark, d)


@query("balanced_sample", with_views(FLAGGED + """,
c AS (SELECT least(count(*) FILTER (NOT has_lesion), CAST(floor(1.5 * count(*) FILTER (has_lesion)) AS BIGINT)) AS k FROM fl),
o AS (SELECT *, row_number() OVER (PARTITION BY has_lesion ORDER BY md5('0|' || case_id || '|' || z)) AS rn FROM fl)
SELECT case_id, z, has_lesion FROM o, c WHERE has_lesion OR rn <= k""", "study"))
def _(spark, d):
    return S.sample_slices(flagged(spark, d), neg_per_pos=1.5)


@query("positive_sample", with_views(FLAGGED + " SELECT * FROM fl WHERE has_lesion", "study"))
def _(spark, d):
    return S.sample_slices(flagged(spark, d))


@query("class_weight", with_views(FLAGGED + f"""
SELECT count(*) FILTER (has_lesion) AS n_pos, count(*) FILTER (NOT has_lesion) AS n_neg,
  {r6('count(*) FILTER (NOT has_lesion) / greatest(1, count(*) FILTER (has_lesion))')} AS pos_weight FROM fl""", "study"))
def _(spark, d):
    return S.class_weight(flagged(spark, d)).withColumn("pos_weight", rounded("pos_weight"))


@query("hash_split", """
SELECT l_linestatus, count(*) FILTER (u < 0.8) AS n_train, count(*) FILTER (u >= 0.8) AS n_test FROM (
  SELECT l_linestatus, ('0x' || substr(md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), 1, 7))::BIGINT
    / CAST(268435456 AS DOUBLE) AS u FROM lineitem) q GROUP BY l_linestatus""")
def _(spark, d):
    part = hash_split(42, {"train": 0.8, "test": 0.2}, *ROW_KEY[:4])
    li = table(spark, d, "lineitem").withColumn("part", part)
    return li.groupBy("l_linestatus").agg(F.count_if(F.col("part") == "train").alias("n_train"),
                                          F.count_if(F.col("part") == "test").alias("n_test"))
