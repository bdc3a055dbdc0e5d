"""Mixing sources to target weights: water-filled targets, repetition rates, hash-seeded copies.

Tokens are aggregated per source; each source gets a target by weight, held at ``limit`` times its size, the excess
going to the others by weight. ``rate = target / size``; a document is emitted ``floor(rate)`` times, and once more if
its hash-seeded draw is below the fraction. The draw depends on seed and ``doc_id`` only, so reruns and lost executors
change nothing; rows without an id of their own draw by their text and a running number.

Null sources form one source, last in order. Null and empty texts have size 0 and are emitted like any other row. Very long
texts are counted whole. An empty table gives an empty result. Added columns of ``mix`` start with two underscores and a random
word, so other columns may have any name and pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtable.llm.common import count_words, stored
from voxtable.operators.ordered import row_index

WEIGHTS = (5, 2, 1)
SHARE, LIMIT, SEED = 1.5, 2.0, "mix-1"


def draw(key: str | Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(seed|key)."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(16 ** 13))


def with_seed(rows: DataFrame, digest: Column, out: str = "seed") -> DataFrame:
    """Rows with the text that seeds their draw: the id, if only one row has it.

    Rows without an id of their own add a digest of their text and, among rows equal in both, a running number. Equal rows
    may swap numbers on a rerun, which changes nothing but their order. Numbers are given by runs of rows, so a text that a third
    of all rows repeat is no window of its own.
    """
    mark = f"__{out}_{uuid.uuid4().hex[:8]}"
    ids, group, row = f"{mark}_id", f"{mark}_group", f"{mark}_row"
    several = rows.groupBy(F.col("doc_id").alias(ids)).agg(F.count(F.lit(1)).alias(mark)).filter(
        F.col(ids).isNull() | (F.col(mark) > 1)).select(ids)
    several = stored(several, "mix-several")       # of known size, so that few of them move no rows
    same = rows["doc_id"].eqNullSafe(several[ids])
    own = rows.join(several, same, "left_anti").withColumn(out, F.col("doc_id").cast("string"))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), digest)
    loose = rows.join(several, same, "left_semi").withColumns({group: key, row: F.monotonically_increasing_id()})
    loose = row_index(loose, [group], row, out=mark).withColumn(out, F.concat(F.col(group), F.lit("|"), F.col(mark)))
    return own.unionByName(loose.drop(group, row, mark))


def source_targets(sizes: DataFrame, share: float = SHARE, limit: float = LIMIT,
                   weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source of ``sizes(source, size)``: ``source, source_size, target, rate``.

    Sorted by ``limit * size / weight``, the sources below the water level are held at their limit; the level at a
    source is what is left for it and all after it, per weight. The windows run over one narrow row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                        ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", pick).withColumn("_cap", limit * F.col("source_size"))
    rising = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    whole, before = Window.partitionBy(), rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = (per.withColumn("_rest", share * F.sum("source_size").over(whole)
                          - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
           .withColumn("_left", F.sum("_w").over(after))
           .withColumn("_held", F.col("_cap") * F.col("_left") < F.col("_rest") * F.col("_w")))
    level = F.min(F.when(~F.col("_held"), F.struct(F.col("_cap") / F.col("_w"), F.col("_rest") / F.col("_left"))))
    per = per.withColumn("_level", level.over(whole).getField("col2"))
    target = F.when(F.col("_held"), F.col("_cap")).otherwise(F.col("_w") * F.col("_level"))
    return per.select("source", "source_size", target.alias("target"),
                      F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
                      .alias("rate"))


def _copies(rate: Column, seed: str) -> Column:
    return (F.floor(rate) + (draw(seed) < rate - F.floor(rate)).cast("long")).cast("long")


def _digest() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def _sizes(docs: DataFrame) -> DataFrame:
    return stored(docs.select("doc_id", "source", count_words("text").alias("size"),
                              _digest().alias("digest")), "mix-sizes")


def _with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    named = rates.withColumnRenamed("source", "_source")
    return rows.join(named, rows["source"].eqNullSafe(named["_source"])).drop("_source")


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, copies, taken``."""
    sizes = _sizes(docs)
    rates = stored(source_targets(sizes, **how), "mix-rates")
    got = _with_rates(with_seed(sizes, F.col("digest")), rates).withColumn("copies", _copies(F.col("rate"), "seed"))
    return got.select("doc_id", "source", "size", "source_size", "target", "copies",
                      (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; columns as given."""
    rates = stored(source_targets(_sizes(docs), **how).select("source", "rate"), "mix-rates")
    word = f"__mix_{uuid.uuid4().hex[:8]}"
    source, rate, copies, seed = (f"{word}_{k}" for k in ("source", "rate", "copies", "seed"))
    named = rates.select(F.col("source").alias(source), F.col("rate").alias(rate))
    rows = with_seed(docs, _digest(), seed)
    rows = rows.join(named, rows["source"].eqNullSafe(named[source]))
    rows = rows.withColumn(copies, _copies(F.col(rate), seed)).filter(F.col(copies) > 0)
    return (rows.withColumn(word, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
         2.0::DOUBLE * source_size AS cap FROM per),
rest AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()
            - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w
  FROM weighed),
held AS (SELECT *, cap * left_w < rest * w AS held FROM rest),
targets AS (
  SELECT source, source_size,
         CASE WHEN held THEN cap
              ELSE w * (SELECT arg_min(rest / left_w, cap / w) FROM held WHERE NOT held) END::DOUBLE AS target FROM held),
rated AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1|' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated"""
