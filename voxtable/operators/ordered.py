"""Ordered operators that hold when one key owns a third of the table.

A plain ``Window.partitionBy(key)`` sends a whole key to one task.  Here the order column is
cut into buckets first: narrow per-bucket totals are accumulated over the buckets of a key,
and the row-level window runs inside ``(key, bucket)`` only.  Buckets are a fixed function
of the row, so a recomputed task lands in the same bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxtable.functions import bits

FAN = 1 << 15            # buckets whose totals one window accumulates
WIDTH = 1 << 16          # rows of a unique integer order column that share one bucket
HASH_DIGITS = 4          # hex digits of an md5 order key that form one bucket


def _const_key(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn("_every", F.lit(0)), ["_every"])


def number_bucket(order: str, width: int = WIDTH) -> Column:
    return F.floor(F.col(order) / F.lit(width))


def rejoin(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join one row per key to many rows per key; a null key meets a null key.

    No hint and no switch: the planner broadcasts by measured size and splits skewed keys.
    """
    named = small.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in small.columns])
    match = [big[c].eqNullSafe(named[f"_on_{c}"]) for c in on]
    return big.join(named, match, how).drop(*[f"_on_{c}" for c in on])


def before_buckets(totals: DataFrame, keys: Sequence[str], value: str, out: str, past: str = "sum") -> DataFrame:
    """``keys, _b, out``: what lies in all earlier buckets of the key, of ``totals(keys, _b, value)``.

    Runs of ``FAN`` buckets are totalled first, so a window holds ``FAN`` rows of a key with up to ``FAN ** 2`` buckets.
    ``past`` is ``sum``, 0 without earlier buckets, or ``max``, null without.
    """
    fold = {"sum": F.sum, "max": F.max}[past]

    def earlier(column: str, over: Sequence[str], order: str) -> Column:
        return fold(column).over(W.partitionBy(*over).orderBy(order).rowsBetween(W.unboundedPreceding, -1))

    rows = totals.select(*keys, "_b", F.col(value).alias("_v"), F.floor(F.col("_b") / FAN).alias("_run"))
    runs = rows.groupBy(*keys, "_run").agg(fold("_v").alias("_t"))
    runs = runs.select(*keys, "_run", earlier("_t", keys, "_run").alias("_far"))
    rows = rejoin(rows.withColumn("_near", earlier("_v", [*keys, "_run"], "_b")), runs, [*keys, "_run"])
    if past == "max":
        return rows.select(*keys, "_b", F.greatest("_far", "_near").alias(out))
    return rows.select(*keys, "_b", (F.coalesce("_far", F.lit(0)) + F.coalesce("_near", F.lit(0))).alias(out))


def row_index(df: DataFrame, keys: Sequence[str], order: str, out: str = "idx",
              width: int = WIDTH, bucket: Column | None = None) -> DataFrame:
    """Exact 0-based position of each row in its key, by a column unique within the key.

    ``bucket`` must not decrease along ``order`` and have at most ``16 ** HASH_DIGITS`` values; by default it is
    ``floor(order / width)``, with any number of values.
    """
    df, k = _const_key(df, keys)
    df = df.withColumn("_b", number_bucket(order, width) if bucket is None else bucket)
    starts = df.groupBy(*k, "_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = before_buckets(starts, k, "_n", "_start") if bucket is None else starts.select(*k, "_b", F.coalesce(
        F.sum("_n").over(W.partitionBy(*k).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    local = F.row_number().over(W.partitionBy(*k, "_b").orderBy(order)) - 1
    out_df = (rejoin(df.withColumn("_local", local), starts, [*k, "_b"])
              .withColumn(out, (F.col("_start") + F.col("_local")).cast("long"))
              .drop("_b", "_local", "_start"))
    return out_df.drop("_every")


def hash_index(df: DataFrame, keys: Sequence[str], order: str, out: str = "idx") -> DataFrame:
    """:func:`row_index` for an md5 order column."""
    return row_index(df, keys, order, out, bucket=F.substring(F.col(order), 1, HASH_DIGITS))


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str = "running",
                before: bool = False, width: int = WIDTH, stop_at=None) -> DataFrame:
    """Running total along a unique integer order; ``before=True`` leaves the row itself out.

    With non-negative values ``stop_at`` drops whole buckets that start at or past that total
    before any row-level work.
    """
    df, k = _const_key(df, keys)
    df = df.withColumn("_b", number_bucket(order, width))
    sums = df.groupBy(*k, "_b").agg(F.sum(value).alias("_s"))
    sums = before_buckets(sums, k, "_s", "_start")
    if stop_at is not None:
        sums = sums.where(F.col("_start") < F.lit(stop_at))
    w = W.partitionBy(*k, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    rows = rejoin(df, sums, [*k, "_b"])
    return (rows.withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(w), F.lit(0)))
            .drop("_b", "_start", "_every"))


def rolling_mean(df: DataFrame, keys: Sequence[str], index: str, value: str, window: int,
                 out: str = "smoothed", width: int = WIDTH) -> DataFrame:
    """Mean of the row and its ``window - 1`` predecessors along a dense 0-based index.

    A row is repeated as lead-in into every later bucket that its window reaches.
    """
    k = list(keys)
    b = F.floor(F.col(index) / F.lit(width))
    copies = F.sequence(b, F.floor((F.col(index) + F.lit(window - 1)) / F.lit(width)))
    rep = df.withColumn("_own", b).withColumn("_b", F.explode(copies))
    w = W.partitionBy(*k, "_b").orderBy(index).rowsBetween(-(window - 1), 0)
    return (rep.withColumn(out, F.avg(value).over(w)).where(F.col("_own") == F.col("_b"))
            .drop("_own", "_b"))


def best_before(df: DataFrame, keys: Sequence[str], index: str, value: str, out: str = "best_before",
                width: int = WIDTH) -> DataFrame:
    """Largest value on any earlier row of the key, null on the first row."""
    k = list(keys)
    df = df.withColumn("_b", F.floor(F.col(index) / F.lit(width)))
    tops = df.groupBy(*k, "_b").agg(F.max(value).alias("_m"))
    tops = before_buckets(tops, k, "_m", "_past", past="max")
    inside = W.partitionBy(*k, "_b").orderBy(index).rowsBetween(W.unboundedPreceding, -1)
    return (rejoin(df, tops, [*k, "_b"])
            .withColumn(out, F.greatest(F.col("_past"), F.max(value).over(inside)))
            .drop("_b", "_past"))


def hash_cutoffs(df: DataFrame, key: str, *wanted: Column) -> DataFrame:
    """One row ``cutoffs``: for every ``n`` the ``n``-th smallest md5 value of ``key`` ('' when ``n`` is 0).

    Each ``n`` is an aggregate over ``df``.  Per-prefix counts find the prefixes that hold the
    cuts, and only the rows of those prefixes are ranked, so picking ``n`` rows becomes the
    filter ``key <= cutoff`` with no shuffle of the rows themselves.  All cuts share both passes.
    """
    sized = df.select(F.col(key).alias("_h"), F.substring(F.col(key), 1, HASH_DIGITS).alias("_b"))
    counts = sized.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    w = W.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)     # at most 16**HASH_DIGITS rows
    upto = F.sum("_n").over(w)
    numbers = df.agg(F.array(*[n.cast("long") for n in wanted]).alias("n")).scalar()
    cum = counts.withColumns({"_end": upto, "_want": numbers}).withColumn("_start", F.col("_end") - F.col("_n"))
    inside = F.filter("_want", lambda n: (n > F.col("_start")) & (n <= F.col("_end")))
    hit = cum.select("_b", F.transform(inside, lambda n: n - F.col("_start")).alias("_ranks"), "_start").where(F.size("_ranks") > 0)
    ranked = sized.join(hit, "_b").withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy("_h")))
    picked = ranked.where(F.array_contains("_ranks", F.col("_r").cast("long"))).select(
        (F.col("_start") + F.col("_r")).alias("_at"), "_h")
    found = [F.max(F.when(F.col("_at") == F.col("_want")[i], F.col("_h"))) for i in range(len(wanted))]
    return picked.withColumn("_want", numbers).agg(F.array(*[F.coalesce(f, F.lit("")) for f in found]).alias("cutoffs"))


def hash_cutoff(df: DataFrame, key: str, n: Column) -> DataFrame:
    """:func:`hash_cutoffs` of one ``n``, as ``cutoff``."""
    return hash_cutoffs(df, key, n).select(F.get("cutoffs", F.lit(0)).alias("cutoff"))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float],
                      out: str = "pct", accuracy: int = 256, is_array: bool = False) -> DataFrame:
    """Exact interpolated percentiles per key (array column ``out``), for keys of any size.

    Two rounds.  Values are counted by their leading bits, ``accuracy`` bins an octave, which names the bins that hold the
    wanted ranks and the ranks inside them; then the distinct values of those bins alone are counted.  ``is_array`` treats
    ``value`` as an array of numbers: both counts happen inside the row, and only counts leave it.  Nulls do not take part,
    NaN is the largest number.  ``accuracy`` changes the work, never the result.
    """
    df, k = _const_key(df, keys)
    qs = [float(q) for q in qs]
    shift = bits.shift_for(accuracy)
    if is_array:
        rows = df.select(*k, F.col(value).cast("array<double>").alias("_a"))
        bins = rows.select(*k, F.explode(bits.bin_counts(shift)("_a")).alias("_e")).select(*k, "_e.*")
        bins = bins.groupBy(*k, "p").agg(F.sum("n").alias("n"))
    else:
        rows = df.select(*k, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
        rows = rows.withColumn("p", bits.bin_of(shift)("v"))
        bins = rows.groupBy(*k, "p").agg(F.count(F.lit(1)).alias("n"))
    # The ranks wanted around each percentile, as columns.
    ranks = [f(F.lit(q) * (F.col("_n") - 1)).cast("long") for q in qs for f in (F.floor, F.ceil)]
    along = W.partitionBy(*k)
    upto = F.sum("n").over(along.orderBy("p").rowsBetween(W.unboundedPreceding, 0))
    bins = bins.withColumns({"_before": upto - F.col("n"), "_n": F.sum("n").over(along)})
    wanted = bins.groupBy(*k).agg(F.max("_n").alias("_n"), *[
        F.max(F.when((r >= F.col("_before")) & (r < F.col("_before") + F.col("n")), F.struct("p", "_before"))).alias(f"_w{i}")
        for i, r in enumerate(ranks)])
    wanted = wanted.withColumn("_bins", F.array_distinct(F.array(*[F.col(f"_w{i}.p") for i in range(len(ranks))])))
    rows = rejoin(rows, wanted.select(*k, "_bins"), k)
    if is_array:
        found = rows.select(*k, F.explode(bits.values_in_bins(shift)("_a", "_bins")).alias("_e")).select(*k, "_e.*")
    else:
        found = rows.where(F.array_contains("_bins", F.col("p"))).select(*k, "p", "v", F.lit(1).cast("long").alias("n"))
    found = found.groupBy(*k, "p", "v").agg(F.sum("n").alias("n"))
    inside = W.partitionBy(*k, "p").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    found = rejoin(found.withColumn("_upto", F.sum("n").over(inside)), wanted.drop("_bins"), k)
    picks = found.groupBy(*k).agg(F.max("_n").alias("_n"), *[
        F.min(F.when((F.col("p") == F.col(f"_w{i}.p")) & (F.col("_upto") > r - F.col(f"_w{i}._before")), F.col("v")))
        .alias(f"_v{i}") for i, r in enumerate(ranks)])
    whole = []
    for i, q in enumerate(qs):
        low, high, place = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}"), F.lit(q) * (F.col("_n") - 1)
        whole.append(low + (high - low) * (place - F.floor(place)))
    return picks.select(*k, F.array(*whole).alias(out)).drop("_every")
