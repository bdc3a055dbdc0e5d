"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Pieces are placed in falling length into the open bin with the least room
that holds them; a new bin gets the permitted length whose cost per token is least when filled greedily with what is
still to come, and at the end every bin shrinks to the least permitted length that holds its contents.

Only the *histogram* of piece lengths decides, and it has at most ``max(capacities)`` entries. So the plan is made once
from that bounded table, as runs: "the pieces of length L with ranks r..r+n go to bins b..b+n at one offset". A piece
finds its bin from its rank among the pieces of its length. Ranks come from counts per (length, hash bucket), so no
length, however common, meets in one task.

A document longer than the largest capacity is cut into full pieces and a rest; nothing is dropped. A document without
tokens (null and empty texts too) has one row of length 0 and null bin. Repeated rows are packed one by one. Very long texts are
counted whole. Only ``doc_id`` and what ``tokens`` reads are used, so other columns may have any name. An empty table gives an
empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtable.llm.common import count_words, parts_for, stored

CAPACITIES = (256, 512, 1024, 2048)
BIN_COST = 16             # what one more bin costs, in tokens
BUCKET_ROWS = 20_000      # pieces per hash bucket, about


def plan_bins(counts: dict[int, int], capacities=CAPACITIES, bin_cost: float = BIN_COST) -> tuple[list, list]:
    """Runs and bins from the histogram ``length -> pieces``.

    Runs ``(length, first rank, n, first bin, offset)``; bins ``(first bin, n, capacity, used)``.
    """
    caps = sorted(capacities)
    room: dict[int, list] = defaultdict(list)      # room left -> runs of bins (first, n, capacity)
    rooms: list[int] = []                          # its keys, rising
    ahead = dict(counts)                           # pieces not yet promised to a bin
    lengths = sorted(counts)
    runs, bins = [], 0

    def put(left, run):
        if not room[left]:
            rooms.insert(bisect_left(rooms, left), left)
        room[left].append(run)

    def filled(length, cap):
        """What a bin of ``cap`` opened for ``length`` would take, greedily, from the pieces ahead."""
        take, left, i = {length: 1}, cap - length, len(lengths) - 1
        while left > 0:
            i = bisect_left(lengths, min(left, lengths[i]) + 1) - 1 if i >= 0 else -1
            if i < 0:
                break
            size = lengths[i]
            n = min(left // size, ahead[size] - take.get(size, 0))
            if n > 0:
                take[size] = take.get(size, 0) + n
                left -= n * size
            i -= 1
        return take, cap - left

    def price(used):
        return (caps[bisect_left(caps, used)] + bin_cost) / used

    for length in reversed(lengths):
        rank, todo = 0, counts[length]
        while todo:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                options = [(price(used), cap, take) for cap in caps if cap >= length
                           for take, used in [filled(length, cap)]]
                _, cap, take = min(options, key=lambda o: o[:2])
                n = max(1, min(todo, *[ahead[s] // k for s, k in take.items()]))
                for s, k in take.items():
                    ahead[s] = max(0, ahead[s] - n * k)
                put(cap, (bins, n, cap))
                bins += n
                continue
            left = rooms[at]
            first, n, cap = room[left].pop()
            if not room[left]:
                rooms.pop(at)
            k = min(n, todo)
            runs.append((length, rank, k, first, cap - left))
            put(left - length, (first, k, cap))
            if n > k:
                put(left, (first + k, n - k, cap))
            rank, todo = rank + k, todo - k
    closed = [(first, n, caps[bisect_left(caps, cap - left)], cap - left)
              for left, same in room.items() for first, n, cap in same]
    return runs, sorted(closed)


def pieces(docs: DataFrame, tokens, capacities=CAPACITIES) -> DataFrame:
    """``doc_id, piece, length``: full pieces of the largest capacity and the rest."""
    most = max(capacities)
    sized = docs.select("doc_id", tokens.cast("long").alias("_n"))
    last = F.greatest(F.ceil(F.col("_n") / most) - 1, F.lit(0)).cast("int")
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    return cut.select("doc_id", "piece", F.least(F.col("_n") - F.col("piece").cast("long") * most, F.lit(most))
                      .cast("int").alias("length"))


def _ranked(cut: DataFrame, buckets: int) -> DataFrame:
    """Rank of each piece among those of its length, from 0, in order of (bucket, doc_id, piece)."""
    cut = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = cut.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
                    .select("length", "_b", "_start"), "pack-starts")
    inside = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece")) - 1
    return (cut.withColumn("_i", inside).join(starts, ["length", "_b"])
            .withColumn("rank", F.col("_i") + F.col("_start")).drop("_b", "_i", "_start"))


def pack(docs: DataFrame, tokens=None, capacities=CAPACITIES, bin_cost: float = BIN_COST) -> DataFrame:
    """One row per piece: ``doc_id, piece, length, bin_id, bin_offset, capacity, bin_used``."""
    cut = stored(pieces(docs, count_words("text") if tokens is None else tokens, capacities), "pack-pieces")
    counts = {r["length"]: r["n"] for r in cut.filter("length > 0").groupBy("length")
              .agg(F.count(F.lit(1)).alias("n")).collect()}          # at most max(capacities) rows
    runs, bins = plan_bins(counts, capacities, bin_cost)
    runs = np.array(sorted(runs), np.int64).reshape(-1, 5)
    bins = np.array(bins, np.int64).reshape(-1, 4)
    keys = runs[:, 0] * 2 ** 44 + runs[:, 1]                         # (length, rank) in one number

    @F.pandas_udf("bin_id long, bin_offset int, capacity int, bin_used int")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = length.to_numpy(np.int64) * 2 ** 44 + rank.to_numpy(np.int64)
        run = runs[np.searchsorted(keys, key, side="right") - 1]
        bin_id = run[:, 3] + rank.to_numpy(np.int64) - run[:, 1]
        box = bins[np.searchsorted(bins[:, 0], bin_id, side="right") - 1]
        return pd.DataFrame({"bin_id": bin_id, "bin_offset": run[:, 4], "capacity": box[:, 2], "bin_used": box[:, 3]})

    ranked = _ranked(cut.filter("length > 0"), parts_for(sum(counts.values()), BUCKET_ROWS, least=64))
    placed = ranked.withColumn("_p", place("length", "rank")).select("doc_id", "piece", "length", "_p.*")
    empty = cut.filter("length = 0").select(
        "doc_id", "piece", "length", F.lit(None).cast("long").alias("bin_id"),
        *[F.lit(None).cast("int").alias(c) for c in ("bin_offset", "capacity", "bin_used")])
    return placed.unionByName(empty)
