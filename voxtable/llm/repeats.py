"""Suffix-array deduplication: all bytes covered by a string of ``length`` bytes that starts at least twice.

The collection is cut down, without losing a repeat, to what a task can build:

1. Of every window of ``length`` bytes the leftmost ``gram`` with the least hash is its *anchor*. Equal windows have
   equal anchors at equal places, so only windows of one anchor can match. The windows of one anchor occurrence are a
   run of starts; with their bytes they are a *fragment*, and anchors that occur once are dropped.
2. Fragments that are equal, by 128 bits of anchor and digest, repeat entirely. Of every other anchor with different
   fragments one fragment each goes on, cut into runs of ``WIDTH`` starts whose windows share a *core*; cores that occur
   once are dropped.
3. What is left goes in buckets by core to the column-wise construction (``bwt``): a string is the bytes left of the
   core, the core as one symbol, and the bytes right of it, so a window is ``WIDTH`` symbols, and it repeats if a
   neighbouring suffix shares that many. A core with very many different strings needs no neighbours: its windows are
   counted one by one, so no bucket grows without bound.

Null texts are empty. Texts shorter than ``length`` have no repeat. Matches never cross documents; rows of one text repeat each
other, whatever their ids, which are not used. Very long texts are hashed in blocks. Added columns start with two underscores and a
random word, so other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm.bwt import repeated_starts
from voxtable.llm.common import bounded, parts_for, release, settle, stored

LENGTH = 200
BUCKET = 8192                   # strings built together, about
MANY = 4096                     # different strings of one core beyond which windows are counted
BLOCK = 1 << 20                 # starts hashed at once
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93))


def sizes_for(length: int) -> tuple[int, int]:
    """``(gram, width)`` for a window length."""
    return max(1, min(32, length // 4)), max(1, min(16, length // 4))


def anchors(raw: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``(hash, place, first start, last start)`` of the anchors of a text of at least ``length`` bytes."""
    gram, _ = sizes_for(length)
    with np.errstate(over="ignore"):
        done, left, power = None, gram, _A
        piece, size = raw.astype(np.uint64) * _B + np.uint64(77), 1
        while left:                                       # grams by doubling
            if left & 1:
                done = (piece, size, power) if done is None else (
                    done[0][:len(piece) - done[1]] * power + piece[done[1]:], done[1] + size, done[2] * power)
            left >>= 1
            if left:
                piece, size, power = piece[:-size] * power + piece[size:], size * 2, power * power
        h = done[0][:len(raw) - gram + 1]
        h = (h ^ (h >> np.uint64(29))) * _C
        h = h ^ (h >> np.uint64(32))
    wide, span = length - gram + 1, 1
    best, place = h, np.arange(len(h), dtype=np.int64)
    while span < wide:                                    # leftmost minimum of every window, by doubling
        step = min(span, wide - span)
        later = best[step:] < best[:-step]
        best, place = (np.where(later, x[step:], x[:-step]) for x in (best, place))
        span += step
    cuts = np.flatnonzero(place[1:] != place[:-1]) + 1
    first = np.concatenate([[0], cuts])
    return h[place[first]], place[first], first, np.concatenate([cuts - 1, [len(place) - 1]])


def text_key(text: Column) -> list[Column]:
    """128 bits of a text: two hashes with seeds of their own. Rows of one text have the same spans, whatever their ids."""
    return [F.xxhash64(F.lit(seed), text) for seed in (1, 2)]


def keyed(docs: DataFrame) -> DataFrame:
    """``k1, k2, text``: the texts and what tells them apart in the joins below."""
    text = F.coalesce("text", F.lit(""))
    one, two = text_key(text)
    return docs.select(one.alias("k1"), two.alias("k2"), text.alias("text"))


def _fragments(rows: DataFrame, length: int) -> DataFrame:
    """``anchor, digest, k1, k2, at``; ``at`` packs the anchor's place and how far the starts reach back from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text", 4 << 20):
            found = []
            for k1, k2, text in zip(*[b.column(c).to_pylist() for c in ("k1", "k2", "text")]):
                raw = text.encode("utf-8", "surrogatepass")
                codes = np.frombuffer(raw, np.uint8)
                for a in range(0, len(raw) - length + 1, BLOCK):
                    h, place, low, high = anchors(codes[a:a + BLOCK + length - 1], length)
                    place, low, high = place + a, low + a, high + a
                    digest = [xxhash.xxh3_64_intdigest(raw[i:j + length]) for i, j in zip(low.tolist(), high.tolist())]
                    found.append((h.view(np.int64), np.array(digest, np.uint64).view(np.int64), np.full(len(h), k1),
                                  np.full(len(h), k2), place << 32 | (place - low) << 16 | (place - high)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)],
                                                 names=["anchor", "digest", "k1", "k2", "at"])
        release()

    return rows.mapInArrow(run, "anchor long, digest long, k1 long, k2 long, at long")


_STRING = "key long, cut long, anchor long, digest long, back int, starts int, left binary, right binary"


def _strings(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The runs of starts around each core of the wanted fragments."""
    _, width = sizes_for(length)
    core = length - width + 1
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list("anchor").alias("anchors"),
                                           F.collect_list("digest").alias("digests"), F.collect_list("at").alias("ats"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text", 2 << 20):
            out = []
            for text, *lists in zip(*[b.column(c).to_pylist() for c in ("text", "anchors", "digests", "ats")]):
                raw = text.encode("utf-8", "surrogatepass")
                for anchor, digest, at in zip(*lists):
                    p, low, high = at >> 32, (at >> 32) - (at >> 16 & 0xFFFF), (at >> 32) - (at & 0xFFFF)
                    for j in range((p - high) // width, (p - low) // width + 1):
                        c = p - width * j                                   # the core's first byte
                        s, e = max(low, c - width + 1), min(high, c)
                        left, right = raw[s:c], raw[c + core:e + length]
                        key = xxhash.xxh3_64_intdigest(raw[c:c + core], j)
                        cut = xxhash.xxh3_64_intdigest(bytes([len(left)]) + left + right, e - s)
                        out.append((key - 2 ** 63, cut - 2 ** 63, anchor, digest, p - s, e - s + 1, left, right))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()] * 2)],
                    names=[c.split()[0] for c in _STRING.split(", ")])
        release()

    both = rows.join(lists, ["k1", "k2"]).select("text", "anchors", "digests", "ats")
    return both.mapInArrow(run, _STRING)


def _built(strings: DataFrame, width: int, buckets: int) -> DataFrame:
    """``key, cut, mask`` by the column-wise construction over each bucket."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        _, core = np.unique(table.column("key").to_numpy(), return_inverse=True)
        sizes, parts = [], []
        lefts, rights = table.column("left").to_pylist(), table.column("right").to_pylist()
        for c, left, right in zip(core.tolist(), lefts, rights):
            parts += [np.frombuffer(left, np.uint8), np.array([256 + c]), np.frombuffer(right, np.uint8)]
            sizes.append(len(left) + 1 + len(right))
        sizes = np.array(sizes, np.int64)
        string, size = repeated_starts(np.concatenate(parts), sizes, width)
        start = sizes[string] - size
        # Starts past the core are suffixes, too, but no windows.
        window = start < table.column("starts").to_numpy()[string]
        mask = np.zeros(len(sizes), np.int64)
        np.bitwise_or.at(mask, string[window], np.int64(1) << start[window])
        return pa.table({"key": table.column("key"), "cut": table.column("cut"), "mask": mask}).filter(pa.array(mask != 0))

    return (strings.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
            .groupBy("bucket").applyInArrow(run, "key long, cut long, mask long"))


def _counted(strings: DataFrame, width: int) -> DataFrame:
    """``key, cut, mask`` by counting the windows of each core; for cores with very many strings."""
    i = F.col("i")
    windows = strings.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("starts") - 1)))
    lead = F.octet_length("left") - i
    windows = windows.select("key", "cut", "n", "i", F.substring("left", i + 1, lead).alias("l"),
                             F.substring("right", F.lit(1), F.lit(width - 1) - lead).alias("r"))
    twice = windows.groupBy("key", "l", "r").agg(F.sum("n").alias("c")).filter("c > 1").drop("c")
    return (windows.join(twice, ["key", "l", "r"]).groupBy("key", "cut")
            .agg(F.sum(F.expr("shiftleft(1L, i)")).alias("mask")))


def _partial(rows: DataFrame, distinct: DataFrame, length: int) -> DataFrame:
    """``anchor, digest, parts``: the repeated starts of fragments that differ from others of their anchor."""
    spark = rows.sparkSession
    _, width = sizes_for(length)
    mixed = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor")
    wanted = stored(distinct.join(stored(mixed, "mixed"), "anchor").select("anchor", "digest", "rep.*"), "wanted")
    strings = stored(_strings(rows, wanted, length), "strings")
    settle(spark)
    cuts = strings.groupBy("key", "cut").agg(F.count(F.lit(1)).alias("n"), F.first("starts").alias("starts"),
                                             F.first("left").alias("left"), F.first("right").alias("right"))
    cuts = stored(cuts, "cuts")
    keys = stored(cuts.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("all")).filter("all > 1"), "cores")
    met = stored(cuts.join(keys, "key"), "met")
    settle(spark)
    whole = met.filter("n > 1").select("key", "cut", F.expr("shiftleft(1L, starts) - 1").alias("mask"))
    few = met.filter(f"c > 1 and c <= {MANY}")
    masks = _built(few.select("key", "cut", "starts", "left", "right"), width, parts_for(few.count(), BUCKET))
    masks = masks.unionByName(whole).unionByName(_counted(met.filter(f"c > {MANY}"), width))
    masks = stored(masks.groupBy("key", "cut").agg(F.bit_or("mask").alias("mask")), "masks")
    settle(spark)
    hit = strings.select("key", "cut", "anchor", "digest", "back").join(masks, ["key", "cut"])
    return stored(hit.groupBy("anchor", "digest").agg(F.collect_list(F.struct("back", "mask")).alias("parts")), "parts")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``k1, k2, spans`` of the rows of ``keyed(docs)`` with repeats: runs of repeated starts as ``[first, last]``.

    Runs are neither sorted nor merged; one list per distinct text, bounded by it however often it occurs.
    """
    spark = docs.sparkSession
    rows = keyed(docs)
    fragments = stored(_fragments(rows, length), "fragments")
    again = stored(fragments.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor"), "again")
    hits = stored(fragments.join(again, "anchor"), "hits")
    settle(spark)
    distinct = stored(hits.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"),
                                                           F.min(F.struct("k1", "k2", "at")).alias("rep")), "distinct")
    settle(spark)
    parts = _partial(rows, distinct, length)
    known = distinct.filter("n > 1").select("anchor", "digest", F.lit(None).cast(parts.schema["parts"].dataType).alias("parts"))
    alone = distinct.filter("n = 1").select("anchor", "digest").join(parts, ["anchor", "digest"])
    known = stored(known.unionByName(alone), "known")
    place, low, high = (F.shiftright("at", 32), F.shiftright("at", 16).bitwiseAND(0xFFFF), F.col("at").bitwiseAND(0xFFFF))
    places = hits.dropDuplicates(["k1", "k2", "at"])          # copies of a text have the same places
    found = places.join(known, ["anchor", "digest"]).select(
        "k1", "k2", F.struct(place.alias("place"), (place - low).alias("first"), (place - high).alias("last"),
                             "parts").alias("f"))
    return stored(found.groupBy("k1", "k2").agg(F.collect_list("f").alias("spans")), "spans")


def covered(size: int, spans, length: int) -> np.ndarray:
    """Flag of every byte that a repeated window covers."""
    edge = np.zeros(size + 1, np.int64)
    for f in (() if spans is None else spans):
        if f["parts"] is None:
            edge[f["first"]] += 1
            edge[f["last"] + length] -= 1
            continue
        for part in f["parts"]:
            start, mask = f["place"] - part["back"], int(part["mask"])
            for i in range(mask.bit_length()):
                if mask >> i & 1:
                    edge[start + i] += 1
                    edge[start + i + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def _with_spans(docs: DataFrame, length: int, name: str) -> DataFrame:
    """Every row with its spans (null without repeats) in the column ``name``."""
    spans = repeated_spans(docs, length)
    settle(docs.sparkSession)
    one, two = text_key(F.coalesce("text", F.lit("")))
    rows = docs.withColumns({f"{name}_1": one, f"{name}_2": two})
    named = spans.select(F.col("k1").alias(f"{name}_1"), F.col("k2").alias(f"{name}_2"), F.col("spans").alias(name))
    return rows.join(named, [f"{name}_1", f"{name}_2"], "left").drop(f"{name}_1", f"{name}_2")


def repeat_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text", 4 << 20):
            rows = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("__spans")):
                raw = (text or "").encode("utf-8", "surrogatepass")
                gone = covered(len(raw), spans.as_py(), length)
                runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[:1].sum())
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if runs else raw
                rows.append((len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c) for c in zip(*rows)]],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs.select("doc_id", "text"), length, "__spans").select("doc_id", "text", "__spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _kept_text(length: int, spans: str) -> Column:
    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, spans):
            if text is None or found is None:
                out.append(text)
                continue
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            keep = ~covered(len(raw), found, length)
            # A character goes only if all its bytes go.
            head = np.flatnonzero((raw & 0xC0) != 0x80)
            keep = np.repeat(np.bitwise_or.reduceat(keep, head), np.diff(np.append(head, len(raw))))
            out.append(raw[keep].tobytes().decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    return cut(F.col("text"), F.col(spans))


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents without the repeated bytes, cut at whole characters; columns and rows as given."""
    name = f"__spans_{uuid.uuid4().hex[:8]}"
    rows = _with_spans(docs, length, name)
    return rows.withColumn("text", _kept_text(length, name)).select(*[F.col(f"`{c}`") for c in docs.columns])
