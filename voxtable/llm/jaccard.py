"""Jaccard join of documents on word shingles by a grouped prefix join.

Shingles have one order: rare before frequent, then by hash. Of two sets with similarity ``t`` or more the first
``n - ceil(t * n) + 1`` shingles, their *prefixes*, share at least one. The order only decides how few candidates there are,
so frequencies are taken from ``2 ** COUNTERS`` shared counters, two million levels of one byte that are sent to all tasks.

1. Equal sets (by a digest of 128 bits) are one class. Classes with the same size and the same prefix are one *group*.
2. Groups send their prefixes to ranges of shingle hashes. A range keeps the shingles that several groups share, and of their
   groups those with a mate of fitting size: the posting lists.
3. Lists are expanded to the members of their groups; a group with several members is a list, too. List mates
   whose places in the prefixes leave the similarity possible are verified on full sets, as :mod:`rounds` says, so a list of
   any length is linear in its members unless they are unlike.

A third of all documents in one group of copies is one class; in one group of near copies, every round of centres joins most of
it. Postings travel packed, as many as a fixed share of the shingles, and nothing is collected but the counters.

Null and empty texts have the empty set and link with nothing. Texts with fewer words than a shingle have their whole word
sequence as one shingle. Repeated rows are equal sets, whatever their ids. Very long texts are read whole. A component is
named by its least ``doc_id``; one without any is named null. Only ``doc_id`` and ``text`` are read, so other columns may have
any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import bounded, parts_for, release, stored
from voxtable.llm.rounds import connect
from voxtable.llm.shingles import TEXT_BYTES, class_sets, digests, shingle_sets

COUNTERS = 21                                  # binary logarithm of the number of frequency counters
SLICES = 64
RANGE_SHINGLES = 2_000_000                     # postings of a range, about

POSTING = "range int, shingles binary, groups binary, sizes binary, places binary, counts binary"


def frequency_levels(docs: DataFrame, words: int) -> np.ndarray:
    """Four levels an octave of the document count of every counter, as bytes."""
    size = 1 << COUNTERS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in bounded(batches, "text", TEXT_BYTES):
            _, hashes = shingle_sets(b.column("text"), words)
            total += np.bincount((hashes >> np.uint64(64 - COUNTERS)).astype(np.int64), minlength=size)
        cut = total.reshape(SLICES, -1)
        used = np.flatnonzero(cut.any(axis=1))
        kind = np.uint16 if total.max() < 1 << 16 else np.int64
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)),
                                          pa.array([cut[k].astype(kind).tobytes() for k in used], pa.binary())],
                                         names=["slice", "counts"])
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, own = np.zeros(size // SLICES, np.int64), 0
        for b in batches:
            own = b.column("slice")[0].as_py()
            for x in b.column("counts").to_pylist():
                total += np.frombuffer(x, np.uint16 if len(x) == 2 * len(total) else np.int64)
        level = np.floor(4 * np.log2(np.maximum(total, 1))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([level.tobytes()], pa.binary())],
                                         names=["slice", "levels"])

    rows = docs.select("text").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(
        add, "slice int, levels binary").collect()
    levels = np.zeros((SLICES, size // SLICES), np.uint8)
    for r in rows:
        levels[r["slice"]] = np.frombuffer(r["levels"], np.uint8)
    return levels.ravel()


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def prefixes(ends: np.ndarray, hashes: np.ndarray, levels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """``(ends, shingles)``: the first shingles of every set, rare ones first."""
    n = np.diff(ends, prepend=0)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, levels[(hashes >> np.uint64(64 - COUNTERS)).astype(np.int64)], row))
    keep = prefix_sizes(n, percent)
    place = np.arange(len(hashes)) - np.repeat(ends - n, n)
    return np.cumsum(keep), hashes[order][place < keep[row]]


def _prefixed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, text_key, n, digest, shape, prefix`` of every document; the last three are null for empty sets."""
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text", TEXT_BYTES):
            ends, hashes = shingle_sets(b.column("text"), words)
            n = np.diff(ends, prepend=0)
            stops, first = prefixes(ends, hashes, levels.value, percent)
            prefix = [first[a:z].tobytes() if z > a else None for a, z in zip(np.concatenate([[0], stops[:-1]]), stops)]
            shape = [xxhash.xxh3_128_digest(p + int(k).to_bytes(8, "big")) if p else None for p, k in zip(prefix, n)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(n), pa.array(digests(ends, hashes), pa.binary()),
                 pa.array(shape, pa.binary()), pa.array(prefix, pa.binary())],
                names=["doc_id", "text_key", "n", "digest", "shape", "prefix"])
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(
        run, f"doc_id {kind}, text_key long, n long, digest binary, shape binary, prefix binary")


def _postings(groups: DataFrame, ranges: int) -> DataFrame:
    """Prefix shingles of ``groups(gid, n, members, prefix)``, packed by range of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in bounded(iter([whole]), "prefix", TEXT_BYTES):
                sizes = pc.divide(pc.binary_length(b.column("prefix")), 8).to_numpy()
                shingles = np.frombuffer(b"".join(b.column("prefix").to_pylist()), np.uint64)
                row = np.repeat(np.arange(b.num_rows), sizes)
                place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                own = ((shingles >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(own, kind="stable")
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(own[order])) + 1, [len(own)]])
                gid, n, members = (b.column(c).to_numpy() for c in ("gid", "n", "members"))
                columns = [shingles[order], gid[row][order], n[row][order].astype(np.int32), place[order].astype(np.int32),
                           members[row][order].astype(np.int32)]
                spans = [(a, z) for a, z in zip(cuts, cuts[1:]) if z > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(own[order[a]]) for a, _ in spans], pa.int32()),
                     *(pa.array([c[a:z].tobytes() for a, z in spans], pa.binary()) for c in columns)],
                    names=["range", "shingles", "groups", "sizes", "places", "counts"])
        release()

    return groups.select("gid", "n", "members", "prefix").mapInArrow(run, POSTING)


def _lists(postings: DataFrame, percent: int) -> DataFrame:
    """``key, gid, n, pos, c``: shingles that several groups share, with the groups that have a mate of fitting size."""

    def run(table: pa.Table) -> pa.Table:
        key, gid, n, pos, members = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (
            ("shingles", np.uint64), ("groups", np.int64), ("sizes", np.int32), ("places", np.int32), ("counts", np.int32)))
        order = np.lexsort((n, key))
        key, gid, n, pos, members = (x[order] for x in (key, gid, n, pos, members))
        # Sorted by size, a group has a fitting mate if the next smaller or the next larger one fits.
        mate = (key[1:] == key[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64))
        good = np.zeros(len(key), bool)
        good[1:] |= mate
        good[:-1] |= mate
        key, gid, n, pos, members = (x[good] for x in (key, gid, n, pos, members))
        _, place = np.unique(key, return_inverse=True)
        c = np.bincount(place, weights=members).astype(np.int64)[place] if len(key) else members.astype(np.int64)
        return pa.table({"key": pa.array(key.view(np.int64)), "gid": pa.array(gid), "n": pa.array(n.astype(np.int64)),
                         "pos": pa.array(pos.astype(np.int64)), "c": pa.array(c)})

    return postings.groupBy("range").applyInArrow(run, "key long, gid long, n long, pos long, c long")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs(doc_id, text)``."""
    docs = docs.select("doc_id", "text")
    rows = stored(_prefixed(docs, words, percent), "prefixes")
    full = rows.filter("digest is not null")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("best")
    classes = stored(full.groupBy("digest").agg(best, F.first("n").alias("n"), F.first("shape").alias("shape"))
                     .withColumn("id", F.monotonically_increasing_id()), "classes")
    groups = stored(classes.groupBy("shape").agg(F.min("id").alias("gid"), F.count(F.lit(1)).alias("members")), "groups")
    total = classes.agg(F.sum("n")).first()[0] or 0
    sent = groups.join(full.groupBy("shape").agg(F.first("prefix").alias("prefix"), F.first("n").alias("n")), "shape")
    shared = stored(_lists(_postings(sent, parts_for(total * (100 - percent) // 100, RANGE_SHINGLES, 8)), percent), "lists")
    grouped = classes.join(groups, "shape")
    alike = grouped.filter("members > 1").select(
        F.xxhash64("shape").alias("key"), "id", "n", F.lit(0).cast("long").alias("pos"), F.col("members").alias("c"))
    lists = shared.join(grouped.select("gid", "id"), "gid").select("key", "id", "n", "pos", "c")
    lists = stored(lists.unionByName(alike), "members")

    def close(x, y):
        # All shingles shared by two sets lie at or behind their first shared one, in both.
        most = F.least(x("n") - x("pos"), y("n") - y("pos"))
        return (100 + percent) * most >= percent * (x("n") + y("n"))

    def fits(table: pa.Table):
        n, pos = (table.column(c).to_numpy() for c in ("n", "pos"))
        return lambda x, y: (100 + percent) * np.minimum(n[x] - pos[x], n[y] - pos[y]) >= percent * (n[x] + n[y])

    labels = connect(lists, percent, close, lambda pairs: pairs.withColumn("estimate", F.col("shared")),
                     lambda ids: class_sets(docs, ids, classes, words), lambda rows: rows, fits)
    named = stored(classes.join(labels, classes["id"] == labels["node"], "left").select(
        "digest", "best", F.coalesce("component", "id").alias("component")), "components")
    least = named.groupBy("component").agg(F.min("best").alias("best"))
    named = named.select("digest", "component").join(least, "component").select("digest", "best.doc_id")
    out = rows.select("doc_id", "n", "digest").join(named.withColumnRenamed("doc_id", "least"), "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


# Pairs by shared shingles, one text per set, then reachability; for small tables.
JOIN_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END)) AS s FROM worded),
classes AS (SELECT s, min(doc_id) AS id FROM sets WHERE len(s) > 0 GROUP BY s),
one AS MATERIALIZED (SELECT id, len(s) AS n, unnest(s) AS g FROM classes),
links AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b FROM one a JOIN one b ON a.g = b.g AND a.id <> b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT id AS a, id AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
named AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
SELECT t.doc_id, len(t.s)::BIGINT AS n_shingles, coalesce(n.component_id, t.doc_id) AS component_id
FROM sets t LEFT JOIN classes c ON c.s = t.s LEFT JOIN named n ON n.id = c.id"""
