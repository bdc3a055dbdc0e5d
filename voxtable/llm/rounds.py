"""Links between members of many overlapping lists (buckets, posting lists), without a list of all pairs.

``connect`` takes ``lists(key, id, n, c, ...)``: every list's members with their set sizes and the list's length ``c``. Two
sets are linked if ``100 * intersection >= percent * union``, and only sets that share a list are compared.

1. Lists of up to ``SMALL`` members give all their pairs, longer ones the pairs of every member with a *centre*, the
   member of least hash, which is the same in lists that share members. Each set first confirms its likeliest pair on full
   sets, then the pairs that still lie in different components.
2. Long lists with several components get further centres, as long as every round halves the rows of such lists. A round is
   linear in the lists, and so are all rounds together.
3. What is left is compared in blocks: a cheap test names the members that may have a partner, those get their full sets
   once, and a task links them by union-find. It emits at most one link less than it has members, never a list of pairs.

Every pair of list mates in different components has then been judged, by the caller's tests or on full sets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import settle, stored
from voxtable.llm.graph import components

SMALL = 8
BLOCK = 512                                    # members of a long list that are compared at once
SHRINK = 2                                     # rounds go on while one leaves at most this part of the rows in mixed lists


def members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with ``100 * intersection >= percent * union`` on full sets."""

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("sa"), b.column("sb")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                at = np.searchsorted(x, y)
                same = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0
                ok.append(100 * same >= percent * (len(x) + len(y) - same))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = (pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b"))
    return both.mapInArrow(run, "a long, b long")


def sizes_fit(x, y, percent: int):
    """Whether sets of these sizes can be linked; columns or numbers."""
    least, most = (F.least, F.greatest) if not isinstance(y, np.ndarray) else (np.minimum, np.maximum)
    return 100 * least(x, y) >= percent * most(x, y)


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("id"))
    return rows.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").withColumn(
        "label", F.coalesce("component", "id")).drop("component")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    for end in ("a", "b"):
        own = labels.select(F.col("node").alias(end), F.col("component").alias(f"l{end}"))
        pairs = pairs.join(own, end, "left").withColumn(f"l{end}", F.coalesce(f"l{end}", end))
    return pairs.filter("la <> lb").drop("la", "lb")


def _pairs(x: DataFrame, y: DataFrame, close: Callable, *more) -> DataFrame:
    """``a, b, shared``: distinct pairs of list mates of ``x`` and ``y`` that pass the test, and the lists they share."""
    both = x.alias("x").join(y.alias("y"), "key")
    own, other = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    for test in (close(own, other), *more):
        both = both.filter(test)
    return both.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b"))


def _centred(rows: DataFrame, seed: int, close: Callable) -> DataFrame:
    """Pairs of members with the centre of their list, in different components."""
    columns = [c for c in rows.columns if c != "key"]
    centre = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(seed)).alias("__o"), *columns)).alias("z"))
    return _pairs(rows, centre.select("key", "z.*").drop("__o"), close, F.col("x.label") != F.col("y.label"))


def _mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the lists that hold several components, with ``label``."""
    tagged = stored(_labelled(rows, labels), "labelled")
    mixed = tagged.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    return stored(tagged.join(mixed, "key"), "mixed")


class _Sets:
    """Full sets, read once for every class that needs one."""

    def __init__(self, sets_of: Callable):
        self.sets_of, self.rows = sets_of, None

    def of(self, ids: DataFrame) -> DataFrame:
        if self.rows is not None:
            ids = stored(ids.join(self.rows.select("id"), "id", "left_anti"), "missing")
            if ids.isEmpty():
                return self.rows
        more = stored(self.sets_of(ids), "sets")
        self.rows = more if self.rows is None else self.rows.unionByName(more)
        return self.rows


def _block_pairs(n: np.ndarray, label: np.ndarray, part: np.ndarray, across: bool, percent: int):
    """``(x, y)``: every row with the later ones, sorted by size, that its size, component and part leave possible."""
    for x in range(len(n)):
        stop = int(np.searchsorted(n, n[x] * 100 // percent, side="right"))
        y = np.arange(x + 1, stop)
        y = y[(label[y] != label[x]) & ((part[y] != part[x]) if across else True)]
        if len(y):
            yield x, y


def _blocks(rows: DataFrame, kind: str, fits: Callable, percent: int) -> DataFrame:
    """``key, i, j, part, id, n, label``: members of blocks that may have a partner in their block."""
    cut = rows.withColumn("parts", F.ceil(F.col("c") / BLOCK).cast("int"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # A part meets every later part of its list and itself: a row goes to as many blocks as there are parts.
    spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("parts", "other", "c")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("n")
        across = table.column("i")[0].as_py() < table.column("j")[0].as_py()
        n, label, part = (table.column(c).to_numpy() for c in ("n", "label", "part"))
        test, good = fits(table), np.zeros(len(n), bool)
        for x, y in _block_pairs(n, label, part, across, percent):
            y = y[test(x, y)]
            good[y] = True
            good[x] |= len(y) > 0
        return table.select(["key", "i", "j", "part", "id", "n", "label"]).filter(pa.array(good))

    return spread.groupBy("key", "i", "j").applyInArrow(run, f"key {kind}, i int, j int, part int, id long, n long, label long")


def _once(blocks: DataFrame) -> DataFrame:
    """One of each set of blocks with the same members."""
    marks = [F.bit_xor(F.xxhash64("id", "part", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    named = blocks.groupBy("key", "i", "j").agg(F.count(F.lit(1)).alias("m"), *marks)
    one = named.groupBy("m", "h1", "h2").agg(F.min(F.struct("key", "i", "j")).alias("x")).select("x.*")
    return blocks.join(one, ["key", "i", "j"])


def _joined(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join components inside blocks, found on full sets: at most one less than a block has members."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("n")
        across = table.column("i")[0].as_py() < table.column("j")[0].as_py()
        ids, n, part = (table.column(c).to_numpy() for c in ("id", "n", "part"))
        label = table.column("label").to_numpy().copy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles").combine_chunks()]
        known, place = np.unique(np.concatenate(sets), return_inverse=True)
        cuts = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        flag, found = np.zeros(len(known), np.int64), []
        for x, y in _block_pairs(n, label, part, across, percent):
            flag[place[cuts[x]:cuts[x + 1]]] = 1
            first, last = int(y[0]), int(y[-1]) + 1
            both = np.add.reduceat(flag[place[cuts[first]:cuts[last]]], cuts[first:last] - cuts[first])[y - first]
            flag[place[cuts[x]:cuts[x + 1]]] = 0
            for z in y[100 * both >= percent * (n[x] + n[y] - both)]:
                if label[z] != label[x]:
                    found.append((ids[x], ids[z]))
                    label[label == label[z]] = label[x]
        a, b = zip(*found) if found else ([], [])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return blocks.join(sets, "id").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def connect(lists: DataFrame, percent: int, close: Callable, judge: Callable, sets_of: Callable, dress: Callable,
            fits: Callable) -> DataFrame:
    """``node, component`` of every linked member of ``lists``; members without link are left out.

    ``close(x, y)`` tests two list rows as columns, ``judge(pairs)`` adds ``estimate`` and may drop hopeless pairs, ``sets_of``
    reads ``id, shingles``, ``dress`` adds columns to rows for ``fits(table)``, which returns the test of row ``x`` with ``y``.
    """
    alike = lambda x, y: sizes_fit(x("n"), y("n"), percent) & close(x, y)
    rows = _labelled(lists, None)
    small, large = rows.filter(F.col("c") <= SMALL), rows.filter(F.col("c") > SMALL)
    pairs = _pairs(small, small, alike, F.col("x.id") < F.col("y.id")).unionByName(_centred(large, 0, alike))
    pairs = stored(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")), "pairs")
    likely = stored(judge(pairs), "likely")
    first = stored(likely.groupBy("a").agg(F.max_by("b", F.struct("estimate", -F.col("b"))).alias("b")), "first")
    sets = _Sets(sets_of)
    settle(lists.sparkSession)
    links = stored(confirmed(first, sets.of(members(likely)), percent), "links")
    labels = stored(components(links), "labels")
    rest = _apart(likely.select("a", "b").join(first, ["a", "b"], "left_anti"), labels)
    more = stored(confirmed(rest, sets.rows, percent), "links")
    if not more.isEmpty():
        links = stored(links.unionByName(more), "links")
        labels = stored(components(links), "labels")
    tried, seed, before = likely.select("a", "b"), 0, None
    large = lists.filter(F.col("c") > SMALL)
    while True:
        left = _mixed(large, labels)
        size = left.count()
        if not size:
            return labels
        if before is not None and SHRINK * size > before:
            break
        settle(lists.sparkSession)
        before, seed = size, seed + 1
        pairs = _centred(left, seed, alike).distinct().join(tried, ["a", "b"], "left_anti").withColumn("shared", F.lit(1))
        first = stored(judge(pairs).groupBy("a").agg(F.max_by("b", F.struct("estimate", -F.col("b"))).alias("b")), "first")
        more = stored(confirmed(first, sets.of(members(first)), percent), "links")
        if more.isEmpty():
            break
        links, tried = stored(links.unionByName(more), "links"), tried.unionByName(first.select("a", "b"))
        labels = stored(components(links), "labels")
    kind = lists.schema["key"].dataType.simpleString()
    blocks = stored(_once(stored(_blocks(dress(left), kind, fits, percent), "blocks")), "blocks")
    more = stored(_joined(blocks, sets.of(blocks.select("id").distinct()), percent), "links")
    if more.isEmpty():
        return labels
    return stored(components(links.unionByName(more)), "labels")
