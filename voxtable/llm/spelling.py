"""Spelling variants: words one inserted, deleted or replaced letter apart, by dense prefix-suffix comparison.

Two words whose longer one has ``m`` letters are near if common prefix and common suffix together reach ``m - 1``. The first
unlike place (the prefix length) lies in one third of the longer word's places; all before that third and all behind it is
then equal in both. So every word goes to one block per third, once as a word of the pair's longer length and once as
a word one shorter; a pair is judged only in the block of its own third, so it is found once.

Inside blocks, words are rows of padded code-point matrices, aligned left for prefixes and right for suffixes, and slabs of
rows are compared with all their block mates at once. Blocks of more than ``BLOCK`` words are dealt again, one block per
place instead of per third: there all words agree but for one letter, so the alphabet bounds the block, whatever the words
are. Blocks are sorted runs of a shuffle by hash, never gathered groups; pairs do not leave a task, only each
word's number of near words and its most frequent one.

A word's *form* is its most frequent near word if that is at least twice as frequent; the *root* follows forms to the last.
Frequencies at least double along the way, so a few rounds of pointer doubling reach it.

Null and empty texts have no words. A null ``doc_id`` counts as empty text in the letter slips. Repeated rows count as
often as they occur. Very long texts and words are read whole. Ties between near words go to the smaller one in code-point
order. Only ``doc_id`` and ``text`` are read, so other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import bounded, release, runs_of, stored

BLOCK = 1024                                   # words of a block that are compared pair by pair
CELLS = 1 << 22                                # letters of a compared slab
TEXT_BYTES = 8 << 20
_SHIFTS = 64                                   # runs up to so many bytes get their checksum by table
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True
_ZERO = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


def letter_runs(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``(offsets, runs)``: maximal runs of A-Z, a-z and U+00C0 to U+00FF of every text, A-Z in lower case."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    keep = _LETTER[data]
    keep[1:] |= data[:-1] == 0xC3              # the second byte of U+00C0 to U+00FF
    offsets, _, runs, _ = runs_of(data, ends - ends[0], keep)
    return offsets, runs


def slip_hashes(ids: list, offsets: np.ndarray, codes: np.ndarray, words: list[bytes]) -> np.ndarray:
    """crc32 of ``<id>:<run>`` of every run, by the checksums of both halves."""
    doc = np.repeat(np.arange(len(ids)), np.diff(offsets))
    size = np.array([len(w) for w in words], np.int64)
    own = np.array([zlib.crc32(w) for w in words], np.uint32)
    start = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    out = np.zeros(len(codes), np.uint32)
    moved, sizes = start, size[codes]
    for n in range(1, min(_SHIFTS, int(size.max(initial=0))) + 1):
        moved = _ZERO[moved & np.uint32(255)] ^ (moved >> np.uint32(8))       # the checksum after one more zero byte
        at = np.flatnonzero(sizes == n) if n > 1 or (sizes == 1).any() else np.zeros(0, int)
        out[at] = moved[doc[at]] ^ own[codes[at]]
    for i in np.flatnonzero(sizes > _SHIFTS):
        out[i] = zlib.crc32(words[codes[i]], int(start[doc[i]]))
    return out


def count_words(docs: DataFrame, shortest: int = 5, least: int = 3, slip: int | None = None) -> DataFrame:
    """``word, n`` of the letter runs of ``docs(doc_id, text)`` with enough letters and occurrences.

    ``slip``: a run whose crc32 with its ``doc_id`` is a multiple of it loses the letter at that checksum modulo its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text", TEXT_BYTES):
            offsets, runs = letter_runs(b.column("text"))
            coded = runs.dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            names = coded.dictionary.cast(pa.large_string())
            slipped: Counter = Counter()
            if slip:
                words = coded.dictionary.to_pylist()
                hashes = slip_hashes(b.column("doc_id").to_pylist(), offsets, codes, words)
                hit = hashes % np.uint32(slip) == 0
                for c, h in zip(codes[hit].tolist(), hashes[hit].tolist()):
                    word = words[c].decode()
                    at = h % len(word)
                    slipped[word[:at] + word[at + 1:]] += 1
                codes = codes[~hit]
            counts = np.bincount(codes, minlength=len(names))
            good = pa.array(counts > 0)
            extra = {w: n for w, n in slipped.items() if len(w) >= shortest}
            found = pa.concat_arrays([names.filter(good).cast(pa.string()), pa.array(list(extra), pa.string())])
            n = np.concatenate([counts[counts > 0], np.array(list(extra.values()), np.int64)])
            out = pa.RecordBatch.from_arrays([found, pa.array(n, pa.int64())], names=["word", "n"])
            yield out.filter(pc.greater_equal(pc.utf8_length(found), shortest))
        release()

    rows = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _dealt(words: DataFrame, places) -> DataFrame:
    """``key, m, a, b, word, n``: blocks of the words that agree before place ``a`` and from place ``b`` of ``m`` on."""
    size = F.char_length("word")
    rows = words.withColumn("m", F.explode(F.array(size, size + 1)))
    rows = rows.withColumn("at", F.explode(places(F.col("m")))).select(
        "word", "n", "m", F.col("at.a").alias("a"), F.col("at.b").alias("b"))
    return _keyed(rows)


def _keyed(rows: DataFrame) -> DataFrame:
    tail = F.col("m") - F.col("b")
    key = F.xxhash64("m", "a", F.substring(F.col("word"), F.lit(1), F.col("a")),
                     F.substring(F.col("word"), F.char_length("word") - tail + 1, tail))
    return rows.select(key.alias("key"), "m", "a", "b", "word", "n")


def _thirds(m):
    cut = [F.floor(m * k / 3).cast("int") for k in range(4)]
    return F.array(*(F.struct(cut[k].alias("a"), cut[k + 1].alias("b")) for k in range(3)))


def _matrix(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, padded with 0 on the right, and on the left."""
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    size = np.array([len(w) for w in words])
    at = np.arange(width)
    left, right = np.zeros((len(words), width), np.uint8), np.zeros((len(words), width), np.uint8)
    left[at < size[:, None]] = flat
    right[at >= width - size[:, None]] = flat
    return left, right


def near_pairs(words: list[str], m: int, low: np.ndarray, high: np.ndarray, mates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs ``(i, j)`` at distance one; row ``i`` is compared with the ``mates[i]`` rows behind it.

    A pair counts if its longer word has ``m`` letters and its first unlike place is in ``[low[i], high[i])``.
    """
    left, right = _matrix(words, m)
    size = np.array([len(w) for w in words])
    total = np.cumsum(mates)
    found, s = [], 0
    while s < len(words):
        base = total[s - 1] if s else 0
        e = max(s + 1, int(np.searchsorted(total, base + max(1, CELLS // m), side="right")))
        i = np.repeat(np.arange(s, e), mates[s:e])
        j = i + 1 + np.arange(len(i)) - np.repeat(total[s:e] - mates[s:e] - base, mates[s:e])
        if len(i):
            unlike = left[i] != left[j]
            prefix = np.where(unlike.any(axis=1), unlike.argmax(axis=1), m)
            unlike = right[i, ::-1] != right[j, ::-1]
            suffix = np.where(unlike.any(axis=1), unlike.argmax(axis=1), m)
            near = ((prefix + suffix >= m - 1) & (prefix >= low[i]) & (prefix < high[i])
                    & (np.maximum(size[i], size[j]) == m))
            found.append((i[near], j[near]))
        s = e
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def _compared(blocks: DataFrame) -> DataFrame:
    """``word, near, best_n, best``: per word and block, the number of near words and the most frequent one."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]

    def judged(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole blocks, all of one ``m``."""
        block, words, n = (table.column(c).combine_chunks() for c in ("block", "word", "n"))
        block, n, words = block.to_numpy(), n.to_numpy(), words.to_pylist()
        low, high = table.column("a").to_numpy(), table.column("b").to_numpy()
        last = np.searchsorted(block, block, side="right")
        i, j = near_pairs(words, table.column("m")[0].as_py(), low, high, last - 1 - np.arange(len(words)))
        if len(i):
            row, other = np.concatenate([i, j]), np.concatenate([j, i])
            rank = np.empty(len(words), int)
            rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
            order = np.lexsort((rank[other], -n[other], row))
            row, other = row[order], other[order]
            own, first, count = np.unique(row, return_index=True, return_counts=True)
            columns = [[words[x] for x in own], count, n[other[first]], [words[x] for x in other[first]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["word", "near", "best_n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                                             # the last block, which may go on in the next batch
        for b in _last_marked(batches):
            table, over = b
            if held is not None:
                table = pa.concat_tables([held, table]) if table is not None else held
            if table is None or not table.num_rows:
                continue
            key, m, a = (table.column(c).to_numpy() for c in ("key", "m", "a"))
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (m[1:] != m[:-1]) | (a[1:] != a[:-1])])
            block = np.cumsum(new) - 1
            stop = table.num_rows if over else int(np.searchsorted(block, block[-1]))
            held = table.slice(stop) if stop < table.num_rows else None
            several = np.bincount(block)[block] > 1
            several[stop:] = False
            table = table.append_column("block", pa.array(block)).filter(pa.array(several))
            m, block = table.column("m").to_numpy(), table.column("block").to_numpy()
            s = 0
            while s < len(m):                                   # slabs of whole blocks of one length
                e = min(int(np.searchsorted(m, m[s], side="right")), s + max(1, CELLS // int(m[s])))
                e = int(np.searchsorted(block, block[e - 1], side="right")) if e < len(m) else e
                yield from judged(table.slice(s, e - s))
                s = e
        release()

    rows = blocks.repartition("m", "key").sortWithinPartitions("m", "key", "a")
    return rows.mapInArrow(run, "word string, near long, best_n long, best string")


def _last_marked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Every batch as a table, then an empty mark for the end."""
    for b in batches:
        yield pa.Table.from_batches([b]), False
    yield None, True


def variants(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``words(word, n)``, one row per distinct word."""
    words = stored(words.select("word", "n"), "words")
    blocks = _dealt(words, _thirds)
    large = stored(blocks.groupBy("key", "m", "a").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > BLOCK)
                   .select("key", "m", "a"), "large")
    small = blocks.join(large, ["key", "m", "a"], "left_anti").select("key", "m", "a", "b", "word", "n")
    single = blocks.join(large, ["key", "m", "a"], "left_semi").withColumn(
        "p", F.explode(F.sequence(F.col("a"), F.col("b") - 1)))
    single = _keyed(single.select("word", "n", "m", F.col("p").alias("a"), (F.col("p") + 1).alias("b")))
    near = _compared(small.unionByName(single)).groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("x"), "best")).alias("top"))
    near = near.select("word", "n_near", (-F.col("top.x")).alias("best_n"), "top.best")
    forms = words.join(near, "word", "left")
    formed = F.col("best_n") >= 2 * F.col("n")
    forms = stored(forms.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                F.when(formed, F.col("best")).alias("form"),
                                F.when(formed, F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(forms.filter("form is not null").select("word", F.col("form").alias("root")))
    return forms.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(steps: DataFrame) -> DataFrame:
    """``word, root``: pointers doubled until none moves; frequencies double along them, so they have no circles."""
    steps = stored(steps, "roots")
    while True:
        up = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(steps.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                             F.col("next").isNotNull().alias("moved")), "roots")
        steps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return steps
