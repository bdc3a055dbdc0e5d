"""Phrase collocations by Rabin-Karp fingerprints.

Texts become *chunks*: the words of some megabytes of documents of one language as codes into the chunk's own
dictionary, with a border between pieces. A chunk's prefix polynomial gives the fingerprint of every n-gram as a difference.
Texts of a language wait until they fill a chunk, as fuller chunks share more of their words and phrases. What travels is
packed: codes are ranks by frequency, places are differences, and numbers go by byte planes through zstd.

* **Shuffle.** A chunk sends one entry per distinct n-gram: fingerprint, count, and the place of its first occurrence in
  the chunk as pointer. Entries travel packed by fingerprint range; a range sums its counts and returns the pointers of
  what reaches the least count to their chunks, without fingerprints. Single words go first, then pairs of words that reached it, then phrases
  of three to five words whose pairs all did; a phrase is never more frequent than its parts, so nothing is lost.
* **Verification.** Inside a chunk, occurrences that share a fingerprint are compared code by code with the first one; unlike
  ones get entries of their own. Across chunks, pointers are read back as text, sent packed by range again, and counts are
  summed by text. Fingerprints only choose what is read back: a collision can add a phrase to that choice, and its own count drops it again.
* **Score.** Parts of a frequent phrase are frequent, so both counts of every cut come from joins of the phrase table with
  itself. Products are decimals of 38 digits.

No table is broadcast by hand and nothing is gathered: a range holds a bounded share of the entries, whose number grows with
the corpus, and a hot phrase has one entry a chunk.

Null and empty texts have no words; a null language counts as ``und``. Repeated rows count as often as they occur, under any
``doc_id``, which is not used. A very long text is a chunk of its own. Ties in rank go to the larger count, then to the
phrase that is smaller by bytes; ties between cuts to the shorter first part. Only ``text`` and ``lang`` are read, so other
columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtable.llm.common import bounded, byte_runs, parts_for, release, settle, stored

CHUNK_BYTES = 8 << 20
HELD_CHUNKS = 4                                 # as many chunks' bytes wait in a task at most, whatever the number of languages
RANGE_ENTRIES = 4_000_000                       # words per fingerprint range, so that a range fits a task
SALTS = 32                                      # partial rankings of a language
_BORDER = np.zeros(256, bool)
_BORDER[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_INSIDE = ~_BORDER
_INSIDE[[0x20, 0x09]] = False
_BASE = np.uint64(0x9E3779B97F4A7C15)           # odd, so it has an inverse
_BACK = np.uint64(pow(int(_BASE), -1, 2 ** 64))
RANGE_TEXTS = 1_000_000                         # phrases read back per group of ranges
PRINT_BYTES = 5                                 # leading bytes of a fingerprint that travel
BITS = 8 * PRINT_BYTES                          # fingerprint bits; tests use few to force collisions

CHUNK = "lang string, n long, codes binary, words binary, ends binary"
ENTRY = "range int, chunk long, m int, prints binary, counts binary, places binary"
POINTER = "range int, chunk long, m int, size long, counts binary, places binary"


def _packed(values: np.ndarray) -> bytes:
    """Their number and their byte planes, compressed; small numbers leave the upper planes empty."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(pa.py_buffer(planes), codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind=np.int32) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).reshape(-1).view(kind)


def _packed_prints(prints: np.ndarray) -> bytes:
    return prints.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :PRINT_BYTES].tobytes()


def _packed_places(places: np.ndarray) -> bytes:
    return _packed(np.diff(places, prepend=0).astype(np.int32))


def _unpacked_column(rows: list[bytes], column: str) -> np.ndarray:
    """``prints``, ``counts`` or ``places`` of entry rows, one after the other."""
    if column == "prints":
        flat = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, PRINT_BYTES)
        wide = np.zeros((len(flat), 8), np.uint8)
        wide[:, :PRINT_BYTES] = flat
        return wide.reshape(-1).view(">u8").astype(np.uint64)
    parts = [_unpacked(x) for x in rows]
    if column == "places":
        parts = [np.cumsum(x, dtype=np.int32) for x in parts]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _chunk_row(lang: str, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """The chunk of some texts of a language, if they have a word."""
    offsets, starts, runs, data = byte_runs(texts, _INSIDE)
    if not len(runs):
        return
    coded = runs.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(-np.bincount(codes, minlength=len(coded.dictionary)), kind="stable")
    words = coded.dictionary.take(pa.array(order))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    piece = np.cumsum(_BORDER[data])[starts]
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    cut = np.flatnonzero((piece[1:] != piece[:-1]) | (text[1:] != text[:-1])) + 1
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int32)
    joined = np.frombuffer(b"".join(words.to_pylist()), np.uint8)
    packed = (_packed(np.insert(rank[codes] + np.int32(1), cut, 0)), _packed(joined), _packed(lengths))
    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([len(codes)]), *(pa.array([x], pa.binary()) for x in packed)],
                                     names=["lang", "n", "codes", "words", "ends"])


def _chunks(docs: DataFrame) -> DataFrame:
    """``lang, n, codes, words, ends``: a row per some megabytes of texts of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[pa.Array]] = {}
        held: dict[str, int] = {}

        def full(lang: str) -> Iterator[pa.RecordBatch]:
            held.pop(lang)
            return _chunk_row(lang, pa.concat_arrays(waiting.pop(lang)))

        for b in bounded(batches, "text", CHUNK_BYTES):
            langs = pc.fill_null(b.column("lang"), "und").dictionary_encode()
            own = langs.indices.to_numpy(zero_copy_only=False)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                texts = b.column("text").filter(pa.array(own == k))
                size = pc.sum(pc.binary_length(texts)).as_py() or 0
                if held.get(lang, 0) + size > CHUNK_BYTES and lang in held:
                    yield from full(lang)
                waiting.setdefault(lang, []).append(texts)
                held[lang] = held.get(lang, 0) + size
            while sum(held.values()) > HELD_CHUNKS * CHUNK_BYTES:
                yield from full(max(held, key=held.get))
        for lang in list(held):
            yield from full(lang)
        release()

    return docs.select("lang", "text").mapInArrow(run, CHUNK).withColumn("chunk", F.monotonically_increasing_id())


class _Chunk:
    """A chunk row, read back."""

    def __init__(self, table: pa.Table):
        row = {c: table.column(c)[0].as_py() for c in ("chunk", "lang", "codes", "words", "ends")}
        self.id, self.lang = row["chunk"], row["lang"]
        self.codes = _unpacked(row["codes"]) - np.int32(1)              # a border is -1
        self.words, self.ends = _unpacked(row["words"], np.uint8).tobytes(), np.cumsum(_unpacked(row["ends"]), dtype=np.int64)

    def word(self, code: int) -> bytes:
        return self.words[self.ends[code - 1] if code else 0:self.ends[code]]

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        """64-bit hashes of words, seeded by the language."""
        seed = xxhash.xxh3_64_intdigest(self.lang.encode())
        return np.fromiter((xxhash.xxh3_64_intdigest(self.word(c), seed) for c in codes), np.uint64, len(codes))


def _range_of(prints: np.ndarray, ranges: int) -> np.ndarray:
    return ((prints >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _scatter(chunk: _Chunk, m: int, prints, counts, places, ranges: int) -> Iterator[tuple]:
    """Entry rows of one chunk and phrase length, a row per fingerprint range that has any."""
    own = _range_of(prints, ranges)
    order = np.argsort(own * np.int64(len(chunk.codes)) + places)           # by place inside a range
    prints, counts, places, own = prints[order], counts[order], places[order], own[order]
    cuts = np.flatnonzero(np.diff(own)) + 1
    for a, z in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(own)]])):
        if z > a:
            yield (int(own[a]), chunk.id, m, _packed_prints(prints[a:z]), _packed(counts[a:z].astype(np.int32)),
                   _packed_places(places[a:z]))


def _entry_rows(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = ["range", "chunk", "m", "prints", "counts", "places"]
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def _mixed(prints: np.ndarray, m: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        prints = (prints ^ (prints >> np.uint64(29)) ^ np.uint64(m)) * np.uint64(0xBF58476D1CE4E5B9)
    prints = prints ^ (prints >> np.uint64(32))
    return prints & ~np.uint64(2 ** (64 - BITS) - 1)


def _grams(codes: np.ndarray, hashed: np.ndarray, m: int, starts: np.ndarray):
    """``(prints, counts, places)``: the distinct windows of ``m`` words among those that begin at ``starts``."""
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(len(codes), _BASE, np.uint64))
        back = np.multiply.accumulate(np.full(len(codes), _BACK, np.uint64))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * power, dtype=np.uint64)])
        found = _mixed((prefix[starts + m] - prefix[starts]) * back[starts], m)
    out = []
    while len(starts):
        own, first, place, counts = np.unique(found, return_index=True, return_inverse=True, return_counts=True)
        # Occurrences that are unlike the first one under their fingerprint make entries of their own.
        unlike = np.zeros(len(starts), bool)
        for k in range(m):
            unlike |= codes[starts + k] != codes[starts[first][place] + k]
        if unlike.any():
            counts = np.bincount(place[~unlike], minlength=len(own))
        out.append((own, counts, starts[first]))
        starts, found = starts[unlike], found[unlike]
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _words(chunks: DataFrame, ranges: int) -> DataFrame:
    """Entries of single words; the pointer of a word is its code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                chunk = _Chunk(pa.Table.from_batches([b.slice(i, 1)]))
                every = np.arange(len(chunk.ends))
                counts = np.bincount(chunk.codes[chunk.codes >= 0], minlength=len(every))
                rows = _scatter(chunk, 1, _mixed(chunk.hashes(every), 1), counts, every, ranges)
                yield from _entry_rows(list(rows)).to_batches()
        release()

    return chunks.mapInArrow(run, ENTRY)


def _frequent(entries: DataFrame, least: int) -> DataFrame:
    """``range, chunk, m, size, counts, places`` of the entries whose fingerprint occurs ``least`` times in all chunks."""

    def run(table: pa.Table) -> pa.Table:
        sizes = pc.divide(pc.binary_length(table.column("prints")), PRINT_BYTES).to_numpy()
        prints, counts, places = (_unpacked_column(table.column(c).to_pylist(), c) for c in ("prints", "counts", "places"))
        order = np.argsort(prints)
        new = np.concatenate([[True], np.diff(prints[order]) != 0])
        total = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new))
        good = np.zeros(len(prints), bool)
        good[order] = (total >= least)[np.cumsum(new) - 1]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        left = np.concatenate([[0], np.cumsum(good)])[ends]
        some = np.flatnonzero(np.diff(left))
        packed = {name: pa.array([pack(x[left[i]:left[i + 1]]) for i in some], pa.binary()) for name, x, pack in (
            ("counts", counts[good], _packed), ("places", places[good], _packed_places))}
        kept = {c: table.column(c).combine_chunks().take(pa.array(some)) for c in ("range", "chunk", "m")}
        return pa.table(kept | {"size": pa.array(np.diff(left)[some])} | packed)

    return entries.groupBy("range").applyInArrow(run, POINTER)


def _joined(table: pa.Table, m: int, column: str) -> np.ndarray:
    return _unpacked_column(table.filter(pc.equal(table.column("m"), m)).column(column).to_pylist(), column)


def _longer(chunks: DataFrame, parts: DataFrame, lengths: range, ranges: int) -> DataFrame:
    """Entries of phrases of ``lengths`` words all of whose shorter parts are in ``parts``: words, or pairs of words."""
    step = lengths[0] - 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _entry_rows([])
        chunk = _Chunk(left)
        codes = chunk.codes
        places = _joined(right, step, "places")
        good = np.zeros(len(codes), bool)                       # where a frequent part begins
        known = np.zeros(len(chunk.ends) + 1, bool)             # codes of words in such parts; the last is the border
        if step == 1:
            known[places] = True
            good = known[codes]
        else:
            wide = np.int64(len(chunk.ends) + 1)
            pair = codes[:-1] * wide + codes[1:]
            good[:-1] = np.isin(pair, pair[places]) & (codes[:-1] >= 0) & (codes[1:] >= 0)
            known[codes[places]] = known[codes[places + 1]] = True
            known[-1] = False
        hashed = np.zeros(len(known), np.uint64)
        hashed[known] = chunk.hashes(np.flatnonzero(known))
        hashed = hashed[codes]
        rows = []
        for m in lengths:
            n = len(codes) - m + 1
            if n <= 0:
                break
            whole = np.ones(n, bool)
            for k in range(m - step + 1):
                whole &= good[k:k + n]
            found = _grams(codes, hashed, m, np.flatnonzero(whole))
            rows += _scatter(chunk, m, *found, ranges)
        release()
        return _entry_rows(rows)

    return chunks.groupBy("chunk").cogroup(parts.groupBy("chunk")).applyInArrow(run, ENTRY)


def _texts(chunks: DataFrame, frequent: DataFrame, groups: int) -> DataFrame:
    """``lang, m, range, texts, counts``: pointers read back as text, packed by group of ranges; words hold no line end."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            chunk = _Chunk(left)
            right = right.set_column(0, "range", pa.array(right.column("range").to_numpy() % groups))
            for m in sorted(set(right.column("m").to_pylist())):
                of_m = right.filter(pc.equal(right.column("m"), m)).sort_by("range")
                places, counts = _joined(of_m, m, "places"), _joined(of_m, m, "counts").astype(np.int64)
                own = np.repeat(of_m.column("range").to_numpy(), of_m.column("size").to_numpy())
                codes = places[:, None] if m == 1 else chunk.codes[places[:, None] + np.arange(m)]
                used = np.unique(codes)
                words = pa.array([chunk.word(c) for c in used.tolist()], pa.binary())
                parts = [words.take(pa.array(np.searchsorted(used, codes[:, k]))) for k in range(m)]
                texts = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if m > 1 else parts[0]
                cuts = np.flatnonzero(np.diff(own)) + 1
                for a, z in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(own)]]).tolist()):
                    joined = np.frombuffer(b"\n".join(texts[a:z].to_pylist()), np.uint8)
                    rows.append((chunk.lang, m, int(own[a]), _packed(joined), _packed(counts[a:z])))
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        columns = zip(*rows) if rows else [[]] * len(kinds)
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["lang", "m", "range", "texts", "counts"])

    return chunks.groupBy("chunk").cogroup(frequent.groupBy("chunk")).applyInArrow(
        run, "lang string, m int, range int, texts binary, counts binary")


def _counted(texts: DataFrame, least: int) -> DataFrame:
    """``lang, m, phrase, f`` by the text itself; equal texts have equal fingerprints and so one range and group."""

    def run(table: pa.Table) -> pa.Table:
        joined = b"\n".join(_unpacked(x, np.uint8).tobytes() for x in table.column("texts").to_pylist())
        phrases = pc.split_pattern(pa.chunked_array([pa.array([joined], pa.large_binary()).cast(pa.large_string())]), "\n")
        counts = np.concatenate([_unpacked(x, np.int64) for x in table.column("counts").to_pylist()])
        found = pa.table({"phrase": pc.list_flatten(phrases), "f": pa.array(counts)}).group_by("phrase").aggregate([("f", "sum")])
        found = found.filter(pc.greater_equal(found.column("f_sum"), least))
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * found.num_rows, pa.string()),
                         "m": pa.array([table.column("m")[0].as_py()] * found.num_rows, pa.int32()),
                         "phrase": found.column("phrase").cast(pa.string()), "f": found.column("f_sum")})

    return texts.groupBy("lang", "m", "range").applyInArrow(run, "lang string, m int, phrase string, f long")


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(phrases, sizes)``: ``lang, m, phrase, f`` of phrases of up to ``longest`` words, and ``lang, n`` words."""
    spark = docs.sparkSession
    chunks = stored(_chunks(docs), "chunks")
    sizes = stored(chunks.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    ranges = parts_for(total, RANGE_ENTRIES, 8)
    found = stored(_frequent(_words(chunks, ranges), least), "words")
    settle(spark)                                               # each step's shuffle files go before the next
    if longest > 1:
        pairs = stored(_frequent(_longer(chunks, found, range(2, 3), ranges), least), "pairs")
        settle(spark)
        found = found.unionByName(pairs)
        if longest > 2:
            found = found.unionByName(_frequent(_longer(chunks, pairs, range(3, longest + 1), ranges), least))
        found = stored(found, "frequent")
        settle(spark)
    groups = parts_for(found.agg(F.sum("size")).first()[0] or 0, RANGE_TEXTS, 8)
    phrases = stored(_counted(_texts(chunks, found, groups), least), "phrases")
    settle(spark)
    return phrases, sizes


def mine_phrases(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases of ``docs(text, lang)``."""
    phrases, sizes = frequent_phrases(docs, least, longest)
    counts = phrases.select("lang", "phrase", "f")
    long = phrases.filter("m >= 2").select("lang", "m", F.col("phrase"), F.col("f").alias("a"),
                                           F.split("phrase", " ").alias("w"))
    cuts = long.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("tail"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.join(sizes, "lang").withColumn(
        "score", F.expr("cast(1000 * cast(a as decimal(18,0)) as decimal(19,0)) * cast(n as decimal(19,0))"
                        " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x"))
    lowest = lowest.select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")
    # A phrase inside a longer one is inside one that is a word longer and at least as frequent.
    m = F.col("m")
    inner = long.filter("m >= 3").select("lang", "a", F.explode(F.array(
        F.array_join(F.slice("w", F.lit(1), m - 1), " "), F.array_join(F.slice("w", F.lit(2), m - 1), " "))).alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("covered"))
    kept = lowest.join(covered, ["lang", "phrase"], "left").filter("covered is null or covered < a").drop("covered")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Partial rankings first, so a language's last ranking has a bounded number of rows.
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    first = salted.filter(F.col("rank") <= top).drop("salt", "rank")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


PHRASE_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs),
worded AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
  FROM worded, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m >= 2),
scored AS (
  SELECT c.lang, c.phrase, c.m, c.a, c.k, x.f AS l, y.f AS r, s.n,
         ((1000::HUGEINT * c.a * s.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1 : k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1 :], ' ') JOIN sizes s ON s.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM lowest p WHERE NOT EXISTS (
    SELECT 1 FROM f q WHERE q.lang = p.lang AND q.m > p.m AND 100 * q.f >= 100 * p.a
    AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000"""
