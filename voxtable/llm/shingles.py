"""Word shingle sets of texts, and the sets of chosen classes of equal sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import bounded, release, split_words

TEXT_BYTES = 4 << 20
_ONE = np.uint64(0x9E3779B97F4A7C15)


def mixed(h):
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """``(ends, hashes)``: sorted distinct 64-bit shingle hashes of every text, one text after the other."""
    offsets, values = split_words(texts, lower=True)
    coded = values.dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    hashed = known[coded.indices.to_numpy(zero_copy_only=False)] if len(values) else np.zeros(0, np.uint64)
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n), dtype=np.int64), n)
    with np.errstate(over="ignore"):
        shingle = np.zeros(len(hashed), np.uint64)
        for k in range(words):                           # the k-th word from here, as far as the text reaches
            at = np.arange(len(hashed)) + k
            inside = at < offsets[row + 1]
            shingle = shingle * _ONE
            shingle[inside] += hashed[at[inside]]
        shingle = mixed(shingle + np.minimum(n[row], words).astype(np.uint64))
    start = np.arange(len(hashed)) - offsets[row]
    full = (start <= n[row] - words) | (start == 0)
    row, shingle = row[full], shingle[full]
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    row, shingle = row[first], shingle[first]
    return np.cumsum(np.bincount(row, minlength=len(n))), shingle


def digests(ends: np.ndarray, hashes: np.ndarray) -> list[bytes | None]:
    """128-bit digest of every set, null for empty ones."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return [xxhash.xxh3_128_digest(hashes[a:z].tobytes()) if z > a else None for a, z in zip(starts, ends)]


def text_places(docs: DataFrame) -> tuple:
    """Columns that tell the texts of ``docs`` apart: the id, with a stand-in for null, and a hash of the text."""
    return F.coalesce("doc_id", F.lit(-2 ** 63)).alias("__id"), F.xxhash64("text").alias("__key")


def class_sets(docs: DataFrame, ids: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """``id, shingles``: full sets of the wanted classes (``classes`` has ``id, digest, best.doc_id, best.text_key``).

    A set is read from one document of its class. Texts under one id with one hash may differ, so the digest decides.
    """
    wanted = ids.join(classes.select("id", "digest", "best.doc_id", "best.text_key"), "id")
    places = wanted.select(F.coalesce("doc_id", F.lit(-2 ** 63)).alias("__id"), F.col("text_key").alias("__key")).distinct()
    texts = docs.select(*text_places(docs), "text").join(places.hint("merge"), ["__id", "__key"], "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text", TEXT_BYTES):
            ends, hashes = shingle_sets(b.column("text"), words)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests(ends, hashes), pa.binary()),
                 pa.array([hashes[a:z].tobytes() for a, z in zip(starts, ends)], pa.binary())], names=["digest", "shingles"])
        release()

    found = texts.mapInArrow(run, "digest binary, shingles binary").dropDuplicates(["digest"])
    return found.join(wanted.select("digest", "id"), "digest").select("id", "shingles")
