"""Helpers shared by the operators: words, hash remainders and stored intermediate tables."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.functions.memory import release
from voxtable.session import stored

__all__ = ["WORD", "bounded", "byte_runs", "count_words", "hash_rest", "list_numpy", "parts_for",
           "release", "settle", "split_words", "stored", "table"]

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def hash_rest(key: str | Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; a null key counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % divisor


def count_words(text: str | Column) -> Column:
    """Number of words of the whole text; null counts 0."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def parts_for(df_rows: int, rows_per_part: int, least: int = 1) -> int:
    """A number of groups that grows with the rows, so a group stays bounded."""
    return max(least, -(-int(df_rows) // rows_per_part))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_runs(texts: pa.Array, inside: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Maximal runs of the bytes marked in ``inside`` (256 flags) of every text, A-Z in lower case if ``lower``.

    ``(offsets, starts, runs, data)``: the runs of text ``i`` are ``runs[offsets[i]:offsets[i + 1]]``, as binary; ``starts``
    are their places in ``data``, the bytes of all texts in a row. Null has none. Only single bytes decide, so borders are
    right in UTF-8 where ``inside`` has all or none of the bytes above 127.
    """
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    return runs_of(data, ends, inside[data], lower)


def runs_of(data: np.ndarray, ends: np.ndarray, keep: np.ndarray,
            lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """:func:`byte_runs` of texts that end at ``ends`` in ``data``, by a flag for every byte."""
    border = np.zeros(len(data) + 1, bool)
    border[ends] = True
    first, last = keep.copy(), keep.copy()
    first[1:] &= ~keep[:-1] | border[1:-1]
    last[:-1] &= ~keep[1:] | border[1:-1]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    kept = _LOWER[data[keep]] if lower else data[keep]
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(kept)])
    return np.searchsorted(starts, ends), starts, runs, data


_WORDS = np.ones(256, bool)
_WORDS[[0x20, *range(0x09, 0x0E)]] = False


def split_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, pa.Array]:
    """``(offsets, words)``: the words of text ``i`` are ``words[offsets[i]:offsets[i + 1]]``; null has none.

    ``lower`` maps A-Z only, as ASCII lower case does.
    """
    offsets, _, words, _ = byte_runs(texts, _WORDS, lower)
    return offsets, words.view(pa.large_string())


def list_numpy(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """``(offsets, flat values)`` of a list column without nulls inside."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return offsets - offsets[0], flat


def bounded(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``most_bytes`` at most; one row is never cut."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def settle(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps, which else stay until the driver collects."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
