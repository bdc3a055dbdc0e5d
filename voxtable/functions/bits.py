"""Counts of array elements by the leading bits of their value, inside the row that holds the array.

The bits of a double, with those of negative numbers turned round, have the order of the numbers. Their first bits cut the
numbers into bins that need no range known beforehand and that no outlier can widen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

COUNTED = ArrayType(StructType().add("p", IntegerType()).add("n", LongType()))
PICKED = ArrayType(StructType().add("p", IntegerType()).add("v", DoubleType()).add("n", LongType()))
MOMENTS = StructType().add("n", LongType()).add("s1", DoubleType()).add("s2", DoubleType())
_REST = np.int64(0x7FFFFFFFFFFFFFFF)
_HALF = 1 << 31


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the doubles; both zeros are equal, NaN is the largest."""
    values = np.asarray(values, np.float64) + 0.0
    values[np.isnan(values)] = np.nan
    bits = values.view(np.int64)
    return bits ^ ((bits >> 63) & _REST)


def from_ordered_bits(bits: np.ndarray) -> np.ndarray:
    return (bits ^ ((bits >> 63) & _REST)).view(np.float64)


def shift_for(accuracy: int) -> int:
    """Bits to drop so that at least ``accuracy`` bins share an octave."""
    return 52 - min(19, max(0, int(accuracy - 1).bit_length()))


def elements(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(row, value)`` of the elements that are not null."""
    flat = pc.list_flatten(a)
    row = pc.list_parent_indices(a).to_numpy(zero_copy_only=False).astype(np.int64)
    if flat.null_count:
        there = pc.is_valid(flat)
        row, flat = row[there.to_numpy(zero_copy_only=False)], flat.filter(there)
    return row, flat.to_numpy(zero_copy_only=False).astype(np.float64)


def _lists(row: np.ndarray, size: int, **fields: np.ndarray) -> pa.Array:
    """A list of structs per row, from fields sorted by row."""
    offsets = np.searchsorted(row, np.arange(size + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
        [pa.array(x) for x in fields.values()], names=list(fields)))


def bin_of(shift: int):
    """Bin of a number."""
    @F.arrow_udf(IntegerType())
    def leading(v: pa.Array) -> pa.Array:
        there = v.is_valid().to_numpy(zero_copy_only=False)
        bins = (ordered_bits(pc.fill_null(v, 0.0).to_numpy(zero_copy_only=False)) >> shift).astype(np.int32)
        return pa.array(bins, mask=~there)
    return leading


def bin_counts(shift: int):
    """``array<struct<p, n>>``: how many elements of an array lie in each bin."""
    @F.arrow_udf(COUNTED)
    def counted(a: pa.Array) -> pa.Array:
        row, value = elements(a)
        keys, n = np.unique((row << 32) + (ordered_bits(value) >> shift) + _HALF, return_counts=True)
        return _lists(keys >> 32, len(a), p=((keys & 0xFFFFFFFF) - _HALF).astype(np.int32), n=n)
    return counted


def values_in_bins(shift: int):
    """``array<struct<p, v, n>>``: the distinct elements in the wanted bins, and how often they occur."""
    @F.arrow_udf(PICKED)
    def picked(a: pa.Array, wanted: pa.Array) -> pa.Array:
        row, value = elements(a)
        bits = ordered_bits(value)
        own_row, own = elements(wanted)
        good = np.isin((row << 32) + (bits >> shift), (own_row << 32) + own.astype(np.int64))
        row, bits = row[good], bits[good]
        order = np.lexsort((bits, row))
        row, bits = row[order], bits[order]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (bits[1:] != bits[:-1])])) if len(row) else row
        n = np.diff(np.append(new, len(row)))
        return _lists(row[new], len(a), p=(bits[new] >> shift).astype(np.int32), v=from_ordered_bits(bits[new]), n=n)
    return picked


@F.arrow_udf(MOMENTS)
def clipped_moments(a: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
    """Count, sum and sum of squares of the clipped elements, as differences from the middle of the clip range.

    Sums of rows with one range may be added; the middle keeps them small, so that the deviation loses no digits.
    """
    row, value = elements(a)
    lo, hi = (pc.fill_null(x, float("nan")).to_numpy(zero_copy_only=False) for x in (lo, hi))
    off = np.fmax(np.fmin(value, hi[row]), lo[row]) - ((lo + hi) / 2)[row]
    sums = [np.bincount(row, w, len(a)) for w in (off, off * off)]
    return pa.StructArray.from_arrays([pa.array(np.bincount(row, minlength=len(a)).astype(np.int64)),
                                       *(pa.array(s.astype(np.float64)) for s in sums)], names=["n", "s1", "s2"])
