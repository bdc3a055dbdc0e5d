"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of many strings.

Every round inserts one symbol of each string: the suffix one symbol longer than in the round before. Where it goes
follows from the transform alone (rank of its symbol before the last suffix's row), and its common prefix with its
neighbours is one more than the least common prefix between two rows with that symbol. The rows live in external files
that a round reads from front to end and writes anew.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

_FILES = (("symbol", np.int32), ("string", np.int32), ("size", np.int16), ("common", np.int16))
END = -1                       # before the first symbol of a string


class _Rows:
    """The rows of one round in files of a folder."""

    def __init__(self, folder: str, number: int):
        self.paths = [os.path.join(folder, f"{name}-{number % 2}") for name, _ in _FILES]

    def write(self, *columns) -> None:
        for path, column, (_, kind) in zip(self.paths, columns, _FILES):
            column.astype(kind, copy=False).tofile(path)

    def read(self) -> list[np.ndarray]:
        return [np.fromfile(path, kind) for path, (_, kind) in zip(self.paths, _FILES)]


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of ``values[low..high]`` (both included) for many ranges."""
    out = np.zeros(len(low), values.dtype)
    level = np.frexp((high - low + 1).astype(float))[1] - 1
    table = values
    for k in range(int(level.max(initial=-1)) + 1):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[low[own]], table[high[own] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[:-(1 << k)], table[1 << k:])
    return out


def collection_bwt(symbols: np.ndarray, sizes: np.ndarray, scratch: str | None = None):
    """``(symbol, string, size, common)`` per suffix in sorted order.

    ``symbols`` holds the strings (symbols >= 0) one after the other, ``sizes`` their lengths. A row is the suffix of
    ``string`` with ``size`` symbols, ``symbol`` what stands before it (``END`` at the start), ``common`` the symbols it
    shares with the row above. Ends of strings are all different and sort first, in order of the strings.
    """
    m = len(sizes)
    stops = np.cumsum(sizes)
    symbols, sizes = np.asarray(symbols, np.int32), np.asarray(sizes, np.int64)

    def before(strings, inserted):
        """The symbol in front of the suffix with ``inserted`` symbols."""
        out = np.full(len(strings), END, np.int32)
        more = sizes[strings] > inserted
        out[more] = symbols[stops[strings[more]] - inserted - 1]
        return out

    with tempfile.TemporaryDirectory(prefix="bwt-", dir=scratch) as folder:
        rows = _Rows(folder, 0)
        rows.write(before(np.arange(m), 0), np.arange(m), np.zeros(m), np.zeros(m))
        for inserted in range(int(sizes.max(initial=0))):
            symbol, string, size, common = rows.read()
            ranked = np.argsort(symbol, kind="stable")
            ranked = ranked[np.count_nonzero(symbol == END):]            # rows by (symbol, row), ends left out
            fresh = np.flatnonzero((size[ranked] == inserted))           # the suffixes still to insert
            at = fresh + m                                               # their rows in the new order
            same = np.zeros(len(ranked) + 1, bool)                       # shares its symbol with the one above
            same[1:-1] = symbol[ranked[1:]] == symbol[ranked[:-1]]

            def shared(i):
                """Common prefix of the suffixes at places ``i - 1`` and ``i`` of ``ranked``."""
                out = np.zeros(len(i), np.int16)
                ok = np.flatnonzero(same[i])
                out[ok] = 1 + _least(common, ranked[i[ok] - 1] + 1, ranked[i[ok]])
                return out

            strings = string[ranked[fresh]]
            place = at - np.arange(len(at))                              # where to insert in the old rows
            after = np.setdiff1d(fresh + 1, fresh, assume_unique=True)
            after = after[after < len(ranked)]                           # old rows whose upper neighbour is new
            below = shared(after)
            new = [np.insert(symbol, place, before(strings, inserted + 1)), np.insert(string, place, strings),
                   np.insert(size, place, np.full(len(at), inserted + 1, np.int16)),
                   np.insert(common, place, shared(fresh))]
            new[3][after + m] = below
            rows = _Rows(folder, inserted + 1)
            rows.write(*new)
        return rows.read()


def repeated_starts(symbols: np.ndarray, sizes: np.ndarray, length: int):
    """``(string, size)`` of all suffixes whose first ``length`` symbols also start another suffix."""
    _, string, size, common = collection_bwt(symbols, sizes)
    far = common >= length
    far[:-1] |= far[1:].copy()
    return string[far], size[far].astype(np.int64)
