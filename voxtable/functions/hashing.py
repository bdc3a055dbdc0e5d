"""Seeded pseudo-randomness that does not depend on partitioning.

A draw is a pure function of ``(seed, key)``, so a retried task repeats it exactly and the
same draw can be written in any SQL dialect that has ``md5``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def order_key(seed: int, *cols: Column | str) -> Column:
    """A uniform 32-digit hex string to sort by."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def as_int(key: Column) -> Column:
    """First seven hex digits as a number in ``[0, 2**28)``."""
    return F.conv(F.substring(key, 1, 7), 16, 10).cast("long")


def as_unit(key: Column) -> Column:
    """The same digits as a number in ``[0, 1)``."""
    return as_int(key) / F.lit(float(1 << 28))


def hash_split(seed: int, weights: dict[str, float], *cols: Column | str) -> Column:
    """Row-level split by hash: the row's draw falls into one of the weight intervals."""
    u = as_unit(order_key(seed, *cols))
    total = float(sum(weights.values()))
    names = list(weights)
    edge, out = 0.0, None
    for name in names[:-1]:
        edge += weights[name] / total
        cond = u < F.lit(edge)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])
