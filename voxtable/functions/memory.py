"""Memory of the Python workers that run array functions."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def release() -> None:
    """Hand freed memory back to the system at the end of a task: its Python worker lives on beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)       # only where the C library has it
    if trim is not None:
        trim(0)
