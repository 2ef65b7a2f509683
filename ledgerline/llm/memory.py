"""What a Python worker remembers from task to task: for one owner at a time, so that stages do not add up in memory."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

_HELD: dict[str, dict] = {}


def memory(owner: str) -> dict:
    """The owner's dictionary; what others left in this worker is dropped, and its memory goes back to the machine."""
    others = [name for name in _HELD if name != owner]
    for other in others:
        _HELD.pop(other).clear()
    if others:
        gc.collect()
        # Many small objects, and batches that are over, leave the allocators' pages empty but held.
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
    return _HELD.setdefault(owner, {})
