"""What a task process keeps for its next tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

KEPT: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """The object of this key, made on first use. Only the latest is held, so tables of several operators never add up."""
    if key not in KEPT:
        release()
        KEPT[key] = make()
    return KEPT[key]


def release() -> None:
    """Forgets what an earlier step of this process kept and gives its memory back; called by steps with tables of their own."""
    KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc only
        trim(0)
