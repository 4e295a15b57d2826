"""What a Python worker holds between tasks: one operator's state at a time.

Workers are used again by other operators. Each asks here for its state, or tells that it has none, and what another
operator has left is let go, so that a worker never holds the vocabularies and memos of several.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_state: dict[Any, Any] = {}


def trim() -> None:
    """Give freed memory back to the system, Arrow's and, where it can, the C library's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def release() -> None:
    """Let go of all state."""
    if _state:
        _state.clear()
        gc.collect()
    trim()


def held(key: Any, build: Callable[[], Any]) -> Any:
    """The state under this key, built if the worker does not hold it."""
    if key not in _state:
        release()
        _state[key] = build()
    return _state[key]
