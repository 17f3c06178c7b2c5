"""What Python workers remember, and how they forget it: a worker stays for many
tasks, and an executor has several, so each should hold little between tasks."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def _released() -> None:
    """Hand freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has no such call
        pass


def forgetful(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """For a function from batches to batches: releases memory when a task ends."""
    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        _released()
    return wrapped


class Memo(dict):
    """``memo[key]`` is ``make(key)``, remembered; ``trim`` empties a memo of over
    ``most`` entries."""

    def __init__(self, make: Callable, most: int):
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
