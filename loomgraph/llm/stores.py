"""What a Python worker keeps from task to task: one budget of bytes for all of it, emptied when another operator begins.

Spark reuses Python workers for whatever task comes next, so objects in module globals would pile up over the stages of
a job. An operator's task first says enter(name); if the worker's last task was another operator's, everything that
was held is dropped and its memory given back to the system.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import weakref
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longest key, in characters or bytes, that is kept.
KEEP_CHARS = 48
#: Bytes that all stores of a worker may have together, about: keys and values as Python counts them, and an entry's place.
KEEP_BYTES, PLACE_BYTES = 96 << 20, 120
#: The place of an entry in Arrow arrays, which Arrow finds by a table that it makes for each lookup.
LOOKUP_BYTES = 48

_stores: weakref.WeakSet[Kept | KeptArrays] = weakref.WeakSet()
_used = 0


class Kept(dict):
    """Values by key; make() gives those that aren't there yet. Long keys aren't kept.

    When the stores of the worker are full together, all of them start anew: what is often asked for comes back first.
    """

    __hash__ = object.__hash__

    def __init__(self, make: Callable[[Any], Any]):
        super().__init__()
        self.make, self.bytes = make, 0
        _stores.add(self)

    def __missing__(self, key: Any) -> Any:
        global _used
        value = self.make(key)
        if len(key) <= KEEP_CHARS:
            size = sys.getsizeof(key) + sys.getsizeof(value) + PLACE_BYTES
            if _used + size > _most:
                empty()
            _used += size
            self.bytes += size
            self[key] = value
        return value

    def __del__(self) -> None:
        global _used
        _used -= self.bytes


class KeptArrays:
    """Byte strings by text in Arrow arrays, which hold about three times as many as dicts: for lookups of many texts at once.

    Long texts aren't kept; when the stores of the worker are full together, all of them start anew.
    """

    def __init__(self) -> None:
        self.bytes = 0
        self.clear()
        _stores.add(self)

    def clear(self) -> None:
        self.keys, self.values = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def many(self, keys: pa.Array, make: Callable[[list[str]], list[bytes]]) -> pa.Array:
        """The values of distinct keys; make() gives those that aren't there yet, all at once."""
        global _used
        places = pc.fill_null(pc.index_in(keys, value_set=self.keys), -1).to_numpy().copy()
        absent = places < 0
        new = keys.filter(pa.array(absent))
        made = pa.array(make(new.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        places[absent] = len(self.keys) + np.arange(len(new))
        found = pa.concat_arrays([self.values, made]).take(pa.array(places))
        short = pc.less_equal(pc.utf8_length(new), KEEP_CHARS)
        new, made = new.filter(short), made.filter(short)
        size = new.nbytes + made.nbytes + LOOKUP_BYTES * len(new)
        if _used + size > _most:
            empty()
        if size <= _most:
            self.keys, self.values = pa.concat_arrays([self.keys, new]), pa.concat_arrays([self.values, made])
            self.bytes += size
            _used += size
        return found

    def __del__(self) -> None:
        global _used
        _used -= self.bytes


def empty() -> None:
    """All stores lose their entries."""
    global _used
    for store in list(_stores):
        store.clear()
        _used -= store.bytes
        store.bytes = 0


_held: dict[Any, Any] = {}
_operator: str | None = None
_most = KEEP_BYTES


def _give_back() -> None:
    """Freed memory goes back to the system, as far as allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def enter(operator: str, most: int = KEEP_BYTES) -> None:
    """A task of this operator begins in the worker; its stores may have so many bytes."""
    global _operator, _most
    _most = most
    if _operator != operator:
        if _operator is not None:
            _held.clear()
            empty()
            _give_back()
        _operator = operator


def held(key: Any, make: Callable[[], Any]) -> Any:
    """make()'s object, one for the worker and key until another operator begins."""
    if key not in _held:
        _held[key] = make()
    return _held[key]
