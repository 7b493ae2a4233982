"""A byte-bounded cache of encoded pieces, one for each Python worker."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

#: What an entry takes besides its key's and its value's bytes: two object heads and a dictionary slot.
_ENTRY = 190


class Pieces:
    """Piece -> ids (bytes). Two generations: when the younger one is full it becomes the older one, whose pieces go unless they were
    seen again. So frequent pieces stay, and neither the number of different pieces nor their length grows the worker."""

    def __init__(self, most: int = 48 << 20):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.used = 0

    def find(self, names: list[str]) -> tuple[list[bytes | None], list[int]]:
        """What is known of the names, and the places of those that aren't."""
        found = list(map(self.young.get, names))
        missing, old = [], self.old
        for i, x in enumerate(found):
            if x is None:
                x = old.get(names[i])
                if x is None:
                    missing.append(i)
                else:
                    found[i] = x
                    self.put(names[i], x)
        return found, missing

    def put(self, name: str, ids: bytes) -> None:
        self.young[name] = ids
        self.used += _ENTRY + len(name) + len(ids)
        if 2 * self.used > self.most:
            self.old, self.young, self.used = self.young, {}, 0


def give_back() -> None:
    """Return what a Python worker has freed to the machine: a reused worker otherwise keeps the peak of every stage that it ran."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # no glibc


def tidy(run):
    """``run`` for mapInArrow, with ``give_back`` when a task's rows are done."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
