"""What Python workers keep between tasks, bounded by bytes and by time.

A worker lives on when its task ends, and so would what it remembers, beside the next
stage's work. So a worker keeps an object only while tasks come: some seconds after the
last one it drops all of them and gives the freed memory back.
"""

from __future__ import annotations

import ctypes
import gc
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress
from typing import Any

#: Seconds without a task after which a worker holds nothing.
IDLE = 2.0

_lock = threading.Lock()
_kept: dict[tuple, Any] = {}
_state = {"tasks": 0, "last": 0.0, "watch": False}


def _release() -> None:
    gc.collect()
    with suppress(ImportError, AttributeError):
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _watch() -> None:
    while True:
        time.sleep(IDLE / 4)
        with _lock:
            if _state["tasks"] or time.monotonic() - _state["last"] < IDLE:
                continue
            _kept.clear()
            _state["watch"] = False
        _release()
        return


@contextmanager
def task() -> Iterator[None]:
    """To be held while a task runs in this worker."""
    with _lock:
        _state["tasks"] += 1
    try:
        yield
    finally:
        with _lock:
            _state["tasks"] -= 1
            _state["last"] = time.monotonic()
            if not _state["watch"]:
                _state["watch"] = True
                threading.Thread(target=_watch, daemon=True).start()


def kept(make: Callable, *args: Any) -> Any:
    """make(*args), made once for the tasks that follow each other in this worker; objects of
    another kind go first."""
    key = (make, *args)
    with _lock:
        if key not in _kept:
            for other in [k for k in _kept if k[0] is not make]:
                del _kept[other]
            _kept[key] = make(*args)
        return _kept[key]


class Memory:
    """What a Python worker remembers: strings and their results, of about ``most`` bytes.

    Two generations: when the newer one holds half of the bytes, it becomes the older
    one, and the older one goes; what is asked for again moves to the newer one.
    """

    #: Bytes of a key and a value besides their characters: two objects and a place in a dictionary.
    EACH = 220

    def __init__(self, most: int):
        self.most, self.size = most, 0
        self.new: dict = {}
        self.old: dict = {}

    def missing(self, asked: Iterable) -> list:
        """The keys that aren't remembered; those that only the older generation has move up."""
        unknown = set(asked).difference(self.new)
        kept = {x: self.old[x] for x in unknown if x in self.old} if self.old else {}
        self.add(kept)
        return [x for x in unknown if x not in kept]

    def add(self, found: dict) -> None:
        self.new.update(found)
        self.size += self.EACH * len(found) + sum(map(len, found)) + sum(map(len, found.values()))

    def turn(self) -> None:
        """To be called when no key of a batch is needed any more."""
        if self.size > self.most // 2:
            self.old, self.new, self.size = self.new, {}, 0


def slices(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about ``most`` characters each, one text at least."""
    yield from runs_of(map(len, texts), most)


def runs_of(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of these sizes that add up to about ``most`` each, one at least."""
    at = held = to = 0
    for i, n in enumerate(sizes):
        if i > at and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
        to = i + 1
    if at < to:
        yield at, to
