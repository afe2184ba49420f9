"""Cells that hold values and depend on one another, on the driver.

Ports are set, derived cells are worked out when somebody looks or watches, and an equal
result stops the wave. Queries use cells for their holes; what is watched re-runs when a
cell it read changes. One thread at a time; a batch is one wave.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable
from contextlib import contextmanager
from typing import Any

#: Wakings of one watcher in one wave before it counts as a loop.
LOOP = 100


class CycleError(RecursionError):
    """A cell reads itself; the text names the cells of the ring."""


_reading: list[_Node | None] = []
_batch: list[set[Watch] | None] = [None]


class _Node:
    def __init__(self, name: str = ""):
        self.name, self.users, self.version = name, set(), 0

    def _read(self) -> None:
        if _reading and _reading[-1] is not None:
            _reading[-1].sources[self] = self.version
            self.users.add(_reading[-1])


class Port(_Node):
    """A cell that is set from outside."""

    def __init__(self, value: Any, name: str = ""):
        super().__init__(name)
        self._value = value

    def get(self) -> Any:
        self._read()
        return self._value

    @property
    def value(self) -> Any:
        return self.get()

    def set(self, value: Any) -> None:
        if value == self._value:
            return
        journal.note("set", self.name, value)
        self._value, self.version = value, self.version + 1
        with batch():
            for u in list(self.users):
                u._stale()


class Derived(_Node):
    """A cell worked out from others, lazily, and again only if one of them differs."""

    def __init__(self, compute: Callable[[], Any], name: str = ""):
        super().__init__(name)
        self.compute, self.sources, self.fresh, self.known, self._value, self._error = compute, {}, False, False, None, None

    def get(self) -> Any:
        """The value; a formula that failed fails for every reader, without running again before something it read differs."""
        self._ensure()
        self._read()
        if self._error is not None:
            raise self._error
        return self._value

    @property
    def value(self) -> Any:
        return self.get()

    def _ensure(self) -> None:
        if self.fresh:
            return
        if self.known and not _differs(self):
            self.fresh = True
            return
        if self in _reading:
            ring = _reading[_reading.index(self) :]
            raise CycleError(" -> ".join((n.name or "?") for n in [*ring, self] if n is not None))
        value, error = None, None
        try:
            value = _run(self, self.compute)
        except CycleError:
            self.fresh = self.known = False
            raise
        except Exception as e:  # noqa: BLE001
            error = e
        if not self.known or value != self._value or error is not None or self._error is not None:
            self._value, self._error, self.version = value, error, self.version + 1
        self.fresh = self.known = True

    def _stale(self) -> None:
        if self.fresh:
            self.fresh = False
            for u in list(self.users):
                u._stale()


def _differs(node) -> bool:
    for s, version in list(node.sources.items()):
        if isinstance(s, Derived):
            s._ensure()
        if s.version != version:
            return True
    return False


def _run(node, f):
    for s in node.sources:
        s.users.discard(node)
    node.sources = {}
    _reading.append(node)
    try:
        return f()
    finally:
        _reading.pop()


class Watch:
    """Runs at once, and again whenever something it read differs; `stop` ends that."""

    def __init__(self, effect: Callable[[], None]):
        self.effect, self.sources, self.live = effect, {}, True
        _run(self, effect)

    def _stale(self) -> None:
        if self.live:
            _batch[0].add(self)

    def stop(self) -> None:
        self.live = False
        for s in self.sources:
            s.users.discard(self)


@contextmanager
def batch():
    """Changes inside are one wave: watchers run once, at the end."""
    if _batch[0] is not None:
        yield
        return
    _batch[0], woken = set(), {}
    try:
        yield
        while _batch[0]:
            w = _batch[0].pop()
            if w.live and _differs(w):
                woken[w] = woken.get(w, 0) + 1
                if woken[w] > LOOP:
                    raise RecursionError("a watcher keeps waking itself")
                _run(w, w.effect)
    finally:
        _batch[0] = None


@contextmanager
def untracked():
    """What is read inside is not depended on."""
    _reading.append(None)
    try:
        yield
    finally:
        _reading.pop()


class Family:
    """A cell for each key, made when asked for; the least recently used beyond `most` that nobody watches are let go."""

    def __init__(self, make: Callable[[Any], _Node], most: int = 1024):
        self.make, self.most, self.open = make, most, OrderedDict()

    def __getitem__(self, key) -> _Node:
        if key not in self.open:
            self.open[key] = self.make(key)
        self.open.move_to_end(key)
        for k in [k for k, n in self.open.items() if not n.users and k != key][: max(0, len(self.open) - self.most)]:
            del self.open[k]
        return self.open[key]


class Journal:
    """The last events, with a count of each kind."""

    def __init__(self, most: int = 1000):
        self.events, self.counts = deque(maxlen=most), {}

    def note(self, kind: str, *facts) -> None:
        self.counts[kind] = self.counts.get(kind, 0) + 1
        self.events.append((kind, *facts))

    def replay(self, apply: Callable[..., None]) -> None:
        for e in list(self.events):
            apply(*e)


journal = Journal()
