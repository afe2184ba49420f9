"""Remote reads: what is known of an answer that has to be asked for, and when to ask again.

The clock and the loader are given, so everything here can be driven by hand.
"""

from __future__ import annotations

import queue
import random
import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# States of a remote answer and kinds of failure.
EMPTY, LOADING, VALUE, FAILED = "empty", "loading", "value", "failed"
PERMANENT, UNKNOWN, TEMPORARY = "permanent", "unknown", "temporary"
# End of fixed values.


@dataclass(frozen=True)
class Remote:
    """State of an answer; `held` is the last good value, taken at `at`."""

    state: str = EMPTY
    held: Any = None
    at: float | None = None
    error: str | None = None
    kind: str | None = None


def loading(held: Any = None, at: float | None = None) -> Remote:
    """Asked, and not answered yet; `held` is what is known so far."""
    return Remote(LOADING, held, at)


def arrived(value: Any, at: float) -> Remote:
    return Remote(VALUE, value, at)


def refused(error: str, kind: str = UNKNOWN, was: Remote | None = None) -> Remote:
    """Failed; the last good value of `was` stays held."""
    return replace(was or Remote(), state=FAILED, error=error, kind=kind)


def held_of(r: Remote) -> Any:
    return r.held


def age_of(r: Remote, now: float) -> float | None:
    return None if r.at is None else now - r.at


def is_fresh(r: Remote, now: float, shelf_life: float) -> bool:
    return r.state == VALUE and r.at is not None and now - r.at <= shelf_life


def together(parts: Iterable[Remote], combine: Callable[..., Any]) -> Remote:
    """All of several answers: the first failure in their order, else loading, else empty, else their combination, as old as the oldest."""
    parts = list(parts)
    for state in (FAILED, LOADING, EMPTY):
        for p in parts:
            if p.state == state:
                return replace(p, held=None, at=None)
    return Remote(VALUE, combine(*(p.held for p in parts)), min((p.at for p in parts), default=None))


def first_of(parts: Iterable[Remote]) -> Remote:
    """The first answer that has a value, else the first that is loading, else the first failure, else the first."""
    parts = list(parts)
    for state in (VALUE, LOADING, FAILED):
        for p in parts:
            if p.state == state:
                return p
    return parts[0] if parts else Remote()


def status_of(answers: DataFrame, group: str) -> DataFrame:
    """The same over a table of answers (state, at): all in, and the time of the oldest, for each group."""
    return answers.groupBy(group).agg(F.bool_and(F.col("state") == VALUE).alias("arrived"), F.min("at").alias("at"))


@dataclass
class Tally:
    asked: int = 0
    answered: int = 0
    called_off: int = 0
    refused: int = 0
    published: int = 0


@dataclass
class RemoteSource:
    """One question, asked by `load`; retries back off doubling with full jitter, up to 32 times the base.

    calm: no question follows another within so many seconds. timeout: a load that takes longer counts as a failure of unknown outcome
    (its thread is left to end by itself). partial: `load` is given a function to tell what it has so far, which is
    published as still loading.
    """

    load: Callable[[], Any]
    every: float | None = None
    shelf_life: float = float("inf")
    retries: int = 0
    base: float = 1.0
    floor: float = 0.0
    calm: float = 0.0
    timeout: float | None = None
    partial: bool = False
    asked_at: float | None = field(default=None, init=False)
    classify: Callable[[Exception], str] = lambda e: UNKNOWN
    clock: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep
    jitter: Callable[[float, float], float] = random.uniform
    answer: Remote = field(default_factory=Remote)
    tally: Tally = field(default_factory=Tally)

    def get(self, fresh: bool = False) -> Remote:
        """The answer, asked for if there is none, if it is stale, or if `fresh` demands it."""
        now = self.clock()
        due = self.every is not None and self.answer.at is not None and now - self.answer.at >= self.every
        calm = self.asked_at is not None and now - self.asked_at < self.calm
        if not calm and (fresh or due or not is_fresh(self.answer, now, self.shelf_life)):
            self._ask()
        return self.answer

    def require(self) -> Any:
        """The value, or the failure as an exception."""
        r = self.get()
        if r.state != VALUE:
            raise LookupError(r.error or f"no answer: {r.state}")
        return r.held

    def _so_far(self, value: Any) -> None:
        self.answer = loading(value, self.clock())
        self.tally.published += 1

    def _load(self) -> Any:
        work = (lambda: self.load(self._so_far)) if self.partial else self.load
        if self.timeout is None:
            return work()
        said: queue.Queue = queue.Queue(1)

        def run():
            try:
                said.put((work(), None))
            except Exception as e:  # noqa: BLE001
                said.put((None, e))

        threading.Thread(target=run, daemon=True).start()
        try:
            value, error = said.get(timeout=self.timeout)
        except queue.Empty:
            self.tally.called_off += 1
            raise TimeoutError(f"no answer within {self.timeout} seconds") from None
        if error is not None:
            raise error
        return value

    def _ask(self) -> None:
        for attempt in range(self.retries + 1):
            self.tally.asked += 1
            self.asked_at = self.clock()
            try:
                value = self._load()
            except Exception as e:  # noqa: BLE001
                kind = UNKNOWN if isinstance(e, TimeoutError) else self.classify(e)
                self.tally.refused += 1
                self.answer = replace(self.answer, state=FAILED, error=str(e), kind=kind)
                if kind == PERMANENT or attempt == self.retries:
                    return
                self.sleep(max(self.floor, self.jitter(0, self.base * min(2**attempt, 32))))
            else:
                self.tally.answered += 1
                if value != self.answer.held or self.answer.state != VALUE:
                    self.tally.published += 1
                self.answer = Remote(VALUE, value, self.clock())
                return

    def restore(self, value: Any, at: float) -> None:
        """Begin with a kept value."""
        self.answer = Remote(VALUE, value, at)


def fresh(source: RemoteSource) -> Remote:
    """The source's answer if it is fresh, else an empty one that keeps what is held."""
    r = source.answer
    return r if is_fresh(r, source.clock(), source.shelf_life) else replace(r, state=EMPTY)


def arrival_of(source: RemoteSource, seconds: float = 60.0, pause: float = 0.05) -> Any:
    """Ask until a value lands, and give it; LookupError at once where asking is refused for good, TimeoutError where none lands in time."""
    end = source.clock() + seconds
    while (r := source.get()).state != VALUE:
        if r.kind == PERMANENT:
            raise LookupError(r.error)
        if source.clock() >= end:
            raise TimeoutError("no answer landed in time")
        source.sleep(pause)
    return r.held


class Questions:
    """One source for each key; the least recently used beyond `most` are let go."""

    def __init__(self, load: Callable[[Any], Any], most: int = 1024, **options):
        self.load, self.most, self.options, self.open = load, most, options, OrderedDict()

    def __getitem__(self, key) -> RemoteSource:
        if key not in self.open:
            self.open[key] = RemoteSource(lambda: self.load(key), **self.options)
        self.open.move_to_end(key)
        while len(self.open) > self.most:
            self.open.popitem(last=False)
        return self.open[key]


def reconcile(target: Callable[[], Any], apply: Callable[[Any], None], attempts: int = 5, sleep: Callable[[float], None] = time.sleep, base: float = 1.0, most: int = 1000) -> bool:
    """Make the world match the latest target: a newer target supersedes one being tried, and failures are counted anew for it.

    It gives up after `attempts` failures over one target, or if the target has moved `most` times.
    """
    failures, want, moves = 0, target(), 0
    while failures < attempts and moves < most:
        try:
            apply(want)
        except Exception:  # noqa: BLE001
            failures += 1
            done = False
            if failures < attempts:
                sleep(base * 2 ** (failures - 1))
        else:
            done = True
        now = target()
        if now != want:
            failures, want, moves = 0, now, moves + 1
        elif done:
            return True
    return False
