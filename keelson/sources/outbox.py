"""Kept values and an outbox of calls, as rows.

A store is a folder of Parquet tables; envelopes carry a version and a time. The book of
an outbox is a keyed table, so who owes what is a filter.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.errors import KeyClash

from .remote import PERMANENT, TEMPORARY, UNKNOWN

# States of an entry.
WAITING, SENDING, STUCK, DONE = "waiting", "sending", "stuck", "done"
# End of fixed values.


def backoff(attempt: int, base: float = 1.0, cap: float = 60.0) -> float:
    """Doubling delay, capped."""
    return min(cap, base * 2**attempt)


def readable(envelopes: DataFrame, version: int, now: float, most_age: float | None = None) -> DataFrame:
    """Kept envelopes (v, at, value) that can still be used: of this version, not too old, not empty."""
    ok: Column = (F.col("v") == version) & F.col("value").isNotNull()
    return envelopes.filter(ok if most_age is None else ok & (F.lit(now) - F.col("at") <= most_age))


@dataclass(frozen=True)
class Entry:
    id: str
    lane: str
    name: str
    args: Any
    at: float
    state: str = WAITING
    attempts: int = 0
    error: str | None = None


class Book:
    """An outbox's entries in a folder of Parquet: a log of entries as they changed, of which the last of each id counts. args are kept as JSON."""

    SCHEMA = "n long, id string, lane string, name string, args string, at double, state string, attempts int, error string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.n = self.frame().agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]

    def _append(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame([(self.n + 1 + i, *r) for i, r in enumerate(rows)], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)
        self.n += len(rows)

    def put(self, e: Entry) -> None:
        self._append([(e.id, e.lane, e.name, json.dumps(e.args), float(e.at), e.state, e.attempts, e.error)])

    def forget(self, *idents: str) -> None:
        self._append([(i, None, None, None, None, None, None, None) for i in idents])

    def frame(self) -> DataFrame:
        """The entries as rows, with n, when each changed last."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.SCHEMA)
        log = self.spark.read.schema(self.SCHEMA).parquet(self.folder)
        last = log.groupBy("id").agg(F.max_by(F.struct(*log.columns), "n").alias("_l"))
        return last.filter("_l.state is not null").select("_l.*")

    def load(self) -> list[Entry]:
        """The entries in the order of their offers."""
        rows = self.frame().orderBy("at", "id").collect()
        return [Entry(r["id"], r["lane"], r["name"], json.loads(r["args"]), r["at"], r["state"], r["attempts"], r["error"]) for r in rows]

    def compact(self) -> None:
        """Write the entries anew without their past."""
        held = self.frame().collect()
        self.spark.createDataFrame(held, self.SCHEMA).coalesce(1).write.mode("overwrite").parquet(self.folder)


@dataclass
class Outbox:
    """Calls to send, first in first out within a lane; an entry's id makes a repeat harmless.

    A permanent refusal discards the entry, an unknown outcome repeats it without
    counting, and other failures count until `most` leaves it stuck; its lane passes it over until it is retried.
    keep: a store that outlives the process; what it holds is taken up, and every change of an entry is written there first.
    """

    send: Callable[[Entry], None]
    most: int = 5
    classify: Callable[[Exception], str] = lambda e: TEMPORARY
    clock: Callable[[], float] = time.time
    book: dict[str, Entry] = field(default_factory=dict)
    #: The last entry that was refused for good, with its error.
    refused: Entry | None = None
    paused: bool = False
    keep: Book | None = None

    def __post_init__(self):
        if self.keep is not None:
            # Whether an entry that was being sent arrived is not known: it is sent again, which its id makes harmless.
            self.book = {e.id: replace(e, state=WAITING) if e.state == SENDING else e for e in self.keep.load()} | self.book

    def _put(self, entry: Entry) -> None:
        if self.keep is not None:
            self.keep.put(entry)
        self.book[entry.id] = entry

    def _forget(self, *idents: str) -> None:
        if self.keep is not None and idents:
            self.keep.forget(*idents)
        for ident in idents:
            del self.book[ident]

    def pause(self) -> None:
        """Hold the book: entries may still be offered, and none is sent."""
        self.paused = True

    def resume(self) -> int:
        """Send again, beginning with one step."""
        self.paused = False
        return self.step()

    def pending(self, pick: Callable[[Entry], str | None]) -> set[str]:
        """The subjects, as `pick` names them, that something is still owed for."""
        named = (pick(e) for e in self.book.values() if e.state != DONE)
        return {name for name in named if name is not None}

    def offer(self, ident: str, lane: str, name: str, args: Any = None) -> None:
        if ident in self.book:
            if (self.book[ident].lane, self.book[ident].name) != (lane, name):
                raise KeyClash(f"the id {ident} names another call")
            return
        self._put(Entry(ident, lane, name, args, self.clock()))

    def step(self) -> int:
        """Try the first entry of every lane that is not stuck once; gives how many went through."""
        sent, seen = 0, set()
        if self.paused:
            return sent
        for e in list(self.book.values()):
            if e.state in (DONE, STUCK) or e.lane in seen:
                continue
            seen.add(e.lane)
            self._put(replace(e, state=SENDING))
            try:
                self.send(e)
            except Exception as err:  # noqa: BLE001
                kind = self.classify(err)
                if kind == PERMANENT:
                    self._forget(e.id)
                    self.refused = replace(e, error=str(err))
                else:
                    tries = e.attempts + (kind != UNKNOWN)
                    self._put(replace(e, state=STUCK if tries >= self.most else WAITING, attempts=tries, error=str(err)))
            else:
                self._put(replace(e, state=DONE))
                sent += 1
        return sent

    def retry(self, ident: str) -> None:
        self._put(replace(self.book[ident], state=WAITING, attempts=0, error=None))

    def absorb(self, before: float) -> None:
        """Forget what was done before a snapshot that shows it."""
        self._forget(*(k for k, e in self.book.items() if e.state == DONE and e.at < before))

    def frame(self, spark) -> DataFrame:
        """The book as rows."""
        schema = "id string, lane string, name string, at double, state string, attempts int, error string"
        return spark.createDataFrame([(e.id, e.lane, e.name, float(e.at), e.state, e.attempts, e.error) for e in self.book.values()], schema)


def owed(book: DataFrame) -> DataFrame:
    return book.filter(F.col("state") != DONE)


def stuck(book: DataFrame) -> DataFrame:
    return book.filter(F.col("state") == STUCK)


def active(book: DataFrame) -> DataFrame:
    return book.filter(F.col("state").isin(WAITING, SENDING))
