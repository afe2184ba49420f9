"""Feeds: one keyed table that is told of rows by hand, by snapshot or by a stream, and read through views.

A feed keeps its rows as a change log over Parquet, so a batch writes what changed and
no more, and what reads a version is not disturbed by later ones. A feed opened on the folder
of an earlier one goes on from its last commit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from keelson.functions.expr import Expr
from keelson.operators.keyed import Keyed, Wins
from keelson.operators.views import Ordered

from .versions import Versions

COMMIT = "version int, based boolean"


@dataclass
class Feed:
    """A named feed. live starts whatever brings batches (it is given `feed`) and gives what stops it; it
    runs while somebody looks."""

    spark: SparkSession
    folder: str
    schema: T.StructType | str
    key: tuple[str, ...]
    wins: Wins | None = None
    live: Callable[[Callable[..., DataFrame]], Callable[[], None]] | None = None
    version: int = field(default=0, init=False)
    _looks: int = field(default=0, init=False)
    _stop: Callable[[], None] | None = field(default=None, init=False)

    def __post_init__(self):
        self.schema = T.StructType.fromDDL(self.schema) if isinstance(self.schema, str) else self.schema
        self._log = Versions(self.spark, self.folder, self.schema, [(k,) for k in self.key])
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            for r in self.spark.read.schema(COMMIT).parquet(f"{self.folder}/commits").orderBy("version").collect():
                if r["version"]:
                    self._log.record(r["version"], r["based"])
                self.version = r["version"]
        else:
            self._log.start()
            self._commit(0, False)

    def _commit(self, version: int, based: bool) -> None:
        self.spark.createDataFrame([(version, based)], COMMIT).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def table(self) -> Keyed:
        """The feed as a keyed table of this moment."""
        return Keyed(self._log.at(self.version), self.key, self.wins)

    def _become(self, turn: Callable[[Keyed], Keyed]) -> DataFrame:
        held, to = self.table(), self.version + 1
        self._log.write(to, held.changes_to(turn(held)))
        based = self._log.write_base(to)
        self._commit(to, based)
        self._log.record(to, based)
        self.version = to
        return self._log.change(to)

    # What the feed is told; each gives the change (prev, next) it made.

    def take(self, rows: DataFrame, seq: str | None = None) -> DataFrame:
        """Rows in; a row that loses by `wins` or equals the held one changes nothing."""
        return self._become(lambda t: t.put(rows, seq))

    def lose(self, keys: DataFrame) -> DataFrame:
        return self._become(lambda t: t.drop(keys))

    def feed(self, put: DataFrame | None = None, drop: DataFrame | None = None, seq: str | None = None) -> DataFrame:
        """A batch, puts and drops together, as one version."""
        return self._become(lambda t: t.apply(put, drop, seq))

    def reset(self, rows: DataFrame, seq: str | None = None) -> DataFrame:
        """The whole picture anew."""
        return self._become(lambda t: t.replace(rows, seq))

    # What it is asked.

    def rows(self) -> DataFrame:
        return self.table().df

    def size(self) -> DataFrame:
        return self.table().size()

    def row(self, *key) -> DataFrame:
        return self.table().row(*key)

    def peek(self, *key) -> Row | None:
        return self.row(*key).first()

    def only(self, test: Expr) -> Keyed:
        return self.table().where(test)

    def only_live(self, before: Expr, after: Expr) -> DataFrame:
        """What enters and leaves when the test of a part changes."""
        return self.table().where_live(before, after)

    def sorted_by(self, *by) -> Ordered:
        return Ordered(self.table(), *by)

    def count(self, test: Expr | None = None) -> DataFrame:
        return self.table().count(test)

    def sum_by(self, measure: Expr) -> DataFrame:
        return self.table().sum_by(measure)

    def changes_since(self, version: int) -> list[DataFrame]:
        """The change of every later version, in order."""
        return [self._log.change(v) for v in range(version + 1, self.version + 1)]

    def look(self) -> Callable[[], None]:
        """Begin to look: the first look starts the live half, and the last to end stops it. Gives what ends this look, once."""
        self._looks += 1
        if self._looks == 1 and self.live is not None:
            self._stop = self.live(self.feed)
        ended = []

        def end() -> None:
            if ended:
                return
            ended.append(True)
            self._looks -= 1
            if not self._looks and self._stop is not None:
                stop, self._stop = self._stop, None
                stop()

        return end
