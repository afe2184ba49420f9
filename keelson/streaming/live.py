"""A relation kept up to date: each micro-batch of source changes becomes a change of the answer.

Every source and the answer is a log of changes over a base below one folder, so a batch
reads what the change rules need and writes only what changed; logs are compacted now and then. A
batch is netted to one change a key, applied, pushed through the plan's change rules,
and counts once its commit is written. A relation opened on a folder goes on from the last
commit, and a streaming batch that was committed already is passed by, so a repeated
batch after a failure changes nothing twice.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.errors import KeyClash
from keelson.operators.keyed import Keyed
from keelson.plans.check import check
from keelson.plans.compile import Compiler, compile_plan
from keelson.plans.nodes import Agg, Node, Source, fill, inputs, key_paths

from .delta import Delta, differing, netted
from .versions import Versions

#: Versions of changes that followers can still ask for.
KEEP = 64
ANSWER = ""
COMMIT = "version int, changed array<string>, compacted array<string>, checkpoint string, batch long"


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def _source_keys(node: Node) -> dict[str, tuple[str, ...]]:
    if isinstance(node, Source):
        return {node.name: node.key}
    return {k: v for n in inputs(node) for k, v in _source_keys(n).items()}


class Live:
    """A plan over keyed sources that change."""

    def __init__(self, spark: SparkSession, node: Node, schemas: Mapping[str, T.StructType | str], folder: str, values: Mapping[str, Any] | None = None):
        self.spark, self.node, self.folder = spark, fill(check(node), values or {}), folder
        self.keys = _source_keys(self.node)
        self.schemas = {k: T.StructType.fromDDL(s) if isinstance(s, str) else s for k, s in schemas.items()}
        empty = {n: spark.createDataFrame([], self.schemas[n]) for n in self.keys}
        answer = compile_plan(self.node, empty).schema
        self.logs = {n: Versions(spark, f"{folder}/source-{n}", self.schemas[n], [(k,) for k in self.keys[n]]) for n in self.keys}
        self.logs[ANSWER] = Versions(spark, f"{folder}/answer", _nullable(answer), key_paths(self.node))
        self.version, self.seen = 0, set()
        if not self._restore():
            for log in self.logs.values():
                log.start()
            self._commit(0, [], [], "", -1)

    def _restore(self) -> bool:
        """Take up the commits of the folder, if there are any."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return False
        for r in self.spark.read.schema(COMMIT).parquet(f"{self.folder}/commits").orderBy("version").collect():
            self.version = r["version"]
            self.seen.add((r["checkpoint"], r["batch"]))
            for kind, names in (("changed", r["changed"]), ("bases", r["compacted"])):
                for name in names:
                    getattr(self.logs[name], kind).append(r["version"])
        return True

    def _commit(self, version: int, changed: list[str], compacted: list[str], checkpoint: str, batch: int) -> None:
        self.spark.createDataFrame([(version, changed, compacted, checkpoint, batch)], COMMIT).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        self.seen.add((checkpoint, batch))

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        return {n: self.logs[n].at(self.version if version is None else version) for n in self.keys}

    def rows(self, version: int | None = None) -> DataFrame:
        """The answer at a version, the last one by default."""
        return self.logs[ANSWER].at(self.version if version is None else version)

    def changes_since(self, version: int) -> DataFrame | None:
        """version, prev, next of all later changes; None if they are forgotten and a snapshot is needed."""
        if version > self.version or self.version - version > KEEP:
            return None
        found = self.logs[ANSWER].change(0).withColumn("version", F.lit(0))
        for v in range(version + 1, self.version + 1):
            found = found.unionByName(self.logs[ANSWER].change(v).withColumn("version", F.lit(v)))
        return found.select("version", "prev", "next")

    def apply(self, patches: Mapping[str, tuple[DataFrame | None, DataFrame | None]], checkpoint: str = "", batch: int = -1) -> DataFrame:
        """Apply (rows to put, keys to drop) to sources as one version; gives the change of the answer.

        A batch that makes keys meet is refused and leaves nothing behind: it counts once its commit is written, and its files before that belong to no version.
        """
        old, to = self.tables(), self.version + 1
        new, changes = dict(old), {}
        for name, (put, drop) in patches.items():
            before = Keyed(old[name], self.keys[name])
            after = before.apply(None if put is None else put.select(*old[name].columns), drop)
            self.logs[name].write(to, before.changes_to(after))
            changes[name], new[name] = self.logs[name].change(to, True), self.logs[name].at(to, True)
        Compiler(new, verify=True)(self.node)
        return self._advance(to, Delta(old, new, changes, self._held())(self.node), list(patches), checkpoint, batch)

    def _held(self) -> dict[Node, DataFrame]:
        """The answer of the plan itself, which is kept, if it is an aggregation."""
        return {self.node: self.rows()} if isinstance(self.node, Agg) else {}

    def _advance(self, to: int, change: DataFrame | None, changed: list[str], checkpoint: str, batch: int) -> DataFrame:
        if change is not None:
            self.logs[ANSWER].write(to, change)
            changed = [*changed, ANSWER]
        compacted = [n for n in changed if self.logs[n].write_base(to)]
        self._commit(to, changed, compacted, checkpoint, batch)
        for n in changed:
            self.logs[n].record(to, n in compacted)
        self.version = to
        return self.logs[ANSWER].change(to)

    def retune(self, values: Mapping[str, Any], node: Node) -> DataFrame:
        """Another choice of holes: the answer is rebuilt and the difference to the held one given."""
        self.node = fill(check(node), values)
        return self._advance(self.version + 1, differing(self.rows(), compile_plan(self.node, self.tables()), self.node), [], "", -1)

    def forget(self) -> None:
        """Delete files that only versions older than the last KEEP need."""
        for log in self.logs.values():
            log.forget(max(0, self.version - KEEP))

    def follow(self, stream: DataFrame, source: str, checkpoint: str, available_now: bool = True, every: str | None = None):
        """Start a StreamingQuery over change rows (kind put or drop, seq, and the source's fields) of one source.

        It ends when what there is has been read (available_now), or runs on, at most once in `every` ("2 seconds").
        """
        columns, key = self.schemas[source].names, list(self.keys[source])

        def batch(rows: DataFrame, number: int) -> None:
            if (checkpoint, number) in self.seen:
                return
            row = F.struct(*(F.col(f"`{c}`") for c in columns))
            # The last change of each key in the batch decides; a put after a drop stays.
            last = rows.withColumn("_r", row).groupBy(*key).agg(F.max_by(F.struct("kind", "_r"), "seq").alias("_l"))
            put = last.filter("_l.kind = 'put'").select("_l._r.*")
            drop = last.filter("_l.kind = 'drop'").select(*key)
            self.apply({source: (put, drop)}, checkpoint, number)

        writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        if every is not None:
            return writer.trigger(processingTime=every).start()
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def window_changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """What a viewer of a window of rows must be sent when the window moves: rows that entered or changed, keys that left."""
    met = Keyed(before, tuple(key)).changes_to(Keyed(after, tuple(key)))
    return met.select(F.when(F.col("next").isNull(), "left").when(F.col("prev").isNull(), "entered").otherwise("changed").alias("what"), F.coalesce("next", "prev").alias("row"))


__all__ = ["KEEP", "KeyClash", "Live", "netted", "window_changes"]
