"""A keyed table as a log of changes over a base, so that a batch writes what changed and no more.

Files are written first and recorded later: what is written and not recorded, of a batch that was refused or that failed, is
in no version, and is overwritten by the next that takes its number.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.folds import key_text

#: Change sets over a base before a new base is written.
FAN = 16


@dataclass
class Versions:
    """Versions of one table below a folder: bases/<v> hold rows, changes/<v> hold prev and next."""

    spark: SparkSession
    folder: str
    schema: T.StructType
    paths: list[tuple[str, ...]]
    bases: list[int] = field(default_factory=lambda: [0])
    changed: list[int] = field(default_factory=list)

    def _row(self) -> T.StructType:
        return T.StructType([T.StructField("prev", self.schema), T.StructField("next", self.schema)])

    def start(self) -> None:
        self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(f"{self.folder}/bases/0")

    def change(self, version: int, written: bool = False) -> DataFrame:
        """prev, next of one version; nothing if the table did not change there. written: it may be written and not recorded."""
        if version not in self.changed and not written:
            return self.spark.createDataFrame([], self._row())
        return self.spark.read.schema(self._row()).parquet(f"{self.folder}/changes/{version}")

    def at(self, version: int, written: bool = False) -> DataFrame:
        """The rows at a version: the last base, without keys that changed since, and what these keys hold now. written: its change may be written and not recorded."""
        base = max(b for b in self.bases if b <= version)
        rows = self.spark.read.schema(self.schema).parquet(f"{self.folder}/bases/{base}")
        later = [v for v in self.changed if base < v <= version]
        later += [version] if written and version not in later and version > base else []
        if not later:
            return rows
        log = None
        for v in later:
            one = self.change(v, True).withColumn("_v", F.lit(v))
            log = one if log is None else log.unionByName(one)
        log = log.withColumn("_r", F.coalesce("next", "prev"))
        log = log.withColumn("_key", key_text(log.schema, [("_r", *p) for p in self.paths]))
        last = log.groupBy("_key").agg(F.max_by(F.struct("next"), "_v").alias("_n"))
        kept = rows.withColumn("_key", key_text(rows.schema, self.paths)).join(last.select("_key"), "_key", "left_anti").drop("_key")
        return kept.unionByName(last.filter("_n.next is not null").select("_n.next.*"))

    def write(self, version: int, change: DataFrame) -> None:
        change.select(F.col("prev").cast(self.schema), F.col("next").cast(self.schema)).write.mode("overwrite").parquet(f"{self.folder}/changes/{version}")

    def write_base(self, version: int, fan: int = FAN) -> bool:
        """Write a new base at a version just written, if with it more than `fan` change sets stand over the last base."""
        if sum(v > self.bases[-1] for v in {*self.changed, version}) <= fan:
            return False
        self.at(version, True).write.mode("overwrite").parquet(f"{self.folder}/bases/{version}")
        return True

    def record(self, version: int, based: bool = False) -> None:
        """From now on what was written for a version, and its base, count."""
        if version not in self.changed:
            self.changed.append(version)
        if based and version not in self.bases:
            self.bases.append(version)

    def forget(self, before: int) -> None:
        """Delete what no version from `before` on needs."""
        base = max(b for b in self.bases if b <= before)
        for kind, held in (("bases", self.bases), ("changes", self.changed)):
            for v in [v for v in held if v < base or kind == "changes" and v <= base and v < before]:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}/{v}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
                held.remove(v)
