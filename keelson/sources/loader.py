"""A Spark data source over a Python loader: one partition for each key, read where the executors are."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def load_keys(spark: SparkSession, name: str, load: Callable[[str], Iterable[tuple]], schema: str, keys: Sequence[str], retries: int = 0) -> DataFrame:
    """Rows of load(key) for every key, under the data source `name`. A failing load is repeated in its task up to `retries` times."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(k) for k in keys]

        def read(self, partition):
            for attempt in range(retries + 1):
                try:
                    rows = list(load(partition.value))
                except Exception:
                    if attempt == retries:
                        raise
                else:
                    yield from rows
                    return

    class Loader(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Loader)
    return spark.read.format(name).load()


class Kept:
    """One value kept as an envelope (v, at, value) in a folder: read back only if its version can be used or migrated and it is not too old."""

    def __init__(self, spark: SparkSession, folder: str, version: int = 1, most_age: float | None = None, migrate: Callable[[int, str], str | None] | None = None):
        self.spark, self.folder, self.version, self.most_age, self.migrate = spark, folder, version, most_age, migrate

    def save(self, value: str, at: float) -> None:
        self.spark.createDataFrame([(self.version, at, value)], "v int, at double, value string").coalesce(1).write.mode("overwrite").parquet(self.folder)

    def load(self, now: float) -> str | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        row = self.spark.read.schema("v int, at double, value string").parquet(self.folder).first()
        if row is None or row["value"] is None or self.most_age is not None and now - row["at"] > self.most_age:
            return None
        if row["v"] == self.version:
            return row["value"]
        return self.migrate(row["v"], row["value"]) if self.migrate else None
