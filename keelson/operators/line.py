"""A line of measured rows: where each begins, what stands at a point, and edits by index."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .running import ordered_pass


@dataclass(frozen=True)
class Line:
    """Rows (index from 0, size). Edits give a new line; an index outside it changes nothing."""

    df: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, sizes: Sequence[float]) -> Line:
        return cls(spark.createDataFrame([(i, float(s)) for i, s in enumerate(sizes)], "index long, size double"))

    def placed(self) -> DataFrame:
        """index, size and offset, the sum of the sizes ahead."""
        return ordered_pass(self.df, [(F.col("index"), False)], [], F.col("size"), before="offset")

    def offset_of(self, index: int) -> DataFrame:
        """The sum of the sizes ahead of an index: a filter and a sum, without sorting."""
        return self.df.filter(F.col("index") < index).agg(F.coalesce(F.sum("size"), F.lit(0.0)).alias("offset"))

    def at(self, point: float) -> DataFrame:
        """index and how far into the row the point lies; ends of the line hold points beyond them, and an empty line answers -1."""
        held = F.struct(F.col("index"), (F.lit(float(point)) - F.col("offset")).alias("into"))
        row = self.placed().agg(F.max_by(held, F.when((F.col("offset") <= point) | (F.col("index") == 0), F.col("index"))).alias("r"))
        return row.select(F.coalesce("r.index", F.lit(-1)).alias("index"), F.coalesce("r.into", F.lit(0.0)).alias("into"))

    def total(self) -> DataFrame:
        return self.df.agg(F.coalesce(F.sum("size"), F.lit(0.0)).alias("total"), F.count(F.lit(1)).alias("size"))

    def measure(self, index: int, size: float) -> Line:
        """A row measured anew."""
        return Line(self.df.withColumn("size", F.when(F.col("index") == index, F.lit(float(size))).otherwise(F.col("size"))))

    def insert(self, index: int, sizes: Sequence[float]) -> Line:
        """New rows ahead of `index`, which pushes the rest down; index is the place of the first new row and at most the line's length."""
        new = Line.of(self.df.sparkSession, sizes).df.withColumn("index", F.col("index") + index)
        return Line(self.df.withColumn("index", F.col("index") + F.when(F.col("index") >= index, len(sizes)).otherwise(0)).unionByName(new))

    def remove(self, index: int, count: int = 1) -> Line:
        kept = self.df.filter((F.col("index") < index) | (F.col("index") >= index + count))
        return Line(kept.withColumn("index", F.col("index") - F.when(F.col("index") >= index, count).otherwise(0)))

    def replace(self, sizes: Sequence[float]) -> Line:
        return Line.of(self.df.sparkSession, sizes)
