"""Places and running sums in a total order, in one window or in two phases."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Estimated bytes of input from which a global order is worked through in two phases.
TWO_PHASES = 256 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the folder that all executors share: the context's checkpoint folder or else spark.checkpoint.dir; only a local master gets a temporary one."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="keelson-"))
    return df.checkpoint()


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def ordered_pass(
    df: DataFrame, order: Sequence[tuple[Column, bool]], ties: Sequence[Column], step: Column | None = None, before: str | None = None, through: str | None = None, place: str | None = None, start: float = 0, two_phases: bool | None = None
) -> DataFrame:
    """df with the sum of `step` ahead of each row (before) and with it (through), and its place from 0.

    Rows stand in the order given (column, whether it falls), then by ties. Nulls stand first
    upwards and last downwards; a null step adds nothing. A global window sorts all rows in one task, so
    inputs over TWO_PHASES bytes are cut into ranges first: each range is counted and summed,
    which tells where each begins, and rows run on within their range.
    """
    names = [f"_o{i}" for i in range(len(order) + len(ties))]
    falls = [falling for _, falling in order] + [False] * len(ties)
    sort = [F.desc(n) if falling else F.asc(n) for n, falling in zip(names, falls)]
    value = F.lit(0.0) if step is None else F.coalesce(step.cast("double"), F.lit(0.0))
    frame = df.withColumns({**dict(zip(names, [c for c, _ in order] + list(ties))), "_step": value})
    if two_phases is None:
        two_phases = estimated_bytes(df) > TWO_PHASES
    if two_phases:
        frame = checkpointed(frame.repartitionByRange(*sort).withColumn("_range", F.spark_partition_id()))
        sums = frame.groupBy("_range").agg(F.sum("_step").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
        ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        begins = sums.select("_range", F.coalesce(F.sum("_sum").over(ahead), F.lit(0.0)).alias("_begin"), F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_first"))
        # One row for each range, as many as shuffle partitions.
        frame = frame.join(F.broadcast(begins), "_range")
        within = Window.partitionBy("_range").orderBy(*sort)
    else:
        frame = frame.withColumns({"_begin": F.lit(0.0), "_first": F.lit(0).cast("long")})
        within = Window.orderBy(*sort)
    base = F.col("_begin") + F.lit(float(start))
    made = {
        before: F.coalesce(F.sum("_step").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + base,
        through: F.sum("_step").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + base,
        place: F.row_number().over(within) - 1 + F.col("_first"),
    }
    made = {n: c for n, c in made.items() if n is not None}
    return frame.withColumns(made).select(*(F.col(f"`{c}`") for c in df.columns if c not in made), *made)


def running_sum(df: DataFrame, order: Sequence[tuple[Column, bool]], key: Column, step: Column, before: str | None, through: str | None, start: float = 0, two_phases: bool | None = None) -> DataFrame:
    """df with the sum of `step` before each row and through it, in the order given and then by key as text."""
    return ordered_pass(df, order, [key], step, before, through, None, start, two_phases)
