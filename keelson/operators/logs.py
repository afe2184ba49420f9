"""Search in lines of text: hits, their histogram and the heights of its bars."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(text: Column, needle: str, regex: bool = False) -> Column:
    """Whether a line holds the needle; an empty needle or an unreadable pattern holds nowhere."""
    if not needle:
        return F.lit(False)
    if not regex:
        return F.contains(text, F.lit(needle))
    try:
        re.compile(needle)
    except re.error:
        return F.lit(False)
    return F.rlike(text, F.lit(needle))


def search(df: DataFrame, text: str, needle: str, order: str, regex: bool = False, first: int = 50) -> tuple[DataFrame, DataFrame]:
    """The first hits in order (a report of that many rows), and the total."""
    hits = df.filter(matches(F.col(text), needle, regex))
    return hits.orderBy(order).limit(first), hits.agg(F.count(F.lit(1)).alias("total"))


def histogram(df: DataFrame, value: str, width: float = 100, buckets: int = 20) -> DataFrame:
    """bucket and n for every bucket, empty ones too; the last takes all that lies beyond."""
    counted = df.groupBy(F.least(F.lit(buckets - 1), F.floor(F.col(value) / width)).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bar_heights(df: DataFrame, value: str, top: float = 100.0, least: float = 4.0) -> DataFrame:
    """df with `height`: 0 stays 0; others lie on a log scale from 0.7 times the smallest to the largest, at least `least`."""
    ends = df.filter(F.col(value) > 0).agg((F.log10(F.min(value) * 0.7)).alias("lo"), F.log10(F.max(value)).alias("hi")).first()
    if ends["lo"] is None:
        return df.withColumn("height", F.lit(0.0))
    span = (F.log10(F.when(F.col(value) > 0, F.col(value))) - ends["lo"]) / (ends["hi"] - ends["lo"])
    return df.withColumn("height", F.when(F.col(value) > 0, F.greatest(F.lit(least), span * top)).otherwise(F.lit(0.0)))
