"""Sharding by proportional stratified interleaving, in DataFrame functions alone.

Rows are shuffled within each source by a seeded hash; a row's fractional rank is
(rank + 1/2) / rows of its source. All rows sorted by fractional rank form one sequence in
which every stretch has the sources in their overall proportions, and cutting it into
equal stretches gives shards that match the mixture and whose counts differ by at most one.

Both ranks are taken in two steps: hash ranges (or ranges of fractions) are counted,
a running sum over the counts gives where each range begins, and only rows within a
range are sorted together. A source that holds a third of all rows is therefore spread over all
ranges. At most MOST_RANGES ranges of each source are counted.

Defined results: a null source is a source of its own; a null text has no bytes; null ids
and repeated rows are rows like others (equal rows are interchangeable); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows in a range, about, and the most ranges.
RANGE, MOST_RANGES = 2048, 65536


def _numbered(df: DataFrame, within: list[str], bucket: str, order: list, name: str, total: str) -> DataFrame:
    """df with `name`, the place of each row within its `within` (from 0) by bucket and then `order`, and `total`, the rows there."""
    counts = df.groupBy(*within, bucket).agg(F.count(F.lit(1)).alias("_n"))
    ordered = Window.partitionBy(*within).orderBy(bucket)
    begins = counts.select(
        *(F.col(c).alias(f"_{c}") for c in (*within, bucket)),
        F.coalesce(F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*within)).alias(total),
    )
    same: Column = F.col(bucket).eqNullSafe(F.col(f"_{bucket}"))
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = df.join(begins, same)
    place = F.row_number().over(Window.partitionBy(*within, bucket).orderBy(*order)) - 1 + F.col("_before")
    return met.withColumn(name, place).drop("_before", *(f"_{c}" for c in (*within, bucket)))


def interleave(docs: DataFrame, shards: int = 16, seed: int = 11, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size (bytes and one), text_crc32, shard and slot (place in the shard) of every row."""
    bytes_ = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), (F.octet_length(bytes_) + 1).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"))
    base = cut(narrow.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32")))
    rows = base.count()
    ranges = min(MOST_RANGES, max(1, -(-rows // RANGE)))
    by_hash = F.shiftright((F.shiftright("h", 33) + (1 << 30)) * ranges, 31)
    ranked = _numbered(base.withColumn("b", by_hash), ["source"], "b", ["h", "doc_id", "text_crc32", "size"], "r", "of").drop("b")
    ranked = ranked.withColumn("f", (F.col("r") + 0.5) / F.col("of"))
    placed = _numbered(ranked.withColumn("b", F.floor(F.col("f") * ranges)), [], "b", ["f", F.xxhash64("source"), "source", "r"], "g", "all_rows")
    shard = F.expr(f"g * {shards} div all_rows")
    return placed.select("doc_id", "source", "size", "text_crc32", shard.cast("int").alias("shard"), "g", "all_rows").select(
        "doc_id", "source", "size", "text_crc32", "shard", F.expr(f"g - (shard * all_rows + {shards - 1}) div {shards}").alias("slot")
    )
