"""Where a row came from: the rows of the sources behind rows of a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions.folds import key_text

from .compile import Compiler, key_column
from .nodes import Agg, Expand, Filter, Join, Node, Pure, Scan, Source, Union, key_paths


def _keyed(c: Compiler, node: Node) -> DataFrame:
    df = c(node)
    return df.withColumn("_key", key_column(df, node))


def why(node: Node, tables: dict[str, DataFrame], *keys: str | DataFrame) -> DataFrame:
    """source, key: the source rows behind the rows of a plan that key texts name: a few of them, or a DataFrame of one column with any number."""
    c = Compiler(tables)
    if len(keys) == 1 and isinstance(keys[0], DataFrame):
        rows = _matching(c, node, keys[0].toDF("_key"))
    else:
        rows = _keyed(c, node).filter(F.col("_key").isin(*keys)).drop("_key")
    return behind(c, node, rows).distinct()


def behind(c: Compiler, node: Node, rows: DataFrame) -> DataFrame:
    """source, key behind `rows`, which are rows of the compiled node."""
    match node:
        case Source():
            return rows.select(F.lit(node.name).alias("source"), key_column(rows, node).alias("key"))
        case Filter() | Pure() | Scan():
            return behind(c, node.input, _matching(c, node.input, rows.select(key_column(rows, node).alias("_key"))))
        case Join():
            left = _matching(c, node.left, rows.select(key_text(rows.schema, key_paths(node.left)).alias("_key")))
            met = rows.filter(F.col(f"`{node.name}`").isNotNull()).select(F.col(f"`{node.name}`.*"))
            right = _matching(c, node.right, met.select(key_column(met, node.right).alias("_key")))
            return behind(c, node.left, left).unionByName(behind(c, node.right, right))
        case Agg():
            below = c(node.input)
            if not node.by:
                return behind(c, node.input, below)
            groups = rows.select(*(F.col(f"`{b}`").alias(f"_g{i}") for i, b in enumerate(node.by))).distinct()
            same = F.lit(True)
            for i, b in enumerate(node.by):
                same = same & F.col(f"`{b}`").eqNullSafe(F.col(f"_g{i}"))
            return behind(c, node.input, below.join(groups, same, "left_semi"))
        case Union():
            keys = rows.select(key_column(rows, node).alias("_key"))
            return behind(c, node.left, _matching(c, node.left, keys)).unionByName(behind(c, node.right, _matching(c, node.right, keys)))
        case Expand():
            return behind(c, node.input, _matching(c, node.input, rows.select(key_text(rows.schema, key_paths(node.input)).alias("_key"))))
    raise TypeError(node)


def _matching(c: Compiler, node: Node, keys: DataFrame) -> DataFrame:
    return _keyed(c, node).join(keys, "_key", "left_semi").drop("_key")
