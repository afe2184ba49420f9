"""Compilation of a plan to a DataFrame; the result has the plan's fields and nothing else.

Catalyst does the rest: filters stay plain enough to reach the scan, unused fields are
pruned, and joins and aggregations get their strategy from statistics and adaptive execution.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.errors import KeyClash, PlanError
from keelson.functions.expr import compile_expr, compile_typed, condition, field, kind_of, resolve, truthy
from keelson.functions.folds import compile_fold, in_stretches, key_text, partial_fold
from keelson.operators.keyed import crowded
from keelson.operators.running import TWO_PHASES, estimated_bytes, ordered_pass, running_sum

from .check import check
from .nodes import Agg, Expand, Filter, Join, Node, Pure, Scan, Source, Union, fill, key_paths, params


def key_column(df: DataFrame, node: Node) -> Column:
    """The key of each row of a compiled plan, as text."""
    return key_text(df.schema, key_paths(node))


def repeated_keys(df: DataFrame, node: Node) -> DataFrame:
    """Keys that several rows share, with how many."""
    return df.groupBy(key_column(df, node).alias("key")).count().filter("count > 1")


class Compiler:
    """Compiles nodes over named tables. verify: also look for keys that meet where they must not; crowd: a notice for joins with so many right rows of one key (one job each)."""

    def __init__(self, tables: Mapping[str, DataFrame], verify: bool = False, two_phases: bool | None = None, crowd: int | None = None):
        self.tables, self.verify, self.two_phases, self.crowd = tables, verify, two_phases, crowd

    def __call__(self, node: Node) -> DataFrame:
        return getattr(self, type(node).__name__.lower())(node)

    def source(self, n: Source) -> DataFrame:
        if n.name not in self.tables:
            raise PlanError(f"no table {n.name} among {', '.join(sorted(self.tables))}")
        df = self.tables[n.name]
        for k in n.key:
            resolve(df.schema, (k,))
        return df

    def filter(self, n: Filter) -> DataFrame:
        df = self(n.input)
        return df.filter(condition(n.test, df.schema))

    def pure(self, n: Pure) -> DataFrame:
        return shaped(self(n.input), n)

    def join(self, n: Join) -> DataFrame:
        left, right = self(n.left), self(n.right)
        if n.name in left.columns:
            raise PlanError(f"the name {n.name} is a field of the left side already")
        pairs = []
        for a, b in n.on:
            (x, tx, _), (_, ty, _) = resolve(left.schema, (a,)), resolve(right.schema, (b,))
            if kind_of(tx) != kind_of(ty):
                raise PlanError(f"cannot match {a} ({tx.simpleString()}) with {b} ({ty.simpleString()})")
            pairs.append(x == F.col(f"`{n.name}`").getField(b))
        if self.crowd is not None:
            crowded(right, [b for _, b in n.on], self.crowd)
        nested = right.select(F.struct("*").alias(n.name))
        on = pairs[0]
        for p in pairs[1:]:
            on = on & p
        if n.residual is not None:
            on = on & truthy(n.residual, type(left.schema)([*left.schema.fields, *nested.schema.fields]))
        return left.join(nested, on, "left" if n.keeping else "inner")

    def agg(self, n: Agg) -> DataFrame:
        df = self(n.input)
        for b in n.by:
            resolve(df.schema, (b,))
        if in_stretches([f for _, f in n.folds]) and (estimated_bytes(df) > TWO_PHASES if self.two_phases is None else self.two_phases):
            return self._stretched(n, df)
        folds = [compile_fold(f, df.schema, key_paths(n.input)).alias(k) for k, f in n.folds]
        return df.groupBy(*(F.col(f"`{b}`") for b in n.by)).agg(*folds) if n.by else df.agg(*folds)

    def _stretched(self, n: Agg, df: DataFrame) -> DataFrame:
        """Groups in two phases: ranges of (group, key) are folded on their own and joined in order, so that no task gathers a whole group."""
        keys = key_paths(n.input)
        key = key_column(df, n.input)
        by = [F.col(f"`{b}`") for b in n.by]
        folds = {k: partial_fold(f, df.schema, keys, "_stretch") for k, f in n.folds}
        dealt = df.repartitionByRange(*by, key).withColumn("_stretch", F.spark_partition_id())
        parts = dealt.groupBy(*by, "_stretch").agg(*(part.alias(k) for k, (part, _) in folds.items()))
        whole = [merge(F.col(f"`{k}`")).alias(k) for k, (_, merge) in folds.items()]
        return parts.groupBy(*by).agg(*whole) if n.by else parts.agg(*whole)

    def union(self, n: Union) -> DataFrame:
        left, right = self(n.left), self(n.right)
        if self.verify:
            met = left.select(key_column(left, n.left).alias("key")).join(right.select(key_column(right, n.right).alias("key")), "key", "left_semi").take(1)
            if met:
                raise KeyClash(f"both sides of a union have the key {met[0]['key']}")
        return left.unionByName(right, allowMissingColumns=True)

    def expand(self, n: Expand) -> DataFrame:
        df = self(n.input)
        resolve(df.schema, (n.field,))
        rest = [F.col(f"`{c}`") for c in df.columns if c not in (n.field, n.name)]
        out = df.select(*rest, F.explode(F.col(f"`{n.field}`")).alias(n.name))
        if self.verify and (met := repeated_keys(out, n).take(1)):
            raise KeyClash(f"an expansion gives the key {met[0]['key']} twice")
        return out

    def scan(self, n: Scan) -> DataFrame:
        df = self(n.input)
        if n.name is None and n.through is None:
            return df
        return running_sum(df, [(compile_expr(field(*o.path), df.schema), o.down) for o in n.order], key_column(df, n.input), compile_expr(n.step, df.schema), n.name, n.through, n.start)


def shaped(df: DataFrame, n: Pure, among: Column | None = None) -> DataFrame:
    """The computed and chosen fields of a Pure node; every field sees the row as it came."""
    made = {k: compile_typed(e, df.schema)[0] for k, e in n.fields}
    kept = [c for c in df.columns if c not in made]
    names = n.pick if n.pick is not None else [*kept, *made]
    return df.select(*(made[c].alias(c) if c in made else F.col(f"`{c}`") if c in df.columns else F.lit(None).alias(c) for c in names))


def compile_plan(node: Node, tables: Mapping[str, DataFrame], values: Mapping[str, Any] | None = None, verify: bool = False, crowd: int | None = None) -> DataFrame:
    """The whole answer of a plan over tables, with holes filled from values; verify and crowd as in `Compiler`."""
    check(node)
    node = fill(node, values or {})
    if left := params(node):
        raise PlanError(f"holes without a value: {', '.join(left)}")
    return Compiler(tables, verify, crowd=crowd)(node)


class Ordering:
    """The ordered view of a scan: places, offsets and what stands at a point."""

    def __init__(self, scan: Scan, tables: Mapping[str, DataFrame]):
        self.start = scan.start
        df = Compiler(tables)(scan.input)
        df = df.withColumn("_key", key_column(df, scan.input))
        order = [(compile_expr(field(*o.path), df.schema), o.down) for o in scan.order]
        passed = ordered_pass(df, order, [F.col("_key")], compile_expr(scan.step, df.schema), "_ahead", "_upto", "_place", scan.start)
        self.rows = passed.select(F.col("_place").alias("place"), F.col("_key").alias("key"), F.col("_ahead").alias("offset"), F.col("_upto").alias("end"))

    def offset_at(self, place: int) -> DataFrame:
        return self.rows.filter(F.col("place") == place).select("offset")

    def offset_of(self, key: str) -> DataFrame:
        return self.rows.filter(F.col("key") == key).select("offset")

    def key_at(self, place: int) -> DataFrame:
        return self.rows.filter(F.col("place") == place).select("key")

    def place_of(self, key: str) -> DataFrame:
        return self.rows.filter(F.col("key") == key).select("place")

    def at(self, point: float) -> DataFrame:
        """place, key and how far into the row the point lies; before the first row it is the first; no row if empty."""
        reached = F.col("offset") <= point
        last = F.when(reached, F.col("place")).otherwise(F.lit(-1))
        best = self.rows.withColumn("_r", last).filter(reached | (F.col("place") == 0)).orderBy(F.desc("_r")).limit(1)
        return best.select("place", "key", (F.lit(float(point)) - F.col("offset")).alias("into"))

    def extent(self) -> DataFrame:
        """end of the last row (start if there is none) and number of rows."""
        return self.rows.agg(F.coalesce(F.max_by("end", "place"), F.lit(float(self.start))).alias("extent"), F.count(F.lit(1)).alias("size"))
