"""Ordered views, lists, groups and shapes over keyed tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.expr import Cmp, Expr, Lit, compile_expr, condition, field, resolve
from keelson.functions.folds import Fold, Min, Order, compile_fold, order_of

from .keyed import Keyed
from .running import ordered_pass


def has(name: str, value) -> Expr:
    """The test that a field equals a value."""
    return Cmp("==", field(name), Lit(value))


class Ordered:
    """Rows in a total order: the fields given, then the key; numbers compare as numbers."""

    def __init__(self, table: Keyed, *by, where: Expr | None = None):
        self.table, self.by = table if where is None else table.where(where), [order_of(b) for b in by]

    def _sort(self) -> list[Column]:
        fields = [(resolve(self.table.df.schema, o.path)[0], o.down) for o in self.by]
        return [F.desc(c) if falling else F.asc(c) for c, falling in fields] + [F.asc(f"`{k}`") for k in self.table.key]

    def rows(self) -> DataFrame:
        return self.table.df.orderBy(*self._sort())

    def slice(self, start: int, end: int) -> DataFrame:
        """Rows start to end - 1; the plan keeps only the first `end` rows of each task."""
        start, end = max(start, 0), max(end, 0)
        return self.rows().limit(end).offset(start) if end > start else self.table.df.limit(0)

    def placed(self) -> DataFrame:
        """Every row with its place from 0."""
        return self._pass(None, place="place")

    def _pass(self, step: Column | None, **names: str) -> DataFrame:
        fields = [(resolve(self.table.df.schema, o.path)[0], o.down) for o in self.by]
        return ordered_pass(self.table.df, fields, [F.col(f"`{k}`") for k in self.table.key], step, **names)

    def rank(self, *key) -> DataFrame:
        """The place of one key, -1 if it is not there: a count of the rows ahead of it, without sorting them."""
        values = [resolve(self.table.df.schema, o.path)[0] for o in self.by] + [F.col(f"`{k}`") for k in self.table.key]
        falls = [o.down for o in self.by] + [False] * len(self.table.key)
        own = self.table.row(*key).select(*(v.alias(f"m{i}") for i, v in enumerate(values))).first()
        if own is None:
            return self.table.df.limit(0).agg(F.lit(-1).cast("long").alias("rank"))
        ahead = F.lit(False)
        for v, falling, mark in reversed(list(zip(values, falls, own))):
            if mark is None:  # nulls stand first upwards and last downwards
                ahead = v.isNotNull() | ahead if falling else v.isNull() & ahead
            else:
                less = v > F.lit(mark) if falling else v.isNull() | (v < F.lit(mark))
                ahead = F.coalesce(less, F.lit(False)) | (v.eqNullSafe(F.lit(mark)) & ahead)
        return self.table.df.agg(F.count_if(ahead).alias("rank"))


def list_of(table: Keyed, where: Expr | None = None, order=(), window: tuple[int, int] | None = None) -> DataFrame:
    """A filtered, ordered and paged list."""
    view = Ordered(table, *order, where=where)
    return view.rows() if window is None else view.slice(*window)


def lists_by(table: Keyed, name: str, order=(), window: tuple[int, int] | None = None, whole: str | None = None) -> DataFrame:
    """The first rows of the list of every value of a field, with `place` in it; whole: also the list of all rows, under this name, and a column `list` with each list's name."""
    if whole is not None:
        each = lists_by(table, name, order, window).withColumn("list", F.col(f"`{name}`").cast("string"))
        every = Ordered(table, *order).placed()
        if window is not None:
            every = every.filter((F.col("place") >= max(window[0], 0)) & (F.col("place") < window[1]))
        return each.unionByName(every.withColumn("list", F.lit(whole)))
    sort = Ordered(table, *order)._sort()
    out = table.df.withColumn("_n", F.row_number().over(Window.partitionBy(f"`{name}`").orderBy(*sort)))
    if window is not None:  # on the row number itself, so that each task keeps only the first rows of a value
        out = out.filter((F.col("_n") <= window[1]) & (F.col("_n") > max(window[0], 0)))
    return out.withColumn("place", F.col("_n") - 1).drop("_n")


def list_for(table: Keyed, name: str, value, order=(), window: tuple[int, int] | None = None) -> DataFrame:
    """The list of one value, which is matched as text; a value that never occurs has an empty list."""
    chosen = Keyed(table.df.filter(F.col(f"`{name}`").cast("string") == F.lit(str(value))), table.key, table.wins)
    return list_of(chosen, None, order, window)


def by_each(table: Keyed, name: str, folds: Mapping[str, Fold], where: Expr | None = None) -> DataFrame:
    """Folds for every value of one field."""
    df = table.df if where is None else table.df.filter(condition(where, table.df.schema))
    paths = [(k,) for k in table.key]
    return df.groupBy(f"`{name}`").agg(*(compile_fold(f, df.schema, paths).alias(k) for k, f in folds.items()))


def key_of(name: str) -> Fold:
    """The group's own value, as a fold."""
    return Min(field(name))


def fold_all(table: Keyed, folds: Mapping[str, Fold], where: Expr | None = None) -> DataFrame:
    """Folds over a whole table; one row even over nothing."""
    df = table.df if where is None else table.df.filter(condition(where, table.df.schema))
    return df.agg(*(compile_fold(f, df.schema, [(k,) for k in table.key]).alias(k) for k, f in folds.items()))


def shape(**parts: DataFrame) -> dict[str, DataFrame]:
    """Named parts of one answer."""
    return dict(parts)


def offsets(table: Keyed, measure: Expr, *by: Order) -> DataFrame:
    """The line of a table: each row with its place, its measure and the sum ahead of it."""
    size = F.coalesce(compile_expr(measure, table.df.schema).cast("double"), F.lit(0.0))
    return Ordered(table, *by)._pass(size, before="offset", place="place").withColumn("measure", size)


def blocks(df: DataFrame, line: str, at: str, fold: Column, span: int = 32) -> DataFrame:
    """Partial folds of aligned blocks of `span` places on every line."""
    return df.groupBy(line, F.floor(F.col(at) / span).alias("block")).agg(fold.alias("part"))


def range_fold(df: DataFrame, line: str, at: str, start: int, end: int, fold: Column) -> DataFrame:
    """A fold over places start to end, both included, of every line; the filter reaches the scan."""
    return df.filter(F.col(at).between(start, end)).groupBy(line).agg(fold.alias("fold"))
