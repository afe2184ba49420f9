"""A chain that builds a plan step by step: from_("orders", "id").where(...).groupBy(...)."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession

from keelson.functions import folds as f
from keelson.functions.expr import All, Cmp, Expr, Param, RowFn, field, wrap

from .compile import compile_plan
from .nodes import Agg, Expand, Filter, Join, Node, Pure, Scan, Source, Union

if TYPE_CHECKING:
    from keelson.streaming.live import Live

_holes = itertools.count(1)


class Cell:
    """A value that may change between runs; each use in a plan is a hole of its own."""

    def __init__(self, value: Any):
        self.value = value


class Group:
    """The folds that a group offers; keyword arguments of `groupBy` call on it."""

    count = staticmethod(lambda: f.Count())
    sum = staticmethod(lambda x, exact=None: f.Sum(_expr(x), exact))
    min = staticmethod(lambda x: f.Min(_expr(x)))
    max = staticmethod(lambda x: f.Max(_expr(x)))
    collect = staticmethod(lambda *by: f.Collect(None, tuple(f.order_of(b) for b in by)))
    collect_of = staticmethod(lambda x, *by: f.Collect(_expr(x), tuple(f.order_of(b) for b in by)))


def _expr(x) -> Expr | RowFn:
    return field(x) if isinstance(x, str) else x


class Query:
    """A plan under construction, with the cells wired to its holes."""

    def __init__(self, node: Node, cells: Mapping[str, Cell] | None = None):
        self._node, self._cells = node, dict(cells or {})

    def _next(self, node: Node, *others: Query) -> Query:
        cells = dict(self._cells)
        for o in others:
            cells |= o._cells
        return Query(node, cells)

    def where(self, name: str, op: str, value: Any) -> Query:
        """Rows whose field compares with a value, or with a cell's value at the time of a run."""
        if not isinstance(value, Cell):
            return self._next(Filter(self._node, Cmp(op, field(name), wrap(value))))
        hole = f"p{next(_holes)}"
        out = self._next(Filter(self._node, Cmp(op, field(name), Param(hole))))
        out._cells[hole] = value
        return out

    def filter(self, *tests: Expr | RowFn) -> Query:
        return self._next(Filter(self._node, tests[0] if len(tests) == 1 else All(tests)))

    def with_(self, **fields: Expr | RowFn) -> Query:
        return self._next(Pure(self._node, tuple(fields.items())))

    def pick(self, *names: str) -> Query:
        return self._next(Pure(self._node, (), names))

    def join(self, other: Query, name: str, on: tuple[str, str] | list[tuple[str, str]], residual: Expr | RowFn | None = None, keeping: bool = False) -> Query:
        pairs = tuple(on) if isinstance(on, list) else (on,)
        return self._next(Join(self._node, other._node, name, pairs, residual, keeping), other)

    def groupBy(self, by: str | list[str], **folds: Callable[[type[Group]], f.Fold] | f.Fold) -> Query:  # noqa: N802
        by = (by,) if isinstance(by, str) else tuple(by)
        return self._next(Agg(self._node, by, tuple((k, x(Group) if callable(x) else x) for k, x in folds.items())))

    def fold(self, **folds) -> Query:
        return self.groupBy([], **folds)

    def union(self, other: Query) -> Query:
        return self._next(Union(self._node, other._node), other)

    def expand(self, name: str, as_: str, key: str | tuple[str, ...]) -> Query:
        return self._next(Expand(self._node, name, as_, (key,) if isinstance(key, str) else tuple(key)))

    def scan(self, by, step, as_: str | None = None, through: str | None = None, start: float = 0) -> Query:
        order = tuple(f.order_of(b) for b in (by if isinstance(by, list) else [by]))
        return self._next(Scan(self._node, order, _expr(step), as_, through, start))

    def tree(self) -> Node:
        return self._node

    def values(self) -> dict[str, Any]:
        return {k: c.value for k, c in self._cells.items()}

    def batch(self, tables: Mapping[str, DataFrame], verify: bool = False, **values: Any) -> DataFrame:
        """The answer over tables as they are, holes filled from cells and keyword arguments."""
        return compile_plan(self._node, tables, {**self.values(), **values}, verify)

    def live(self, spark: SparkSession, schemas: Mapping[str, Any], folder: str, **values: Any) -> Live:
        """The answer kept up to date below a folder, over tables that are told of changes; opened again on the folder it goes on."""
        from keelson.streaming.live import Live

        return Live(spark, self._node, schemas, folder, {**self.values(), **values})


def from_(name: str, *key: str) -> Query:
    return Query(Source(name, key))
