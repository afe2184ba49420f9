"""Folds of a group: count, sum, min, max, collect and custom ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expr import Expr, Field, compile_typed, field, kind_of, text_of


@dataclass(frozen=True)
class Order:
    """A field to order by, upwards unless `down`; nulls come first upwards and last downwards."""

    path: tuple[str, ...]
    down: bool = False


def up(*path: str) -> Order:
    return Order(tuple(path))


def down(*path: str) -> Order:
    return Order(tuple(path), True)


def order_of(x) -> Order:
    return x if isinstance(x, Order) else Order(x if isinstance(x, tuple) else (x,))


@dataclass(frozen=True)
class Count:
    pass


@dataclass(frozen=True)
class Sum:
    """exact: a decimal type to add in, so that the order of rows cannot show in the last digits."""

    of: Expr
    exact: str | None = None


@dataclass(frozen=True)
class Min:
    of: Expr


@dataclass(frozen=True)
class Max:
    of: Expr


@dataclass(frozen=True)
class Collect:
    """Values (whole rows without `of`) ordered by `by`, then by the key as text."""

    of: Expr | None = None
    by: tuple[Order, ...] = ()


@dataclass(frozen=True)
class Custom:
    """A left fold in the order of the key as text: add(held, row) gives the next held.

    join(a, b) makes one answer of the answers over two neighbouring stretches and must be
    associative; with it a large group is folded stretch by stretch in many tasks.
    """

    zero: Column
    add: Callable[[Column, Column], Column]
    sub: Callable[[Column, Column], Column] | None = None
    join: Callable[[Column, Column], Column] | None = None


Fold = Count | Sum | Min | Max | Collect | Custom


def invertible(fold: Fold) -> bool:
    return isinstance(fold, (Count, Sum)) or isinstance(fold, Custom) and fold.sub is not None


def key_text(schema: T.StructType, paths: list[tuple[str, ...]]) -> Column:
    """A row's key as text: the value itself for one path, a JSON list for several, "[]" for none."""
    if not paths:
        return F.lit("[]")
    parts = [compile_typed(field(*p), schema) for p in paths]
    if len(parts) == 1:
        return text_of(*parts[0][:2])
    quoted = lambda c, t: F.when(c.isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")) if kind_of(t) == "string" else text_of(c, t)
    return F.concat(F.lit("["), F.concat_ws(",", *(quoted(c, t) for c, t, _ in parts)), F.lit("]"))


def _comparator(order: list[tuple[str, bool]]):
    def compare(x: Column, y: Column) -> Column:
        out = F.lit(0)
        for name, falling in reversed(order):
            a, b = x[name], y[name]
            less, more = (1, -1) if falling else (-1, 1)
            out = F.when(a.eqNullSafe(b), out).when(a.isNull() | (a < b), less).otherwise(more)
        return out

    return compare


def compile_fold(fold: Fold, schema: T.StructType, keys: list[tuple[str, ...]]) -> Column:
    match fold:
        case Count():
            return F.count(F.lit(1))
        case Sum():
            c, t, _ = compile_typed(fold.of, schema)
            # In doubles, as longs could overflow; other types that count as numbers stay decimals.
            c = c.cast(fold.exact) if fold.exact else c if isinstance(t, T.DecimalType) else c.cast("double")
            return F.coalesce(F.sum(c), F.lit(0)).cast("double")
        case Min():
            return F.min(compile_typed(fold.of, schema)[0])
        case Max():
            return F.max(compile_typed(fold.of, schema)[0])
    row = F.struct(*(F.col(f"`{n}`") for n in schema.names))
    if isinstance(fold, Custom):
        # By the key alone: the row may hold a map, which has no order.
        rows = F.array_sort(F.collect_list(F.struct(key_text(schema, keys).alias("k"), row.alias("v"))), _comparator([("k", False)]))
        return F.aggregate(rows, fold.zero, lambda held, x: fold.add(held, x["v"]))
    order = [(f"o{i}", o.down) for i, o in enumerate(fold.by)]
    fields = [compile_typed(Field(o.path), schema)[0].alias(f"o{i}") for i, o in enumerate(fold.by)]
    value = row if fold.of is None else compile_typed(fold.of, schema)[0]
    listed = F.collect_list(F.struct(*fields, key_text(schema, keys).alias("k"), value.alias("v")))
    plain = not any(o.down for o in fold.by) and isinstance(value_type(fold, schema), T.AtomicType)
    return F.transform(F.array_sort(listed) if plain else F.array_sort(listed, _comparator([*order, ("k", False)])), lambda x: x["v"])


def value_type(fold: Collect, schema: T.StructType) -> T.DataType:
    return schema if fold.of is None else compile_typed(fold.of, schema)[1]


def partial_fold(fold: Fold, schema: T.StructType, keys: list[tuple[str, ...]], stretch: str) -> tuple[Column, Callable[[Column], Column]]:
    """A fold in two phases: its column over one stretch of a group, and what makes the answer of such columns.

    Stretches follow each other in the order of the key as text and of the column `stretch`.
    """
    whole = compile_fold(fold, schema, keys)
    match fold:
        case Count() | Sum():
            return whole, lambda part: F.coalesce(F.sum(part), F.lit(0)).cast("long" if isinstance(fold, Count) else "double")
        case Min():
            return whole, F.min
        case Max():
            return whole, F.max
        case Custom(join=join) if join is not None:
            parts = lambda part: F.transform(F.array_sort(F.collect_list(F.struct(F.col(stretch).alias("at"), part.alias("v")))), lambda x: x["v"])
            joined = lambda p: F.when(F.size(p) == 0, fold.zero).otherwise(F.aggregate(F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), F.get(p, F.lit(0)), join))
            return whole, lambda part: joined(parts(part))
    raise ValueError(f"{type(fold).__name__} needs all rows of a group at once")


def in_stretches(folds: list[Fold]) -> bool:
    """Whether some fold gathers the rows of a group and all can be worked out stretch by stretch."""
    gathers = [isinstance(f, (Collect, Custom)) for f in folds]
    return any(gathers) and all(isinstance(f, Custom) and f.join is not None for f, g in zip(folds, gathers) if g)
