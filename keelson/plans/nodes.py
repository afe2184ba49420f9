"""The eight relational nodes. A plan is a value: it can be compared, printed and sent."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

from keelson.functions.expr import Expr, RowFn, params_of, substitute
from keelson.functions.folds import Collect, Fold, Max, Min, Order, Sum


@dataclass(frozen=True)
class Source:
    name: str
    key: tuple[str, ...]


@dataclass(frozen=True)
class Filter:
    input: Node
    test: Expr | RowFn


@dataclass(frozen=True)
class Pure:
    """Computed fields, each seeing the row as it came, then a choice of fields."""

    input: Node
    fields: tuple[tuple[str, Expr | RowFn], ...] = ()
    pick: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Join:
    """Equality on pairs of fields, and `residual` over the merged row; the right row nests as `name`. keeping: left rows without a match stay, with null there."""

    left: Node
    right: Node
    name: str
    on: tuple[tuple[str, str], ...]
    residual: Expr | RowFn | None = None
    keeping: bool = False


@dataclass(frozen=True)
class Agg:
    input: Node
    by: tuple[str, ...]
    folds: tuple[tuple[str, Fold], ...]


@dataclass(frozen=True)
class Union:
    """Both inputs, whose keys must not meet."""

    left: Node
    right: Node


@dataclass(frozen=True)
class Expand:
    """A row for each entry of a nested list, which gives way to the entry as `name`."""

    input: Node
    field: str
    name: str
    key: tuple[str, ...]


@dataclass(frozen=True)
class Scan:
    """A pass in order: `name` is the sum of `step` ahead of the row, `through` with the row, both from `start`."""

    input: Node
    order: tuple[Order, ...]
    step: Expr | RowFn
    name: str | None = None
    through: str | None = None
    start: float = 0


Node = Source | Filter | Pure | Join | Agg | Union | Expand | Scan


def inputs(node: Node) -> tuple[Node, ...]:
    if isinstance(node, (Join, Union)):
        return node.left, node.right
    return () if isinstance(node, Source) else (node.input,)


def sources(node: Node) -> set[str]:
    """Names of the source tables below a node."""
    return {node.name} if isinstance(node, Source) else set().union(*(sources(n) for n in inputs(node)))


def _exprs(node: Node) -> Iterator[Expr]:
    match node:
        case Filter():
            found = [node.test]
        case Pure():
            found = [e for _, e in node.fields]
        case Join():
            found = [node.residual]
        case Scan():
            found = [node.step]
        case Agg():
            found = [getattr(f, "of", None) for _, f in node.folds]
        case _:
            found = []
    return (e for e in found if isinstance(e, Expr))


def params(node: Node) -> list[str]:
    """Names of all holes of a plan, each once."""
    below = [p for n in inputs(node) for p in params(n)]
    return list(dict.fromkeys([*below, *(p for e in _exprs(node) for p in params_of(e))]))


def fill(node: Node, values: Mapping[str, Any]) -> Node:
    """The plan with the holes that `values` names filled."""
    sub = lambda e: substitute(e, values) if isinstance(e, Expr) else e
    node = replace(node, **{f.name: fill(v, values) for f in fields(node) if isinstance(v := getattr(node, f.name), Node)})
    match node:
        case Filter():
            return replace(node, test=sub(node.test))
        case Pure():
            return replace(node, fields=tuple((k, sub(e)) for k, e in node.fields))
        case Join():
            return replace(node, residual=sub(node.residual))
        case Scan():
            return replace(node, step=sub(node.step))
        case Agg():
            fold = lambda f: replace(f, of=sub(f.of)) if isinstance(f, (Sum, Min, Max, Collect)) else f
            return replace(node, folds=tuple((k, fold(f)) for k, f in node.folds))
    return node


def key_paths(node: Node) -> list[tuple[str, ...]]:
    """The fields that name a row of a plan."""
    match node:
        case Source():
            return [(k,) for k in node.key]
        case Filter() | Pure() | Scan():
            return key_paths(node.input)
        case Join():
            return key_paths(node.left) + [(node.name, *p) for p in key_paths(node.right)]
        case Agg():
            return [(b,) for b in node.by]
        case Union():
            return key_paths(node.left)
        case Expand():
            return key_paths(node.input) + [(node.name, k) for k in node.key]
    raise TypeError(node)
