"""Scalar expressions as plain values, and their compilation to Columns.

An expression follows dynamic-language rules rather than SQL's: equality is strict and
null equals null, logic is two-valued (only true counts), arithmetic is on doubles with
null as zero and never raises, `+` joins text. What cannot differ from SQL for the
types at hand compiles to the plain SQL operator, so filters still reach the scan.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.errors import PlanError


class Expr:
    """A node of an expression; operators build larger ones."""

    def _cmp(op):  # noqa: N805
        return lambda self, other: Cmp(op, self, wrap(other))

    def _math(op):  # noqa: N805
        return lambda self, other: Math(op, self, wrap(other))

    eq, ne = _cmp("=="), _cmp("!=")
    __lt__, __le__, __gt__, __ge__ = _cmp("<"), _cmp("<="), _cmp(">"), _cmp(">=")
    has = _cmp("has")
    __add__, __sub__, __mul__, __truediv__ = _math("+"), _math("-"), _math("*"), _math("/")

    def __and__(self, other):
        return All((self, wrap(other)))

    def __or__(self, other):
        return AnyOf((self, wrap(other)))

    def __invert__(self):
        return Not(self)


@dataclass(frozen=True)
class Field(Expr):
    path: tuple[str, ...]


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Cmp(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class All(Expr):
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class AnyOf(Expr):
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Not(Expr):
    part: Expr


@dataclass(frozen=True)
class Math(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Some(Expr):
    part: Expr


#: A function from a column getter to a Column: anything Spark can say, without a canonical text.
RowFn = Callable[[Callable[..., Column]], Column]


def field(*path: str) -> Field:
    return Field(tuple(path))


def lit(value: Any) -> Lit:
    return Lit(value)


def param(name: str) -> Param:
    return Param(name)


def some(part: Expr) -> Some:
    return Some(part)


def wrap(x: Any) -> Expr:
    return x if isinstance(x, Expr) else Lit(x)


def children(e: Expr) -> tuple[Expr, ...]:
    match e:
        case Cmp() | Math():
            return e.left, e.right
        case All() | AnyOf():
            return e.parts
        case Not() | Some():
            return (e.part,)
    return ()


def params_of(e: Expr) -> Iterator[str]:
    """Names of the holes, in order, with repeats."""
    if isinstance(e, Param):
        yield e.name
    for c in children(e):
        yield from params_of(c)


def substitute(e: Expr, values: Mapping[str, Any]) -> Expr:
    """The expression with the holes that `values` names filled."""
    match e:
        case Param():
            return Lit(values[e.name]) if e.name in values else e
        case Cmp() | Math():
            return replace(e, left=substitute(e.left, values), right=substitute(e.right, values))
        case All() | AnyOf():
            return replace(e, parts=tuple(substitute(p, values) for p in e.parts))
        case Not() | Some():
            return replace(e, part=substitute(e.part, values))
    return e


def canon(e: Expr | RowFn) -> str | None:
    """One text for each meaning; None if a function is inside."""
    if not isinstance(e, Expr):
        return None
    match e:
        case Field():
            return "f" + json.dumps(list(e.path))
        case Lit():
            return "l" + json.dumps(e.value, default=str)
        case Param():
            return "p" + json.dumps(e.name)
    head = {Cmp: "cmp", Math: "math", All: "and", AnyOf: "or", Not: "not", Some: "some"}[type(e)]
    inside = [canon(c) for c in children(e)]
    return None if None in inside else f"{head}({','.join([getattr(e, 'op', ''), *inside])})"


# Compilation.

NUMBER, STRING, BOOL, NULL, OTHER = "number", "string", "boolean", "null", "other"


def kind_of(t: T.DataType) -> str:
    match t:
        case T.NumericType():
            return NUMBER
        case T.StringType():
            return STRING
        case T.BooleanType():
            return BOOL
        case T.NullType():
            return NULL
    return OTHER


def resolve(schema: T.StructType, path: tuple[str, ...]) -> tuple[Column, T.DataType, bool]:
    """Column, type and nullability of a field path."""
    found, at, nullable = None, schema, False
    for name in path:
        if not isinstance(at, T.StructType) or name not in at.names:
            raise PlanError(f"no field {'.'.join(path)} among {', '.join(schema.names)}")
        step = at[name]
        found = F.col(f"`{name}`") if found is None else found.getField(name)
        at, nullable = step.dataType, nullable or step.nullable
    return found, at, nullable


def text_of(c: Column, t: T.DataType) -> Column:
    """A value as text, the way a script would write it; null is "null"."""
    if isinstance(t, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        c = F.when(whole, F.floor(c).cast("string")).when(F.isnan(c), "NaN").when(F.abs(c) == float("inf"), F.when(c > 0, "Infinity").otherwise("-Infinity")).otherwise(c.cast("string"))
    return F.coalesce(c.cast("string"), F.lit("null"))


def _number(c: Column, t: T.DataType, nullable: bool) -> Column:
    kind = kind_of(t)
    if kind == STRING:
        c = F.when(F.trim(c) == "", F.lit(0.0)).otherwise(F.coalesce(c.try_cast("double"), F.when(c.isNotNull(), F.lit(float("nan")))))
    elif kind == NULL:
        return F.lit(0.0)
    else:
        c = c.cast("double")
    return F.coalesce(c, F.lit(0.0)) if nullable or kind == STRING else c


_ORDER = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def compile_typed(e: Expr | RowFn, schema: T.StructType) -> tuple[Column, T.DataType, bool]:
    """Column, type and whether it may be null."""
    if not isinstance(e, Expr):
        return e(lambda *path: resolve(schema, path)[0]), T.NullType(), True
    match e:
        case Field():
            return resolve(schema, e.path)
        case Lit():
            t = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), type(None): T.NullType()}.get(type(e.value))
            if t is None:
                raise PlanError(f"a literal must be a number, text, boolean or None: {e.value!r}")
            return F.lit(e.value), t, e.value is None
        case Param():
            raise PlanError(f"the hole {e.name} is not filled")
        case Cmp():
            return _compare(e, schema), T.BooleanType(), False
        case All():
            out = F.lit(True)
            for p in e.parts:
                out = out & truthy(p, schema) if p is not e.parts[0] else truthy(p, schema)
            return out, T.BooleanType(), False
        case AnyOf():
            out = F.lit(False)
            for p in e.parts:
                out = out | truthy(p, schema) if p is not e.parts[0] else truthy(p, schema)
            return out, T.BooleanType(), False
        case Not():
            return ~truthy(e.part, schema), T.BooleanType(), False
        case Some():
            c, _, nullable = compile_typed(e.part, schema)
            return c.isNotNull() if nullable else F.lit(True), T.BooleanType(), False
        case Math():
            return _compute(e, schema)
    raise PlanError(f"not an expression: {e!r}")


def compile_expr(e: Expr | RowFn, schema: T.StructType) -> Column:
    return compile_typed(e, schema)[0]


def truthy(e: Expr | RowFn, schema: T.StructType) -> Column:
    """True where the value is exactly true, else false."""
    c, t, nullable = compile_typed(e, schema)
    if isinstance(e, Expr) and kind_of(t) != BOOL:
        return F.lit(False)
    return F.coalesce(c, F.lit(False)) if nullable else c


def _compare(e: Cmp, schema: T.StructType) -> Column:
    (a, ta, na), (b, tb, nb) = compile_typed(e.left, schema), compile_typed(e.right, schema)
    ka, kb = kind_of(ta), kind_of(tb)
    if e.op in ("==", "!="):
        if NULL in (ka, kb):
            same = F.lit(True) if ka == kb else (b if ka == NULL else a).isNull()
        elif ka != kb:
            same = a.isNull() & b.isNull() if na and nb else F.lit(False)
        else:
            same = a.eqNullSafe(b) if na or nb else a == b
            if na != nb and isinstance(e.right if na else e.left, Lit) and e.op == "==":
                same = F.coalesce(a == b, F.lit(False))
        return same if e.op == "==" else ~same
    if e.op == "has":
        return F.contains(text_of(a, ta), text_of(b, tb))
    if e.op not in _ORDER:
        raise PlanError(f"no such comparison: {e.op}")
    order = _ORDER[e.op]
    if ka == kb == STRING:
        both_null = F.lit("=" in e.op)
        return F.coalesce(order(a, b), a.isNull() & b.isNull() & both_null) if na or nb else order(a, b)
    if ka == kb == NUMBER:
        return order(F.coalesce(a, F.lit(0)) if na else a, F.coalesce(b, F.lit(0)) if nb else b)
    x, y = _number(a, ta, na), _number(b, tb, nb)
    return order(x, y) & ~F.isnan(x) & ~F.isnan(y)


def _compute(e: Math, schema: T.StructType) -> tuple[Column, T.DataType, bool]:
    (a, ta, na), (b, tb, nb) = compile_typed(e.left, schema), compile_typed(e.right, schema)
    if e.op == "+" and STRING in (kind_of(ta), kind_of(tb)):
        return F.concat(text_of(a, ta), text_of(b, tb)), T.StringType(), False
    x, y = _number(a, ta, na), _number(b, tb, nb)
    if e.op == "/":
        over = F.when((x == 0) | F.isnan(x), float("nan")).when(x > 0, float("inf")).otherwise(float("-inf"))
        return F.when(y == 0, over).otherwise(F.try_divide(x, y)), T.DoubleType(), False
    if e.op not in ("+", "-", "*"):
        raise PlanError(f"no such operation: {e.op}")
    return {"+": x + y, "-": x - y, "*": x * y}[e.op], T.DoubleType(), False


def condition(e: Expr | RowFn, schema: T.StructType) -> Column:
    """A filter for the rows where e is exactly true, in the plainest form that means so.

    A filter drops null as it drops false, so comparisons of a field with a literal need no
    guard around them and can be pushed to the scan.
    """
    if isinstance(e, All) and e.parts:
        out = condition(e.parts[0], schema)
        for p in e.parts[1:]:
            out = out & condition(p, schema)
        return out
    if isinstance(e, Cmp) and isinstance(e.left, Field) and isinstance(e.right, Lit) and e.right.value is not None and e.op != "has":
        (a, ta, na), value = resolve(schema, e.left.path), e.right.value
        if na and kind_of(ta) == kind_of(compile_typed(e.right, schema)[1]):
            if e.op == "==":
                return a == F.lit(value)
            if e.op == "!=":
                return (a != F.lit(value)) | a.isNull()
            if kind_of(ta) == NUMBER:
                plain = _ORDER[e.op](a, F.lit(value))
                return plain | a.isNull() if _ORDER[e.op](0, value) else plain
            if kind_of(ta) == STRING:
                return _ORDER[e.op](a, F.lit(value))
    return truthy(e, schema)
