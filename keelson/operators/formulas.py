"""Sheet formulas: range folds and functions over cells, in exact decimals."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Functions of the language and its errors.
FOLDS = ("SUM", "PROD", "AVG", "MIN", "MAX", "COUNT")
SCALARS = {"ABS": (1,), "SQRT": (1,), "INT": (1,), "SIGN": (1,), "MOD": (2,), "POW": (2,), "ROUND": (1, 2)}
SYNTAX, REF, NAME, DIV, VALUE, NUM = "#SYNTAX!", "#REF!", "#NAME?", "#DIV/0!", "#VALUE!", "#NUM!"
# End of fixed values.

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|([A-Za-z]+\d+)|([A-Za-z]+)|(.))")


class FormulaError(ValueError):
    """The formula cannot be read; its text is the sheet's error."""


def number(c: Column) -> Column:
    """A cell's text as a number; blanks and other text count as 0."""
    return F.coalesce(F.trim(c).try_cast("double"), F.lit(0.0))


def range_folds(cells: DataFrame, text: str = "text") -> DataFrame:
    """All folds over the cells given. AVG divides by the number of cells; COUNT counts numbers only."""
    x, n = number(F.col(text)), F.count(F.lit(1))
    return cells.agg(
        F.coalesce(F.sum(x), F.lit(0.0)).alias("SUM"), F.coalesce(F.product(x), F.lit(1.0)).alias("PROD"), F.when(n > 0, F.coalesce(F.sum(x), F.lit(0.0)) / F.greatest(n, F.lit(1))).alias("AVG"),
        F.coalesce(F.min(x), F.lit(0.0)).alias("MIN"), F.coalesce(F.max(x), F.lit(0.0)).alias("MAX"), F.count_if(F.trim(F.col(text)).try_cast("double").isNotNull()).alias("COUNT"),
    )


def scalar(name: str, *args: Column) -> Column:
    """A function of the language over Columns; null where it has no value (a root of a negative, MOD by zero)."""
    x = args[0].cast("double")
    match name:
        case "ABS":
            return F.abs(x)
        case "SQRT":
            return F.when(x >= 0, F.sqrt(x))
        case "INT":
            return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")
        case "SIGN":
            return F.signum(x)
        case "MOD":
            y = args[1].cast("double")
            return F.when(y != 0, x - y * F.when(x / F.nullif(y, F.lit(0.0)) < 0, F.ceil(x / F.nullif(y, F.lit(0.0)))).otherwise(F.floor(x / F.nullif(y, F.lit(0.0)))))
        case "POW":
            return F.pow(x, args[1].cast("double"))
        case "ROUND":
            return _round(x, F.lit(0) if len(args) < 2 else args[1])
    raise FormulaError(NAME)


def _round(x: Column, places: Column) -> Column:
    """Half to even, at most six places."""
    d, out = x.cast("decimal(28,9)"), F.lit(None).cast("double")
    for k in range(7):
        out = F.when(F.least(F.greatest(places.cast("int"), F.lit(0)), F.lit(6)) == k, F.bround(d, k).cast("double")).otherwise(out)
    return out


@dataclass(frozen=True)
class Term:
    """A parsed formula: ("num", x), ("ref", name), ("range", a, b), ("call", name, args) or (operator, args)."""

    head: str
    args: tuple = ()


def parse(text: str) -> Term:
    """Read a formula by precedence: + -, then * /, then ^ (to the right), then signs, so that -2^2 is 4. Names and references may be in lower case."""
    tokens = [(m.lastindex, m.group(m.lastindex).upper()) for m in _TOKEN.finditer(text.strip())]
    at = 0

    def peek():
        return tokens[at][1] if at < len(tokens) else None

    def take(want=None):
        nonlocal at
        if at >= len(tokens) or want is not None and tokens[at][1] != want:
            raise FormulaError(SYNTAX)
        at += 1
        return tokens[at - 1]

    def chain(below, ops):
        out = below()
        while peek() in ops:
            op = take()[1]
            out = Term(op, (out, below()))
        return out

    def total():
        return chain(product, ("+", "-"))

    def product():
        return chain(power, ("*", "/"))

    def power():
        base = signed()
        if peek() == "^":
            take()
            return Term("^", (base, power()))
        return base

    def signed():
        if peek() in ("-", "+"):
            op = take()[1]
            return Term("neg", (signed(),)) if op == "-" else signed()
        return atom()

    def argument():
        out = total()
        if peek() == ":":
            take()
            kind, end = take()
            if out.head != "ref" or kind != 2:
                raise FormulaError(REF)
            return Term("range", (out.args[0], end))
        return out

    def atom():
        kind, value = take()
        if kind == 1:
            return Term("num", (float(value),))
        if kind == 2:
            return Term("ref", (value,))
        if kind == 3:
            if value not in FOLDS and value not in SCALARS:
                raise FormulaError(NAME)
            take("(")
            args = [] if peek() == ")" else [argument()]
            while args and peek() == ",":
                take()
                args.append(argument())
            take(")")
            if value in SCALARS and len(args) not in SCALARS[value]:
                raise FormulaError(VALUE)
            return Term("call", (value, tuple(args)))
        if value == "(":
            out = total()
            take(")")
            return out
        raise FormulaError(SYNTAX)

    out = total()
    if at < len(tokens):
        raise FormulaError(SYNTAX)
    return out


def place(ref: str) -> tuple[int, str]:
    """Row number (from 1) and column letters of a reference."""
    letters = ref.rstrip("0123456789")
    return int(ref[len(letters) :]), letters


def _letters(a: str, b: str) -> list[str]:
    index = lambda s: sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(s)))

    def name(n):
        out = ""
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(65 + r) + out
        return out

    lo, hi = sorted((index(a), index(b)))
    return [name(k) for k in range(lo, hi + 1)]


def compile_row(formula: Term | str, columns: list[str]) -> Column:
    """A formula whose references name columns of one row (A1 means column A), as a Column; null where it divides by zero."""
    t = parse(formula) if isinstance(formula, str) else formula
    sub = lambda x: compile_row(x, columns)
    match t.head:
        case "num":
            return F.lit(t.args[0])
        case "ref":
            name = place(t.args[0])[1]
            if name not in columns:
                raise FormulaError(REF)
            return number(F.col(name).cast("string"))
        case "neg":
            return -sub(t.args[0])
        case "^":
            return F.pow(sub(t.args[0]), sub(t.args[1]))
        case "call":
            name, args = t.args
            if name in SCALARS:
                return scalar(name, *(sub(a) for a in args))
            values = []
            for a in args:
                values += [F.col(c).cast("string") for c in _letters(*(place(r)[1] for r in a.args))] if a.head == "range" else [sub(a).cast("string")]
            if not values:  # over nothing
                return F.lit({"PROD": 1.0, "AVG": None}.get(name, 0.0)).cast("double")
            x = F.array(*(number(v) for v in values))
            add = F.aggregate(x, F.lit(0.0), lambda h, v: h + v)
            return {
                "SUM": add, "PROD": F.aggregate(x, F.lit(1.0), lambda h, v: h * v), "AVG": add / len(values), "MIN": F.array_min(x), "MAX": F.array_max(x),
                "COUNT": F.size(F.filter(F.array(*(v.try_cast("double") for v in values)), lambda v: v.isNotNull())).cast("double"),
            }[name]
        case "range":
            raise FormulaError(VALUE)
    a, b = sub(t.args[0]), sub(t.args[1])
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.when(b != 0, F.try_divide(a, b))}[t.head]()
