"""What a change of the sources changes in a plan, node by node.

A change frame has a row for each key that differs: `prev` and `next`, whole rows as structs, null
where there is none. Filters and projections map both sides; a join recomputes the pairs of
touched left rows; an aggregation adds and subtracts what changed where its answer is held and its folds can be undone
exactly, and else recomputes touched groups; an ordered pass moves
everything behind the first touched row, so it is recomputed and compared.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.expr import compile_typed, condition
from keelson.functions.folds import Count, Sum, key_text
from keelson.plans.compile import Compiler, key_column, shaped
from keelson.plans.nodes import Agg, Expand, Filter, Join, Node, Pure, Scan, Source, Union, key_paths, sources


def differing(before: DataFrame, after: DataFrame, node: Node) -> DataFrame:
    """prev, next for all keys whose rows differ between two states of a node."""
    side = lambda df, name: df.select(key_column(df, node).alias(f"_{name}"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name))
    met = side(before, "prev").join(side(after.select(*(f"`{c}`" for c in before.columns)), "next"), F.col("_prev") == F.col("_next"), "full_outer")
    return met.filter(~F.col("prev").eqNullSafe(F.col("next"))).select("prev", "next")


def netted(changes: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """One change for each key: the earliest prev and the latest next, dropped if they are equal."""
    keys = [F.coalesce(F.col(f"next.{k}"), F.col(f"prev.{k}")).alias(f"_k{i}") for i, k in enumerate(key)]
    held = changes.select(*keys, seq, F.struct("prev").alias("p"), F.struct("next").alias("n"))
    out = held.groupBy(*(f"_k{i}" for i in range(len(key)))).agg(F.min_by("p", seq).alias("p"), F.max_by("n", seq).alias("n"))
    return out.select("p.prev", "n.next").filter(~F.col("prev").eqNullSafe(F.col("next")))


def sides(change: DataFrame, *fields: str) -> DataFrame:
    """The given fields of both sides of a change, each combination once."""
    pick = lambda side: change.filter(F.col(side).isNotNull()).select(*(F.col(f"{side}.`{f}`") for f in fields))
    return pick("prev").union(pick("next")).distinct()


def _semi(df: DataFrame, keys: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    keys = keys.toDF(*(f"_s{i}" for i in range(len(keys.columns))))
    same: Column = F.lit(True)
    for i, (name, _) in enumerate(on):
        same = same & F.col(f"`{name}`").eqNullSafe(F.col(f"_s{i}"))
    return df.join(keys, same, "left_semi")


class Delta:
    """Derives the change of any node from the old and new tables and the changes of the sources."""

    def __init__(self, old: Mapping[str, DataFrame], new: Mapping[str, DataFrame], changes: Mapping[str, DataFrame], held: Mapping[Node, DataFrame] | None = None):
        """held: nodes whose old answer is kept as a table."""
        self.old, self.new, self.changes, self.held = Compiler(old), Compiler(new), changes, held or {}

    def __call__(self, node: Node) -> DataFrame | None:
        """prev, next of the node; None if nothing below it changed."""
        if not sources(node) & set(self.changes):
            return None
        match node:
            case Source():
                return self.changes[node.name]
            case Filter() | Pure():
                return self._mapped(node, self(node.input))
            case Join():
                return self._join(node)
            case Agg():
                return self._agg(node)
            case Union():
                left, right = self(node.left), self(node.right)
                return right if left is None else left if right is None else left.unionByName(right)
            case Expand():
                return self._expand(node)
            case Scan():
                return differing(self.old(node), self.new(node), node)
        raise TypeError(node)

    def _mapped(self, node: Filter | Pure, change: DataFrame) -> DataFrame:
        # Both sides are judged as rows of their own and met again by key, which stays the same through either node.
        parts = []
        for side in ("prev", "next"):
            rows = change.filter(F.col(side).isNotNull()).select(f"{side}.*")
            parts.append(rows.filter(condition(node.test, rows.schema)) if isinstance(node, Filter) else shaped(rows, node))
        return differing(parts[0], parts[1], node)

    def _join(self, n: Join) -> DataFrame:
        lefts, rights = self(n.left), self(n.right)
        paths = key_paths(n.left)
        touched = None
        if lefts is not None:
            touched = self._keys(lefts, n.left)
        if rights is not None:
            on = sides(rights, *(b for _, b in n.on)).dropna()
            for c in (self.old, self.new):
                rows = _semi(c(n.left), on, n.on)
                keys = rows.select(key_text(rows.schema, paths).alias("_key"))
                touched = keys if touched is None else touched.union(keys)
        touched = touched.distinct()
        before, after = (self._over(c, n, touched) for c in (self.old, self.new))
        return differing(before, after, n)

    def _keys(self, change: DataFrame, node: Node) -> DataFrame:
        out = []
        for side in ("prev", "next"):
            rows = change.filter(F.col(side).isNotNull()).select(f"{side}.*")
            out.append(rows.select(key_column(rows, node).alias("_key")))
        return out[0].union(out[1]).distinct()

    def _over(self, c: Compiler, n: Join, touched: DataFrame) -> DataFrame:
        """The join over the touched left rows alone."""
        left = c(n.left)
        left = left.withColumn("_key", key_column(left, n.left)).join(touched, "_key", "left_semi").drop("_key")
        inner = Compiler({**c.tables, "\0left": left})
        return inner(Join(Source("\0left", tuple(p[0] for p in key_paths(n.left))), n.right, n.name, n.on, n.residual, n.keeping))

    def _agg(self, n: Agg) -> DataFrame:
        change = self(n.input)
        if n in self.held and undoable(n, change.schema["next"].dataType):
            return self._added(n, change)
        out = []
        for c in (self.old, self.new):
            rows = c(n.input)
            if n.by:
                rows = _semi(rows, sides(change, *n.by), [(b, b) for b in n.by])
            inner = Compiler({"\0rows": rows})
            out.append(inner(Agg(_renamed(n.input, "\0rows"), n.by, n.folds)))
        return differing(out[0], out[1], n)

    def _added(self, n: Agg, change: DataFrame) -> DataFrame:
        """Counts and sums of what came, less those of what went, on top of the held rows: no group is read again."""
        parts = []
        for side, sign in (("next", 1), ("prev", -1)):
            rows = change.filter(F.col(side).isNotNull()).select(f"{side}.*")
            one = Compiler({"\0rows": rows})(Agg(_renamed(n.input, "\0rows"), n.by, n.folds))
            parts.append(one.select(*(F.col(f"`{b}`").alias(f"_g{i}") for i, b in enumerate(n.by)), *((F.col(f"`{k}`") * sign).alias(f"_d{i}") for i, (k, _) in enumerate(n.folds))))
        moved = parts[0].unionByName(parts[1]).groupBy(*(f"_g{i}" for i in range(len(n.by)))).agg(*(F.sum(f"_d{i}").alias(f"_d{i}") for i in range(len(n.folds))))
        held = self.held[n]
        same = F.lit(True)
        for i, b in enumerate(n.by):
            same = same & F.col(f"`{b}`").eqNullSafe(F.col(f"_g{i}"))
        row = F.struct(*(F.col(f"`{c}`") for c in held.columns))
        met = moved.join(held.select(*(F.col(f"`{c}`") for c in held.columns), row.alias("_held")), same, "left")
        kinds = {f.name: f.dataType for f in held.schema}
        fresh = {b: F.col(f"_g{i}") for i, b in enumerate(n.by)} | {k: F.coalesce(F.col(f"`{k}`"), F.lit(0)) + F.col(f"_d{i}") for i, (k, _) in enumerate(n.folds)}
        now = F.struct(*(fresh[c].cast(kinds[c]).alias(c) for c in held.columns))
        count = next(k for k, f in n.folds if isinstance(f, Count))
        left = F.lit(True) if not n.by else fresh[count] > 0
        return met.select(F.col("_held").alias("prev"), F.when(left, now).alias("next")).filter(~F.col("prev").eqNullSafe(F.col("next")))

    def _expand(self, n: Expand) -> DataFrame:
        change = self(n.input)
        parts = []
        for side in ("prev", "next"):
            rows = change.filter(F.col(side).isNotNull()).select(f"{side}.*")
            parts.append(Compiler({"\0rows": rows})(Expand(_renamed(n.input, "\0rows"), n.field, n.name, n.key)))
        return differing(parts[0], parts[1], n)


def undoable(n: Agg, rows: T.StructType) -> bool:
    """Whether the folds of an aggregation can be added to and taken from without a trace: a count, which tells when a group is gone, and sums of whole numbers, which doubles hold exactly."""
    whole = lambda f: isinstance(f, Sum) and isinstance(compile_typed(f.of, rows)[1], (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    return any(isinstance(f, Count) for _, f in n.folds) and all(isinstance(f, Count) or whole(f) for _, f in n.folds)


def _renamed(node: Node, name: str) -> Source:
    return Source(name, tuple(p[0] for p in key_paths(node)))
