"""Keyed tables: a DataFrame with the columns that name a row, and the changes between two of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.errors import KeyClash
from keelson.functions.expr import Expr, compile_expr, condition
from keelson.notice import notice

#: Decides between a held row and an incoming one: True where the incoming row wins.
Wins = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class ByRevision:
    """The incoming row wins unless its revision is lower. Among rows of one batch the highest revision is the one that lasts, in any order."""

    name: str

    def __call__(self, held: Column, incoming: Column) -> Column:
        return incoming[self.name] >= held[self.name]


def by_revision(name: str) -> Wins:
    return ByRevision(name)


def _has_map(kind: T.DataType) -> bool:
    match kind:
        case T.MapType():
            return True
        case T.ArrayType():
            return _has_map(kind.elementType)
        case T.StructType():
            return any(_has_map(f.dataType) for f in kind.fields)
    return False


def comparable(c: Column, kind: T.DataType) -> Column:
    """A value that is equal, in the sense of <=>, exactly where c is: maps become their entries in the order of keys."""
    if not _has_map(kind):
        return c
    match kind:
        case T.MapType():
            sorted_ = F.array_sort(F.map_keys(c))
            return F.transform(sorted_, lambda k: F.struct(k.alias("k"), comparable(F.element_at(c, k), kind.valueType).alias("v")))
        case T.ArrayType():
            return F.transform(c, lambda x: comparable(x, kind.elementType))
    return F.when(c.isNotNull(), F.struct(*(comparable(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))


@dataclass(frozen=True)
class Keyed:
    """A table with a declared key. Methods return new tables; nothing is changed in place."""

    df: DataFrame
    key: tuple[str, ...]
    wins: Wins | None = None

    def checked(self) -> Keyed:
        """The table itself, if no two rows share a key (one job)."""
        if met := self.df.groupBy(*self.key).count().filter("count > 1").take(1):
            raise KeyClash(f"several rows have the key {[met[0][k] for k in self.key]}")
        return self

    def _with(self, df: DataFrame) -> Keyed:
        return Keyed(df, self.key, self.wins)

    def _same(self, a: str, b: str) -> Column:
        out = F.lit(True)
        for k in self.key:
            out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
        return out

    def _meet(self, other: DataFrame) -> DataFrame:
        """held and incoming rows side by side, as structs, null where there is none."""
        whole = lambda df, name: df.select(*(F.col(f"`{k}`").alias(f"_{name}_{i}") for i, k in enumerate(self.key)), F.struct(*(F.col(f"`{c}`") for c in self.df.columns)).alias(name))
        on = F.lit(True)
        for i in range(len(self.key)):
            on = on & F.col(f"_held_{i}").eqNullSafe(F.col(f"_incoming_{i}"))
        return whole(self.df, "held").join(whole(other, "incoming"), on, "full_outer").select("held", "incoming")

    def _chosen(self) -> Column:
        held, incoming = F.col("held"), F.col("incoming")
        better = F.lit(True) if self.wins is None else F.coalesce(self.wins(held, incoming), F.lit(False))
        return F.when(incoming.isNull(), held).when(held.isNull() | better, incoming).otherwise(held)

    def netted(self, rows: DataFrame, seq: str | None = None) -> DataFrame:
        """One row for each key: the one that lasts if rows come one after the other in the order of `seq`.

        Rows have no order of their own. Without `seq` the highest revision lasts under `by_revision`; else rows that share a key
        must be equal, and the query fails where they are not.
        """
        columns = [c for c in self.df.columns]
        key, row = [F.col(f"`{k}`") for k in self.key], F.struct(*(F.col(f"`{c}`") for c in columns))
        plain = F.xxhash64(*(F.col(f"`{f.name}`") if not _has_map(f.dataType) else F.to_json(F.struct(comparable(F.col(f"`{f.name}`"), f.dataType).alias("m"))) for f in rows.select(*(f"`{c}`" for c in columns)).schema))
        if isinstance(self.wins, ByRevision):
            order = [F.col(f"`{self.wins.name}`"), F.col(seq) if seq else plain]
            return rows.groupBy(*key).agg(F.max_by(row, F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))).alias("_r")).select("_r.*")
        if seq is None:
            one = rows.withColumn("_h", plain).groupBy(*key).agg(F.first(row).alias("_r"), (F.min("_h") != F.max("_h")).alias("_unlike"))
            clash = F.raise_error(F.concat(F.lit("several rows have the key "), F.to_json(F.struct(*(F.col(f"_r.`{k}`") for k in self.key))), F.lit("; name a column that orders them")))
            return one.select(F.when(F.col("_unlike"), clash).otherwise(F.col("_r")).alias("_r")).select("_r.*")
        if self.wins is None:
            return rows.groupBy(*key).agg(F.max_by(row, F.col(seq)).alias("_r")).select("_r.*")
        ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), row.alias("r"))), lambda x, y: F.when(x["s"] < y["s"], -1).when(x["s"] > y["s"], 1).otherwise(0))
        won = F.aggregate(ordered, F.lit(None).cast(rows.select(row).schema[0].dataType), lambda held, x: F.when(held.isNull() | F.coalesce(self.wins(held, x["r"]), F.lit(False)), x["r"]).otherwise(held))
        return rows.groupBy(*key).agg(won.alias("_r")).select("_r.*")

    def put(self, rows: DataFrame, seq: str | None = None) -> Keyed:
        """Upsert: an incoming row replaces the held one of its key unless the held one wins."""
        return self._with(self._meet(self.netted(rows, seq)).select(self._chosen().alias("r")).select("r.*"))

    def drop(self, keys: DataFrame) -> Keyed:
        """Without the rows that keys names; unknown keys mean nothing."""
        on = F.lit(True)
        gone = keys.select(*(F.col(k).alias(f"_gone_{k}") for k in self.key)).distinct()
        for k in self.key:
            on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"_gone_{k}"))
        return self._with(self.df.join(gone, on, "left_anti"))

    def apply(self, put: DataFrame | None = None, drop: DataFrame | None = None, seq: str | None = None) -> Keyed:
        """One batch: all puts, then all drops."""
        out = self if put is None else self.put(put, seq)
        return out if drop is None else out.drop(drop)

    def replace(self, rows: DataFrame, seq: str | None = None) -> Keyed:
        """A snapshot: it owns which keys there are; `wins` still decides what survivors hold."""
        return self._with(self._meet(self.netted(rows, seq)).filter(F.col("incoming").isNotNull()).select(self._chosen().alias("r")).select("r.*"))

    def row(self, *key) -> DataFrame:
        out = self.df
        for k, v in zip(self.key, key):
            out = out.filter(F.col(f"`{k}`").eqNullSafe(F.lit(v)))
        return out

    def has(self, *key) -> bool:
        return bool(self.row(*key).take(1))

    def size(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("size"))

    def where(self, test: Expr) -> Keyed:
        return self._with(self.df.filter(condition(test, self.df.schema)))

    def count(self, test: Expr | None = None) -> DataFrame:
        c = F.count(F.lit(1)) if test is None else F.count_if(condition(test, self.df.schema))
        return self.df.agg(c.alias("count"))

    def sum_by(self, measure: Expr) -> DataFrame:
        return self.df.agg(F.coalesce(F.sum(compile_expr(measure, self.df.schema)), F.lit(0)).cast("double").alias("sum"))

    def changes_to(self, later: Keyed) -> DataFrame:
        """prev, next for every key whose row differs: an insert has no prev, a delete no next."""
        met = self._meet(later.df)
        kind = met.schema["held"].dataType
        return met.filter(~comparable(F.col("held"), kind).eqNullSafe(comparable(F.col("incoming"), kind))).select(F.col("held").alias("prev"), F.col("incoming").alias("next"))

    def where_live(self, before: Expr, after: Expr) -> DataFrame:
        """What changes in the filtered table when its test changes, as prev, next: only rows that enter or leave."""
        was, now = condition(before, self.df.schema), condition(after, self.df.schema)
        row = F.struct(*(F.col(f"`{c}`") for c in self.df.columns))
        met = self.df.select(F.when(was, row).alias("prev"), F.when(now, row).alias("next"))
        return met.filter(~F.col("prev").eqNullSafe(F.col("next")))


def alike(a: Sequence[str], b: Sequence[str], df: DataFrame | None = None) -> Column:
    """Whether two lists of columns hold equal values, null equal to null; maps need df, whose types then count."""
    held = lambda c: F.col(c) if df is None else comparable(F.col(c), df.select(c).schema[0].dataType)
    out = F.lit(len(a) == len(b))
    for x, y in zip(a, b):
        out = out & held(x).eqNullSafe(held(y))
    return out


def same_items(df: DataFrame, a: str, b: str) -> Column:
    """Whether two list columns hold equal items in the same order; a null list equals only a null list."""
    return alike([a], [b], df)


#: Rows of one join key from which a join counts as crowded.
CROWDED = 10_000


def crowded(df: DataFrame, on: Sequence[str], most: int = CROWDED) -> DataFrame:
    """Join keys with `most` rows or more, with their counts; a notice says so once for each call that finds any."""
    found = df.groupBy(*on).count().filter(F.col("count") >= most)
    if row := found.orderBy(F.desc("count")).limit(1).collect():
        notice("join.crowded", key=[row[0][k] for k in on], rows=row[0]["count"])
    return found
