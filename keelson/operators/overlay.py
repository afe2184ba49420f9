"""Lanes of ids, and boards that replay notes over a base."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def lane_drop(lane: Column, ident: Column) -> Column:
    """A lane without an id."""
    return F.array_remove(lane, ident)


def lane_place(lane: Column, ident: Column, at: Column) -> Column:
    """A lane with an id at a place (clamped), wherever it stood before."""
    rest = F.array_remove(lane, ident)
    k = F.least(F.greatest(at, F.lit(0)), F.size(rest))
    return F.concat(F.slice(rest, F.lit(1), k), F.array(ident), F.slice(rest, k + 1, F.greatest(F.size(rest) - k, F.lit(0))))


def lane_append(lane: Column, ident: Column) -> Column:
    return F.concat(F.array_remove(lane, ident), F.array(ident))


def lane_find(lane: Column, ident: Column) -> Column:
    """Place of an id from 0, -1 if it is not there."""
    return F.coalesce(F.array_position(lane, ident) - 1, F.lit(-1)).cast("long")


def lanes_drop(lanes: Column, ident: Column) -> Column:
    """All lanes of a board (lane name to ids) without an id."""
    return F.transform_values(lanes, lambda _, lane: F.array_remove(lane, ident))


def lanes_place(lanes: Column, ident: Column, into: Column, at: Column) -> Column:
    """The id in one lane at a place, wherever it stood before; without such a lane it is only taken out."""
    return F.transform_values(lanes_drop(lanes, ident), lambda name, lane: F.when(name == into, lane_place(lane, ident, at)).otherwise(lane))


def laid(lanes: Column, ids: Column, notes: Column) -> Column:
    """The lanes of a board after its notes, in order.

    lanes: map of lane name to ids; ids: all ids that have a row; notes: array of structs (kind
    place, take or put; id, lane, at, stuck). Stuck notes are passed by, place puts an id
    into a lane, take removes it, put gives it a row; ids without a row vanish at the end.
    """
    empty = F.slice(ids, F.lit(1), F.lit(0))
    zero = F.struct(lanes.alias("lanes"), empty.alias("made"), empty.alias("gone"))

    def step(held: Column, note: Column) -> Column:
        kind, ident = note["kind"], note["id"]
        live = ~F.coalesce(note["stuck"], F.lit(False))
        now = F.when(live & (kind == "place"), lanes_place(held["lanes"], ident, note["lane"], note["at"])).when(live & (kind == "take"), lanes_drop(held["lanes"], ident)).otherwise(held["lanes"])
        made = F.when(live & (kind == "put"), F.array_append(held["made"], ident)).otherwise(held["made"])
        gone = F.when(live & (kind == "take"), F.array_append(held["gone"], ident)).when(live & (kind == "place"), F.array_remove(held["gone"], ident)).otherwise(held["gone"])
        return F.struct(now.alias("lanes"), made.alias("made"), gone.alias("gone"))

    end = F.aggregate(notes, zero, step, lambda held: F.struct(held["lanes"].alias("lanes"), F.array_except(F.array_union(ids, held["made"]), held["gone"]).alias("rows")))
    return F.transform_values(end["lanes"], lambda _, lane: F.filter(lane, lambda x: F.array_contains(end["rows"], x)))


def projected(zero: Column, notes: Column, apply: Mapping[str, Callable[[Column, Column], Column]]) -> Column:
    """A base value after an array of notes (kind, stuck, and what the kinds need), in order; stuck notes and unknown kinds pass by."""

    def step(held: Column, note: Column) -> Column:
        out = held
        for kind, f in apply.items():
            out = F.when(note["kind"] == kind, f(held, note)).otherwise(out)
        return F.when(F.coalesce(note["stuck"], F.lit(False)), held).otherwise(out)

    return F.aggregate(notes, zero, step)
