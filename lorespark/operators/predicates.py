"""Row conditions shared by the catalogue operations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_types(type_1: Column, type_2: Column, wanted: list[str], match: str) -> Column:
    """Membership of the wanted types: all of them, any of them, or exactly them."""
    wanted = list(dict.fromkeys(wanted))
    present = F.array_compact(F.array(type_1, type_2))
    if match == "any":
        return F.arrays_overlap(present, F.array(*[F.lit(value) for value in wanted]))
    condition = F.lit(True)
    for value in wanted:
        condition = condition & F.array_contains(present, value)
    if match == "exact":
        condition = condition & (F.size(present) == len(wanted))
    return condition


def has_component(cell: Column, value: str | Column, separator: str = " ; ") -> Column:
    """One component of a separated cell equals the value; a null cell never matches."""
    return F.array_contains(F.split(cell, separator, -1), value)


def has_stage(cell: Column, label: str | Column) -> Column:
    """The cell is the label, alone or followed by a detail."""
    return F.get(F.split(cell, " ·", 2), F.lit(0)) == label


def within(column: Column, low: int | None, high: int | None) -> Column:
    """Inclusive bounds; an unknown value never satisfies a bound."""
    condition = F.lit(True)
    if low is not None:
        condition = condition & (column >= low)
    if high is not None:
        condition = condition & (column <= high)
    return condition


def flag(column: Column) -> Column:
    """Text flag of the source as an integer."""
    return column.try_cast("int")
