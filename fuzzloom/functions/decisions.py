"""Decision functions over a trajectory that is held as an array column: the twins of ``kernel.decided`` for stored states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def last(states: Column, p: Column) -> Column:
    """State p if p > 0, else the last one."""
    return F.try_element_at(states, F.when(p > 0, p + 1).otherwise(F.lit(-1)).cast("int"))


def mean(states: Column, p: Column) -> Column:
    """Mean of states 0 to p if p > 0, else of all; null without states."""
    part = F.slice(states, F.lit(1), F.when(p > 0, F.least(p + 1, F.size(states))).otherwise(F.size(states)).cast("int"))
    return F.try_divide(F.aggregate(part, F.lit(0.0), lambda a, x: a + x), F.size(part))


def exited(states: Column, p: Column) -> Column:
    """Greatest of the states before p, of all if p < 0; null if there is none."""
    return F.array_max(F.slice(states, F.lit(1), F.when(p >= 0, p).otherwise(F.size(states)).cast("int")))


#: The functions by the names that maps use.
DECIDERS: dict[str, Callable[[Column, Column], Column]] = {"LAST": last, "MEAN": mean, "EXITED": exited}
