"""Values that stand in an expression more than once, and medians of arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value made once, however often it stands there."""
    return F.transform(F.array(value), body)[0]


def median(values: Column) -> Column:
    """Of the values that aren't null, between the middle two; null of none."""
    return bound(F.sort_array(F.filter(values, lambda v: v.isNotNull())), lambda v: F.get(v, F.shiftright(F.size(v) - 1, 1)) * 0.5 + F.get(v, F.shiftright(F.size(v), 1)) * 0.5)
