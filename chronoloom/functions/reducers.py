"""Reducers: how the values of a field in a bucket become one number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first(v: Column, order: Column) -> Column:
    # Rows without the field must not win, so their order is null, which min_by and max_by pass over.
    return F.min_by(v, F.when(v.isNotNull(), order))


def _last(v: Column, order: Column) -> Column:
    return F.max_by(v, F.when(v.isNotNull(), order))


#: Name to (value, order) -> aggregate. ``ma`` has no width of its own and is the average of the bucket.
REDUCERS: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda v, order: F.sum(v),
    "max": lambda v, order: F.max(v),
    "min": lambda v, order: F.min(v),
    "first": _first,
    "last": _last,
    "count": lambda v, order: F.count(v),
    "avg": lambda v, order: F.avg(v),
    "ma": lambda v, order: F.avg(v),
}
