"""A query specification as one DataFrame plan: prune, filter, one partial and one final aggregation."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.buckets import bucket_start
from chronoloom.functions.reducers import REDUCERS
from chronoloom.plans.spec import EPOCH, QuerySpec

MISSING = 0.0


def from_map(field: str) -> Column:
    return F.try_element_at("value", F.lit(field))


def in_range(ts: Column, start_us: int | None, end_us: int | None) -> Column | None:
    """Half-open range on the raw column, against literals, so that it reaches the Parquet scan."""
    literal = lambda us: F.lit(EPOCH + dt.timedelta(microseconds=us)).cast("timestamp_ntz")
    tests = [ts >= literal(start_us)] if start_us is not None else []
    tests += [ts < literal(end_us)] if end_us is not None else []
    return None if not tests else tests[0] if len(tests) == 1 else tests[0] & tests[1]


def run_query(points: DataFrame, spec: QuerySpec, *, index: str = "index_name", ts: str = "ts", order: Column | None = None, value: Callable[[str], Column] = from_map, sort: bool = True) -> DataFrame:
    """index_name, bucket_start and a column per requested field, ascending.

    points hold one row per standing point: a series, a timestamp without zone, and values (a map, or as ``value`` says).
    order breaks ties of first and last. A field that no point of a bucket has is 0, as are its sum, count and average;
    buckets without points have no row.
    """
    rows = points
    if spec.index_names is not None:
        rows = rows.where(F.col(index).isin(*spec.index_names) if len(spec.index_names) != 1 else F.col(index) == spec.index_names[0])
    test = in_range(F.col(ts), spec.start_us, spec.end_us)
    if test is not None:
        rows = rows.where(test)
    order = F.col("ts_ns") if order is None else order
    names = list(dict.fromkeys(field for _, field, _ in spec.outputs))
    rows = rows.select(F.col(index).alias("index_name"), bucket_start(F.col(ts), spec.group).alias("bucket_start"), order.alias("__order"), *(value(n).alias(f"__v{k}") for k, n in enumerate(names)))
    aggregates = [F.coalesce(REDUCERS[r](F.col(f"__v{names.index(f)}"), F.col("__order")).cast("double"), F.lit(MISSING)).alias(n) for n, f, r in spec.outputs]
    keys = rows.groupBy("index_name", "bucket_start")
    out = keys.agg(*aggregates) if aggregates else keys.agg(F.count("*").alias("__n")).drop("__n")
    return out.orderBy("index_name", "bucket_start") if sort else out
