"""Pre-aggregated buckets: built from points, merged to coarser levels, and used to answer queries that they nest in.

A rollup row is keyed by (index_name, level, bucket_start, field_name). ``first_ns`` and ``last_ns`` make first and last
mergeable in any order; counts are 64 bits wide. Points without a value keep their bucket by a row whose field is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.functions.buckets import bucket_start
from chronoloom.plans.query import MISSING, in_range, run_query
from chronoloom.plans.spec import Group, QuerySpec

KEYS = ("index_name", "bucket_start", "field_name")
ROLLUP_COLUMNS = (*KEYS, "sum", "min", "max", "first", "first_ns", "last", "last_ns", "count")
ROLLUP_SCHEMA = T.StructType(
    [T.StructField("index_name", T.StringType()), T.StructField("bucket_start", T.TimestampNTZType()), T.StructField("field_name", T.StringType())]
    + [T.StructField(c, T.LongType() if c.endswith("_ns") or c == "count" else T.DoubleType()) for c in ROLLUP_COLUMNS[3:]]
    + [T.StructField("part", T.IntegerType())]
)
STORED_LEVELS = ("minute", "hour", "day", "month", "year")


def build_rollup(points: DataFrame, level: str) -> DataFrame:
    """Rollup rows of one level of standing points (index_name, ts, ts_ns, value map); null values count nowhere."""
    cells = points.select("index_name", bucket_start(F.col("ts"), Group(1, level)).alias("bucket_start"), "ts_ns", F.explode_outer("value").alias("field_name", "v"))
    # Without a value neither a time of it.
    cells = cells.withColumns({"field_name": F.when(F.col("v").isNotNull(), F.col("field_name")), "ts_ns": F.when(F.col("v").isNotNull(), F.col("ts_ns"))})
    out = cells.groupBy(*KEYS).agg(
        F.sum("v").alias("sum"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.min_by("v", "ts_ns").alias("first"), F.min("ts_ns").alias("first_ns"), F.max_by("v", "ts_ns").alias("last"), F.max("ts_ns").alias("last_ns"), F.count("v").alias("count"),
    )
    return out.withColumn("level", F.lit(level))


def merge_rollup(rollup: DataFrame, group: Group, level: str | None = None) -> DataFrame:
    """Rows of a level (or several partial rows of one bucket) merged into the buckets of a coarser group."""
    rows = rollup.withColumn("bucket_start", bucket_start(F.col("bucket_start"), group))
    out = rows.groupBy(*KEYS).agg(
        F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.min_by("first", "first_ns").alias("first"), F.min("first_ns").alias("first_ns"), F.max_by("last", "last_ns").alias("last"), F.max("last_ns").alias("last_ns"), F.sum("count").alias("count"),
    )
    return out.withColumn("level", F.lit(level or group.unit))


def choose_level(spec: QuerySpec, stored: tuple[str, ...] = STORED_LEVELS, whole: bool = True) -> str | None:
    """The coarsest stored level whose buckets make up the query's; whole: and on whose edges its range ends. None: use points."""
    order = [level for level in reversed(STORED_LEVELS) if level in stored]
    for level in order:
        own = Group(1, level)
        if own.nests_in(spec.group) and (not whole or spec.end_us is None or own.floor_us(spec.end_us) == spec.end_us):
            return level
    return None


def _reduced(field: str, reducer: str) -> Column:
    """A reducer over rollup rows, from those of one field."""
    of = lambda c: F.when(F.col("field_name") == field, F.col(c))
    if reducer in ("first", "last"):
        return (F.min_by if reducer == "first" else F.max_by)(of(reducer), of(f"{reducer}_ns"))
    if reducer in ("avg", "ma"):
        return F.try_divide(F.sum(of("sum")), F.sum(of("count")))
    return {"min": F.min, "max": F.max}.get(reducer, F.sum)(of(reducer))


def query_rollup(rollup: DataFrame, spec: QuerySpec, level: str | None = None, sort: bool = True) -> DataFrame:
    """The query's answer from rollup rows (of one level, if it names one) that nest in its group; the same rows as ``run_query`` gives."""
    rows = rollup if level is None else rollup.where(F.col("level") == level)
    if spec.index_names is not None:
        rows = rows.where(F.col("index_name").isin(*spec.index_names))
    test = in_range(F.col("bucket_start"), spec.start_us, spec.end_us)
    if test is not None:
        rows = rows.where(test)
    keyed = rows.withColumn("bucket_start", bucket_start(F.col("bucket_start"), spec.group)).groupBy("index_name", "bucket_start")
    columns = [F.coalesce(_reduced(f, r).cast("double"), F.lit(MISSING)).alias(n) for n, f, r in spec.outputs]
    out = keyed.agg(*columns) if columns else keyed.agg(F.count("*").alias("__n")).drop("__n")
    return out.orderBy("index_name", "bucket_start") if sort else out


def answer(points: DataFrame, rollup: DataFrame | None, spec: QuerySpec, stored: tuple[str, ...] = STORED_LEVELS) -> DataFrame:
    """From the coarsest rollup that gives the exact answer, else from the points."""
    level = choose_level(spec, stored) if rollup is not None else None
    return run_query(points, spec) if level is None else query_rollup(rollup, spec, level)
