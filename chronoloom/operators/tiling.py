"""Cuts series that hold very many rows into consecutive tiles of bounded size, with the neighbours' rows as halos.

Series below the target stay whole. The plan has one row per slot (a span of time) of the hot series only. Slots with too
many rows are cut again, so that a burst gets short slots and an outage a long one; only rows of one instant can't be
parted. The plan is computed from two columns, and sent to all tasks only when its measured size is within a bound, else
joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.session import ensure_checkpoint_dir

#: Rows of a plan that may be sent to every task (some 5 MB).
SEND_ROWS = 100_000
#: How many slots a slot with too many rows is cut into; a power of two, so that slots nest.
FINER = 64
#: Slots of the first level whose rows are summed by one task.
BLOCK_SLOTS = 4096


def small(spark: SparkSession, df: DataFrame, bound: int = SEND_ROWS) -> tuple[DataFrame, bool]:
    """The frame as local data if it has at most ``bound`` rows, and whether it does."""
    rows = df.limit(bound + 1).collect()
    return (spark.createDataFrame(rows, df.schema), True) if len(rows) <= bound else (df, False)


def hot_series(posts: DataFrame, target_rows: int, key: str = "index_name", ts: str = "ts") -> DataFrame:
    """Series with more rows than the target: first instant and width (in us, a power of two) of their slots."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    stats = posts.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(at).alias("origin"), F.max(at).alias("end"))
    slots = F.ceil(F.col("n") / (target_rows / 16))
    width = F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("origin") + 1) / slots))
    return stats.where(F.col("n") > target_rows).select(key, "origin", F.pow(F.lit(2.0), F.ceil(F.log2(width))).cast("long").alias("width"))


def _slot(level: int) -> Column:
    """The slot of a row by its distance ``off`` from the series' origin; each level's slots are ``FINER`` times as fine."""
    return F.floor(F.col("off") / _width(level)).cast("long")


def _width(level: int) -> Column:
    return F.greatest(F.lit(1), F.floor(F.col("width") / FINER**level)).cast("long")


def _leaves(rows: DataFrame, key: str, target_rows: int) -> list[DataFrame]:
    """Per level the slots that are not cut further: key, slot, begin (from the origin) and n rows."""
    spark, rest, out = rows.sparkSession, rows.select(key, "off", "width"), []
    ensure_checkpoint_dir(spark)
    while True:
        level = len(out)
        counted = rest.groupBy(key, _slot(level).alias("slot"), "width").agg(F.count("*").alias("n")).select(key, "slot", "n", _width(level).alias("w"))
        counted, few = small(spark, counted)
        counted = counted if few else counted.checkpoint()
        full = (F.col("n") > target_rows / 2) & (F.col("w") > 1)
        out.append(counted.where(~full).select(key, "slot", (F.col("slot") * F.col("w")).alias("begin"), "n"))
        more = counted.where(full).select(key, "slot")
        if more.isEmpty():
            return out
        rest = rest.withColumn("slot", _slot(level)).join(F.broadcast(more) if few else more, [key, "slot"], "left_semi").drop("slot")


def _running(df: DataFrame, key: str) -> DataFrame:
    """Adds ``before`` and ``upto``, the rows before and up to each slot in time; sums of blocks are summed first, so no task takes a whole series."""
    block = df.withColumn("block", F.floor(F.col("at") / BLOCK_SLOTS))
    sums = block.groupBy(key, "block").agg(F.sum("n").alias("s"))
    sums = sums.select(key, "block", (F.sum("s").over(Window.partitionBy(key).orderBy("block")) - F.col("s")).alias("base"))
    upto = F.col("base") + F.sum("n").over(Window.partitionBy(key, "block").orderBy("begin"))
    out = block.join(sums, [key, "block"]).withColumn("upto", upto)
    return out.withColumn("before", F.col("upto") - F.col("n")).drop("block", "base")


def assign(posts: DataFrame, target_rows: int, halo_rows: int, key: str = "index_name", ts: str = "ts") -> DataFrame:
    """Adds ``tile`` and ``halo``. A row comes once with halo false, and again for each other tile within halo_rows of it."""
    spark = posts.sparkSession
    hot, hot_small = small(spark, hot_series(posts, target_rows, key, ts))
    if hot_small and hot.isEmpty():
        return posts.withColumns({"tile": F.lit(0), "halo": F.lit(False)})
    placed = posts.join(F.broadcast(hot) if hot_small else hot, key, "left").withColumn("off", F.unix_micros(F.col(ts).cast("timestamp")) - F.col("origin"))
    levels = _leaves(placed.where(F.col("off").isNotNull()), key, target_rows)
    plan = None
    for level, leaves in enumerate(levels):
        # ``at``: the slot of the first level, for blocks of the running sums.
        one = leaves.join(hot, key).select(key, F.lit(level).alias("level"), "slot", "begin", "n", F.floor(F.col("begin") / F.col("width")).alias("at"))
        plan = one if plan is None else plan.unionByName(one)
    # A slot belongs to the tile that its first row falls in; its rows are the halo of tiles that begin or end near it.
    plan = _running(plan, key).withColumn("tile", F.floor(F.col("before") / target_rows).cast("int"))
    of_tile = Window.partitionBy(key, "tile")
    plan = plan.withColumns({"start": F.min("before").over(of_tile), "stop": F.max("upto").over(of_tile)})
    near_next = F.col("upto") > F.col("stop") - halo_rows
    near_last = (F.col("before") < F.col("start") + halo_rows) & (F.col("tile") > 0)
    other = lambda step: F.struct((F.col("tile") + step).alias("tile"), F.lit(True).alias("halo"))
    plan = plan.select(key, "level", "slot", F.array_compact(F.array(F.struct("tile", F.lit(False).alias("halo")), F.when(near_next, other(1)), F.when(near_last, other(-1)))).alias("tiles"))
    plan, plan_small = small(spark, plan)
    tiled = placed
    for level in range(len(levels)):
        of_level = plan.where(F.col("level") == level).select(key, F.col("slot").alias(f"slot{level}"), F.col("tiles").alias(f"tiles{level}"))
        tiled = tiled.withColumn(f"slot{level}", _slot(level)).join(F.broadcast(of_level) if plan_small else of_level, [key, f"slot{level}"], "left")
    whole = F.array(F.struct(F.lit(0).alias("tile"), F.lit(False).alias("halo")))
    return tiled.withColumn("t", F.explode(F.coalesce(*(f"tiles{level}" for level in range(len(levels))), whole))).select(*posts.columns, "t.tile", "t.halo")
