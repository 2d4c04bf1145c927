"""Totals and averages over trailing periods, for each series, field and day, days without posts included.

Readings are summed per series, field and day where they lie (partial aggregation, so a hot series shuffles no more than
its days). The daily sums are then packed into dense blocks of entities by days, one tile of days at a time with the
longest window's preceding days as a halo, and multiplied by banded window operators: one matrix product per tile and
window gives the trailing sums of all its entities.

Defined cases: null, NaN and infinite readings are in no total; posts without series or time are left out; a post whose
map is null or empty counts as a post; a series' days run from its first to its last standing post (UTC); an average over
no readings is null and its total 0; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.readings import codes_of, over_chunks, standing

WINDOWS = (7, 30)
TILE_DAYS = 64
OUT = "index_name string, field_name string, day int, window_days int, n_posts long, n_readings long, total double, average double"


def daily(posts: DataFrame) -> DataFrame:
    """Per series and UTC day a row without field (n_posts), and one per field with its finite readings' count and sum."""
    day = F.unix_date(F.col("ts").cast("date"))
    entries = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("value"))), F.coalesce(F.map_entries("value"), F.array()))
    cells = standing(posts).select("index_name", day.alias("day"), F.inline(entries).alias("field_name", "v"))
    finite = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < F.lit(float("inf")))
    return cells.groupBy("index_name", "field_name", "day").agg(F.count("*").alias("n_rows"), F.count(F.when(finite, 1)).alias("n"), F.coalesce(F.sum(F.when(finite, F.col("v"))), F.lit(0.0)).alias("s"))


def window_operator(days: int, width: int, halo: int) -> np.ndarray:
    """Banded 0/1 matrix: column j sums the ``width`` days that end with day j of the tile; rows are halo and tile days."""
    row, column = np.arange(halo + days)[:, None], np.arange(days)[None, :] + halo
    return ((row <= column) & (row > column - width)).astype("float64")


def _roll(table: pa.Table, windows: tuple[int, ...], tile_days: int) -> pa.Table | None:
    """Trailing sums of whole series, whose rows come sorted by series, field (null first) and day."""
    series, names = codes_of(table.column("index_name").combine_chunks())
    field, fields = codes_of(table.column("field_name").combine_chunks())
    day = table.column("day").to_numpy()
    n_rows, n, s = (table.column(c).to_numpy() for c in ("n_rows", "n", "s"))
    changes = np.append(True, (series[1:] != series[:-1]) | (field[1:] != field[:-1]))
    entity = np.cumsum(changes) - 1
    at = np.flatnonzero(changes)
    e_series, e_field = series[at], field[at]
    # A series' rows without field, one for each day with posts, tell its first and last day.
    posts_of = np.array([f is None for f in fields])[field]
    first = np.full(len(names), np.iinfo("int32").max, "int64")
    last = np.full(len(names), np.iinfo("int32").min, "int64")
    np.minimum.at(first, series, day)
    np.maximum.at(last, series, day)
    post_entity = np.full(len(names), -1)
    post_entity[series[posts_of]] = entity[posts_of]
    halo = max(windows) - 1
    operators = {w: window_operator(tile_days, w, halo) for w in windows}
    out: list[tuple[np.ndarray, ...]] = []
    lo, hi = first.min() // tile_days, last.max() // tile_days
    busy = np.zeros(hi - lo + 1, bool)
    for a, b in zip(first // tile_days - lo, last // tile_days - lo):
        busy[a : b + 1] = True
    by_day = np.argsort(day, kind="stable")
    sorted_days = day[by_day]
    for tile in np.flatnonzero(busy) + lo:
        start, end = tile * tile_days, (tile + 1) * tile_days
        live = np.flatnonzero((first[e_series] < end) & (last[e_series] >= start))
        place = np.full(len(at), -1)
        place[live] = np.arange(len(live))
        rows = by_day[np.searchsorted(sorted_days, start - halo) : np.searchsorted(sorted_days, end)]
        rows = rows[place[entity[rows]] >= 0]
        block = np.zeros((3, len(live), halo + tile_days))
        where = (place[entity[rows]], day[rows] - start + halo)
        for k, x in enumerate((n_rows, n, s)):
            block[k][where] = x[rows]
        days = np.arange(start, end)
        inside = (days[None, :] >= first[e_series[live]][:, None]) & (days[None, :] <= last[e_series[live]][:, None])
        e, j = np.nonzero(inside)
        posts_at = place[post_entity[e_series[live]]]
        for w, operator in operators.items():
            rolled = block @ operator
            out.append((live[e], days[j], np.full(len(e), w), rolled[0][posts_at[e], j], rolled[1][e, j], rolled[2][e, j]))
    if not out:
        return None
    ent, days, width, n_posts, n_read, total = (np.concatenate(x) for x in zip(*out))
    none = np.array([f is None for f in fields])[e_field[ent]]
    with np.errstate(invalid="ignore", divide="ignore"):
        average = total / n_read
    take = lambda values, codes: pa.array(values, pa.string()).take(pa.array(codes))
    return pa.table({
        "index_name": take(names, e_series[ent]), "field_name": take(fields, e_field[ent]), "day": pa.array(days, pa.int32()), "window_days": pa.array(width, pa.int32()),
        "n_posts": pa.array(np.rint(n_posts).astype("int64")), "n_readings": pa.array(np.rint(n_read).astype("int64"), mask=none),
        "total": pa.array(total, mask=none), "average": pa.array(average, mask=none | (n_read == 0)),
    })


def trailing_totals(posts: DataFrame, windows: tuple[int, ...] = WINDOWS, tile_days: int = TILE_DAYS) -> DataFrame:
    """Columns of OUT, one row per series, field, day (since the epoch) and window; the row with field_name null is of the series as a whole."""
    by_series = daily(posts).repartition("index_name").sortWithinPartitions("index_name", F.col("field_name").asc_nulls_first(), "day")
    return by_series.mapInArrow(over_chunks(lambda t: _roll(t, windows, tile_days), ("index_name",), 20_000), OUT)
