"""Faulty readings against their definition, with hot series cut into tiles."""

import datetime as dt

import numpy as np
import pytest

from chronoloom.operators import anomalies as A
from chronoloom.operators import tiling

SCHEMA = "post_id long, index_name string, ts timestamp_ntz, value map<string,double>, case_kind string"
KINDS = "kind string, field_name string, unit string, low_limit double, high_limit double"
START = dt.datetime(2025, 1, 1)


def catalogue(spark):
    return spark.createDataFrame([("k", "v", "V", 0.0, 1000.0), ("k", "c", "code", 0.0, 4.0), ("k", "v", "V", 0.0, 1000.0), (None, "x", None, None, None)], KINDS)


def flags(spark, rows, **kw):
    found = A.flag_readings(spark.createDataFrame(rows, SCHEMA), catalogue(spark), **kw)
    return {(r.post_id, r.field_name, r.case_kind) for r in found.collect()}


def series(values, name="k.a", first=0, field="v"):
    return [(first + k, name, START + dt.timedelta(minutes=k), {field: None if v is None else float(v)}, "") for k, v in enumerate(values)]


@pytest.mark.parametrize("tile_rows", [65_536, 200])
def test_all_kinds(spark, tile_rows):
    rng = np.random.default_rng(1)
    v = 100 + 5 * np.sin(np.arange(900) / 50) + rng.normal(0, 0.5, 900)
    v[300:303] = 400.0  # three in a row: spikes
    v[500:504] = 300.0  # four in a row: a level
    v[100], v[101], v[102] = 2000.0, float("inf"), -1.0
    v[195:210] = v[195]  # across the edge of a tile
    v[700] = 950.0
    want = {(k, "v", "spike") for k in (300, 301, 302, 700)} | {(k, "v", "impossible") for k in (100, 101, 102)} | {(k, "v", "stuck") for k in range(195, 210)}
    # The level widens the ordinary range to 300: 400 lies within its reach, 950 beyond.
    want -= {(k, "v", "spike") for k in (300, 301, 302)}
    assert flags(spark, series(v), tile_rows=tile_rows, halo_rows=40) == want


def test_spikes_of_three_posts(spark):
    v = np.tile([10.0, 11.0, 12.0, 11.5], 60)
    v[50:53] = [40, 41, 39]
    v[0] = 90.0
    v[-1] = 0.5
    assert flags(spark, series(v)) == {(k, "v", "spike") for k in (50, 51, 52, 0, len(v) - 1)}


@pytest.mark.parametrize("before", [88.0, 12.0])
def test_a_tail_reading_beside_spikes_is_no_level(spark, before):
    rng = np.random.default_rng(3)
    v = rng.normal(10, 1, 800)
    v[[100, 200, 300, 600]] = 20.0, 38.0, 80.0, 88.0  # ordinary: each in reach of the range with those before
    v[399], v[400:403] = before, (5600, 5900, 5700)
    v[700] = 2000.0
    ok = catalogue(spark).selectExpr("kind", "field_name", "unit", "low_limit", "high_limit * 10 AS high_limit")
    found = A.flag_readings(spark.createDataFrame(series(v), SCHEMA), ok).collect()
    assert {r.post_id for r in found} == {400, 401, 402, 700} and {r.case_kind for r in found} == {"spike"}


def test_a_level_as_long_as_four_posts_is_ordinary(spark):
    v = np.tile([10.0, 11.0, 12.0, 11.5], 60)
    v[50:54] = [40, 41, 39, 40]
    v[100:104] = [-300, 900, -300, 900]
    v[150:153] = 5000.0
    ok = catalogue(spark).selectExpr("kind", "field_name", "unit", "-1e6 AS low_limit", "1e6 AS high_limit")
    assert {r.post_id for r in A.flag_readings(spark.createDataFrame(series(v), SCHEMA), ok).collect()} == {150, 151, 152}


def test_often_equal_fields_and_codes_do_not_stick(spark):
    assert flags(spark, series([5.0] * 40)) == set()
    assert flags(spark, series([2.0] * 20 + [1.0, 3.0] * 40, field="c")) == set()
    assert flags(spark, series([9.0], field="c")) == {(0, "c", "impossible")}


def test_later_posts_replace_and_nulls_are_no_readings(spark):
    rows = series(np.tile([10.0, 11.0, 12.0], 30)) + [(1000, "k.a", START, {"v": 5000.0}, ""), (1001, "k.a", START, {"v": 10.5}, "")]
    rows += [(2000, None, START, {"v": 9e9}, ""), (2001, "k.a", None, {"v": 9e9}, ""), (2002, "k.a", START + dt.timedelta(days=9), None, ""), (2003, "k.a", START + dt.timedelta(days=8), {"v": float("nan")}, "")]
    assert flags(spark, rows) == set()
    assert flags(spark, []) == set()


def test_tiles_hold_every_row_once(spark):
    rows = [(k, "hot", START + dt.timedelta(seconds=(k * k) % 7919), None, "") for k in range(3000)] + [(5000, "cold", START, None, "")]
    tiled = tiling.assign(spark.createDataFrame(rows, SCHEMA), 400, 50)
    own = tiled.where("NOT halo").groupBy("index_name", "tile").count().collect()
    assert sum(r["count"] for r in own) == 3001
    sizes = [r["count"] for r in own if r.index_name == "hot"]
    assert len(sizes) > 5 and max(sizes) <= 600
    assert tiled.where("halo").count() >= 50 * (len(sizes) - 1)


@pytest.mark.parametrize("send", [100_000, 3])
def test_a_burst_is_cut_like_the_rest(spark, monkeypatch, send):
    """22,000 rows, 20,000 of them in the last hour of ten years, some thousand in one instant."""
    monkeypatch.setattr(tiling, "SEND_ROWS", send)
    small = tiling.small
    monkeypatch.setattr(tiling, "small", lambda s, df, bound=send: small(s, df, bound))
    years = dt.timedelta(days=3650)
    at = [START + years * (k / 2000) for k in range(2000)] + [START + years - dt.timedelta(milliseconds=k * 170) for k in range(20_000)] + [START + years + dt.timedelta(days=1)] * 1500
    rows = [(k, "hot", t, None, "") for k, t in enumerate(at)] + [(90_000, "cold", START, None, ""), (90_001, None, START, None, ""), (90_002, "hot", None, None, "")]
    tiled = tiling.assign(spark.createDataFrame(rows, SCHEMA), 1000, 50).select("post_id", "index_name", "ts", "tile", "halo").collect()
    own = [r for r in tiled if not r.halo]
    assert sorted(r.post_id for r in own) == sorted(r[0] for r in rows)
    hot = sorted((r.ts, r.tile) for r in own if r.index_name == "hot" and r.ts)
    assert [t for _, t in hot] == sorted(t for _, t in hot)
    sizes = [sum(t == k for _, t in hot) for k in {t for _, t in hot}]
    assert len(sizes) >= 15 and max(sizes) < 2 * 1500 and sorted(sizes)[-2] < 2 * 1000
    # The 50 rows before a tile's first row, and after its last, are its halo.
    tiles = sorted({t for _, t in hot})
    for k in tiles[1:-1]:
        mine = [x for x, t in hot if t == k]
        halo = {r.ts for r in tiled if r.halo and r.tile == k}
        order = [x for x, _ in hot]
        first, last = order.index(mine[0]), len(order) - 1 - order[::-1].index(mine[-1])
        assert set(order[max(0, first - 50) : first]) <= halo | {mine[0]} and set(order[last + 1 : last + 51]) <= halo | {mine[-1]}
