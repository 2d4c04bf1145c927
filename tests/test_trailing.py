"""Trailing totals against a day by day sum."""

import datetime as dt
import random

import pytest

from chronoloom.operators import trailing as T

SCHEMA = "post_id long, index_name string, ts timestamp_ntz, value map<string,double>, day string"


def brute(rows, windows):
    last = {}
    for post, name, ts, value, _ in rows:
        if name is not None and ts is not None and last.get((name, ts), (-1,))[0] < post:
            last[name, ts] = (post, value)
    out = {}
    for series in {n for n, _ in last}:
        own = {t: v for (n, t), (_, v) in last.items() if n == series}
        days = [t.date() for t in own]
        fields = {f for v in own.values() if v for f in v} | {None}
        for f in fields:
            day = min(days)
            while day <= max(days):
                for w in windows:
                    inside = [v for t, v in own.items() if 0 <= (day - t.date()).days < w]
                    reads = [v[f] for v in inside if f and v and v.get(f) is not None and abs(v[f]) < float("inf")]
                    out[series, f, (day - dt.date(1970, 1, 1)).days, w] = (len(inside), len(reads) if f else None, sum(reads) if f else None)
                day += dt.timedelta(1)
    return out


@pytest.mark.parametrize("tile_days, windows", [(64, (7, 30)), (5, (3, 12)), (1, (2,))])
def test_against_brute_force(spark, tile_days, windows):
    rng = random.Random(tile_days)
    rows = []
    for k in range(300):
        name = rng.choice(["a.x", "b.y", "c", None])
        day = rng.choice([0, 1, 2, 40, 41, 90]) if name != "c" else 7
        ts = None if rng.random() < 0.05 else dt.datetime(2024, 12, 20) + dt.timedelta(days=day, hours=rng.randrange(24))
        value = rng.choice([None, {}, {"f": rng.choice([1.5, None, float("nan"), float("inf"), -2.0])}, {"f": 2.0, "g": rng.random()}])
        rows.append((k, name, ts, value, "clash"))
    rows += rows[:20]
    got = {(r.index_name, r.field_name, r.day, r.window_days): r for r in T.trailing_totals(spark.createDataFrame(rows, SCHEMA), windows, tile_days).collect()}
    want = brute(rows, windows)
    assert set(got) == set(want)
    for k, (n_posts, n_read, total) in want.items():
        r = got[k]
        assert (r.n_posts, r.n_readings) == (n_posts, n_read), k
        if total is None:
            assert r.total is None and r.average is None
        else:
            assert r.total == pytest.approx(total) and (r.average is None if not n_read else r.average == pytest.approx(total / n_read))


def test_empty(spark):
    assert T.trailing_totals(spark.createDataFrame([], SCHEMA)).count() == 0


def test_operator_is_banded():
    b = T.window_operator(4, 2, 3)
    assert b.shape == (7, 4) and b.sum(axis=0).tolist() == [2, 2, 2, 2] and b[2, 0] == b[3, 0] == 1
