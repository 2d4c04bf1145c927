"""Regular grids against their definition, and predictions on a known season."""

import datetime as dt

import numpy as np
import pytest

from chronoloom.operators import grid as G

POSTS = "post_id long, index_name string, ts timestamp_ntz, value map<string,double>, bucket long"
REQUESTS = "grid_id long, index_name string, from_time timestamp_ntz, to_time timestamp_ntz, group_spec string, field_name string, value double"
KINDS = "kind string, field_name string, unit string, low_limit double, high_limit double"
AT = dt.datetime(2025, 1, 1)
US = 1_735_689_600_000_000
MINUTE = 60_000_000


def run(spark, posts, requests):
    kinds = spark.createDataFrame([("k", "v", "V", -1e6, 1e6), ("k", "c", "code", 0.0, 4.0)], KINDS)
    rows = G.regular_grid(spark.createDataFrame(posts, POSTS), spark.createDataFrame(requests, REQUESTS), kinds).collect()
    return {(r.grid_id, r.bucket_us): r for r in rows}


def test_buckets_and_states(spark):
    posts = [(1, "k.a", AT + dt.timedelta(minutes=1), {"v": 10.0, "c": 1.0}, 0), (2, "k.a", AT + dt.timedelta(minutes=3), {"v": 20.0}, 0), (3, "k.a", AT + dt.timedelta(minutes=11), {"v": None, "c": float("nan")}, 0), (4, "k.a", AT + dt.timedelta(minutes=16), {"v": 40.0, "c": 2.0}, 0)]
    posts += [(5, "k.a", AT + dt.timedelta(minutes=21), {"v": 1.0}, 0), (6, "k.a", AT + dt.timedelta(minutes=21), None, 0), (7, None, AT, {"v": 1.0}, 0), (8, "k.a", None, {"v": 1.0}, 0)]
    requests = [(1, "k.a", AT + dt.timedelta(minutes=2), AT + dt.timedelta(minutes=21), "5minutes", "v", 0.0), (2, "k.a", AT, AT + dt.timedelta(minutes=20), "5minutes", "c", 0.0), (3, "none", AT, AT + dt.timedelta(minutes=2), "minute", "v", 0.0), (4, "k.a", None, AT, "minute", "v", 0.0), (5, "k.a", AT, AT, "minute", "v", 0.0), (6, "k.a", AT, AT + dt.timedelta(1), "fortnight", "v", 0.0)]
    got = run(spark, posts + posts[:1], requests + requests[:2])
    b = lambda k: US + k * 5 * MINUTE
    assert {k for k in got if k[0] == 1} == {(1, b(k)) for k in range(5)}
    assert [got[1, b(k)].cell_state == "observed" for k in range(5)] == [True, False, False, True, False]
    assert got[1, b(0)].value == pytest.approx(15) and got[1, b(0)].n_readings == 2
    assert 15 < got[1, b(1)].value < got[1, b(2)].value < 40
    assert [(got[2, b(k)].cell_state, got[2, b(k)].value) for k in range(4)] == [("observed", 1.0), ("held", 1.0), ("held", 1.0), ("observed", 2.0)]
    assert {got[3, US + k * MINUTE].cell_state for k in range(2)} == {"missing"} and got[3, US].value is None
    assert not {k for k in got if k[0] in (4, 5, 6)}
    assert run(spark, [], []) == {} and len(run(spark, [], requests[:1])) == 5


def test_season_is_predicted(spark):
    rng = np.random.default_rng(2)
    true = lambda h: 20 + 5 * np.sin(2 * np.pi * h / 24) + 0.01 * h
    hours = [h for h in range(24 * 20) if not 200 <= h < 224]
    posts = [(h, "k.a", AT + dt.timedelta(hours=h, minutes=7), {"v": float(true(h) + rng.normal(0, 0.1))}, 0) for h in hours] + [(9999, "k.a", AT + dt.timedelta(hours=30), {"v": 9e5}, 0)]
    got = run(spark, posts, [(1, "k.a", AT, AT + dt.timedelta(days=20), "1hour", "v", 0.0)])
    gap = [got[1, US + h * 60 * MINUTE] for h in range(200, 224)]
    assert {g.cell_state for g in gap} == {"seasonal"}
    assert max(abs(g.value - true(h)) for g, h in zip(gap, range(200, 224))) < 1.0


def test_long_requests_cross_spans_and_months(spark, monkeypatch):
    monkeypatch.setattr(G, "SPAN", 4)
    posts = [(1, "k.a", AT, {"v": 10.0, "c": 3.0}, 0), (2, "k.a", AT + dt.timedelta(minutes=19), {"v": 29.0}, 0), (3, "k.a", dt.datetime(2024, 3, 5), {"v": 1.0}, 0)]
    got = run(spark, posts, [(1, "k.a", AT, AT + dt.timedelta(minutes=20), "minute", "c", 0.0), (2, "k.a", AT, AT + dt.timedelta(minutes=20), "minute", "v", 0.0), (3, "k.a", dt.datetime(2024, 2, 20), dt.datetime(2024, 6, 1), "2months", "v", 0.0)])
    assert [got[1, US + k * MINUTE].value for k in range(20)] == [3.0] * 20
    values = [got[2, US + k * MINUTE].value for k in range(20)]
    assert values[0] == 10 and values[19] == 29 and (np.diff(values) > 0).all()
    month = lambda m: int((dt.datetime(2024, m, 1) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    assert {k[1]: got[k].cell_state == "observed" for k in got if k[0] == 3} == {month(1): False, month(3): True, month(5): False}


@pytest.mark.parametrize("field", ["r", "v"])
def test_a_field_mostly_zero_keeps_its_season(spark, field):
    """Rain falls from 3 to 6 o'clock only: the fit takes in the wet readings, though both quartiles are 0."""
    true = lambda h: 4.0 if 3 <= h % 24 < 6 else 0.0
    posts = [(h, "k.a", AT + dt.timedelta(hours=h), {field: true(h)}, 0) for h in range(24 * 20) if not 240 <= h < 264]
    kinds = spark.createDataFrame([("k", "r", "mm", 0.0, 200.0), ("k", "v", "V", 0.0, 200.0)], KINDS)
    request = [(1, "k.a", AT, AT + dt.timedelta(days=20), "1hour", field, 0.0)]
    rows = G.regular_grid(spark.createDataFrame(posts, POSTS), spark.createDataFrame(request, REQUESTS), kinds).collect()
    got = {r.bucket_us: r for r in rows}
    gap = [got[US + h * 60 * MINUTE] for h in range(240, 264)]
    assert {g.cell_state for g in gap} == {"seasonal"}
    assert 1.5 < gap[4].value == max(g.value for g in gap) and gap[16].value < 0.5
