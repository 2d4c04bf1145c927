"""Missing values against their definition, and how well they are filled on held-out values."""

import datetime as dt

import numpy as np

from chronoloom.operators import impute as M
from tests.conftest import DATA

POSTS = "post_id long, index_name string, ts timestamp_ntz, value map<string,double>, site string"
POINTS = "point_id long, index_name string, ts_ns long, value map<string,double>, kind string"
KINDS = "kind string, field_name string, unit string, low_limit double, high_limit double"
AT = dt.datetime(2025, 1, 1)
NS = 1_735_689_600_000_000_000


def kinds(spark):
    return spark.createDataFrame([("power", "amps", "A", 0.0, 1e4), ("power", "volts", "V", 0.0, 1e4), ("power", "watts", "W", 0.0, 1e8), ("power", "state", "code", 0.0, 4.0)], KINDS)


def test_cases(spark):
    whole = {"amps": 2.0, "volts": 230.0, "watts": 460.0, "state": 1.0}
    posts = [(k, "power.s.a", AT + dt.timedelta(minutes=k), whole, "") for k in range(40)]
    posts += [(100, "power.s.a", AT + dt.timedelta(minutes=100), {**whole, "watts": None, "state": float("nan")}, ""), (101, "power.s.a", AT + dt.timedelta(minutes=101), None, ""), (102, "power.s.a", AT + dt.timedelta(minutes=102), {**whole, "watts": 1e9}, "")]
    posts += [(200, "power.s.a", AT, {"amps": 1.0}, ""), (201, "power.s.a", AT, whole, ""), (300, None, AT, None, ""), (301, "power.s.a", None, None, ""), (302, "other.s.a", AT, None, ""), (303, "power", AT, whole, "")]
    points = [(1, "power.t.p0", NS, {**whole, "amps": -9999.0}, ""), (2, "power.t.p1", NS + 5, whole, ""), (3, "power.t.p1", NS + 5, {**whole, "volts": None}, ""), (4, "power.z.p9", NS, {}, "")]
    got = {(r.table_name, r.rec_id, r.field_name): r for r in M.fill_missing(spark.createDataFrame(posts + posts[:3], POSTS), spark.createDataFrame(points, POINTS), kinds(spark)).collect()}
    want = {("posts", 100, "watts"), ("posts", 100, "state"), *(("posts", 101, f) for f in whole), ("points", 1, "amps"), ("points", 3, "volts"), *(("points", 4, f) for f in whole)}
    assert set(got) == want
    assert got["posts", 100, "watts"].source.startswith("rule:") and abs(got["posts", 100, "watts"].filled - 460) < 1e-9
    assert abs(got["points", 1, "amps"].filled - 2) < 1e-9 and abs(got["points", 3, "volts"].filled - 230) < 1e-9
    assert got["posts", 100, "state"].filled == 1.0 and got["points", 4, "state"].source == "dependency:kind"
    assert all(r.filled is not None for r in got.values())


def test_empty(spark):
    empty = [spark.createDataFrame([], s) for s in (POSTS, POINTS, KINDS)]
    assert M.fill_missing(*empty).count() == 0
    assert M.fill_missing(empty[0], empty[1], kinds(spark)).count() == 0
    alone = M.fill_missing(spark.createDataFrame([(1, "power.a.b", AT, None, "")], POSTS), empty[1], kinds(spark)).collect()
    assert len(alone) == 4 and {r.source for r in alone} == {"none"} and {r.filled for r in alone} == {None}


def test_held_out_values_are_filled_closely(spark):
    """Known values of the tables are taken out and compared with what is filled in."""
    from pyspark.sql import functions as F

    points = spark.read.parquet(f"{DATA}/sf0.01/points.parquet").where("index_name IS NOT NULL")
    kind_fields = spark.read.parquet(f"{DATA}/sf0.01/kind_fields.parquet")
    known = points.where("point_id % 25 = 0").select("point_id", F.explode("value").alias("field_name", "v")).where("NOT isnan(v) AND v BETWEEN 0 AND 1e5")
    without = points.withColumn("value", F.when(F.col("point_id") % 25 == 0, F.lit(None)).otherwise(F.col("value")))
    filled = M.fill_missing(spark.createDataFrame([], POSTS), without, kind_fields).where("table_name = 'points'")
    rows = known.join(filled, (known.point_id == filled.rec_id) & (known.field_name == filled.field_name)).select(known.field_name, "v", "filled").collect()
    state = [r.v == r.filled for r in rows if r.field_name == "state"]
    others = [abs(r.v - r.filled) / max(abs(r.v), 1) for r in rows if r.field_name != "state"]
    assert len(state) > 50 and np.mean(state) > 0.9
    assert len(others) > 100 and np.median(others) < 0.05


def test_dependencies_are_mined_and_verified(spark):
    """A code that follows the hour of the day is found as such, one that follows nothing isn't, and each fill says so."""
    rng = np.random.default_rng(4)
    catalogue = spark.createDataFrame([("k", "shift", "code", 0.0, 9.0), ("k", "noise", "code", 0.0, 9.0), ("k", "base", "u", 0.0, 1e6)], KINDS)
    rows = []
    for series in range(3):
        for hour in range(24 * 20):
            value = {"shift": float(hour % 24 // 8 + series), "noise": float(rng.integers(0, 10)), "base": 100.0 * (series + 1) + rng.normal(0, 0.1)}
            if hour % 17 == 5:
                value = {}
            rows.append((series * 10_000 + hour, f"k.s{series}.u", AT + dt.timedelta(hours=hour), value, ""))
    got = M.fill_missing(spark.createDataFrame(rows, POSTS), spark.createDataFrame([], POINTS), catalogue).collect()
    assert len(got) == 3 * sum(1 for h in range(480) if h % 17 == 5) * 3
    for r in got:
        series, hour = divmod(r.rec_id, 10_000)
        if r.field_name == "shift":
            assert r.source == "dependency:series+hour_of_day" and r.filled == hour % 24 // 8 + series
        elif r.field_name == "base":
            assert r.source.startswith("dependency:") and abs(r.filled - 100 * (series + 1)) < 1
        else:
            assert r.source.startswith("group:") and 0 <= r.filled <= 9


def test_shares_and_errors_by_source(spark):
    """Held-out values of posts and points: what each source fills, and how far off it is."""
    from collections import defaultdict

    from pyspark.sql import functions as F

    d = f"{DATA}/sf0.01"
    kind_fields = spark.read.parquet(f"{d}/kind_fields.parquet")
    tables = []
    for name, key in (("posts", "post_id"), ("points", "point_id")):
        df = spark.read.parquet(f"{d}/{name}.parquet")
        known = df.where(f"{key} % 31 = 0 AND index_name IS NOT NULL").select(F.lit(name).alias("table_name"), F.col(key).alias("rec_id"), F.explode("value").alias("field_name", "v")).where("NOT isnan(v) AND v BETWEEN 0 AND 1e5")
        # One field at a time is missing, so that relations of the row can be used.
        taken = F.map_filter("value", lambda k, v: (F.col(key) % 31 != 0) | (F.pmod(F.xxhash64(k, F.col(key)), F.lit(3)) != 0))
        tables.append((df.withColumn("value", taken), known.where("pmod(xxhash64(field_name, rec_id), 3) = 0")))
    filled = M.fill_missing(tables[0][0], tables[1][0], kind_fields)
    rows = tables[0][1].unionByName(tables[1][1]).join(filled, ["table_name", "rec_id", "field_name"]).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source.split(":")[0]].append(float(r.v != r.filled) if r.field_name == "state" else abs(r.v - r.filled) / max(abs(r.v), 1))
    assert len(rows) > 500 and set(by) <= {"rule", "dependency", "group"} and len(by["rule"]) > 20
    print({k: (len(v), float(np.median(v)), float(np.mean(np.array(v) <= 0.04))) for k, v in by.items()})
    # Spikes among the values held out, or in their rows, are not what a row like it would hold.
    assert np.mean(np.array(by["rule"]) < 0.01) > 0.95 and np.median(by["group"]) < 0.1
    assert not by["dependency"] or np.mean(np.array(by["dependency"]) <= 0.04) > 0.9
