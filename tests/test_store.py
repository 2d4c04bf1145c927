"""The store, its routes, rollups and streams on small fixtures."""

import datetime as dt
import json
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from chronoloom import BadGroupError, BadReducerError, BadTimeError, DatabaseExistsError, DatabaseNotFoundError, MalformedBodyError, QuerySpec, Store, parse_group
from chronoloom.functions.buckets import from_ns
from chronoloom.plans.query import run_query
from chronoloom.plans.rollup import answer, build_rollup, choose_level, merge_rollup, query_rollup
from chronoloom.plans.spec import Group
from chronoloom.sources.api import Api, finite, serve
from chronoloom.sources.log import CommitLostError
from chronoloom.sources.store import part_of
from chronoloom.streaming import ingest


DAY = 86_400_000_000_000


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "root"))
    s.create_db("t")
    return s


#: The example of a bulk insert and a query that the outer interface documents.
EXAMPLE = [{"index": "index1", "time": "2016-08-28T21:24:00Z", "value": {"open": 10.1, "close": 10.2}}]
EXAMPLE_QUERY = {"index": "index1", "from": "2016-08-01T08:00:00Z", "to": "2016-08-31T18:00:59Z", "group": "2minutes", "fields": {"open": {"reducer": "avg"}}}


def row(index, time, **value):
    return {"index": index, "time": time, "value": value}


def ask(store, group, reducers, index="s", start="2016-01-01T00:00:00Z", end="2017-01-01T00:00:00Z"):
    rows = store.query("t", {"index": index, "from": start, "to": end, "group": group, "fields": {f: {"reducer": r} for f, r in reducers.items()}}).collect()
    return [(r.bucket_start.strftime("%m-%d %H:%M:%S"), *(r[f] for f in reducers)) for r in rows]


def test_groups():
    assert parse_group("5minutes") == Group(5, "minute") and parse_group("minute") == parse_group("1minutes") == Group(1, "minute")
    assert parse_group("") == parse_group(None) == Group(1, "year")
    for bad in ("5", "0hours", "5weeks", "x", "-1day", "1.5hours"):
        with pytest.raises(BadGroupError):
            parse_group(bad)
    us = lambda *a: int((dt.datetime(*a) - dt.datetime(1970, 1, 1)).total_seconds()) * 10**6
    assert Group(7, "month").floor_us(us(1995, 6, 17)) == us(1995, 2, 1)
    assert Group(1, "day").floor_us(-1) == -86_400_000_000
    assert Group(1, "hour").nests_in(Group(6, "hour")) and not Group(5, "hour").nests_in(Group(12, "hour")) and Group(1, "day").nests_in(Group(3, "month")) and not Group(1, "month").nests_in(Group(30, "day"))


def test_reducers_of_one_bucket(store):
    store.put("t", [row("s", "2016-08-28T09:00:00Z", a=1), row("s", "2016-08-28T09:00:20Z", a=5), row("s", "2016-08-28T09:00:40Z", a=3)])
    for reducer, want in {"sum": 9, "max": 5, "min": 1, "first": 1, "last": 3, "count": 3, "avg": 3, "ma": 3}.items():
        assert ask(store, "minute", {"a": reducer}) == [("08-28 09:00:00", want)]
    with pytest.raises(BadReducerError):
        ask(store, "minute", {"a": "median"})


def test_sparse_fields_and_missing_ones(store):
    store.put("t", json.dumps([row("s", "2016-08-28T09:00:00Z", a=1), row("s", "2016-08-28T09:00:10Z", a=2, b=7), row("s", "2016-08-28T09:00:20Z", b=8)]))
    assert ask(store, "minute", {"a": "last", "b": "first"}) == [("08-28 09:00:00", 2, 7)]
    assert ask(store, "minute", {"a": "count", "z": "min"}) == [("08-28 09:00:00", 2, 0.0)]


def test_upsert_replaces_the_whole_map(store):
    store.put("t", [row("s", "2016-08-28T09:00:00Z", a=1, b=2), row("s", "2016-08-28T09:00:00Z", a=3, c=4)])
    assert store.get("t", "s", "2016-08-28T09:00:00Z") == {"a": 3.0, "c": 4.0}
    store.put("t", [row("s", "2016-08-28T09:00:00Z", a=9)])
    assert store.get("t", "s", "2016-08-28T09:00:00Z") == {"a": 9.0}
    assert store.get("t", "s", "2016-08-28T09:00:00Z", "a") == 9.0 and store.get("t", "s", "2016-08-28T09:00:00Z", "b") is None
    assert store.get("t", "s", "2016-08-28T09:00:01Z") is None and store.get("t", "none", "2016-08-28T09:00:00Z") is None


def test_out_of_order_and_mixed_depth(store):
    store.put("t", [row("s", "2016-01-01T09:00:00Z", a=1), row("s", "2016-01-01T10:00:00Z", a=2)])
    store.put("t", [row("s", "2016-01-01T09:30:00Z", a=4), row("s", "2016-01-02T00:00:00Z", a=2), row("s", "2016-01-02T03:04:05Z", a=4)])
    assert ask(store, "hour", {"a": "sum"}, end="2016-01-02T00:00:00Z") == [("01-01 09:00:00", 5), ("01-01 10:00:00", 2)]
    assert ask(store, "day", {"a": "sum"}) == [("01-01 00:00:00", 7), ("01-02 00:00:00", 6)]


def test_ranges_and_widths(store):
    store.put("t", [row("s", f"2016-01-01T09:0{m}:00Z", a=m) for m in range(6)] + [row("s", "2016-01-01T09:00:01Z", a=7)])
    at = lambda a, b, g: [r[0][-8:] for r in ask(store, g, {"a": "count"}, start=f"2016-01-01T{a}Z", end=f"2016-01-01T{b}Z")]
    assert at("09:00:00", "09:02:00", "minute") == ["09:00:00", "09:01:00"]
    assert at("09:00:30", "09:01:00", "minute") == ["09:00:00"]
    assert at("09:00:00", "09:01:00", "1second") == ["09:00:00", "09:00:01"]
    assert at("09:00:00", "10:00:00", "5minutes") == ["09:00:00", "09:05:00"]


@pytest.mark.parametrize("bounds, left", [(("2016-01-02T00:00:00Z", "2016-01-07T00:00:00Z"), [1, 9]), (("2016-01-20T00:00:00Z", "2016-01-21T00:00:00Z"), [1, 3, 5, 9]), (("2016-01-03T00:00:00Z", "2016-01-05T00:00:00Z"), [1, 5, 9]), (("2016-01-05T00:00:00Z", "2016-01-05T00:00:00Z"), [1, 3, 5, 9])])
def test_range_delete(store, bounds, left):
    store.put("t", [row("s", f"2016-01-0{d}T00:00:00Z", a=d) for d in (1, 3, 5, 9)] + [row("o", "2016-01-03T00:00:00Z", a=1)])
    store.delete("t", "s", *bounds)
    assert [r.value["a"] for r in store.scan("t", "s").collect()] == left
    assert store.scan("t", "o").count() == 1
    store.put("t", [row("s", "2016-01-03T00:00:00Z", a=33)])
    assert 33 in [r.value["a"] for r in store.scan("t", "s").collect()]
    before = store.points("t").count()
    store.compact("t")
    live = store._live("t")
    assert store.points("t").count() == before and all(len(b) == 1 for b in live.batches.values()) and not live.deletes
    assert "Window" not in store.points("t")._jdf.queryExecution().toString() and store.compact("t") is None
    assert store.vacuum("t") == 0 and store.vacuum("t", 0) > 0 and store.points("t").count() == before
    with pytest.raises(BadTimeError):
        store.delete("t", "s", None, "2016-01-05T00:00:00Z")


def test_nanoseconds_and_wide_counts(store, spark):
    ns = 1_456_789_000_000_000_000
    rows = spark.createDataFrame([("n", ns, {"a": 1.0}, 0), ("n", ns + 1, {"a": 2.0}, 0), ("n", -1500, {"a": 3.0}, 0)], "index_name string, ts_ns long, value map<string,double>, pos long")
    store.append("t", rows)
    assert store.get("t", "n", ns) == {"a": 1.0} and store.get("t", "n", ns + 1) == {"a": 2.0}
    assert spark.range(1).select(F.unix_micros(from_ns(F.lit(-1500)).cast("timestamp"))).first()[0] == -2
    many = spark.range(65_537).select(F.lit("big").alias("index_name"), (F.lit(ns) + F.col("id") * 1_000_000).alias("ts_ns"), F.create_map(F.lit("a"), F.lit(1.0)).alias("value"), F.lit(0).alias("pos"))
    store.append("t", many)
    assert ask(store, "year", {"a": "count"}, "big") == [("01-01 00:00:00", 65_537.0)] and ask(store, "day", {"a": "avg"}, "big")[0][1] == 1.0


def test_bad_rows_are_reported_and_the_rest_is_stored(store):
    done = store.put("t", [row("s", "not a time", a=1), {"index": "s", "time": "2016-01-01T00:00:00Z", "value": {"a": "x"}}, row("s", "2016-01-01T00:00:00Z", a=1), {"time": "2016-01-01T00:00:00Z", "value": {}}, {}])
    assert done.accepted == 1 and sorted(r.reason for r in done.rejected.collect()) == ["no index", "no index", "time: unreadable", "value: not an object of numbers"]
    for body in ("{", "{}", "[1]"):
        with pytest.raises(MalformedBodyError):
            store.put("t", body)


def test_catalogue(store):
    assert store.list_dbs() == ["t"] and store.db_info("t")["name"] == "t"
    with pytest.raises(DatabaseExistsError):
        store.create_db("t")
    with pytest.raises(DatabaseNotFoundError):
        store.points("nope")
    assert store.points("t").count() == 0 and ask(store, "day", {"a": "sum"}) == []
    store.put("t", [row("x", "2016-01-01T00:00:00Z", a=1), row("y", "2016-01-01T00:00:00Z", a=1)])
    store.drop_index("t", "x")
    assert [r.index_name for r in store.list_indexes("t").collect()] == ["y"]
    store.drop_db("t")
    assert store.list_dbs() == []


def test_routes(store):
    api = Api(store)
    assert api.handle("PUT", "/db0")[0] == 201 and api.handle("PUT", "/db0")[0] == 409
    assert api.handle("GET", "/")[1]["engine"] == "chronoloom" and api.handle("GET", "/_all_dbs") == (200, ["db0", "t"]) and api.handle("GET", "/db0")[1]["name"] == "db0"
    body = json.dumps(EXAMPLE)
    assert api.handle("POST", "/db0", body) == (200, {"accepted": 1, "rejected": []})
    query = json.dumps(EXAMPLE_QUERY)
    assert api.handle("POST", "/db0/_query", query) == (200, [{"Timestamp": 1_472_419_440_000_000_000, "Value": {"open": 10.1}}])
    assert api.handle("GET", "/db0/index1/2016-08-28T21:24:00Z") == (200, {"open": 10.1, "close": 10.2}) and api.handle("GET", "/db0/index1/open/2016-08-28T21:24:00Z") == (200, 10.1)
    assert api.handle("GET", "/db0/index1/2016-08-28T21:24:01Z")[0] == 404 and api.handle("GET", "/db0/index1/soon")[0] == 400
    assert api.handle("DELETE", "/db0/index1")[0] == 201 and api.handle("DELETE", "/db0/index1", "{}")[0] == 400
    assert api.handle("DELETE", "/db0/index1", json.dumps({"from": "2016-08-01T00:00:00Z", "to": "2016-09-01T00:00:00Z"}))[0] == 201
    assert api.handle("GET", "/db0/index1/2016-08-28T21:24:00Z")[0] == 404
    assert api.handle("DELETE", "/db0/index1/_all")[0] == 201 and api.handle("DELETE", "/db0/_all")[0] == 201 and api.handle("PATCH", "/db0")[0] == 400 and api.handle("GET", "/none")[0] == 404
    server = serve(api, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/_all_dbs") as answer:
        assert json.load(answer) == ["t"]
    server.shutdown()


@pytest.fixture(scope="module")
def points(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("index_name"), ((F.col("id") * 7_919_000 % 40_000_000) * 100_000_000 + 1_700_000_000_000_000_000).alias("ts_ns"), (F.col("id") % 17).cast("double").alias("v"))
    return rows.withColumns({"ts": from_ns(F.col("ts_ns")), "value": F.create_map(F.lit("x"), F.col("v"))}).drop("v").dropDuplicates(["index_name", "ts_ns"]).cache()


@pytest.mark.parametrize("level, group", [("minute", "5minutes"), ("minute", "hour"), ("hour", "day"), ("day", "month"), ("day", "year"), ("month", "3months")])
def test_rollups_answer_as_points_do(points, level, group):
    for reducer in ("sum", "min", "max", "first", "last", "count", "avg"):
        spec = QuerySpec({"x": reducer, "none": reducer}, parse_group(group), ("a",), 1_700_000_000_000_000_000)
        want = [tuple(r) for r in run_query(points, spec).collect()]
        got = [tuple(r) for r in query_rollup(build_rollup(points, level), spec, level).collect()]
        assert len(got) == len(want) > 0
        assert all(g[:2] == w[:2] and g[2:] == pytest.approx(w[2:]) for g, w in zip(got, want))


def test_rollup_of_rollup_and_choice(points):
    key = lambda df: sorted(tuple(r) for r in df.select("index_name", "bucket_start", "field_name", "sum", "min", "max", "first", "last", "count").collect())
    assert key(merge_rollup(merge_rollup(build_rollup(points, "minute"), Group(1, "hour")), Group(1, "day"))) == key(build_rollup(points, "day"))
    spec = QuerySpec({"x": "sum"}, parse_group("6hours"), None, None, 1_700_006_400_000_000_000)
    assert choose_level(spec) == "hour" and choose_level(QuerySpec({"x": "sum"}, parse_group("month"))) == "month"
    assert choose_level(QuerySpec({"x": "sum"}, parse_group("30seconds"))) is None and choose_level(QuerySpec({"x": "sum"}, parse_group("day"), to_ns=1)) is None
    assert answer(points, build_rollup(points, "hour"), spec, ("hour",)).collect() == run_query(points, spec).collect()


def test_plan_prunes_and_pushes_down(spark, store, points):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    store.append("t", points.withColumn("pos", F.lit(0)))
    spec = QuerySpec({"x": "sum"}, parse_group("hour"), ("a",), 1_700_000_000_000_000_000, 1_700_100_000_000_000_000)
    plan = store.query("t", spec)._jdf.queryExecution().toString()
    pruned, pushed = plan[plan.index("PartitionFilters") :].split("PushedFilters")
    assert "part#" in pruned and "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed and "EqualTo(index_name,a)" in pushed


def test_streams(spark, store, tmp_path, points):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for k in range(3):
        (inbox / f"{k}.json").write_text("\n".join(json.dumps(row("s", f"2016-01-01T0{k}:0{m}:00Z", a=m)) for m in range(4)) + '\n{"index": "s", "time": "never", "value": {}}\n')
    rejected = []
    rows = ingest.read_rows(spark, str(inbox), 1)
    for _ in range(2):  # again: nothing is new, nothing counts twice
        ingest.into_store(rows, store, "t", str(tmp_path / "cp"), lambda df, k: rejected.append(df.count())).trigger(availableNow=True).start().awaitTermination()
    assert store.points("t").count() == 12 and rejected == [1, 1, 1]
    points.drop("v").write.parquet(str(tmp_path / "points"))
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "points"))
    ingest.into_rollup(stream, str(tmp_path / "rollup"), "hour", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted(tuple(r) for r in df.select("index_name", "bucket_start", "sum", "first", "last", "count").collect())
    assert key(ingest.read_rollup(spark, str(tmp_path / "rollup"), "hour")) == key(build_rollup(points, "hour"))


def frame(spark, *rows):
    return spark.createDataFrame([(i, ns, v, 0) for i, ns, v in rows], "index_name string, ts_ns long, value map<string,double>, pos long")


def test_two_streams_and_replays(spark, store, tmp_path):
    for name in ("x", "y"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "0.json").write_text(json.dumps(row(name, "2016-01-01T00:00:00Z", a=1)) + "\n")
        ingest.into_store(ingest.read_rows(spark, str(tmp_path / name), 1), store, "t", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start().awaitTermination()
    assert {r.index_name for r in store.points("t").collect()} == {"x", "y"}
    # A stream that begins anew from an empty checkpoint is another stream: its batches count.
    (tmp_path / "x" / "1.json").write_text(json.dumps(row("x", "2016-01-02T00:00:00Z", a=2)) + "\n")
    ingest.into_store(ingest.read_rows(spark, str(tmp_path / "x"), 1), store, "t", str(tmp_path / "cp-again")).trigger(availableNow=True).start().awaitTermination()
    assert store.points("t").count() == 3
    # A batch that was published before its stream could note it is not written again, so a later delete holds.
    store.ingest("t", spark.createDataFrame([("z", "2016-01-01T00:00:00Z", '{"a": 1}', 0)], "index string, time string, value string, pos long"), "s/7")
    store.delete("t", "z", "2016-01-01T00:00:00Z", "2016-01-02T00:00:00Z")
    assert store.done("t", "s/7") and not store.done("t", "s/8") and store.get("t", "z", "2016-01-01T00:00:00Z") is None


def test_commits_survive_crashes_and_competition(spark, store):
    log = store._log("t")
    lost = log.claim()  # a writer that died before it wrote, and one that died after
    dead = log.claim()
    frame(spark, ("s", 1, {"a": 1.0})).withColumn("part", F.lit(0)).write.partitionBy("part").parquet(f"{store.root}/t/data/batch={dead}")
    assert store.points("t").count() == 0
    n = store.append("t", frame(spark, ("s", 2, {"a": 2.0})))
    assert n > dead > lost and store.points("t").count() == 1
    # Of many writers at once each has a number of its own.
    taken = []
    threads = [threading.Thread(target=lambda: taken.extend(Store(spark, store.root)._log("t").claim() for _ in range(5))) for _ in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert len(set(taken)) == 40
    # A number is published once, and not by a claim that was never made.
    for n in (n, 10_000):
        with pytest.raises(CommitLostError):
            log.publish(n, {"kind": "points", "parts": []})


def test_put_and_delete_at_once_have_an_order(spark, store):
    store.append("t", frame(spark, ("s", 1, {"a": 1.0})))
    log = store._log("t")
    put = log.claim()
    store.delete("t", "s", 0, 10)  # later by its number, though published first
    assert store.points("t").count() == 0
    store.compact("t")
    assert store._live("t").deletes  # the put could still come before it
    store._write("t", put, frame(spark, ("s", 2, {"a": 2.0})).select("index_name", "ts_ns", from_ns(F.col("ts_ns")).alias("ts"), "value", F.lit(put).cast("long").alias("commit"), F.lit(part_of("s")).alias("part")), {"kind": "points"})
    assert store.points("t").count() == 0
    store.append("t", frame(spark, ("s", 3, {"a": 3.0})))
    store.compact("t")
    assert [r.ts_ns for r in store.points("t").collect()] == [3] and not store._live("t").deletes


def test_compactions_at_once(spark, store):
    for k in range(3):
        store.append("t", frame(spark, ("s", 1, {"a": float(k)}), ("s", 10 + k, {"a": 1.0})))
    live = store._live("t")
    first = store.compact("t")
    stale = store._log("t").claim()
    rows = store._resolved("t", live, parts={part_of("s")})
    store._write("t", stale, rows, {"kind": "compact", "replaces": {str(part_of("s")): sorted(live.batches[part_of("s")])}, "drops": []})
    assert store._live("t").batches == {part_of("s"): {first}} and store.points("t").count() == 4


def test_parts_are_those_of_the_engine(spark):
    names = ["", "a", "click", "é日本", "x" * 100, "k.site-1.u7"]
    got = spark.createDataFrame([(n,) for n in names], "i string").select(F.pmod(F.xxhash64("i"), F.lit(64))).collect()
    assert [part_of(n) for n in names] == [r[0] for r in got]


def test_nested_databases_and_odd_values(spark, store):
    store.create_db("plant/line1")
    store.put("plant/line1", [row("s", "2016-01-01T00:00:00Z", a=1)])
    assert store.list_dbs() == ["plant/line1", "t"] and store.list_indexes("plant/line1").count() == 1
    with pytest.raises(DatabaseNotFoundError):
        store.points("plant")
    done = store.put("t", '[{"index": "s", "time": "2016-01-01T00:00:00Z", "value": {"a": NaN}}, {"index": "s", "time": "2016-01-01T00:00:00Z", "value": {"a": 1e999}}]')
    assert done.accepted == 0 and done.rejected.count() == 2
    api = Api(store)
    assert [api.handle("DELETE", "/t/s", b)[0] for b in ("[1]", "3", '{"from": 1, "to": 2}', "{")] == [400] * 4
    assert finite({"a": [float("nan"), {"b": float("inf")}, 1.0]}) == {"a": [None, {"b": None}, 1.0]}


def _same(got, want):
    got, want = [tuple(r) for r in got.collect()], [tuple(r) for r in want.collect()]
    assert len(got) == len(want) and all(g[:2] == w[:2] and g[2:] == pytest.approx(w[2:]) for g, w in zip(got, want))
    return len(got)


def test_stored_rollups_answer_as_points_do(spark, store, points):
    """Through puts, corrections and deletes, before and after each refresh."""
    fields = {f"{f}_{r}": (f, r) for f in ("x", "y") for r in ("sum", "min", "max", "first", "last", "count", "avg", "ma")}
    t0 = 1_700_000_000_000_000_000
    specs = [QuerySpec(fields, parse_group(g), names, a, b) for g, names, a, b in (("hour", ("a",), t0, t0 + 10**15 + 777), ("day", None, None, None), ("90minutes", ("a", "b", "none"), t0 + 5, None), ("month", None, None, t0 + 2 * 10**15 + 1), ("year", ("b",), t0, t0 + 4 * 10**15))]

    def check(rows):
        assert sum(_same(store.query("t", s), store.query("t", s, rollups=False)) for s in specs) >= rows

    store.append("t", points.withColumn("pos", F.lit(0)))
    assert store.refresh_rollups("t") and store.refresh_rollups("t") is None
    check(100)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = store.query("t", specs[1])._jdf.queryExecution().toString()
    assert "level=day" in plan and "/data/" not in plan
    store.append("t", frame(spark, ("a", t0 + 3_600_000_000_000, {}), ("a", t0 + 40 * DAY, {"y": 4.0}), ("c", t0, {"x": 1.0, "y": -2.0})))
    store.append("t", points.where("index_name = 'a'").limit(20).select("index_name", "ts_ns", F.create_map(F.lit("y"), F.lit(2.5)).alias("value"), F.lit(0).alias("pos")))
    check(100)
    store.delete("t", "b", t0, t0 + 2 * DAY + 5)
    store.drop_index("t", "c")
    check(100)
    assert store.refresh_rollups("t")
    check(100)
    store.append("t", frame(spark, ("c", t0, {"x": 3.0})))
    store.compact("t")
    check(100)
    assert store.refresh_rollups("t") and store.refresh_rollups("t", rebuild=True)
    assert store.vacuum("t", 0) >= 3  # the rollups that the last one replaced, and what was compacted
    check(100)


def test_watermarked_windows(spark, tmp_path, points):
    points.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in")).select("index_name", F.col("ts").cast("timestamp").alias("ts"), "ts_ns", F.explode("value").alias("field_name", "v"))
    ingest.windowed(stream, Group(1, "hour"), "1 second").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    # All came in one batch, so none was late; buckets that end before the watermark are out, each once and as in the rollup.
    got = {(r.index_name, r.field_name, r.bucket_start): (r.sum, r["min"], r["max"], r["first"], r.last, r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz")).collect()}
    newest = points.agg(F.max("ts")).first()[0]
    want = {(r.index_name, r.field_name, r.bucket_start): (r.sum, r["min"], r["max"], r["first"], r.last, r["count"]) for r in build_rollup(points, "hour").collect() if r.bucket_start + dt.timedelta(hours=1) <= newest - dt.timedelta(seconds=1)}
    assert got == want and len(want) > 100
    # A point older than the watermark is dropped, one within it counts.
    more = points.limit(1).select(F.lit("a").alias("index_name"), F.explode(F.array(F.lit(newest), F.lit(newest - dt.timedelta(days=30)))).alias("ts"), F.lit(1).cast("long").alias("ts_ns"), F.create_map(F.lit("x"), F.lit(5.0)).alias("value"))
    more.unionByName(more.limit(1).withColumn("ts", F.col("ts") + F.expr("interval 3 hours"))).select(points.columns).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.windowed(stream, Group(1, "hour"), "1 second").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.groupBy("index_name", "field_name", "bucket_start").count().where("count > 1").count() == 0
    assert out.agg(F.sum("count")).first()[0] == points.count() + 1
    with pytest.raises(ValueError):
        ingest.windowed(stream, Group(1, "month"), "1 day")
