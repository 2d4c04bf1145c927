"""Registered queries of the storage and query engine, each with the SQL that gives the same rows.

Driver tables are read as series: ``events`` by event_type, ``orders`` by priority, ``lineitem`` by return flag. Sums and
averages are rounded to six digits, as the order of addition differs between engines. Rows are compared as sets, so only
the queries through the store sort them.
"""

from __future__ import annotations

import http.client
import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.buckets import bucket_start, level_of, micros
from chronoloom.operators.readings import standing
from chronoloom.plans.query import run_query
from chronoloom.plans.rollup import query_rollup
from chronoloom.plans.spec import Group, QuerySpec, parse_group, parse_ns
from chronoloom.session import scratch_folder
from chronoloom.sources.api import Api, serve
from chronoloom.sources.store import Store
from chronoloom.streaming.ingest import into_rollup, into_store, read_rollup, read_rows, windowed

ALL = {"sum_v": "sum", "max_v": "max", "min_v": "min", "first_v": "first", "last_v": "last", "count_v": "count", "avg_v": "avg"}
UNTIED = {k: v for k, v in ALL.items() if v not in ("first", "last")}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rounded(df: DataFrame, keep: tuple[str, ...] = ("index_name", "bucket_start")) -> DataFrame:
    return df.select(*keep, *(F.round(c, 6).alias(c) for c in df.columns if c not in keep))


def _events(spark: SparkSession, d: str, fields: dict[str, str], group: str, **bounds) -> DataFrame:
    spec = QuerySpec(fields, parse_group(group), **bounds)
    return _rounded(run_query(_table(spark, d, "events"), spec, index="event_type", order=F.struct("ts", "event_id"), value=lambda _: F.col("value"), sort=False))


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Events as standing points with maps."""
    return _table(spark, d, "events").select(F.col("event_type").alias("index_name"), "ts", (micros(F.col("ts")) * 1000).alias("ts_ns"), F.create_map(F.lit("value"), "value").alias("value"))


_FIRST, _LAST = "arg_min(value, (ts, event_id))", "arg_max(value, (ts, event_id))"
_SQL = {"sum_v": "round(sum(value), 6)", "max_v": "max(value)", "min_v": "min(value)", "first_v": _FIRST, "last_v": _LAST, "count_v": "CAST(count(value) AS DOUBLE)", "avg_v": "round(avg(value), 6)", "ma_v": "round(avg(value), 6)"}


def _events_sql(bucket: str, fields, where: str = "") -> str:
    return f"SELECT event_type AS index_name, CAST({bucket} AS TIMESTAMP) AS bucket_start, {', '.join(f'{_SQL[f]} AS {f}' for f in fields)} FROM events {where} GROUP BY 1, 2"


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

for _unit in ("second", "minute", "hour", "day"):
    QUERIES[f"group_{_unit}"] = lambda s, d, u=_unit: _events(s, d, ALL, u)
    ORACLE_SQL[f"group_{_unit}"] = _events_sql(f"date_trunc('{_unit}', ts)", ALL)
for _group, _interval in (("5minutes", "5 minutes"), ("36hours", "36 hours"), ("7days", "7 days")):
    QUERIES[f"group_{_group}"] = lambda s, d, g=_group: _events(s, d, ALL, g)
    ORACLE_SQL[f"group_{_group}"] = _events_sql(f"time_bucket(INTERVAL '{_interval}', ts, TIMESTAMP '1970-01-01')", ALL)


def _orders(spark: SparkSession, d: str, group: str) -> DataFrame:
    return _rounded(run_query(_table(spark, d, "orders"), QuerySpec(UNTIED, parse_group(group)), index="o_orderpriority", ts="o_orderdate", order=F.col("o_orderkey"), value=lambda _: F.col("o_totalprice"), sort=False))


def _orders_sql(bucket: str) -> str:
    return f"SELECT o_orderpriority AS index_name, CAST({bucket} AS TIMESTAMP) AS bucket_start, " + ", ".join(f"{_SQL[f].replace('value', 'o_totalprice')} AS {f}" for f in UNTIED) + " FROM orders GROUP BY 1, 2"


for _group, _bucket in (("month", "date_trunc('month', o_orderdate)"), ("year", "date_trunc('year', o_orderdate)"), ("3months", "time_bucket(INTERVAL '3 months', o_orderdate, TIMESTAMP '1970-01-01')"), ("7months", "time_bucket(INTERVAL '7 months', o_orderdate, TIMESTAMP '1970-01-01')"), ("2years", "time_bucket(INTERVAL '24 months', o_orderdate, TIMESTAMP '1970-01-01')")):
    QUERIES[f"group_{_group}"] = lambda s, d, g=_group: _orders(s, d, g)
    ORACLE_SQL[f"group_{_group}"] = _orders_sql(_bucket)
QUERIES["group_default"] = lambda s, d: _orders(s, d, "")
ORACLE_SQL["group_default"] = _orders_sql("date_trunc('year', o_orderdate)")

for _reducer in ("sum", "max", "min", "first", "last", "count", "avg", "ma"):
    QUERIES[f"reduce_{_reducer}"] = lambda s, d, r=_reducer: _events(s, d, {f"{r}_v": r}, "day")
    ORACLE_SQL[f"reduce_{_reducer}"] = _events_sql("date_trunc('day', ts)", [f"{_reducer}_v"])

_FROM, _TO = "2024-01-05T10:20:30Z", "2024-01-12T16:00:00Z"


def range_query(spark: SparkSession, d: str) -> DataFrame:
    """One series, from floored to its bucket, to exclusive; both bounds and the series reach the scan."""
    return _events(spark, d, ALL, "6hours", index_names=("click",), from_ns=parse_ns(_FROM), to_ns=parse_ns(_TO))


def multi_series(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, UNTIED, "day", index_names=("click", "view"))


def multi_field(spark: SparkSession, d: str) -> DataFrame:
    fields = {"l_quantity": "sum", "l_extendedprice": "avg", "l_discount": "max", "l_tax": "min"}
    return _rounded(run_query(_table(spark, d, "lineitem"), QuerySpec(fields, parse_group("month")), index="l_returnflag", ts="l_shipdate", order=F.col("l_orderkey"), value=F.col, sort=False))


def missing_field_default(spark: SparkSession, d: str) -> DataFrame:
    spec = QuerySpec({"value": "max", "other": "sum", "none": "last"}, parse_group("day"))
    return run_query(_points(spark, d), spec, sort=False)


def upsert_lww(spark: SparkSession, d: str) -> DataFrame:
    """Events keyed by type and minute: the last written stands, whole."""
    rows = _table(spark, d, "events").select(F.col("event_type").alias("index_name"), bucket_start(F.col("ts"), Group(1, "minute")).alias("ts"), "event_id", "value")
    return standing(rows, ("index_name", "ts"), "event_id", ("value",))


def standing_posts(spark: SparkSession, d: str) -> DataFrame:
    rows = standing(_table(spark, d, "posts"))
    return rows.select("index_name", "ts", "post_id", F.coalesce(F.size("value"), F.lit(-1)).cast("int").alias("n_fields"))


def _stored(spark: SparkSession, d: str) -> Store:
    store = Store(spark, scratch_folder(spark))
    store.create_db("bench")
    store.append("bench", _points(spark, d).withColumn("pos", F.lit(0)))
    return store


#: Stores by application and directory, for queries that only read: as in use, they and their rollups are written once.
_KEPT: dict[tuple[str, str], Store] = {}


def _kept(spark: SparkSession, d: str) -> Store:
    key = (spark.sparkContext.applicationId, d)
    if key not in _KEPT:
        store = _stored(spark, d)
        store.refresh_rollups("bench")
        _KEPT[key] = store
    return _KEPT[key]


def point_get(spark: SparkSession, d: str) -> DataFrame:
    """Each series' first and last point by its exact time, one by the whole map and one by its field; and a time without a point."""
    store = _kept(spark, d)
    ends = _points(spark, d).groupBy("index_name").agg(F.min("ts_ns").alias("first"), F.max("ts_ns").alias("last")).collect()
    rows = [(r.index_name, r.first, store.get("bench", r.index_name, r.first)["value"]) for r in ends]
    rows += [(r.index_name, r.last, store.get("bench", r.index_name, r.last, "value")) for r in ends]
    rows += [(r.index_name, r.first - 1, store.get("bench", r.index_name, r.first - 1)) for r in ends]
    return spark.createDataFrame(rows, "index_name string, ts_ns long, value double")


def put_json(spark: SparkSession, d: str) -> DataFrame:
    """A bulk insert of all nations as JSON, with rows that can't be stored: what was stored, and what was rejected why."""
    store = Store(spark, scratch_folder(spark))
    store.create_db("nations/all")
    good = [{"index": f"region {r.n_regionkey}", "time": f"2020-01-01T00:00:{r.n_nationkey:02d}Z", "value": {"key": r.n_nationkey, "size": len(r.n_name)}} for r in _table(spark, d, "nation").collect()]
    bad = [{"index": "", "time": "2020-01-01T00:00:00Z", "value": {}}, {"index": "x", "time": "soon", "value": {"a": 1}}, {"index": "x", "time": "2020-01-01T00:00:00Z", "value": {"a": "b"}}]
    done = store.put("nations/all", json.dumps(good + bad))
    stored = store.points("nations/all").select("index_name", "ts_ns", F.col("value")["key"].alias("key"), F.col("value")["size"].alias("size"), F.lit("").alias("reason"))
    lost = done.rejected.select("index_name", F.lit(0).cast("long").alias("ts_ns"), F.lit(0.0).alias("key"), F.lit(0.0).alias("size"), "reason")
    return stored.unionByName(lost)


def _json_files(spark: SparkSession, d: str, at: str, where: str = "true") -> None:
    rows = _points(spark, d).where(where)
    rows.select(F.col("index_name").alias("index"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("time"), "value").write.json(at)


def put_files(spark: SparkSession, d: str) -> DataFrame:
    """A bulk insert of all events from JSON files."""
    at = scratch_folder(spark)
    _json_files(spark, d, f"{at}/files")
    store = Store(spark, f"{at}/root")
    store.create_db("bench")
    store.put_files("bench", f"{at}/files")
    return store.points("bench").select("index_name", "ts_ns", F.col("value")["value"].alias("value"))


def stream_store(spark: SparkSession, d: str) -> DataFrame:
    """All events after two streams of JSON files brought them into one database, each run twice."""
    at = scratch_folder(spark)
    store = Store(spark, f"{at}/root")
    store.create_db("bench")
    for name, where in (("views", "index_name = 'view'"), ("others", "index_name <> 'view'")):
        _json_files(spark, d, f"{at}/{name}", where)
        for _ in range(2):
            into_store(read_rows(spark, f"{at}/{name}"), store, "bench", f"{at}/checkpoint-{name}").trigger(availableNow=True).start().awaitTermination()
    return store.points("bench").select("index_name", "ts_ns", F.col("value")["value"].alias("value"))


def store_query(spark: SparkSession, d: str) -> DataFrame:
    """The JSON form of a query against a store that was written and corrected."""
    store = _stored(spark, d)
    store.append("bench", _corrected(spark, d))
    return _rounded(store.query("bench", _VIEW_BODY))


def rollup_corrected(spark: SparkSession, d: str) -> DataFrame:
    """The same from stored rollups that are older than the correction, and from points for the days that it touched and the last, cut day."""
    store = _stored(spark, d)
    store.refresh_rollups("bench")
    store.append("bench", _corrected(spark, d))
    return _rounded(store.query("bench", _VIEW_BODY))


_VIEW_BODY = {"index": "view", "from": _FROM, "to": _TO, "group": "1day", "fields": {"value": {"reducer": "sum"}, "n": {"reducer": "count"}}}


def _corrected(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).where("index_name = 'view' AND value['value'] > 50").withColumns({"value": F.create_map(F.lit("value"), F.lit(1.0)), "pos": F.lit(0)})


def delete_range(spark: SparkSession, d: str) -> DataFrame:
    store = _stored(spark, d)
    store.delete("bench", "click", _FROM, _TO)
    return store.points("bench").select("index_name", "ts_ns", F.col("value")["value"].alias("value"))


def drop_index(spark: SparkSession, d: str) -> DataFrame:
    store = _stored(spark, d)
    store.drop_index("bench", "click")
    store.compact("bench")
    return store.points("bench").groupBy("index_name").agg(F.count("*").alias("n_points"))


def list_indexes(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d).list_indexes("bench")


def ordered_scan(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d).scan("bench", "purchase").select("index_name", "ts_ns", F.col("value")["value"].alias("value"))


def last_points(spark: SparkSession, d: str) -> DataFrame:
    """The hundred latest points of a series (a top-k report)."""
    return _kept(spark, d).scan("bench", "purchase", descending=True, limit=100).select("index_name", "ts_ns", F.col("value")["value"].alias("value"))


def _rollup_query(spark: SparkSession, d: str, level: str, group: str) -> DataFrame:
    """Seven reducers of one field from the stored rollup of a finer level."""
    store = _kept(spark, d)
    spec = QuerySpec({k: ("value", r) for k, r in ALL.items()}, parse_group(group))
    return _rounded(query_rollup(store.rollup("bench", level), spec, sort=False))


def rollup_year(spark: SparkSession, d: str) -> DataFrame:
    """Months and years come from the stored days, by the store's own choice of a level."""
    return _rounded(_kept(spark, d).query("bench", QuerySpec({k: ("value", r) for k, r in ALL.items()}, parse_group("year")), sort=False))


def json_field(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "events").select("event_id", F.from_json("props", "map<string,double>").alias("m"))
    return rows.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"))


def levels(spark: SparkSession, d: str) -> DataFrame:
    """How many points have each finest unit of time."""
    points = _table(spark, d, "points").where("ts_ns IS NOT NULL")
    return points.groupBy(level_of(F.col("ts_ns")).alias("level_name")).agg(F.count("*").alias("n_points"))


def stream_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The hourly rollup of all events after they came in as a stream of files."""
    at = scratch_folder(spark)
    events = spark.readStream.schema(_table(spark, d, "events").schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/events.parque[t]")
    points = events.select(F.col("event_type").alias("index_name"), "ts", (micros(F.col("ts")) * 1000).alias("ts_ns"), F.create_map(F.lit("value"), "value").alias("value"))
    into_rollup(points, f"{at}/rollup", "hour", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = read_rollup(spark, f"{at}/rollup", "hour")
    return _rounded(rows.select("index_name", "bucket_start", F.col("sum").alias("sum_v"), F.col("max").alias("max_v"), F.col("min").alias("min_v"), F.col("first").alias("first_v"), F.col("last").alias("last_v"), F.col("count").cast("double").alias("count_v")))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hours of all events as a watermarked stream emits them: those that end before the watermark, each once."""
    at = scratch_folder(spark)
    events = spark.readStream.schema(_table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    cells = events.select(F.col("event_type").alias("index_name"), F.col("ts").cast("timestamp").alias("ts"), (micros(F.col("ts")) * 1000).alias("ts_ns"), F.lit("value").alias("field_name"), F.col("value").alias("v"))
    windowed(cells, Group(1, "hour"), "1 second").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{at}/out").withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))
    return _rounded(rows.select("index_name", "bucket_start", F.col("sum").alias("sum_v"), F.col("max").alias("max_v"), F.col("min").alias("min_v"), F.col("first").alias("first_v"), F.col("last").alias("last_v"), F.col("count").cast("double").alias("count_v")))


_POINT = {"index": "index1", "time": "2016-08-28T21:24:00Z", "value": {"open": 10.1, "close": 10.2}}
_ASK = {"index": "index1", "from": "2016-08-01T08:00:00Z", "to": "2016-08-31T18:00:59Z", "group": "2minutes", "fields": {"open": {"reducer": "avg"}}}
#: Requests to the routes, in order: method, path, body, and the expected status and answer.
_REQUESTS = (
    ("PUT", "/db", None, 201, None),
    ("PUT", "/db", None, 409, {"error": "exists", "reason": "db"}),
    ("GET", "/_all_dbs", None, 200, ["db"]),
    ("POST", "/db", [_POINT, {"index": "index1", "time": "soon", "value": {}}], 200, {"accepted": 1, "rejected": [{"index": "index1", "time": "soon", "reason": "time: unreadable"}]}),
    ("POST", "/db/_query", _ASK, 200, [{"Timestamp": 1_472_419_440_000_000_000, "Value": {"open": 10.1}}]),
    ("POST", "/db/_query", {**_ASK, "group": "5weeks"}, 400, {"error": "BadGroupError", "reason": "unknown group '5weeks': units are second, minute, hour, day, month, year"}),
    ("GET", "/db/index1/2016-08-28T21:24:00Z", None, 200, {"open": 10.1, "close": 10.2}),
    ("GET", "/db/index1/open/2016-08-28T21:24:00Z", None, 200, 10.1),
    ("DELETE", "/db/index1", {"from": "2016-08-28T21:24:00Z", "to": "2016-08-28T21:24:01Z"}, 201, None),
    ("GET", "/db/index1/2016-08-28T21:24:00Z", None, 404, {"error": "not_found", "reason": "no point of index1 at 2016-08-28T21:24:00Z"}),
    ("DELETE", "/db/index1/_all", None, 201, None),
    ("DELETE", "/db/_all", None, 201, None),
    ("GET", "/db", None, 404, {"error": "not_found", "reason": "db"}),
    ("PATCH", "/db", None, 400, {"error": "no_handler", "reason": "Can't handle PATCH to /db"}),
)


def http_routes(spark: SparkSession, d: str) -> DataFrame:
    """Every route over a socket: the status, the answer, and the header that lets any origin read it."""
    server = serve(Api(Store(spark, scratch_folder(spark))), 0)
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    rows = []
    try:
        for k, (method, path, body, _, _) in enumerate(_REQUESTS):
            connection = http.client.HTTPConnection("127.0.0.1", server.server_port)
            connection.request(method, path, None if body is None else json.dumps(body))
            answer = connection.getresponse()
            rows.append((k, method, path, answer.status, answer.read().decode(), answer.headers["Access-Control-Allow-Origin"]))
            connection.close()
    finally:
        server.shutdown()
        server.server_close()
    return spark.createDataFrame(rows, "step int, method string, path string, status int, answer string, origin string")


def _routes_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = [f"({k}, {quoted(m)}, {quoted(p)}, {status}, {quoted('' if answer is None else json.dumps(answer, sort_keys=True))}, '*')" for k, (m, p, _, status, answer) in enumerate(_REQUESTS)]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(step, method, path, status, answer, origin)"


def rollup_tables(spark: SparkSession, d: str) -> DataFrame:
    """Standing rollups merged from days to months, as ``sum`` and ``count`` of each series' first field."""
    rows = standing(_table(spark, d, "rollups").where("level_name = 'day' AND field_name IS NOT NULL"), ("index_name", "field_name", "bucket_start"), "rollup_id", ("sum_v", "min_v", "max_v", "count_v"))
    months = rows.groupBy("index_name", "field_name", bucket_start(F.col("bucket_start"), Group(1, "month")).alias("bucket_start"))
    return months.agg(F.round(F.sum("sum_v"), 4).alias("sum_v"), F.min("min_v").alias("min_v"), F.max("max_v").alias("max_v"), F.sum("count_v").cast("long").alias("count_v"))


QUERIES |= {
    "range_query": range_query, "multi_series": multi_series, "multi_field": multi_field, "missing_field_default": missing_field_default, "point_get": point_get, "upsert_lww": upsert_lww,
    "standing_posts": standing_posts, "store_query": store_query, "delete_range": delete_range, "drop_index": drop_index, "list_indexes": list_indexes, "ordered_scan": ordered_scan,
    "last_points": last_points, "put_json": put_json, "put_files": put_files, "stream_store": stream_store, "rollup_corrected": rollup_corrected, "rollup_year": rollup_year, "stream_windows": stream_windows, "http_routes": http_routes,
    "rollup_hour_from_minute": lambda s, d: _rollup_query(s, d, "minute", "hour"), "rollup_month_from_day": lambda s, d: _rollup_query(s, d, "day", "month"),
    "json_field": json_field, "levels": levels, "stream_rollup": stream_rollup, "rollup_tables": rollup_tables,
}
_NS = "epoch_us(ts) * 1000 AS ts_ns"
ORACLE_SQL |= {
    "range_query": _events_sql("time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01')", ALL, "WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-12 16:00:00'"),
    "multi_series": _events_sql("date_trunc('day', ts)", UNTIED, "WHERE event_type IN ('click', 'view')"),
    "multi_field": "SELECT l_returnflag AS index_name, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS bucket_start, round(sum(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice, max(l_discount) AS l_discount, min(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2",
    "missing_field_default": "SELECT event_type AS index_name, CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket_start, max(value) AS value, 0.0::DOUBLE AS other, 0.0::DOUBLE AS \"none\" FROM events GROUP BY 1, 2",
    "point_get": "WITH e AS (SELECT event_type AS index_name, epoch_us(ts) * 1000 AS ts_ns, value FROM events), m AS (SELECT index_name, min(ts_ns) AS a, max(ts_ns) AS b FROM e GROUP BY 1) SELECT e.* FROM e JOIN m ON e.index_name = m.index_name AND (ts_ns = a OR ts_ns = b) UNION ALL SELECT index_name, a - 1, NULL FROM m",
    "upsert_lww": "SELECT event_type AS index_name, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2",
    "standing_posts": "SELECT index_name, ts, post_id, CAST(CASE WHEN value IS NULL THEN -1 ELSE cardinality(value) END AS INTEGER) AS n_fields FROM (SELECT *, row_number() OVER (PARTITION BY index_name, ts ORDER BY post_id DESC) AS rn FROM posts WHERE index_name IS NOT NULL AND ts IS NOT NULL) WHERE rn = 1",
    "store_query": "SELECT event_type AS index_name, CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket_start, round(sum(CASE WHEN value > 50 THEN 1.0 ELSE value END), 6) AS value, 0.0::DOUBLE AS n FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12 16:00:00' GROUP BY 1, 2",
    "delete_range": f"SELECT event_type AS index_name, {_NS}, value FROM events WHERE NOT (event_type = 'click' AND ts >= TIMESTAMP '2024-01-05 10:20:30' AND ts < TIMESTAMP '2024-01-12 16:00:00')",
    "drop_index": "SELECT event_type AS index_name, count(*) AS n_points FROM events WHERE event_type <> 'click' GROUP BY 1",
    "list_indexes": "SELECT DISTINCT event_type AS index_name FROM events",
    "ordered_scan": f"SELECT event_type AS index_name, {_NS}, value FROM events WHERE event_type = 'purchase' ORDER BY ts",
    "rollup_hour_from_minute": _events_sql("date_trunc('hour', ts)", ALL),
    "rollup_month_from_day": _events_sql("date_trunc('month', ts)", ALL),
    "last_points": f"SELECT event_type AS index_name, {_NS}, value FROM events WHERE event_type = 'purchase' ORDER BY ts DESC LIMIT 100",
    "put_json": "SELECT 'region ' || n_regionkey AS index_name, epoch_us(TIMESTAMP '2020-01-01' + to_seconds(n_nationkey)) * 1000 AS ts_ns, n_nationkey::DOUBLE AS key, length(n_name)::DOUBLE AS size, '' AS reason FROM nation UNION ALL SELECT * FROM (VALUES ('', 0, 0.0, 0.0, 'no index'), ('x', 0, 0.0, 0.0, 'time: unreadable'), ('x', 0, 0.0, 0.0, 'value: not an object of numbers'))",
    "put_files": f"SELECT event_type AS index_name, {_NS}, value FROM events",
    "stream_store": f"SELECT event_type AS index_name, {_NS}, value FROM events",
    "rollup_year": _events_sql("date_trunc('year', ts)", ALL),
    "json_field": "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events",
    "levels": "SELECT CASE WHEN ts_ns % 1000 <> 0 THEN 'nanosecond' WHEN ts_ns % 1000000 <> 0 THEN 'microsecond' WHEN ts_ns % 1000000000 <> 0 THEN 'millisecond' WHEN ts_ns % 60000000000 <> 0 THEN 'second' WHEN ts_ns % 3600000000000 <> 0 THEN 'minute' WHEN ts_ns % 86400000000000 <> 0 THEN 'hour' WHEN day(make_timestamp(ts_ns // 1000)) <> 1 THEN 'day' WHEN month(make_timestamp(ts_ns // 1000)) <> 1 THEN 'month' ELSE 'year' END AS level_name, count(*) AS n_points FROM points WHERE ts_ns IS NOT NULL GROUP BY 1",
    "stream_rollup": _events_sql("date_trunc('hour', ts)", [k for k in ALL if k != "avg_v"]),
    "stream_windows": "SELECT * FROM (" + _events_sql("date_trunc('hour', ts)", [k for k in ALL if k != "avg_v"]) + ") WHERE bucket_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 SECOND",
    "http_routes": _routes_sql(),
    "rollup_tables": "SELECT index_name, field_name, CAST(date_trunc('month', bucket_start) AS TIMESTAMP) AS bucket_start, round(sum(sum_v), 4) AS sum_v, min(min_v) AS min_v, max(max_v) AS max_v, CAST(sum(count_v) AS BIGINT) AS count_v FROM (SELECT *, row_number() OVER (PARTITION BY index_name, field_name, bucket_start ORDER BY rollup_id DESC) AS rn FROM rollups WHERE level_name = 'day' AND index_name IS NOT NULL AND field_name IS NOT NULL AND bucket_start IS NOT NULL) WHERE rn = 1 GROUP BY 1, 2, 3",
}
ORACLE_SQL["rollup_corrected"] = ORACLE_SQL["store_query"]
