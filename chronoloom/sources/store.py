"""A database of series as an append-only log of Parquet files.

``<root>/<db>/log/`` says what each commit did (see ``log``), ``data/batch=<n>/part=<k>/`` holds the points of commit n,
``days/batch=<n>/`` the series and days that it touched, and ``rollups/batch=<n>/`` pre-aggregates. Points are spread by a
hash of their series over ``PARTS`` directories and sorted by series and time within files: a query on one series reads
one directory of each live batch and, by the files' statistics, few row groups. Within a batch each (series, ns) is once.
Resolution keeps, for each (series, ns), the latest commit's map - whole, never merged field by field - unless a later
delete covers it; a part that only one live batch holds, as after ``compact``, is read without any shuffle.

A reader takes the entries that were published when it looked, so it sees each commit whole or not at all, and files are
never changed or moved. ``compact`` writes new files and ``vacuum`` removes what nothing has used for a time.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.errors import BadTimeError, DatabaseExistsError, DatabaseNotFoundError, MalformedBodyError
from chronoloom.functions.buckets import from_ns
from chronoloom.operators.instants import instant
from chronoloom.plans.query import in_range, run_query
from chronoloom.plans.rollup import ROLLUP_COLUMNS, ROLLUP_SCHEMA, build_rollup, choose_level, merge_rollup, query_rollup
from chronoloom.plans.spec import FIXED_UNITS, Group, QuerySpec, parse_ns
from chronoloom.sources.log import ABANDONED_S, Log

PARTS = 64
#: Deletes that may be sent to every task; more are joined.
SEND_DELETES = 100_000
#: The characters of a database's name; the same in routes.
DB_NAME = r"[-%+()$_a-zA-Z0-9]+"
#: Levels of stored rollups; months and years are made of days.
ROLLUP_LEVELS = ("minute", "hour", "day")
DAY_NS = FIXED_UNITS["day"] * 1000
MAX_NS = 2**63 - 1
POINTS = T.StructType([T.StructField("index_name", T.StringType()), T.StructField("ts_ns", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("value", T.MapType(T.StringType(), T.DoubleType())), T.StructField("commit", T.LongType()), T.StructField("batch", T.LongType()), T.StructField("part", T.IntegerType())])
DAYS = T.StructType([T.StructField("index_name", T.StringType()), T.StructField("day", T.DateType()), T.StructField("batch", T.LongType())])
BODY = T.StructType([T.StructField("index", T.StringType()), T.StructField("time", T.StringType()), T.StructField("value", T.StringType())])


@dataclass(frozen=True)
class Ingested:
    """What became of a batch: the commit (None if no row was good), its rows, and the rejected rows with their reasons."""

    commit: int | None
    accepted: int
    rejected: DataFrame


@dataclass
class Live:
    """What counts of a database at one moment."""

    batches: dict[int, set[int]]  # part to the batches that hold it
    deletes: list[dict]
    rollup: dict | None
    entries: list[dict]


def part_of(index_name: str) -> int:
    """The directory of a series, as Spark's ``pmod(xxhash64(index_name), PARTS)``."""
    h = xxhash.xxh64(index_name.encode(), seed=42).intdigest()
    return (h - (1 << 64) if h >> 63 else h) % PARTS


def _part(index_name) -> Column:
    return F.pmod(F.xxhash64(index_name), F.lit(PARTS)).cast("int")


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


class Store:
    """Databases under one root directory, on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())
        self._logs: dict[str, Log] = {}

    # Databases and series

    def _dir(self, db: str) -> str:
        if not all(re.fullmatch(DB_NAME, p) for p in db.split("/")):
            raise DatabaseNotFoundError(f"no database can be named {db!r}")
        if not self._fs.exists(self._path(db, "log")):
            raise DatabaseNotFoundError(db)
        return f"{self.root}/{db}"

    def _log(self, db: str) -> Log:
        at = f"{self._dir(db)}/log"
        return self._logs.setdefault(db, Log(self.spark, at))

    def create_db(self, db: str) -> None:
        """A new database; a name with slashes lies in folders, which needn't be databases themselves."""
        if not all(re.fullmatch(DB_NAME, p) for p in db.split("/")):
            raise ValueError(f"no database can be named {db!r}")
        if self._fs.exists(self._path(db)):
            raise DatabaseExistsError(db)
        self._fs.mkdirs(self._path(db, "log"))

    def drop_db(self, db: str) -> None:
        """Removes a database with all that is in it."""
        self._dir(db)
        self._logs.pop(db, None)
        self._fs.delete(self._path(db), True)

    def list_dbs(self) -> list[str]:
        """Databases under the root, in folders of any depth, by their path from it."""

        def below(prefix: str) -> list[str]:
            out = []
            for s in self._fs.listStatus(self._path(*filter(None, [prefix]))):
                name = s.getPath().getName()
                if s.isDirectory():
                    at = f"{prefix}/{name}" if prefix else name
                    out += [at] if self._fs.exists(self._path(at, "log")) else below(at)
            return out

        return sorted(below("")) if self._fs.exists(self._path()) else []

    def db_info(self, db: str) -> dict[str, str]:
        return {"name": db, "path": self._dir(db)}

    def list_indexes(self, db: str) -> DataFrame:
        """Series that were written after they were last dropped, from the small lists that commits keep."""
        live = self._live(db)
        days = self._days(db, [e for e in live.entries if e["kind"] == "points"])
        dropped = {e["index"]: e["n"] for e in live.entries if e["kind"] == "delete" and e["whole"]}
        last = days.groupBy("index_name").agg(F.max("batch").alias("written"))
        if dropped:
            gone = self.spark.createDataFrame(sorted(dropped.items()), "t_index string, dropped long")
            last = last.join(gone, (F.col("index_name") == F.col("t_index")) & (F.col("written") < F.col("dropped")), "left_anti")
        return last.select("index_name").orderBy("index_name")

    def drop_index(self, db: str, index: str) -> None:
        """Deletes all points of a series written so far."""
        self._append_delete(db, index, -(2**63), MAX_NS, True)

    # The log

    def _live(self, db: str) -> Live:
        """Follows the entries in order. A compaction counts only if all that it replaces still counts when its turn comes."""
        entries = self._log(db).entries()
        batches: dict[int, set[int]] = {}
        dropped: set[int] = set()
        rollup = None
        for e in entries:
            if e["kind"] == "points":
                for p in e["parts"]:
                    batches.setdefault(p, set()).add(e["n"])
            elif e["kind"] == "compact":
                if all(set(old) <= batches.get(int(p), set()) for p, old in e["replaces"].items()):
                    for p, old in e["replaces"].items():
                        batches[int(p)] = batches[int(p)] - set(old) | ({e["n"]} if int(p) in e["parts"] else set())
                    dropped |= set(e["drops"])
            elif e["kind"] == "rollup":
                rollup = e
        return Live({p: b for p, b in batches.items() if b}, [e for e in entries if e["kind"] == "delete" and e["n"] not in dropped], rollup, entries)

    def done(self, db: str, source: str) -> bool:
        """Whether a commit that named this source was published."""
        return any(e.get("source") == source for e in self._log(db).entries())

    def append(self, db: str, points: DataFrame, source: str | None = None) -> int:
        """Writes points (index_name, ts_ns, value, pos) as one commit; of equal keys in it the highest pos wins.

        source: a name under which the commit can be found again by ``done``.
        """
        log = self._log(db)
        n = log.claim()
        rows = points.select("index_name", "ts_ns", from_ns(F.col("ts_ns")).alias("ts"), F.col("value").cast("map<string,double>").alias("value"), F.col("pos").cast("long").alias("pos"), _part("index_name").alias("part")).withColumn("day", F.col("ts").cast("date"))
        # A hot series spreads over the days of its points; the window and the writer need no other shuffle or sort.
        spread = rows.repartition("part", "day")
        later = F.lead(F.lit(True)).over(Window.partitionBy("part", "index_name", "ts_ns", "day").orderBy("pos"))
        last = spread.withColumn("later", later).where(F.col("later").isNull())
        self._write(db, n, last.select("index_name", "ts_ns", "ts", "value", F.lit(n).cast("long").alias("commit"), "part"), {"kind": "points", "source": source})
        return n

    def _write(self, db: str, n: int, rows: DataFrame, entry: dict) -> None:
        """Writes a batch's points and the days that they touch, and publishes it."""
        at = f"{self.root}/{db}/data/batch={n}"
        rows.write.partitionBy("part").parquet(at)
        parts = [s.getPath().getName() for s in self._fs.listStatus(self._path(db, "data", f"batch={n}"))]
        parts = sorted(int(p.removeprefix("part=")) for p in parts if p.startswith("part="))
        if parts and entry["kind"] == "points":
            written = self.spark.read.schema(T.StructType(POINTS.fields[:3])).parquet(at)
            written.select("index_name", F.col("ts").cast("date").alias("day")).distinct().coalesce(PARTS).write.parquet(f"{self.root}/{db}/days/batch={n}")
        self._log(db).publish(n, {**entry, "parts": parts})

    def _append_delete(self, db: str, index: str, from_ns_: int, to_ns: int, whole: bool = False) -> None:
        log = self._log(db)
        log.publish(log.claim(), {"kind": "delete", "index": index, "from": from_ns_, "to": to_ns, "whole": whole})

    def _days(self, db: str, entries: list[dict]) -> DataFrame:
        """Series and days that batches touched, with the batch."""
        at = [f"{self.root}/{db}/days/batch={e['n']}" for e in entries if e.get("parts")]
        if not at:
            return self.spark.createDataFrame([], DAYS)
        return self.spark.read.schema(DAYS).option("basePath", f"{self.root}/{db}/days").parquet(*at)

    def points(self, db: str, index_names: tuple[str, ...] | None = None, start_us: int | None = None, end_us: int | None = None, live: Live | None = None) -> DataFrame:
        """Standing points: index_name, ts_ns, ts, value. Filters reach the scan; they are on keys, so versions stay together."""
        return self._resolved(db, live or self._live(db), index_names, start_us, end_us).select("index_name", "ts_ns", "ts", "value")

    def _resolved(self, db: str, live: Live, index_names=None, start_us=None, end_us=None, parts: set[int] | None = None) -> DataFrame:
        """Standing points of some parts with their ``commit`` and ``part``."""
        wanted = set(live.batches) if parts is None else parts & set(live.batches)
        if index_names is not None:
            wanted &= {part_of(i) for i in index_names}
        test = in_range(F.col("ts"), start_us, end_us)

        def read(which: list[int]) -> DataFrame:
            by_batches: dict[tuple[int, ...], list[int]] = {}
            for p in which:
                by_batches.setdefault(tuple(sorted(live.batches[p])), []).append(p)
            batches = sorted({b for bs in by_batches for b in bs})
            log = self.spark.read.schema(POINTS).option("basePath", f"{self.root}/{db}/data").parquet(*(f"{self.root}/{db}/data/batch={b}" for b in batches))
            log = log.where(_any([F.col("batch").isin(*bs) & F.col("part").isin(*ps) for bs, ps in by_batches.items()]))
            if index_names is not None:
                log = log.where(F.col("index_name") == index_names[0] if len(index_names) == 1 else F.col("index_name").isin(*index_names))
            return log if test is None else log.where(test)

        single = [p for p in sorted(wanted) if len(live.batches[p]) == 1]
        several = [p for p in sorted(wanted) if len(live.batches[p]) > 1]
        columns = ["index_name", "ts_ns", "ts", "value", "commit", "part"]
        frames = [read(single).select(*columns)] if single else []
        if several:
            later = F.lead(F.lit(True)).over(Window.partitionBy("index_name", "ts_ns").orderBy("commit", "batch"))
            frames.append(read(several).withColumn("later", later).where(F.col("later").isNull()).select(*columns))
        if not frames:
            return self.spark.createDataFrame([], POINTS).select(*columns)
        rows = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
        dead = [(e["index"], e["from"], e["to"], e["n"]) for e in live.deletes if part_of(e["index"]) in wanted and (index_names is None or e["index"] in index_names)]
        if dead:
            gone = self.spark.createDataFrame(dead, "t_index string, from_ns long, to_ns long, t_commit long")
            gone = F.broadcast(gone) if len(dead) <= SEND_DELETES else gone
            # A range up to the last instant includes it: nothing lies after it.
            before_end = (F.col("ts_ns") < F.col("to_ns")) | (F.col("to_ns") == MAX_NS)
            rows = rows.join(gone, (F.col("index_name") == F.col("t_index")) & (F.col("commit") < F.col("t_commit")) & (F.col("ts_ns") >= F.col("from_ns")) & before_end, "left_anti")
        return rows

    def compact(self, db: str, least_batches: int = 2) -> int | None:
        """Rewrites the standing points of the parts that ``least_batches`` or more batches hold, or that deletes concern.

        Points keep the number of the commit that wrote them. Deletes that no writer at work could still come before are
        dropped. The commit's number; None if no part needs it. See ``vacuum`` for the files that it replaces.
        """
        log = self._log(db)
        live = self._live(db)
        parts = {p for p, b in live.batches.items() if len(b) >= least_batches} | {part_of(e["index"]) for e in live.deletes} & set(live.batches)
        first_pending = min(log.pending(), default=1 << 62)
        drops = [e["n"] for e in live.deletes if e["n"] < first_pending]
        if not parts and not drops:
            return None
        n = log.claim()
        rows = self._resolved(db, live, parts=parts).withColumn("day", F.col("ts").cast("date")).repartition("part", "day").sortWithinPartitions("part", "index_name", "ts_ns").drop("day")
        self._write(db, n, rows, {"kind": "compact", "replaces": {str(p): sorted(live.batches[p]) for p in sorted(parts)}, "drops": drops})
        return n

    def vacuum(self, db: str, older_than_s: float = 7 * ABANDONED_S) -> int:
        """Removes files that no entry has used for ``older_than_s`` (readers must be done with them by then); how many folders."""
        if older_than_s and older_than_s < ABANDONED_S:
            raise ValueError("writers at work may still need what they replace for a day")
        live = self._live(db)
        old = lambda status: status.getModificationTime() < (self._now_ms() - older_than_s * 1000)
        pending = set(self._log(db).pending())
        gone = 0
        if self._fs.exists(self._path(db, "rollups")):
            chain = live.rollup["chain"] if live.rollup else []
            for b in self._fs.listStatus(self._path(db, "rollups")):
                n = int(b.getPath().getName().removeprefix("batch="))
                if n not in pending and n not in chain and old(b):
                    gone += bool(self._fs.delete(b.getPath(), True))
        if not self._fs.exists(self._path(db, "data")):
            return gone
        for b in self._fs.listStatus(self._path(db, "data")):
            n = int(b.getPath().getName().removeprefix("batch="))
            for p in self._fs.listStatus(b.getPath()):
                name = p.getPath().getName()
                if name.startswith("part=") and n not in pending and n not in live.batches.get(int(name.removeprefix("part=")), ()) and old(p):
                    gone += bool(self._fs.delete(p.getPath(), True))
        return gone

    @staticmethod
    def _now_ms() -> float:
        import time

        return time.time() * 1000

    # Rollups

    def refresh_rollups(self, db: str, levels: tuple[str, ...] = ROLLUP_LEVELS, rebuild: bool = False) -> int | None:
        """Writes pre-aggregates of the levels for the series and days that changed since the last time, at first all.

        The commit's number; None if nothing changed.
        """
        log = self._log(db)
        live = self._live(db)
        pending = log.pending()
        last = max((e["n"] for e in live.entries), default=0)
        base = None if rebuild or live.rollup is None or tuple(live.rollup["levels"]) != tuple(levels) else live.rollup
        days = self._changed_days(db, live, base)
        if days is None:
            return None
        n = log.claim()
        at = f"{self.root}/{db}/rollups/batch={n}"
        days.coalesce(PARTS).write.parquet(f"{at}/days")
        points = self.points(db, live=live)
        if base is not None:
            points = self._of_days(points, self.spark.read.parquet(f"{at}/days"), "left_semi")
        finer = None
        for level in sorted(levels, key=lambda u: FIXED_UNITS[u]):
            rows = build_rollup(points, level) if finer is None else merge_rollup(self.spark.read.parquet(finer), Group(1, level))
            spread = rows.withColumn("part", _part("index_name")).repartition("part", F.col("bucket_start").cast("date")).sortWithinPartitions("part", "index_name", "bucket_start")
            spread.select(*ROLLUP_COLUMNS, "part").write.partitionBy("part").parquet(f"{at}/level={level}")
            finer = f"{at}/level={level}"
        log.publish(n, {"kind": "rollup", "levels": list(levels), "chain": [*(base["chain"] if base else []), n], "upto": last, "unseen": [p for p in pending if p <= last]})
        return n

    @staticmethod
    def _since(live: Live, rollup: dict) -> list[dict]:
        """Points and deletes that a rollup doesn't include."""
        seen = lambda e: e["n"] <= rollup["upto"] and e["n"] not in rollup["unseen"]
        return [e for e in live.entries if e["kind"] in ("points", "delete") and not seen(e)]

    def _changed_days(self, db: str, live: Live, rollup: dict | None) -> DataFrame | None:
        """Series and days (index_name, day) that commits changed since a rollup; None if there are none."""
        every = [e for e in live.entries if e["kind"] == "points"]
        if rollup is None:
            return self._days(db, every).select("index_name", "day").distinct() if every else None
        since = self._since(live, rollup)
        frames = [self._days(db, [e for e in since if e["kind"] == "points"]).select("index_name", "day")] if any(e["kind"] == "points" for e in since) else []
        deletes = [(e["index"], e["from"] // DAY_NS, (e["to"] - 1) // DAY_NS) for e in since if e["kind"] == "delete"]
        if deletes:
            ranges = self.spark.createDataFrame(deletes, "t_index string, first long, last long")
            within = (F.col("index_name") == F.col("t_index")) & F.unix_date("day").between(F.col("first"), F.col("last"))
            frames.append(self._days(db, every).select("index_name", "day").join(ranges, within, "left_semi"))
        if not frames:
            return None
        return (frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])).distinct()

    @staticmethod
    def _of_days(rows: DataFrame, days: DataFrame, how: str, ts: str = "ts") -> DataFrame:
        return rows.withColumn("day", F.col(ts).cast("date")).join(days, ["index_name", "day"], how).drop("day")

    def rollup(self, db: str, level: str, live: Live | None = None, index_names: tuple[str, ...] | None = None, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
        """The stored rollup's rows of one level: of each series and day those of the batch that covered it last."""
        live = live or self._live(db)
        base = f"{self.root}/{db}/rollups"
        chain = live.rollup["chain"] if live.rollup else []
        have = [n for n in chain if self._fs.exists(self._path(db, "rollups", f"batch={n}", f"level={level}"))]

        def read(n: int) -> DataFrame:
            rows = self.spark.read.option("basePath", f"{base}/batch={n}/level={level}").schema(ROLLUP_SCHEMA).parquet(f"{base}/batch={n}/level={level}")
            if index_names is not None:
                rows = rows.where(F.col("part").isin(*{part_of(i) for i in index_names}) & F.col("index_name").isin(*index_names))
            test = in_range(F.col("bucket_start"), start_us, end_us)
            return (rows if test is None else rows.where(test)).drop("part")

        out = None
        for n in have:
            # Days that later batches cover anew are theirs.
            later = [self.spark.read.parquet(f"{base}/batch={m}/days") for m in chain if m > n]
            rows = read(n)
            if later:
                days = later[0]
                for more in later[1:]:
                    days = days.unionByName(more)
                rows = self._of_days(rows, days.distinct(), "left_anti", "bucket_start")
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], ROLLUP_SCHEMA).drop("part") if out is None else out

    # Writing

    def validate(self, rows: DataFrame) -> DataFrame:
        """Rows of index, time and value (JSON text) as points with a ``reason`` where one can't be stored."""
        read = rows.withColumns({"t": instant(F.col("time"), F.lit("UTC"), F.lit("ymd")), "m": F.from_json("value", "map<string,double>")})
        odd = F.exists(F.map_values("m"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        reason = F.when(F.col("index").isNull() | (F.col("index") == ""), "no index").when(F.col("t.time_status") != "ok", F.concat(F.lit("time: "), "t.time_status")).when(F.col("m").isNull() | odd, "value: not an object of numbers")
        return read.select(F.col("index").alias("index_name"), "t.ts_ns", F.col("m").alias("value"), F.col("pos"), "time", F.col("value").alias("value_text"), reason.alias("reason"))

    def put(self, db: str, body: str | bytes | list) -> Ingested:
        """A JSON array of ``{"index", "time", "value"}``: good rows are stored as one commit, others reported."""
        if not isinstance(body, list):
            try:
                body = json.loads(body)
            except ValueError as e:
                raise MalformedBodyError(str(e)) from e
        if not isinstance(body, list) or not all(isinstance(r, dict) for r in body):
            raise MalformedBodyError("a batch is an array of objects")
        text = lambda x: x if isinstance(x, str) or x is None else str(x)
        rows = [(text(r.get("index")), text(r.get("time")), json.dumps(r.get("value")), k) for k, r in enumerate(body)]
        return self.ingest(db, self.spark.createDataFrame(rows, "index string, time string, value string, pos long"))

    def put_files(self, db: str, path: str) -> Ingested:
        """The same from JSON files, one object or array a line, read in parallel; later lines win within a commit."""
        rows = self.spark.read.schema(BODY).json(path).withColumn("pos", F.monotonically_increasing_id())
        return self.ingest(db, rows)

    def ingest(self, db: str, rows: DataFrame, source: str | None = None) -> Ingested:
        """Stores the good rows of (index, time, value as JSON text, pos); with a source also an empty batch is a commit."""
        self._dir(db)
        checked = self.validate(rows)
        good = checked.where(F.col("reason").isNull())
        accepted = good.count()
        commit = self.append(db, good, source) if accepted or source else None
        return Ingested(commit, accepted, checked.where(F.col("reason").isNotNull()).select("index_name", "time", "value_text", "reason"))

    def delete(self, db: str, index: str, from_time: str | int | None, to_time: str | int | None) -> None:
        """Deletes [from, to) of a series; a range without points, or that is empty, changes nothing."""
        if from_time in (None, "") or to_time in (None, ""):
            raise BadTimeError("'from' and 'to' are required")
        bounds = [b if isinstance(b, int) else parse_ns(b) for b in (from_time, to_time)]
        if bounds[0] < bounds[1]:
            self._append_delete(db, index, *bounds)

    # Reading

    def get(self, db: str, index: str, time: str | int, field: str | None = None) -> dict | float | None:
        """The point's map at exactly that time, or one of its fields; None if there is none. Nothing is created."""
        ns = time if isinstance(time, int) else parse_ns(time)
        us = ns // 1000
        rows = self.points(db, (index,), us, us + 1).where(F.col("ts_ns") == ns).select("value").collect()
        return None if not rows else rows[0].value if field is None else (rows[0].value or {}).get(field)

    def query(self, db: str, spec: QuerySpec | str | bytes | dict, sort: bool = True, rollups: bool = True) -> DataFrame:
        """Answers from the coarsest stored rollup whose buckets make up the query's; from points where days changed since, and at the end."""
        spec = spec if isinstance(spec, QuerySpec) else QuerySpec.from_json(spec)
        live = self._live(db)
        level = choose_level(spec, tuple(live.rollup["levels"]), whole=False) if rollups and live.rollup else None
        if level is None:
            points = self.points(db, spec.index_names, spec.start_us, spec.end_us, live)
            return run_query(points if spec.to_ns is None else points.where(F.col("ts_ns") < spec.to_ns), spec, sort=sort)
        whole = None if spec.to_ns is None else Group(1, level).floor_us(spec.to_ns // 1000)
        rows = self.rollup(db, level, live, spec.index_names, spec.start_us, whole)
        changed = self._changed_days(db, live, live.rollup)
        extra = []
        if changed is not None:
            rows = self._of_days(rows, changed, "left_anti", "bucket_start")
            extra.append(self._of_days(self.points(db, spec.index_names, spec.start_us, whole, live), changed, "left_semi"))
        if whole is not None and whole * 1000 < spec.to_ns:
            begin = whole if spec.start_us is None else max(whole, spec.start_us)
            extra.append(self.points(db, spec.index_names, begin, spec.end_us, live).where(F.col("ts_ns") < spec.to_ns))
        for points in extra:
            rows = rows.unionByName(build_rollup(points, level).select(*ROLLUP_COLUMNS))
        return query_rollup(rows, spec, sort=sort)

    def scan(self, db: str, index: str, descending: bool = False, limit: int | None = None) -> DataFrame:
        """All points of a series in the order of time, or against it; the first ``limit`` of them."""
        rows = self.points(db, (index,)).orderBy(F.col("ts_ns").desc() if descending else F.col("ts_ns"))
        return rows if limit is None else rows.limit(limit)
