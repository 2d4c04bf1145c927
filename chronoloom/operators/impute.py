"""Missing values of standing rows, filled from like records, each marked with where it came from.

1. *One pass* over the standing rows lists the missing values and sums up the complete records: for each series, hour and
   field count, sum, least and greatest value, of coded fields one row a code; and for each relation how many records
   agree with it. The sums are a written table of numbers only.
2. *Mining.* Every set of ``DETERMINANTS`` (attributes of a record: kind, site, series, hour, day, hour of the day,
   weekday) is tried for every kind and field, and every relation ``a = b * c`` (so also both ratios) of a kind's measured
   fields. The dictionary of a set (key to value) is a written table too: a code's value is the most frequent one, a
   measured field's the mean without the least and greatest. A record agrees with its key if it has that code, or if all
   the key's measured values lie within ``tolerance`` of their mean. A set determines a field if, over all its keys with
   two or more complete records, at least ``confidence`` of ``support`` or more records agree, each key's first one not
   counted.
3. *Filling.* Relations of the row itself come first. The dictionaries are left-joined to what is missing; of those
   verified the one with the highest agreement gives the value. What none fills takes the value of the group that is like
   it, verified or not, in the order of ``FALLBACK``.

``source`` of a filled value: ``rule:<relation>``, ``dependency:<set>``, ``group:<set>``, or ``none`` (nothing like it was
ever recorded; ``filled`` is null).

A value is missing if it is absent, null or NaN, or its row's map is null; in points also if it is outside the field's
limits, which stands for no measurement. Values outside the limits fill nothing. Rows without series or time do not
stand. Of equal (series, time) the highest id stands. Fields that the catalogue doesn't list for the kind are not
expected, a kind it doesn't list expects none. Empty tables give no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators import tiling
from chronoloom.operators.readings import codes_of, limits_by_kind, map_parts, over_chunks, standing
from chronoloom.session import scratch_folder

HOUR_NS = 3_600_000_000_000
CODED_UNITS = ("code",)
#: Sets of attributes that may determine a field, by the columns of their keys; ``place`` stands for kind and site.
DETERMINANTS = {"kind+site+hour": ("place", "hour"), "kind+site+day": ("place", "day"), "series+day": ("series", "day"), "series+hour_of_day": ("series", "hour_of_day"), "series+weekday": ("series", "weekday"), "series": ("series",), "kind": ()}
#: Groups in the order in which they stand in for a dependency: from near in time to the whole kind.
FALLBACK = ("kind+site+hour", "series+day", "kind+site+day", "series+hour_of_day", "series", "kind")
#: Missing values whose keys may be sent to every task (some 40 MB); more are joined.
SEND_KEYS = 1_000_000
OUT = pa.schema([("row_kind", pa.string()), ("table_name", pa.string()), ("rec_id", pa.int64()), ("index_name", pa.string()), ("hour", pa.int64()), ("field", pa.int32()), ("rule", pa.string()), ("code", pa.int64()), ("v", pa.float64()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int64())])
OUT_DDL = "row_kind string, table_name string, rec_id long, index_name string, hour long, field int, rule string, code long, v double, low double, high double, n long"
SUMS_DDL = "series long, place long, hour long, field int, code long, v double, low double, high double, n long"
DICTIONARY_DDL = "determinants string, series long, place long, hour long, day long, hour_of_day long, weekday long, field int, value double, agreed long, n long"


class Catalogue:
    """The fields that each kind reports, by position."""

    def __init__(self, limits: dict[tuple[str, str], tuple[str, float, float]]):
        self.fields: dict[str, list[str]] = {}
        for kind, field in sorted(limits):
            self.fields.setdefault(kind, []).append(field)
        #: Kinds and fields by number, and which of them are coded.
        self.pairs = [(kind, f) for kind, names in self.fields.items() for f in names]
        self.coded = [k for k, pair in enumerate(self.pairs) if limits[pair][0] in CODED_UNITS]
        self.width = max((len(f) for f in self.fields.values()), default=0)
        self.limits = limits
        #: per kind: relations (product, factor, factor) among measured fields, by position
        self.relations = {kind: [(a, *bc) for a in m for bc in combinations([x for x in m if x != a], 2)] for kind, names in self.fields.items() for m in [[k for k, f in enumerate(names) if limits[kind, f][0] not in CODED_UNITS]]}


def _pass(table: pa.Table, cat: Catalogue) -> pa.Table | None:
    tables, table_names = codes_of(table.column("table_name").combine_chunks())
    series, names = codes_of(table.column("index_name").combine_chunks())
    split = [n.split(".", 1)[0].strip().lower() for n in names]
    kind_names = sorted(set(split))
    kinds = np.array([kind_names.index(k) for k in split], "int64")[series]
    rec, hour = table.column("rec_id").to_numpy(), table.column("hour").to_numpy()
    value = table.column("value").combine_chunks()
    rows, keys, v = map_parts(value if isinstance(value, pa.Array) else value.chunk(0))
    field_names = keys.dictionary.to_pylist()
    n, width = table.num_rows, cat.width
    position = np.full((len(kind_names), max(1, len(field_names))), -1)
    low, high = np.full((len(kind_names), width), -np.inf), np.full((len(kind_names), width), np.inf)
    coded, expected = np.zeros((len(kind_names), width), bool), np.zeros((len(kind_names), width), bool)
    number = np.full((len(kind_names), width), -1, "int32")
    for k, kind in enumerate(kind_names):
        for p, field in enumerate(cat.fields.get(kind, ())):
            unit, low[k, p], high[k, p] = cat.limits[kind, field]
            coded[k, p], expected[k, p], number[k, p] = unit in CODED_UNITS, True, cat.pairs.index((kind, field))
            if field in field_names:
                position[k, field_names.index(field)] = p
    cells = np.full((n, width), np.nan)
    at = position[kinds[rows], np.asarray(keys.indices)] if len(rows) else np.zeros(0, int)
    cells[rows[at >= 0], at[at >= 0]] = v[at >= 0]
    is_points = np.array([t == "points" for t in table_names])[tables]
    outside = (cells < low[kinds]) | (cells > high[kinds]) | np.isinf(cells)
    missing = expected[kinds] & (np.isnan(cells) | (outside & is_points[:, None]))
    good = np.where(outside, np.nan, cells)
    parts: list[pa.Table] = []

    def emit(count: int, **columns) -> None:
        full = {c: pa.nulls(count, t) for c, t in zip(OUT.names, OUT.types)}
        for c, x in columns.items():
            full[c] = x if isinstance(x, pa.Array) else pa.array([x] * count, OUT.field(c).type) if isinstance(x, str) else pa.array(x, OUT.field(c).type)
        if count:
            parts.append(pa.table(full, schema=OUT))

    label = lambda values, codes: pa.array(values, pa.string()).take(pa.array(codes))
    # Complete records by series, hour, field and code.
    r, p = np.nonzero(~np.isnan(good))
    if len(r):
        x = good[r, p]
        code = np.where(coded[kinds[r], p], x, 0).astype("int64")
        order = np.lexsort((code, p, hour[r], series[r]))
        r, p, x, code = r[order], p[order], x[order], code[order]
        first = np.flatnonzero(np.append(True, (series[r][1:] != series[r][:-1]) | (hour[r][1:] != hour[r][:-1]) | (p[1:] != p[:-1]) | (code[1:] != code[:-1])))
        a = r[first]
        emit(len(first), row_kind="sum", index_name=label(names, series[a]), hour=hour[a], field=number[kinds[a], p[first]], code=code[first], v=np.add.reduceat(x, first), low=np.minimum.reduceat(x, first), high=np.maximum.reduceat(x, first), n=np.diff(np.append(first, len(r))))
    where, what = np.nonzero(missing)

    def column(mask: np.ndarray, **more) -> None:
        w = where[mask]
        emit(len(w), row_kind="missing", table_name=label(table_names, tables[w]), rec_id=rec[w], index_name=label(names, series[w]), hour=hour[w], field=number[kinds[w], what[mask]], **more)

    # A missing value: one row without a rule, and one for each relation that its row allows.
    column(np.ones(len(where), bool))
    for k, kind in enumerate(kind_names):
        of_kind = kinds == k
        for a, b, c in cat.relations.get(kind, ()):
            rule = f"{cat.fields[kind][a]}={cat.fields[kind][b]}*{cat.fields[kind][c]}"
            x, y, z = good[:, a], good[:, b], good[:, c]
            with np.errstate(invalid="ignore", over="ignore"):
                whole = of_kind & ~np.isnan(x + y + z) & (x != 0)
                emit(1, row_kind="verify", field=[int(number[k, a])], rule=rule, v=[float((np.abs(x - y * z)[whole] <= 1e-3 * np.abs(x[whole])).sum())], n=[int(whole.sum())])
                for target, guess in ((a, y * z), (b, np.divide(x, z, out=np.full(n, np.nan), where=z != 0)), (c, np.divide(x, y, out=np.full(n, np.nan), where=y != 0))):
                    mask = of_kind[where] & (what == target)
                    mask[mask] = np.isfinite(guess[where[mask]])
                    column(mask, rule=rule, v=guess[where[mask]])
    return pa.concat_tables(parts) if parts else None


def _places(df: DataFrame) -> DataFrame:
    """Adds numbers for a row's series and for its kind and site."""
    parts = F.split("index_name", r"\.")
    return df.withColumns({"series": F.xxhash64("index_name"), "place": F.xxhash64(F.lower(F.trim(parts[0])), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")))})


def _times(df: DataFrame) -> DataFrame:
    day = F.floor(F.col("hour") / 24).cast("long")
    return df.withColumns({"day": day, "hour_of_day": F.pmod("hour", F.lit(24)).cast("long"), "weekday": F.pmod(day + 4, F.lit(7)).cast("long")})


def _added(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by, "field", "code").agg(F.sum("v").alias("v"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))


def dictionary(sums: DataFrame, by: tuple[str, ...], coded: list[int], tolerance: float) -> DataFrame:
    """Of sums by key, field and code: the key, field, value, how many records agree with it, and n records."""
    is_coded = F.col("field").isin(*coded) if coded else F.lit(False)
    mean = F.col("v") / F.col("n")
    inner = F.when(F.col("n") > 2, (F.col("v") - F.col("low") - F.col("high")) / (F.col("n") - 2)).otherwise(mean)
    close = F.col("high") - F.col("low") <= 2 * tolerance * F.abs(mean)
    measured = sums.where(~is_coded).select(*by, "field", inner.alias("value"), F.when(close, F.col("n")).otherwise(F.lit(1)).cast("long").alias("agreed"), "n")
    best = sums.where(is_coded).groupBy(*by, "field").agg(F.max_by("code", F.struct("n", -F.col("code"))).cast("double").alias("value"), F.max("n").alias("agreed"), F.sum("n").alias("n"))
    return measured.unionByName(best)


def dictionaries(sums: DataFrame, daily: DataFrame, coded: list[int], tolerance: float) -> DataFrame:
    """DICTIONARY_DDL of all sets; daily: the sums by series and day, from which the coarser ones follow."""
    out = None
    for name, by in DETERMINANTS.items():
        added = _times(daily.withColumn("hour", F.col("day") * 24)) if {"hour", "hour_of_day"}.isdisjoint(by) else _times(sums)
        one = dictionary(_added(added, *by), by, coded, tolerance).withColumn("determinants", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def verified(every: DataFrame, confidence: float, support: int) -> DataFrame:
    """determinants, field and trust where a set determines the field; each key's first record isn't counted, as it always agrees."""
    told = every.where("n >= 2").groupBy("determinants", "field").agg(F.sum(F.col("agreed") - 1).alias("agreed"), F.sum(F.col("n") - 1).alias("n"))
    return told.where((F.col("n") >= support) & (F.col("agreed") >= confidence * F.col("n"))).select("determinants", "field", (F.col("agreed") / F.col("n")).alias("trust"))


def fill_missing(posts: DataFrame, points: DataFrame, kind_fields: DataFrame, *, confidence: float = 0.95, support: int = 30, tolerance: float = 0.02) -> DataFrame:
    """One row per missing value: table_name, rec_id, index_name, field_name, filled, source."""
    cat = Catalogue(limits_by_kind(kind_fields))
    spark = posts.sparkSession
    if not cat.width:
        return spark.createDataFrame([], "table_name string, rec_id long, index_name string, field_name string, filled double, source string")
    div = lambda x, y: F.floor(x / y).cast("long")
    own = standing(posts).select(F.lit("posts").alias("table_name"), F.col("post_id").alias("rec_id"), "index_name", div(F.unix_micros(F.col("ts").cast("timestamp")), HOUR_NS / 1000).alias("hour"), "value")
    others = standing(points, ("index_name", "ts_ns"), "point_id").select(F.lit("points").alias("table_name"), F.col("point_id").alias("rec_id"), "index_name", F.call_function("div", F.col("ts_ns") - F.pmod("ts_ns", F.lit(HOUR_NS)), F.lit(HOUR_NS)).alias("hour"), "value")
    # Missing values and sums of the complete records; several steps below read them.
    at = scratch_folder(spark)
    own.unionByName(others).mapInArrow(over_chunks(lambda t: _pass(t, cat), (), 100_000), OUT_DDL).write.partitionBy("row_kind").parquet(f"{at}/seen")
    seen = spark.read.schema(OUT_DDL).parquet(f"{at}/seen")
    of = lambda kind: seen.where(F.col("row_kind") == kind)
    rules = of("verify").groupBy("rule", "field").agg(F.sum("v").alias("agreed"), F.sum("n").alias("n")).where((F.col("agreed") >= confidence * F.col("n")) & (F.col("n") >= support)).select("rule", F.col("field").alias("product"), (F.col("agreed") / F.col("n")).alias("trust"))
    sums = _places(of("sum")).select(*[c.split(" ")[0] for c in SUMS_DDL.split(", ")])
    # Series and day fix the place.
    day = F.floor(F.col("hour") / 24).cast("long")
    _added(sums.withColumn("day", day), "series", "place", "day").write.parquet(f"{at}/daily")
    dictionaries(sums, spark.read.parquet(f"{at}/daily"), cat.coded, tolerance).write.partitionBy("determinants").parquet(f"{at}/dictionaries")
    every = spark.read.schema(DICTIONARY_DDL).parquet(f"{at}/dictionaries")
    names = list(DETERMINANTS)
    told = verified(every, confidence, support).groupBy("field").agg(*(F.max(F.when(F.col("determinants") == name, F.col("trust"))).alias(f"trust{k}") for k, name in enumerate(names)))

    missing = of("missing")
    best = missing.where(F.col("rule").isNotNull()).join(_sent(rules), ["rule"]).where(F.element_at(_kinds(cat), F.col("field")) == F.element_at(_kinds(cat), F.col("product")))
    best = best.groupBy("table_name", "rec_id", "field").agg(F.max_by(F.struct("rule", "v"), F.struct("trust", "rule")).alias("best"))
    cells = _times(_places(missing.where(F.col("rule").isNull()).select("table_name", "rec_id", "index_name", "hour", "field")))
    few = missing.where(F.col("rule").isNull()).count() <= SEND_KEYS
    filled = cells.join(best, ["table_name", "rec_id", "field"], "left").join(_sent(told), ["field"], "left")
    for k, name in enumerate(names):
        by = [*DETERMINANTS[name], "field"]
        keys = cells.select(*by).distinct()
        known = every.where(F.col("determinants") == name).select(*by, F.col("value").alias(f"value{k}"))
        # Only the keys of missing values go on, to be joined.
        filled = filled.join(known.join(F.broadcast(keys) if few else keys, by, "left_semi"), by, "left")
    cells = filled.join(_sent(spark.createDataFrame([(k, f) for k, (_, f) in enumerate(cat.pairs)], "field int, field_name string")), ["field"])
    # Of the verified sets that know the key, the most trusted; of equal ones the first of DETERMINANTS.
    trusted = F.array_max(F.array_compact(F.array(*(F.when(F.col(f"value{k}").isNotNull() & F.col(f"trust{k}").isNotNull(), F.struct(F.col(f"trust{k}").alias("trust"), F.lit(-k).alias("rank"), F.lit(f"dependency:{name}").alias("source"), F.col(f"value{k}").alias("v"))) for k, name in enumerate(names)))))
    near: Column = F.struct(F.lit("none").alias("source"), F.lit(None).cast("double").alias("v"))
    for name in reversed(FALLBACK):
        v = F.col(f"value{names.index(name)}")
        near = F.when(v.isNotNull(), F.struct(F.lit(f"group:{name}").alias("source"), v.alias("v"))).otherwise(near)
    cells = cells.withColumns({"t": trusted, "g": near})
    source = F.when(F.col("best").isNotNull(), F.concat(F.lit("rule:"), "best.rule")).when(F.col("t").isNotNull(), F.col("t.source")).otherwise(F.col("g.source"))
    return cells.select("table_name", "rec_id", "index_name", "field_name", F.coalesce("best.v", "t.v", "g.v").alias("filled"), source.alias("source"))


def _kinds(cat: Catalogue) -> Column:
    """Kind by number of a kind's field."""
    return F.create_map(*(x for k, (kind, _) in enumerate(cat.pairs) for x in (F.lit(k), F.lit(kind))))


def _sent(df: DataFrame) -> DataFrame:
    """To every task if the rows, counted, are few; they grow with the catalogue's kinds and fields, relations with the cube of a kind's."""
    local, few = tiling.small(df.sparkSession, df)
    return F.broadcast(local) if few else local
