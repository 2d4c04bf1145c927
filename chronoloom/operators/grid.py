"""Irregular readings onto the regular grid of a request: one row per bucket, empty ones filled and marked.

1. Requests become ranges of bucket numbers; posts meet the requests that cover their day (an equality join, so no pairs
   arise but those that count), and are reduced to one row per request and bucket.
2. For each requested field of a series a harmonic seasonal regression with trend is fitted over all its posts: the
   entries of the normal equations are plain sums, added up where the posts lie and merged; readings outside the field's
   limits stay out of the fit, and those outside the quartile fences, except in fields of counts and rain and where the
   quartiles are equal.
3. Empty buckets take the prediction plus the residual of the observed buckets before and after, bridged linearly; before
   the first and after the last the nearest residual holds. Coded fields repeat the last code instead.

Long requests are cut into spans of ``SPAN`` buckets which know the nearest observation on either side.

``cell_state``: ``observed``, ``seasonal`` (regression and bridge), ``held`` (last value), ``missing`` (nothing to go by).

Defined cases: a request with a null bound, a range that ends before it begins, or a group of an unknown unit or width 0
has no buckets; of several requests with one grid_id the smallest by its columns counts; null and NaN are no readings, infinities are (their bucket is not empty, but they enter neither fit nor bridge); several
readings of a bucket are averaged, of coded fields the last counts; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators import tiling
from chronoloom.operators.readings import codes_of, limits_by_kind, over_chunks, standing
from chronoloom.session import scratch_folder

SPAN = 4096
DAY_US = 86_400_000_000
UNIT_US = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": DAY_US}
UNIT_MONTHS = {"month": 1, "year": 12}
#: Periods of the harmonics in days, with the number of harmonics of each.
PERIODS = ((1.0, 2), (7.0, 1))
#: Trend runs in years from this day, so that the normal equations stay well conditioned.
TREND_DAY = 20_000
RIDGE = 1e-6
#: Units of counts and rain: rare large readings are normal there and belong in the fit.
UNFENCED_UNITS = ("n", "mm")
OUT = "grid_id long, bucket_us long, value double, n_readings long, cell_state string"


def _us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _months(c: Column) -> Column:
    return (F.year(c) - 1970) * 12 + F.month(c) - 1


def bucket_number(ts: Column, step_us: Column, months: Column) -> Column:
    """Number of the bucket that holds an instant, counted from the epoch."""
    return F.when(months.isNull(), (_us(ts) - F.pmod(_us(ts), step_us)) / step_us).otherwise(F.floor(_months(ts) / months)).cast("long")


def one_per_id(requests: DataFrame) -> DataFrame:
    """One request per grid_id: of several the smallest by its columns in their order."""
    columns = ["index_name", "field_name", "from_time", "to_time", "group_spec"]
    return requests.groupBy("grid_id").agg(F.min(F.struct(*columns)).alias("r")).select("grid_id", *(f"r.{c}" for c in columns))


def requests_plan(requests: DataFrame) -> DataFrame:
    """grid_id, index_name, field_name, step_us, months, first and last bucket, and the days that these cover."""
    spec = F.lower(F.trim("group_spec"))
    width = F.coalesce(F.expr("try_cast(nullif(regexp_extract(lower(trim(group_spec)), '^([0-9]+)', 1), '') as bigint)"), F.lit(1))
    unit = F.regexp_extract(spec, "^[0-9]*([a-z]+?)s?$", 1)
    steps = F.create_map(*(F.lit(x) for kv in UNIT_US.items() for x in kv))
    months = F.create_map(*(F.lit(x) for kv in UNIT_MONTHS.items() for x in kv))
    r = requests.select("grid_id", "index_name", "field_name", "from_time", "to_time", width.alias("width"), unit.alias("unit")).where(F.col("grid_id").isNotNull() & (F.col("width") > 0) & F.col("unit").isin(*UNIT_US, *UNIT_MONTHS))
    r = r.withColumns({"step_us": F.try_element_at(steps, F.col("unit")) * F.col("width"), "months": F.try_element_at(months, F.col("unit")) * F.col("width")})
    before_to = F.col("to_time") - F.expr("interval 1 microsecond")
    r = r.withColumns({"first": bucket_number(F.col("from_time"), F.col("step_us"), F.col("months")), "last": bucket_number(before_to, F.col("step_us"), F.col("months"))}).where("first <= last")
    at = lambda b: F.when(F.col("months").isNull(), b * F.col("step_us")).otherwise(F.unix_micros(F.add_months(F.lit("1970-01-01").cast("date"), (b * F.col("months")).cast("int")).cast("timestamp")))
    r = r.withColumns({"begin_us": at(F.col("first")), "end_us": at(F.col("last") + 1)})
    return r.select("grid_id", "index_name", "field_name", "step_us", "months", "first", "last", "begin_us", "end_us")


def _features(us: Column) -> list[Column]:
    days = us / DAY_US
    out = [F.lit(1.0), (days - TREND_DAY) / 365.25]
    for period, harmonics in PERIODS:
        for k in range(1, harmonics + 1):
            angle = days * (2 * np.pi * k / period)
            out += [F.cos(angle), F.sin(angle)]
    return out


def _features_of(us: np.ndarray) -> np.ndarray:
    days = us / DAY_US
    out = [np.ones(len(us)), (days - TREND_DAY) / 365.25]
    for period, harmonics in PERIODS:
        for k in range(1, harmonics + 1):
            angle = days * (2 * np.pi * k / period)
            out += [np.cos(angle), np.sin(angle)]
    return np.stack(out, axis=1)


def asked_readings(posts: DataFrame, fields: DataFrame) -> DataFrame:
    """Readings of the fields that are asked for, of standing posts: index_name, field_name, us, v (infinities too).

    fields: distinct index_name, field_name. A series' fields come as one list, so each post is met once.
    """
    lists = fields.groupBy("index_name").agg(F.collect_set("field_name").alias("fields"))
    local, few = tiling.small(posts.sparkSession, lists)
    rows = standing(posts.join(F.broadcast(local) if few else local, "index_name", "left_semi")).join(F.broadcast(local) if few else local, "index_name")
    entries = F.map_entries(F.map_filter("value", lambda k, v: v.isNotNull() & ~F.isnan(v) & F.array_contains("fields", k)))
    return rows.select("index_name", _us(F.col("ts")).alias("us"), F.inline(entries).alias("field_name", "v"))


def seasonal_models(readings: DataFrame, limits: DataFrame) -> DataFrame:
    """index_name, field_name, sums: the normal equations (upper triangle, then right-hand side) of the seasonal regression.

    readings: see ``asked_readings``; limits: kind, field_name, low_limit, high_limit, unfenced.
    """
    key = ["index_name", "field_name"]
    kind = F.lower(F.substring_index("index_name", ".", 1))
    finite = readings.where(F.abs("v") < float("inf"))
    inside = finite.join(F.broadcast(limits.withColumnRenamed("field_name", "f")), (kind == F.col("kind")) & (F.col("field_name") == F.col("f")), "left").where(F.coalesce(F.col("v") >= F.col("low_limit"), F.lit(True)) & F.coalesce(F.col("v") <= F.col("high_limit"), F.lit(True))).withColumn("unfenced", F.coalesce("unfenced", F.lit(False)))
    quartiles = inside.groupBy(*key).agg(F.percentile_approx("v", [0.25, 0.75], 200).alias("q")).select(*key, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    quartiles, few = tiling.small(readings.sparkSession, quartiles)
    reach = 3 * (F.col("q3") - F.col("q1"))
    fenced = inside.join(F.broadcast(quartiles) if few else quartiles, key).where(F.col("unfenced") | (reach == 0) | F.col("v").between(F.col("q1") - reach, F.col("q3") + reach))
    x = _features(F.col("us"))
    names = [f"x{k}" for k in range(len(x))]
    fenced = fenced.select(*key, "v", *(c.alias(n) for c, n in zip(x, names)))
    products = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    return fenced.groupBy(*key).agg(F.array(*products, *(F.sum(F.col(a) * F.col("v")) for a in names)).alias("sums"))


def _solve(sums: list | None) -> np.ndarray | None:
    if sums is None:
        return None
    k = 2 + 2 * sum(h for _, h in PERIODS)
    s = np.asarray(sums, float)
    a = np.zeros((k, k))
    a[np.triu_indices(k)] = s[: k * (k + 1) // 2]
    a = a + np.triu(a, 1).T
    if a[0, 0] < 1:
        return None
    # The mean is left free; the other terms are held back where there are too few readings to tell them apart.
    penalty = np.eye(k) * (RIDGE * a[0, 0] + 0.5)
    penalty[0, 0] = 0
    try:
        return np.linalg.solve(a + penalty, s[k * (k + 1) // 2 :])
    except np.linalg.LinAlgError:
        return None


def _fill(table: pa.Table, limits: dict) -> pa.Table | None:
    """Whole (grid_id, span) groups, each of a header row (bucket null, first) and a row per observed bucket in order."""
    grid = table.column("grid_id").to_numpy()
    bucket_col = table.column("bucket")
    heads = np.flatnonzero(np.asarray(bucket_col.is_null().combine_chunks()))
    bucket = bucket_col.fill_null(0).to_numpy()
    mean, final, n = (table.column(c).to_numpy(zero_copy_only=False) for c in ("mean_v", "last_v", "n"))
    header = table.select(["index_name", "field_name", "step_us", "months", "low", "high", "sums", "prev_bucket", "prev_mean", "prev_last", "next_bucket", "next_mean"]).take(pa.array(heads)).to_pylist()
    ends = np.append(heads[1:], table.num_rows)
    out: list[tuple] = []
    for head, end, h in zip(heads, ends, header):
        numbers = np.arange(h["low"], h["high"] + 1)
        start = lambda b: b * h["step_us"] if h["months"] is None else (np.datetime64("1970-01", "M") + b * h["months"]).astype("datetime64[us]").astype("int64")
        us = start(numbers)
        unit, low, high = limits.get(((h["index_name"] or "").split(".", 1)[0].strip().lower(), h["field_name"]), ("", -np.inf, np.inf))
        rows = slice(head + 1, end)
        seen, place = bucket[rows], bucket[rows] - h["low"]
        coded = unit == "code"
        own = final[rows] if coded else mean[rows]
        value, count = np.full(len(numbers), np.nan), np.zeros(len(numbers), "int64")
        state = np.full(len(numbers), "missing", object)
        value[place], count[place], state[place] = own, n[rows], "observed"
        empty = np.flatnonzero(count == 0)
        usable = np.isfinite(own)
        ends_b, ends_v = list(seen[usable]), list(own[usable])
        if h["prev_bucket"] is not None:
            ends_b.insert(0, h["prev_bucket"])
            ends_v.insert(0, h["prev_last"] if coded else h["prev_mean"])
        if h["next_bucket"] is not None and not coded:
            ends_b.append(h["next_bucket"])
            ends_v.append(h["next_mean"])
        ends_b, ends_v = np.array(ends_b, "int64"), np.array(ends_v, float)
        if len(empty) and coded:
            at = np.searchsorted(ends_b, numbers[empty], side="right") - 1
            have = at >= 0
            value[empty[have]] = ends_v[at[have]] if len(ends_v) else np.nan
            state[empty[have]] = "held"
        elif len(empty):
            model = _solve(h["sums"])
            if model is not None:
                guess = _features_of(us[empty]) @ model
                if len(ends_b):
                    residual = ends_v - _features_of(start(ends_b)) @ model
                    guess = guess + np.interp(us[empty], start(ends_b), residual)
                value[empty], state[empty] = np.clip(guess, low, high), "seasonal"
            elif len(ends_b):
                value[empty], state[empty] = np.clip(np.interp(us[empty], start(ends_b), ends_v), low, high), "held"
        out.append((np.full(len(numbers), grid[head]), us, value, count, state))
    if not out:
        return None
    g, us, value, count, state = (np.concatenate(x) for x in zip(*out))
    return pa.table({"grid_id": pa.array(g, pa.int64()), "bucket_us": pa.array(us, pa.int64()), "value": pa.array(value, mask=np.isnan(value)), "n_readings": pa.array(count), "cell_state": pa.array(state, pa.string())})


def _catalogue_limits(kind_fields: DataFrame) -> DataFrame:
    """Limits of each kind and field, and whether it is fenced, from the catalogue, whose rows ``limits_by_kind`` bounds."""
    rows = [(kind, field, low, high, unit in UNFENCED_UNITS) for (kind, field), (unit, low, high) in limits_by_kind(kind_fields).items()]
    return kind_fields.sparkSession.createDataFrame(rows, "kind string, field_name string, low_limit double, high_limit double, unfenced boolean")


def regular_grid(posts: DataFrame, requests: DataFrame, kind_fields: DataFrame) -> DataFrame:
    """Columns of OUT: one row per bucket of each request."""
    spark = posts.sparkSession
    # Requests and the days that they cover go to every task only where their counted rows are few.
    day = lambda us: F.floor(us / DAY_US).cast("int")
    plan = requests_plan(one_per_id(requests))
    covered, few = tiling.small(spark, plan.withColumn("day", F.explode(F.sequence(day(F.col("begin_us")), day(F.col("end_us") - 1)))))
    send = F.broadcast if few else (lambda df: df)
    fields = plan.select("index_name", "field_name").where(F.col("index_name").isNotNull() & F.col("field_name").isNotNull()).distinct()
    # Posts are read, resolved and shuffled once; the fences, the fit and the buckets take their readings from what is written.
    at = scratch_folder(spark)
    asked_readings(posts, fields).write.parquet(f"{at}/readings")
    readings = spark.read.schema("index_name string, us long, field_name string, v double").parquet(f"{at}/readings")
    models = seasonal_models(readings, _catalogue_limits(kind_fields))

    ts = F.timestamp_micros("us")
    met = readings.withColumn("day", day(F.col("us"))).join(send(covered), ["index_name", "field_name", "day"]).where((F.col("us") >= F.col("begin_us")) & (F.col("us") < F.col("end_us")))
    bucket = bucket_number(ts, F.col("step_us"), F.col("months"))
    met = met.select("grid_id", "us", "v", bucket.alias("bucket"), F.floor((bucket - F.col("first")) / SPAN).alias("span"))
    observed = met.groupBy("grid_id", "span", "bucket").agg(F.avg("v").alias("mean_v"), F.max_by("v", "us").alias("last_v"), F.count("*").alias("n"))

    ends = observed.where((F.abs("mean_v") < float("inf")) & (F.abs("last_v") < float("inf"))).groupBy("grid_id", "span").agg(F.min_by(F.struct("bucket", "mean_v", "last_v"), "bucket").alias("head"), F.max_by(F.struct("bucket", "mean_v", "last_v"), "bucket").alias("tail"))
    spans = plan.withColumn("span", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - F.col("first")) / SPAN))))
    spans = spans.withColumns({"low": F.col("first") + F.col("span") * SPAN, "high": F.least(F.col("last"), F.col("first") + (F.col("span") + 1) * SPAN - 1)})
    of_grid = Window.partitionBy("grid_id").orderBy("span")
    headers = spans.join(ends, ["grid_id", "span"], "left").withColumns({"prev": F.last("tail", ignorenulls=True).over(of_grid.rowsBetween(Window.unboundedPreceding, -1)), "next": F.first("head", ignorenulls=True).over(of_grid.rowsBetween(1, Window.unboundedFollowing))})
    headers = headers.join(models, ["index_name", "field_name"], "left").select(
        "grid_id", "span", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("double").alias("mean_v"), F.lit(None).cast("double").alias("last_v"), F.lit(0).cast("long").alias("n"),
        "index_name", "field_name", "step_us", "months", "low", "high", "sums", F.col("prev.bucket").alias("prev_bucket"), F.col("prev.mean_v").alias("prev_mean"), F.col("prev.last_v").alias("prev_last"), F.col("next.bucket").alias("next_bucket"), F.col("next.mean_v").alias("next_mean"),
    )
    cells = headers.unionByName(observed, allowMissingColumns=True).repartition("grid_id", "span").sortWithinPartitions("grid_id", "span", F.col("bucket").asc_nulls_first())
    catalogue = limits_by_kind(kind_fields)
    return cells.mapInArrow(over_chunks(lambda t: _fill(t, catalogue), ("grid_id", "span"), 50_000), OUT)
