"""The core's registered queries: name to callable of (spark, directory of the tables)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import anomalies, drift, grid, impute, instants, trailing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    changes = drift.drift_report(table(spark, d, "raw_posts"), table(spark, d, "raw_queries"))
    return changes.select("feed", "file_no", "change_kind", "field_from", "field_to").distinct()


def p1_consistent(spark: SparkSession, d: str) -> DataFrame:
    rows = drift.consistent_table(table(spark, d, "raw_posts"), table(spark, d, "raw_queries"))
    as_text = lambda c: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))), {"ignoreNullFields": "false"})
    return rows.select("table_name", "rec_id", "feed", "file_no", "entry_pos", "entry_name", "read_status", "schema_version", as_text(F.col("numbers")).alias("numbers"), as_text(F.col("texts")).alias("texts"), F.concat_ws(";", "applied").alias("applied"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    read = instants.normalise_times(*(table(spark, d, t) for t in ("raw_posts", "raw_queries", "series_info")))
    return read.where(~F.col("canonical")).select("table_name", "rec_id", "time_field", "time_status", "ts_ns").distinct()


def _day_text() -> Column:
    return F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd").alias("day_text")


def p4_trailing(spark: SparkSession, d: str) -> DataFrame:
    rows = trailing.trailing_totals(table(spark, d, "posts")).where(F.col("field_name").isNotNull())
    return rows.select("index_name", "field_name", _day_text(), F.col("window_days").cast("long").alias("window_days"), "n_posts", "n_readings", F.round("total", 6).alias("total"), F.round("average", 6).alias("average"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = trailing.trailing_totals(table(spark, d, "posts"))
    return rows.where(F.col("field_name").isNull() & (F.col("n_posts") == 0)).select("index_name", _day_text(), F.col("window_days").cast("long").alias("window_days"))


def p5_filled(spark: SparkSession, d: str) -> DataFrame:
    return impute.fill_missing(table(spark, d, "posts"), table(spark, d, "points"), table(spark, d, "kind_fields"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    # Each row is one that was filled, or for which nothing like it was ever recorded.
    return p5_filled(spark, d).where("filled IS NOT NULL OR source = 'none'").select("table_name", "rec_id", "field_name")


def p5_by_rule(spark: SparkSession, d: str) -> DataFrame:
    """The values that relations between the fields of a row fill."""
    return p5_filled(spark, d).where("source LIKE 'rule:%'").select("table_name", "rec_id", "field_name", F.round("filled", 6).alias("filled"), "source")


def p6_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.regular_grid(table(spark, d, "posts"), table(spark, d, "grid_requests"), table(spark, d, "kind_fields"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_grid(spark, d).where("cell_state != 'observed'").select("grid_id", "bucket_us")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    flagged = anomalies.flag_readings(table(spark, d, "posts"), table(spark, d, "kind_fields"))
    return flagged.select("post_id", "field_name", "case_kind").distinct()


def p7_limits_and_runs(spark: SparkSession, d: str) -> DataFrame:
    """The faults that plain SQL can tell: impossible values and stuck runs."""
    return p7_found(spark, d).where("case_kind != 'spike'")


QUERIES = {"p1_found": p1_found, "p1_consistent": p1_consistent, "p2_found": p2_found, "p4_found": p4_found, "p4_trailing": p4_trailing, "p5_found": p5_found, "p5_filled": p5_filled, "p5_by_rule": p5_by_rule, "p6_found": p6_found, "p6_grid": p6_grid, "p7_found": p7_found, "p7_limits_and_runs": p7_limits_and_runs}

_STANDING = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY index_name, ts ORDER BY post_id DESC) AS rn FROM posts WHERE index_name IS NOT NULL AND ts IS NOT NULL) WHERE rn = 1"
_TRAILING = """
WITH st AS (SELECT index_name, ts, max(post_id) AS post_id FROM posts WHERE index_name IS NOT NULL AND ts IS NOT NULL GROUP BY index_name, ts),
sp AS (SELECT p.index_name, CAST(p.ts AS DATE) AS d, p.value FROM posts p JOIN st USING (index_name, ts, post_id)),
days AS (SELECT index_name, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM sp GROUP BY index_name),
np AS (SELECT index_name, d, count(*) AS n FROM sp GROUP BY index_name, d),
cells AS (SELECT index_name, d, unnest(map_keys(value)) AS f, unnest(map_values(value)) AS v FROM sp WHERE value IS NOT NULL),
daily AS (SELECT index_name, f, d, count(v) FILTER (WHERE isfinite(v)) AS n, sum(v) FILTER (WHERE isfinite(v)) AS s FROM cells GROUP BY index_name, f, d),
fields AS (SELECT DISTINCT index_name, f FROM daily),
grid AS (SELECT days.index_name, f, days.d, coalesce(np.n, 0) AS np, coalesce(daily.n, 0) AS n, coalesce(daily.s, 0) AS s FROM days JOIN fields USING (index_name) LEFT JOIN np USING (index_name, d) LEFT JOIN daily USING (index_name, f, d)),
r AS (SELECT index_name, f, d, w, CASE w WHEN 7 THEN sum(np) OVER w7 ELSE sum(np) OVER w30 END AS np, CASE w WHEN 7 THEN sum(n) OVER w7 ELSE sum(n) OVER w30 END AS n, CASE w WHEN 7 THEN sum(s) OVER w7 ELSE sum(s) OVER w30 END AS s
 FROM grid CROSS JOIN (VALUES (7), (30)) AS ws(w)
 WINDOW w7 AS (PARTITION BY index_name, f, w ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY index_name, f, w ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""
ORACLE_SQL = {
    "p4_trailing": _TRAILING + "SELECT index_name, f AS field_name, strftime(d, '%Y-%m-%d') AS day_text, CAST(w AS BIGINT) AS window_days, CAST(np AS BIGINT) AS n_posts, CAST(n AS BIGINT) AS n_readings, round(s, 6) AS total, CASE WHEN n > 0 THEN round(s / n, 6) END AS average FROM r",
    "p4_found": f"""
WITH sp AS (SELECT DISTINCT index_name, CAST(ts AS DATE) AS d FROM ({_STANDING})),
days AS (SELECT index_name, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM sp GROUP BY index_name)
SELECT index_name, strftime(d, '%Y-%m-%d') AS day_text, CAST(w AS BIGINT) AS window_days FROM days CROSS JOIN (VALUES (7), (30)) AS ws(w)
WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.index_name = days.index_name AND sp.d <= days.d AND sp.d > days.d - CAST(w AS INTEGER))
""",
    "p5_found": f"""
WITH st AS (SELECT 'posts' AS table_name, post_id AS rec_id, index_name, value FROM ({_STANDING})
 UNION ALL SELECT 'points', point_id, index_name, value FROM (SELECT *, row_number() OVER (PARTITION BY index_name, ts_ns ORDER BY point_id DESC) AS rn FROM points WHERE index_name IS NOT NULL AND ts_ns IS NOT NULL) WHERE rn = 1),
x AS (SELECT table_name, rec_id, field_name, element_at(value, field_name)[1] AS v, low_limit, high_limit FROM st JOIN kind_fields ON split_part(index_name, '.', 1) = kind)
SELECT table_name, rec_id, field_name FROM x WHERE v IS NULL OR isnan(v) OR (table_name = 'points' AND (v < low_limit OR v > high_limit))
""",
    "p6_found": f"""
WITH g AS (SELECT *, CAST(coalesce(nullif(regexp_extract(group_spec, '^([0-9]+)', 1), ''), '1') AS BIGINT) * CASE regexp_extract(group_spec, '([a-z]+?)s?$', 1) WHEN 'second' THEN 1000000 WHEN 'minute' THEN 60000000 WHEN 'hour' THEN 3600000000 WHEN 'day' THEN 86400000000 END AS step FROM grid_requests WHERE from_time IS NOT NULL AND to_time IS NOT NULL),
b AS (SELECT grid_id, index_name, field_name, step, unnest(generate_series(epoch_us(from_time) // step, (epoch_us(to_time) - 1) // step)) * step AS bucket_us FROM g),
r AS (SELECT index_name, epoch_us(ts) AS us, unnest(map_keys(value)) AS field_name, unnest(map_values(value)) AS v FROM ({_STANDING}) WHERE value IS NOT NULL),
full_b AS (SELECT DISTINCT g.grid_id, r.us // g.step * g.step AS bucket_us FROM g JOIN r ON r.index_name = g.index_name AND r.field_name = g.field_name AND r.v IS NOT NULL AND NOT isnan(r.v))
SELECT b.grid_id, b.bucket_us FROM b LEFT JOIN full_b USING (grid_id, bucket_us) WHERE full_b.grid_id IS NULL
""",
    "p5_by_rule": f"""
WITH st AS (SELECT 'posts' AS table_name, post_id AS rec_id, index_name, value FROM ({_STANDING})
 UNION ALL SELECT 'points', point_id, index_name, value FROM (SELECT *, row_number() OVER (PARTITION BY index_name, ts_ns ORDER BY point_id DESC) AS rn FROM points WHERE index_name IS NOT NULL AND ts_ns IS NOT NULL) WHERE rn = 1),
x AS (SELECT table_name, rec_id, field_name, element_at(value, field_name)[1] AS v, low_limit, high_limit FROM st JOIN kind_fields ON split_part(index_name, '.', 1) = kind WHERE kind = 'power' AND field_name <> 'state'),
y AS (SELECT *, v IS NULL OR isnan(v) OR (table_name = 'points' AND (v < low_limit OR v > high_limit)) AS missing, CASE WHEN v >= low_limit AND v <= high_limit AND NOT isnan(v) THEN v END AS good FROM x),
r AS (SELECT table_name, rec_id, max(good) FILTER (WHERE field_name = 'watts') AS w, max(good) FILTER (WHERE field_name = 'amps') AS a, max(good) FILTER (WHERE field_name = 'volts') AS u FROM y GROUP BY ALL),
f AS (SELECT table_name, rec_id, field_name, CASE field_name WHEN 'watts' THEN a * u WHEN 'amps' THEN CASE WHEN u <> 0 THEN w / u END ELSE CASE WHEN a <> 0 THEN w / a END END AS filled FROM y JOIN r USING (table_name, rec_id) WHERE missing)
SELECT table_name, rec_id, field_name, round(filled, 6) AS filled, 'rule:watts=amps*volts' AS source FROM f WHERE filled IS NOT NULL
""",
    "p7_limits_and_runs": f"""
WITH c AS (SELECT post_id, index_name, ts, unnest(map_keys(value)) AS field_name, unnest(map_values(value)) AS v FROM ({_STANDING}) WHERE value IS NOT NULL),
k AS (SELECT c.*, unit, low_limit, high_limit FROM c LEFT JOIN kind_fields f ON split_part(index_name, '.', 1) = f.kind AND c.field_name = f.field_name WHERE v IS NOT NULL AND NOT isnan(v)),
s AS (SELECT *, coalesce(v = lag(v) OVER w, false) AS same FROM k WINDOW w AS (PARTITION BY index_name, field_name ORDER BY ts)),
g AS (SELECT *, count(*) FILTER (WHERE NOT same) OVER (PARTITION BY index_name, field_name ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM s),
n AS (SELECT *, count(*) OVER (PARTITION BY index_name, field_name, run) AS size, count(*) FILTER (WHERE same) OVER (PARTITION BY index_name, field_name) * 3 < count(*) OVER (PARTITION BY index_name, field_name) AS varied FROM g)
SELECT post_id, field_name, 'impossible' AS case_kind FROM n WHERE v < low_limit OR v > high_limit OR isinf(v)
UNION SELECT post_id, field_name, 'stuck' FROM n WHERE size >= 10 AND varied AND coalesce(unit, '') NOT IN ('code', 'n', 'mm')
""",
}
