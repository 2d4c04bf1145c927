"""The subpackage's registered queries; of its operators only the exact counts are expressible in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import chunking, corpus_ids, leaks, quantiles


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = quantiles.reading_percentiles(*(_table(spark, d, t) for t in ("posts", "grid_requests", "raw_queries", "rollups")))
    named = [F.col("p")[k].alias(f"p{round(100 * q):02d}") for k, q in enumerate(quantiles.PERCENTILES)]
    return rows.select("scope", "group_key", "field_name", "n_values", *named)


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """The exact part of the percentiles: how many values each group has."""
    return p3_percentiles(spark, d).where("scope != 'bucket' OR group_key LIKE 'grid %'").select("scope", "group_key", "field_name", "n_values")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return corpus_ids.encode_corpus(_table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.cut_documents(_table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_pieces(spark, d).where("piece_no = 0").select("doc_id").distinct()


QUERIES = {"p3_percentiles": p3_percentiles, "p3_counts": p3_counts, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found, "p10_pieces": p10_pieces}
ORACLE_SQL: dict[str, str] = {
    "p3_counts": """
WITH st AS (SELECT index_name, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY index_name, ts ORDER BY post_id DESC) AS rn FROM posts WHERE index_name IS NOT NULL AND ts IS NOT NULL) WHERE rn = 1 AND value IS NOT NULL),
c AS (SELECT * FROM (SELECT index_name, ts, unnest(map_keys(value)) AS field_name, unnest(map_values(value)) AS v FROM st) WHERE isfinite(v)),
g AS (SELECT grid_id, index_name, field_name, from_time, to_time, CAST(coalesce(nullif(regexp_extract(group_spec, '^([0-9]+)', 1), ''), '1') AS BIGINT) * CASE regexp_extract(group_spec, '([a-z]+?)s?$', 1) WHEN 'second' THEN 1000000 WHEN 'minute' THEN 60000000 WHEN 'hour' THEN 3600000000 WHEN 'day' THEN 86400000000 END AS step FROM grid_requests),
b AS (SELECT 'grid ' || grid_id || ' ' || (epoch_us(ts) // step * step) AS group_key, c.field_name FROM c JOIN g ON c.index_name = g.index_name AND c.field_name = g.field_name AND epoch_us(ts) >= epoch_us(from_time) // step * step AND epoch_us(ts) < (epoch_us(to_time) - 1) // step * step + step),
r AS (SELECT index_name || ' ' || level_name AS group_key, field_name, sum_v FROM (SELECT *, row_number() OVER (PARTITION BY index_name, level_name, bucket_start, field_name ORDER BY rollup_id DESC) AS rn FROM rollups WHERE index_name IS NOT NULL AND level_name IS NOT NULL AND bucket_start IS NOT NULL AND field_name IS NOT NULL) WHERE rn = 1 AND isfinite(sum_v))
SELECT 'series' AS scope, index_name AS group_key, field_name, count(*) AS n_values FROM c GROUP BY ALL
UNION ALL SELECT 'kind', split_part(index_name, '.', 1), field_name, count(*) FROM c GROUP BY ALL
UNION ALL SELECT 'bucket', group_key, field_name, count(*) FROM b GROUP BY ALL
UNION ALL SELECT 'rollup', group_key, field_name, count(*) FROM r GROUP BY ALL
""",
}
