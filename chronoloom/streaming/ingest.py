"""Continuous ingest into a store, and rollups maintained as points arrive.

A batch that is replayed after a failure counts once: in the store its stream and batch id are part of the commit itself,
so either both are seen or neither, and a rollup's part is written under a name that the batch id fixes. Points of any
age are accepted: late ones change only the buckets that they fall in. Without a watermark no state is held in the stream
at all - the rollup is on disk.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from chronoloom.plans.rollup import build_rollup, merge_rollup
from chronoloom.plans.spec import Group
from chronoloom.sources.store import BODY, Store


def read_rows(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of ``{"index", "time", "value"}`` rows from JSON files as they appear."""
    return spark.readStream.schema(BODY).option("maxFilesPerTrigger", files_per_batch).json(path)


def into_store(rows: DataFrame, store: Store, db: str, checkpoint: str, on_rejected=None, stream: str | None = None) -> DataStreamWriter:
    """Writer that appends each micro-batch as one commit; rejected rows go to ``on_rejected(frame, batch_id)``.

    stream: what names the stream among those that write into the database, by default the id in its checkpoint. Batches
    are numbered anew where a checkpoint is, so a name may be kept only together with its checkpoint.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        source = f"{stream or _stream_id(batch.sparkSession, checkpoint)}/{batch_id}"
        if store.done(db, source):
            return
        batch = batch.persist()
        try:
            result = store.ingest(db, batch.withColumn("pos", F.monotonically_increasing_id()), source)
            if on_rejected is not None:
                on_rejected(result.rejected, batch_id)
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that the engine gave the stream when it made the checkpoint."""
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint, "metadata")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()


def into_rollup(points: DataFrame, path: str, level: str, checkpoint: str) -> DataStreamWriter:
    """Writer that keeps a rollup of one level; each micro-batch adds one part per bucket that it touches.

    points: index_name, ts, ts_ns, value, each (index_name, ts_ns) once over the stream. ``read_rollup`` merges the parts.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        build_rollup(batch, level).drop("level").write.mode("overwrite").parquet(f"{path}/level={level}/batch={batch_id}")

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_rollup(spark: SparkSession, path: str, level: str) -> DataFrame:
    """The rollup's rows, the parts of each bucket merged."""
    return merge_rollup(spark.read.parquet(f"{path}/level={level}"), Group(1, level), level)


def windowed(points: DataFrame, group: Group, late: str) -> DataFrame:
    """Stateful alternative for unbounded feeds: emits a bucket once it can't change, drops what comes later than ``late``.

    points: index_name, ts (timestamp), ts_ns, field_name, v. Fixed units only.
    """
    if not group.step_us:
        raise ValueError("months and years vary in length; use into_rollup")
    rows = points.withWatermark("ts", late).groupBy("index_name", "field_name", F.window("ts", f"{group.step_us} microseconds"))
    return rows.agg(F.sum("v").alias("sum"), F.min("v").alias("min"), F.max("v").alias("max"), F.min_by("v", "ts_ns").alias("first"), F.max_by("v", "ts_ns").alias("last"), F.count("v").alias("count")).select("index_name", "field_name", F.col("window.start").alias("bucket_start"), "sum", "min", "max", "first", "last", "count")
