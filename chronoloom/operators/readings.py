"""Standing posts, and Arrow helpers that hand map columns to numpy without a Python object per reading."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


HOUR_US = 3_600_000_000


def standing(posts: DataFrame, keys: tuple[str, ...] = ("index_name", "ts"), version: str = "post_id", keep: tuple[str, ...] = ("value",)) -> DataFrame:
    """The rows that stand: of those with non-null keys, the highest version of each key, whole.

    One shuffle and one sort. With a time among the keys the shuffle is on series and hour, so that a series with a large
    share of the rows is spread evenly and what falls into one bucket lies together; else on all keys.
    """
    rows = posts.select(*keys, version, *keep)
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    together = keys
    if "ts" in keys:
        rows = rows.withColumn("__hour", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / HOUR_US))
        rows, together = rows.repartition("index_name", "__hour"), ("index_name", "__hour", *(k for k in keys if k != "index_name"))
    later = F.lead(F.lit(True)).over(Window.partitionBy(*together).orderBy(version))
    return rows.withColumn("__later", later).where(F.col("__later").isNull()).select(*keys, version, *keep)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where the input has fewer splits than there are cores (one small file, say), else as read.

    For frames that come straight from a scan: counting the splits of a shuffled plan would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def kind_of(name=None):
    """Kind of a series: its name before the first dot."""
    return F.substring_index(name if name is not None else F.col("index_name"), ".", 1)


def limits_by_kind(kind_fields: DataFrame) -> dict[tuple[str, str], tuple[str, float, float]]:
    """(kind, field) to (unit, low, high). The catalogue of fields is fixed and small; more rows than the bound fail."""
    bound = 100_000
    rows = kind_fields.select("kind", "field_name", "unit", "low_limit", "high_limit").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"kind_fields has more than {bound} rows; it is meant to be a catalogue")
    inf = float("inf")
    return {
        (r.kind.strip().lower(), r.field_name): (r.unit or "", -inf if r.low_limit is None else r.low_limit, inf if r.high_limit is None else r.high_limit)
        for r in rows
        if r.kind is not None and r.field_name is not None
    }


def map_parts(column: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray]:
    """Of a map<string,double> array: each entry's row, its key as a dictionary array, and its value (null as NaN)."""
    offsets = np.asarray(column.offsets)
    lengths = np.diff(offsets)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_valid()), lengths, 0)
    rows = np.repeat(np.arange(len(column)), lengths)
    take = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(offsets[:-1], lengths)
    keys = column.keys.take(pa.array(take)).dictionary_encode()
    values = column.items.take(pa.array(take)).cast(pa.float64()).to_numpy(zero_copy_only=False)
    return rows, keys, values


def codes_of(column: pa.Array) -> tuple[np.ndarray, list]:
    """Integer codes and the distinct values of a column; null has a code of its own."""
    d = column.dictionary_encode("encode")
    return np.asarray(d.indices), d.dictionary.to_pylist()


def chunks(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that never cut a group of equal keys; the batches must come sorted by the keys. Without keys any cut is good."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        if not keys:
            yield table
            held, size = [], 0
            continue
        tail = np.ones(size, bool)
        for k in keys:
            column = table.column(k)
            last = column[-1]
            same = pc.fill_null(pc.equal(column, last), False) if last.is_valid else column.is_null()
            tail &= same.to_numpy()
        cut = size - int(tail[::-1].argmin()) if not tail.all() else 0
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
        held, size = rest.to_batches(), rest.num_rows
        if not cut:
            rows = max(rows, 2 * size)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def over_chunks(work: Callable[[pa.Table], pa.Table | None], keys: tuple[str, ...], rows: int) -> Callable:
    """A function for mapInArrow that applies ``work`` to whole groups of sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, keys, rows):
            out = work(table)
            if out is not None and out.num_rows:
                yield from out.combine_chunks().to_batches(max_chunksize=100_000)

    return run
