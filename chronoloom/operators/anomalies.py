"""Readings that spike, stick or cannot be, relative to what their series normally does.

Every series' field has a robust control chart: exponentially weighted mean and scale that are updated with clipped
deviations only, so that a fault moves neither. Readings far outside the chart are suspects, however many follow each other.
Run-length counters find stuck runs, physical limits the impossible. What needs the whole series - the range of its
ordinary readings, the share of repeats - is merged from the tiles' partial results. Suspects are then checked against it
exactly: those within its reach join it, then the nearest stretch of more than ``spike_run`` that all lie outside (a change
of level), until neither is left.

* ``impossible``: outside the field's limits, infinities included.
* ``stuck``: in a run of ``stuck_run`` or more equal successive readings, if fewer than a third of all the field's
  readings equal the one before.
* ``spike``: within the limits, at most ``spike_run`` readings long, and farther outside the range of all other ordinary
  readings than ``reach`` times its width.

Series are cut into tiles (see ``tiling``), so one series may hold a third of all rows. Within a tile the charts of all
series advance together, one numpy step per reading.

Defined cases: null and NaN are no readings; posts without series or time are left out; a field that the catalogue
doesn't list has no limits and is treated as measured; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators import tiling
from chronoloom.operators.readings import codes_of, limits_by_kind, map_parts, over_chunks
from chronoloom.session import ensure_checkpoint_dir

#: Units of counts, codes and rain: long runs of equal values and rare large ones are normal there.
UNCHARTED_UNITS = ("code", "n", "mm")
OUT = pa.schema([("index_name", pa.string()), ("field_name", pa.string()), ("row_kind", pa.string()), ("post_id", pa.int64()), ("v", pa.float64()), ("n", pa.int64()), ("n_same", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("low_moving", pa.float64()), ("high_moving", pa.float64()), ("stretch", pa.list_(pa.float64()))])
OUT_DDL = "index_name string, field_name string, row_kind string, post_id long, v double, n long, n_same long, low double, high double, low_moving double, high_moving double, stretch array<double>"


def run_lengths(change: np.ndarray) -> np.ndarray:
    """Length of the run that each element is in; change marks the elements that begin a run."""
    run = np.cumsum(change) - 1
    return np.bincount(run)[run] if len(run) else run


def chart(x: np.ndarray, starts: np.ndarray, weight: float, limit: float, clip: float, spike_run: int, warm: int = 32) -> np.ndarray:
    """Which elements of the sequences that begin at ``starts`` lie more than ``limit`` scales off their control chart.

    More than ``spike_run`` suspects in a row, of one side and each within twice the size of the one before, are a new level: the
    chart moves there and doubles its scale.
    """
    flags = np.zeros(len(x), bool)
    if not len(x):
        return flags
    lengths = np.diff(np.append(starts, len(x)))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    first = np.arange(warm)[None, :]
    head = np.where(first < lengths[:, None], x[np.minimum(starts[:, None] + first, len(x) - 1)], np.nan)
    mean = np.nanmedian(head, axis=1)
    scale = np.nanmedian(np.abs(head - mean[:, None]), axis=1) * 1.2
    in_a_row, last = np.zeros(len(starts), "int64"), np.zeros(len(starts))
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # at step t, the sequences longer than t
    for t in range(lengths[0]):
        m = active[t]
        at = starts[:m] + t
        d = x[at] - mean[:m]
        size = np.abs(d)
        floor = np.maximum(scale[:m], 1e-9 * np.abs(mean[:m]) + 1e-12)
        flags[at] = far = size > limit * floor
        alike = (d * last[:m] > 0) & (size < 2 * np.abs(last[:m])) & (np.abs(last[:m]) < 2 * size)
        in_a_row[:m] = (in_a_row[:m] * alike + 1) * far
        last[:m] = d
        bounded = np.minimum(size, clip * floor)
        mean[:m] += weight * np.copysign(bounded, d)
        scale[:m] = floor + weight * (bounded - floor)
        if (moved := np.flatnonzero(in_a_row[:m] > spike_run)).size:
            mean[moved] = x[at[moved]]
            scale[moved] *= 2
            in_a_row[moved] = 0
    return flags


def _tile(table: pa.Table, limits: dict, p: dict) -> pa.Table | None:
    series, names = codes_of(table.column("index_name").combine_chunks())
    tile, halo = table.column("tile").to_numpy(), table.column("halo").to_numpy(zero_copy_only=False)
    ts, post = table.column("ts_us").to_numpy(), table.column("post_id").to_numpy()
    # Rows come sorted by series, tile, time and post: of equal times the last stands.
    same = (series[1:] == series[:-1]) & (tile[1:] == tile[:-1]) & (ts[1:] == ts[:-1])
    stands = np.append(~same, True)
    value = table.column("value").combine_chunks()
    rows, keys, v = map_parts(value if isinstance(value, pa.Array) else value.chunk(0))
    keep = stands[rows] & ~np.isnan(v)
    rows, field, v, fields = rows[keep], np.asarray(keys.indices)[keep], v[keep], keys.dictionary.to_pylist()
    if not len(rows):
        return None
    group = np.cumsum(np.append(True, (series[1:] != series[:-1]) | (tile[1:] != tile[:-1]))) - 1
    key = group[rows].astype("int64") * len(fields) + field
    order = np.argsort(key, kind="stable")
    rows, field, v, key = rows[order], field[order], v[order], key[order]
    begins = np.append(True, key[1:] != key[:-1])
    sequence = np.cumsum(begins) - 1
    starts = np.flatnonzero(begins)
    catalogue = [limits.get((names[series[rows[s]]].split(".", 1)[0].strip().lower(), fields[field[s]]), ("", -np.inf, np.inf)) for s in starts]
    low, high = (np.array([c[k] for c in catalogue])[sequence] for k in (1, 2))
    charted = np.array([c[0] not in UNCHARTED_UNITS for c in catalogue])[sequence]
    impossible = (v < low) | (v > high) | np.isinf(v)
    repeats = np.append(False, v[1:] == v[:-1]) & ~begins
    stuck = charted & (run_lengths(~repeats) >= p["stuck_run"])
    live = np.flatnonzero(charted & ~impossible & ~stuck)
    suspect, stretch = np.zeros(len(v), bool), {}
    if len(live):
        new = np.append(True, sequence[live][1:] != sequence[live][:-1])
        far = chart(v[live], np.flatnonzero(new), p["weight"], p["limit"], p["clip"], p["spike_run"])
        suspect[live] = far
        # Stretches of more than spike_run suspects, by their first.
        last = p["spike_run"]
        stretches = sliding_window_view(far, last + 1).all(axis=1) & (sequence[live][last:] == sequence[live][:-last]) if len(live) > last else np.zeros(0, bool)
        stretch = {int(live[k]): v[live[k : k + last + 1]].tolist() for k in np.flatnonzero(stretches)}
    own = ~halo[rows]
    ordinary = charted & ~impossible & ~suspect & own
    n_seq = len(starts)

    def extreme(mask: np.ndarray, ufunc, start: float) -> np.ndarray:
        out = np.full(n_seq, start)
        ufunc.at(out, sequence[mask], v[mask])
        return out

    counts = {"n": np.bincount(sequence[own], minlength=n_seq), "n_same": np.bincount(sequence[own & repeats], minlength=n_seq)}
    ranges = {"low": extreme(ordinary, np.minimum, np.inf), "high": extreme(ordinary, np.maximum, -np.inf), "low_moving": extreme(ordinary & ~stuck, np.minimum, np.inf), "high_moving": extreme(ordinary & ~stuck, np.maximum, -np.inf)}
    name_at = lambda at: pa.array([names[series[r]] for r in rows[at]], pa.string())
    field_at = lambda at: pa.array([fields[f] for f in field[at]], pa.string())
    used = counts["n"] > 0
    summary = pa.table([name_at(starts[used]), field_at(starts[used]), pa.array(["summary"] * int(used.sum())), pa.nulls(int(used.sum()), pa.int64()), pa.nulls(int(used.sum()), pa.float64()), *(pa.array(counts[k][used].astype("int64")) for k in counts), *(pa.array(ranges[k][used]) for k in ranges), pa.nulls(int(used.sum()), OUT.types[-1])], schema=OUT)
    parts = [summary]
    for kind, mask in (("impossible", impossible & own), ("stuck", stuck & own), ("spike", suspect & own)):
        at = np.flatnonzero(mask)
        none = [pa.nulls(len(at), t) for t in OUT.types[5:-1]]
        stretches = pa.array([stretch.get(int(k)) for k in at] if kind == "spike" else [None] * len(at), OUT.types[-1])
        parts.append(pa.table([name_at(at), field_at(at), pa.array([kind] * len(at), pa.string()), pa.array(post[rows[at]]), pa.array(v[at]), *none, stretches], schema=OUT))
    return pa.concat_tables(parts)


def _grow(bins: list, stretches: list, low: float, high: float, reach: float) -> tuple[float, float]:
    """The ordinary range after all suspects that are within its reach have joined, nearest first, and stretches that stay outside it."""
    above = sorted((b for b in bins if b["low"] > high), key=lambda b: b["low"])
    below = sorted((b for b in bins if b["high"] < low), key=lambda b: -b["high"])
    while True:
        width = high - low
        if above and above[0]["low"] - high <= reach * width:
            high = max(high, above.pop(0)["high"])
        elif below and low - below[0]["high"] <= reach * width:
            low = min(low, below.pop(0)["low"])
        elif stretches := [s for s in stretches if (s["above_near"] is None or s["above_near"] > high) and (s["below_near"] is None or s["below_near"] < low)]:
            near = min(stretches, key=lambda s: max(0 if s["above_far"] is None else s["above_far"] - high, 0 if s["below_far"] is None else low - s["below_far"]))
            high = high if near["above_far"] is None else max(high, near["above_far"])
            low = low if near["below_far"] is None else min(low, near["below_far"])
        else:
            return low, high


def flag_readings(posts: DataFrame, kind_fields: DataFrame, *, weight: float = 0.1, limit: float = 6.0, clip: float = 3.0, stuck_run: int = 10, spike_run: int = 3, reach: float = 1.5, tile_rows: int = 65_536, halo_rows: int = 1_024) -> DataFrame:
    """One row per faulty reading: post_id, index_name, field_name, case_kind, v, low, high (the range of ordinary readings).

    weight: of the newest reading in the charts; limit and clip: in scales; the other parameters as in the module's text.
    """
    limits = limits_by_kind(kind_fields)
    p = {"weight": weight, "limit": limit, "clip": clip, "stuck_run": stuck_run, "spike_run": spike_run}
    rows = posts.where(F.col("index_name").isNotNull() & F.col("ts").isNotNull()).select("index_name", "ts", "post_id", "value")
    tiled = tiling.assign(rows, tile_rows, halo_rows)
    sorted_rows = tiled.withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts").repartition("index_name", "tile").sortWithinPartitions("index_name", "tile", "ts_us", "post_id")
    ensure_checkpoint_dir(posts.sparkSession)
    # Summaries and suspects are a small part of the readings; both sides of the check below read them.
    seen = sorted_rows.mapInArrow(over_chunks(lambda t: _tile(t, limits, p), ("index_name", "tile"), 150_000), OUT_DDL).checkpoint()
    key = ["index_name", "field_name"]
    repeats = F.col("n_same") * 3 >= F.col("n")
    totals = seen.where("row_kind = 'summary'").groupBy(*key).agg(F.sum("n").alias("n"), F.sum("n_same").alias("n_same"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("low_moving").alias("low_moving"), F.max("high_moving").alias("high_moving"))
    totals = totals.select(*key, repeats.alias("repeats"), F.when(repeats, F.col("low")).otherwise(F.col("low_moving")).alias("low"), F.when(repeats, F.col("high")).otherwise(F.col("high_moving")).alias("high"))
    candidates = seen.where("row_kind != 'summary'").select(*key, "row_kind", "post_id", "v", "stretch").join(totals, key)
    spikes = candidates.where((F.col("row_kind") == "spike") & ((F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))))
    # Suspects by side and binary order of their distance from the middle: a gap that ends the range is wider than a bin.
    middle = (F.col("low") + F.col("high")) / 2
    order = lambda x: F.floor(F.log2(F.abs(x - middle))).cast("int")
    bins = spikes.groupBy(*key, "low", "high", (F.col("v") > F.col("high")).alias("above"), order(F.col("v")).alias("bin")).agg(F.min("v").alias("bin_low"), F.max("v").alias("bin_high"))
    bins = bins.groupBy(*key, "low", "high").agg(F.collect_list(F.struct(F.col("bin_low").alias("low"), F.col("bin_high").alias("high"))).alias("bins"))
    # Stretches by the bins of their nearest and farthest readings on either side; those with a reading in the range are none.
    outside = spikes.where(F.col("stretch").isNotNull() & ~F.exists("stretch", lambda x: (x >= F.col("low")) & (x <= F.col("high"))))
    over, under = F.filter("stretch", lambda x: x > F.col("high")), F.filter("stretch", lambda x: x < F.col("low"))
    edges = {"above_near": F.array_min(over), "above_far": F.array_max(over), "below_near": F.array_max(under), "below_far": F.array_min(under)}
    outside = outside.select(*key, "low", "high", *(c.alias(k) for k, c in edges.items()))
    outside = outside.groupBy(*key, *(order(F.col(k)).alias(f"{k}_bin") for k in edges)).agg(F.min("above_near").alias("above_near"), F.max("above_far").alias("above_far"), F.max("below_near").alias("below_near"), F.min("below_far").alias("below_far"))
    bins = bins.join(outside.groupBy(*key).agg(F.collect_list(F.struct(*edges)).alias("stretches")), key, "left")

    def widen(batches):
        for pdf in batches:
            dicts = lambda xs: [x if isinstance(x, dict) else x.asDict() for x in (xs if xs is not None else ())]
            found = [_grow(dicts(bs), dicts(ss), lo, hi, reach) for bs, ss, lo, hi in zip(pdf.bins, pdf.stretches, pdf.low, pdf.high)]
            yield pdf[key].assign(wide_low=[f[0] for f in found], wide_high=[f[1] for f in found])

    ranges = bins.mapInPandas(widen, "index_name string, field_name string, wide_low double, wide_high double")
    spikes = spikes.join(ranges, key).where((F.col("v") < F.col("wide_low")) | (F.col("v") > F.col("wide_high")))
    spikes = spikes.select("post_id", *key, F.col("row_kind").alias("case_kind"), "v", F.col("wide_low").alias("low"), F.col("wide_high").alias("high"))
    plain = candidates.where((F.col("row_kind") == "impossible") | ((F.col("row_kind") == "stuck") & ~F.col("repeats")))
    return spikes.unionByName(plain.select("post_id", *key, F.col("row_kind").alias("case_kind"), "v", "low", "high"))
