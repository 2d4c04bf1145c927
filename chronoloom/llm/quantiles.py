"""Percentiles of very large numeric columns from mergeable sketches: dyadic Count-sketches.

A value is encoded in 32 bits that sort as the values do (sign, exponent and 20 bits of mantissa: a relative resolution of
about 1e-6). At every binary resolution a sketch counts the values in each dyadic interval. A resolution with no more
occupied intervals than a Count-sketch has counters (``DEPTH`` rows of ``WIDTH``) is counted exactly, so are the coarsest
``LEAST_BITS``; each finer one is a signed Count-sketch, read as the median of its rows. Resolutions turn from exact to
sketched as a group grows, from the finest on: of a small group all are exact, and the finest alone, from which the
others follow, is all that is kept. Sketches merge by addition, whatever their resolutions are, and a deletion is an
addition of a negative count. A percentile is found by descending the resolutions: left if the rank lies in the left half,
else right; among exact ones that is a search in running totals.

The rank error stays below ``RANK_ERROR`` of the count (measured in the tests; the Count-sketch bound holds with high
probability), and is none while all resolutions are exact.

Every partition sketches what it holds before anything is shuffled, so of a hot group one sketch of bounded size per
partition moves; sketches with counters then meet in up to ``SALTS`` tasks a group, and their sums in one. Null, NaN and
infinite values count nowhere; groups without values, and empty tables, give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.grid import DAY_US, one_per_id, requests_plan
from chronoloom.operators.readings import codes_of, map_parts, standing

BITS = 32
LEAST_BITS = 11
WIDTH = 1024
DEPTH = 5
SALTS = 256
RANK_ERROR = 0.01
PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: Values that a task sketches at once, and bytes of sketches that it merges at once.
FLUSH_VALUES, FLUSH_BYTES = 1_000_000, 32 << 20
LEVELS = BITS - LEAST_BITS
#: Posts and what is asked of them meet by series and slot; a day has a whole number of slots.
SLOT_US = DAY_US // 6
_MULTIPLIERS = np.random.default_rng(20_250_203).integers(1, 2**63, (2, LEVELS, DEPTH), dtype="uint64") * np.uint64(2) + np.uint64(1)
_WIDTH_SHIFT = np.uint64(64 - WIDTH.bit_length() + 1)
KEYS = ("scope", "group_key", "field_name")
#: Sketches of groups: ``bits`` is the finest exact resolution.
ROWS = pa.schema([("scope", pa.string()), ("group_key", pa.string()), ("field_name", pa.string()), ("bits", pa.int8()), ("sketch", pa.large_binary())])
ROWS_DDL = "scope string, group_key string, field_name string, bits byte, sketch binary"
RESULT_DDL = "scope string, group_key string, field_name string, n_values long, p array<double>"
#: An interval and its count.
ENTRY = np.dtype([("prefix", "<u4"), ("count", "<i8")])
MONTH0 = np.datetime64("1970-01", "M")


def encode(v: np.ndarray) -> np.ndarray:
    """Codes of finite values, in their order."""
    bits = (np.asarray(v, "float64") + 0.0).view("uint64")
    ordered = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))
    return (ordered >> np.uint64(64 - BITS)).astype("int64")


def decode(code: np.ndarray) -> np.ndarray:
    """The value in the middle of a code's interval."""
    ordered = (np.asarray(code).astype("uint64") << np.uint64(64 - BITS)) | np.uint64(1 << (63 - BITS))
    exact = (np.asarray(code).astype("uint64") << np.uint64(64 - BITS)) == np.uint64(1 << 63)
    bits = np.where(ordered >> np.uint64(63), ordered & np.uint64((1 << 63) - 1), ~ordered)
    return np.where(exact, 0.0, bits.view("float64"))


def _summed(prefix: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted prefixes, each once with its sum; without those that come to nothing."""
    order = np.argsort(prefix, kind="stable")
    prefix, count = prefix[order], count[order]
    first = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1])) if len(prefix) else np.zeros(0, int)
    prefix, count = prefix[first], np.add.reduceat(count, first) if len(first) else count[:0]
    return prefix[count != 0], count[count != 0]


class DyadicSketch:
    """Counts of codes at every binary resolution; see the module's text."""

    def __init__(self, bits: int = BITS, prefix: np.ndarray | None = None, count: np.ndarray | None = None, table: np.ndarray | None = None):
        self.bits = bits  # the finest exact resolution
        self.prefix = np.zeros(0, "int64") if prefix is None else prefix
        self.count = np.zeros(0, "int64") if count is None else count
        # The sketched resolutions, bits + 1 first.
        self.table = np.zeros((BITS - bits, DEPTH, WIDTH), "int64") if table is None else table

    @staticmethod
    def _place(bits: int, prefix: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        x = prefix.astype("uint64") + np.uint64(1)
        level = bits - LEAST_BITS - 1
        for d in range(DEPTH):
            mixed = x * _MULTIPLIERS[0, level, d]
            mixed ^= mixed >> np.uint64(29)
            mixed *= _MULTIPLIERS[1, level, d]
            yield d, (mixed >> _WIDTH_SHIFT).astype("int64"), 1 - 2 * ((mixed >> np.uint64(20)) & np.uint64(1)).astype("int64")

    def _sketch(self, prefix: np.ndarray, count: np.ndarray, finest: int) -> tuple[np.ndarray, np.ndarray]:
        """Adds intervals of resolution ``finest``, summed, to the sketched resolutions up to it; those of the exact one."""
        for bits in range(finest, self.bits, -1):  # finest first: each coarser resolution has fewer intervals to add
            for d, at, sign in self._place(bits, prefix):
                self.table[bits - self.bits - 1, d] += np.bincount(at, weights=sign * count, minlength=WIDTH).astype("int64")
            prefix, count = _summed(prefix >> 1, count)
        return prefix, count

    def _coarsen(self, bits: int) -> None:
        """Makes the resolutions from ``bits`` on the sketched ones."""
        if bits < self.bits:
            was, self.bits = self.bits, bits
            self.table = np.concatenate([np.zeros((was - bits, DEPTH, WIDTH), "int64"), self.table])
            self.prefix, self.count = self._sketch(self.prefix, self.count, was)

    def _fit(self) -> DyadicSketch:
        bits, n, prefix = self.bits, len(self.prefix), self.prefix
        while n > DEPTH * WIDTH and bits > LEAST_BITS:
            bits -= 1
            prefix = prefix >> 1
            n = int((prefix[1:] != prefix[:-1]).sum()) + 1
        self._coarsen(bits)
        return self

    def add(self, codes: np.ndarray, counts: np.ndarray) -> DyadicSketch:
        """Adds counts (negative to delete) of codes; in place."""
        prefix, count = self._sketch(*_summed(codes, counts), BITS)
        self.prefix, self.count = _summed(np.append(self.prefix, prefix), np.append(self.count, count))
        return self._fit()

    def merge(self, other: DyadicSketch) -> DyadicSketch:
        self._coarsen(other.bits)
        self.table[other.bits - self.bits :] += other.table
        prefix, count = self._sketch(other.prefix, other.count, other.bits)
        self.prefix, self.count = _summed(np.append(self.prefix, prefix), np.append(self.count, count))
        return self._fit()

    @property
    def n(self) -> int:
        return int(self.count.sum())

    def codes_at(self, ranks: np.ndarray) -> np.ndarray:
        """Codes whose ranks (from 0) are about those given."""
        upto = np.cumsum(self.count)
        at = np.minimum(np.searchsorted(upto, ranks, side="right"), len(upto) - 1)
        prefix, rest, size = self.prefix[at], ranks - (upto[at] - self.count[at]), self.count[at].astype(float)
        for bits in range(self.bits + 1, BITS + 1):
            left = prefix << 1
            rows = self.table[bits - self.bits - 1]
            inside = np.clip(np.median([rows[d, at] * sign for d, at, sign in self._place(bits, left)], axis=0), 0, size)
            right = rest >= inside
            prefix = left + right
            rest = np.where(right, rest - inside, rest)
            size = np.where(right, size - inside, inside)
        return prefix

    def quantiles(self, q) -> np.ndarray:
        return decode(self.codes_at(np.maximum(np.ceil(np.asarray(q) * self.n) - 1, 0)))

    def to_bytes(self) -> bytes:
        """While all is exact the bare entries, so that those of many groups are read and written at once."""
        entries = np.empty(len(self.prefix), ENTRY)
        entries["prefix"], entries["count"] = self.prefix, self.count
        return entries.tobytes() if self.bits == BITS else zlib.compress(np.int64(len(entries)).tobytes() + entries.tobytes() + self.table.astype("<i8").tobytes(), 1)

    @classmethod
    def from_bytes(cls, data: bytes, bits: int) -> DyadicSketch:
        if bits == BITS:
            entries, table = np.frombuffer(data, ENTRY), None
        else:
            data = zlib.decompress(data)
            end = 8 + int(np.frombuffer(data[:8], "<i8")[0]) * ENTRY.itemsize
            entries, table = np.frombuffer(data[8:end], ENTRY), np.frombuffer(data[end:], "<i8").reshape(BITS - bits, DEPTH, WIDTH).copy()
        return cls(bits, entries["prefix"].astype("int64"), entries["count"].astype("int64"), table)


class Groups:
    """Sketches of many groups at once, by number: exact entries in common arrays, and objects for those with counters."""

    def __init__(self, group: np.ndarray, codes: np.ndarray, counts: np.ndarray, dense: dict[int, DyadicSketch] | None = None):
        self.dense = dense or {}
        order = np.lexsort((codes, group))
        group, codes, counts = group[order], codes[order], counts[order]
        change = np.append(True, (group[1:] != group[:-1]) | (codes[1:] != codes[:-1]))[: len(group)]
        first = np.flatnonzero(change)
        group, codes, counts = group[first], codes[first], np.add.reduceat(counts, first) if len(first) else counts[:0]
        alive = counts != 0
        group, codes, counts = group[alive], codes[alive], counts[alive]
        begins = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
        sizes = np.diff(np.append(begins, len(group)))
        grown = [(int(group[b]), slice(b, b + s)) for b, s in zip(begins, sizes) if s > DEPTH * WIDTH or int(group[b]) in self.dense]
        if grown:
            stay = np.ones(len(group), bool)
            for g, rows in grown:
                self.dense.setdefault(g, DyadicSketch()).add(codes[rows], counts[rows])
                stay[rows] = False
            group, codes, counts = group[stay], codes[stay], counts[stay]
            begins = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
            sizes = np.diff(np.append(begins, len(group)))
        self.ids, self.begins, self.sizes, self.codes, self.counts = group[begins], begins, sizes, codes, counts

    def table(self, keys: list[pa.Array]) -> pa.Table:
        """Rows of ROWS."""
        entries = np.empty(len(self.codes), ENTRY)
        entries["prefix"], entries["count"] = self.codes, self.counts
        offsets = np.append(self.begins, len(self.codes)).astype("int64") * ENTRY.itemsize
        compact = pa.Array.from_buffers(pa.large_binary(), len(self.ids), [None, pa.py_buffer(offsets), pa.py_buffer(entries)])
        dense = sorted(self.dense.items())
        at = pa.array(np.append(self.ids, [g for g, _ in dense]).astype("int64"))
        bits = np.append(np.full(len(self.ids), BITS), [s.bits for _, s in dense]).astype("int8")
        return pa.table([*(k.take(at) for k in keys), pa.array(bits), pa.concat_arrays([compact, pa.array([s.to_bytes() for _, s in dense], pa.large_binary())])], schema=ROWS)

    def percentiles(self, keys: list[pa.Array], q: tuple[float, ...]) -> pa.Table:
        """Rows of RESULT_DDL of the groups that hold values; of exact groups all ranks are searched at once."""
        upto = np.cumsum(self.counts)
        before = upto[self.begins] - self.counts[self.begins] if len(self.begins) else upto[:0]
        totals = np.diff(np.append(before, upto[-1] if len(upto) else 0))
        found = np.zeros((len(self.ids), len(q)))
        for k, x in enumerate(q):
            rank = np.maximum(np.ceil(x * totals), 1) + before
            if len(self.ids):
                found[:, k] = decode(self.codes[np.minimum(np.searchsorted(upto, rank, side="left"), len(self.codes) - 1)])
        dense = [(g, s) for g, s in sorted(self.dense.items()) if s.n > 0]
        found = np.concatenate([found, *(s.quantiles(q)[None, :] for _, s in dense)])
        at = pa.array(np.append(self.ids, [g for g, _ in dense]).astype("int64"))
        n = np.append(totals, [s.n for _, s in dense]).astype("int64")
        some = np.flatnonzero(n > 0)
        out = pa.table({**{c: k.take(at) for c, k in zip(KEYS, keys)}, "n_values": pa.array(n), "p": pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * len(q), pa.int32()), pa.array(found.ravel()))})
        return out.take(pa.array(some))


def _numbered(columns: list[pa.Array]) -> tuple[np.ndarray, list[pa.Array]]:
    """A number for each row's key, and the keys by number."""
    joint = np.zeros(len(columns[0]), "int64")
    for column in columns:
        codes, values = codes_of(column)
        joint = joint * max(1, len(values)) + codes
    _, first, group = np.unique(joint, return_index=True, return_inverse=True)
    return group.reshape(-1), [c.take(pa.array(first)) for c in columns]


def _batches(table: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from table.cast(pa.schema([f.with_type(pa.binary()) if f.type == pa.large_binary() else f for f in table.schema])).combine_chunks().to_batches(max_chunksize=5_000)


def _flushed(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow from (scope, group_key, field_name, v, n) to sketches; n is negative for deletions."""
    for table in _flushed(batches, FLUSH_VALUES):
        v = table.column("v").to_numpy(zero_copy_only=False)
        table = table.filter(pa.array(np.isfinite(v)))
        group, keys = _numbered([table.column(k).combine_chunks() for k in KEYS])
        yield from _batches(Groups(group, encode(v[np.isfinite(v)]), table.column("n").to_numpy()).table(keys))


def _asked(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows; what is asked of a slot that goes on is repeated at the next one's begin."""
    asks = None
    for table in _flushed(batches, rows):
        if asks is not None and asks.num_rows:
            table = pa.concat_tables([asks, table]).combine_chunks()
        yield table
        series, slot = (table.column(c) for c in ("index_name", "slot"))
        last = pc.and_(pc.equal(series, series[-1]), pc.equal(slot, slot[-1]))
        asks = table.filter(pc.and_(last, table.column("ask").is_valid()))


def _pairs(asked: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of equal keys in ``keys`` and ``asked``, about FLUSH_VALUES pairs at once."""
    order = np.argsort(asked, kind="stable")
    low = np.searchsorted(asked[order], keys, side="left")
    many = np.searchsorted(asked[order], keys, side="right") - low
    some = np.flatnonzero(many)
    upto = np.cumsum(many[some])
    begin = 0
    while begin < len(some):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + FLUSH_VALUES, side="right")))
        part = some[begin:end]
        n = many[part]
        yield np.repeat(part, n), order[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[part], n)]
        begin = end


def _starts(us: np.ndarray, every: np.ndarray) -> np.ndarray:
    """First instants of the buckets that hold ``us``; ``every`` is a width in us, or a number of months, negative."""
    month = us.astype("datetime64[us]").astype("datetime64[M]").astype("int64")
    months = np.maximum(-every, 1)
    by_month = (MONTH0 + np.where(every < 0, month // months * months, 0)).astype("datetime64[us]").astype("int64")
    return np.where(every < 0, by_month, us // np.maximum(every, 1) * every)


def _sketch_readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow from posts (index_name, slot, us, value) and what is asked of them (index_name, slot, ask) to sketches of series, kinds and buckets.

    The rows come sorted by series and slot, what is asked first. Buckets of ranges have the scope ``ranged`` and a key of
    their width, start and series, whichever requests ask for them.
    """
    for table in _asked(batches, FLUSH_VALUES // 4):
        series, names = codes_of(table.column("index_name").combine_chunks())
        series = series.astype("int64")
        value, ask = (c if isinstance(c, pa.Array) else c.chunk(0) for c in (table.column(k).combine_chunks() for k in ("value", "ask")))
        rows, key, v = map_parts(value)
        keep = np.isfinite(v)
        rows, field, v = rows[keep], np.asarray(key.indices, "int64")[keep], v[keep]
        fields = key.dictionary.to_pylist()
        code = encode(v)

        def sketch(scope: str, owner: np.ndarray, labels: list[str], at: np.ndarray, fields=fields, field=field, code=code) -> Iterator[pa.RecordBatch]:
            """Sketches of the readings ``at``, by their owner (whose names are the labels) and field."""
            if len(at):
                joint, group = np.unique(owner * len(fields) + field[at], return_inverse=True)
                keys = [pa.array([scope] * len(joint), pa.string()), pa.array(labels, pa.string()).take(pa.array(joint // len(fields))), pa.array(fields, pa.string()).take(pa.array(joint % len(fields)))]
                yield from _batches(Groups(group.reshape(-1), code[at], np.ones(len(at), "int64")).table(keys))

        every_reading = np.arange(len(rows))
        yield from sketch("series", series[rows], names, every_reading)
        kinds, kind = np.unique([n.split(".", 1)[0] for n in names], return_inverse=True)
        yield from sketch("kind", kind.reshape(-1)[series[rows]].astype("int64"), kinds.tolist(), every_reading)
        # Each reading meets what is asked of its series and slot for its field, or for all.
        asks = np.flatnonzero(np.asarray(ask.is_valid()))
        if not len(asks) or not len(rows):
            continue
        ask = ask.take(pa.array(asks))
        begin, end, every = (ask.field(c).to_numpy(zero_copy_only=False) for c in ("begin_us", "end_us", "every"))
        wanted, wanted_names = codes_of(ask.field("field_name"))
        number = {f: k for k, f in enumerate(fields)}
        wanted = np.array([-1 if f is None else number.get(f, -2) for f in wanted_names])[wanted]
        us = table.column("us").fill_null(0).to_numpy()[rows]
        slots, slot = np.unique(table.column("slot").to_numpy(), return_inverse=True)
        place = series * len(slots) + slot.reshape(-1)
        for scope, label, of, asked, keys in (
            ("ranged", "{1} {2} {0}", wanted >= 0, place[asks] * len(fields) + wanted, place[rows] * len(fields) + field),
            ("bucket", "query {0} {1} {2}", wanted == -1, place[asks], place[rows]),
        ):
            of = np.flatnonzero(of)
            for reading, a in _pairs(asked[of], keys):
                a = of[a]
                meets = (us[reading] >= begin[a]) & (us[reading] < end[a])
                reading, a = reading[meets], a[meets]
                widths, width = np.unique(every[a], return_inverse=True)
                starts, bucket = np.unique(_starts(us[reading], every[a]), return_inverse=True)
                owners, owner = np.unique((series[rows[reading]] * len(widths) + width.reshape(-1)) * len(starts) + bucket.reshape(-1), return_inverse=True)
                labels = [label.format(names[o // len(starts) // len(widths)], widths[o // len(starts) % len(widths)], starts[o % len(starts)]) for o in owners.tolist()]
                yield from sketch(scope, owner.reshape(-1), labels, reading)


def _read(table: pa.Table) -> tuple[Groups, list[pa.Array]]:
    """Sketches of rows, those of equal keys merged."""
    group, keys = _numbered([table.column(k).combine_chunks() for k in KEYS])
    bits = table.column("bits").to_numpy()
    blobs = table.column("sketch").combine_chunks()
    blobs = blobs if isinstance(blobs, pa.Array) else blobs.chunk(0)
    exact = bits == BITS
    dense: dict[int, DyadicSketch] = {}
    for r in np.flatnonzero(~exact):
        s = DyadicSketch.from_bytes(blobs[int(r)].as_py(), int(bits[r]))
        g = int(group[r])
        dense[g] = dense[g].merge(s) if g in dense else s
    small = blobs.filter(pa.array(exact))
    sizes = np.asarray(pc.binary_length(small)).astype("int64") // ENTRY.itemsize
    offsets = np.frombuffer(small.buffers()[1], "<i4" if small.type == pa.binary() else "<i8")[small.offset : small.offset + len(small) + 1] if len(small) else np.zeros(1, int)
    entries = np.frombuffer(small.buffers()[2], "u1")[offsets[0] : offsets[-1]].view(ENTRY) if len(small) and sizes.sum() else np.empty(0, ENTRY)
    return Groups(np.repeat(group[exact], sizes), entries["prefix"].astype("int64"), entries["count"].astype("int64"), dense), keys


def _merge(q: tuple[float, ...] | None):
    """mapInArrow over sketches sorted by ``h``, the hash of their key (and salt): one sketch of each, or its percentiles.

    What is held is bounded by bytes; of a key that goes on, the sum so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            table = pa.concat_tables(held).combine_chunks()
            h = table.column("h").to_numpy()
            cut = len(h) if last else int(np.searchsorted(h, h[-1]))
            done, rest = table.slice(0, cut), table.slice(cut)
            if cut:
                groups, keys = _read(done)
                yield from _batches(groups.table(keys) if q is None else groups.percentiles(keys, q))
            held, size = [], 0
            if rest.num_rows:
                groups, keys = _read(rest)
                merged = groups.table(keys).cast(pa.schema([f.with_type(pa.binary()) if f.name == "sketch" else f for f in ROWS]))
                merged = merged.append_column("h", pa.array(np.full(merged.num_rows, h[-1])))
                # Under the input's own schema, where ``h`` can't be null; else it can't be joined to what follows.
                held = [pa.Table.from_arrays([merged.column(c) for c in table.column_names], schema=table.schema)]

        for batch in batches:
            # Few rows may hold much.
            step = max(1, int(batch.num_rows * FLUSH_BYTES / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = pa.Table.from_batches([batch.slice(at, step)])
                held.append(part)
                size += part.nbytes
                if size >= FLUSH_BYTES:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return run


def _merged(sketches: DataFrame, q: tuple[float, ...]) -> DataFrame:
    """Percentiles from sketches: those with counters first meet by key and salt, then all by key."""
    by = lambda df, *salt: df.withColumn("h", F.xxhash64(*KEYS, *salt)).repartition("h").sortWithinPartitions("h").select("h", *ROWS.names)
    # Exact sketches are small and few of each group; they go straight to the key's first salt.
    salt = F.when(F.col("bits") < BITS, F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(F.lit(0))
    once = by(sketches, salt).mapInArrow(_merge(None), ROWS_DDL)
    return by(once).mapInArrow(_merge(q), RESULT_DDL)


def percentiles(values: DataFrame, q: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """Percentiles of each group: scope, group_key, field_name, n_values, p (in the order of q).

    values: scope, group_key, field_name, v, n (1, or -1 to delete a value counted elsewhere).
    """
    return _merged(values.select(*KEYS, "v", "n").mapInArrow(_partial, ROWS_DDL), q)


def reading_percentiles(posts: DataFrame, requests: DataFrame, queries: DataFrame, rollups: DataFrame, q: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """Percentiles of standing readings per series and field, per kind and field, per bucket of the requests, and of rollup sums.

    Scopes and group keys: ``series`` (index_name), ``kind``, ``bucket`` (request and bucket start in us), ``rollup``
    (index_name and level). Requests are those of ``requests`` in their range, and of ``queries`` every series and group
    that has posts, over all time, each field; a null or empty group is a year, an unknown one has no buckets.
    """
    at = lambda x, width: ((x - F.pmod(x, F.lit(width))) / width).cast("long")
    rows = posts.where(F.col("index_name").isNotNull() & F.col("ts").isNotNull()).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    every = F.coalesce("step_us", F.col("months").cast("long") * -1).alias("every")
    ranged = requests_plan(one_per_id(requests)).where(F.col("index_name").isNotNull() & F.col("field_name").isNotNull())
    ranged = ranged.select(F.concat(F.lit("grid "), "grid_id").alias("name"), "index_name", "field_name", every, "begin_us", "end_us")
    ranged = ranged.withColumn("day", F.explode(F.sequence(at(F.col("begin_us"), DAY_US), at(F.col("end_us") - 1, DAY_US))))
    # What several requests ask for is asked once: ranges of a day that aren't asked for in between are dropped at the end.
    asks = ranged.groupBy("index_name", "field_name", "every", "day").agg(F.min("begin_us").alias("begin_us"), F.max("end_us").alias("end_us"))
    spec = F.coalesce(F.nullif(F.lower(F.trim("group_text")), F.lit("")), F.lit("year"))
    always = queries.where(F.col("index_name").isNotNull()).select("index_name", spec.alias("group_spec")).distinct()
    always = requests_plan(always.withColumns({"grid_id": F.lit(0).cast("long"), "field_name": F.lit(""), "from_time": F.lit("1970-01-01").cast("timestamp"), "to_time": F.lit("1970-01-02").cast("timestamp")}))
    days = rows.select("index_name", at(F.col("us"), DAY_US).alias("day")).distinct()
    always = always.select("index_name", every).distinct().join(days, "index_name").withColumn("field_name", F.lit(None).cast("string"))
    asks = asks.unionByName(always.withColumns({"begin_us": F.col("day") * DAY_US, "end_us": (F.col("day") + 1) * DAY_US}))
    first, last = F.greatest("begin_us", F.col("day") * DAY_US), F.least("end_us", (F.col("day") + 1) * DAY_US) - 1
    asks = asks.select("index_name", F.explode(F.sequence(at(first, SLOT_US), at(last, SLOT_US))).alias("slot"), F.struct("field_name", "every", "begin_us", "end_us").alias("ask"))
    # Asks go the way of the posts, once for a slot: no list of them is sent to all tasks or repeated with each post.
    rows = rows.select("index_name", at(F.col("us"), SLOT_US).alias("slot"), "us", "post_id", "value").unionByName(asks, allowMissingColumns=True).repartition("index_name", "slot")
    later = F.lead(F.lit(True)).over(Window.partitionBy("index_name", "slot", "us").orderBy("post_id"))
    rows = rows.withColumn("later", later).where(F.col("ask").isNotNull() | F.col("later").isNull())
    sketches = rows.select("index_name", "slot", "us", "value", "ask").mapInArrow(_sketch_readings, ROWS_DDL)
    last = rollups.where(F.col("bucket_start").isNotNull() & F.col("level_name").isNotNull())
    last = standing(last, ("index_name", "level_name", "bucket_start", "field_name"), "rollup_id", ("sum_v",))
    sums = last.select(F.lit("rollup").alias("scope"), F.concat_ws(" ", "index_name", "level_name").alias("group_key"), "field_name", F.col("sum_v").alias("v"), F.lit(1).cast("long").alias("n"))
    found = _merged(sketches.unionByName(sums.mapInArrow(_partial, ROWS_DDL)), q)
    return _requested(found, ranged, at)


def _requested(found: DataFrame, ranged: DataFrame, at) -> DataFrame:
    """The groups, of the scope ``ranged`` once for each request that asks for the bucket, and named by it."""
    is_ranged, parts = F.col("scope") == "ranged", F.split("group_key", " ", 3)
    # Other groups have the width 0, which no request has.
    found = found.withColumns({"at_series": F.when(is_ranged, parts[2]).otherwise(F.col("group_key")), "at_every": F.when(is_ranged, parts[0].cast("long")).otherwise(F.lit(0)), "start": F.when(is_ranged, parts[1].cast("long")).otherwise(F.lit(0))})
    names = ranged.withColumnRenamed("field_name", "at_field")
    same = (F.col("at_series") == F.col("index_name")) & (F.col("field_name") == F.col("at_field")) & (F.col("at_every") == F.col("every")) & (at(F.col("start"), DAY_US) == F.col("day"))
    named = found.join(names, same & (F.col("start") >= F.col("begin_us")) & (F.col("start") < F.col("end_us")), "left").where(~is_ranged | F.col("name").isNotNull())
    key = F.when(is_ranged, F.concat_ws(" ", "name", F.col("start").cast("string"))).otherwise(F.col("group_key"))
    return named.select(F.when(is_ranged, F.lit("bucket")).otherwise(F.col("scope")).alias("scope"), key.alias("group_key"), "field_name", "n_values", "p")
