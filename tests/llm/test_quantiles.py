"""Sketches against exact ranks, merging and deleting."""

import numpy as np
import pytest

from chronoloom.llm import quantiles as Q
from chronoloom.llm import queries
from tests.conftest import DATA
from tests.oracle import assert_same


def rank_error(values, got, q):
    s = np.sort(values)
    low, high = (np.searchsorted(s, got, side) / len(s) for side in ("left", "right"))
    return max(low - q, q - high, 0)


def samples():
    rng = np.random.default_rng(7)
    return {
        "normal": rng.normal(240, 3, 60_000), "tails": rng.standard_cauchy(60_000) * 1e3, "mixed": np.concatenate([rng.normal(-5, 1, 30_000), np.full(20_000, 7.25), rng.lognormal(3, 2, 30_000)]),
        "few": rng.integers(0, 5, 50_000).astype(float), "tiny": rng.normal(0, 1e-12, 40_000), "grid": np.round(rng.normal(50_000, 4_000, 80_000), 2),
    }


@pytest.mark.parametrize("name", list(samples()))
def test_rank_error_is_bounded(name):
    v = samples()[name]
    codes, counts = np.unique(Q.encode(v), return_counts=True)
    sketch = Q.DyadicSketch().add(codes, counts)
    assert sketch.n == len(v)
    for q, got in zip(Q.PERCENTILES, sketch.quantiles(Q.PERCENTILES)):
        assert rank_error(Q.decode(Q.encode(v)), got, q) <= Q.RANK_ERROR


def test_codes_keep_order_and_precision():
    v = np.array([-np.finfo(float).max, -1e300, -2.5, -1e-300, 0.0, 1e-300, 1.0, 1.0000021, 1e300, np.finfo(float).max])
    codes = Q.encode(v)
    assert (np.diff(codes) > 0).all()
    assert np.allclose(Q.decode(codes), v, rtol=1e-6, atol=0)
    assert Q.encode(np.array([-0.0]))[0] == Q.encode(np.array([0.0]))[0] and Q.decode(Q.encode(np.array([0.0])))[0] == 0


def same(a, b):
    return a.bits == b.bits and (a.prefix == b.prefix).all() and (a.count == b.count).all() and (a.table == b.table).all()


@pytest.mark.parametrize("name", list(samples()))
def test_merge_is_addition_and_deletion_undoes(name):
    v = samples()[name]
    part = lambda x: Q.DyadicSketch().add(*np.unique(Q.encode(x), return_counts=True))
    whole, merged = part(v), part(v[:30_000]).merge(part(v[30_000:]))
    assert same(whole, merged) and same(whole, part(v[30_000:]).merge(part(v[:30_000])))
    codes, counts = np.unique(Q.encode(v[30_000:]), return_counts=True)
    left, want = merged.add(codes, -counts), part(v[:30_000])
    want._coarsen(left.bits)
    assert same(left, want)
    again = Q.DyadicSketch.from_bytes(whole.to_bytes(), whole.bits)
    assert same(again, whole)


def test_resolutions_turn_from_exact_to_sketched_one_by_one():
    rng = np.random.default_rng(1)
    codes = Q.encode(rng.normal(100, 30, 200_000))
    s, seen = Q.DyadicSketch(), []
    for k in range(0, len(codes), 2_000):
        s.add(codes[k : k + 2_000], np.ones(2_000, "int64"))
        seen.append(s.bits)
        assert len(s.prefix) <= Q.DEPTH * Q.WIDTH or s.bits == Q.LEAST_BITS
        # Exact resolutions hold what is there.
        want, count = np.unique(codes[: k + 2_000] >> (Q.BITS - s.bits), return_counts=True)
        assert (s.prefix == want).all() and (s.count == count).all()
    assert seen == sorted(seen, reverse=True) and len(set(seen)) > 3 and seen[0] == Q.BITS


def test_hot_group_of_very_many_sketches(spark):
    """One group spread over 2,000 partial sketches, among small ones."""
    rng = np.random.default_rng(5)
    n = 200_000
    hot = rng.lognormal(3, 1, n)
    df = spark.createDataFrame([("s", "hot" if k % 100 else f"g{k % 700}", "f", float(x), 1) for k, x in enumerate(hot)], "scope string, group_key string, field_name string, v double, n long").repartition(8)

    def many(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                for b in Q._partial(iter([batch.slice(at, 100)])):
                    yield pa.RecordBatch.from_pydict({**{c: b.column(c) for c in b.schema.names}}, schema=b.schema)

    partial = df.mapInArrow(many, Q.ROWS_DDL)
    assert partial.where("group_key = 'hot'").count() >= 2_000
    got = {r.group_key: r for r in Q._merged(partial, (0.05, 0.5, 0.95)).collect()}
    assert sum(r.n_values for r in got.values()) == n
    values = np.array([x for k, x in enumerate(hot) if k % 100])
    assert got["hot"].n_values == len(values) and max(rank_error(values, x, q) for x, q in zip(got["hot"].p, (0.05, 0.5, 0.95))) <= Q.RANK_ERROR
    # Sketches with counters from the start, merged in small steps.
    dense = spark.createDataFrame([("s", "d", "f", bytearray(s.to_bytes()), s.bits) for s in (Q.DyadicSketch().add(*np.unique(Q.encode(rng.normal(50, 9, 9_000)), return_counts=True)) for _ in range(60))], "scope string, group_key string, field_name string, sketch binary, bits int").selectExpr("scope", "group_key", "field_name", "cast(bits as byte) bits", "sketch").repartition(6)
    was, Q.FLUSH_BYTES = Q.FLUSH_BYTES, 1 << 20
    try:
        row = Q._merged(dense, (0.5,)).first()
    finally:
        Q.FLUSH_BYTES = was
    assert row.n_values == 540_000 and abs(row.p[0] - 50) < 0.2


def test_every_group_of_a_table_against_exact_ranks(spark):
    """All groups of the registered query: counts are exact, percentiles within the bound, groups with a few values exact."""
    d = f"{DATA}/sf0.01"
    rows = queries.p3_percentiles(spark, d).collect()
    posts = spark.read.parquet(f"{d}/posts.parquet").where("index_name IS NOT NULL AND ts IS NOT NULL").toPandas().sort_values("post_id").drop_duplicates(["index_name", "ts"], keep="last")
    want: dict = {}
    grid = spark.read.parquet(f"{d}/grid_requests.parquet").toPandas().drop_duplicates("grid_id")
    unit = {"second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}
    asked: dict = {}
    for r in grid.itertuples():
        digits = "".join(c for c in r.group_spec if c.isdigit())
        step = int(digits or 1) * unit[r.group_spec[len(digits) :].rstrip("s")]
        a, b = (int(t.value // 1000) for t in (r.from_time, r.to_time))
        asked.setdefault((r.index_name, r.field_name), []).append((r.grid_id, step, a // step * step, -(-b // step) * step))
    for index, ts, value in zip(posts.index_name, posts.ts, posts.value):
        us = ts.value // 1000
        for f, x in (value or {}).items():
            if x is None or not np.isfinite(x):
                continue
            want.setdefault(("series", index, f), []).append(x)
            want.setdefault(("kind", index.split(".")[0], f), []).append(x)
            for g, step, a, b in asked.get((index, f), ()):
                if a <= us < b:
                    want.setdefault(("bucket", f"grid {g} {us // step * step}", f), []).append(x)
    got = {(r.scope, r.group_key, r.field_name): r for r in rows if r.scope != "rollup" and not r.group_key.startswith("query")}
    assert set(got) == set(want) and {k[0] for k in got} == {"series", "kind", "bucket"}
    worst = 0
    for k, v in want.items():
        r, v = got[k], Q.decode(Q.encode(np.array(v)))
        assert r.n_values == len(v)
        errors = [rank_error(v, x, q) for q, x in zip(Q.PERCENTILES, [r[f"p{round(100 * q):02d}"] for q in Q.PERCENTILES])]
        worst = max(worst, *errors) if len(v) > 100 else worst
        assert len(v) > 100 or max(errors) < 1 / len(v) + 1e-9
    assert worst <= Q.RANK_ERROR + 0.01  # ranks are whole numbers: of a hundred values one is a percent


def test_groups_of_queries(spark):
    """The buckets of raw_queries' groups, of months too; a null or empty group is a year."""
    ts = ["2020-01-31 10:00:00", "2020-02-01 00:00:00", "2021-03-01 00:00:00"]
    posts = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({k}, 'k.a', timestamp_ntz'{t}', map('f', double({k})))" for k, t in enumerate(ts)) + " AS t(post_id, index_name, ts, value)")
    requests = spark.createDataFrame([], "grid_id long, index_name string, from_time timestamp_ntz, to_time timestamp_ntz, group_spec string, field_name string")
    rollups = spark.createDataFrame([], "rollup_id long, index_name string, level_name string, bucket_start timestamp_ntz, field_name string, sum_v double")
    queries_ = spark.createDataFrame([("k.a", None), ("k.a", " "), ("k.a", "Months"), ("k.a", "2hours"), ("k.a", "5weeks"), ("k.b", "day")], "index_name string, group_text string")
    got = {(r.group_key.split(" ")[-2], int(r.group_key.split(" ")[-1]) // 86_400_000_000): r.n_values for r in Q.reading_percentiles(posts, requests, queries_, rollups).where("scope = 'bucket'").collect()}
    day = lambda t: (np.datetime64(t) - np.datetime64("1970-01-01")).astype(int)
    assert got == {("-12", day("2020-01-01")): 2, ("-12", day("2021-01-01")): 1, ("-1", day("2020-01-01")): 1, ("-1", day("2020-02-01")): 1, ("-1", day("2021-03-01")): 1, ("7200000000", day("2020-01-31")): 1, ("7200000000", day("2020-02-01")): 1, ("7200000000", day("2021-03-01")): 1}


def test_groups(spark):
    rng = np.random.default_rng(3)
    hot = rng.normal(100, 10, 30_000)
    rows = [("series", "k.a.hot", "f", float(x), 1) for x in hot] + [("series", "k.b.cold", "f", float(x), 1) for x in (3, 1, 2, 2, 9)]
    rows += [("series", "k.b.cold", "f", 9.0, -1), ("series", "k.b.cold", "f", None, 1), ("series", "k.b.cold", "f", float("nan"), 1), ("series", "k.b.cold", "f", float("inf"), 1), ("other", None, "f", 5.0, 1)]
    df = spark.createDataFrame(rows, "scope string, group_key string, field_name string, v double, n long").repartition(6)
    got = {(r.scope, r.group_key): r for r in Q.percentiles(df, (0.25, 0.5, 1.0)).collect()}
    assert set(got) == {("series", "k.a.hot"), ("series", "k.b.cold"), ("other", None)}
    cold = got["series", "k.b.cold"]
    assert cold.n_values == 4 and np.allclose(cold.p, [1, 2, 3], rtol=1e-6)
    assert got["series", "k.a.hot"].n_values == 30_000 and rank_error(hot, got["series", "k.a.hot"].p[1], 0.5) <= Q.RANK_ERROR
    assert Q.percentiles(df.limit(0)).count() == 0


def test_tables_with_nulls_and_repeats(spark):
    posts = spark.createDataFrame([(1, "k.a", None, {"f": 1.0}), (2, None, None, None)], "post_id long, index_name string, ts timestamp_ntz, value map<string,double>")
    requests = spark.createDataFrame([], "grid_id long, index_name string, from_time timestamp_ntz, to_time timestamp_ntz, group_spec string, field_name string")
    queries = spark.createDataFrame([("k.a", "nonsense"), (None, None)], "index_name string, group_text string")
    rollups = spark.createDataFrame([], "rollup_id long, index_name string, level_name string, bucket_start timestamp_ntz, field_name string, sum_v double")
    assert Q.reading_percentiles(posts, requests, queries, rollups).count() == 0


def test_counts_are_those_of_sql(spark):
    assert_same(spark, f"{DATA}/sf0.001", queries.p3_counts, queries.ORACLE_SQL["p3_counts"])


def test_many_requests_of_a_series_are_sketched_once(spark, monkeypatch):
    """Sketches don't grow with the requests that ask for a bucket, and each request has its own buckets only."""
    hour, day0 = 3_600_000_000, 1_738_540_800_000_000  # 2025-02-03
    posts = spark.range(2_000).selectExpr("id AS post_id", "'k.a' AS index_name", f"CAST(timestamp_micros({day0} + id * 43000000) AS timestamp_ntz) AS ts", "map('f', double(id), 'g', double(-id)) AS value").repartition(4)
    requests = spark.range(300).selectExpr("id AS grid_id", "'k.a' AS index_name", f"CAST(timestamp_micros({day0} + id % 20 * {hour}) AS timestamp_ntz) AS from_time", f"CAST(timestamp_micros({day0} + (id % 20 + 1 + 40 * int(id % 3 = 0)) * {hour}) AS timestamp_ntz) AS to_time", "if(id % 2 = 0, 'hour', '60minutes') AS group_spec", "if(id = 299, 'g', 'f') AS field_name")
    queries_ = spark.createDataFrame([("k.a", "day"), ("k.b", "day")], "index_name string, group_text string")
    rollups = spark.createDataFrame([], "rollup_id long, index_name string, level_name string, bucket_start timestamp_ntz, field_name string, sum_v double")
    seen, merged = [], Q._merged
    monkeypatch.setattr(Q, "_merged", lambda sketches, q: seen.append(sketches) or merged(sketches, q))
    got = {(r.group_key, r.field_name): (r.n_values, r.p[0]) for r in Q.reading_percentiles(posts, requests, queries_, rollups, (0.5,)).where("scope = 'bucket'").collect()}
    want: dict = {}
    for k in range(2_000):
        at = k * 43_000_000
        for g in range(300):
            if g % 20 * hour <= at < (g % 20 + 1 + 40 * (g % 3 == 0)) * hour:
                want.setdefault((f"grid {g} {day0 + at // hour * hour}", "g" if g == 299 else "f"), []).append(-k if g == 299 else k)
        for f, x in (("f", k), ("g", -k)):
            want.setdefault((f"query k.a {24 * hour} {day0 + at // (24 * hour) * 24 * hour}", f), []).append(x)
    assert {k: n for k, (n, _) in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(np.isclose(got[k][1], sorted(v)[(len(v) - 1) // 2], rtol=1e-6) for k, v in want.items())
    assert len(want) > 1_500 and seen[0].count() < 400


def test_what_is_asked_of_a_slot_holds_over_tables(monkeypatch):
    """A slot that is read in many tables, and pairs cut into many steps, give the same counts; a series without requests has no buckets."""
    import pyarrow as pa

    ask = pa.struct([("field_name", pa.string()), ("every", pa.int64()), ("begin_us", pa.int64()), ("end_us", pa.int64())])
    schema = pa.schema([("index_name", pa.string()), ("slot", pa.int64()), ("us", pa.int64()), ("value", pa.map_(pa.string(), pa.float64())), ("ask", ask)])
    rows = [("a", s, None, None, {"field_name": f, "every": w, "begin_us": s * Q.SLOT_US, "end_us": (s + 1) * Q.SLOT_US - 50}) for s in (0, 1) for f, w in (("f", 10), ("f", 7), ("x", 10), (None, -1))]
    rows += [("a", s, s * Q.SLOT_US + k, [("f", 1.0), ("g", 2.0)], None) for s in (0, 1) for k in (*range(100), Q.SLOT_US - 10)] + [("b", 0, k, [("f", 3.0)], None) for k in range(50)]
    rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0))
    table = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    def counts(flush):
        monkeypatch.setattr(Q, "FLUSH_VALUES", flush)
        out: dict = {}
        for b in Q._sketch_readings(iter(table.to_batches(max_chunksize=9))):
            for r in b.to_pylist():
                k = r["scope"], r["group_key"], r["field_name"]
                out[k] = out.get(k, 0) + int(np.frombuffer(r["sketch"], Q.ENTRY)["count"].sum())
        return out

    whole = counts(1_000_000)
    assert counts(40) == whole == counts(4)
    assert whole["ranged", "10 0 a", "f"] == 10 and sum(n for (s, k, _), n in whole.items() if s == "ranged" and k.startswith("7 ")) == 200
    assert {(k, f): n for (s, k, f), n in whole.items() if s == "bucket"} == {("query a -1 0", "f"): 200, ("query a -1 0", "g"): 200}
    assert whole["series", "b", "f"] == 50 and whole["kind", "a", "g"] == 202


def test_merging_goes_on_after_a_flush(monkeypatch):
    """More bytes in a task than are merged at once, under the schema that Spark gives, where ``h`` can't be null."""
    import pyarrow as pa

    schema = pa.schema([pa.field("h", pa.int64(), nullable=False), ("scope", pa.string()), ("group_key", pa.string()), ("field_name", pa.string()), ("bits", pa.int8()), ("sketch", pa.binary())])
    rng = np.random.default_rng(2)
    hot = rng.normal(50, 9, (12, 9_000))
    small = Q.DyadicSketch().add(Q.encode(np.arange(5.0)), np.ones(5, "int64"))
    rows = [(h, "s", f"g{h}", "f", small.bits, small.to_bytes()) for h in range(5) for _ in range(40)]
    rows += [(7, "s", "hot", "f", x.bits, x.to_bytes()) for x in (Q.DyadicSketch().add(*np.unique(Q.encode(v), return_counts=True)) for v in hot)]
    rows += [(9, "s", "g9", "f", small.bits, small.to_bytes())]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[k : k + 7]), schema)], schema=schema) for k in range(0, len(rows), 7)]

    def run(at_once):
        monkeypatch.setattr(Q, "FLUSH_BYTES", at_once)
        return {r["group_key"]: (r["n_values"], r["p"]) for b in Q._merge((0.2, 0.5, 0.9))(iter(batches)) for r in b.to_pylist()}

    got = run(1_000)
    assert got == run(100_000) == run(1 << 30)
    assert {k: n for k, (n, _) in got.items()} == {**{f"g{h}": 200 for h in range(5)}, "hot": hot.size, "g9": 5}
    assert max(rank_error(hot.ravel(), x, q) for x, q in zip(got["hot"][1], (0.2, 0.5, 0.9))) <= Q.RANK_ERROR
