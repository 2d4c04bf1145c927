"""Chunks of sorted rows never cut a group."""

import numpy as np
import pyarrow as pa
import pytest

from chronoloom.operators.readings import chunks, map_parts


@pytest.mark.parametrize("rows", [1, 3, 10, 1000])
@pytest.mark.parametrize("batch", [1, 4, 50])
def test_chunks_keep_groups_whole(rows, batch):
    rng = np.random.default_rng(rows * 100 + batch)
    names = [None] * 3 + sorted(rng.choice(list("abcdefg"), 60).tolist())
    tiles = list(range(3)) + [0] * 60
    table = pa.table({"k": pa.array(names, pa.string()), "t": tiles, "x": np.arange(63)})
    got = list(chunks(iter(table.to_batches(max_chunksize=batch)), ("k", "t"), rows))
    assert pa.concat_tables(got).column("x").to_pylist() == list(range(63))
    seen = [set(zip(g.column("k").to_pylist(), g.column("t").to_pylist())) for g in got]
    assert sum(map(len, seen)) == len(set().union(*seen))


def test_chunks_of_nothing():
    assert list(chunks(iter([]), ("k",), 5)) == []


def test_map_parts_with_nulls_and_slices():
    column = pa.array([[("a", 1.0)], None, [], [("b", None), ("a", float("nan"))], [("c", 2.0)]], pa.map_(pa.string(), pa.float64()))
    rows, keys, values = map_parts(column)
    assert rows.tolist() == [0, 3, 3, 4]
    assert keys.to_pylist() == ["a", "b", "a", "c"]
    assert np.isnan(values[1]) and np.isnan(values[2]) and values[3] == 2.0
    rows, keys, values = map_parts(column.slice(3))
    assert rows.tolist() == [0, 0, 1] and keys.to_pylist() == ["b", "a", "c"]
