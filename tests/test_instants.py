"""Time texts against the standard library's own reading of zones."""

import datetime as dt
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.operators import instants as I

UTC = dt.timezone.utc


def one(text, zone="UTC", order="dmy"):
    status, ns, canonical = I.parse_times([text], [zone], [order])
    return I.STATUSES[status[0]], int(ns[0]), bool(canonical[0])


@pytest.mark.parametrize(
    "text, zone, order, want",
    [
        ("2024-08-19T13:33:05Z", None, None, "2024-08-19T13:33:05"),
        (" 2024-08-19T13:33:05Z\n", None, None, "2024-08-19T13:33:05"),
        ("2024-08-19t13:33:05z", None, None, "2024-08-19T13:33:05"),
        ("2024-08-19T13:33Z", None, None, "2024-08-19T13:33:00"),
        ("2024-07-31", "Europe/Berlin", None, "2024-07-30T22:00:00"),
        ("20240820T031642Z", None, None, "2024-08-20T03:16:42"),
        ("20240823 172137", "Europe/London", None, "2024-08-23T16:21:37"),
        ("1724216332", None, None, "2024-08-21T04:58:52"),
        ("1724210196569", None, None, "2024-08-21T03:16:36.569000"),
        ("1724418545.812", None, None, "2024-08-23T13:09:05.812000"),
        ("Sun, 25 Aug 2024 01:53:37 GMT", "Asia/Tokyo", None, "2024-08-25T01:53:37"),
        ("Thu, 29 Aug 2024 06:43:25 +0530", None, None, "2024-08-29T01:13:25"),
        ("21.08.2024 05:21:24", "Europe/Berlin", "mdy", "2024-08-21T03:21:24"),
        ("09/03/2024 02:27", "America/New_York", "mdy", "2024-09-03T06:27:00"),
        ("09/03/2024 02:27", "Europe/London", "dmy", "2024-03-09T02:27:00"),
        ("2024/10/09 22:47:42", "Asia/Tokyo", "ymd", "2024-10-09T13:47:42"),
        ("03/Sep/2024:16:04:56 +0200", None, None, "2024-09-03T14:04:56"),
        ("Aug 20, 2024 12:07:16 AM", "UTC", None, "2024-08-20T00:07:16"),
        ("Aug 20, 2024 12:07:16 PM", "UTC", None, "2024-08-20T12:07:16"),
        ("2024-08-22 23:45:56,732", "UTC", None, "2024-08-22T23:45:56.732000"),
        ("2024-10-15T07:32:20[Europe/London]", "UTC", None, "2024-10-15T06:32:20"),
        ("2024-09-13 18:30:10 America/New_York", "UTC", None, "2024-09-13T22:30:10"),
        ("2024-10-27 02:33:18 CET", "Europe/Berlin", None, "2024-10-27T01:33:18"),
        ("2024-10-27 02:33:18 CEST", "Europe/Berlin", None, "2024-10-27T00:33:18"),
        ("2024-08-28T05:38:10-0330", None, None, "2024-08-28T09:08:10"),
        ("2024-08-28T05:38:10+02", None, None, "2024-08-28T03:38:10"),
    ],
)
def test_formats(text, zone, order, want):
    at = dt.datetime.fromisoformat(want).replace(tzinfo=UTC)
    assert one(text, zone, order)[:2] == ("ok", round(at.timestamp() * 1e6) * 1000)


def test_nanoseconds_are_kept():
    assert one("2024-10-02T03:15:54.934321136Z")[1] % 10**9 == 934321136
    assert one("1724533865572594393")[1] == 1724533865572594393


@pytest.mark.parametrize("text", [None, "", " ", "n/a", "T::Z", "2024-02-30", "2023-02-29", "2024-13-01T00:00:00Z", "2024-08-00 19:34:00", "2024-08-24 01:79:41", "2024-08-01 24:00:00", "2024-08-01T00:00:60Z", "0000-00-00 00:00:00", "31/31/2024", "Aug 20, 2024 13:00:00 PM", "2024-08-01T00:00:00+25:00", "2024-08-01 00:00:00 XYZ", "2024-08-01 00:00:00 Nowhere/Town", "9" * 40, "x" * 100_000, "2024-08-01T00:00:00", "٢024-08-01"])
def test_unreadable(text):
    assert one(text, None if text == "2024-08-01T00:00:00" else "UTC")[:2] == ("unreadable", 0)


def test_wall_clock_twice_or_never():
    assert one("2024-10-27 01:30:00", "Europe/London")[0] == "ambiguous"
    assert one("2025-03-30 01:30:00", "Europe/London")[0] == "nonexistent"
    assert one("2025-04-06T02:30", "Australia/Sydney")[0] == "ambiguous"
    assert one("2024-10-27 01:30:00+0100", "Europe/London")[0] == "ok"


def test_canonical():
    assert one("2024-08-19T13:33:05.123Z")[2] and one("2024-08-19T13:33:05Z")[2]
    assert not one(" 2024-08-19T13:33:05Z")[2] and not one("2024-02-30T13:33:05Z")[2] and not one("2024-08-19T13:33:05+00:00")[2]


@settings(max_examples=200, deadline=None)
@given(st.datetimes(dt.datetime(1971, 1, 1), dt.datetime(2036, 1, 1)), st.sampled_from(["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "America/St_Johns", "Pacific/Chatham"]))
def test_wall_clock_as_the_library_reads_it(wall, zone):
    wall = wall.replace(microsecond=0)
    found = {at.timestamp() for fold in (0, 1) if (at := wall.replace(tzinfo=ZoneInfo(zone), fold=fold).astimezone(UTC)).astimezone(ZoneInfo(zone)).replace(tzinfo=None) == wall}
    want = "ok" if len(found) == 1 else "ambiguous" if found else "nonexistent"
    status, ns, _ = one(wall.isoformat(), zone)
    assert status == want and (status != "ok" or ns == int(found.pop()) * 10**9)


def test_days_from_civil():
    days = np.arange(np.datetime64("1677-09-22"), np.datetime64("2262-04-11"), 7)
    y = days.astype("datetime64[Y]").astype(int) + 1970
    m = days.astype("datetime64[M]").astype(int) % 12 + 1
    d = (days - days.astype("datetime64[M]")).astype(int) + 1
    assert (I.days_from_civil(y, m, d) == days.astype(int)).all()


def test_tables(spark):
    posts = spark.createDataFrame([(1, "a", "2024-08-01 12:00:00", "x"), (1, "a", "2024-08-01 12:00:00", "x"), (2, None, None, "y")], "post_id long, index_name string, time_text string, zone string")
    queries = spark.createDataFrame([], "query_id long, index_name string, from_text string, to_text string")
    info = spark.createDataFrame([("a", "Asia/Tokyo", "ymd"), ("a", "Asia/Tokyo", "ymd"), (None, None, None)], "index_name string, zone string, date_order string")
    rows = I.normalise_times(posts, queries, info).collect()
    assert sorted((r.rec_id, r.time_status) for r in rows) == [(1, "ok"), (1, "ok"), (2, "unreadable")]
    empty = I.normalise_times(posts.limit(0), queries, info.limit(0))
    assert empty.count() == 0


@pytest.mark.parametrize("n", [150, 201, 5_000, 200_000])
def test_long_texts_are_read_like_short_ones(n):
    """White space around a time, and the digits of a fraction, may be of any length."""
    want = int(dt.datetime(2024, 8, 19, 13, 33, 5, tzinfo=UTC).timestamp()) * 10**9
    assert one(" " * n + "2024-08-19T13:33:05Z" + "\n" * n) == ("ok", want, False)
    assert one("2024-08-19T13:33:05." + "1234567891" * (n // 10) + "Z") == ("ok", want + 123_456_789, True)
    assert one("2024-08-19T13:33:05Z" + "x" * n)[0] == one("1" * n)[0] == one("Mon, " + " " * n + "z")[0] == one("a" * n + " 19 Aug 2024")[0] == "unreadable"
