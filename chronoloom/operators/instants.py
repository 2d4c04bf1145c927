"""Time texts of mixed formats, precisions and zones as nanoseconds since the epoch.

Every known format is an alternative of one regular expression whose named groups give the calendar components. A text
is matched once; ranges are then validated and instants assembled for whole columns at a time, with integer day
arithmetic. Zones are tables of UTC transitions, built once per Python worker and zone.

Results (``time_status``):

* ``ok`` - ``ts_ns`` is the instant;
* ``ambiguous`` / ``nonexistent`` - a wall-clock time that its zone shows twice or never, and that names no offset;
* ``unreadable`` - null, empty, no known format, a component out of range, an abbreviation that the series' zone does
  not use, or a wall-clock time of a series without a zone.

``ts_ns`` is 0 unless the status is ``ok``. Surrounding white space is ignored. Instants outside the range of 64-bit
nanoseconds (about 1677-2262) are unreadable, as nothing can hold them.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from chronoloom.operators.readings import spread

STATUSES = ("ok", "ambiguous", "nonexistent", "unreadable")
OK, AMBIGUOUS, NONEXISTENT, UNREADABLE = range(4)
PARTS = ("y", "mo", "d", "h", "mi", "s", "f", "z", "ap")
MONTHS = {m: i + 1 for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"))}

_CLOCK = r"(?P<h>[0-9]{2}):(?P<mi>[0-9]{2})(?::(?P<s>[0-9]{2})(?:[.,](?P<f>[0-9]+))?)?"
_ZONE = r"[ ]?(?P<z>[Zz]|[+-][0-9]{2}(?::?[0-9]{2})?|\[[A-Za-z0-9_+/-]+\]|[A-Za-z][A-Za-z_]*(?:/[A-Za-z0-9_+-]+)*)?"
_NAME = r"(?P<mo>[A-Za-z]{3})[a-z]*\.?"
#: Format name and pattern; the names of groups are those of PARTS and made unique by the format's number.
FORMATS = (
    ("iso", rf"(?P<y>[0-9]{{4}})-(?P<mo>[0-9]{{2}})-(?P<d>[0-9]{{2}})(?:[Tt ]{_CLOCK}{_ZONE})?"),
    ("slash_ymd", rf"(?P<y>[0-9]{{4}})/(?P<mo>[0-9]{{2}})/(?P<d>[0-9]{{2}})(?:[Tt ]{_CLOCK}{_ZONE})?"),
    ("slash", rf"(?P<d>[0-9]{{1,2}})/(?P<mo>[0-9]{{1,2}})/(?P<y>[0-9]{{4}})(?:[Tt ]{_CLOCK}{_ZONE})?"),
    ("dot", rf"(?P<d>[0-9]{{1,2}})\.(?P<mo>[0-9]{{1,2}})\.(?P<y>[0-9]{{4}})(?:[Tt ]{_CLOCK}{_ZONE})?"),
    ("log", rf"(?P<d>[0-9]{{1,2}})/{_NAME}/(?P<y>[0-9]{{4}}):{_CLOCK}{_ZONE}"),
    ("mail", rf"(?:[A-Za-z]{{3,9}},?[ ]+)?(?P<d>[0-9]{{1,2}})[ -]{_NAME}[ -](?P<y>[0-9]{{4}})(?:[ ]{_CLOCK}{_ZONE})?"),
    ("clock12", rf"{_NAME}[ ](?P<d>[0-9]{{1,2}}),[ ](?P<y>[0-9]{{4}})[ ](?P<h>[0-9]{{1,2}}):(?P<mi>[0-9]{{2}})(?::(?P<s>[0-9]{{2}})(?:[.,](?P<f>[0-9]+))?)?[ ]?(?P<ap>[AaPp])\.?[Mm]\.?{_ZONE}"),
    ("compact", rf"(?P<y>[0-9]{{4}})(?P<mo>[0-9]{{2}})(?P<d>[0-9]{{2}})[Tt ](?P<h>[0-9]{{2}})(?P<mi>[0-9]{{2}})(?:(?P<s>[0-9]{{2}})(?:[.,](?P<f>[0-9]+))?)?{_ZONE}"),
    ("epoch", r"(?P<s>-?[0-9]{1,19})(?:\.(?P<f>[0-9]+))?"),
)
CANONICAL = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?Z")
#: First and last years for which transitions are tabulated: the range of 64-bit nanoseconds.
FIRST_YEAR, LAST_YEAR = 1677, 2262
NS = 1_000_000_000


def _compile() -> tuple[re.Pattern, dict[str, tuple[int, ...]]]:
    alternatives = []
    for k, (name, pattern) in enumerate(FORMATS):
        alternatives.append(f"(?P<{name}>{re.sub(r'[(][?]P<([a-z]+)>', rf'(?P<\g<1>_{k}>', pattern)})")
    rx = re.compile("|".join(alternatives), re.ASCII)
    parts = {name: tuple(rx.groupindex.get(f"{p}_{k}", 0) for p in PARTS) for k, (name, _) in enumerate(FORMATS)}
    return rx, parts


_RX, _GROUPS = _compile()
_RANK = {name: k for k, (name, _) in enumerate(FORMATS)}


def days_from_civil(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of proleptic Gregorian dates, in integers only."""
    shifted = y - (m <= 2)
    era = np.floor_divide(shifted, 400)
    of_era = shifted - era * 400
    day_of_year = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + of_era * 365 + of_era // 4 - of_era // 100 + day_of_year - 719468


def days_in_month(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    lengths = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return lengths[np.clip(m, 0, 12)] + ((m == 2) & leap)


@lru_cache(maxsize=None)
def zone_table(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Transitions of a zone (UTC seconds), and the offsets and abbreviations of the spans between them; None if unknown."""
    try:
        zone = ZoneInfo(name)
    except Exception:
        return None
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)

    def state(at: int) -> tuple[int, str]:
        local = (epoch + dt.timedelta(seconds=at)).astimezone(zone)
        return int(local.utcoffset().total_seconds()), local.tzname()

    week = 7 * 86400
    start, end = (int((dt.datetime(y, 1, 2, tzinfo=dt.timezone.utc) - epoch).total_seconds()) for y in (FIRST_YEAR, LAST_YEAR + 1))
    # Before any zone kept summer time a coarse step suffices; after that no two changes share a week.
    steps = [*range(start, -2_500_000_000, 52 * week), *range(-2_500_000_000, end, week)]
    states, found = [state(steps[0])], []
    for low, high in zip(steps, steps[1:]):
        if (new := state(high)) != states[-1]:
            old, lo, hi = states[-1], low, high
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if state(mid) == old else (lo, mid)
            found.append(hi)
            states.append(new)
    return np.array(found, "int64"), np.array([s[0] for s in states], "int64"), np.array([s[1] for s in states], object)


def to_utc(local_s: np.ndarray, zone: str, abbreviation: str = "") -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds and status of wall-clock seconds in a zone; an abbreviation chooses between the two of a repeated hour."""
    table = zone_table(zone)
    if table is None:
        return np.zeros_like(local_s), np.full(local_s.shape, UNREADABLE, "int8")
    changes, offsets, names = table
    if abbreviation and not (names == abbreviation).any():
        return np.zeros_like(local_s), np.full(local_s.shape, UNREADABLE, "int8")
    span = lambda utc: np.searchsorted(changes, utc, side="right")
    before, after = span(local_s - 86400), span(local_s + 86400)
    first, second = local_s - offsets[before], local_s - offsets[after]
    in_first = offsets[span(first)] == offsets[before]
    in_second = (offsets[span(second)] == offsets[after]) & (offsets[before] != offsets[after])
    exists = in_first | in_second
    if abbreviation:
        in_first &= names[span(first)] == abbreviation
        in_second &= names[span(second)] == abbreviation
    status = np.where(in_first & in_second, AMBIGUOUS, np.where(in_first | in_second, OK, np.where(exists, UNREADABLE, NONEXISTENT)))
    return np.where(in_second & ~in_first, second, first), status.astype("int8")


def _offset(text: str) -> int | None:
    """Seconds of a numeric offset, None if out of range."""
    digits = text[1:].replace(":", "").ljust(4, "0")
    hours, minutes = int(digits[:2]), int(digits[2:])
    return None if hours > 23 or minutes > 59 else (hours * 3600 + minutes * 60) * (-1 if text[0] == "-" else 1)


def _epoch_ns(whole: str, fraction: str | None) -> int | None:
    """Plain numbers count from the epoch, in the unit that their length tells: s, ms, us or ns."""
    size = len(whole.lstrip("-"))
    unit = NS if size <= 11 else 10**6 if size <= 14 else 10**3 if size <= 17 else 1
    ns = int(whole) * unit
    if fraction:
        part = int(fraction[:9].ljust(9, "0")) * unit // NS
        ns += -part if whole[0] == "-" else part
    return ns if -(2**63) <= ns < 2**63 else None


def parse_times(texts, zones, orders) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Status code, nanoseconds and whether the text was canonical (``YYYY-MM-DDTHH:MM:SS[.fraction]Z``) of each text.

    zones: each text's zone where it names none; orders: dmy, mdy or ymd, how dates with slashes are written.
    """
    n = len(texts)
    status, ns, canonical = np.full(n, UNREADABLE, "int8"), np.zeros(n, "int64"), np.zeros(n, bool)
    rows, parts, wall = [], [], {}
    match, exact = _RX.fullmatch, CANONICAL.fullmatch
    for i, text in enumerate(texts):
        if not isinstance(text, str):
            continue
        m = match(text.strip())
        if m is None:
            continue
        kind = m.lastgroup
        y, mo, d, h, mi, s, f, z, ap = (m.group(g) if g else None for g in _GROUPS[kind])
        if kind == "epoch":
            if (value := _epoch_ns(s, f)) is not None:
                status[i], ns[i] = OK, value
            continue
        if kind == "slash" and orders[i] == "mdy":
            d, mo = mo, d
        month = int(mo) if mo.isdigit() else MONTHS.get(mo.lower(), 0)
        hour = int(h or 0)
        if ap:
            hour = (hour % 12 + (12 if ap in "pP" else 0)) if 1 <= hour <= 12 else 99
        offset = 0
        if z is None:
            wall.setdefault((zones[i], ""), []).append(len(rows))
        elif z in "Zz" or z in ("UTC", "GMT"):
            canonical[i] = z == "Z" and exact(text) is not None
        elif z[0] in "+-":
            offset = _offset(z)
            if offset is None:
                continue
        elif z[0] == "[" or "/" in z:
            wall.setdefault((z.strip("[]"), ""), []).append(len(rows))
        else:
            wall.setdefault((zones[i], z), []).append(len(rows))
        rows.append(i)
        parts.append((int(y), month, int(d), hour, int(mi or 0), int(s or 0), int(f[:9].ljust(9, "0")) if f else 0, offset))
    if not rows:
        return status, ns, canonical & (status == OK)
    at = np.array(rows)
    y, mo, d, h, mi, s, frac, offset = np.array(parts, "int64").T
    good = (mo >= 1) & (mo <= 12) & (d >= 1) & (d <= days_in_month(y, mo)) & (h <= 23) & (mi <= 59) & (s <= 59)
    good &= (y >= FIRST_YEAR + 1) & (y <= LAST_YEAR - 1)
    seconds = days_from_civil(y, np.clip(mo, 1, 12), d) * 86400 + h * 3600 + mi * 60 + s - offset
    code = np.where(good, OK, UNREADABLE).astype("int8")
    for (zone, abbreviation), where in wall.items():
        where = np.array(where)[good[where]]
        if len(where):
            if not zone:
                code[where] = UNREADABLE
            else:
                seconds[where], code[where] = to_utc(seconds[where], zone, abbreviation)
    done = code == OK
    status[at] = code
    ns[at[done]] = seconds[done] * NS + frac[done]
    return status, ns, canonical & (status == OK)


_RESULT = StructType([StructField("time_status", StringType()), StructField("ts_ns", LongType()), StructField("canonical", BooleanType())])


@pandas_udf(_RESULT)
def _instants(text: pd.Series, zone: pd.Series, order: pd.Series) -> pd.DataFrame:
    none = lambda s: s.astype(object).where(s.notna(), None).to_numpy()
    status, ns, canonical = parse_times(none(text), none(zone), none(order))
    return pd.DataFrame({"time_status": np.array(STATUSES, object)[status], "ts_ns": ns, "canonical": canonical})


def instant(text: Column, zone: Column, order: Column) -> Column:
    """Struct ``time_status, ts_ns, canonical`` of a time text; zone and order may be null."""
    return _instants(text, zone, order)


def normalise_times(raw_posts: DataFrame, raw_queries: DataFrame, series_info: DataFrame) -> DataFrame:
    """One row per time text: table_name, rec_id, time_field, time_text, time_status, ts_ns, canonical.

    A series that series_info lacks has no zone; of one that it lists twice, the smallest zone and order count. Only
    the named columns are read, so extra columns of any name do no harm. Empty tables give an empty result.
    """
    info = series_info.where(F.col("index_name").isNotNull()).groupBy("index_name").agg(F.min("zone").alias("zone"), F.min("date_order").alias("date_order"))
    posts = raw_posts.select("index_name", F.lit("raw_posts").alias("table_name"), F.col("post_id").alias("rec_id"), F.array(F.struct(F.lit("post_time").alias("time_field"), F.col("time_text"))).alias("texts"))
    asked = F.array(
        F.struct(F.lit("query_from").alias("time_field"), F.col("from_text").alias("time_text")),
        F.struct(F.lit("query_to").alias("time_field"), F.col("to_text").alias("time_text")),
    )
    queries = raw_queries.select("index_name", F.lit("raw_queries").alias("table_name"), F.col("query_id").alias("rec_id"), asked.alias("texts"))
    rows = spread(posts.unionByName(queries)).join(info, "index_name", "left").select("table_name", "rec_id", "zone", "date_order", F.inline("texts"))
    return rows.withColumn("t", instant(F.col("time_text"), F.col("zone"), F.col("date_order"))).select("table_name", "rec_id", "time_field", "time_text", "t.time_status", "t.ts_ns", "t.canonical")
