"""Calendar buckets as column expressions, all inside code generation; sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units from coarse to fine, as the levels of the time hierarchy.
LEVELS = ("root", "year", "month", "day", "hour", "minute", "second", "millisecond", "microsecond", "nanosecond")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def bucket_start(ts: Column, group) -> Column:
    """Start of the bucket (a ``plans.spec.Group``) that holds a timestamp, as a timestamp without zone."""
    if group.step_us:
        us = micros(ts)
        return F.timestamp_micros(us - F.pmod(us, F.lit(group.step_us))).cast("timestamp_ntz")
    months = (F.year(ts) - 1970) * 12 + F.month(ts) - 1
    return F.add_months(F.lit("1970-01-01").cast("date"), (months - F.pmod(months, F.lit(group.months))).cast("int")).cast("timestamp_ntz")


def from_ns(ns: Column) -> Column:
    """Timestamp without zone of nanoseconds since the epoch, rounded down to microseconds, also before 1970."""
    # Integer division: a quotient of doubles would lose the last digits.
    return F.timestamp_micros(F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000))).cast("timestamp_ntz")


def level_of(ts_ns: Column) -> Column:
    """Name of the finest unit that a time (in ns) uses, ``year`` for the first instant of a year."""
    day = F.pmod(ts_ns, F.lit(86_400_000_000_000))
    date = from_ns(ts_ns)
    checks = [("nanosecond", F.pmod(ts_ns, F.lit(1_000)) != 0), ("microsecond", F.pmod(ts_ns, F.lit(1_000_000)) != 0), ("millisecond", F.pmod(ts_ns, F.lit(1_000_000_000)) != 0)]
    checks += [("second", F.pmod(day, F.lit(60_000_000_000)) != 0), ("minute", F.pmod(day, F.lit(3_600_000_000_000)) != 0), ("hour", day != 0), ("day", F.dayofmonth(date) != 1), ("month", F.month(date) != 1)]
    out = F.lit("year")
    for name, test in reversed(checks):
        out = F.when(test, name).otherwise(out)
    return out
