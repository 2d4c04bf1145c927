"""What a query asks for: validated before any plan is built."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from chronoloom.errors import BadGroupError, BadReducerError, BadTimeError, MalformedBodyError
from chronoloom.functions.reducers import REDUCERS
from chronoloom.operators.instants import OK, parse_times

#: Microseconds of the fixed units and months of the calendar units; the finest two serve rollups only.
FIXED_UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}
CALENDAR_UNITS = {"month": 1, "year": 12}
QUERY_UNITS = ("second", "minute", "hour", "day", "month", "year")
EPOCH = dt.datetime(1970, 1, 1)
_GROUP = re.compile(r"([0-9]*)([a-z]*)")


@dataclass(frozen=True)
class Group:
    """A bucket width: N units, aligned to the epoch in UTC."""

    width: int
    unit: str

    @property
    def step_us(self) -> int | None:
        """Width of fixed units in microseconds; None for months and years."""
        return self.width * FIXED_UNITS[self.unit] if self.unit in FIXED_UNITS else None

    @property
    def months(self) -> int | None:
        return self.width * CALENDAR_UNITS[self.unit] if self.unit in CALENDAR_UNITS else None

    def floor_us(self, us: int) -> int:
        """Start of the bucket that holds an instant, in microseconds since the epoch."""
        if self.step_us:
            return us - us % self.step_us
        at = EPOCH + dt.timedelta(microseconds=us)
        n = ((at.year - 1970) * 12 + at.month - 1) // self.months * self.months
        return int((dt.datetime(1970 + n // 12, n % 12 + 1, 1) - EPOCH).total_seconds()) * 1_000_000

    def nests_in(self, other: Group) -> bool:
        """Whether every bucket of ``other`` is made of whole buckets of this width."""
        if self.step_us and other.step_us:
            return other.step_us % self.step_us == 0
        if self.months and other.months:
            return other.months % self.months == 0
        return bool(self.step_us and other.months and FIXED_UNITS["day"] % self.step_us == 0)


def parse_group(text: str | None) -> Group:
    """``<digits><unit>``, singular or plural; without digits one unit; nothing at all means a year."""
    if text is None or not text.strip():
        return Group(1, "year")
    m = _GROUP.fullmatch(text.strip().lower())
    unit = m[2].removesuffix("s") if m else ""
    if unit not in QUERY_UNITS:
        raise BadGroupError(f"unknown group {text!r}: units are {', '.join(QUERY_UNITS)}")
    width = int(m[1]) if m[1] else 1
    if width < 1:
        raise BadGroupError(f"group {text!r} has no width")
    return Group(width, unit)


def parse_ns(text: str, zone: str = "UTC", order: str = "ymd") -> int:
    """Nanoseconds since the epoch of one time text, in any format of ``operators.instants``."""
    status, ns, _ = parse_times([text], [zone], [order])
    if status[0] != OK:
        raise BadTimeError(f"no single instant: {text!r}")
    return int(ns[0])


@dataclass(frozen=True)
class QuerySpec:
    """One aggregation: series, half-open range (its start floored to the bucket), bucket width, a reducer for each field.

    Several series, and open bounds, go beyond the single-series form; ``index_names`` None means all series. In place of
    a reducer (field, reducer) may stand, so that a field can have several: the key is then the name of the result.
    """

    fields: Mapping[str, str | tuple[str, str]]
    group: Group = Group(1, "year")
    index_names: tuple[str, ...] | None = None
    from_ns: int | None = None
    to_ns: int | None = None
    extra: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        for name, _, reducer in self.outputs:
            if reducer not in REDUCERS:
                raise BadReducerError(f"field {name!r}: unknown reducer {reducer!r}; there are {', '.join(REDUCERS)}")

    @property
    def outputs(self) -> list[tuple[str, str, str]]:
        """Name of the result, field and reducer of each."""
        return [(name, *((name, r) if isinstance(r, str) or r is None else r)) for name, r in self.fields.items()]

    @property
    def start_us(self) -> int | None:
        """First instant asked for: the start of the bucket that holds ``from``."""
        return None if self.from_ns is None else self.group.floor_us(self.from_ns // 1000)

    @property
    def end_us(self) -> int | None:
        """First microsecond no longer asked for."""
        return None if self.to_ns is None else -(-self.to_ns // 1000)

    @classmethod
    def from_json(cls, body: str | bytes | Mapping) -> QuerySpec:
        """From ``{"index", "from", "to", "group", "fields": {name: {"reducer": name}}}``; from and to are required.

        An entry of fields may name its field (``{"field": name, "reducer": name}``) where it isn't the key.
        """
        if not isinstance(body, Mapping):
            try:
                body = json.loads(body)
            except ValueError as e:
                raise MalformedBodyError(str(e)) from e
        if not isinstance(body, Mapping) or not isinstance(body.get("fields", {}), Mapping):
            raise MalformedBodyError("a query is an object with an object of fields")
        index = body.get("index")
        reducer_of = lambda v: v.get("reducer", "") if isinstance(v, Mapping) else str(v)
        fields = {str(k): (str(v["field"]), reducer_of(v)) if isinstance(v, Mapping) and "field" in v else reducer_of(v) for k, v in body.get("fields", {}).items()}
        names = None if index is None else tuple(index) if isinstance(index, (list, tuple)) else (str(index),)
        for bound in ("from", "to"):
            if not isinstance(body.get(bound), str):
                raise BadTimeError(f"{bound!r} is required")
        return cls(fields, parse_group(body.get("group")), names, parse_ns(body["from"]), parse_ns(body["to"]))
