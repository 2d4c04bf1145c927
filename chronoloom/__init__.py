"""chronoloom: time-series storage, calendar queries and data-quality operators on Spark DataFrames."""

from chronoloom.errors import (
    BadGroupError,
    BadReducerError,
    BadTimeError,
    ChronoloomError,
    DatabaseExistsError,
    DatabaseNotFoundError,
    MalformedBodyError,
)
from chronoloom.plans.spec import QuerySpec, parse_group
from chronoloom.plans.query import run_query
from chronoloom.sources.store import Store

__version__ = "0.1.0"

__all__ = [
    "BadGroupError",
    "BadReducerError",
    "BadTimeError",
    "ChronoloomError",
    "DatabaseExistsError",
    "DatabaseNotFoundError",
    "MalformedBodyError",
    "QuerySpec",
    "Store",
    "parse_group",
    "run_query",
]
