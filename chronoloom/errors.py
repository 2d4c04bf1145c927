"""Exceptions raised at the library's surface; faults inside a Spark job are left to fail the job."""


class ChronoloomError(Exception):
    """Base of all errors raised by this library."""


class DatabaseNotFoundError(ChronoloomError):
    """The named database does not exist."""


class DatabaseExistsError(ChronoloomError):
    """A database of that name exists already."""


class BadTimeError(ChronoloomError, ValueError):
    """A time text could not be read as an instant."""


class BadGroupError(ChronoloomError, ValueError):
    """A group specification names no known unit or a width of zero."""


class BadReducerError(ChronoloomError, ValueError):
    """A reducer name is not one of those in ``functions.reducers``."""


class MalformedBodyError(ChronoloomError, ValueError):
    """A JSON body could not be parsed, or is not of the expected shape."""
