"""The store behind ten HTTP routes with JSON bodies, with or without a socket."""

from __future__ import annotations

import json
import logging
import math
import re
import time
from collections.abc import Callable
from datetime import timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import unquote

from chronoloom.errors import ChronoloomError, DatabaseExistsError, DatabaseNotFoundError
from chronoloom.plans.spec import EPOCH
from chronoloom.sources.store import DB_NAME, Store

log = logging.getLogger(__name__)
DB = rf"(?P<db>{DB_NAME})"
INDEX = r"(?P<index>[^/]+)"
Answer = tuple[int, Any]


class Api:
    """Dispatches (method, path, body) to the store; answers (status, JSON value or None)."""

    def __init__(self, store: Store, version: str = "0.1.0"):
        self.store, self.version = store, version
        #: Methods and paths are the outer interface. First match wins, so fixed names come before patterns that would take them.
        self.routes: list[tuple[str, re.Pattern, Callable[..., Answer]]] = [
            (method, re.compile(path), handler)
            for method, path, handler in (
                ("GET", r"/", self.info),
                ("GET", r"/_all_dbs", self.list_dbs),
                ("GET", rf"/{DB}/?", self.db_info),
                ("PUT", rf"/{DB}/?", self.create_db),
                ("DELETE", rf"/{DB}/_all", self.drop_db),
                ("POST", rf"/{DB}/_query", self.query),
                ("POST", rf"/{DB}/?", self.put),
                ("GET", rf"/{DB}/{INDEX}/(?P<time>[^/]+)", self.get),
                ("GET", rf"/{DB}/{INDEX}/(?P<field>[^/]+)/(?P<time>[^/]+)", self.get),
                ("DELETE", rf"/{DB}/{INDEX}/_all", self.drop_index),
                ("DELETE", rf"/{DB}/{INDEX}", self.delete),
            )
        ]

    def handle(self, method: str, path: str, body: bytes | str = b"") -> Answer:
        began = time.perf_counter()
        try:
            for verb, pattern, handler in self.routes:
                if verb == method and (m := pattern.fullmatch(path)):
                    return handler(body, **{k: unquote(v) for k, v in m.groupdict().items()})
            return 400, {"error": "no_handler", "reason": f"Can't handle {method} to {path}"}
        except DatabaseNotFoundError as e:
            return 404, {"error": "not_found", "reason": str(e)}
        except DatabaseExistsError as e:
            return 409, {"error": "exists", "reason": str(e)}
        except (ChronoloomError, ValueError) as e:
            return 400, {"error": type(e).__name__, "reason": str(e)}
        finally:
            log.info("%s %s %.3f s", method, path, time.perf_counter() - began)

    def info(self, body) -> Answer:
        return 200, {"engine": "chronoloom", "version": self.version, "spark": self.store.spark.version}

    def list_dbs(self, body) -> Answer:
        return 200, self.store.list_dbs()

    def db_info(self, body, db: str) -> Answer:
        return 200, self.store.db_info(db)

    def create_db(self, body, db: str) -> Answer:
        self.store.create_db(db)
        return 201, None

    def drop_db(self, body, db: str) -> Answer:
        self.store.drop_db(db)
        return 201, None

    def query(self, body, db: str) -> Answer:
        out = []
        for row in self.store.query(db, body).drop("index_name").toLocalIterator():
            values = row.asDict()
            start = values.pop("bucket_start")
            out.append({"Timestamp": (start - EPOCH) // timedelta(microseconds=1) * 1000, "Value": values})
        return 200, out

    def put(self, body, db: str) -> Answer:
        done = self.store.put(db, body)
        rejected = [{"index": r.index_name, "time": r.time, "reason": r.reason} for r in done.rejected.collect()]
        return 200, {"accepted": done.accepted, "rejected": rejected}

    def get(self, body, db: str, index: str, time: str, field: str | None = None) -> Answer:
        found = self.store.get(db, index, time, field)
        return (404, {"error": "not_found", "reason": f"no point of {index} at {time}"}) if found is None else (200, found)

    def drop_index(self, body, db: str, index: str) -> Answer:
        self.store.drop_index(db, index)
        return 201, None

    def delete(self, body, db: str, index: str) -> Answer:
        if body:
            try:
                bounds = json.loads(body)
            except ValueError as e:
                return 400, {"error": "MalformedBodyError", "reason": str(e)}
            if not isinstance(bounds, dict) or not all(isinstance(bounds.get(k), (str, type(None))) for k in ("from", "to")):
                return 400, {"error": "MalformedBodyError", "reason": "a range is an object with the texts 'from' and 'to'"}
            self.store.delete(db, index, bounds.get("from"), bounds.get("to"))
        return 201, None


def finite(value: Any) -> Any:
    """The value with null for each number that JSON can't write (sums of accepted points may overflow)."""
    if isinstance(value, dict):
        return {k: finite(v) for k, v in value.items()}
    if isinstance(value, list):
        return [finite(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def serve(api: Api, port: int = 9527, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server for the routes; the caller runs ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        timeout = 5

        def _any(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, value = api.handle(self.command, self.path, self.rfile.read(size) if size else b"")
            data = b"" if value is None else json.dumps(finite(value), allow_nan=False, sort_keys=True).encode()
            self.send_response(status)
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_PUT = do_POST = do_DELETE = do_PATCH = do_OPTIONS = _any

        def log_message(self, *args) -> None:
            log.debug("%s", args)

    return ThreadingHTTPServer((host, port), Handler)
