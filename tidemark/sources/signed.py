"""Signed GET requests for account records: the query that is signed, and one more try after a clock that was off.

Fetching and signing are given by the caller, so no secret is kept here and everything can be run without a network.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from urllib.parse import urlencode

from ..validate import InvalidArgument, need, number

#: Fixed value: the error code of an answer to a request whose time is outside the window.
CLOCK_IS_OFF = -1021


class RefusedRequest(RuntimeError):
    """An answer that is no success; code is the service's own where it gives one."""

    def __init__(self, status: int, code: int | None = None):
        super().__init__(f"the account service answered {status}" + (f" ({code})" if code is not None else ""))
        self.status, self.code = status, code


class SignedReader:
    """fetch(path_and_query, headers) gives (status, body); sign(text) gives the signature as text; key_header names
    the header that carries the key. Times are in milliseconds."""

    def __init__(self, fetch: Callable[[str, dict], tuple[int, str]], sign: Callable[[str], str], api_key: str, key_header: str, time_path: str, window: int = 5000, clock: Callable[[], float] = time.time):
        number(window, "window", integer=True, minimum=1)
        need(bool(api_key and key_header), "api_key and key_header are needed")
        self.fetch, self.sign, self.headers, self.time_path = fetch, sign, {key_header: api_key}, time_path
        self.window, self.clock, self.offset = window, clock, 0

    def now(self) -> int:
        return round(self.clock() * 1000)

    def query(self, params: dict) -> str:
        """The text that is signed: the parameters that are set, in their order, then window and time."""
        text = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in params.items() if v is not None}
        return urlencode(text | {"recvWindow": str(self.window), "timestamp": str(self.now() + self.offset)})

    def synchronise(self) -> None:
        """Learns how far the service's clock is ahead, as of the middle of a request for its time."""
        began = self.now()
        status, body = self.fetch(self.time_path, {})
        ended = self.now()
        try:
            there = json.loads(body)["serverTime"] if status == 200 else None
        except (ValueError, KeyError, TypeError):
            there = None
        if not isinstance(there, int | float) or isinstance(there, bool):
            raise InvalidArgument("the account service gave no time")
        self.offset = round(there - (began + ended) / 2)

    def get(self, path: str, **params) -> str:
        """The body of an answer, for the parsers of account records. A request refused for its time is sent once more
        with the service's time."""
        for again in (False, True):
            query = self.query(params)
            status, body = self.fetch(f"{path}?{query}&{urlencode({'signature': self.sign(query)})}", self.headers)
            if status == 200:
                return body
            try:
                code = json.loads(body).get("code")
            except (ValueError, AttributeError):
                code = None
            if again or code != CLOCK_IS_OFF:
                raise RefusedRequest(status, code)
            self.synchronise()
        raise AssertionError("unreachable")
