"""A cache of loaded values by key and time, with one load at a time for a key; optionally kept in a file."""

from __future__ import annotations

import json
import sqlite3
import threading
import time
from collections.abc import Callable
from typing import Any

CLEAN_EVERY = 50


class TtlCache:
    """get_or_load(key, seconds, loader): a ttl of 0 loads every time. Over max_entries, expired entries go first,
    then the oldest. Concurrent calls for a key share one load; a failed load is not kept."""

    def __init__(self, max_entries: int = 10_000, clock: Callable[[], float] = time.time):
        self.max_entries, self.clock = max_entries, clock
        self.entries: dict[str, tuple[float, Any]] = {}
        self.loading: dict[str, tuple[threading.Event, list]] = {}
        self.lock = threading.RLock()

    def read(self, key: str) -> tuple[float, Any] | None:
        return self.entries.get(key)

    def write(self, key: str, until: float, value: Any) -> None:
        self.entries.pop(key, None)
        if len(self.entries) >= self.max_entries:
            now = self.clock()
            for k in [k for k, (t, _) in self.entries.items() if t <= now]:
                del self.entries[k]
        while len(self.entries) >= self.max_entries:
            del self.entries[next(iter(self.entries))]
        self.entries[key] = until, value

    def get_or_load(self, key: str, ttl: float, loader: Callable[[], Any]) -> Any:
        if ttl <= 0:
            return loader()
        with self.lock:
            if (held := self.read(key)) and held[0] > self.clock():
                return held[1]
            mine = key not in self.loading
            event, result = self.loading.setdefault(key, (threading.Event(), []))
        if not mine:
            event.wait()
            if isinstance(result[0], Exception):
                raise result[0]
            return result[0]
        try:
            result.append(loader())
        except Exception as e:
            result.append(e)
            raise
        finally:
            with self.lock:
                if not isinstance(result[0], Exception):
                    self.write(key, self.clock() + ttl, result[0])
                del self.loading[key]
            event.set()
        return result[0]


class FileCache(TtlCache):
    """The same with entries as JSON in a database file, so they outlive the process."""

    def __init__(self, path: str, max_entries: int = 10_000, clock: Callable[[], float] = time.time):
        super().__init__(max_entries, clock)
        self.db = sqlite3.connect(path, check_same_thread=False)
        self.db.execute("create table if not exists entries (key text primary key, until real, at integer, value text)")
        self.writes = 0

    def read(self, key: str) -> tuple[float, Any] | None:
        row = self.db.execute("select until, value from entries where key = ?", (key,)).fetchone()
        return row and (row[0], json.loads(row[1]))

    def write(self, key: str, until: float, value: Any) -> None:
        self.writes += 1
        with self.db:
            at = self.db.execute("select coalesce(max(at), 0) + 1 from entries").fetchone()[0]
            self.db.execute("insert or replace into entries values (?, ?, ?, ?)", (key, until, at, json.dumps(value)))
            if self.writes % CLEAN_EVERY == 0:
                self.db.execute("delete from entries where until <= ?", (self.clock(),))
            self.db.execute("delete from entries where key in (select key from entries order by until > ?, at limit max(0, (select count(*) from entries) - ?))", (self.clock(), self.max_entries))


def make_cache(path: str | None = None, max_entries: int = 10_000) -> TtlCache:
    return FileCache(path, max_entries) if path else TtlCache(max_entries)
