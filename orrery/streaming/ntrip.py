"""A caster or socket as a streaming source of raw byte rows.

A live socket cannot be read again, so bytes that were read but not yet committed live only in the reader's memory: delivery is
at most once over a restart. Land the rows first (for instance to parquet) and decode from there where that matters.
"""

from __future__ import annotations

import base64
import socket
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


def next_delay(delay: float, cap: float = 64.0) -> float:
    """The wait before the next attempt doubles up to the cap."""
    return min(delay * 2, cap)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.host, self.port = options["host"], int(options.get("port", 2101))
        self.mount, self.login = options.get("mount"), options.get("login")
        self.limit, self.wait = int(options.get("bytes", 65_536)), float(options.get("wait", 1.0))
        self.sock: socket.socket | None = None
        self.delay, self.retry_at, self.kept = 1.0, 0.0, {}

    def initialOffset(self) -> dict:
        return {"at": 0}

    def _connect(self) -> None:
        if self.sock or time.time() < self.retry_at:
            return
        try:
            self.sock = socket.create_connection((self.host, self.port), timeout=self.wait)
            if self.mount:
                auth = f"Authorization: Basic {base64.b64encode(self.login.encode()).decode()}\r\n" if self.login else ""
                self.sock.sendall(f"GET /{self.mount} HTTP/1.0\r\nUser-Agent: NTRIP orrery\r\n{auth}\r\n".encode())
            self.delay = 1.0
        except OSError:
            self.sock, self.retry_at = None, time.time() + self.delay
            self.delay = next_delay(self.delay)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        self._connect()
        data = b""
        try:
            while self.sock and len(data) < self.limit:
                chunk = self.sock.recv(4096)
                if not chunk:
                    self.sock = None
                    break
                data += chunk
        except OSError:
            pass
        if not data:
            return iter([]), start
        end = {"at": start["at"] + len(data)}
        self.kept[start["at"]] = (end["at"], data)
        return iter([(self.mount or self.host, start["at"], data)]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(self.mount or self.host, a, d) for a, (z, d) in sorted(self.kept.items()) if start["at"] <= a and z <= end["at"]])

    def commit(self, end: dict) -> None:
        self.kept = {a: v for a, v in self.kept.items() if v[0] > end["at"]}


class NtripSource(DataSource):
    """Options host, port, mount, login, bytes (a batch's most), wait (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "ntrip"

    def schema(self) -> str:
        return "stream string, at bigint, data binary"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(dict(self.options))
