"""One rate for all tasks that ask a service: the driver gives out turns.

A worker asks for a turn before each request and is told how long to wait for it. Turns of a kind are its interval apart whoever takes them, so busy tasks have the
rate that idle ones don't use, and a worker that dies costs the turn it waited for. A worker that can't reach the driver keeps a fixed share of the rate.
"""

from __future__ import annotations

import hmac
import secrets
import socket
import socketserver
import threading
import time
from dataclasses import dataclass
from functools import cache

from pyspark.sql import SparkSession

#: Seconds after which a worker takes the driver for out of reach, and until it tries again.
PATIENCE, AGAIN = 5.0, 60.0


class _Asked(socketserver.StreamRequestHandler):
    """Lines of 'key kind' or 'key kind seconds', each answered by the seconds to wait."""

    def handle(self) -> None:
        for line in self.rfile:
            key, kind, *rest = line.decode().split()
            if not hmac.compare_digest(key, self.server.pace.key):
                return
            self.wfile.write(f"{self.server.pace.hold(kind, float(rest[0])) if rest else self.server.pace.turn(kind)}\n".encode())


class Pace:
    """Turns by kind on the driver, `gaps` seconds apart."""

    def __init__(self, gaps: dict[str, float], host: str = "127.0.0.1", bind: str | None = None):
        self.gaps, self.key = dict(gaps), secrets.token_hex(16)
        self._next, self._lock = dict.fromkeys(gaps, 0.0), threading.Lock()
        self._server = socketserver.ThreadingTCPServer((bind or host, 0), _Asked, bind_and_activate=True)
        self._server.daemon_threads, self._server.pace = True, self
        threading.Thread(target=self._server.serve_forever, daemon=True).start()
        self.turns = Turns(host, self._server.server_address[1], self.key)

    def turn(self, kind: str) -> float:
        """Take the next turn; seconds until it comes."""
        with self._lock:
            now = time.monotonic()
            at = max(now, self._next[kind])
            self._next[kind] = at + self.gaps[kind]
        return at - now

    def hold(self, kind: str, seconds: float) -> float:
        """Give no new turn for some seconds, since the service asked for a pause."""
        with self._lock:
            self._next[kind] = max(self._next[kind], time.monotonic() + seconds)
        return seconds

    def close(self) -> None:
        self._server.shutdown()
        self._server.server_close()


_lost: dict[Turns, float] = {}


@dataclass(frozen=True)
class Turns:
    """Where a worker asks for turns; goes to tasks with their code, or as text with a data source's options."""

    host: str
    port: int
    key: str

    @staticmethod
    def parse(text: str | None) -> Turns | None:
        if not text:
            return None
        host, port, key = text.rsplit(":", 2)
        return Turns(host, int(port), key)

    def __str__(self) -> str:
        return f"{self.host}:{self.port}:{self.key}"

    def ask(self, kind: str, hold: float | None = None) -> float | None:
        """Seconds until this worker's turn; None if the driver doesn't answer. hold: have all wait that long instead."""
        if time.monotonic() < _lost.get(self, 0.0):
            return None
        line = f"{self.key} {kind}" + ("" if hold is None else f" {hold}")
        for _ in range(2):  # a connection that has gone stale is made anew once
            try:
                return _connection(self).ask(line)
            except (OSError, ValueError):
                _connection.cache_clear()
        _lost[self] = time.monotonic() + AGAIN
        return None


class _Connection:
    def __init__(self, turns: Turns):
        self.lock = threading.Lock()
        self.socket = socket.create_connection((turns.host, turns.port), timeout=PATIENCE)
        self.lines = self.socket.makefile("r")

    def ask(self, line: str) -> float:
        with self.lock:
            self.socket.sendall(f"{line}\n".encode())
            return float(self.lines.readline())


@cache
def _connection(turns: Turns) -> _Connection:
    """One connection a worker process."""
    return _Connection(turns)


@cache
def _paces(application: str, host: str, bind: str, gaps: tuple) -> Pace:
    return Pace(dict(gaps), host, bind)


def turns(spark: SparkSession, gaps: dict[str, float]) -> Turns:
    """The turns of an application, given out by its driver from the first call on."""
    host = spark.conf.get("spark.driver.host")
    return _paces(spark.sparkContext.applicationId, host, spark.conf.get("spark.driver.bindAddress", host), tuple(sorted(gaps.items()))).turns
