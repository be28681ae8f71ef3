"""Optional HTTP connectors. Nothing here runs unless asked for; tests give a fake transport.

The base addresses are parameters: no service is built in.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import UTC, date, datetime, timedelta
from functools import cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

from oddsframe.operators.snapshots import MAX_STALE, fetch_windows, price_at
from oddsframe.sources.pace import Turns, turns
from oddsframe.sources.store import windows

# Seconds between requests of each kind, page sizes and ceilings, the longest window of a price request.
MIN_INTERVAL = {"prices": 0.03, "trades": 0.05, "events": 0.35, "observations": 6.0}
PAGE, MAX_OFFSET, EVENT_PAGE = 500, 10_000, 100
MAX_WINDOW, SNAPSHOT_WINDOW = timedelta(days=5), timedelta(days=15)
TOO_MANY = 429
RETRY_STATUS = {408, 425, 429, 500, 502, 503, 504}
# Attempts, first pause and longest pause in seconds; a refusal (403) of the event crawl passes after a while.
PATIENCE, REFUSED = (5, 1.0, 60.0), (8, 15.0, 300.0)
Transport = Callable[[str], str]


class Client:
    """GET with a least interval between requests, retries, and an optional cache on disk by a hash of the address.

    turns: where all clients of an application ask for their turns. share: how many clients ask the service at once; without turns, or if nobody gives them, each
    keeps that many intervals between its own requests."""

    def __init__(self, kind: str, cache: str | None = None, transport: Transport | None = None, share: int = 1, timeout: float = 60, sleep: Callable[[float], None] = time.sleep, turns: Turns | None = None):
        self.kind, self.turns = kind, turns
        self.gap, self.cache, self.timeout, self.sleep = MIN_INTERVAL[kind] * share, Path(cache) if cache else None, timeout, sleep
        self.patience = dict.fromkeys(RETRY_STATUS, PATIENCE) | ({403: REFUSED} if kind == "events" else {})
        self.transport = transport or self._get
        self._lock, self._next = threading.Lock(), 0.0

    def _get(self, url: str) -> str:
        with urllib.request.urlopen(url, timeout=self.timeout) as r:
            return r.read().decode()

    def _wait(self) -> None:
        wait = self.turns.ask(self.kind) if self.turns else None
        if wait is not None:
            self.sleep(wait)
            return
        with self._lock:
            now = time.monotonic()
            at = max(now, self._next)
            self._next = at + self.gap
        self.sleep(max(0.0, at - now))

    def get_text(self, url: str, params: dict | None = None, cached: bool = True) -> str:
        full = url + ("?" + urllib.parse.urlencode(params, doseq=True) if params else "")
        path = self.cache / hashlib.sha256(full.encode()).hexdigest() if self.cache and cached else None
        if path and path.exists():
            return path.read_text()
        text = self._asked(full)
        if path:
            path.parent.mkdir(parents=True, exist_ok=True)
            tmp = path.with_suffix(".tmp")
            tmp.write_text(text)
            tmp.replace(path)
        return text

    def _asked(self, url: str) -> str:
        """The answer, asked for again as long as the kind of failure allows."""
        tried = 0
        while True:
            self._wait()
            try:
                return self.transport(url)
            except (urllib.error.URLError, TimeoutError) as e:
                attempts, first, longest = self.patience.get(e.code, (0, 0, 0)) if isinstance(e, urllib.error.HTTPError) else PATIENCE
                tried += 1
                if tried >= attempts:
                    raise
                pause = min(longest, first * 2.0 ** (tried - 1))
                if self.turns and getattr(e, "code", None) == TOO_MANY:
                    self.turns.ask(self.kind, hold=pause)
                self.sleep(pause)

    def get_json(self, url: str, params: dict | None = None, cached: bool = True):
        return json.loads(self.get_text(url, params, cached))


@cache
def worker_client(kind: str, share: int, transport: Transport | None = None, turns: Turns | None = None) -> Client:
    """One client a worker process, so that its interval holds over all events that the process fetches."""
    return Client(kind, transport=transport, share=share, turns=turns)


def price_history(client: Client, base: str, token: str, start: datetime, end: datetime, fidelity_min: int = 1, window: timedelta = MAX_WINDOW) -> pd.DataFrame:
    """(ts, p) of a token in [start, end], read window by window; a time comes once."""
    points: dict[int, float] = {}
    for a, b in windows(pd.Timestamp(start), pd.Timestamp(end), pd.Timedelta(window)):
        got = client.get_json(f"{base}/prices-history", {"market": token, "startTs": int(a.timestamp()), "endTs": int(b.timestamp()), "fidelity": fidelity_min})
        for x in got.get("history") or []:
            points.setdefault(int(x["t"]), float(x["p"]))
    at = sorted(points)
    return pd.DataFrame({"ts": pd.to_datetime(at, unit="s", utc=True), "p": [points[t] for t in at]})


def taker_trades(client: Client, base: str, condition_id: str, max_offset: int = MAX_OFFSET) -> tuple[pd.DataFrame, bool]:
    """Taker trades of a market, and if the service's offset ceiling cut them off."""
    rows, offset, truncated = [], 0, False
    while True:
        page = client.get_json(f"{base}/trades", {"market": condition_id, "limit": PAGE, "offset": offset, "takerOnly": "true"})
        rows += page
        if len(page) < PAGE:
            break
        offset += PAGE
        if truncated := offset >= max_offset:
            break
    out = pd.DataFrame({
        "ts": pd.to_datetime([int(t["timestamp"]) for t in rows], unit="s", utc=True), "side": [t["side"] for t in rows], "outcome_index": [int(t["outcomeIndex"]) for t in rows],
        "price": [float(t["price"]) for t in rows], "size": [float(t["size"]) for t in rows], "tx": [t.get("transactionHash") for t in rows],
    })
    return out.sort_values("ts", kind="stable").reset_index(drop=True), truncated


def get_event(client: Client, base: str, id_or_slug: str) -> dict:
    """One raw event by id or slug."""
    found = client.get_json(f"{base}/events", {"id" if id_or_slug.isdigit() else "slug": id_or_slug})
    if not found:
        raise ValueError(f"no event {id_or_slug!r}")
    return found[0] if isinstance(found, list) else found


def list_series(client: Client, base: str) -> Iterator[dict]:
    """All series, page by page."""
    offset = 0
    while page := client.get_json(f"{base}/series", {"limit": EVENT_PAGE, "offset": offset}):
        yield from page
        offset += len(page)


def series_events(client: Client, base: str, series_id: str) -> Iterator[dict]:
    """All events of a series, page by page."""
    offset = 0
    while page := client.get_json(f"{base}/events", {"series_id": series_id, "limit": EVENT_PAGE, "offset": offset}):
        yield from page
        offset += len(page)


def iter_events(client: Client, base: str, since: date, until: date | None = None, tag_slug: str | None = None, closed: bool | None = True, step: timedelta = timedelta(days=31), today: date | None = None) -> Iterator[dict]:
    """Events by end date in [since, until), in windows of their own cursors: closed ones, open ones (closed False) or both (None), of one tag or all.

    Pages of closed events in windows that are over are cached where the client has a cache, so a crawl can go on where it stopped; a refused page is asked for
    again with the same cursor."""
    today = today or datetime.now(UTC).date()
    fixed = {"limit": EVENT_PAGE} | ({} if closed is None else {"closed": str(closed).lower()}) | ({"tag_slug": tag_slug} if tag_slug else {})
    for a, b in windows(pd.Timestamp(since), pd.Timestamp(until or today), pd.Timedelta(step)):
        window = {"end_date_min": a.date().isoformat(), "end_date_max": b.date().isoformat()} | fixed
        cursor: dict = {}
        while True:
            page = client.get_json(f"{base}/events/keyset", window | cursor, cached=bool(closed) and b.date() < today)
            yield from page.get("events") or []
            if not (page.get("events") and page.get("next_cursor")):
                break
            cursor = {"after_cursor": page["next_cursor"]}


def fetch_prices(wanted: DataFrame, base: str, fidelity_min: int = 1, workers: int = 8, window: timedelta = MAX_WINDOW, transport: Transport | None = None) -> DataFrame:
    """(market_id, ts, p) of the windows wanted (market_id, token0, start, end), fetched on the executors by `workers` tasks; a market that fails has no rows."""

    given = turns(wanted.sparkSession, MIN_INTERVAL)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = worker_client("prices", workers, transport, given)
        for pdf in frames:
            for r in pdf.itertuples():
                try:
                    got = price_history(client, base, r.token0, r.start.to_pydatetime(), r.end.to_pydatetime(), fidelity_min, window)
                except (OSError, ValueError, KeyError):
                    continue
                yield got.assign(market_id=r.market_id)[["market_id", "ts", "p"]]

    return wanted.select("market_id", "token0", "start", "end").repartition(workers, "market_id").mapInPandas(run, "market_id string, ts timestamp, p double").dropDuplicates(["market_id", "ts"])


def fetch_snapshots(markets: DataFrame, targets: DataFrame, base: str, fidelity_min: int = 10, max_stale: timedelta = MAX_STALE, workers: int = 8, transport: Transport | None = None) -> DataFrame:
    """Prices at snapshot targets, fetched for the windows around them instead of whole histories."""
    wanted = fetch_windows(markets, targets).withColumnsRenamed({"window_start": "start", "window_end": "end"})
    prices = fetch_prices(wanted, base, fidelity_min, workers, SNAPSHOT_WINDOW, transport)
    return price_at(targets, prices, "target_ts", max_stale).where("p is not null")
