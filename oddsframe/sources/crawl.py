"""Crawls as Spark data sources: each partition is a window of events or a year of a station, read page by page where it runs. Nothing is listed on the driver.

    spark.dataSource.register(EventCrawl)
    spark.read.format("market_events").option("base", address).option("since", "2025-01-01").load()

As a stream the event crawl has the day up to which it has come as its offset, so a query with a checkpoint goes on where it stopped. The addresses are options; no service is built
in. Tests give a subclass with its own transport.
"""

from __future__ import annotations

import csv
import io
import json
import time
from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from oddsframe.schemas import RAW_EVENT
from oddsframe.sources import api
from oddsframe.sources.pace import Turns, turns
from oddsframe.sources.store import Store

# Days of a window, the answer of a throttled service, how often it is asked again and the pause's step in seconds.
STEP_DAYS, THROTTLED, ATTEMPTS, PAUSE = 31, "Too many requests", 6, 30.0


class _Window(InputPartition):
    """Events that end in [start, end)."""

    def __init__(self, start: str, end: str):
        super().__init__((start, end))
        self.start, self.end = start, end


def _windows(start: date, end: date, step: int) -> list[_Window]:
    cuts = [start + timedelta(days=k) for k in range(0, max(0, (end - start).days), step)]
    return [_Window(a.isoformat(), b.isoformat()) for a, b in zip(cuts, [*cuts[1:], end], strict=False)]


class _Series(InputPartition):
    """All events of a series."""

    def __init__(self, series: str):
        super().__init__(series)
        self.series = series


class _Pages:
    """How a window or a series is read; what both readers of events have in common."""

    def __init__(self, options: dict[str, str], transport):
        self.options, self.transport = dict(options), transport
        self.since, self.step = date.fromisoformat(self.options.get("since", "1970-01-01")), int(self.options.get("step_days", STEP_DAYS))
        self.until = date.fromisoformat(self.options["until"]) if "until" in self.options else None

    def end(self) -> date:
        today = datetime.now(UTC).date()
        return min(self.until or today, today) if self.options.get("closed", "true") == "true" else self.until or today

    def read(self, partition: _Window | _Series | None) -> Iterator[tuple[str, str]]:
        if partition is None:  # what Spark reads where there are no partitions
            return
        client = api.Client("events", self.options.get("cache"), self.transport, int(self.options.get("workers", "1")), turns=Turns.parse(self.options.get("turns_token")))
        if isinstance(partition, _Series):
            yield from ((partition.series, json.dumps(e)) for e in api.series_events(client, self.options["base"], partition.series))
            return
        closed = self.options.get("closed", "true")
        asked = {"end_date_min": partition.start, "end_date_max": partition.end, "limit": api.EVENT_PAGE} | ({} if closed == "any" else {"closed": closed}) | ({"tag_slug": t} if (t := self.options.get("tag")) else {})
        cursor: dict = {}
        while True:
            page = client.get_json(f"{self.options['base']}/events/keyset", asked | cursor, cached=closed == "true" and partition.end < datetime.now(UTC).date().isoformat())
            for event in page.get("events") or []:
                yield partition.start, json.dumps(event)
            if not (page.get("events") and page.get("next_cursor")):
                return
            cursor = {"after_cursor": page["next_cursor"]}


class _EventReader(_Pages, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        if "series" in self.options:
            return [_Series(x) for x in self.options["series"].split(",") if x]
        return _windows(self.since, self.end(), self.step)


class _EventStream(_Pages, DataSourceStreamReader):
    """Windows that are over, from the day reached on. The offset is that day."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"day": self.since.isoformat()}

    def latestOffset(self) -> dict:  # noqa: N802
        whole = max(0, (self.end() - self.since).days) // self.step
        return {"day": (self.since + timedelta(days=whole * self.step)).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[_Window]:
        return _windows(date.fromisoformat(start["day"]), date.fromisoformat(end["day"]), self.step)

    def commit(self, end: dict) -> None:
        pass


class EventCrawl(DataSource):
    """(window, event: JSON) by end date, or with the option series (ids, comma-joined) by series. Options: base, since; until, tag, closed (true, false, any), step_days, cache (a folder on every worker), turns_token (of pace.turns, for one
    rate over all tasks; Spark hides it in plans), workers (that share the rate without turns)."""

    transport = None

    @classmethod
    def name(cls) -> str:
        return "market_events"

    def schema(self) -> str:
        return "window string, event string"

    def reader(self, schema) -> DataSourceReader:
        return _EventReader(self.options, type(self).transport)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _EventStream(self.options, type(self).transport)


def raw_events(crawled: DataFrame, extra: str = "") -> DataFrame:
    """The events of a crawl, typed (schemas.RAW_EVENT and more fields)."""
    return crawled.select(F.from_json("event", RAW_EVENT + extra).alias("e")).select("e.*")


class _Year(InputPartition):
    def __init__(self, station: str, year: int):
        super().__init__((station, year))
        self.station, self.year = station, year


class _YearReader(DataSourceReader):
    def __init__(self, options: dict[str, str], transport, sleep):
        self.options, self.transport, self.sleep = dict(options), transport, sleep

    def partitions(self) -> list[_Year]:
        return [_Year(s, int(y)) for s, y in (x.split("/") for x in self.options["years"].split(",") if x)]

    def read(self, partition: _Year | None) -> Iterator[tuple]:
        """The year's reports, then one row without a time that tells how many lines were dropped for their number of fields; nothing at all if the service doesn't answer."""
        if partition is None:
            return
        client = api.Client("observations", None, self.transport, int(self.options.get("workers", "1")), sleep=self.sleep, turns=Turns.parse(self.options.get("turns_token")))
        asked = {"station": partition.station, "data": "metar", "year1": partition.year, "month1": 1, "day1": 1, "year2": partition.year + 1, "month2": 1, "day2": 1, "tz": "Etc/UTC", "format": "onlycomma", "report_type": [3, 4]}
        text = THROTTLED
        for k in range(ATTEMPTS):
            try:
                text = client.get_text(self.options["base"], asked, cached=False)
            except OSError:
                return
            if not text.startswith(THROTTLED):
                break
            if client.turns:
                client.turns.ask(client.kind, hold=PAUSE * (k + 1))
            self.sleep(PAUSE * (k + 1))
        else:
            return
        lines = csv.reader(io.StringIO(text))
        header, dropped = next(lines, []), 0
        for line in lines:
            if len(line) != len(header):
                dropped += 1
                continue
            row = dict(zip(header, line, strict=True))
            yield partition.station, partition.year, row.get("valid") or None, row.get("metar") or None, None
        yield partition.station, partition.year, None, None, dropped


class StationYears(DataSource):
    """(station_icao, year, valid, metar, dropped) of station-years. Options: base; years as station/year, comma-joined; turns_token and workers as for the event crawl."""

    transport = None
    sleep = staticmethod(time.sleep)

    @classmethod
    def name(cls) -> str:
        return "station_years"

    def schema(self) -> str:
        return "station_icao string, year int, valid string, metar string, dropped int"

    def reader(self, schema) -> DataSourceReader:
        return _YearReader(self.options, type(self).transport, type(self).sleep)


def download_station_years(store: Store, stations: list[str], base: str, first_year: int, today: date | None = None, workers: int = 1, source: type[DataSource] = StationYears) -> dict[str, int]:
    """Fetch the station-years that the store doesn't have, and the current year again: a partition each, which takes its place as it is written. What fails is missing and asked for
    the next time. Counts of years, fetched, failed, skipped, and lines dropped."""
    spark, path, now = store.spark, f"{store.root}/reports", (today or datetime.now(UTC).date()).year
    spark.dataSource.register(source)
    have = {(r.station_icao, int(r.year)) for r in store.partitions("reports", ["station_icao", "year"]).collect()}  # a row a station-year, from folder names
    wanted = [(s, y) for s in sorted(set(stations)) for y in range(first_year, now + 1)]
    todo = [(s, y) for s, y in wanted if y == now or (s, y) not in have]
    if not todo:
        return {"years": len(wanted), "fetched": 0, "failed": 0, "skipped": len(wanted), "dropped": 0}
    rows = spark.read.format(source.name()).option("base", base).option("workers", workers).option("turns_token", str(turns(spark, api.MIN_INTERVAL))).option("years", ",".join(f"{s}/{y}" for s, y in todo)).load().persist()
    rows.write.partitionBy("station_icao", "year").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    told = rows.where("valid is null and dropped is not null").agg(F.count("*").alias("n"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped")).first()
    rows.unpersist()
    return {"years": len(wanted), "fetched": told.n, "failed": len(todo) - told.n, "skipped": len(wanted) - len(todo), "dropped": told.dropped}


def load_reports(store: Store, stations: list[str] | None = None) -> DataFrame:
    """Raw reports (station_icao, valid, metar) of the stored station-years; other stations' partitions aren't read."""
    rows = store.spark.read.schema("valid string, metar string, dropped int, station_icao string, year int").parquet(f"{store.root}/reports").where("valid is not null")
    rows = rows if stations is None else rows.where(F.col("station_icao").isin(stations))
    return rows.select("station_icao", "valid", "metar")


def fetch_stations(client: api.Client, base: str, zones: str, wanted: list[str]) -> list[dict]:
    """Metadata of stations by id, with the time zone of their place from a second service; an error for an unknown one. A row a station: few."""
    found = {s["icaoId"]: s for s in client.get_json(base, {"ids": ",".join(sorted(wanted)), "format": "json"})}
    if unknown := sorted(set(wanted) - found.keys()):
        raise ValueError(f"unknown stations: {', '.join(unknown)}")
    zone = lambda s: client.get_json(zones, {"latitude": s["lat"], "longitude": s["lon"], "timezone": "auto", "forecast_days": 1, "daily": "temperature_2m_max"})["timezone"]
    return [{"station_icao": k, "name": s["site"], "country": s["country"], "lat": float(s["lat"]), "lon": float(s["lon"]), "elev_m": float(s["elev"]), "tz": zone(s)} for k, s in sorted(found.items())]
