"""Crawls with a made transport: windows, cursors, restarts; station-years with throttling, dropped lines, retries."""

import json
from datetime import date
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from oddsframe.sources import api, crawl
from oddsframe.sources.store import Store


def events_source(folder):
    """Two pages in January, one in each later month. What is asked is told in a file."""

    class Made(crawl.EventCrawl):
        @staticmethod
        def transport(url):
            q = parse_qs(urlparse(url).query)
            with open(f"{folder}/asked", "a") as f:
                f.write(url + "\n")
            if "series_id" in q:
                return json.dumps([{"id": f"{q['series_id'][0]}-{k}", "markets": []} for k in range(2)] if q["offset"] == ["0"] else [])
            start, more = q["end_date_min"][0], "after_cursor" in q
            return json.dumps({"events": [{"id": f"{start}{'b' if more else 'a'}", "slug": "s", "title": "t", "markets": []}], "next_cursor": "c" if start == "2026-01-01" and not more else None})

        @classmethod
        def name(cls):
            return "made_events"

    return Made


def asked(folder):
    return [parse_qs(urlparse(u).query) for u in (folder / "asked").read_text().splitlines()]


def test_crawl_reads_windows_side_by_side(spark, tmp_path):
    spark.dataSource.register(events_source(tmp_path))
    df = spark.read.format("made_events").option("base", "http://x").option("since", "2026-01-01").option("until", "2026-03-15").option("tag", "politics").load()
    assert df.rdd.getNumPartitions() == 3
    assert sorted(r.id for r in crawl.raw_events(df).collect()) == ["2026-01-01a", "2026-01-01b", "2026-02-01a", "2026-03-04a"]
    assert all(q["tag_slug"] == ["politics"] and q["closed"] == ["true"] for q in asked(tmp_path))
    assert spark.read.format("made_events").option("base", "http://x").option("since", "2026-01-01").option("until", "2026-01-01").load().count() == 0
    series = spark.read.format("made_events").option("base", "http://x").option("series", "7,9").load()
    assert sorted(r.id for r in crawl.raw_events(series).collect()) == ["7-0", "7-1", "9-0", "9-1"]


def test_a_crawl_as_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    spark.dataSource.register(events_source(tmp_path))

    def run(until):
        df = spark.readStream.format("made_events").option("base", "http://x").option("since", "2026-01-01").option("until", until).load()
        q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run("2026-02-10")
    assert sorted(r.window for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["2026-01-01", "2026-01-01"]
    n = len(asked(tmp_path))
    run("2026-03-20")
    assert [q["end_date_min"] for q in asked(tmp_path)[n:]] == [["2026-02-01"]]  # windows that are over alone, none twice
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def reports_source(folder):
    class Made(crawl.StationYears):
        sleep = staticmethod(lambda s: None)

        @staticmethod
        def transport(url):
            q = parse_qs(urlparse(url).query)
            station, year = q["station"][0], q["year1"][0]
            with open(f"{folder}/asked", "a") as f:
                f.write(f"{station}/{year}\n")
            times = (folder / "asked").read_text().count(f"{station}/{year}")
            if station == "DOWN":
                raise OSError("no answer")
            if station == "SLOW" and times < 3:
                return "Too many requests, please wait"
            return f"station,valid,metar\n{station},{year}-01-01 00:50,{station} 010050Z 05/01\n{station},{year}-01-01 01:50,a,b\n{station},{year}-01-02 00:50,\"{station}, AUTO 06/01\"\n"

        @classmethod
        def name(cls):
            return "made_years"

    return Made


def test_station_years_are_fetched_once_but_for_the_current_one(spark, tmp_path):
    store, source = Store(spark, f"{tmp_path}/s"), reports_source(tmp_path)
    fetch = lambda **o: crawl.download_station_years(store, ["EDDM", "SLOW", "DOWN"], "http://x", 2024, date(2025, 6, 1), source=source, **o)
    assert fetch() == {"years": 6, "fetched": 4, "failed": 2, "skipped": 0, "dropped": 4}
    n = len((tmp_path / "asked").read_text().split())
    assert fetch(workers=2) == {"years": 6, "fetched": 2, "failed": 2, "skipped": 2, "dropped": 2}
    again = (tmp_path / "asked").read_text().split()[n:]
    assert sorted(set(again)) == ["DOWN/2024", "DOWN/2025", "EDDM/2025", "SLOW/2025"]
    rows = crawl.load_reports(store)
    assert rows.count() == 8 and rows.where("station_icao = 'SLOW'").count() == 4  # the year that came again took its place
    assert crawl.load_reports(store, ["EDDM"]).where(F.col("metar").contains(", AUTO")).count() == 2
    assert sorted(map(tuple, store.partitions("reports", ["station_icao", "year"]).collect())) == [("EDDM", "2024"), ("EDDM", "2025"), ("SLOW", "2024"), ("SLOW", "2025")]


def test_station_metadata(tmp_path):
    def transport(url):
        if "latitude" in url:
            return json.dumps({"timezone": "Europe/Berlin"})
        return json.dumps([{"icaoId": "EDDM", "site": "Munich", "country": "DE", "lat": 48.35, "lon": 11.78, "elev": 453}])

    client = api.Client("observations", transport=transport, sleep=lambda s: None)
    assert crawl.fetch_stations(client, "http://a", "http://z", ["EDDM"]) == [{"station_icao": "EDDM", "name": "Munich", "country": "DE", "lat": 48.35, "lon": 11.78, "elev_m": 453.0, "tz": "Europe/Berlin"}]
    with pytest.raises(ValueError, match="XXXX"):
        crawl.fetch_stations(client, "http://a", "http://z", ["EDDM", "XXXX"])


def test_resuming_reads_the_ledger_alone(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    todo = spark.createDataFrame([(f"e/{k}", "a") for k in range(4)], "event_id string, market_id string")

    def fetch(pdf):
        import pandas as pd

        if pdf["event_id"].iloc[0] == "e/3":
            raise ValueError("down")
        return pd.DataFrame({"market_id": ["a"], "ts": [pd.Timestamp("2026-01-01", tz="UTC")], "p": [0.5]})

    assert store.download("prices", todo, fetch)["failed"] == 1
    assert store.download("prices", todo, fetch)["skipped"] == 3
    tries = {r.event_id: (r.n, r.good) for r in store.ledger().groupBy("event_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("good")).collect()}
    assert tries == {"e/0": (1, 1), "e/1": (1, 1), "e/2": (1, 1), "e/3": (2, 0)}
    files = store.stored_event_ids("prices").inputFiles()
    assert files and all("/ledger/" in f for f in files)
    assert sorted(r.event_id for r in store.partitions("prices", ["event_id"]).collect()) == ["e/0", "e/1", "e/2"]
    # an event that was stored by a writer that died before its entry is fetched again and isn't doubled
    spark.createDataFrame([("e/3", "a", None, 0.1)], "event_id string, market_id string, ts timestamp, p double").selectExpr("event_id", "market_id", "timestamp '2026-01-01' as ts", "p").write.mode("append").partitionBy("event_id").parquet(f"{tmp_path}/s/prices")
    assert store.download("prices", todo, lambda pdf: fetch(pdf.assign(event_id="e/0")))["fetched"] == 1
    assert [r.p for r in store.load_prices(["e/3"]).collect()] == [0.5]
