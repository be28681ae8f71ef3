"""The steps of the daily-temperature study on a store, each from the tables of earlier ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsframe.functions.exprs import parse_duration
from oddsframe.operators import backtest
from oddsframe.schemas import RAW_EVENT
from oddsframe.sources import api, crawl
from oddsframe.sources.markets import markets_frame
from oddsframe.sources.pace import turns
from oddsframe.weather import features, model, observations, rules

STATION = "station_icao string, name string, country string, lat double, lon double, elev_m double, tz string"
#: The first year of reports that is fetched by default.
FIRST_YEAR = 2021
ABOUT = ["city", "description", "resolutionSource", "eventDate"]


def run_step(study) -> None:
    STEPS[study.args.step](study)


def _table(study, name: str) -> DataFrame:
    return study.read(f"weather/{name}", f"weather {name}")


def _keep(study, df: DataFrame, name: str) -> DataFrame:
    return study.keep(df, f"weather/{name}")


def _ruled(study) -> DataFrame:
    """The stored markets of the study with their rules."""
    return rules.load(study.store.load_markets(), _table(study, "rules"))


#: How the series of the study are named: a city and this.
SERIES = "-daily-weather"


def markets(study) -> None:
    """Events from files, or those of every series of the study from the service, a partition a series."""
    a, extra = study.args, "".join(f", {c} string" for c in ABOUT)
    if a.json:
        events = study.spark.read.schema(RAW_EVENT + extra).json(a.json)
    else:
        city = {s["id"]: s["slug"].removesuffix(SERIES) for s in api.list_series(api.Client("events"), study.service()) if (s.get("slug") or "").endswith(SERIES)}
        study.spark.dataSource.register(crawl.EventCrawl)
        crawled = study.spark.read.format("market_events").option("base", a.base).option("series", ",".join(city)).option("workers", a.workers).option("turns_token", str(turns(study.spark, api.MIN_INTERVAL))).load()
        names = F.create_map(*[F.lit(x) for kv in city.items() for x in kv]) if city else F.create_map().cast("map<string,string>")
        events = crawled.select(F.from_json("event", RAW_EVENT + extra).alias("e"), names[F.col("window")].alias("__city")).select("e.*", "__city").withColumn("city", F.coalesce("__city", "city")).drop("__city")
    found, failures = rules.weather_frame(events)
    study.store.save_markets(markets_frame(events.drop(*ABOUT)))
    _keep(study, found, "rules")
    failures.show(50, False)


def stations(study) -> None:
    """From a table with a header, or from the services, for the stations named or those of the rules."""
    a = study.args
    if a.csv:
        _keep(study, study.spark.read.csv(a.csv, header=True, schema=STATION), "stations")
        return
    wanted = a.stations or [r[0] for r in _table(study, "rules").select("station_icao").where("station_icao is not null").distinct().collect()]
    rows = crawl.fetch_stations(api.Client("observations"), study.service(), a.zones, wanted)
    _keep(study, study.spark.createDataFrame([tuple(r.values()) for r in rows], STATION), "stations")


def known_stations(table: DataFrame, wanted: list[str]) -> DataFrame:
    """The stations of these ids; an error for an id that isn't known."""
    found = table.where(F.col("station_icao").isin(wanted))
    if unknown := sorted(set(wanted) - {r.station_icao for r in found.select("station_icao").collect()}):
        raise SystemExit(f"unknown stations: {', '.join(unknown)}")
    return found


def metar(study) -> None:
    """Reports from files, or station-years from the service (those that the store lacks, and the current year)."""
    a, table = study.args, _table(study, "stations")
    if a.csv:
        files = dict(x.split("=", 1) for x in a.csv)
        known_stations(table, list(files))
        raw = reduce(DataFrame.unionByName, [observations.read_raw(study.spark, path, icao) for icao, path in files.items()])
    else:
        wanted = [r[0] for r in (known_stations(table, a.stations) if a.stations else table).select("station_icao").collect()]
        print(crawl.download_station_years(study.store, wanted, study.service(), a.start.year if a.start else FIRST_YEAR, workers=a.workers))
        raw = crawl.load_reports(study.store, wanted)
    _keep(study, observations.decode(raw), "obs")


def forecasts(study) -> None:
    _keep(study, features.build_runs(study.spark, study.args.runs), "runs")


def download(study) -> None:
    print(study.download(_ruled(study).where(rules.settleable() & F.col("closed")), study.args.step))


def settlement(study) -> None:
    daily = _keep(study, observations.build_daily(_table(study, "obs"), _table(study, "stations")), "daily")
    told = observations.validate(_ruled(study), daily).where("has_obs and not incident")
    told.groupBy("unit", "source").agg(F.count("*").alias("events"), F.avg(F.col("ok").cast("double")).alias("reproduced")).show()


def _context(study) -> features.Context:
    return features.make_context(*[_table(study, name) for name in ("stations", "obs", "daily", "runs")])


def fit(study) -> None:
    ctx = _context(study)
    grid = _keep(study, model.features_for(model.training_queries(ctx.truth, ctx.stations, model.MIN_DATE), ctx, True), "grid")
    model.fit_walk_forward(ctx, grid=grid).save(study.at("weather/fits"))


def _panel(study, triggers: bool):
    """(panel, split) of the model on the stations that settle reliably before the split."""
    wx = _ruled(study).where(rules.settleable())
    middle = F.expr("date_from_unix_date(cast(percentile_approx(unix_date(local_date), 0.5) as int))")
    split = study.args.split or wx.agg(middle).first()[0]
    reliable = observations.reliable_stations(observations.validate(_ruled(study), _table(study, "daily")), split)
    forecaster = model.WeatherModel(_context(study), model.Fits.load(study.spark, study.at("weather/fits")), wx, parse_duration(study.args.obs_lag), reliable, triggers)
    asked = study.store.load_markets().join(wx.select("market_id"), "market_id", "left_semi")
    return backtest.build_panel(asked, study.store.load_prices(asked), study.store.load_trades(asked), forecaster), split


def evaluate(study) -> None:
    from oddsframe.cli import Reports

    panel = _keep(study, _panel(study, False)[0], "panel")
    told = [df.withColumn("model", F.lit(name)) for name, df in model.evaluation(panel).items()]
    Reports(study.args.reports, "weather").table(reduce(DataFrame.unionByName, told), "logloss_by_horizon")


def trade(study) -> None:
    panel, split = _panel(study, True)
    name = "_".join(filter(None, [f"weather_lag{study.args.obs_lag}", study.args.band_cost]))
    study.report(panel, backtest.SimConfig(cost=study.args.cost), split, name, breakdowns=("trigger", "hgroup", "city", "side"))


STEPS = {"markets": markets, "stations": stations, "prices": download, "trades": download, "metar": metar, "settlement": settlement, "forecasts": forecasts, "fit": fit, "eval": evaluate, "backtest": trade}
