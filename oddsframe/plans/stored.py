"""Queries whose rows go through the store, the loaders, whole features and fits, each with its SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsframe.operators import stats
from oddsframe.plans.core import _scored, query, r6
from oddsframe.plans.more import _DAILY, _LL, _asked, _daily
from oddsframe.plans.views import Tables
from oddsframe.plugins import load_model
from oddsframe.sources.store import Store
from oddsframe.weather import emos, features, model, observations, rules


def new_store(spark: SparkSession) -> Store:
    """An empty store in the folder that the cluster shares; without one, a local run makes its own, which goes with the process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="oddsframe-store-")
        atexit.register(shutil.rmtree, root, True)
    return Store(spark, f"{root.rstrip('/')}/store-{uuid.uuid4().hex}")


def _event() -> Column:
    return F.floor(F.col("market_id") / 3).cast("string").alias("event_id")


def _prices(t: Tables) -> DataFrame:
    return t.mids.select(_event(), F.col("market_id").cast("string").alias("market_id"), F.col("ts").cast("timestamp").alias("ts"), "p")


@query("select cast(cast(floor(market_id / 3) as bigint) as varchar) as event_id, cast(market_id as varchar) as market_id, ts, p from mids where cast(floor(market_id / 3) as bigint) in (select event_id from markets where category = 'c1')", "mids", "markets")
def stored_prices(t: Tables) -> DataFrame:
    """Prices of the events of one category, from a store that holds all."""
    store = new_store(t.spark)
    store.append("prices", _prices(t))
    wanted = t.markets.where("category = 'c1'").select(F.col("event_id").cast("string").alias("event_id"))
    return store.load_prices(wanted).select("event_id", "market_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "p")


@query("select cast(market_id as varchar) as market_id, ts, round(px0, 6) as px0, buys0, round(usd, 6) as usd from trades", "trades")
def stored_trades(t: Tables) -> DataFrame:
    """All trades from the store, in terms of the first outcome."""
    store = new_store(t.spark)
    raw = t.raw_trades.select(_event(), F.col("market_id").cast("string").alias("market_id"), F.col("ts").cast("timestamp").alias("ts"), "side", F.col("outcome_index").cast("int").alias("outcome_index"), "price", "size", F.lit("x").alias("tx"), F.lit(False).alias("truncated"))
    store.append("trades", raw)
    return r6(store.load_trades().select("market_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "px0", "buys0", "usd"), "px0", "usd")


@query(
    """, b as (select market_id, event_id, fee_rate, 0 as batch from markets where market_id % 2 = 0 or market_id % 3 = 0 union all select market_id, event_id, fee_rate + 1, 1 from markets where market_id % 2 = 1
               union all select market_id, event_id + 1, fee_rate + 2, 2 from markets where market_id % 50 = 0),
    l as (select *, row_number() over (partition by market_id order by batch desc) as rn from b) select market_id, event_id, fee_rate, cast(count(*) over (partition by event_id) as int) as markets_in_event from l where rn = 1""",
    "markets",
)
def stored_markets(t: Tables) -> DataFrame:
    """Markets saved in three batches, of which the last moves some to another event."""
    store, k = new_store(t.spark), F.col("market_id")
    ended = {"closed_ts": F.col("end_ts"), "uma_end_ts": F.col("end_ts")}
    m = t.markets.withColumns(ended | {"n_outcomes": F.lit(2), "closed": F.lit(True), "disputed": F.lit(False), "archived_copy": F.lit(False)}).drop("clean", "known_ts")
    store.save_markets(m.where((k % 2 == 0) | (k % 3 == 0)))
    store.save_markets(m.where(k % 2 == 1).withColumn("fee_rate", F.col("fee_rate") + 1))
    moved = m.where(k % 50 == 0).withColumns({"fee_rate": F.col("fee_rate") + 2, "event_id": F.col("event_id") + 1})
    return store.save_markets(moved).select("market_id", "event_id", "fee_rate", "markets_in_event")


@query(
    """, e as (select cast(floor(market_id / 3) as bigint) as event_id, count(*) as n, max(p) as p from mids group by 1)
    select cast(event_id as varchar) as event_id, event_id % 7 <> 3 as ok, case when event_id % 7 not in (2, 3) then n else 0 end as n_rows, case when event_id % 7 not in (2, 3) then p end as highest from e""",
    "mids",
)
def download_ledger(t: Tables) -> DataFrame:
    """A download of every event's prices, of which some fail and some have none: what the ledger says, beside what is stored."""
    store = new_store(t.spark)

    def fetch(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["event_id"].iloc[0]) % 7
        if k == 3:
            raise ValueError("no answer")
        return pdf.iloc[:0] if k == 2 else pdf

    store.download("prices", _prices(t), fetch)
    stored = store.load_prices().groupBy("event_id").agg(F.max("p").alias("highest"))
    return store.ledger().select("event_id", "ok", "n_rows").join(stored, "event_id", "left")


@query(
    """, d as (select distinct station_icao, strftime(ts, '%Y-%m-%d %H:%M') as valid, metar, event_id % 40 as c, event_id % 3 as neg from reports), m as (select station_icao, right(valid, 2) as minute, count(*) as n from d group by 1, 2),
    s as (select *, n >= 0.2 * sum(n) over (partition by station_icao) as often from m)
    select d.station_icao, strptime(d.valid, '%Y-%m-%d %H:%M') as obs_time, d.metar, cast(case when neg = 0 then -c else c end as double) + 0.0 as temp_c, s.often as is_routine from d join s on s.station_icao = d.station_icao and s.minute = right(d.valid, 2)""",
    "reports",
)
def decode(t: Tables) -> DataFrame:
    """Raw reports with their times as text, decoded; equal ones once."""
    raw = t.reports.select("station_icao", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("valid"), "metar")
    out = observations.decode(raw)
    return out.select("station_icao", F.col("obs_time").cast("timestamp_ntz").alias("obs_time"), "metar", (F.col("temp_c") + 0.0).alias("temp_c"), "is_routine")


@query("select event_id from events where event_id % 5 <> 0 and event_id % 4 in (0, 1) and event_id % 7 <> 0 and event_id % 3 = 1")
def settleable(t: Tables) -> DataFrame:
    """Markets that reports settle: a station, a source, no copy, opened before the day; an unknown opening counts as late."""
    k = F.col("event_id")
    rows = t.events.select(
        "event_id", F.when(k % 5 != 0, "KLGA").alias("station_icao"), F.when(k % 4 == 0, "wu").when(k % 4 == 1, "noaa").otherwise("hko").alias("source"), (k % 7 == 0).alias("archived_copy"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("opened_after_day_start"),
    )
    return rows.where(rules.settleable()).select("event_id")


@query("select market_id, decision_time, round(1 / (1 + exp(-1.3 * ln(p / (1 - p)))), 6) as p_model from panel", "panel")
def loaded_model(t: Tables) -> DataFrame:
    """A model named as text."""
    return r6(load_model("oddsframe.plugins:LogitSharpen").predict(t.panel).select("market_id", "decision_time", "p_model"), "p_model")


@query(
    f""", {_DAILY}, b as (select *, fc_max + case when model = 'gfs_050' then 0.5 else 0 end as corr from c where rn = 1),
    w as (select q.station_icao, q.local_date, max(case when model = 'ecmwf_ifs025' then corr end) as ec, max(case when model = 'gfs_050' then corr end) as gfs from q left join b on b.station_icao = q.station_icao and b.local_date = q.local_date group by 1, 2)
    select station_icao, local_date, round(case when ec is null then gfs when gfs is null then ec else (ec + gfs) / 2 end, 6) as ens_mean, round(ec - gfs, 6) as ec_minus_gfs, round(abs(ec - gfs) / sqrt(2.0), 6) as ens_sd, cast(0 as bigint) as obs_n,
           cast(case when extract(day from local_date) % 2 = 0 then extract(day from local_date) end as double) as y_c, cast(67.0 as double) as hours_to_eod from w""",
    "runs",
)
def build_features(t: Tables) -> DataFrame:
    """All features of a decision 43 hours before each day that has a forecast, in a zone without clock changes: the ensemble, reports (none yet), target and horizon."""
    daily = _daily(t)
    steps = daily.select("station_icao", "model", "init_time", "local_date", (F.col("local_date").cast("timestamp") + F.expr("interval 12 hours")).alias("valid_time"), (F.col("fc_max") - 1).alias("temp_c"))
    bias = daily.select("station_icao", "model", "local_date").distinct().where("model = 'gfs_050'").withColumns({"bias": F.lit(0.5), "mse": F.lit(1.0)})
    asked = _asked(t)
    stations = asked.select("station_icao").distinct().withColumn("tz", F.lit("UTC"))
    obs = t.spark.createDataFrame([], "station_icao string, local_date date, obs_time timestamp, local_time timestamp_ntz, temp_c double, temp_c_precise double, is_routine boolean, metar string")
    day = F.dayofmonth("local_date")
    truth = asked.select("station_icao", "local_date").where(day % 2 == 0).withColumns({"y_c": day.cast("double"), "y_halfwidth": F.lit(0.5)})
    ctx = features.Context(stations, obs, truth, daily, steps, bias, t.spark.createDataFrame([], "station_icao string, local_date date, h int, rise double, peak_hour int, month int"))
    out = features.build_features(asked, ctx)
    return out.select("station_icao", "local_date", *[F.round(c, 6).alias(c) for c in ("ens_mean", "ec_minus_gfs", "ens_sd")], F.coalesce("obs_n", F.lit(0)).cast("long").alias("obs_n"), "y_c", F.round(F.col("hours_to_eod").cast("double"), 6).alias("hours_to_eod"))


_TRAIN = "select cast(ts as date) as day, value / 10 as x, 1.5 + 0.8 * value / 10 + (event_id * 37 % 100) / 50.0 as y, user_id % 2 as kind from events"


def _grid(t: Tables) -> DataFrame:
    """Training rows with one regressor, targets known almost exactly: fits then are least squares."""
    k, x = F.col("event_id"), F.col("value") / 10
    return t.events.select(
        F.concat(F.lit("S"), F.col("user_id") % 9).alias("station_icao"), F.to_date("ts").alias("local_date"), F.col("ts").cast("timestamp").alias("decision_time"), x.alias("ens_mean"), (1.5 + 0.8 * x + (k * 37 % 100) / 50.0).alias("y_c"),
        F.lit(0.001).alias("y_halfwidth"), F.when(F.col("user_id") % 2 == 0, "pre_24").otherwise("pre_36").alias("hbin"), F.lit(None).cast("double").alias("local_hour"), x.alias("fc_max_ecmwf_ifs025"),
    )


def _line(fits: DataFrame) -> DataFrame:
    p = lambda k: F.col("params")[k]
    spread = F.exp(p(3) + p(4) * F.log(F.lit(1.3)) + p(5) * F.log(F.lit(emos.ERROR_MISSING + 0.3)) + p(6))
    return fits.select("fit_month", "hbin", F.round(p(0), 3).alias("level"), F.round(p(1), 4).alias("slope"), F.round(spread, 3).alias("spread"), "n_train")


@query(
    f"""with r as ({_TRAIN}) select date '2024-02-01' as fit_month, case kind when 0 then 'pre_24' else 'pre_36' end as hbin, round(regr_intercept(y, x), 3) as level, round(regr_slope(y, x), 4) as slope,
        round(sqrt(regr_syy(y, x) / count(*) * (1 - regr_r2(y, x))), 3) as spread, count(*) as n_train from r group by kind"""
)
def emos_fit(t: Tables) -> DataFrame:
    """Interval-censored fits of two bins where they have a closed form."""
    return _line(emos.fit_all(_grid(t).withColumn("fit_month", F.lit("2024-02-01").cast("date"))))


@query(
    f"""with r as ({_TRAIN}), m as (select unnest([date '2024-01-01', date '2024-02-01']) as fit_month)
    select fit_month, case kind when 0 then 'pre_24' else 'pre_36' end as hbin, round(regr_intercept(y, x), 3) as level, round(regr_slope(y, x), 4) as slope,
        round(sqrt(regr_syy(y, x) / count(*) * (1 - regr_r2(y, x))), 3) as spread, count(*) as n_train from m join r on r.day - interval 14 day < fit_month - 4 group by 1, kind having count(*) >= 300"""
)
def walk_forward_fits(t: Tables) -> DataFrame:
    """Fits by month, each on the days before it less the gap; the days are set back by two weeks, so that they lie in two months."""
    grid = _grid(t).withColumn("local_date", F.date_sub("local_date", 14))
    profile = t.spark.createDataFrame([], "station_icao string, local_date date, h int, rise double, peak_hour int, month int")
    fits = model.fit_walk_forward(features.Context(*[None] * 6, profile), date(2024, 1, 1), date(2023, 1, 1), grid.unionByName(grid.limit(1).withColumns({"local_date": F.lit("2024-02-01").cast("date"), "hbin": F.lit(None).cast("string")})))
    return _line(fits.bins)


@query(
    f""", a as (select event_id, market_id, category, decision_time, neg_risk, winner, p, case when neg_risk then p / sum(p) over w else p end as q, least(greatest(p * p + 0.1, 0.01), 0.99) as m0 from daily where p is not null window w as (partition by event_id, decision_time)),
    n as (select *, case when neg_risk then greatest(m0, 0.0001) / sum(greatest(m0, 0.0001)) over (partition by event_id, decision_time) else m0 end as m from a),
    l as (select *, cast(decision_time as date) as day, 1.0 as one, case when neg_risk then {_LL.format(x='q')} when winner = 0 then {_LL.format(x='p')} else {_LL.format(x='1 - p')} end as a, case when neg_risk or winner = 0 then {_LL.format(x='m')} else {_LL.format(x='1 - m')} end as b from n where not neg_risk or winner = 0),
    d as (select category, day, one, b - a as diff from l), g as (select category as "group", count(*) as n, count(distinct event_id) as events, round(avg(b), 6) as ll_model from l group by 1),
    i as ({stats.block_ci_sql('d', 'diff', 'one', 'day', ['category'], 300)})
    select g.*, round(i.point, 6) as model_minus_market, round(i.lo, 6) as ci_lo, round(i.hi, 6) as ci_hi from g join i on i.category = g."group" """,
    "daily",
)
def study_evaluation(t: Tables) -> DataFrame:
    """The study's evaluation of a model's probabilities, normalised within events, by horizon."""
    panel = _scored(t).withColumns({"hgroup": F.col("category"), "day": F.to_date("decision_time")})
    out = model.evaluation(panel, ("p_model",), 300)["p_model"]
    return r6(out.select("group", "n", "events", "ll_model", "model_minus_market", "ci_lo", "ci_hi"), "ll_model", "model_minus_market", "ci_lo", "ci_hi")
