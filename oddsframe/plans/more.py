"""Further queries: whole protocols, observation and forecast features, rules and downloads, each with its SQL."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsframe.operators import backtest as B
from oddsframe.operators import execution as E
from oddsframe.operators import scan, snapshots, stats
from oddsframe.plans.core import _ORDERS, _ROI, _SIM, DAYS, _made_costs, _scored, query, r6
from oddsframe.plans.domain import _OBS, _obs, _stations
from oddsframe.plans.views import Tables
from oddsframe.plugins import LogitSharpen, without_outcomes
from oddsframe.sources import markets as M
from oddsframe.sources.store import complete_events
from oddsframe.weather import emos, features, model, observations, rules

# ---- calibration and backtest protocols


@query(
    f"""{_ROI}, x2 as (select * from x where events >= 10), k as (select *, row_number() over (order by pval) as rk, count(*) over () as m from x2), cut as (select max(case when pval * m / rk <= 0.25 then rk end) as top from k)
    select category, band, snapshot, cast(n as bigint) as n, events, coalesce(rk <= top, false) as bh_pass, side, round(cost, 6) as cost,
           round((win - exec_price - fee_rate_mean * exec_price * (1 - exec_price)) / (exec_price + fee_rate_mean * exec_price * (1 - exec_price)), 6) as exp_roi from k cross join cut""",
    "cells_in",
)
def discover(t: Tables) -> DataFrame:
    """Cells, false discovery control and expected return together."""
    cells = scan.discover(t.cells_in.withColumn("split", F.lit("discovery")), _made_costs(t), min_events=10, q=0.25)[0]
    return r6(cells.select("category", "band", "snapshot", "n", "events", "bh_pass", "side", "cost", "exp_roi"), "cost", "exp_roi")


@query(
    """, c as (select band, event_id, sum(y - p) as r, count(*) as n, sum(p) as ps, sum(y) as ys from cells_in group by 1, 2), g as (select band, sum(n) as n, count(*) as events, sum(ps) / sum(n) as p_mean, sum(ys) / sum(n) as freq from c group by 1),
    h as (select g.band, sum(power(c.r - (g.freq - g.p_mean) * c.n, 2)) as u from g join c on c.band = g.band group by 1)
    select g.band, cast(g.n as bigint) as n, events, round(p_mean, 6) as p_mean, round(freq, 6) as freq, round(sqrt(events / (events - 1.0) * u) / g.n, 6) as se from g join h on h.band = g.band""",
    "cells_in",
)
def summary_by_band(t: Tables) -> DataFrame:
    out = scan.summary_by_band(t.cells_in.withColumn("split", F.lit("discovery")))
    return r6(out.select("band", "n", "events", "p_mean", "freq", "se"), "p_mean", "freq", "se")


_LL = "-ln(least(greatest({x}, 0.0001), 1.0))"
_LOSSES = f""", n as (select event_id, market_id, category, decision_time, neg_risk, winner, p, case when neg_risk then p / sum(p) over (partition by event_id, decision_time) else p end as q, least(greatest(p * p + 0.1, 0.01), 0.99) as m from daily where p is not null),
    l as (select *, case when neg_risk then {_LL.format(x='q')} when winner = 0 then {_LL.format(x='p')} else {_LL.format(x='1 - p')} end as a, case when neg_risk or winner = 0 then {_LL.format(x='m')} else {_LL.format(x='1 - m')} end as b from n where not neg_risk or winner = 0)"""


@query(f"""{_LOSSES} select category as "group", count(*) as n, count(distinct event_id) as events, round(avg(a), 6) as ll_market, round(avg(b), 6) as ll_model, round(avg(b - a), 6) as model_minus_market from l group by 1""", "daily")
def head_to_head_means(t: Tables) -> DataFrame:
    """All but the random intervals."""
    out = stats.head_to_head(stats.outcome_losses(_scored(t)).withColumn("block", F.to_date("decision_time")), "category", "block", 20)
    return r6(out.select("group", "n", "events", "ll_market", "ll_model", "model_minus_market"), "ll_market", "ll_model", "model_minus_market")


@query(
    f"""{_LOSSES}, d as (select category, cast(decision_time as date) as day, b - a as diff, 1.0 as one from l),
    g as (select category as "group", count(*) as n, count(distinct event_id) as events, round(avg(a), 6) as ll_market, round(avg(b), 6) as ll_model from l group by 1),
    i as ({stats.block_ci_sql('d', 'diff', 'one', 'day', ['category'], 400)})
    select g.*, round(i.point, 6) as model_minus_market, round(i.lo, 6) as ci_lo, round(i.hi, 6) as ci_hi from g join i on i.category = g."group" """,
    "daily",
)
def head_to_head(t: Tables) -> DataFrame:
    """Mean losses by category with intervals from resampled days."""
    out = stats.head_to_head(stats.outcome_losses(_scored(t)).withColumn("block", F.to_date("decision_time")), "category", "block", 400)
    return r6(out, "ll_market", "ll_model", "model_minus_market", "ci_lo", "ci_hi")


@query(
    f""", {_SIM}, i as ({stats.block_ci_sql('trades_', 'pnl', None, 'day', [])}), j as ({stats.block_ci_sql('trades_', 'pnl', 'spend', 'day', [])})
    select 'pnl' as what, round(point, 4) as point, round(lo, 4) as lo, round(hi, 4) as hi from i union all select 'roi', round(point, 4), round(lo, 4), round(hi, 4) from j""",
    "panel",
)
def bootstrap_roi(t: Tables) -> DataFrame:
    out = B.bootstrap(B.simulate(t.panel))
    return out.select("what", *[F.round(c, 4).alias(c) for c in ("point", "lo", "hi")])


@query(f", {_SIM} select 'pnl' as what, round(sum(pnl), 4) as point from trades_ union all select 'roi', round(sum(pnl) / sum(spend), 4) from trades_", "panel")
def bootstrap_points(t: Tables) -> DataFrame:
    return B.bootstrap(B.simulate(t.panel)).select("what", F.round("point", 4).alias("point"))


_KELLY = _SIM.replace("least(20.0 / cps, 0.1 * vol_window) as shares", "least(least(greatest(least(greatest(edge / (1 - cps), 0), 1) * 0.15 * 10000, 0), 200) / cps, 0.1 * vol_window) as shares")


@query(f", {_KELLY} select market_id, side, decision_time, round(shares, 6) as shares, round(spend, 6) as spend, round(pnl, 6) as pnl from trades_", "panel")
def simulate_kelly(t: Tables) -> DataFrame:
    out = B.simulate(t.panel, B.SimConfig(sizing="kelly"))
    return r6(out.select("market_id", "side", "decision_time", "shares", "spend", "pnl"), "shares", "spend", "pnl")


@query(f", {_ORDERS.replace('case when fees_enabled then', 'case when true then')} select market_id, decision_time, side, round(fee, 8) as fee from c", "panel")
def orders_fee_everywhere(t: Tables) -> DataFrame:
    return B.candidate_orders(t.panel, B.SimConfig(fee_everywhere=True)).select("market_id", "decision_time", "side", F.round("fee", 8).alias("fee"))


_GRID_SIM = """cfg as (select * from (values (0.02), (0.05), (0.10), (0.20)) t(threshold)),
    o as (select panel.*, threshold, 'YES' as side, p_model as p_win, p + 0.03 as price from panel cross join cfg union all select panel.*, threshold, 'NO', 1 - p_model, 1 - p + 0.03 from panel cross join cfg),
    f as (select *, case when fees_enabled then fee_rate * power(price * (1 - price), fee_exponent) else 0 end as fee from o where price between 0.01 and 0.99), c as (select *, price + fee as cps, p_win - price - fee as edge from f),
    e as (select *, row_number() over (partition by threshold, market_id, side order by decision_time) as rn from c where edge > threshold and traded_near),
    q as (select *, least(20.0 / cps, 0.1 * vol_window) as shares from e where rn = 1), v as (select *, shares * cps as spend from q where shares > 0.5),
    d as (select *, sum(spend) over (partition by threshold, day order by decision_time, market_id, side rows unbounded preceding) as cum_day from v),
    g as (select threshold, count(*) as n, sum(shares * (case when (side = 'YES') = (winner = 0) then 1 else 0 end - cps)) / sum(spend) as roi from d where cum_day <= 2000 group by 1)"""


@query(f", {_GRID_SIM} select threshold::double as threshold from g order by n >= 100 desc, roi desc, threshold limit 1", "panel")
def chosen_threshold(t: Tables) -> DataFrame:
    found, _ = B.choose_threshold(t.panel, B.SimConfig(), [0.02, 0.05, 0.10, 0.20])
    return t.spark.createDataFrame([(found,)], "threshold double")


@query(
    f""", ev as (select event_id, max(day) as last from panel group by 1), ranked as (select last, row_number() over (order by last) as rn, count(*) over () as n from ev), cut as (select last as d from ranked where rn = n // 2 + 1),
    panel2 as (select p.* from panel p join ev using (event_id) cross join cut where ev.last >= cut.d), {_SIM.replace('from panel', 'from panel2')}
    select (select count(*) from ev, cut where last < d) as train_events, (select count(*) from ev, cut where last >= d) as test_events, count(*) as n_trades, round(sum(pnl), 4) as pnl, round(sum(pnl) / sum(spend), 6) as roi from trades_""",
    "panel",
)
def backtest_run(t: Tables) -> DataFrame:
    """The whole protocol with one threshold: what it reports of the test half."""
    res, _ = B.run(t.panel, B.SimConfig(), thresholds=[0.05], breakdowns=())
    main = res["test_main"]
    row = (res["train_events"], res["test_events"], main["n_trades"], round(main["pnl"], 4), round(main["roi"], 6))
    return t.spark.createDataFrame([row], "train_events long, test_events long, n_trades long, pnl double, roi double")


@query(f", {_SIM} select category, round(sum(pnl), 4) as pnl from trades_ group by category order by sum(pnl) desc limit 3", "panel")
def best_categories(t: Tables) -> DataFrame:
    """A top-k report: sorted, then cut."""
    return B.breakdown(B.simulate(t.panel), "category").limit(3).select("category", F.round("pnl", 4).alias("pnl"))


@query(f", {_GRID_SIM} select round(max(case when threshold = 0.02 then roi end), 6) as t2, round(max(case when threshold = 0.2 then roi end), 6) as t20 from g", "panel")
def heatmap_cells(t: Tables) -> DataFrame:
    wide = B.heatmap(B.sweep(t.panel, B.SimConfig(), [0.02, 0.2], [0.03]))
    return wide.agg(F.round(F.max(F.when(F.col("threshold") == 0.02, F.col("`0.03`"))), 6).alias("t2"), F.round(F.max(F.when(F.col("threshold") == 0.2, F.col("`0.03`"))), 6).alias("t20"))


@query(
    """, d as (select event_id, market_id, decision_time, neg_risk, p * 0.5 + 0.1 as m from daily where p is not null)
    select event_id, market_id, decision_time, round(case when neg_risk then m / sum(m) over (partition by event_id, decision_time) else m end, 6) as p_model from d""",
    "daily",
)
def normalize_model(t: Tables) -> DataFrame:
    rows = t.daily.where("p is not null").select("event_id", "market_id", "decision_time", "neg_risk", (F.col("p") * 0.5 + 0.1).alias("p_model"))
    return r6(B.normalize_model(rows).drop("neg_risk"), "p_model")


_PANEL = f"""ok as (select event_id from markets group by 1 having bool_and(clean)), m as (select * from markets where event_id in (select event_id from ok)),
    e as (select event_id, min(created_ts) as a, max(known_ts) - interval 1 hour as z from m group by 1),
    g as (select event_id, make_timestamp(unnest(range((floor((epoch_us(a) + 43200000000) / 43200000000) * 43200000000)::bigint, epoch_us(z) + 1, 43200000000))) as decision_time from e),
    r as (select g.event_id, g.decision_time, m.market_id, m.neg_risk from g join m on m.event_id = g.event_id and g.decision_time >= m.created_ts and g.decision_time <= m.known_ts - interval 1 hour),
    x as (select r.*, case when r.decision_time - q.ts > interval 2 day then null else q.p end as p from r asof left join mids q on q.market_id = r.market_id and r.decision_time >= q.ts),
    w as (select *, bool_or(p is null) over k as miss, sum(p) over k as s from x window k as (partition by event_id, decision_time)),
    n as (select *, case when neg_risk and s > 0 then p / s else p end as q_market, 1 / (1 + exp(-1.3 * ln(p / (1 - p)))) as m0 from w where p is not null and not (neg_risk and miss)),
    pm as (select *, case when neg_risk then greatest(m0, 1e-4) / sum(greatest(m0, 1e-4)) over (partition by event_id, decision_time) else m0 end as p_model from n)"""


@query(
    f""", {_PANEL} select pm.event_id, pm.market_id, pm.decision_time, round(pm.q_market, 6) as q_market, round(any_value(pm.p_model), 5) as p_model, round(coalesce(sum(t.size), 0), 4) as vol_window
    from pm left join trades t on t.market_id = pm.market_id and t.ts > pm.decision_time - interval 2 day and t.ts <= pm.decision_time + interval 2 day group by 1, 2, 3, 4""",
    "markets", "mids", "trades",
)
def build_panel(t: Tables) -> DataFrame:
    """Grid, guard, as-of mids, normalisation, the model and the prints around each decision, as one plan."""
    out = B.build_panel(t.markets, t.mids, t.trades, LogitSharpen(), timedelta(hours=12), max_stale=DAYS(2), fill_window=DAYS(2))
    return out.select("event_id", "market_id", "decision_time", F.round("q_market", 6).alias("q_market"), F.round("p_model", 5).alias("p_model"), F.round("vol_window", 4).alias("vol_window"))


_HOLD = """h as (select x.*, m.end_ts as event_end, m.series_slug, m.fee_exponent, case when x.p < 0.2 then 'low' when x.p < 0.5 then 'mid' else 'high' end as b2 from cells_in x join markets m on m.market_id = x.market_id),
    f as (select 1 as cand, 'ALL' as c, 'mid' as b, 'NO' as side union all select 2, 'c1', 'low', 'YES' union all select 3, 'ALL', 'none', 'NO'),
    k as (select f.cand, f.side, h.*, case when f.side = 'YES' then p else 1 - p end + 0.02 as mid_price, case when f.side = 'YES' then y else 1 - y end as win from f join h on h.b2 = f.b and (f.c = 'ALL' or f.c = h.category))"""


def _holdout(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.cells_in.join(t.markets.select("market_id", F.col("end_ts").alias("event_end"), "series_slug", "fee_exponent"), "market_id")
    rows = rows.withColumns({"target_ts": F.col("event_end") - F.expr("interval 5 days"), "event_slug": F.col("series_slug"), "band": F.when(F.col("p") < 0.2, "low").when(F.col("p") < 0.5, "mid").otherwise("high")})
    frozen = scan.frozen_frame(t.spark, [{"category": c, "band": b, "snapshot": "ALL", "side": s} for c, b, s in (("ALL", "mid", "NO"), ("c1", "low", "YES"), ("ALL", "none", "NO"))])
    return rows, frozen


@query(f", {_HOLD} select cand, event_id, market_id, snapshot, round(p, 6) as p, round(mid_price, 6) as mid_price, cast(win as int) as win from k", "cells_in", "markets")
def candidate_rows(t: Tables) -> DataFrame:
    """Holdout rows of every frozen candidate; the events of a candidate are fewer than the sample's limit."""
    out = scan.candidate_rows(*_holdout(t), None, 10**9)
    return out.select("cand", "event_id", "market_id", "snapshot", F.round("p", 6).alias("p"), F.round("mid_price", 6).alias("mid_price"), F.col("win").cast("int").alias("win"))


@query(
    f""", {_HOLD}, v as (select *, case when fees_enabled then fee_rate * power(mid_price * (1 - mid_price), fee_exponent) else 0 end as fee from k where mid_price between 0.001 and 0.999),
    u as (select *, win - mid_price - fee as pnl, mid_price + fee as spend from v), g as (select cand, count(*) as n, count(distinct event_id) as events, sum(pnl) as pnl, sum(pnl) / sum(spend) as roi from u group by 1),
    be as (select cand, event_id, sum(pnl) as pnl, sum(spend) as spend, row_number() over (partition by cand order by sum(pnl) desc, event_id) as rn from u group by 1, 2), wo as (select cand, sum(pnl) / sum(spend) as roi_wo from be where rn > 5 group by 1),
    sr as (select cand, max(s) as best from (select cand, series_slug, sum(pnl) as s from u group by 1, 2) group by 1)
    select cast(f.cand as int) as cand, coalesce(g.n, 0) as mid_n, g.events as mid_events, round(g.roi, 6) as mid_roi, round(wo.roi_wo, 6) as mid_roi_wo_top5, round(case when g.pnl > 0 then sr.best / g.pnl end, 6) as mid_top_series_share
    from f left join g on g.cand = f.cand left join wo on wo.cand = f.cand left join sr on sr.cand = f.cand""",
    "cells_in", "markets",
)
def holdout_means(t: Tables) -> DataFrame:
    """The evaluation without its random intervals, at mid prices."""
    rows, frozen = _holdout(t)
    out = scan.evaluate(rows, frozen, t.trades, None, 10**9, DAYS(3), 20)
    return r6(out.select("cand", "mid_n", "mid_events", "mid_roi", "mid_roi_wo_top5", "mid_top_series_share"), "mid_roi", "mid_roi_wo_top5", "mid_top_series_share")


@query(
    f""", {_HOLD}, v as (select *, case when fees_enabled then fee_rate * power(mid_price * (1 - mid_price), fee_exponent) else 0 end as fee from k where mid_price between 0.001 and 0.999),
    u as (select cand, event_id, cast(event_end as date) as day, win - mid_price - fee as pnl, mid_price + fee as spend from v),
    e as ({stats.block_ci_sql('u', 'pnl', 'spend', 'event_id', ['cand'], 200)}), d as ({stats.block_ci_sql('u', 'pnl', 'spend', 'day', ['cand'], 200)})
    select cast(f.cand as int) as cand, round(e.point, 6) as mid_roi, round(e.lo, 6) as mid_event_id_lo, round(e.hi, 6) as mid_event_id_hi, round(d.lo, 6) as mid_day_lo, round(d.hi, 6) as mid_day_hi
    from f left join e on e.cand = f.cand left join d on d.cand = f.cand""",
    "cells_in", "markets",
)
def holdout_evaluate(t: Tables) -> DataFrame:
    """The evaluation's returns at mid prices with their intervals by event and by day; all candidates and execution variants are one job."""
    rows, frozen = _holdout(t)
    out = scan.evaluate(rows, frozen, t.trades, None, 10**9, DAYS(3), 200)
    names = ["mid_roi", "mid_event_id_lo", "mid_event_id_hi", "mid_day_lo", "mid_day_hi"]
    return r6(out.select("cand", *names), *names)


@query(
    """, s as (select s_suppkey as k, s_suppkey % 3 = 0 as a, s_suppkey % 7 as b from supplier)
    select k, not a and b < 3 as pass from s""",
)
def passes(t: Tables) -> DataFrame:
    """The bars of a candidate on made results: some lack a return, some events."""
    bad, b = F.col("s_suppkey") % 3 == 0, F.col("s_suppkey") % 7
    made = {"n": F.lit(500), "roi": F.when(bad, -0.1).otherwise(0.1), "event_id_lo": F.lit(0.01), "day_lo": F.lit(0.01), "events": F.when(b < 3, 300).otherwise(100), "roi_wo_top5": F.lit(0.05), "top_series_share": F.lit(0.1)}
    rows = t.supplier.select("s_suppkey", *[c.alias(f"print_lim_{n}") for n, c in made.items()], F.lit(90.0).alias("fillable_usd_per_day"))
    return rows.select(F.col("s_suppkey").alias("k"), scan.passes().alias("pass"))


@query("select count(distinct event_id) as events, max(n) as most from (select event_id, count(*) as n from (select distinct event_id, 1 as one from markets where clean) group by 1)", "markets")
def sample_sizes(t: Tables) -> DataFrame:
    """A sample of all events with one random market each: as many events as there are, one market in each."""
    out = scan.sample_markets(t.markets.withColumn("token0", F.lit("t")), events_per_category=10**9, markets_per_event=1)
    return out.groupBy("event_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("events"), F.max("n").alias("most"))


# ---- forecasts, observations and the weather model

_DAILY = """dr as (select concat('S', cast(station_icao as varchar)) as station_icao, model, cast(init_date as timestamp) as init_time, cast(init_date + interval '2' day as date) as local_date, fc_max,
    cast(init_date as timestamp) + case when model = 'gfs_050' then interval 5 hour else interval 8 hour end as available_time from runs),
    q as (select distinct station_icao, local_date, cast(local_date as timestamp) - interval 43 hour as decision_time from dr),
    c as (select q.*, dr.model, dr.init_time, dr.fc_max, row_number() over (partition by q.station_icao, q.local_date, dr.model order by dr.init_time desc, dr.fc_max desc) as rn
          from q join dr on dr.station_icao = q.station_icao and dr.local_date = q.local_date and dr.available_time <= q.decision_time)"""


def _daily(t: Tables) -> DataFrame:
    runs = t.runs.select(F.concat(F.lit("S"), F.col("station_icao").cast("string")).alias("station_icao"), "model", F.col("init_date").cast("timestamp").alias("init_time"), "fc_max", F.to_date(F.date_add("init_date", 2)).alias("local_date"))
    return features.available_runs(runs)


def _asked(t: Tables) -> DataFrame:
    q = _daily(t).select("station_icao", "local_date").distinct()
    return q.withColumns({"qid": F.xxhash64("station_icao", "local_date"), "decision_time": F.col("local_date").cast("timestamp") - F.expr("interval 43 hours")})


@query(f", {_DAILY} select station_icao, model, cast(init_time as timestamp) as init_time, cast(available_time as timestamp) as available_time from dr", "runs")
def available_time(t: Tables) -> DataFrame:
    return _daily(t).select("station_icao", "model", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("init_time", "available_time")])


@query(f", {_DAILY} select station_icao, local_date, model, cast(init_time as timestamp) as init_time, round(fc_max, 4) as fc_max from c where rn = 1", "runs")
def latest_runs(t: Tables) -> DataFrame:
    """The latest run usable at a decision, by the operator itself."""
    return features.latest_runs(_asked(t), _daily(t)).select("station_icao", "local_date", "model", F.col("init_time").cast("timestamp_ntz").alias("init_time"), F.round("fc_max", 4).alias("fc_max"))


@query(
    f""", {_DAILY}, b as (select *, case when model = 'gfs_050' then 0.5 end as bias from c where rn = 1)
    select station_icao, local_date, round(max(case when model = 'gfs_050' then fc_max end), 4) as fc_max_gfs_050, round(max(case when model = 'gfs_050' then fc_max + 0.5 end), 4) as fc_corr_gfs_050, round(max(case when model = 'gfs_050' then fc_max - 0.5 end), 4) as rem_corr_gfs_050,
           round(max(case when model = 'ecmwf_ifs025' then fc_max end), 4) as fc_corr_ecmwf_ifs025, max(case when model = 'ecmwf_ifs025' then floor((epoch_us(decision_time) - epoch_us(init_time)) / 60000000) / 60.0 end) as age_h_ecmwf_ifs025
    from (select q.station_icao, q.local_date, b.model, b.fc_max, b.decision_time, b.init_time from q left join b on b.station_icao = q.station_icao and b.local_date = q.local_date) group by 1, 2""",
    "runs",
)
def forecast_features(t: Tables) -> DataFrame:
    """One step a run, a degree below its maximum; the one model has a bias."""
    daily = _daily(t)
    steps = daily.select("station_icao", "model", "init_time", "local_date", (F.col("local_date").cast("timestamp") + F.expr("interval 12 hours")).alias("valid_time"), (F.col("fc_max") - 1).alias("temp_c"))
    bias = daily.select("station_icao", "model", "local_date").distinct().where("model = 'gfs_050'").withColumns({"bias": F.lit(0.5), "mse": F.lit(1.0)})
    out = features.forecast_features(_asked(t), daily, steps, bias)
    wanted = ["fc_max_gfs_050", "fc_corr_gfs_050", "rem_corr_gfs_050", "fc_corr_ecmwf_ifs025"]
    return out.select("station_icao", "local_date", *[F.round(c, 4).alias(c) for c in wanted], F.col("age_h_ecmwf_ifs025").cast("double").alias("age_h_ecmwf_ifs025"))


@query(
    """, r as (select station_icao, local_date, avg(e) over w as b, avg(e * e) over w as m from errors window w as (partition by station_icao order by local_date range between interval 33 day preceding and interval 4 day preceding))
    select station_icao, local_date, round(last_value(b ignore nulls) over f, 6) as bias, round(last_value(m ignore nulls) over f, 4) as mse from r window f as (partition by station_icao order by local_date rows between 7 preceding and current row)""",
    "errors",
)
def run_bias(t: Tables) -> DataFrame:
    """Trailing errors of the midnight run, carried over, by the operator itself."""
    rows = t.errors.withColumn("local_date", F.to_date("local_date"))
    daily = rows.select("station_icao", F.lit("gfs_050").alias("model"), F.date_sub("local_date", 1).cast("timestamp").alias("init_time"), "local_date", F.lit(0.0).alias("fc_max"))
    out = features.run_bias(daily, rows.select("station_icao", "local_date", F.col("e").alias("y_c")))
    return out.select("station_icao", "local_date", F.round("bias", 6).alias("bias"), F.round("mse", 4).alias("mse"))


@query(f"{_OBS} select station_icao, local_date, count(*) as n_obs, max(coalesce(pr, c)) as y_c, 0.5 as y_halfwidth from o group by 1, 2 having count(*) >= 12", "reports")
def truth_table(t: Tables) -> DataFrame:
    local = observations.with_local_date(_obs(t), "obs_time", _stations(t))
    return features.truth_table(observations.build_daily(_obs(t), _stations(t)), local).select("station_icao", "local_date", "n_obs", "y_c", "y_halfwidth")


_WX = f"""{_OBS}, d as (select station_icao, local_date, count(*) as n_obs, max(c) as max_c_int, floor(max(coalesce(pr, c)) + 0.5) as max_c_from_precise from o group by 1, 2),
    wx as (select d.*, extract(day from local_date) % 5 * 8 as low, case when extract(day from local_date) % 5 < 4 then extract(day from local_date) % 5 * 8 + 20 end as high, extract(day from local_date) % 9 = 0 as archived from d)"""


def _wx(t: Tables) -> DataFrame:
    days = observations.with_local_date(_obs(t), "obs_time", _stations(t)).select("station_icao", "local_date").distinct()
    k = F.dayofmonth("local_date") % 5
    return days.withColumns({
        "market_id": F.concat_ws("/", "station_icao", "local_date"), "unit": F.lit("C"), "source": F.lit("wu"), "winner": F.lit(0), "bucket_low": k * 8, "bucket_high": F.when(k < 4, k * 8 + 20),
        "archived_copy": F.dayofmonth("local_date") % 9 == 0, "opened_after_day_start": F.lit(None).cast("boolean"),
    })


@query(f"""{_WX} select station_icao, local_date, max_c_int >= low and max_c_int <= coalesce(high, 10000) as ok, max_c_from_precise >= low and max_c_from_precise <= coalesce(high, 10000) as ok_max_c_from_precise, max_c_int as our_value, n_obs >= 12 as has_obs, archived as incident from wx""", "reports")
def validate_settlement(t: Tables) -> DataFrame:
    out = observations.validate(_wx(t), observations.build_daily(_obs(t), _stations(t)))
    return out.select("station_icao", "local_date", "ok", "ok_max_c_from_precise", "our_value", "has_obs", "incident")


@query(f"""{_WX} select station_icao from wx where n_obs >= 12 and not archived and local_date < date '2024-01-20' group by 1 having count(*) >= 3 and avg((max_c_int >= low and max_c_int <= coalesce(high, 10000))::int) >= 0.4""", "reports")
def reliable_stations(t: Tables) -> DataFrame:
    told = observations.validate(_wx(t), observations.build_daily(_obs(t), _stations(t)))
    return observations.reliable_stations(told, date(2024, 1, 20), 0.4, 3)


@query(f"""{_WX} select concat(station_icao, '/', cast(local_date as varchar)) as market_id, case when max_c_int >= low and max_c_int <= coalesce(high, 10000) then 0 else 1 end as winner_reproduced from wx where n_obs >= 12""", "reports")
def observed_settlement(t: Tables) -> DataFrame:
    wx = _wx(t)
    return observations.ObservedSettlement(observations.build_daily(_obs(t), _stations(t)), wx.drop("winner")).reproduce(wx.select("market_id"))


def _at_two(t: Tables) -> tuple[DataFrame, DataFrame]:
    local = observations.with_local_date(_obs(t), "obs_time", _stations(t), local_time=True)
    q = local.select("station_icao", "local_date").distinct()
    return q.withColumns({"qid": F.xxhash64("station_icao", "local_date"), "decision_time": F.col("local_date").cast("timestamp") + F.expr("interval 14 hours")}), local


@query(
    f"""{_OBS}, q as (select distinct station_icao, local_date from o), s as (select q.station_icao, q.local_date, max(coalesce(pr, c)) as rem_max from q join o on o.station_icao = q.station_icao and o.local_date = q.local_date
        where o.ts + interval 10 minute > q.local_date::timestamp + interval 14 hour group by 1, 2)
    select q.station_icao, q.local_date, s.rem_max from q left join s on s.station_icao = q.station_icao and s.local_date = q.local_date""",
    "reports",
)
def remaining_max(t: Tables) -> DataFrame:
    return features.remaining_max(*_at_two(t)).select("station_icao", "local_date", "rem_max")


@query(
    f"""{_OBS.replace(' from reports)', ', case event_id % 5 when 0 then 1.5 / 8 when 1 then 6.0 / 8 when 2 then 0.0 when 3 then 8.0 / 8 end as cloud, event_id % 5 = 1 as convective, cast((event_id % 30) * case when event_id % 2 = 0 then 1.0 else 1.943844 end as double) as wind from reports)')},
    q as (select distinct station_icao, local_date, local_date::timestamp + interval 14 hour as t from o),
    j as (select q.*, o.ts + interval 10 minute as u, coalesce(pr, c) as v, cloud, convective, wind from q join o on o.station_icao = q.station_icao and o.local_date = q.local_date),
    a as (select *, row_number() over (partition by station_icao, local_date order by u desc, v desc) as rn from j where u <= t), b as (select *, row_number() over (partition by station_icao, local_date order by u desc, v desc) as rn from j where u <= t - interval 3 hour)
    select q.station_icao, q.local_date, a.cloud, a.convective, round(a.wind, 6) as wind_kt, round(a.v - b.v, 6) as trend_3h from q left join a on a.station_icao = q.station_icao and a.local_date = q.local_date and a.rn = 1 left join b on b.station_icao = q.station_icao and b.local_date = q.local_date and b.rn = 1""",
    "reports",
)
def obs_extra(t: Tables) -> DataFrame:
    q, local = _at_two(t)
    out = features.obs_extra(features.obs_features(q, local), local)
    return out.select("station_icao", "local_date", "cloud", "convective", F.round("wind_kt", 6).alias("wind_kt"), F.round("trend_3h", 6).alias("trend_3h"))


@query(
    f"""{_OBS}, h as (select station_icao, local_date, cast(extract(hour from lt) as int) as h, max(coalesce(pr, c)) as hm, count(*) as n from o group by 1, 2, 3), d as (select station_icao, local_date, max(hm) as y from h group by 1, 2 having sum(n) >= 12),
    f as (select d.*, x.h, h.hm from d cross join range(24) x(h) left join h on h.station_icao = d.station_icao and h.local_date = d.local_date and h.h = x.h), p as (select *, y - max(hm) over (partition by station_icao, local_date order by h) as rise from f)
    select station_icao, cast(extract(month from local_date) as int) as month, cast(h as int) as h, round(avg(rise), 6) as clim_rise from p where local_date < date '2024-01-20' group by 1, 2, 3""",
    "reports",
)
def climatology_rise(t: Tables) -> DataFrame:
    local = observations.with_local_date(_obs(t), "obs_time", _stations(t), local_time=True)
    return r6(features.climatology(features.build_day_profile(local), date(2024, 1, 20))[1], "clim_rise")


@query(
    f"""{_OBS}, h as (select station_icao, local_date, cast(extract(hour from lt) as int) as h, max(coalesce(pr, c)) as hm, count(*) as n from o group by 1, 2, 3), d as (select station_icao, local_date, max(hm) as y from h group by 1, 2 having sum(n) >= 12),
    k as (select d.station_icao, d.local_date, min(h.h) as peak from d join h on h.station_icao = d.station_icao and h.local_date = d.local_date and h.hm = d.y group by 1, 2)
    select station_icao, cast(extract(month from local_date) as int) as month, round(avg(peak), 6) as clim_peak_hour from k where local_date < date '2024-01-20' group by 1, 2""",
    "reports",
)
def climatology_peak(t: Tables) -> DataFrame:
    local = observations.with_local_date(_obs(t), "obs_time", _stations(t), local_time=True)
    return r6(features.climatology(features.build_day_profile(local), date(2024, 1, 20))[0], "clim_peak_hour")


@query("select concat('b', cast(station_icao % 4 as varchar)) as hbin, round(sqrt(avg(e * e)), 6) as raw_sigma from errors where local_date < date '1995-05-28' group by 1", "errors")
def raw_sigma(t: Tables) -> DataFrame:
    grid = t.errors.select(F.concat(F.lit("b"), (F.col("station_icao") % 4).cast("string")).alias("hbin"), F.to_date("local_date").alias("local_date"), (F.col("e") + 1).alias("y_c"), F.lit(1.0).alias("fc_max_ecmwf_ifs025"))
    return r6(model.raw_sigma(grid, date(1995, 6, 1)), "raw_sigma")


@query("select event_id, round(case when event_id % 2 = 0 then (lo - 0.5 - 32) / 1.8 else lo - 0.5 end, 6) as a, round(case when event_id % 2 = 0 then (hi + 0.5 - 32) / 1.8 else hi + 0.5 end, 6) as b from (select event_id, case when event_id % 5 = 0 then -1000 else event_id % 90 end as lo, case when event_id % 7 = 0 then 1000 else event_id % 90 + 1 end as hi from events)")
def bucket_edges(t: Tables) -> DataFrame:
    n = F.col("event_id") % 90
    a, b = model.bucket_edges_c(F.when(F.col("event_id") % 2 == 0, "F").otherwise("C"), F.when(F.col("event_id") % 5 != 0, n), F.when(F.col("event_id") % 7 != 0, n + 1))
    return t.events.select("event_id", F.round(a, 6).alias("a"), F.round(b, 6).alias("b"))


@query("select event_id, round(0.5 + 0.9 * value / 10 + 0.2 * (event_id % 5), 6) as mu, round(greatest(exp(0.1 + 0.3 * ln(0.3 + event_id % 3) + 0.2 * ln(1.5 + 0.3) + 0.05 * 24.0 / 24), 0.15), 6) as sigma from events")
def emos_predict(t: Tables) -> DataFrame:
    """Predictions of one bin from given parameters."""
    rows = t.events.select("event_id", F.lit("S1").alias("station_icao"), F.lit("pre_24").alias("hbin"), F.lit("2024-02-01").cast("date").alias("fit_month"), (F.col("value") / 10).alias("ens_mean"), (F.col("event_id") % 5).alias("ec_minus_gfs"), (F.col("event_id") % 3).alias("ens_sd"))
    fits = t.spark.createDataFrame([(date(2024, 2, 1), "pre_24", [0.5, 0.9, 0.2, 0.1, 0.3, 0.2, 0.05], [], 500)], emos.FIT_SCHEMA)
    return r6(emos.predict_all(rows, fits).select("event_id", "mu", "sigma"), "mu", "sigma")


@query(
    """, d as (select distinct concat('S', cast(user_id % 9 as varchar)) as station_icao, cast(ts as date) as local_date from events where event_type = 'error'),
    k as (select unnest([-60, -54, -48, -42, -36, -30, -24, -18, -12, -6, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23]) as off)
    select station_icao, local_date, local_date::timestamp + to_hours(off) + to_hours(case cast(substr(station_icao, 2) as int) % 3 when 0 then 5 when 1 then -1 else -9 end) as decision_time from d cross join k""".replace(", d as", "with d as", 1),
)
def training_queries(t: Tables) -> DataFrame:
    """Decisions for fitting in local time; no clock changes in these months."""
    days = t.events.where("event_type = 'error'").select(F.concat(F.lit("S"), (F.col("user_id") % 9).cast("string")).alias("station_icao"), F.to_date("ts").alias("local_date")).distinct()
    return features.training_queries(days, _stations(t)).select("station_icao", "local_date", F.col("decision_time").cast("timestamp_ntz").alias("decision_time"))


@query(
    """, s as (select concat('S', cast(station_icao % 9 as varchar)) as station_icao, model, cast(init_date as timestamp) as init_time, fc_max, k from runs cross join range(0, 61, 3) r(k)),
    l as (select *, init_time + to_hours(cast(k as int)) as v, case cast(substr(station_icao, 2) as int) % 3 when 0 then 5 when 1 then -1 else -9 end as off from s),
    d as (select station_icao, model, init_time, cast(v - to_hours(off) as date) as local_date, max(fc_max + k) as fc_max, max(v) as last_valid, any_value(off) as off from l group by 1, 2, 3, 4)
    select station_icao, model, init_time, local_date, round(fc_max, 4) as fc_max from d where last_valid >= local_date::timestamp + interval 1 day + to_hours(off) - interval 3 hour""",
    "runs",
)
def run_tables(t: Tables) -> DataFrame:
    """Full-day maxima of runs with a step every three hours, of days that a run covers to their end; zones without clock changes."""
    runs = t.runs.select(F.concat(F.lit("S"), (F.col("station_icao") % 9).cast("string")).alias("station_icao"), "model", F.col("init_date").cast("timestamp").alias("init_time"), "fc_max", F.explode(F.sequence(F.lit(0), F.lit(60), F.lit(3))).alias("k"))
    steps = runs.select("station_icao", "model", "init_time", F.expr("init_time + make_dt_interval(0, k)").alias("valid_time"), (F.col("fc_max") + F.col("k")).alias("temp_c"))
    zones = t.spark.createDataFrame([(f"S{i}", z) for i in range(9) for z in [["Etc/GMT+5", "Etc/GMT-1", "Etc/GMT-9"][i % 3]]], "station_icao string, tz string")
    daily = features.build_run_tables(features.available_runs(steps), zones)[1]
    return daily.select("station_icao", "model", F.col("init_time").cast("timestamp_ntz").alias("init_time"), "local_date", F.round("fc_max", 4).alias("fc_max"))


# ---- rules and markets


@query(
    """select event_id, case when event_id % 4 = 0 then 'hko' when event_id % 4 = 1 then 'noaa' when event_id % 4 = 2 then 'wu' else 'unknown' end as source, case when event_id % 3 = 0 then 'C' else 'F' end as unit,
       case when event_id % 2 = 0 then 'KLGA' end as icao, case when event_id % 5 = 0 then date '2024-01-05' else date '2024-02-01' end as day from events"""
)
def rule_texts(t: Tables) -> DataFrame:
    """Source, unit, station and day as descriptions tell them."""
    k = F.col("event_id")
    told = F.concat(
        F.when(k % 4 == 0, "By the Hong Kong Observatory. ").otherwise(""), F.lit("The resolution source for this market will be "), F.when(k % 4 == 1, "NOAA data").when(k % 4 == 2, "Wunderground").otherwise("something"),
        F.when(k % 2 == 0, " at wunderground.com/history/daily/us/ny/klga.").otherwise("."), F.when(k % 3 == 0, " In degrees Celsius").otherwise(""), F.when(k % 5 == 0, " on 5 Jan '24").otherwise(""),
    )
    return t.events.select("event_id", rules.parse_source(told).alias("source"), rules.parse_unit(F.lit("30 or below"), told).alias("unit"), rules.parse_icao(told, F.lit("")).alias("icao"), rules.parse_local_date(told, F.lit("2024-02-01")).alias("day"))


@query("select market_id, created_ts - interval 1 hour as start, least(greatest(end_ts, created_ts) + interval 1 day, timestamp '2024-01-25') as \"end\" from markets where market_id % 2 = 0", "markets")
def fetch_bounds(t: Tables) -> DataFrame:
    m = t.markets.withColumns({"token0": F.when(F.col("market_id") % 2 == 0, "t").otherwise(""), "closed_ts": F.col("end_ts"), "uma_end_ts": F.lit(None).cast("timestamp_ntz")})
    return M.fetch_bounds(m, now=F.lit("2024-01-25").cast("timestamp_ntz")).select("market_id", "start", "end")


@query(
    """, j as (select m.market_id, least(m.end_ts, m.known_ts) as z, p.decision_time as t from markets m join probes p on p.market_id = m.market_id)
    select distinct market_id, case when t >= z - interval 15 day then z - interval 15 day else t - interval 2 hour end as window_start, case when t >= z - interval 15 day then z else t end as window_end from j""",
    "markets", "probes",
)
def fetch_windows(t: Tables) -> DataFrame:
    markets = t.markets.withColumns({"token0": F.lit("t"), "closed_ts": F.col("known_ts")})
    return snapshots.fetch_windows(markets, t.probes.select("market_id", F.col("decision_time").alias("target_ts"))).select("market_id", "window_start", "window_end")


@query("select market_id from markets where category in ('c1', 'c2') and clean", "markets")
def select_markets(t: Tables) -> DataFrame:
    return M.select_markets(t.markets, categories=["c1", "c2"], clean_only=True).select("market_id")


@query("select distinct event_id from markets where event_id in (select floor(market_id / 3)::bigint from mids) and event_id in (select floor(market_id / 3)::bigint from raw_trades where size > 200)", "markets", "mids", "raw_trades")
def events_with_both(t: Tables) -> DataFrame:
    event = F.floor(F.col("market_id") / 3).cast("long").alias("event_id")
    return complete_events(t.markets, t.mids.select(event), t.raw_trades.where("size > 200").select(event))


@query(
    """select event_id, concat('m', cast(event_id as varchar)) as market_id, event_id % 2 as winner, case when event_id % 3 = 0 then 0.05 else 0.0 end as fee_rate, event_id % 3 = 0 as fees_enabled, 'Yes' as outcome0, event_id % 5 = 0 as neg_risk from events"""
)
def market_rows_of_json(t: Tables) -> DataFrame:
    """Markets of raw events as the service writes them."""
    from oddsframe.schemas import RAW_EVENT

    k = F.col("event_id")
    text = F.concat(
        F.lit('{"id":"'), k, F.lit('","slug":"s","title":"t","tags":[],"negRisk":'), F.when(k % 5 == 0, "true").otherwise("false"), F.lit(',"markets":[{"id":"m'), k,
        F.lit('","conditionId":"0x1","outcomes":"[\\"Yes\\",\\"No\\"]","outcomePrices":"'), F.when(k % 2 == 0, '[\\"1\\",\\"0\\"]').otherwise('[\\"0\\",\\"1\\"]'),
        F.lit('","clobTokenIds":"[\\"a\\",\\"b\\"]","closed":true,"createdAt":"2024-01-01T00:00:00Z","endDate":"2024-01-02T00:00:00Z","feesEnabled":'), F.when(k % 3 == 0, "true").otherwise("false"), F.lit(',"feeSchedule":{"rate":'), F.when(k % 3 == 0, "0.05").otherwise("0.0"), F.lit("}}]}"),
    )
    events = t.events.select(F.from_json(text, RAW_EVENT).alias("e")).select("e.*")
    return M.markets_frame(events).select(F.col("event_id").cast("long").alias("event_id"), "market_id", F.col("winner").cast("long").alias("winner"), "fee_rate", "fees_enabled", "outcome0", "neg_risk")


@query("select event_id, decision_time, 'grid' as trigger from (select event_id, make_timestamp(unnest(range((floor((epoch_us(a) + 86400000000) / 86400000000) * 86400000000)::bigint, epoch_us(z) + 1, 86400000000))) as decision_time from (select event_id, min(created_ts) as a, max(known_ts) - interval 1 hour as z from markets group by 1)) union all select event_id, min(created_ts) + interval 90 minute + interval 1 second, 'model' from markets group by 1", "markets")
def decision_times(t: Tables) -> DataFrame:
    """The daily grid, and the times that a model asks for."""

    class Late(LogitSharpen):
        def decision_times(self, markets: DataFrame) -> DataFrame:
            return markets.groupBy("event_id").agg((F.min("created_ts") + F.expr("interval 5401 seconds")).alias("decision_time"))

    return B.decision_times(t.markets, Late(), DAYS(1)).select("event_id", F.col("decision_time").cast("timestamp_ntz").alias("decision_time"), "trigger")


@query("select event_id, market_id, category from markets", "markets")
def markets_without_outcomes(t: Tables) -> DataFrame:
    """What a model gets to see: no winner, no resolution."""
    shown = without_outcomes(t.markets)
    hidden = [c for c in ("winner", "known_ts") if c in shown.columns]
    return shown.select("event_id", "market_id", "category", *hidden)


@query("select t.trade_id, t.market_id, t.ts, round(t.px0, 6) as px0 from trades t where t.market_id in (select market_id from markets where category = 'c1')", "trades", "markets")
def trades_of_chosen(t: Tables) -> DataFrame:
    """Trades in terms of outcome 0, of the markets chosen alone (a semi-join)."""
    chosen = M.select_markets(t.markets, categories=["c1"])
    return E.outcome0_view(t.raw_trades).join(chosen.select("market_id"), "market_id", "left_semi").select("trade_id", "market_id", "ts", F.round("px0", 6).alias("px0"))
