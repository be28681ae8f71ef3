"""Queries of the core operators over the generic tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsframe.functions import exprs as X
from oddsframe.operators import backtest as B
from oddsframe.operators import execution as E
from oddsframe.operators import scan, snapshots, stats
from oddsframe.operators.temporal import forward_fill
from oddsframe.plans.views import Tables, oracle
from oddsframe.plugins import LogitSharpen, settlement_agreement

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DAYS = lambda n: timedelta(days=n)


def query(sql: str | None = None, *views: str):
    """Register a function of Tables under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[f.__name__] = oracle(sql, *views)
        return f

    return add


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


BAND = "case when {x} is null then null " + " ".join(f"when {{x}} < {e} then '{n}'" for e, n in zip(X.BAND_EDGES, X.band_labels(X.BAND_EDGES), strict=False)) + f" else '{X.band_labels(X.BAND_EDGES)[-1]}' end"
P75 = "round(list_sort(list(cost))[cast(floor(0.75 * (count(*) - 1) + 0.5) as int) + 1], 6)"
COSTS = f"""costs as (select t.trade_id, t.market_id, t.ts, t.size, m.p as mid, case when t.buys0 then t.px0 - m.p else m.p - t.px0 end as cost, mk.category
  from trades t asof join mids m on t.market_id = m.market_id and t.ts >= m.ts join markets mk on mk.market_id = t.market_id where t.ts - m.ts <= interval 2 day),
table_ as (select category, {BAND.format(x="mid")} as band, median(cost) as median_cost from costs group by all),
pooled as (select band, median(median_cost) as pooled from table_ group by band)"""


@query("select t.trade_id, t.px0, t.buys0, round(t.usd, 6) as usd from trades t", "trades")
def outcome0_view(t: Tables) -> DataFrame:
    return r6(E.outcome0_view(t.raw_trades).select("trade_id", "px0", "buys0", "usd"), "usd")


@query(
    """select pr.market_id, pr.decision_time, case when pr.decision_time - m.ts > interval 2 day then null else m.ts end as price_ts,
       case when pr.decision_time - m.ts > interval 2 day then null else m.p end as p
       from probes pr asof left join mids m on pr.market_id = m.market_id and pr.decision_time >= m.ts""",
    "probes", "mids",
)
def asof_price_at(t: Tables) -> DataFrame:
    return snapshots.price_at(t.probes, t.mids, max_stale=DAYS(2))


@query(
    """select pr.market_id, pr.decision_time, case when pr.decision_time - m.ts > interval 2 day then null else m.ts end as price_ts,
       case when pr.decision_time - m.ts > interval 2 day then null else m.p end as p
       from probes pr asof left join mids m on pr.market_id = m.market_id and pr.decision_time >= m.ts""",
    "probes", "mids",
)
def asof_price_at_chunked(t: Tables) -> DataFrame:
    """The same join with each key's time line cut into chunks, for hot keys."""
    return snapshots.price_at(t.probes, t.mids, max_stale=DAYS(2), chunk=DAYS(3))


@query(
    """select pr.market_id, pr.decision_time, case when pr.decision_time - m.ts > interval 2 day then null else m.ts end as price_ts,
       case when pr.decision_time - m.ts > interval 2 day then null else m.p end as p
       from probes pr asof left join mids m on pr.market_id = m.market_id and pr.decision_time >= m.ts""",
    "probes", "mids",
)
def asof_price_at_balanced(t: Tables) -> DataFrame:
    """The same join with the time lines of keys over forty rows cut at quantiles."""
    return snapshots.price_at(t.probes, t.mids, max_stale=DAYS(2), chunk=40)


def _costs(t: Tables) -> DataFrame:
    return E.trade_costs(t.trades, t.mids, DAYS(2))


@query("select t.trade_id, m.p as mid, round(case when t.buys0 then t.px0 - m.p else m.p - t.px0 end, 6) as cost from trades t asof join mids m on t.market_id = m.market_id and t.ts >= m.ts where t.ts - m.ts <= interval 2 day", "trades", "mids")
def trade_costs(t: Tables) -> DataFrame:
    return r6(_costs(t).select("trade_id", "mid", "cost"), "cost")


@query(f", {COSTS} select {BAND.format(x='mid')} as band, count(*) as n, round(median(cost), 6) as median_cost, round(avg(cost), 6) as mean_cost, {P75} as p75_cost, round(sum(size), 4) as shares from costs group by 1", "trades", "mids", "markets")
def cost_table(t: Tables) -> DataFrame:
    return r6(E.cost_table(_costs(t)), "median_cost", "mean_cost", "p75_cost").withColumn("shares", F.round("shares", 4))


def _cost_by_category(t: Tables) -> DataFrame:
    return E.cost_table(_costs(t).join(t.markets.select("market_id", "category"), "market_id"), ["category"])


@query(
    f""", {COSTS} select x.market_id, x.ts, {BAND.format(x='x.p')} as band, round(greatest(coalesce(c.median_cost, q.pooled, 0.02), 0), 6) as cost
        from mids x join markets m on m.market_id = x.market_id left join table_ c on c.category = m.category and c.band = {BAND.format(x='x.p')} left join pooled q on q.band = {BAND.format(x='x.p')}""",
    "trades", "mids", "markets",
)
def attach_cost(t: Tables) -> DataFrame:
    rows = t.mids.join(t.markets.select("market_id", "category"), "market_id")
    return r6(E.attach_cost(rows, _cost_by_category(t), by=["category"]).select("market_id", "ts", "band", "cost"), "cost")


@query(
    """select pr.market_id, pr.decision_time, round(coalesce(sum(t.size), 0), 4) as vol_window, coalesce(sum(t.size), 0) > 0 as traded_near from probes pr
       left join trades t on t.market_id = pr.market_id and t.ts > pr.decision_time - interval 2 day and t.ts <= pr.decision_time + interval 2 day group by 1, 2""",
    "probes", "trades",
)
def window_volume(t: Tables) -> DataFrame:
    return E.window_volume(t.probes, t.trades, DAYS(2)).withColumn("vol_window", F.round("vol_window", 4))


@query(
    """, rows_ as (select p.*, s.side, 0.5 as lim from probes p cross join (values ('YES'), ('NO')) s(side)),
    j as (select r.*, t.ts, t.size, case when r.side = 'YES' then t.px0 else 1 - t.px0 end as px from rows_ r join trades t on t.market_id = r.market_id
          and t.ts > r.decision_time and t.ts <= r.decision_time + interval 5 day and t.buys0 = (r.side = 'YES')),
    g as (select market_id, decision_time, side, arg_min(px, ts) as print_px, min(ts) as print_ts, sum(px * size) as print_usd,
          coalesce(sum(case when px <= lim then px * size end), 0) as fillable_usd, coalesce(sum(case when px <= lim then size end), 0) as fillable_shares from j group by 1, 2, 3)
    select r.market_id, r.decision_time, r.side, round(g.print_px, 6) as print_px, g.print_ts, round(g.print_usd, 7) as print_usd, round(g.fillable_usd, 7) as fillable_usd, round(g.fillable_shares, 4) as fillable_shares
    from rows_ r left join g using (market_id, decision_time, side)""",
    "probes", "trades",
)
def first_print(t: Tables) -> DataFrame:
    rows = t.probes.withColumn("side", F.explode(F.array(F.lit("YES"), F.lit("NO")))).withColumn("lim", F.lit(0.5))
    out = E.first_print(rows, t.trades, DAYS(5), limit_col="lim").drop("lim")
    return out.withColumns({"print_px": F.round("print_px", 6), **{c: F.round(c, 7) for c in ("print_usd", "fillable_usd")}, "fillable_shares": F.round("fillable_shares", 4)})


@query(
    """, e as (select p.market_id, p.decision_time as t0, m.winner from probes p join markets m using (market_id)),
    ref as (select e.*, x.p as p0 from e asof left join mids x on e.market_id = x.market_id and e.t0 >= x.ts),
    hit as (select r.market_id, r.t0, min(x.ts) as f from ref r join mids x on x.market_id = r.market_id and x.ts > r.t0 and x.ts <= r.t0 + interval 5 day
            where case when r.winner = 0 then x.p - r.p0 else r.p0 - x.p end > 0.05 group by 1, 2)
    select e.market_id, e.t0, round(floor((epoch_us(h.f) - epoch_us(e.t0)) / 1000000) / 60.0, 6) as reaction_min from e left join hit h on e.market_id = h.market_id and e.t0 = h.t0""",
    "probes", "mids", "markets",
)
def reaction_minutes(t: Tables) -> DataFrame:
    events = t.probes.join(t.markets.select("market_id", "winner"), "market_id").select("market_id", F.col("decision_time").alias("t0"), "winner")
    return r6(E.reaction_minutes(events, t.mids, 0.05, DAYS(5)).select("market_id", "t0", "reaction_min"), "reaction_min")


@query(
    """, s as (select market_id, created_ts, known_ts, end_ts, unnest(['30d', '7d', '1d', '6h', '1h', 'life10', 'life50', 'life90']) as snapshot, unnest([720.0, 168, 24, 6, 1, null, null, null]) as h, unnest([null, null, null, null, null, 0.1::double, 0.5, 0.9]) as f from markets),
    g as (select market_id, snapshot, created_ts, known_ts, case when h is not null then end_ts - to_hours(cast(h as int)) when created_ts < end_ts then created_ts + to_microseconds(cast(floor((epoch_us(end_ts) - epoch_us(created_ts)) * f) as bigint)) end as target_ts from s)
    select market_id, snapshot, target_ts from g where target_ts >= created_ts and target_ts <= known_ts - interval 1 hour""",
    "markets",
)
def snapshot_targets(t: Tables) -> DataFrame:
    return snapshots.snapshot_targets(t.markets)


@query(
    """, e as (select event_id, min(created_ts) as a, max(known_ts) - interval 1 hour as t1 from markets group by 1),
    g as (select event_id, (floor((epoch_us(a) + 43200000000) / 43200000000) * 43200000000)::bigint as u, epoch_us(t1) as v from e)
    select event_id, make_timestamp(unnest(range(u, v + 1, 43200000000))) as decision_time from g""",
    "markets",
)
def decision_grid(t: Tables) -> DataFrame:
    return snapshots.decision_grid(t.markets, timedelta(hours=12))


@query("""select p.event_id, p.decision_time, m.market_id from (select distinct event_id, decision_time from daily) p join markets m on m.event_id = p.event_id and p.decision_time >= m.created_ts and p.decision_time <= m.known_ts - interval 1 hour""", "daily", "markets")
def market_rows_guard(t: Tables) -> DataFrame:
    return snapshots.market_rows(t.daily.select("event_id", "decision_time").distinct(), t.markets).select("event_id", "decision_time", "market_id")


@query(
    """, w as (select *, bool_or(p is null) over g as miss, sum(p) over g as s from daily window g as (partition by event_id, decision_time))
    select event_id, market_id, decision_time, p, round(case when neg_risk then s else p end, 6) as p_sum, round(case when neg_risk and s > 0 then p / s else p end, 6) as q_market from w where p is not null and not (neg_risk and miss)""",
    "daily",
)
def normalize_event(t: Tables) -> DataFrame:
    return r6(snapshots.normalize_event(t.daily).select("event_id", "market_id", "decision_time", "p", "p_sum", "q_market"), "p_sum", "q_market")


@query("""select event_id, decision_time, round(coalesce(sum(p), 0), 6) as sum_p from (select d.*, 3 as m from daily d) where neg_risk group by 1, 2 having count(*) = 3""", "daily")
def overround(t: Tables) -> DataFrame:
    return r6(snapshots.overround(t.daily.withColumn("markets_in_event", F.lit(3)), "decision_time"), "sum_p")


@query("""select market_id, p, y, 'YES' as side from cells_in union all select market_id, round(1 - p, 6), 1 - y, 'NO' from cells_in""", "cells_in")
def side_view(t: Tables) -> DataFrame:
    return r6(stats.side_view(t.cells_in.select("market_id", "p", "y")), "p")


@query("""select market_id, decision_time, round(case when fees_enabled then fee_rate * power(p * (1 - p), fee_exponent) else 0 end, 8) as fee from panel""", "panel")
def fee_per_share(t: Tables) -> DataFrame:
    return t.panel.select("market_id", "decision_time", F.round(X.taker_fee(F.col("p")), 8).alias("fee"))


@query(f"select {BAND.format(x='p')} as band, count(*) as n, round(avg(p), 6) as mean_p from mids group by 1", "mids")
def band_histogram(t: Tables) -> DataFrame:
    return t.mids.groupBy(X.band("p").alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"))


def _cells_sql(keys: str, source: str = "cells_in") -> str:
    return f"""c as (select {keys}, event_id, sum(y - p) as r, count(*) as n, sum(p) as ps, sum(y) as ys, sum(case when fees_enabled then fee_rate else 0 end) as fs from {source} group by {keys}, event_id),
    g as (select {keys}, sum(n) as n, count(*) as events, sum(ps) / sum(n) as p_mean, sum(ys) / sum(n) as freq, sum(fs) / sum(n) as fee_rate_mean from c group by {keys})"""


@query(
    f""", {_cells_sql("category, band")}, h as (select g.category, g.band, sum(power(c.r - (g.freq - g.p_mean) * c.n, 2)) as u from g join c on c.category = g.category and c.band = g.band group by 1, 2)
    select g.category, g.band, cast(g.n as bigint) as n, g.events, round(p_mean, 6) as p_mean, round(freq, 6) as freq, round(freq - p_mean, 6) as diff,
           round(sqrt(events / (events - 1.0) * u) / g.n, 6) as se from g join h on h.category = g.category and h.band = g.band""",
    "cells_in",
)
def cell_stats(t: Tables) -> DataFrame:
    out = stats.cell_stats(t.cells_in, ["category", "band"])
    return r6(out.select("category", "band", "n", "events", "p_mean", "freq", "diff", "se"), "p_mean", "freq", "diff", "se")


_SETS = """, s as (select category, band, snapshot, event_id, p, y, fees_enabled, fee_rate from cells_in union all select category, band, 'ALL', event_id, p, y, fees_enabled, fee_rate from cells_in
    union all select 'ALL', band, snapshot, event_id, p, y, fees_enabled, fee_rate from cells_in union all select 'ALL', band, 'ALL', event_id, p, y, fees_enabled, fee_rate from cells_in)"""
_Z = f"""{_SETS}, {_cells_sql("category, band, snapshot", "s")}, h as (select g.category, g.band, g.snapshot, sum(power(c.r - (g.freq - g.p_mean) * c.n, 2)) as u from g join c on c.category = g.category and c.band = g.band and c.snapshot = g.snapshot group by 1, 2, 3),
    z0 as (select g.*, freq - p_mean as diff, sqrt(events / (events - 1.0) * u) / g.n as se from g join h on h.category = g.category and h.band = g.band and h.snapshot = g.snapshot),
    z as (select *, least(1.0, 2 * {X.norm_sf_sql("least(abs(diff / se), 38e0)")}) as pval from z0)"""


@query(f"{_Z} select category, band, snapshot, cast(n as bigint) as n, events, round(diff, 6) as diff, round(se, 6) as se, round(diff / se, 4) as z, round(pval, 6) as pval, round(fee_rate_mean, 6) as fee_rate_mean from z", "cells_in")
def calibration_cells_grouping_sets(t: Tables) -> DataFrame:
    out = scan.all_cells(t.cells_in)
    return r6(out.select("category", "band", "snapshot", "n", "events", "diff", "se", F.round("z", 4).alias("z"), "pval", "fee_rate_mean"), "diff", "se", "pval", "fee_rate_mean")


@query(
    f"""{_Z}, k as (select *, row_number() over (order by pval) as rk, count(*) over () as m from z), cut as (select max(case when pval * m / rk <= 0.25 then rk end) as top from k)
    select category, band, snapshot, coalesce(rk <= top, false) as bh_pass from k cross join cut""",
    "cells_in",
)
def benjamini_hochberg(t: Tables) -> DataFrame:
    return stats.benjamini_hochberg(scan.all_cells(t.cells_in), q=0.25).select("category", "band", "snapshot", "bh_pass")


_ROI = f"""{_Z}, ct as (select 'c' || i::varchar as category, b as band, 0.01 * (i + 1) as median_cost from range(3) r(i) cross join (values ('0-20'), ('20-50')) v(b)), po as (select band, median(median_cost) as pooled from ct group by band),
    w as (select z.*, greatest(coalesce(ct.median_cost, po.pooled, 0.02), 0) as cost from z left join ct on ct.category = z.category and ct.band = z.band left join po on po.band = z.band),
    x as (select *, case when diff > 0 then 'YES' else 'NO' end as side, case when diff > 0 then p_mean else 1 - p_mean end + cost as exec_price, case when diff > 0 then freq else 1 - freq end as win from w)"""


def _made_costs(t: Tables) -> DataFrame:
    rows = [(f"c{i}", b, 0.01 * (i + 1)) for i in range(3) for b in ("0-20", "20-50")]
    return t.spark.createDataFrame(rows, "category string, band string, median_cost double")


@query(f"{_ROI} select category, band, snapshot, side, round(exec_price, 6) as exec_price, round((win - exec_price - fee_rate_mean * exec_price * (1 - exec_price)) / (exec_price + fee_rate_mean * exec_price * (1 - exec_price)), 6) as exp_roi from x", "cells_in")
def expected_roi(t: Tables) -> DataFrame:
    return r6(scan.expected_roi(scan.all_cells(t.cells_in), _made_costs(t)).select("category", "band", "snapshot", "side", "exec_price", "exp_roi"), "exec_price", "exp_roi")


@query(
    f"""select x.market_id, x.ts as target_ts, case when m.winner = 0 then 1 else 0 end as y, round(floor((epoch_us(m.end_ts) - epoch_us(x.ts)) / 60000000) / 60.0, 6) as hours_to_end,
        case when max(m.end_ts) over (partition by m.event_id) < timestamp '2024-01-29' then 'discovery' else 'holdout' end as split, {BAND.format(x='x.p')} as band from mids x join (select *, max(end_ts) over (partition by event_id) as ee from markets) m on m.market_id = x.market_id""",
    "mids", "markets",
)
def assemble(t: Tables) -> DataFrame:
    snaps = t.mids.select("market_id", F.col("ts").alias("target_ts"), "p").withColumn("snapshot", F.lit("1d"))
    markets = t.markets.withColumns({"closed_ts": F.col("end_ts"), "volume": F.lit(1000.0)})
    return r6(scan.assemble(snaps, markets, date(2024, 1, 29)).select("market_id", "target_ts", "y", "hours_to_end", "split", "band"), "hours_to_end")


_ORDERS = """o as (select *, 'YES' as side, p_model as p_win, p + 0.03 as price from panel union all select *, 'NO', 1 - p_model, 1 - p + 0.03 from panel),
    f as (select *, case when fees_enabled then fee_rate * power(price * (1 - price), fee_exponent) else 0 end as fee from o where price between 0.01 and 0.99),
    c as (select *, price + fee as cps, p_win - price - fee as edge from f)"""


@query(f", {_ORDERS} select market_id, decision_time, side, round(price, 6) as price, round(fee, 8) as fee, round(edge, 6) as edge from c", "panel")
def candidate_orders(t: Tables) -> DataFrame:
    return B.candidate_orders(t.panel).select("market_id", "decision_time", "side", F.round("price", 6).alias("price"), F.round("fee", 8).alias("fee"), F.round("edge", 6).alias("edge"))


_SIM = f"""{_ORDERS}, e as (select *, row_number() over (partition by market_id, side order by decision_time) as rn from c where edge > 0.05 and traded_near),
    q as (select *, least(20.0 / cps, 0.1 * vol_window) as shares from e where rn = 1), v as (select *, shares * cps as spend from q where shares > 0.5),
    d as (select *, sum(spend) over (partition by day order by decision_time, market_id, side rows unbounded preceding) as cum_day from v),
    trades_ as (select *, case when side = 'YES' then winner = 0 else winner = 1 end as won, shares * (case when (side = 'YES') = (winner = 0) then 1 else 0 end - cps) as pnl from d where cum_day <= 2000)"""


@query(f", {_SIM} select market_id, side, decision_time, round(shares, 6) as shares, round(spend, 6) as spend, won, round(pnl, 6) as pnl from trades_", "panel")
def simulate(t: Tables) -> DataFrame:
    return r6(B.simulate(t.panel).select("market_id", "side", "decision_time", "shares", "spend", "won", "pnl"), "shares", "spend", "pnl")


_METRICS = """dd as (select day, sum(pnl) as d from trades_ group by day), eq as (select day, sum(d) over (order by day) as equity from dd), pk as (select *, greatest(0, max(equity) over (order by day)) as peak from eq)
    select count(*) as n_trades, round(sum(pnl), 4) as pnl, round(sum(spend), 4) as turnover, round(sum(pnl) / sum(spend), 6) as roi, round(avg(won::int), 6) as hit_rate, (select round(max(peak - equity), 4) from pk) as max_dd,
           round(avg(edge), 6) as avg_edge, round(avg(pnl / shares), 6) as realized_edge, (select count(*) from dd) as n_days from trades_"""


def _rounded_metrics(m: DataFrame) -> DataFrame:
    return m.withColumns({**{c: F.round(c, 4) for c in ("pnl", "turnover", "max_dd")}, **{c: F.round(c, 6) for c in ("roi", "hit_rate", "avg_edge", "realized_edge")}})


@query(f", {_SIM}, {_METRICS}", "panel")
def sim_metrics(t: Tables) -> DataFrame:
    return _rounded_metrics(B.metrics(B.simulate(t.panel)))


@query(
    """, cfg as (select t.x as threshold, c.x as cost from (values (0.02), (0.05), (0.10), (0.20)) t(x) cross join (values (0.01), (0.03), (0.05)) c(x)),
    o as (select panel.*, threshold, cost, 'YES' as side, p_model as p_win, p + cost as price from panel cross join cfg union all select panel.*, threshold, cost, 'NO', 1 - p_model, 1 - p + cost from panel cross join cfg),
    f as (select *, case when fees_enabled then fee_rate * power(price * (1 - price), fee_exponent) else 0 end as fee from o where price between 0.01 and 0.99),
    c as (select *, price + fee as cps, p_win - price - fee as edge from f),
    e as (select *, row_number() over (partition by threshold, cost, market_id, side order by decision_time) as rn from c where edge > threshold and traded_near),
    q as (select *, least(20.0 / cps, 0.1 * vol_window) as shares from e where rn = 1), v as (select *, shares * cps as spend from q where shares > 0.5),
    d as (select *, sum(spend) over (partition by threshold, cost, day order by decision_time, market_id, side rows unbounded preceding) as cum_day from v),
    tr as (select *, shares * (case when (side = 'YES') = (winner = 0) then 1 else 0 end - cps) as pnl from d where cum_day <= 2000)
    select cfg.threshold::double as threshold, cfg.cost::double as cost, count(tr.market_id) as n_trades, round(coalesce(sum(pnl), 0), 4) as pnl, round(sum(pnl) / sum(spend), 6) as roi from cfg left join tr on tr.threshold = cfg.threshold and tr.cost = cfg.cost group by 1, 2""",
    "panel",
)
def param_sweep(t: Tables) -> DataFrame:
    out = B.sweep(t.panel, B.SimConfig(), [0.02, 0.05, 0.10, 0.20], [0.01, 0.03, 0.05])
    return out.select("threshold", "cost", "n_trades", F.round("pnl", 4).alias("pnl"), F.round("roi", 6).alias("roi"))


@query(f", {_SIM} select category, count(*) as n, round(sum(pnl), 4) as pnl, round(sum(spend), 4) as spend, round(avg(won::int), 6) as hit, round(avg(edge), 6) as avg_edge, round(sum(pnl) / sum(spend), 6) as roi from trades_ group by category", "panel")
def breakdown(t: Tables) -> DataFrame:
    out = B.breakdown(B.simulate(t.panel), "category")
    return out.withColumns({**{c: F.round(c, 4) for c in ("pnl", "spend")}, **{c: F.round(c, 6) for c in ("hit", "avg_edge", "roi")}})


@query(f", {_SIM}, b as (select day, sum(pnl) as pnl, sum(spend) as spend, row_number() over (order by sum(pnl) desc, day) as rn from trades_ group by day) select round(sum(pnl), 4) as pnl_without_top5, round(sum(pnl) / sum(spend), 6) as roi_without_top5 from b where rn > 5", "panel")
def without_top_k(t: Tables) -> DataFrame:
    return B.without_top(B.simulate(t.panel)).select(F.round("pnl_without_top5", 4).alias("pnl_without_top5"), F.round("roi_without_top5", 6).alias("roi_without_top5"))


@query(", e as (select event_id, max(day) as d from panel group by 1), k as (select d, row_number() over (order by d) as rn, count(*) over () as n from e) select d as split_day from k where rn = n // 2 + 1", "panel")
def split_date(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(B.split_date(t.panel),)], "split_day date")


_LOSS = "-ln(least(greatest({x}, 0.0001), 1.0))"


@query(
    f""", n as (select event_id, market_id, decision_time, neg_risk, winner, p, case when neg_risk then p / sum(p) over (partition by event_id, decision_time) else p end as q, least(greatest(p * p + 0.1, 0.01), 0.99) as m from daily where p is not null)
    select event_id, market_id, decision_time, round(case when neg_risk then {_LOSS.format(x='q')} when winner = 0 then {_LOSS.format(x='p')} else {_LOSS.format(x='1 - p')} end, 6) as ll_market,
           round(case when neg_risk or winner = 0 then {_LOSS.format(x='m')} else {_LOSS.format(x='1 - m')} end, 6) as ll_model from n where not neg_risk or winner = 0""",
    "daily",
)
def outcome_losses(t: Tables) -> DataFrame:
    return r6(stats.outcome_losses(_scored(t)).select("event_id", "market_id", "decision_time", "ll_market", "ll_model"), "ll_market", "ll_model")


def _scored(t: Tables) -> DataFrame:
    d = t.daily.where("p is not null")
    share = F.col("p") / F.sum("p").over(Window.partitionBy("event_id", "decision_time"))
    return d.withColumns({"q_market": F.when(F.col("neg_risk"), share).otherwise(F.col("p")), "p_model": F.least(F.greatest(F.col("p") * F.col("p") + 0.1, F.lit(0.01)), F.lit(0.99))})


@query()
def sample_markets(t: Tables) -> DataFrame:
    return scan.sample_markets(t.markets.withColumn("token0", F.lit("t")), events_per_category=5, markets_per_event=1).select("market_id", "event_id", "category")


@query(
    """select station_icao, model, local_date, round(avg(e) over w, 9) as bias, round(avg(e * e) over w, 4) as mse from errors
       window w as (partition by station_icao, model order by local_date range between interval 33 day preceding and interval 4 day preceding)""",
    "errors",
)
def trailing_bias(t: Tables) -> DataFrame:
    back = Window.partitionBy("station_icao", "model").orderBy(F.unix_date(F.to_date("local_date"))).rangeBetween(-33, -4)
    return t.errors.select("station_icao", "model", "local_date", F.round(F.avg("e").over(back), 9).alias("bias"), F.round(F.avg(F.col("e") * F.col("e")).over(back), 4).alias("mse"))


@query(
    """, x as (select station_icao, model, local_date, case when extract(day from local_date) % 3 = 0 then round(e, 9) end as v from errors)
    select station_icao, model, local_date, last_value(v ignore nulls) over (partition by station_icao, model order by local_date rows between 7 preceding and current row) as v from x""",
    "errors",
)
def forward_fill_limit(t: Tables) -> DataFrame:
    x = t.errors.select("station_icao", "model", "local_date", F.when(F.dayofmonth("local_date") % 3 == 0, F.round("e", 9)).alias("v"))
    return forward_fill(x, "v", ["station_icao", "model"], "local_date", 7)


@query(
    "select m.category, count(*) as markets, count(distinct m.event_id) as events, round(avg((m.winner = r.w)::int), 6) as reproduced from markets m join (select market_id, (market_id % 3) % 2 as w from markets where market_id % 10 <> 0) r on r.market_id = m.market_id where m.clean group by 1",
    "markets",
)
def settlement_agreement_by_category(t: Tables) -> DataFrame:
    class Source:
        name = "made"

        def reproduce(self, markets: DataFrame) -> DataFrame:
            return markets.select("market_id", F.when(F.col("market_id") % 10 != 0, (F.col("market_id") % 3) % 2).alias("winner_reproduced"))

    return r6(settlement_agreement(t.markets, Source(), ["category"]), "reproduced")


@query("select event_id from markets group by event_id having event_id not in (select floor(market_id / 3)::bigint from raw_trades where size > 200)", "markets", "raw_trades")
def anti_missing_trades(t: Tables) -> DataFrame:
    from oddsframe.sources.store import missing_events

    return missing_events(t.markets, t.raw_trades.where("size > 200").select(F.floor(F.col("market_id") / 3).cast("long").alias("event_id")).distinct())


@query("select market_id, decision_time, round(1 / (1 + exp(-1.3 * ln(p / (1 - p)))), 6) as p_model from panel", "panel")
def logit_sharpen(t: Tables) -> DataFrame:
    return r6(LogitSharpen().predict(t.panel).select("market_id", "decision_time", "p_model"), "p_model")


@query(
    f"""select event_id, round({X.crps_gaussian_sql('value / 10', '20.0', '4.0')}, 8) as crps, round({X.norm_cdf_sql('(value / 10 - 20.0) / 4.0')}, 9) as cdf,
        round(power(least(value, 100) / 100 - event_id % 2, 2), 8) as brier, round({X.interval_prob_sql('value / 10 - 1', 'value / 10 + 1', '20.0', '4.0', '(case when event_id % 3 = 0 then 19.5 end)')}, 8) as prob from events"""
)
def scores(t: Tables) -> DataFrame:
    e = t.events.withColumn("v", F.col("value") / 10)
    return e.select(
        "event_id", F.round(F.expr(X.crps_gaussian_sql("v", "20.0", "4.0")), 8).alias("crps"), F.round(F.expr(X.norm_cdf_sql("(v - 20.0) / 4.0")), 9).alias("cdf"),
        F.round(X.brier(F.least("value", F.lit(100)) / 100, F.col("event_id") % 2), 8).alias("brier"), F.round(F.expr(X.interval_prob_sql("v - 1", "v + 1", "20.0", "4.0", "(case when event_id % 3 = 0 then 19.5 end)")), 8).alias("prob"),
    )
