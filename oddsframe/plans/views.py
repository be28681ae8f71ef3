"""Domain tables made from the generic ones, by SQL text that Spark and the oracle's engine both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[list[str], str]] = {
    "mids": (["events"], "select user_id as market_id, ts, round(least(greatest(value / 100.0, 0.01), 0.99), 4) as p from events where event_type in ('view', 'click')"),
    "raw_trades": (
        ["events"],
        """select event_id as trade_id, user_id as market_id, ts, case when event_id % 2 = 0 then 'BUY' else 'SELL' end as side,
           cast(floor(event_id / 2) as bigint) % 2 as outcome_index, round(least(greatest(value / 100.0, 0.01), 0.99), 4) as price, value as size
           from events where event_type in ('purchase', 'signup')""",
    ),
    "trades": (
        ["raw_trades"],
        """select *, case when outcome_index = 0 then price else 1 - price end as px0, (side = 'BUY') = (outcome_index = 0) as buys0, size * price as usd from raw_trades""",
    ),
    "probes": (["events"], "select distinct user_id as market_id, ts as decision_time from events where event_type = 'error'"),
    "markets": (
        ["events"],
        """select user_id as market_id, cast(floor(user_id / 3) as bigint) as event_id, cast(floor(user_id / 3) as bigint) % 2 = 0 as neg_risk,
           concat('c', cast(user_id % 5 as varchar(9))) as category, min(ts) as created_ts, min(ts) as start_ts, max(ts) as end_ts,
           case when user_id % 4 = 1 then max(ts) - interval '1' day else max(ts) end as known_ts, user_id % 2 as winner, cast(0.01 * (user_id % 4) as double) as fee_rate,
           user_id % 3 <> 0 as fees_enabled, 1.0 as fee_exponent, user_id % 7 <> 0 as clean, concat('s', cast(user_id % 11 as varchar(9))) as series_slug from events group by user_id""",
    ),
    #: Event-day prices of markets, some missing; the table that normalisation works on.
    "daily": (
        ["mids", "markets"],
        """select m.event_id, m.market_id, m.neg_risk, m.category, m.winner, m.series_slug, date_trunc('day', x.ts) as decision_time,
           case when count(*) % 4 = 3 then null else min(x.p) end as p
           from mids x join markets m on x.market_id = m.market_id group by m.event_id, m.market_id, m.neg_risk, m.category, m.winner, m.series_slug, date_trunc('day', x.ts)""",
    ),
    #: Calibration rows: price, outcome, category, band, snapshot.
    "cells_in": (
        ["mids", "markets"],
        """select m.event_id, m.market_id, m.category, case when x.p < 0.2 then '0-20' when x.p < 0.5 then '20-50' else '50-100' end as band,
           case when extract(day from x.ts) < 11 then '7d' else '1d' end as snapshot, x.p, case when m.winner = 0 then 1 else 0 end as y, m.fees_enabled, m.fee_rate
           from mids x join markets m on x.market_id = m.market_id""",
    ),
    #: A decision panel for the simulation.
    "panel": (
        ["mids", "markets"],
        """select m.event_id, m.market_id, x.ts as decision_time, cast(x.ts as date) as day, x.p, round(least(greatest(x.p + ((x.market_id * 7 + extract(day from x.ts)) % 11 - 5) / 20.0, 0.02), 0.98), 4) as p_model,
           m.winner, m.fees_enabled, m.fee_rate, m.fee_exponent, m.category, 50.0 + (x.market_id % 13) * 40 as vol_window, (x.market_id + cast(extract(day from x.ts) as bigint)) % 5 <> 0 as traded_near
           from mids x join markets m on x.market_id = m.market_id""",
    ),
    #: Orders as a daily error series of a forecast model.
    "errors": (
        ["orders"],
        """select o_custkey % 50 as station_icao, o_custkey % 2 as model, o_orderdate as local_date, avg(o_totalprice) / 1000.0 as e from orders group by o_custkey % 50, o_custkey % 2, o_orderdate""",
    ),
    #: Forecast runs with availability, from line items.
    "runs": (
        ["lineitem"],
        """select l_partkey % 20 as station_icao, case when l_linenumber % 2 = 0 then 'gfs_050' else 'ecmwf_ifs025' end as model, l_shipdate as init_date, cast(l_shipdate + interval '5' day as date) as available_date, max(l_quantity) as fc_max
           from lineitem group by l_partkey % 20, case when l_linenumber % 2 = 0 then 'gfs_050' else 'ecmwf_ifs025' end, l_shipdate""",
    ),
    #: Report texts built from values.
    "reports": (
        ["events"],
        """select event_id, concat('S', cast(user_id % 9 as varchar(9))) as station_icao, ts, cast(extract(minute from ts) as int) % 6 * 10 as minute,
           concat('KXXX 0100Z ', lpad(cast(cast(floor(value) as bigint) % 360 as varchar(9)), 3, '0'), lpad(cast(event_id % 30 as varchar(9)), 2, '0'), case when event_id % 2 = 0 then 'KT' else 'MPS' end, ' 9999 ',
                  case event_id % 5 when 0 then 'FEW030' when 1 then 'BKN020CB' when 2 then 'CAVOK' when 3 then 'SCT025 OVC040' else 'NOSIG' end, ' ',
                  case when event_id % 3 = 0 then 'M' else '' end, lpad(cast(event_id % 40 as varchar(9)), 2, '0'), '/05 Q1013',
                  case when event_id % 4 = 0 then concat(' RMK AO2 T', cast(event_id % 2 as varchar(9)), lpad(cast(event_id % 400 as varchar(9)), 3, '0'), '0050') else '' end) as metar
           from events""",
    ),
}


def expand(names: list[str]) -> list[str]:
    """The views with what they rest on, each after what it needs."""
    out: list[str] = []
    for n in names:
        if n in VIEWS:
            out += [x for x in [*expand(VIEWS[n][0]), n] if x not in out]
    return out


def oracle(sql: str, *names: str) -> str:
    """The query with the views it reads before it."""
    parts = [f"{n} as ({VIEWS[n][1]})" for n in expand(list(names))]
    body = sql.strip()
    more = body.startswith(",")  # the query's own named tables follow the views
    return f"with {', '.join(parts)}{'' if more else ' '}{body}" if parts else f"with {body[1:]}" if more else body


class Tables:
    """Generic tables and domain views of one folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        needs, sql = VIEWS[name]
        for n in needs:
            getattr(self, n).createOrReplaceTempView(n)
        return self.spark.sql(sql)
