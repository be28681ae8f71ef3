"""Queries of market tables, parsing and weather operators over the generic tables, each with its SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsframe.operators.temporal import asof_join
from oddsframe.plans.core import query, r6
from oddsframe.plans.views import Tables
from oddsframe.sources import markets as M
from oddsframe.sources.categories import categorize
from oddsframe.weather import emos, features, model, observations, rules


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_props_parse(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k bigint").k.alias("k"))


@query(
    """, b as (select market_id, event_id, fee_rate, 0 as batch from markets where market_id % 2 = 0 or market_id % 3 = 0 union all select market_id, event_id, fee_rate + 1, 1 from markets where market_id % 2 = 1),
    l as (select *, row_number() over (partition by market_id order by batch desc) as rn from b) select market_id, fee_rate, cast(count(*) over (partition by event_id) as int) as markets_in_event from l where rn = 1""",
    "markets",
)
def market_upsert(t: Tables) -> DataFrame:
    m = t.markets.withColumns({"closed_ts": F.col("end_ts"), "uma_end_ts": F.col("end_ts"), "n_outcomes": F.lit(2), "closed": F.lit(True), "disputed": F.lit(False), "archived_copy": F.lit(False)}).drop("clean", "known_ts")
    old, new = m.where("market_id % 2 = 0 or market_id % 3 = 0"), m.where("market_id % 2 = 1").withColumn("fee_rate", F.col("fee_rate") + 1)
    return M.upsert(old, new).select("market_id", "fee_rate", "markets_in_event")


@query(
    """select market_id, case when neg_risk then 'negrisk' when count(*) over (partition by event_id) > 1 then 'multi_market' else 'binary' end as structure, least(end_ts, created_ts + interval 20 day) as known_ts,
       end_ts - (created_ts + interval 20 day) > interval 1 hour as resolved_early_1h, market_id % 5 <> 0 as clean from markets""",
    "markets",
)
def with_derived(t: Tables) -> DataFrame:
    m = t.markets.withColumns({"closed_ts": F.col("created_ts") + F.expr("interval 20 days"), "uma_end_ts": F.lit(None).cast("timestamp_ntz"), "n_outcomes": F.lit(2), "closed": F.lit(True), "disputed": F.col("market_id") % 5 == 0, "archived_copy": F.lit(False)})
    return M.with_derived(m).select("market_id", "structure", "known_ts", "resolved_early_1h", "clean")


@query("select event_id, case event_type when 'view' then 0 when 'click' then 1 else null end as winner from events")
def winner_index(t: Tables) -> DataFrame:
    text = F.when(F.col("event_type") == "view", '["1","0"]').when(F.col("event_type") == "click", '["0","1"]').when(F.col("event_type") == "error", '["0.5","0.5"]').otherwise("junk")
    return t.events.select("event_id", M.winner_index(text, F.lit(True)).alias("winner"))


@query("select event_id, case when event_type = 'view' then 'crypto' when event_type = 'click' then 'sports' else 'other' end as category from events")
def categorize_tags(t: Tables) -> DataFrame:
    tags = F.when(F.col("event_type") == "view", F.array(F.lit("games"), F.lit("BITCOIN"))).when(F.col("event_type") == "click", F.array(F.lit("NBA"))).otherwise(F.array(F.lit("x")))
    return t.events.select("event_id", categorize(tags).alias("category"))


@query("select event_id, ts from events")
def parse_timestamps(t: Tables) -> DataFrame:
    """Times written in the three forms of the API and read back."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    form = F.when(F.col("event_id") % 3 == 0, F.concat(text, F.lit("Z"))).when(F.col("event_id") % 3 == 1, F.concat(F.replace(text, F.lit("T"), F.lit(" ")), F.lit("+00"))).otherwise(F.concat(text, F.lit("+00:00")))
    return t.events.select("event_id", M.parse_ts(form).cast("timestamp_ntz").alias("ts"))


@query("select r.event_id, r.station_icao, r.minute, coalesce(s.share >= 0.2, false) as is_routine from reports r join (select station_icao, minute, count(*) / sum(count(*)) over (partition by station_icao) as share from reports group by 1, 2) s on s.station_icao = r.station_icao and s.minute = r.minute", "reports")
def flag_routine(t: Tables) -> DataFrame:
    return observations.flag_routine(t.reports.select("event_id", "station_icao", "minute")).select("event_id", "station_icao", "minute", "is_routine")


@query(
    r"""select event_id, cast(case when event_id % 3 = 0 then -(event_id % 40) else event_id % 40 end as double) as temp_c, case when event_id % 4 = 0 then case when event_id % 2 = 1 then -1 else 1 end * (event_id % 400) / 10.0 end as temp_c_precise,
        case event_id % 5 when 0 then 1.5 / 8 when 1 then 6.0 / 8 when 2 then 0.0 when 3 then 8.0 / 8 end as cloud, event_id % 5 = 1 as convective, round(cast((event_id % 30) * case when event_id % 2 = 0 then 1.0 else 1.943844 end as double), 6) as wind_kt from reports""",
    "reports",
)
def decode_reports(t: Tables) -> DataFrame:
    return r6(observations.parse_sky_wind(observations.parse_reports(t.reports)).select("event_id", "temp_c", "temp_c_precise", "cloud", "convective", "wind_kt"), "wind_kt")


@query(
    """select event_id, case event_id % 6 when 0 then null when 1 then null else cast(event_id % 60 as int) end as low,
       cast(case event_id % 6 when 0 then event_id % 60 - 1 when 1 then event_id % 60 when 2 then null when 3 then event_id % 60 + 1 else event_id % 60 end as int) as high from events"""
)
def parse_labels(t: Tables) -> DataFrame:
    n = (F.col("event_id") % 60).cast("string")
    k = F.col("event_id") % 6
    label = F.when(k == 0, F.concat(F.lit("<"), n, F.lit("°F"))).when(k == 1, F.concat(n, F.lit("°C or below"))).when(k == 2, F.concat(n, F.lit("°C or Higher"))).when(k == 3, F.concat(n, F.lit("-"), (F.col("event_id") % 60 + 1).cast("string"), F.lit("°F"))).otherwise(F.concat(n, F.lit("°C")))
    return t.events.select("event_id", rules.parse_label(label).alias("b")).select("event_id", "b.low", "b.high")


@query(
    """, q as (select distinct l_partkey % 20 as station_icao, cast(l_shipdate + interval 17 day as date) as decision_date from lineitem),
    c as (select q.*, r.model, r.init_date, r.fc_max, row_number() over (partition by q.station_icao, q.decision_date, r.model order by r.init_date desc, r.fc_max desc) as rn from q join runs r on r.station_icao = q.station_icao and r.available_date <= q.decision_date and r.init_date > q.decision_date - interval 60 day)
    select station_icao, decision_date, model, init_date, round(fc_max, 4) as fc_max from c where rn = 1""",
    "runs",
)
def latest_available_run(t: Tables) -> DataFrame:
    """The last run by availability, as an as-of join; a run's availability follows its time by a fixed delay."""
    q = t.lineitem.select((F.col("l_partkey") % 20).alias("station_icao"), F.date_add("l_shipdate", 17).alias("decision_date")).distinct()
    q = q.withColumns({"model": F.explode(F.array(*[F.lit(m) for m in features.MODELS])), "at": F.col("decision_date").cast("timestamp")})
    runs = t.runs.select("station_icao", "model", F.col("available_date").cast("timestamp").alias("available"), "init_date", "fc_max")
    out = asof_join(q, runs, ["station_icao", "model"], "at", "available", {"init_date": "init_date", "fc_max": "fc_max"}, tolerance=timedelta(days=54), ties=["init_date", "fc_max"])
    return out.where("init_date is not null").select("station_icao", "decision_date", "model", "init_date", F.round("fc_max", 4).alias("fc_max"))


@query("select station_icao, init_date, max(case when model = 'ecmwf_ifs025' then fc_max end) as fc_max_ecmwf_ifs025, max(case when model = 'gfs_050' then fc_max end) as fc_max_gfs_050 from runs group by 1, 2", "runs")
def pivot_models(t: Tables) -> DataFrame:
    wide = t.runs.groupBy("station_icao", "init_date").pivot("model", features.MODELS).agg(F.max("fc_max").alias("fc_max"))
    return wide.select("station_icao", "init_date", *[F.col(m).alias(f"fc_max_{m}") for m in features.MODELS])


ZONES = ["America/New_York", "Europe/Berlin", "Asia/Tokyo"]


def _stations(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(f"S{i}", ZONES[i % 3]) for i in range(9)], "station_icao string, tz string")


@query(
    """, s as (select distinct station_icao, cast(ts as date) as local_date, case cast(substr(station_icao, 2) as int) % 3 when 0 then 5 when 1 then -1 else -9 end as h from reports)
    select station_icao, local_date, local_date::timestamp + to_hours(h) as day_start_utc, local_date::timestamp + to_hours(h) + interval 1 day as day_end_utc from s""",
    "reports",
)
def local_day_bounds(t: Tables) -> DataFrame:
    keys = t.reports.select("station_icao", F.to_date("ts").alias("local_date")).distinct()
    out = observations.local_day_bounds(keys, _stations(t))
    return out.select("station_icao", "local_date", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("day_start_utc", "day_end_utc")])


def _obs(t: Tables) -> DataFrame:
    return observations.flag_routine(observations.parse_reports(t.reports)).withColumn("obs_time", F.col("ts").cast("timestamp"))


_OBS = """, o as (select station_icao, cast(ts + to_hours(case cast(substr(station_icao, 2) as int) % 3 when 0 then -5 when 1 then 1 else 9 end) as date) as local_date, ts + to_hours(case cast(substr(station_icao, 2) as int) % 3 when 0 then -5 when 1 then 1 else 9 end) as lt, ts,
    cast(case when event_id % 3 = 0 then -(event_id % 40) else event_id % 40 end as double) as c, case when event_id % 4 = 0 then (event_id % 400) / 10.0 end as pr from reports)"""


@query(
    f"""{_OBS} select station_icao, local_date, count(*) as n_obs, max(c) as max_c_int, max(coalesce(pr, c)) as max_c_precise, cast(floor(max(coalesce(pr, c)) * 9 / 5 + 32 + 0.5) as bigint) as max_f_from_precise,
        cast(floor(max(c) * 9 / 5 + 32 + 0.5) as bigint) as max_f_from_int, cast(floor(max(coalesce(pr, c)) * 9 / 5 + 32) as bigint) as max_f_from_precise_floor, cast(floor(max(coalesce(pr, c)) + 0.5) as bigint) as max_c_from_precise from o group by 1, 2""",
    "reports",
)
def settlement_daily(t: Tables) -> DataFrame:
    return observations.build_daily(_obs(t), _stations(t)).select("station_icao", "local_date", "n_obs", "max_c_int", "max_c_precise", "max_f_from_precise", "max_f_from_int", "max_f_from_precise_floor", "max_c_from_precise")


@query(
    f"""{_OBS}, h as (select station_icao, local_date, cast(extract(hour from lt) as int) as h, max(coalesce(pr, c)) as hm, count(*) as n from o group by 1, 2, 3), d as (select station_icao, local_date, max(hm) as y from h group by 1, 2 having sum(n) >= 12),
    f as (select d.*, x.h, h.hm from d cross join range(24) x(h) left join h on h.station_icao = d.station_icao and h.local_date = d.local_date and h.h = x.h)
    select station_icao, local_date, cast(h as int) as h, round(y - max(hm) over (partition by station_icao, local_date order by h), 6) as rise from f""",
    "reports",
)
def day_profile(t: Tables) -> DataFrame:
    local = observations.with_local_date(_obs(t), "obs_time", _stations(t), local_time=True)
    return r6(features.build_day_profile(local).select("station_icao", "local_date", "h", "rise"), "rise")


@query(
    f"""{_OBS}, q as (select distinct station_icao, local_date from o), s as (select q.station_icao, q.local_date, max(coalesce(pr, c)) as obs_max, count(*) as obs_n from q join o on o.station_icao = q.station_icao and o.local_date = q.local_date
        where o.ts + interval 10 minute <= q.local_date::timestamp + interval 14 hour group by 1, 2)
    select q.station_icao, q.local_date, s.obs_max, coalesce(s.obs_n, 0) as obs_n from q left join s on s.station_icao = q.station_icao and s.local_date = q.local_date""",
    "reports",
)
def obs_so_far(t: Tables) -> DataFrame:
    local = observations.with_local_date(_obs(t), "obs_time", _stations(t), local_time=True)
    q = local.select("station_icao", "local_date").distinct().withColumns({"qid": F.xxhash64("station_icao", "local_date"), "decision_time": F.col("local_date").cast("timestamp") + F.expr("interval 14 hours")})
    return features.obs_features(q, local).select("station_icao", "local_date", "obs_max", "obs_n")


@query(
    """, j as (select k.station_icao, k.local_date, t.e * 0.987654321 as y, abs(extract(doy from k.local_date) - extract(doy from t.local_date)) as dd from errors k join errors t on t.station_icao = k.station_icao and t.local_date <= k.local_date - interval 4 day)
    select station_icao, local_date, round(avg(y), 6) as clim_mu, round(stddev_samp(y), 6) as clim_sigma from j where dd <= 15 or dd >= 351 group by 1, 2 having count(*) >= 20""",
    "errors",
)
def clim_baseline(t: Tables) -> DataFrame:
    """All days of all stations, by the operator's own least count. The factor keeps means off the halves that rounding splits."""
    truth = t.errors.select("station_icao", "local_date", (F.col("e") * 0.987654321).alias("y_c"))
    return r6(model.clim_baseline(truth, truth), "clim_mu", "clim_sigma")


@query(
    """select event_id, case when h > 0 and h < 24 and n > 0 then 'intra_' || lpad(cast(cast(floor(lh) as int) as varchar), 2, '0') when h > 0 and h < 24 then 'pre_24' when h >= 24 and h < 36 then 'pre_24' when h >= 36 and h < 48 then 'pre_36' when h >= 48 and h < 60 then 'pre_48' when h >= 60 and h < 200 then 'pre_60' end as hbin,
       case when h >= 48 then 'a: >=48h' when h >= 36 then 'b: 36-48h' when h >= 24 then 'c: 24-36h' when lh < 10 then 'd: day D 00-10' when lh < 16 then 'e: day D 10-16' else 'f: day D 16-24' end as hgroup
       from (select event_id, value - 10 as h, (event_id % 240) / 10.0 as lh, event_id % 3 as n from events)"""
)
def horizon_bins(t: Tables) -> DataFrame:
    h, lh, n = F.col("value") - 10, (F.col("event_id") % 240) / 10.0, F.col("event_id") % 3
    return t.events.select("event_id", emos.horizon_bin(h, lh, n).alias("hbin"), model.horizon_group(h, lh).alias("hgroup"))


@query(
    """select s_suppkey, round(y - floor(y), 6) as fy, round(coalesce(sum(case when land then w * v end) / nullif(sum(case when land then w end), 0), sum(w * v) / sum(w)), 6) as value from (
      select s_suppkey, y, cy, cx, w, cy * 100 + cx as v, (cy + cx) % 2 = 0 as land from (
        select s_suppkey, y, x, unnest([floor(y), floor(y), floor(y) + 1, floor(y) + 1]) as cy, unnest([floor(x) % 40, (floor(x) + 1) % 40, floor(x) % 40, (floor(x) + 1) % 40]) as cx,
               unnest([(1 - (y - floor(y))) * (1 - (x - floor(x))), (1 - (y - floor(y))) * (x - floor(x)), (y - floor(y)) * (1 - (x - floor(x))), (y - floor(y)) * (x - floor(x))]) as w
        from (select s_suppkey, (90.0 - (s_suppkey % 170 - 79.3)) / 9.0 as y, (s_suppkey * 7 % 3600) / 10.0 / 9.0 as x from supplier))) where w > 1e-9 group by s_suppkey, y""",
)
def grid_interpolation(t: Tables) -> DataFrame:
    """Land-masked bilinear means on a 40 x 21 grid."""
    pts = t.supplier.select("s_suppkey", (F.col("s_suppkey") % 170 - F.lit(79.3).cast("double")).alias("lat"), ((F.col("s_suppkey") * 7 % 3600) / 10.0).alias("lon"))
    grid = t.spark.range(21 * 40).select(F.floor(F.col("id") / 40).alias("j"), (F.col("id") % 40).alias("i")).withColumns({"value": (F.col("j") * 100 + F.col("i")).cast("double"), "land": ((F.col("j") + F.col("i")) % 2 == 0).cast("double")})
    out = features.interpolate(pts, grid, 90.0, 0.0, 9.0, 9.0, 40, 21)
    y = (90.0 - F.col("lat")) / 9.0
    return r6(out.select("s_suppkey", (y - F.floor(y)).alias("fy"), "value"), "fy", "value")


