"""Snapshot targets, decision grids, prices at a time, and normalisation within an event."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsframe.functions.exprs import LOOKAHEAD_BUFFER, interval, micros, micros_of, usable
from oddsframe.operators.temporal import asof_join

# Snapshot horizons before the scheduled end, and fractions of a market's life.
DEFAULT_HORIZONS = {"30d": timedelta(days=30), "7d": timedelta(days=7), "1d": timedelta(days=1), "6h": timedelta(hours=6), "1h": timedelta(hours=1)}
LIFE_FRACTIONS = {"life10": 0.1, "life50": 0.5, "life90": 0.9}
MAX_STALE = timedelta(minutes=60)
MAIN_WINDOW, SMALL_WINDOW = timedelta(days=15), timedelta(hours=2)


def _from_micros(x, like: str):
    """Microseconds as a timestamp of the kind that column `like` has."""
    return F.timestamp_micros(x.cast("long")).cast(like)


def snapshot_targets(markets: DataFrame, horizons: dict[str, timedelta] | None = None, life_fractions: dict[str, float] | None = None, buffer: timedelta = LOOKAHEAD_BUFFER) -> DataFrame:
    """(market_id, snapshot, target_ts): a time before the end by horizon, and into the life by fraction, where usable."""
    horizons = DEFAULT_HORIZONS if horizons is None else horizons
    life_fractions = LIFE_FRACTIONS if life_fractions is None else life_fractions
    kind = markets.schema["end_ts"].dataType.simpleString()
    end, start = micros("end_ts"), micros("created_ts")
    rows = [F.struct(F.lit(k).alias("snapshot"), (end - micros_of(h)).alias("us")) for k, h in horizons.items()]
    alive = F.col("created_ts") < F.col("end_ts")
    rows += [F.struct(F.lit(k).alias("snapshot"), F.when(alive, start + F.floor((end - start) * f)).alias("us")) for k, f in life_fractions.items()]
    if not rows:
        return markets.select("market_id", F.lit("").alias("snapshot"), F.col("end_ts").alias("target_ts")).where("false")
    out = markets.where("end_ts is not null").select("market_id", "created_ts", "known_ts", F.explode(F.array(*rows)).alias("x")).where("x.us is not null")
    out = out.select("market_id", "created_ts", "known_ts", "x.snapshot", _from_micros(F.col("x.us"), kind).alias("target_ts"))
    return out.where(usable("target_ts", buffer)).select("market_id", "snapshot", "target_ts")


def decision_grid(markets: DataFrame, every: timedelta = timedelta(hours=1), buffer: timedelta = LOOKAHEAD_BUFFER) -> DataFrame:
    """(event_id, decision_time) at each full step after the event's opening until the last time before its outcome could be known."""
    kind, step = markets.schema["known_ts"].dataType.simpleString(), micros_of(every)
    opening = F.least(F.min("start_ts"), F.min("created_ts"))
    events = markets.groupBy("event_id").agg(micros(opening).alias("t0"), (micros(F.max("known_ts")) - micros_of(buffer)).alias("t1")).dropna()
    events = events.withColumn("t0", F.floor((F.col("t0") + step) / step) * step)
    times = F.when(F.col("t1") >= F.col("t0"), F.sequence(F.col("t0"), F.col("t1"), F.lit(step).cast("long")))
    return events.select("event_id", F.explode(times).alias("us")).select("event_id", _from_micros(F.col("us"), kind).alias("decision_time"))


def market_rows(events: DataFrame, markets: DataFrame, time_col: str = "decision_time", buffer: timedelta = LOOKAHEAD_BUFFER) -> DataFrame:
    """Each (event_id, time) as a row for every market of the event that is usable then."""
    return events.join(markets.select("event_id", "market_id", "created_ts", "known_ts"), "event_id").where(usable(time_col, buffer))


def price_at(rows: DataFrame, prices: DataFrame, time_col: str = "decision_time", max_stale: timedelta = MAX_STALE, chunk: timedelta | int | None = None) -> DataFrame:
    """rows with p and price_ts: the market's last price at or before the time; null if older than max_stale."""
    px = prices.select("market_id", F.col("ts").alias("__ts"), F.col("p").alias("__p"))
    return asof_join(rows, px, ["market_id"], time_col, "__ts", {"price_ts": "__ts", "p": "__p"}, tolerance=max_stale, ties=["__p"], chunk=chunk)


def normalize_event(rows: DataFrame, time_col: str = "decision_time") -> DataFrame:
    """rows with p_sum and q_market; exclusive groups with a missing price are dropped, other rows without one too."""
    group = Window.partitionBy("event_id", time_col)
    neg = F.coalesce("neg_risk", F.lit(False))
    out = rows.withColumns({"__miss": F.max(F.col("p").isNull()).over(group), "__sum": F.sum("p").over(group)})
    out = out.where(F.col("p").isNotNull() & ~(neg & F.col("__miss"))).withColumn("p_sum", F.when(neg, F.col("__sum")).otherwise(F.col("p")))
    share = F.when(neg & (F.col("p_sum") > 0), F.try_divide("p", "p_sum")).otherwise(F.col("p"))
    return out.withColumn("q_market", share).drop("__miss", "__sum")


def overround(rows: DataFrame, time_col: str = "target_ts") -> DataFrame:
    """(event_id, time, sum_p) of exclusive groups whose rows cover every market of the event."""
    g = rows.where("neg_risk").groupBy("event_id", time_col).agg(F.count("*").alias("n"), F.first("markets_in_event").alias("m"), F.coalesce(F.sum("p"), F.lit(0.0)).alias("sum_p"))
    return g.where("n = m").drop("n", "m")


def fetch_windows(markets: DataFrame, targets: DataFrame) -> DataFrame:
    """(market_id, token0, window_start, window_end) that a price connector has to read for the targets: one main window before the end
    for recent targets, a small one for each older target."""
    end = F.least("end_ts", "closed_ts")
    m = markets.where("token0 is not null").select("market_id", "token0", end.alias("main_end")).withColumn("main_start", F.col("main_end") - interval(MAIN_WINDOW))
    j = targets.select("market_id", "target_ts").join(m, "market_id")
    recent = F.col("target_ts") >= F.col("main_start")
    start = F.when(recent, F.col("main_start")).otherwise(F.col("target_ts") - interval(SMALL_WINDOW))
    return j.select("market_id", "token0", start.alias("window_start"), F.when(recent, F.col("main_end")).otherwise(F.col("target_ts")).alias("window_end")).distinct()
