"""Taker cost against the mid, and fills against real prints."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsframe.functions.exprs import band, clip, micros
from oddsframe.operators.temporal import asof_join, forward_join, range_sum


def outcome0_view(trades: DataFrame) -> DataFrame:
    """Trades in terms of outcome 0: its price px0, if the taker gained exposure to it (buys0), and the notional paid (usd)."""
    first = F.col("outcome_index") == 0
    return trades.withColumns({"px0": F.when(first, F.col("price")).otherwise(1 - F.col("price")), "buys0": (F.col("side") == "BUY") == first, "usd": F.col("size") * F.col("price")})


def trade_costs(trades: DataFrame, mids: DataFrame, tolerance: timedelta = timedelta(minutes=5), chunk: timedelta | int | None = None) -> DataFrame:
    """Trades that have a mid within the tolerance before them, with mid and signed cost (positive: worse than mid)."""
    px = mids.select("market_id", F.col("ts").alias("__ts"), F.col("p").alias("__p"))
    j = asof_join(trades, px, ["market_id"], "ts", "__ts", {"mid": "__p"}, tolerance=tolerance, ties=["__p"], chunk=chunk).where("mid is not null")
    return j.withColumn("cost", F.when(F.col("buys0"), F.col("px0") - F.col("mid")).otherwise(F.col("mid") - F.col("px0")))


def cost_table(costs: DataFrame, by: list[str] | None = None, edges: list[float] | None = None) -> DataFrame:
    """Count, median, mean, 75th percentile of cost and shares, by price band of the mid and more keys."""
    keys = [*(by or []), "band"]
    rows = costs.withColumn("band", band("mid", edges))
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.median("cost").alias("median_cost"), F.avg("cost").alias("mean_cost"), F.coalesce(F.sum("size"), F.lit(0.0)).alias("shares"))
    p75 = quantile_by(rows, keys, "cost", 0.75, "p75_cost")
    out = g.join(p75, [g[k].eqNullSafe(p75[k]) for k in keys], "left").select(*[g[k] for k in keys], "n", "median_cost", "mean_cost", "p75_cost", "shares")
    return out.orderBy(*(by or []), F.split("band", "-")[0].cast("double"))


def quantile_by(rows: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """(keys, name): the value of rank round(q * (n - 1)) in each group, by counts of distinct values rather than a list of them."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    group = Window.partitionBy(*keys)
    upto = F.sum("__n").over(group.orderBy(value))
    ranked = counts.withColumns({"__upto": upto, "__all": F.sum("__n").over(group)})
    return ranked.where(F.col("__upto") > F.floor(F.lit(q) * (F.col("__all") - 1) + 0.5)).groupBy(*keys).agg(F.min(value).alias(name))


def attach_cost(rows: DataFrame, table: DataFrame, stat: str = "median_cost", price_col: str = "p", by: list[str] | None = None, default: float = 0.02, edges: list[float] | None = None) -> DataFrame:
    """rows with band and cost: that of the keyed cell, else the median over the band's cells, else the default; at least 0."""
    keys = [*(by or []), "band"]
    pooled = table.groupBy("band").agg(F.median(stat).alias("__pooled"))
    out = rows.withColumn("band", band(price_col, edges)).join(table.select(*keys, F.col(stat).alias("__cell")), keys, "left").join(pooled, "band", "left")
    cost = F.coalesce("__cell", "__pooled", F.lit(default))
    return out.select(*[c for c in rows.columns if c not in ("band", "cost")], "band", clip(cost, 0.0).alias("cost"))


def window_volume(rows: DataFrame, trades: DataFrame, window: timedelta = timedelta(minutes=60), time_col: str = "decision_time") -> DataFrame:
    """rows with vol_window, the shares printed in (t - window, t + window], and traded_near."""
    keys = rows.select("market_id", time_col).distinct()
    sums = range_sum(keys, trades, "market_id", time_col, "ts", "size", -window, window)
    out = rows.join(sums, ["market_id", time_col], "left").withColumn("vol_window", F.coalesce("__sum", F.lit(0.0))).drop("__sum")
    return out.select(*rows.columns, "vol_window", (F.col("vol_window") > 0).alias("traded_near"))


def first_print(rows: DataFrame, trades: DataFrame, window: timedelta = timedelta(minutes=60), time_col: str = "decision_time", limit_col: str | None = None) -> DataFrame:
    """rows (market_id, time, side) with the first same-side print in (t, t + window]: print_px, print_ts, print_usd (all of them), and
    with a limit the fillable_usd and fillable_shares at or below it. Null where there is no print."""
    keys = ["market_id", time_col, "side", *([limit_col] if limit_col else [])]
    probes = rows.select(*keys).distinct().withColumn("__row", F.struct(*keys))
    tape = trades.select("market_id", F.col("ts").alias("__ts"), F.col("px0").alias("__px0"), F.col("buys0").alias("__buys0"), F.col("size").alias("__size"))
    j = forward_join(probes, tape, "market_id", time_col, "__ts", window, F.col("__buys0") == (F.col("side") == "YES"))
    px = F.when(F.col("side") == "YES", F.col("__px0")).otherwise(1 - F.col("__px0"))
    j = j.withColumn("__px", px)
    first = F.min(F.struct("__ts", "__px"))
    aggs = [first.alias("__first"), F.coalesce(F.sum(F.col("__px") * F.col("__size")), F.lit(0.0)).alias("print_usd")]
    if limit_col:
        ok = F.col("__px") <= F.col(limit_col)
        aggs += [F.coalesce(F.sum(F.when(ok, F.col("__px") * F.col("__size"))), F.lit(0.0)).alias("fillable_usd"), F.coalesce(F.sum(F.when(ok, F.col("__size"))), F.lit(0.0)).alias("fillable_shares")]
    found = j.groupBy("__row").agg(*aggs).select("__row.*", F.col("__first.__px").alias("print_px"), F.col("__first.__ts").alias("print_ts"), "print_usd", *(["fillable_usd", "fillable_shares"] if limit_col else []))
    out = rows.join(found, keys, "left")
    return out.select(*rows.columns, *[c for c in found.columns if c not in keys])


def reaction_minutes(events: DataFrame, mids: DataFrame, move: float = 0.05, horizon: timedelta = timedelta(hours=6)) -> DataFrame:
    """events (market_id, t0, winner) with reaction_min: minutes until the mid first moved by more than `move` toward the outcome."""
    px = mids.select("market_id", F.col("ts").alias("__ts"), F.col("p").alias("__p"))
    ref = asof_join(events.select("market_id", "t0", "winner").distinct(), px, ["market_id"], "t0", "__ts", {"__p0": "__p"}, ties=["__p"])
    toward = F.when(F.col("winner") == 0, F.col("__p") - F.col("__p0")).otherwise(F.col("__p0") - F.col("__p"))
    hit = forward_join(ref, px, "market_id", "t0", "__ts", horizon, toward > move).groupBy("market_id", "t0").agg(F.min("__ts").alias("__first"))
    out = events.join(hit, ["market_id", "t0"], "left")
    seconds = F.floor((micros("__first") - micros("t0")) / 1_000_000)
    return out.select(*events.columns, (seconds / 60.0).alias("reaction_min"))
