"""Structured Streaming forms of the batch notions of availability, staleness and volume around a time.

These go beyond the batch operators: they read growing folders (or any stream) of prices, trades and observations.
"""

from __future__ import annotations

from bisect import bisect_right
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from oddsframe.functions.exprs import interval, micros_of
from oddsframe.schemas import PRICES, TRADES


def _text(d: timedelta) -> str:
    return f"{micros_of(d)} microseconds"


def read_prices(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(PRICES).option("maxFilesPerTrigger", max_files).parquet(path)


def read_trades(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(TRADES).option("maxFilesPerTrigger", max_files).parquet(path)


def rolling_volume(trades: DataFrame, window: timedelta = timedelta(minutes=60), slide: timedelta = timedelta(minutes=5), late: timedelta = timedelta(minutes=10)) -> DataFrame:
    """(market_id, window_end, shares, prints) over sliding windows; prints later than the watermark are dropped."""
    g = trades.withWatermark("ts", _text(late)).groupBy("market_id", F.window("ts", _text(window), _text(slide)))
    return g.agg(F.sum("size").alias("shares"), F.count("*").alias("prints")).select("market_id", F.col("window.end").alias("window_end"), "shares", "prints")


def available_observations(obs: DataFrame, lag: timedelta = timedelta(minutes=10)) -> DataFrame:
    """Observations with usable_from = obs_time + lag as the event time of what follows."""
    return obs.withColumn("usable_from", F.col("obs_time") + interval(lag)).withWatermark("usable_from", _text(lag))


def running_day_max(obs: DataFrame, lag: timedelta = timedelta(minutes=10)) -> DataFrame:
    """(station_icao, local_date, obs_max, obs_n) so far, from available observations."""
    rows = available_observations(obs, lag).withColumn("v", F.coalesce("temp_c_precise", "temp_c")).where("v is not null")
    return rows.groupBy("station_icao", "local_date").agg(F.max("v").alias("obs_max"), F.count("*").alias("obs_n"))


def volume_near(probes: DataFrame, trades: DataFrame, window: timedelta = timedelta(minutes=60), late: timedelta = timedelta(minutes=10)) -> DataFrame:
    """(market_id, decision_time, vol_window, traded_near) of streamed distinct probes: the shares printed in (t - window, t + window], once no more can come.

    A stream-stream join on the interval, with a watermark on either side: each side's rows are kept until the other's watermark has passed the interval, so the state
    is what came within window and lateness. A probe without prints comes out with 0."""
    a = probes.select("market_id", "decision_time").withWatermark("decision_time", _text(late))
    b = trades.select(F.col("market_id").alias("__market"), F.col("ts").alias("__ts"), F.col("size").alias("__size")).withWatermark("__ts", _text(late))
    near = (F.col("__ts") > F.col("decision_time") - interval(window)) & (F.col("__ts") <= F.col("decision_time") + interval(window))
    sums = a.join(b, (F.col("market_id") == F.col("__market")) & near, "left_outer").groupBy("market_id", "decision_time").agg(F.coalesce(F.sum("__size"), F.lit(0.0)).alias("vol_window"))
    return sums.withColumn("traded_near", F.col("vol_window") > 0)


_TIME = "t long"


class _LastPrice(StatefulProcessor):
    """A market's prices and open probes, each in a map by time. A probe waits for a timer behind which no row of its time or before can come; prices go once no
    probe can be so near to them, at the latest by a timer of their own."""

    def __init__(self, stale: int):
        self.stale = stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.prices, self.probes = handle.getMapState("prices", _TIME, "p double"), handle.getMapState("probes", _TIME, "n int")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        mark, latest = timerValues.getCurrentWatermarkInMs(), None
        for f in rows:
            for t, p, side in zip(f["t"], f["p"], f["side"], strict=True):
                at = int(t.value // 1000)
                if side:
                    self.probes.updateValue((at,), ((self.probes.getValue((at,)) or (0,))[0] + 1,))
                    self.handle.registerTimer(max(at // 1000, mark) + 1)
                elif p is not None and p == p:
                    known = self.prices.getValue((at,))
                    if known is None or known[0] < p:  # of prices at one time the highest stands, as in price_at
                        self.prices.updateValue((at,), (float(p),))
                    latest = max(at, latest or at)
        if latest is not None:
            self.handle.registerTimer(max((latest + self.stale) // 1000, mark) + 1)
        self._forget(mark)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        due = sorted(k[0] for k in self.probes.keys() if k[0] // 1000 < mark)  # noqa: SIM118
        out = []
        if due:
            known = sorted((k[0], v[0]) for k, v in self.prices.iterator())
            times = [t for t, _ in known]
            for t in due:
                at = bisect_right(times, t) - 1
                price = known[at] if at >= 0 and t - times[at] <= self.stale else None
                out += [(key[0], pd.Timestamp(t, unit="us"), price and price[1], pd.Timestamp(price[0], unit="us") if price else pd.NaT)] * self.probes.getValue((t,))[0]
                self.probes.removeKey((t,))
        self._forget(mark)
        return iter([pd.DataFrame(out, columns=["market_id", "decision_time", "p", "price_ts"])] if out else [])

    def _forget(self, mark: int) -> None:
        open_ = min((k[0] for k in self.probes.keys()), default=mark * 1000)  # noqa: SIM118
        for k in [k for k in self.prices.keys() if k[0] < min(open_, mark * 1000) - self.stale]:  # noqa: SIM118
            self.prices.removeKey(k)

    def close(self) -> None:
        pass


def last_price(prices: DataFrame, probes: DataFrame, max_stale: timedelta = timedelta(minutes=60), late: timedelta = timedelta(minutes=10)) -> DataFrame:
    """(market_id, decision_time, p, price_ts) of streamed probes: the last price at or before each, null if older than max_stale.

    Keyed state in maps with event-time timers; it needs, and sets, the RocksDB state store, whose maps are read by key and saved as changes. A market's state is
    at most its rows within max_stale and the lateness allowed; nothing is left of a market that has gone quiet. Rows later than that are dropped."""
    prices.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    a = prices.select("market_id", F.col("ts").alias("t"), "p", F.lit(0).alias("side"))
    b = probes.select("market_id", F.col("decision_time").alias("t"), F.lit(None).cast("double").alias("p"), F.lit(1).alias("side"))
    both = a.unionByName(b).withWatermark("t", _text(late))
    return both.groupBy("market_id").transformWithStateInPandas(_LastPrice(micros_of(max_stale)), "market_id string, decision_time timestamp, p double, price_ts timestamp", "append", "EventTime")
