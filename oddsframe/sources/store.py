"""Stored tables: markets, prices and trades as Parquet, the last two in buckets of events."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsframe.operators.execution import outcome0_view
from oddsframe.schemas import PRICES, TRADES, names
from oddsframe.sources.markets import last_rows, with_derived
from oddsframe.sources.table import Table


class Store:
    """Tables under one root that Spark can reach; no local file is opened."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def table(self, name: str) -> Table:
        """A table of versions; markets are keyed, so that merges rewrite only the buckets they touch, and so are prices and trades, by event. Folders by event of former stores are read too."""
        key = {"markets": "market_id"} | dict.fromkeys(_ROWS, "event_id")
        return Table(self.spark, f"{self.root}/{name}", key.get(name), schema=_ROWS.get(name))

    def load_markets(self) -> DataFrame:
        """All markets. What is derived from an event's markets together is made anew, and only if it is used."""
        table = self.table("markets")
        if not table.exists():
            raise FileNotFoundError(f"no market table at {table.path}: fetch markets first")
        return with_derived(table.read())

    def save_markets(self, new: DataFrame) -> DataFrame:
        """Upsert by market_id; the stored table. Readers see the table before or after, whole, and writers at once lose nothing of each other."""
        self.table("markets").merge(new, last_rows)
        return self.load_markets()

    def _load(self, kind: str, event_ids: Iterable[str] | DataFrame | None) -> DataFrame:
        table = self.table(kind)
        df = table.read(keys=event_ids) if table.exists() else self.spark.createDataFrame([], _ROWS[kind])
        return df.where("ts is not null")  # a row without a time marks an event that has none

    def load_prices(self, event_ids: Iterable[str] | DataFrame | None = None) -> DataFrame:
        """Prices of events (all by default); buckets that hold other events alone aren't read."""
        return self._load("prices", event_ids)

    def load_trades(self, event_ids: Iterable[str] | DataFrame | None = None) -> DataFrame:
        """Taker trades of events in terms of outcome 0."""
        return outcome0_view(self._load("trades", event_ids))

    def partitions(self, kind: str, columns: list[str]) -> DataFrame:
        """The values of partition columns that a stored table has, as strings, from its folders' names: no data file is read. Prices and trades lie in buckets; their events are read."""
        if kind in _ROWS and self.table(kind).version():
            return self.table(kind).read().select(*columns).distinct()
        fs, pattern = self._fs(f"{self.root}/{kind}" + "".join(f"/{c}=*" for c in columns))
        unquote = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        names = [x.getPath().toString().rsplit("/", len(columns))[1:] for x in fs.globStatus(pattern) or []]
        return self.spark.createDataFrame([tuple(unquote(n.partition("=")[2]) for n in row) for row in names], ", ".join(f"{c} string" for c in columns))

    def ledger(self) -> DataFrame:
        """(kind, event_id, n_rows, ok, at): a row for each attempt to fetch an event, appended after its rows are stored."""
        path = f"{self.root}/ledger"
        return self.spark.read.schema(LEDGER).parquet(path) if self.exists(path) else self.spark.createDataFrame([], LEDGER)

    def stored_event_ids(self, kind: str) -> DataFrame:
        """(event_id) of events whose prices or trades were fetched, also if there were none, from the ledger; from the folders' names where rows came before it."""
        done = self.ledger().where(F.col("ok") & (F.col("kind") == kind)).select("event_id").distinct()
        return done if self.exists(f"{self.root}/ledger") else self.partitions(kind, ["event_id"])

    def append(self, kind: str, rows: DataFrame, replace: bool = False) -> None:
        """Store rows in buckets of events, then enter the events in the ledger; rows with failed set aren't stored, but counted as attempts. replace: what an event had
        before goes, so that one whose writer died before the entry can be fetched again."""
        rows = rows.withColumn("event_id", F.col("event_id").cast("string"))
        rows = (rows if "failed" in rows.columns else rows.withColumn("failed", F.lit(False))).persist()  # fetched once, used twice
        self.table(kind).add(rows.where("not failed").drop("failed"), replace)
        tried = rows.groupBy("event_id").agg(F.count("ts").alias("n_rows"), (~F.bool_or("failed")).alias("ok"))
        tried.select(F.lit(kind).alias("kind"), "event_id", "n_rows", "ok", F.current_timestamp().alias("at")).write.mode("append").parquet(f"{self.root}/ledger")
        rows.unpersist()

    def download(self, kind: str, todo: DataFrame, fetch: Callable[[pd.DataFrame], pd.DataFrame], workers: int | None = None) -> dict[str, int]:
        """Fetch what isn't stored yet, by event, on the executors; run it again to go on. fetch maps the rows of one event to its prices or
        trades and may fail: such events are counted and tried again the next time. An event without any rows is done. Resuming reads the ledger, no prices or trades."""
        schema = PRICES if kind == "prices" else TRADES
        left = todo.join(self.stored_event_ids(kind), "event_id", "left_anti")
        asked = todo.select("event_id").distinct().persist()
        n, before = asked.count(), asked.join(self.stored_event_ids(kind), "event_id", "left_anti").count()
        dealt = left.repartition(workers, "event_id") if workers else left.repartition("event_id")
        self.append(kind, dealt.sortWithinPartitions("event_id").mapInPandas(_fetching(fetch, [*names(schema), "failed"]), f"{schema}, failed boolean"), replace=True)
        failed = missing_events(asked, self.stored_event_ids(kind)).count()
        asked.unpersist()
        return {"events": n, "fetched": before - failed, "failed": failed, "skipped": n - before}


#: Rows from which on what was fetched is given on, those of many events at once: a frame an event costs more than the rows that most events have.
FRAME = 10_000


def _events(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each event, from frames that are sorted by it; an event's rows may lie in several."""
    whole = lambda parts: (parts[0] if len(parts) == 1 else pd.concat(parts)).reset_index(drop=True)
    held: list[pd.DataFrame] = []
    for pdf in frames:
        ids = pdf["event_id"]
        cuts = [0, *(np.flatnonzero(np.diff(pd.factorize(ids)[0])) + 1), len(pdf)] if len(pdf) else []
        for start, end in pairwise(cuts):
            if held and (start or not pd.Series([held[-1]["event_id"].iloc[-1]]).equals(pd.Series([ids.iloc[0]]))):
                yield whole(held)
                held = []
            held.append(pdf.iloc[start:end])
    if held:
        yield whole(held)


def _fetching(fetch: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What download maps over rows sorted by event: fetch, event by event. An event that fails or has no rows is marked by one row without a time."""

    def put(got: list[tuple], marks: list[tuple]) -> Iterator[pd.DataFrame]:
        for _, alike in groupby(got, lambda g: (list(g[1].columns), list(g[1].dtypes))):  # so that putting them together changes no value
            events, found = zip(*alike, strict=True)
            ids = np.repeat(np.array(events, dtype=object), [len(f) for f in found])
            yield pd.concat(found, ignore_index=True).assign(event_id=ids, failed=False).reindex(columns=columns)
        if marks:
            known = dict(zip(("event_id", "failed"), zip(*marks, strict=True), strict=True))
            yield pd.DataFrame({c: pd.Series(known.get(c, [None] * len(marks)), dtype=object) for c in columns})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got, marks, rows = [], [], 0
        for pdf in _events(frames):
            event, found, failed = pdf["event_id"].iloc[0], (), False
            try:
                found = fetch(pdf)
            except (OSError, ValueError, KeyError):
                failed = True
            if len(found):
                got.append((event, found))
            else:
                marks.append((event, failed))
            rows += max(1, len(found))
            if rows >= FRAME:
                yield from put(got, marks)
                got, marks, rows = [], [], 0
        yield from put(got, marks)

    return run


#: Tables of rows by event.
_ROWS = {"prices": PRICES, "trades": TRADES}

#: Columns of the ledger.
LEDGER = "kind string, event_id string, n_rows long, ok boolean, at timestamp"


def missing_events(markets: DataFrame, stored: DataFrame) -> DataFrame:
    """(event_id) of markets that aren't stored."""
    return markets.select("event_id").distinct().join(stored, "event_id", "left_anti")


def complete_events(*ids: DataFrame) -> DataFrame:
    """(event_id) that every one of the tables has."""
    out = ids[0].select("event_id").distinct()
    for other in ids[1:]:
        out = out.join(other.select("event_id").distinct(), "event_id", "left_semi")
    return out


def windows(start: pd.Timestamp, end: pd.Timestamp, step: pd.Timedelta) -> Iterator[tuple[pd.Timestamp, pd.Timestamp]]:
    """[start, end] cut into windows of at most step."""
    while start < end:
        yield start, min(start + step, end)
        start = min(start + step, end)


