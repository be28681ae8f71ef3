"""Tables of versions: what readers see while writers write, race and die."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from oddsframe.sources.markets import last_rows
from oddsframe.sources.store import Store
from oddsframe.sources.table import BUCKETS, Table


def table(spark, path, buckets=4):
    return Table(spark, f"{path}/t", "market_id", buckets)


def rows(spark, text, value):
    return spark.createDataFrame([(k, value) for k in text], "market_id string, x long")


def held(t):
    return {r.market_id: r.x for r in t.read().collect()}


class Died(Exception):
    pass


def dies(*_, **__):
    raise Died


def test_merges_rewrite_only_what_they_touch(spark, tmp_path):
    t = table(spark, tmp_path, 8)
    t.merge(rows(spark, "abcdefghij", 1), last_rows)
    before = t.manifest(1)["folders"]
    t.merge(rows(spark, "a", 2), last_rows)
    after = t.manifest(2)["folders"]
    changed = [b for b in after if after[b] != before.get(b)]
    assert len(changed) == 1 and set(before) == set(after) and len(before) > 3
    assert held(t) == dict.fromkeys("bcdefghij", 1) | {"a": 2}
    assert {r.market_id: r.x for r in t.read(1).collect()} == dict.fromkeys("abcdefghij", 1)


def test_a_writer_that_dies_at_any_step_leaves_the_version_before(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.merge(rows(spark, "abc", 1), last_rows)
    plain, calls = Table._write, []

    def second_write_dies(self, df):
        calls.append(1)
        return plain(self, df) if len(calls) % 2 else dies()

    steps = {"_write": [dies, second_write_dies], "_commit": [dies], "_merge_into": [dies]}
    for name, deaths in steps.items():
        for death in deaths:
            with monkeypatch.context() as m, pytest.raises(Died):
                m.setattr(Table, name, death)
                m.setattr(Table, "_forget", lambda *_: None)  # nor does it clean up
                t.merge(rows(spark, "ad", 9), last_rows)
            assert held(t) == dict.fromkeys("abc", 1) and t.version() == 1

    class Torn:
        """A file system whose files of manifests can't be finished."""

        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def create(self, *a):
            self.fs.create(*a).close()
            raise Died

    with monkeypatch.context() as m, pytest.raises(Died):
        m.setattr(t, "fs", Torn(t.fs))
        t.merge(rows(spark, "ad", 9), last_rows)
    assert held(t) == dict.fromkeys("abc", 1)
    t.merge(rows(spark, "ad", 2), last_rows)
    assert held(t) == {"a": 2, "b": 1, "c": 1, "d": 2}
    with monkeypatch.context() as m, pytest.raises(Died):  # after the commit the new version is there, cleaned up or not
        m.setattr(Table, "_forget", dies)
        t.merge(rows(spark, "e", 3), last_rows)
    assert held(t) == {"a": 2, "b": 1, "c": 1, "d": 2, "e": 3}
    assert t.vacuum(timedelta(seconds=-60)) > 5 and held(t) == {"a": 2, "b": 1, "c": 1, "d": 2, "e": 3}


def test_writers_at_once_lose_nothing(spark, tmp_path, monkeypatch):
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    t.merge(rows(spark, "ab", 1), last_rows)
    plain, raced = Table._commit, []

    def late(self, version, manifest):
        if not raced:
            raced.append(1)
            other.merge(rows(spark, "bc", 2), last_rows)
        return plain(self, version, manifest)

    with monkeypatch.context() as m:
        m.setattr(Table, "_commit", late)
        t.merge(rows(spark, "ad", 3), last_rows)
    assert held(t) == {"a": 3, "b": 2, "c": 2, "d": 3} and t.version() == 3
    monkeypatch.setattr(Table, "_commit", lambda *_: False)
    with pytest.raises(OSError, match="other writers"):
        t.merge(rows(spark, "z", 1), last_rows, attempts=2)


def test_readers_keep_the_version_they_found(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/u")
    t.replace(spark.range(3))
    found = t.read()
    t.replace(spark.range(5))
    assert found.count() == 3 and t.read().count() == 5 and t.vacuum() == 0 and found.count() == 3
    assert t.vacuum(timedelta(seconds=-60)) == 1 and t.version() == 2 and t.read().count() == 5


def test_columns_keys_and_empty_tables(spark, tmp_path):
    t = table(spark, tmp_path)
    assert not t.exists()
    with pytest.raises(FileNotFoundError):
        t.read()
    t.merge(rows(spark, "", 0), last_rows)
    assert t.exists() and t.read().columns == ["market_id", "x"] and t.read().count() == 0
    t.merge(spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "market_id string, x long").coalesce(1), last_rows)
    assert held(t) == {None: 2, "a": 1}
    t.merge(spark.createDataFrame([("b", 5, "n", "__")], "market_id string, x int, `odd.name` string, bucket string"), last_rows)
    got = {r.market_id: r for r in t.read().collect()}
    assert dict(t.read().dtypes)["x"] == "bigint" and got["b"]["odd.name"] == "n" and got["a"]["odd.name"] is None and len(got) == 3
    with pytest.raises(ValueError, match="without a key"):
        Table(spark, f"{tmp_path}/v").merge(rows(spark, "a", 1), last_rows)


def test_new_rows_are_run_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            runs.add(len(f))
            yield f

    table(spark, tmp_path).merge(rows(spark, "abc", 1).mapInPandas(count, "market_id string, x long"), last_rows)
    assert runs.value == 3


def test_a_folder_of_files_becomes_a_table(spark, tmp_path):
    rows(spark, "abc", 1).withColumn("clean", F.lit(True)).write.parquet(f"{tmp_path}/t")
    t = table(spark, tmp_path)
    assert t.exists() and t.version() == 0 and len(held(t)) == 3
    t.merge(rows(spark, "c", 2), last_rows)
    assert held(t) == {"a": 1, "b": 1, "c": 2}
    again = Table(spark, f"{tmp_path}/t", "market_id", 16)  # other buckets: all rows are dealt anew
    again.merge(rows(spark, "d", 2), last_rows)
    assert held(again) == {"a": 1, "b": 1, "c": 2, "d": 2} and again.manifest(2)["buckets"] == 16


PRICE = "event_id string, market_id string, ts timestamp, p double"


def prices(spark, events, p=0.5, tasks=1):
    made = spark.createDataFrame([(e,) for e in events], "event_id string").repartition(tasks)
    return made.select("event_id", F.lit("m").alias("market_id"), F.lit("2026-01-01").cast("timestamp").alias("ts"), F.lit(p).alias("p"))


def test_files_of_stored_prices_do_not_grow_with_events_or_tasks(spark, tmp_path):
    store, ids = Store(spark, f"{tmp_path}/s"), [f"{k:03d}" for k in range(400)]
    spread = [e for e in ids for _ in range(3)]
    store.append("prices", prices(spark, spread, tasks=7))
    store.append("prices", prices(spark, ["400", None, ""], 0.7))
    files = list((tmp_path / "s/prices").rglob("*.parquet"))
    assert len(files) <= 2 * BUCKETS  # one folder an event, and a file of each task in it, before
    assert store.load_prices().count() == 1203
    want = ["007", "400", "nothing"]
    asked = spark.createDataFrame([(e,) for e in [*want, "007"]], "event_id string")
    for got in (store.load_prices(want), store.load_prices(asked)):
        assert got.columns == ["event_id", "market_id", "ts", "p"] and sorted((r.event_id, r.p) for r in got.collect()) == [("007", 0.5)] * 3 + [("400", 0.7)]
    assert store.load_prices([]).count() == 0
    assert {r.event_id for r in store.partitions("prices", ["event_id"]).collect()} == {*ids, "400", None, ""}


def test_a_store_of_folders_by_event_goes_on_in_buckets(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    prices(spark, ["007", "8", "9/a"], 0.1).write.partitionBy("event_id").parquet(f"{tmp_path}/s/prices")
    assert sorted(r.event_id for r in store.stored_event_ids("prices").collect()) == ["007", "8", "9/a"]
    store.append("prices", prices(spark, ["8", "10"], 0.2))
    held = lambda: sorted((r.event_id, r.p) for r in store.load_prices().collect())
    assert held() == [("007", 0.1), ("10", 0.2), ("8", 0.1), ("8", 0.2), ("9/a", 0.1)]
    assert [r.p for r in store.load_prices(["9/a"]).collect()] == [0.1]
    store.append("prices", prices(spark, ["8", "9/a"], 0.3), replace=True)
    assert held() == [("007", 0.1), ("10", 0.2), ("8", 0.3), ("9/a", 0.3)]


def test_files_of_stored_trades_do_not_grow_with_events_or_tasks(spark, tmp_path, monkeypatch):
    def trades(size):
        made = spark.range(900).repartition(7).select((F.col("id") % 300).cast("string").alias("event_id"), F.col("id").cast("string").alias("market_id"), F.lit("2026-01-01").cast("timestamp").alias("ts"))
        return made.withColumns({"side": F.lit("BUY"), "outcome_index": F.lit(1), "price": F.lit(0.25), "size": F.lit(size), "tx": F.lit("x"), "truncated": F.lit(False)})

    store, other = (Store(spark, f"{tmp_path}/s") for _ in range(2))
    store.append("trades", trades(4.0))
    plain, raced = Table._commit, []

    def late(self, version, manifest):
        if not raced:
            raced.append(1)
            other.append("trades", trades(8.0))
        return plain(self, version, manifest)

    monkeypatch.setattr(Table, "_commit", late)  # another writer is first: both writers' rows stay
    store.append("trades", trades(16.0))
    assert len(list((tmp_path / "s/trades").rglob("*.parquet"))) <= 4 * BUCKETS
    got = {(r.px0, r.buys0, r.usd): r["count"] for r in store.load_trades().groupBy("px0", "buys0", "usd").count().collect()}
    assert got == {(0.75, False, usd): 900 for usd in (1.0, 2.0, 4.0)}
    assert sorted(r.market_id for r in store.load_trades(["7"]).where("usd = 1").collect()) == ["307", "607", "7"]


def test_files_of_a_download_do_not_grow_with_events(spark, tmp_path, monkeypatch):
    import pandas as pd

    store, at = Store(spark, f"{tmp_path}/s"), pd.Timestamp("2026-01-01", tz="UTC")
    todo = spark.range(300).repartition(7).select(F.col("id").cast("string").alias("event_id"), F.lit("m").alias("market_id"))

    def fetch(p, down=True):
        def run(pdf):
            k = int(pdf["event_id"].iloc[0])
            if down and k % 50 == 3:
                raise ValueError("no answer")
            return pd.DataFrame({"market_id": ["m"], "ts": [at], "p": [p]}).iloc[: int(k % 50 != 2)]

        return run

    assert store.download("prices", todo, fetch(0.1)) == {"events": 300, "fetched": 294, "failed": 6, "skipped": 0}
    assert len(list((tmp_path / "s/prices").rglob("*.parquet"))) <= 2 * BUCKETS
    before = store.table("prices").manifest(1)["folders"]
    store.append("prices", prices(spark, ["7", "3"], 0.2), replace=True)  # 7 was there: its bucket alone is written anew
    after = store.table("prices").manifest(2)["folders"]
    assert len([b for b in before if not set(before[b]) <= set(after[b])]) == 1
    assert sorted((r.event_id, r.p) for r in store.load_prices(["3", "7", "8"]).collect()) == [("3", 0.2), ("7", 0.2), ("8", 0.1)] and store.load_prices().count() == 289

    store.table("prices").add(prices(spark, ["53"], 0.3))  # as by a writer that died before its entry
    plain, raced = Table._commit, []

    def late(self, version, manifest):
        if not raced:
            raced.append(1)
            Store(spark, store.root).append("prices", prices(spark, ["103", "8"], 0.4), replace=True)
        return plain(self, version, manifest)

    monkeypatch.setattr(Table, "_commit", late)  # and another one stores an event meanwhile: the later one's rows stay, none are doubled
    store.append("prices", prices(spark, ["53", "103"], 0.5), replace=True)
    assert sorted((r.event_id, r.p) for r in store.load_prices(["7", "8", "53", "103"]).collect()) == [("103", 0.5), ("53", 0.5), ("7", 0.2), ("8", 0.4)]
    assert store.load_prices().count() == 291


def test_a_download_takes_many_events_at_once_and_each_of_them_whole(spark, tmp_path, monkeypatch):
    import pandas as pd

    from oddsframe.sources import store as module

    sizes = {f"{k:03d}": 1 + k % 11 for k in range(299)} | {None: 5}
    todo = spark.createDataFrame([(e, str(j)) for e, n in sizes.items() for j in range(n)], "event_id string, market_id string").repartition(7)

    def fetch(pdf):
        event = pdf["event_id"].iloc[0]
        assert pdf["event_id"].isna().all() if event is None else (pdf["event_id"] == event).all()
        k = int(event or 1)
        if k % 50 == 3:
            raise ValueError("no answer")
        times = pd.to_datetime(["2026-01-01"] * len(pdf), utc=k % 2 == 0)  # with and without a zone
        return pd.DataFrame({"p": float(len(pdf)), "ts": times, "market_id": pdf["market_id"], "event_id": "other"} | ({"more": 1} if k % 3 else {})).iloc[: 0 if k % 50 == 2 else len(pdf)]

    plain, plans = Store.append, []

    def append(self, kind, rows, replace=False):
        plans.append(rows._jdf.queryExecution().toString())
        return plain(self, kind, rows, replace)

    monkeypatch.setattr(Store, "append", append)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # events lie across batches
    try:
        store = Store(spark, f"{tmp_path}/s")
        assert store.download("prices", todo, fetch, workers=2) == {"events": 300, "fetched": 293, "failed": 7, "skipped": 0}  # rows without an event never count as stored
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in plans[0]  # a call and a frame an event, before
    stored = [e for e in sizes if int(e or 1) % 50 not in (2, 3)]
    at = pd.Timestamp("2026-01-01")
    got = store.load_prices().groupBy("event_id", "p", F.col("ts").cast("string").alias("ts")).count().collect()
    assert {(r.event_id, r.p, r.ts): r["count"] for r in got} == {(e, float(sizes[e]), f"{at}"): sizes[e] for e in stored}
    told = [(r.event_id, r.n_rows, r.ok) for r in store.ledger().collect()]
    assert len(told) == 300 and set(told) == {(e, n if e in stored else 0, int(e or 1) % 50 != 3) for e, n in sizes.items()}

    frames = [pd.DataFrame({"event_id": [f"{k:05d}"] * 3, "market_id": "m"}) for k in range(9_000)]
    made = [len(f) for f in module._fetching(lambda pdf: pdf.assign(ts=at, p=0.5), ["event_id", "market_id", "ts", "p", "failed"])(pd.concat(frames[k : k + 500]) for k in range(0, 9_000, 500))]
    assert sum(made) == 27_000 and len(made) == 3
