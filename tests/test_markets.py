import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from oddsframe.schemas import RAW_EVENT
from oddsframe.sources import api, markets as M
from oddsframe.sources.categories import categorize
from oddsframe.sources.store import Store, complete_events, missing_events
from tests.frames import T0, at, markets


def raw(i, *ms, **kw):
    base = {"id": i, "slug": f"ev-{i}", "title": "T", "negRisk": False, "tags": [{"slug": "sports"}]}
    market = {"conditionId": "0x1", "question": "q", "outcomes": '["Yes","No"]', "outcomePrices": '["1","0"]', "clobTokenIds": '["t0","t1"]', "closed": True, "createdAt": "2026-03-01T00:00:00Z", "endDate": "2026-03-11T00:00:00Z", "closedTime": "2026-03-11 02:00:00+00", "volumeNum": 5.0, "umaResolutionStatuses": '["proposed"]'}
    return base | kw | {"markets": [market | m for m in ms]}


def frame(spark, tmp_path, *events):
    path = tmp_path / "events.json"
    path.write_text("\n".join(json.dumps(e) for e in events))
    return M.markets_frame(spark.read.schema(RAW_EVENT).json(str(path)))


def test_flattening(spark, tmp_path):
    df = frame(
        spark, tmp_path,
        raw("1", {"id": "a"}, {"id": "b", "outcomePrices": '["0.5","0.5"]'}),
        raw("2", {"id": "c", "outcomes": '["Over","Under"]', "outcomePrices": '["0","1"]', "feesEnabled": True, "feeSchedule": {"rate": 0.05, "exponent": 2}}, enableNegRisk=True, tags=[{"slug": "Bitcoin"}, {"slug": "up-or-down"}]),
        raw("3", {"id": "d", "umaResolutionStatuses": '["disputed"]', "closedTime": "2026-03-05 00:00:00+00"}, slug="arch-x", tags=None),
        raw("4", {"id": "e", "closed": False, "outcomePrices": None, "outcomes": "junk", "clobTokenIds": None, "endDate": None}, endDate="2026-04-01T00:00:00.123Z"),
    )
    m = {r.market_id: r for r in df.collect()}
    assert (m["a"].winner, m["a"].clean, m["a"].structure, m["a"].markets_in_event, m["a"].category, m["a"].known_ts) == (0, True, "multi_market", 2, "sports", at(240))
    assert m["b"].winner is None and not m["b"].clean and json.loads(m["b"].outcome_prices) == ["0.5", "0.5"]
    assert (m["c"].winner, m["c"].outcome0, m["c"].structure, m["c"].category, m["c"].fee_rate, m["c"].fee_exponent) == (1, "Over", "negrisk", "crypto_updown", 0.05, 2.0)
    assert m["d"].disputed and m["d"].archived_copy and not m["d"].clean and m["d"].resolved_early_1h and m["d"].category == "other" and m["d"].known_ts == at(96)
    assert (m["e"].winner, m["e"].n_outcomes, m["e"].token0, m["e"].outcome0) == (None, 0, None, None) and m["e"].end_ts == datetime(2026, 4, 1, 0, 0, 0, 123000)


def test_the_last_of_equal_ids_stays(spark, tmp_path):
    df = frame(spark, tmp_path, raw("1", {"id": "a", "question": "old"}, {"id": "a", "question": "new"}))
    assert [r.question for r in df.collect()] == ["new"] and df.first().markets_in_event == 1


def test_times_lists_and_winners(spark):
    df = spark.createDataFrame([("2026-03-01T00:00:00Z",), ("2026-03-01 00:00:00+00",), ("2026-03-01T01:00:00.5+01:00",), (" ",), (None,), ("2026-03-01",), ("soon",)], "t string")
    out = [r[0] for r in df.select(M.parse_ts("t")).collect()]
    assert out[:6] == [T0, T0, T0 + timedelta(seconds=0.5), None, None, T0] and out[6] is None
    df = spark.createDataFrame([('["1","0"]', True), ('["0","1"]', True), ("[1, 0]", True), ('["1","0"]', False), ('["1"]', True), ('["x","0"]', True), ("{}", True), (None, True), ('["1","0"]', None)], "p string, c boolean")
    assert [r[0] for r in df.select(M.winner_index("p", "c")).collect()] == [0, 1, 0, None, None, None, None, None, None]


def test_categories_can_be_replaced(spark):
    df = spark.createDataFrame([(["Games", None],), ([],), (None,), (["iran", "NFL"],)], "t array<string>")
    assert [r[0] for r in df.select(categorize(F.col("t"))).collect()] == ["sports", "other", "other", "sports"]
    assert [r[0] for r in df.select(categorize(F.col("t"), [("mine", ["iran"])])).collect()] == ["other", "other", "other", "mine"]


def test_selection(spark):
    m = markets(spark, [{"market_id": "a"}, {"event_id": "2", "event_slug": "s2", "market_id": "b", "category": "x", "disputed": True}])
    ids = lambda df: sorted(r.market_id for r in df.collect())
    assert ids(M.select_markets(m, ["1"])) == ["a"] and ids(M.select_markets(m, ["s2"])) == ["b"] and ids(M.select_markets(m, categories=["x"])) == ["b"] and ids(M.select_markets(m, clean_only=True)) == ["a"]


def test_store_upserts_and_prunes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "root"))
    with pytest.raises(FileNotFoundError):
        store.load_markets()
    store.save_markets(markets(spark, [{"market_id": "a", "volume": 1.0}, {"market_id": "b"}]))
    out = {r.market_id: r for r in store.save_markets(markets(spark, [{"market_id": "a", "volume": 2.0}, {"market_id": "c"}])).collect()}
    assert out["a"].volume == 2.0 and out["c"].markets_in_event == 3 and len(out) == 3
    assert store.load_prices().count() == 0 and store.load_trades(["1"]).count() == 0
    px = spark.createDataFrame([("1", "a", T0, 0.5), ("2", "z", T0, 0.5)], "event_id string, market_id string, ts timestamp, p double")
    store.append("prices", px)
    one = store.load_prices(["1"])
    assert [r.market_id for r in one.collect()] == ["a"] and "PartitionFilters: [isnotnull(event_id" in one._jdf.queryExecution().toString()
    assert [r.event_id for r in missing_events(px, store.stored_event_ids("trades")).orderBy("event_id").collect()] == ["1", "2"]
    assert complete_events(px, px.where("event_id = '2'")).count() == 1


def test_downloads_resume(spark, tmp_path):
    import pandas as pd

    store = Store(spark, str(tmp_path / "root"))
    todo = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "c")], "event_id string, market_id string")

    def fetch(pdf):
        if pdf["event_id"].iloc[0] == "2":
            raise ValueError("down")
        return pd.DataFrame({"market_id": pdf["market_id"], "ts": pd.Timestamp("2026-03-01"), "p": 0.5})

    assert store.download("prices", todo, fetch) == {"events": 2, "fetched": 1, "failed": 1, "skipped": 0}
    ok = lambda pdf: pd.DataFrame({"market_id": pdf["market_id"], "ts": pd.Timestamp("2026-03-01"), "p": 0.5})
    assert store.download("prices", todo, ok) == {"events": 2, "fetched": 1, "failed": 0, "skipped": 1}
    assert store.load_prices().count() == 3


def test_connectors(tmp_path):
    asked = []

    def transport(url):
        asked.append(url)
        if "prices-history" in url:
            return json.dumps({"history": [{"t": 1772323200, "p": 0.5}, {"t": 1772323200, "p": 0.7}]})
        if "trades" in url:
            n = api.PAGE if "offset=0&" in url else 3
            return json.dumps([{"timestamp": 1772323200 + i, "side": "BUY", "outcomeIndex": 0, "price": "0.5", "size": 1, "transactionHash": "x"} for i in range(n)])
        return json.dumps([{"id": "7"}] if "slug=known" in url else [])

    c = api.Client("prices", str(tmp_path), transport)
    px = api.price_history(c, "http://x", "tok", T0, T0 + timedelta(days=12))
    assert len(px) == 1 and sum("prices-history" in u for u in asked) == 3
    api.price_history(c, "http://x", "tok", T0, T0 + timedelta(days=12))
    assert sum("prices-history" in u for u in asked) == 3  # from the cache
    rows, cut = api.taker_trades(c, "http://x", "cond")
    assert len(rows) == api.PAGE + 3 and not cut and api.taker_trades(c, "http://x", "cond", api.PAGE)[1]
    assert api.get_event(c, "http://x", "known")["id"] == "7"
    with pytest.raises(ValueError, match="no event"):
        api.get_event(c, "http://x", "unknown")


def test_fetch_bounds(spark):
    m = markets(spark, [{"start_ts": None}, {"market_id": "b", "token0": ""}, {"market_id": "c", "created_ts": None, "start_ts": None}])
    (r,) = M.fetch_bounds(m, timedelta(days=2), F.lit(at(24 * 365)).cast("timestamp")).collect()
    assert r.start == at(240 - 48) and r.end == at(242 + 24)


def refused(url):
    import urllib.error

    raise urllib.error.HTTPError(url, 403, "refused", None, None)


def test_event_crawl_by_window_tag_and_state_goes_on_after_a_refusal(tmp_path):
    asked, slept, failing = [], [], [2]

    def transport(url):
        asked.append(url)
        if "after_cursor" in url and failing[0]:
            failing[0] -= 1
            refused(url)
        more = "end_date_min=2026-01-01" in url and "after_cursor" not in url
        return json.dumps({"events": [{"id": len(asked)}], "next_cursor": "c1" if more else None})

    c = api.Client("events", str(tmp_path), transport, sleep=slept.append)
    crawl = lambda **o: list(api.iter_events(c, "http://x", date(2026, 1, 1), date(2026, 2, 15), today=date(2026, 2, 10), **o))
    assert len(crawl(tag_slug="politics")) == 3
    assert all("tag_slug=politics" in u and "closed=true" in u for u in asked) and len({u for u in asked if "after_cursor=c1" in u}) == 1
    assert [x for x in slept if x >= 15] == [15.0, 30.0]
    n = len(asked)
    assert len(crawl(tag_slug="politics")) == 3 and len(asked) == n + 1  # windows that are over come from the cache
    crawl(closed=None)
    assert not any("closed" in u for u in asked[n + 1 :])
    with pytest.raises(Exception, match="403"):
        api.Client("prices", transport=refused, sleep=slept.append).get_text("http://x")


def test_a_worker_keeps_one_client_and_its_share_of_the_rate():
    assert api.worker_client("trades", 4) is api.worker_client("trades", 4)
    assert api.worker_client("trades", 4).gap == pytest.approx(4 * api.MIN_INTERVAL["trades"])


def test_snapshots_are_fetched_in_the_windows_around_targets(spark):
    def steady(url):
        from urllib.parse import parse_qs, urlparse

        q = parse_qs(urlparse(url).query)
        if q["market"] == ["bad"]:
            raise ValueError("no such token")
        return json.dumps({"history": [{"t": t, "p": 0.3} for t in range(int(q["startTs"][0]), int(q["endTs"][0]), 600)]})

    m = markets(spark, [{"market_id": "a", "token0": "good"}, {"market_id": "b", "token0": "bad"}])
    end = m.first().end_ts
    targets = spark.createDataFrame([(i, "1d", end - timedelta(days=d)) for i in "ab" for d in (1, 40)], "market_id string, snapshot string, target_ts timestamp")
    out = api.fetch_snapshots(m, targets, "http://x", workers=2, transport=steady).collect()
    assert sorted((r.market_id, r.p, r.target_ts) for r in out) == [("a", 0.3, end - timedelta(days=40)), ("a", 0.3, end - timedelta(days=1))]


def test_an_event_without_rows_is_done_and_one_that_fails_is_not(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    todo = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "event_id string, market_id string")

    def fetch(pdf):
        import pandas as pd

        if pdf["event_id"].iloc[0] == "3":
            raise ValueError("down")
        at = [] if pdf["event_id"].iloc[0] == "2" else [pd.Timestamp("2026-01-01", tz="UTC")]
        return pd.DataFrame({"market_id": ["a"] * len(at), "ts": at, "p": [0.5] * len(at)})

    assert store.download("prices", todo, fetch) == {"events": 3, "fetched": 2, "failed": 1, "skipped": 0}
    assert store.download("prices", todo, fetch, workers=2) == {"events": 3, "fetched": 0, "failed": 1, "skipped": 2}
    assert store.load_prices().count() == 1 and sorted(r.event_id for r in store.stored_event_ids("prices").collect()) == ["1", "2"]


def test_of_equal_ids_in_one_batch_the_last_row_stays(spark):
    rows = [(f"e{k}", "m", k) for k in range(50)]
    new = markets(spark, [{"market_id": "m", "event_id": e, "fee_rate": float(k)} for e, _, k in rows]).coalesce(1)
    assert M.upsert(None, new).collect()[0].fee_rate == 49.0
