"""Golden records against a plain reading of the rules, on odd records."""

import datetime as dt
import random

import pytest

from oddsframe.llm import survivorship

SCHEMA = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
START = dt.datetime(2024, 1, 1)


def records(seed, n, clusters):
    r = random.Random(seed)
    maybe = lambda *xs: r.choice([None, "", " \t", *xs])
    out = []
    for k in range(n):
        at = r.choice([None, START + dt.timedelta(days=r.choice([0, 30, 31, 60]), microseconds=r.choice([0, 1]))])
        source = r.choice(["partner", "store", "web", "crm", "other", None, ""])
        row = (k, r.choice([None, *range(clusters)]), source, at, maybe("Ann", "Ünïö", " Bo "), maybe("a@x", "b@x"), maybe("Rome", "Oslo"), r.choice([None, 1, 2]), maybe("retail", "public"), r.choice([None, 1.005, -2.5, 0.0]))
        out += [row] * r.choice([1, 1, 1, 2])
    return out


def plainly(rows):
    fill = lambda s: s if s is not None and s.strip(" \t\n\x0b\x0c\r") else None
    by = {}
    for r in rows:
        by.setdefault(r[1] if r[1] is not None else r[0], []).append(r)
    out = {}
    for cluster, own in by.items():
        latest = max((r[3] for r in own if r[3]), default=None)
        rank = lambda r: {"partner": 0, "store": 1, "web": 2, "crm": 3}.get(r[2], 4)
        stale = lambda r: r[3] is None or latest - r[3] > dt.timedelta(days=30)
        recent = lambda r: (r[3] is None, -(r[3] - START).total_seconds() if r[3] else 0, rank(r), r[0] is None, r[0] or 0)
        trusted = lambda r: (stale(r), rank(r), *recent(r))
        first = lambda at, order: min(((order(r), fill(r[at]) if isinstance(r[at], str) else r[at], r[0]) for r in own if (fill(r[at]) if isinstance(r[at], str) else r[at]) is not None), default=(None, None, None))[1:]
        segment = first(8, recent)
        name = first(4, lambda r: (-len(r[4]), *trusted(r)))
        balance = first(9, lambda r: (fill(r[8]) != segment[0], *recent(r)))
        held = lambda r: (fill(r[6]) is not None) + (r[7] is not None)
        home = min(own, key=lambda r: (-held(r), *trusted(r)))
        cents = None if balance[0] is None else int((100 * balance[0] + 0.5) // 1)
        out[cluster] = (cluster, len(own), sum(map(stale, own)), name[0], first(5, trusted)[0], segment[0], fill(home[6]), home[7], cents, name[1], first(5, trusted)[1], segment[1], balance[1], home[0] if held(home) else None)
    return out


@pytest.mark.parametrize(("seed", "salts"), [(1, 64), (2, 1), (3, 3)])
def test_records_equal_a_plain_reading(spark, seed, salts):
    rows = records(seed, 160, 12)
    got = survivorship.golden_records(spark.createDataFrame(rows, SCHEMA).repartition(5), salts=salts).collect()
    assert {r.cluster_id: tuple(r) for r in got} == plainly(rows)


def test_order_does_not_depend_on_the_session_time_zone(spark):
    # 2:30 of 31 March 2024 doesn't exist in Berlin
    rows = [(1, 9, "crm", dt.datetime(2024, 3, 31, 2, 30), "a", None, None, None, "x", 1.0), (2, 9, "crm", dt.datetime(2024, 3, 31, 3, 10), "b", None, None, None, "y", 2.0)]
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = survivorship.golden_records(spark.createDataFrame(rows, SCHEMA)).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    assert (got.segment, got.name, got.balance_cents, got.n_stale) == ("y", "b", 200, 0)


def test_odd_rows(spark):
    nulls = (None,) * 10
    rows = [nulls, nulls, (5, None, "web", START, "n" * 100_000, None, None, None, None, float("nan")), (6, 5, "web", START, None, None, None, None, None, float("inf")), (7, 5, "web", START, None, None, None, None, None, 1e300)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("cluster", "none", "salt", "latest", "chosen", "salts", "value", "id", "rank", "before", "cluster_id"):
        frame = frame.selectExpr("*", f"'clash' as {name}")
    got = {r.cluster_id: r for r in survivorship.golden_records(frame).collect()}
    assert set(got) == {None, 5}
    assert (got[None].n_records, got[None].n_stale, got[None].name, got[None].address_from) == (2, 2, None, None)
    assert (got[5].n_records, len(got[5].name), got[5].balance_cents, got[5].balance_from) == (3, 100_000, None, None)
    assert survivorship.golden_records(frame.where("false")).count() == 0


def test_timestamps_with_a_zone_work_too(spark):
    frame = spark.createDataFrame(records(4, 80, 6), SCHEMA)
    zoned = frame.withColumn("updated_at", frame.updated_at.cast("timestamp"))
    key = lambda r: str(r)
    assert sorted(survivorship.golden_records(zoned).collect(), key=key) == sorted(survivorship.golden_records(frame).collect(), key=key)


def test_no_single_task_and_no_window(spark):
    plan = survivorship.golden_records(spark.createDataFrame(records(5, 50, 3), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
