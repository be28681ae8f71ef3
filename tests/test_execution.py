from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsframe.functions.exprs import band, band_labels, taker_fee
from oddsframe.operators import execution as E
from oddsframe.operators.temporal import pieces
from tests.frames import T0, at, rows

TRADES = "market_id string, ts timestamp, side string, outcome_index int, price double, size double"


def tape(spark, *data):
    return E.outcome0_view(spark.createDataFrame([("a", *d) for d in data], TRADES))


def test_bands(spark):
    assert band_labels([0.01, 0.5]) == ["0-1", "1-50", "50-100"]
    df = spark.createDataFrame([(x,) for x in (0.0, 0.0099, 0.01, 0.35, 0.99, 1.0, None)], "p double")
    assert [r[0] for r in df.select(band("p")).collect()] == ["0-1", "0-1", "1-3", "35-50", "99-100", "99-100", None]


def test_fee(spark):
    df = spark.createDataFrame([(0.5, True, 0.04, 1.0), (0.5, True, 0.04, 2.0), (0.5, False, 0.04, 1.0), (0.5, None, 0.04, 1.0), (0.5, True, None, None)], "x double, fees_enabled boolean, fee_rate double, fee_exponent double")
    assert np.allclose([r[0] for r in df.select(taker_fee(F.col("x"))).collect()], [0.01, 0.0025, 0, 0, 0])


def test_outcome_zero_view(spark):
    out = tape(spark, (at(0), "BUY", 0, 0.3, 10.0), (at(1), "SELL", 0, 0.3, 10.0), (at(2), "BUY", 1, 0.3, 10.0), (at(3), "SELL", 1, 0.3, 10.0)).orderBy("ts").collect()
    assert [(round(r.px0, 9), r.buys0, r.usd) for r in out] == [(0.3, True, 3.0), (0.3, False, 3.0), (0.7, False, 3.0), (0.7, True, 3.0)]


def test_costs_and_table(spark):
    mids = spark.createDataFrame([("a", at(0), 0.5)], "market_id string, ts timestamp, p double")
    t = tape(spark, (at(0), "BUY", 0, 0.52, 1.0), (at(minutes=5), "SELL", 0, 0.47, 2.0), (at(minutes=5, seconds=1), "BUY", 0, 0.9, 3.0), (at(minutes=1), "BUY", 1, 0.53, 4.0))
    c = E.trade_costs(t, mids)
    assert sorted(round(r.cost, 9) for r in c.collect()) == [0.02, 0.03, 0.03]
    r = E.cost_table(c).first()
    assert (r.band, r.n, round(r.median_cost, 9), round(r.p75_cost, 9), r.shares) == ("50-65", 3, 0.03, 0.03, 7.0)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 10])
def test_third_quartile_is_the_nearest_rank(spark, n):
    df = spark.createDataFrame([("k", float(i), 1.0, 0.5) for i in range(1, n + 1)], "g string, cost double, size double, mid double")
    assert E.cost_table(df).first().p75_cost == 1 + int(np.floor(0.75 * (n - 1) + 0.5))


def test_attach_cost_falls_back(spark):
    table = spark.createDataFrame([("x", "35-50", 0.01), ("y", "35-50", 0.03), ("y", "10-20", -0.02)], "category string, band string, median_cost double")
    df = spark.createDataFrame([("x", 0.4), ("z", 0.4), ("x", 0.15), ("x", 0.9), ("x", None)], "category string, p double")
    out = [(r.category, r.p, round(r.cost, 9)) for r in E.attach_cost(df, table, by=["category"]).collect()]
    assert sorted(out, key=str) == sorted([("x", 0.4, 0.01), ("z", 0.4, 0.02), ("x", 0.15, 0.0), ("x", 0.9, 0.02), ("x", None, 0.02)], key=str)


def test_window_volume_is_open_on_the_left(spark):
    t = tape(spark, (at(0), "BUY", 0, 0.5, 5.0), (at(1), "BUY", 0, 0.5, 7.0), (at(2), "BUY", 0, 0.5, 35.0), (at(2, seconds=1), "BUY", 0, 0.5, 100.0))
    p = spark.createDataFrame([("a", at(1)), ("a", at(1)), ("a", at(9)), ("b", at(1))], "market_id string, decision_time timestamp")
    out = [(r.market_id, r.decision_time, r.vol_window, r.traded_near) for r in E.window_volume(p, t).collect()]
    assert sorted(out, key=str) == [("a", at(1), 42.0, True), ("a", at(1), 42.0, True), ("a", at(9), 0.0, False), ("b", at(1), 0.0, False)]


def test_first_print_takes_the_same_side_after_the_time(spark):
    t = tape(spark, (at(1), "BUY", 0, 0.40, 9.0), (at(1.2), "SELL", 0, 0.41, 9.0), (at(1.4), "SELL", 1, 0.52, 10.0), (at(1.5), "BUY", 0, 0.47, 10.0), (at(2), "BUY", 0, 0.55, 4.0), (at(2, seconds=1), "BUY", 0, 0.1, 50.0))
    p = spark.createDataFrame([("a", at(1), "YES", 0.5), ("a", at(1), "NO", 0.5), ("a", at(7), "YES", 0.5)], "market_id string, decision_time timestamp, side string, limit double")
    out = {(r.side, r.decision_time): r for r in E.first_print(p, t, limit_col="limit").collect()}
    yes, no, late = out["YES", at(1)], out["NO", at(1)], out["YES", at(7)]
    assert round(yes.print_px, 9) == 0.48 and yes.print_ts == at(1.4) and yes.fillable_shares == 20.0 and round(yes.print_usd, 9) == 11.7
    assert round(no.print_px, 9) == 0.59 and no.fillable_shares == 0 and late.print_px is None and late.fillable_usd is None


def test_reaction(spark):
    mids = spark.createDataFrame([("a", at(0), 0.5), ("a", at(minutes=5), 0.54), ("a", at(minutes=12), 0.56), ("b", at(0), 0.5), ("b", at(minutes=7), 0.4), ("c", at(0), 0.5), ("c", at(7), 0.9)], "market_id string, ts timestamp, p double")
    ev = spark.createDataFrame([("a", at(0), 0), ("b", at(0), 1), ("c", at(0), 0), ("d", at(0), 0)], "market_id string, t0 timestamp, winner int")
    assert rows(E.reaction_minutes(ev, mids), "market_id", "reaction_min") == [("a", 12.0), ("b", 7.0), ("c", None), ("d", None)]


def test_asof_ties_take_the_last_by_value_and_chunks_agree(spark):
    from oddsframe.operators.temporal import pieces, asof_join

    rng = np.random.default_rng(0)
    right = spark.createDataFrame([(f"m{int(k)}", at(float(h)), int(s)) for k, h, s in zip(rng.integers(0, 3, 300), rng.integers(0, 60, 300), range(300), strict=True)], "k string, t timestamp, seq int")
    left = spark.createDataFrame([(f"m{int(k)}", at(float(h))) for k, h in zip(rng.integers(0, 4, 200), rng.uniform(-5, 70, 200), strict=True)], "k string, u timestamp")
    r, want = right.collect(), []
    for x in left.collect():
        before = [(y.t, y.seq) for y in r if y.k == x.k and y.t <= x.u]
        want.append((x.k, x.u, max(before)[1] if before else None))
    for chunk in (None, timedelta(hours=7), 5, 1):
        assert rows(asof_join(left, right, ["k"], "u", "t", {"seq": "seq"}, ties=["seq"], chunk=chunk), "k", "u", "seq") == sorted(want, key=str)


def test_a_one_key_tape_is_cut_into_even_pieces(spark):
    tape = spark.range(20_000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * F.col("id") % 997 * 60 + F.col("id")).alias("t"))
    rows_ = tape.unionByName(spark.createDataFrame([("cold", T0)] * 50 + [(None, T0)], "k string, t timestamp"))
    sizes = {(r.k, r.c): r.n for r in pieces(rows_, ["k"], "t", 1_000).groupBy("k", F.col("__chunk").alias("c")).agg(F.count("*").alias("n")).collect()}
    hot = [n for (k, _), n in sizes.items() if k == "hot"]
    assert sum(hot) == 20_000 and 18 <= len(hot) <= 24 and max(hot) <= 1_500
    assert sizes["cold", 0] == 50 and sizes[None, 0] == 1


def test_range_sums_over_chunks_equal_brute_force(spark, monkeypatch):
    import random

    from oddsframe.operators import temporal

    r = random.Random(4)
    probes = [("a" if r.random() < 0.8 else "b", T0 + timedelta(minutes=r.randrange(6000))) for _ in range(200)]
    points = [("a" if r.random() < 0.8 else "b", T0 + timedelta(minutes=r.randrange(6000)), float(r.randrange(9))) for _ in range(500)] + [("a", None, 5.0)]
    left = spark.createDataFrame([(i, *x) for i, x in enumerate(probes)], "i int, k string, t timestamp")
    right = spark.createDataFrame(points, "k string, t timestamp, x double")
    for windows in (1, 16):
        monkeypatch.setattr(temporal, "WINDOWS_A_CHUNK", windows)
        out = {x.i: x["__sum"] for x in temporal.range_sum(left, right, "k", "t", "t", "x", timedelta(minutes=-30), timedelta(minutes=60)).collect()}
        for i, (k, t) in enumerate(probes):
            near = [x for k2, p, x in points if p is not None and k2 == k and t - timedelta(minutes=30) < p <= t + timedelta(minutes=60)]
            assert out[i] == (sum(near) if near else None)
