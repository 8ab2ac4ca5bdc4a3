"""Exact small cases."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.operators import options as op
from tidewright.operators import scenarios as sc
from tidewright.operators import stats
from tidewright.operators import windows as win
from tidewright.operators.evidence import confidence
from tidewright.operators.portfolio import ledger


def series(spark, closes, symbol="X", start="2020-01-01"):
    days = pd.date_range(start, periods=len(closes)).date
    rows = [(symbol, d, float(c), float(c), float(c), float(c), 1.0) for d, c in zip(days, closes)]
    return spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double, volume double")


def book(spark, **kw):
    base = {"spot": 100.0, "strike": 100.0, "years": 1.0, "rate": 0.05, "vol": 0.2, "kind": "call"}
    base.update(kw)
    return spark.createDataFrame([tuple(base.values())], "spot double, strike double, years double, rate double, vol double, kind string")


def test_price_and_greeks(spark):
    c = op.priced(book(spark)).first()
    p = op.priced(book(spark, kind="put")).first()
    assert c.price == pytest.approx(10.450584, abs=1e-6) and p.price == pytest.approx(5.573526, abs=1e-6)
    assert c.price - p.price == pytest.approx(100 - 100 * math.exp(-0.05), abs=1e-9)
    assert c.delta == pytest.approx(0.636831, abs=1e-6) and c.gamma == pytest.approx(0.018762, abs=1e-6)
    assert c.theta == pytest.approx(-6.414028 / 365, abs=1e-7) and c.vega == pytest.approx(0.37524035, abs=1e-7)
    assert c.rho == pytest.approx(0.53232482, abs=1e-7)


def test_expired_contract(spark):
    c = op.priced(book(spark, spot=110.0, years=0.0)).first()
    assert (c.price, c.delta, c.gamma, c.vega) == (10.0, 1.0, 0.0, 0.0)


def test_implied_volatility_round_trip_and_bounds(spark):
    rows = [(100.0, float(k), y, 0.04, v, kind) for k in (80, 95, 100, 105, 130) for y in (7 / 365, 30 / 365, 0.5, 2.0) for v in (0.1, 0.25, 0.8) for kind in ("call", "put")]
    b = spark.createDataFrame(rows, "spot double, strike double, years double, rate double, vol double, kind string")
    for r in op.implied_volatility(op.priced(b).select("spot", "strike", "years", "rate", "kind", "price", "vol", "vega")).collect():
        if r.implied_vol is None:
            assert r.vega < 0.0051
        else:
            assert r.implied_vol == pytest.approx(r.vol, abs=1e-4)
    low = spark.createDataFrame([(100.0, 80.0, 0.5, 0.04, "call", 1.0)], "spot double, strike double, years double, rate double, kind string, price double")
    assert op.implied_volatility(low).first().implied_vol is None


def test_forward_returns_and_triggers(spark):
    s = series(spark, [100, 110, 121])
    got = [r.f for r in s.withColumn("f", win.forward_pct("close", 1)).orderBy("ts").collect()]
    assert got[:2] == pytest.approx([10, 10]) and got[2] is None
    up = series(spark, [100 + i * 100 / 9 for i in range(10)])
    flags = [r.f for r in up.withColumn("f", win.trigger_flag("change_pct", 5, 20.0)).orderBy("ts").collect()]
    assert flags == [None] * 5 + [1.0] * 5
    fall = series(spark, [100.0] * 30 + [70.0] * 5)
    flags = [r.f for r in fall.withColumn("f", win.trigger_flag("drawdown_pct", 30, -20.0)).orderBy("ts").collect()]
    assert flags[-1] == 1.0 and flags[25] == 0.0


def test_episodes_and_months(spark):
    true_at = [0, 1, 3, 24]
    hits = spark.createDataFrame([("X", p) for p in true_at], "symbol string, pos int")
    assert sc.episode_counts(hits, ["symbol"]).first().episodes == 2
    days = pd.date_range("2021-01-01", "2021-03-31").date
    f = spark.createDataFrame([("X", d, 1.0 if str(d) == "2021-02-10" else 0.0) for d in days], "symbol string, ts date, flag double")
    r = sc.monthly_frequency(f, ["symbol"]).first()
    assert (r.months_observed, r.months_triggered) == (3, 1)


def test_outcome_summary(spark):
    r = spark.createDataFrame([(x,) for x in (-10.0, 0.0, 5.0, 10.0)], "fwd double").agg(*sc.outcome("fwd")).first()
    assert (r.median_pct, r.worst_pct, r.share_lower_pct) == (2.5, -10.0, 25.0)


def test_constant_window_is_unknown(spark):
    s = series(spark, [5.0] * 40).withColumn("z", win.rolling_zscore("close", 10))
    assert s.filter("z IS NOT NULL").count() == 0


def test_sizes_and_staging(spark):
    rows = spark.createDataFrame([(200.0, 1000.0, x) for x in (40.0, 10.0, 0.0)], "m double, a double, b double")
    got = [r.v for r in rows.select(stats.size_for_loss(F.col("m"), F.col("a"), F.col("b")).alias("v")).collect()]
    assert got == [500.0, 1000.0, 1000.0]
    s = series(spark, [1.0] * 8).withColumn("e", win.staged_exposure(4, 2))
    assert [r.e for r in s.orderBy("ts").collect()] == [0.25, 0.25, 0.5, 0.5, 0.75, 0.75, 1.0, 1.0]


def test_stop_replay(spark):
    r = stats.stop_outcomes(series(spark, [100.0] * 5 + [60.0] * 5), 6, 20.0).first()
    assert r.worst_pct == pytest.approx(-40) and r.hit_share_pct > 0


def test_steady_growth(spark):
    s = series(spark, [100 * 1.1 ** (t / 252) for t in range(504)]).withColumnRenamed("close", "equity")
    assert stats.performance_stats(s.select("symbol", "ts", "equity"), ["symbol"]).first().annualized_return_pct == pytest.approx(10, abs=0.05)
    flat = series(spark, [100.0] * 20).withColumnRenamed("close", "equity")
    assert stats.performance_stats(flat.select("symbol", "ts", "equity"), ["symbol"]).first().sharpe is None


def test_confidence_labels(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 9, 10, 29, 30, 99, 100)], "n int")
    assert [r.c for r in rows.select(confidence(F.col("n")).alias("c")).collect()] == ["none", "none", "low", "low", "moderate", "moderate", "high"]


ORDER = "account long, seq long, action string, side string, contracts int, fill_price double, spot double, strike double, kind string"


def test_ledger_cash_and_collateral(spark):
    rows = [(1, 1, "open", "buy", 2, 1.35, 100.0, 100.0, "call"), (2, 1, "open", "sell", 1, 2.50, 185.0, 180.0, "put"),
            (3, 1, "open", "sell", 1, 1.0, 185.0, 200.0, "call"), (4, 1, "open", "sell", 9, 2.5, 185.0, 180.0, "put")]
    got = {r.account: r for r in ledger(spark.createDataFrame(rows, ORDER)).collect()}
    assert got[1].cash == pytest.approx(100_000 - 271.30)
    assert got[2].cash == pytest.approx(100_249.35) and got[2].collateral == 18_000
    assert got[3].collateral == pytest.approx((0.20 * 185 - 15 + 1) * 100)
    assert got[4].status == "refused" and got[4].cash == 100_000


def test_ledger_realised_equals_cash_change_when_flat(spark):
    rows = [(1, 1, "open", "buy", 3, 2.0, 100.0, 100.0, "call"), (1, 2, "close", "sell", 1, 2.5, 100.0, 100.0, "call"), (1, 3, "expire", "buy", 0, 0.0, 107.0, 100.0, "call")]
    last = ledger(spark.createDataFrame(rows, ORDER)).orderBy("seq").collect()[-1]
    assert last.open_positions == 0 and last.realized == pytest.approx(last.cash - 100_000)
