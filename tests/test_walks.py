"""Walks over arrays of bars against the windows that they stand for."""

import datetime as dt

import numpy as np
import pytest

from tidewright.operators import backtest as bt

DAY = dt.date(2020, 1, 1)
GRIDS = {
    "regime-trend": (420, 40, [{"fast": 5, "slow": 20, "hurst_threshold": h} for h in (0.5, 0.6)]),
    "rsi": (60, 15, [{"period": p, "oversold": a, "overbought": b} for p, a, b in ((7, 30, 70), (14, 40, 60))]),
    "mean-reversion": (60, 15, [{"window": n, "entry_z": a, "exit_z": b} for n, a, b in ((21, -1.0, 0.5), (21, -2.0, 0.5), (10, -1.5, 0.0))]),
    "vol-target": (60, 15, [{"target_vol": v, "lookback": n} for v, n in ((10.0, 20), (15.0, 20), (10.0, 40))]),
}


def bars(spark, n):
    """Symbols that move, stand still, end too soon, lack a close, lack a name."""
    rng = np.random.default_rng(11)
    rows = []
    for symbol, size, step in (("A", n, 0.012), ("B", n - 7, 0.03), ("flat", n, 0.0), ("short", 50, 0.01), ("gap", n, 0.01), (None, n, 0.01)):
        close = np.round(100 * np.exp(np.cumsum(rng.normal(0, 1, size) * step)), 4)
        opens = np.round(close * np.exp(rng.normal(0, 1, size) * step / 3), 4)
        rows += [(symbol, DAY + dt.timedelta(days=i), float(o), None if symbol == "gap" and i == 30 else float(c)) for i, (o, c) in enumerate(zip(opens, close))]
    order = rng.permutation(len(rows))
    return spark.createDataFrame([rows[i] for i in order], "symbol string, ts date, open double, close double")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def listed(df):
    near = lambda v: None if v is None else round(v, 7)
    return sorted(([r.symbol, r.fold, r.run_id, r.ts, near(r.exposure), near(r.equity), near(r.benchmark), near(r.cost), r.traded] for r in df.collect()), key=str)


@pytest.mark.parametrize("strategy", GRIDS)
def test_arrays_walk_as_windows_do(spark, strategy):
    train, test, grid = GRIDS[strategy]
    b = bars(spark, train + 3 * test + 4)
    got, want = bt.walk_forward(b, strategy, train, test, grid=grid), bt._walk_by_windows(b, strategy, train, test, None, grid)
    assert got.dtypes == want.dtypes
    assert listed(got) == listed(want) and {r[0] for r in listed(got)} == {"A", "B", "flat", "gap"}  # a symbol without a name joins no fold


@pytest.mark.parametrize("strategy", GRIDS)
def test_folds_and_points_cost_no_shuffle(spark, strategy):
    train, test, grid = GRIDS[strategy]
    b = bars(spark, train + 3 * test).filter("symbol IN ('A', 'B', 'flat')")
    assert exchanges(bt.walk_forward(b, strategy, train, test, grid=grid)) == 1


def test_symbols_that_outgrow_a_batch_and_a_block(spark, monkeypatch):
    """Symbols cut by batches, and taken few at a time, walk as they do together."""
    train, test, grid = GRIDS["rsi"]
    b = bars(spark, train + 5 * test).filter("symbol IS NOT NULL AND symbol <> 'gap'")
    together = listed(bt.walk_forward(b, "rsi", train, test, grid=grid))
    monkeypatch.setattr(bt, "ROWS_AT_ONCE", 1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "17")
    try:
        assert listed(bt.walk_forward(b, "rsi", train, test, grid=grid)) == together
    finally:
        spark.conf.set(key, before)
