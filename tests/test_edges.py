"""Edge cases of back-test signals, rules, recurrences, as-of joins and fits."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.catalog.registry import REUSE
from tidewright.functions.nulls import printed
from tidewright.operators import backtest as bt
from tidewright.operators import estimators as es
from tidewright.operators import scan
from tidewright.operators.asof import asof_join
from tidewright.operators.evidence import factor_history
from tidewright.operators.options import greek_curves
from tidewright.operators.portfolio import staged_runs
from tidewright.operators.textaudit import section_coverage
from tidewright.tables import tick_bars

DAY = dt.date(2020, 1, 1)


def bars(spark, closes, symbol="A"):
    rows = [(symbol, DAY + dt.timedelta(days=i), float(c), float(c), float(c), float(c), 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double, volume double")


def test_flat_prices_give_no_crossover(spark):
    b = bt.with_inputs(bars(spark, [0.1] * 700), "ma-crossover", [])
    for fast, slow in ((10, 50), (20, 100), (50, 200)):
        assert {r[0] for r in b.select(bt.ma_crossover(fast, slow)[0]).collect()} == {0.0}


def test_rules_with_zero_divisors_and_nan(spark):
    b = bars(spark, [10.0] * 15 + [float("nan"), 12.0])
    flags = [r.flag for r in bt.rule_signal(b, "close / ret_10 > 1", [("ret", 10)]).orderBy("ts").collect()]
    assert flags[:15] == [False] * 15
    flags = [r.flag for r in bt.rule_signal(b, "close > 5", []).orderBy("ts").collect()]
    assert flags == [True] * 15 + [False, True]
    assert [r.flag for r in bt.rule_signal(b, "NOT (close > 50)", []).orderBy("ts").collect()][15:] == [False, True]
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


@pytest.mark.parametrize("strategy", list(bt.AXES))
def test_sweep_of_every_strategy(spark, strategy):
    rng = np.random.default_rng(1)
    found = bt.sweep(bars(spark, 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 420)))), strategy).collect()
    (xn, xs), (yn, ys) = bt.AXES[strategy]
    assert len(found) == len(xs) * len(ys)
    if strategy == "ma-crossover":
        assert [(r.fast, r.slow) for r in found if r.run_id is None] == [(50.0, 50.0)]


def test_spans_of_one(spark):
    b = bars(spark, [1.0, 3.0, 2.0, 2.0])
    assert [r.y for r in scan.ewm_mean(b, "close", 1.0, "y").orderBy("ts").collect()] == [1.0, 3.0, 2.0, 2.0]
    assert [r.y for r in scan.wilder_rsi(b, 1, "y").orderBy("ts").collect()] == [None, 100.0, 0.0, 50.0]
    assert scan.ewm_rsi(b, 1, "y").count() == 4


def test_asof_join_with_one_hot_symbol(spark):
    right = bars(spark, range(1, 41), "H").unionByName(bars(spark, range(101, 111), "B"))
    asks = [(i, "H" if i % 10 else "B", DAY + dt.timedelta(days=i % 50 - 2)) for i in range(2000)] + [(5000, "H", None), (5001, None, DAY)]
    left = spark.createDataFrame(asks, "id int, symbol string, asked date")
    got = {r.id: r.close for r in asof_join(left, right, ["symbol"], "asked", "ts", ["close"]).collect()}
    for i, symbol, asked in asks:
        k = -1 if asked is None or symbol is None else min((asked - DAY).days, 39 if symbol == "H" else 9)
        assert got[i] == (None if k < 0 else float(k + (1 if symbol == "H" else 101)))
    plan = asof_join(left, right, ["symbol"], "asked", "ts", ["close"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate")  # the window reads distinct asks


def test_all_starts_are_replayed(spark):
    runs = staged_runs(bars(spark, np.linspace(10, 20, 900)), 21, 1000.0)
    assert runs.count() == len(range(0, 900 - 21 - 2, 4))


def test_too_small_groups_say_so(spark):
    rows = [("A", 0, float(i), float(i % 3), float(i)) for i in range(40)] + [("B", 0, 1.0, 2.0, 3.0)]
    train = spark.createDataFrame(rows, "symbol string, refit int, x double, z double, y double")
    found = es.fit_quantiles(train, ["x", "z"], "y", [0.5]).toPandas().set_index("symbol")
    assert pd.isna(found.loc["A", "error"]) and list(found.loc["A", "kept"]) == ["x", "z"] and found.loc["B", "error"]
    quotes = spark.createDataFrame([("A", k / 10, 0.04 + k * k / 1000) for k in range(-4, 5)] + [("B", 0.0, 0.04)], "symbol string, k double, w double")
    smiles = es.fit_smiles(quotes, "symbol").toPandas().set_index("symbol")
    assert pd.isna(smiles.loc["A", "error"]) and smiles.loc["B", "error"] == "1 usable quotes"


def test_ridge_on_large_levels(spark):
    rng = np.random.default_rng(3)
    x = 1e7 + rng.normal(size=400)
    y = 2 * (x - 1e7) + 5e6 + rng.normal(scale=0.01, size=400)
    rows = spark.createDataFrame([("A", float(a), float(b)) for a, b in zip(x, y)], "symbol string, x double, y double")
    got = es.ridge_fits(rows, "symbol", ["x"], "y", ridge=0.0).first()
    slope, intercept = np.polyfit(x - 1e7, y, 1)
    assert abs(got.coefficients[0] - slope) < 1e-6 and abs(got.intercept + got.coefficients[0] * 1e7 - intercept) < 1e-3


def test_long_labels_match_whole(spark):
    label = "a required label that is a good deal longer than forty characters"
    docs = spark.createDataFrame([(1, label), (2, label[:45])], "doc_id int, text string")
    got = {r.doc_id: r.labels_present for r in section_coverage(docs, [], [label]).collect()}
    assert got == {1: 1, 2: 0}


def test_ledger_keeps_contracts_apart(spark):
    from tidewright.operators.portfolio import ledger

    order = "account long, seq long, action string, side string, contracts int, fill_price double, spot double, strike double, kind string, expiry string"
    rows = [
        (1, 1, "open", "buy", 2, 1.0, 100.0, 100.0, "call", "a"), (1, 2, "open", "sell", 1, 2.0, 100.0, 90.0, "put", "a"), (1, 3, "close", "sell", 3, 1.5, 100.0, 100.0, "call", "a"),
        (1, 4, "close", "sell", 1, 1.5, 100.0, 100.0, "call", "b"), (1, 5, "close", "sell", 1, 0.0, 100.0, 100.0, "call", "a"), (1, 6, "open", "buy", 0, 1.0, 100.0, 100.0, "call", "a"),
        (1, 7, "expire", "buy", None, None, None, 90.0, "put", "a"), (1, 8, "expire", "buy", None, None, 95.0, 90.0, "put", "a"), (1, 9, "close", "sell", None, 1.5, 100.0, 100.0, "call", "a"),
    ]
    got = ledger(spark.createDataFrame(rows, order)).orderBy("seq").collect()
    assert [r.status for r in got] == ["done", "done", "refused", "nothing open", "refused", "refused", "waiting", "done", "done"]
    assert [r.collateral for r in got][1] == 9000 and got[7].collateral == 0 and got[8].open_positions == 0
    assert abs(got[8].realized - (got[8].cash - 100_000)) < 1e-9


def test_dated_episodes_and_scenarios_without_a_trigger(spark):
    from datetime import date, timedelta

    from tidewright.operators import scenarios as sc

    day = lambda i: date(2020, 1, 1) + timedelta(days=i)
    hits = spark.createDataFrame([("A", "x", p, day(p), float(p)) for p in (3, 4, 14, 25, 40)] + [("B", "x", 7, day(7), None)], "symbol string, scenario string, pos long, ts date, fwd_21 double")
    got = sorted(tuple(r) for r in sc.episodes(hits, ["symbol", "scenario"]).collect())
    assert got == [("A", "x", 1, day(3), day(14), 3, 12, 3.0), ("A", "x", 2, day(25), day(25), 1, 1, 25.0), ("A", "x", 3, day(40), day(40), 1, 1, 40.0), ("B", "x", 1, day(7), day(7), 1, 1, None)]
    counts = {r.symbol: r.episodes for r in sc.episode_counts(hits, ["symbol"]).collect()}
    assert counts == {"A": 3, "B": 1}
    closes = spark.createDataFrame([(s, day(i), 100.0 + i % 7) for s in ("A", "B") for i in range(60)], "symbol string, ts date, close double")
    market = closes.filter("symbol = 'A'").select("ts", sc.F.lit(0.0).alias("ret"))
    found = sc.measure_scenarios(closes, closes, market, [sc.Scenario("fall", "self", "change_pct", 2, -1.0), sc.Scenario("war", "none", None)]).collect()
    war = [r for r in found if r.scenario == "war"]
    assert {r.symbol for r in war} == {"A", "B"} and all(r.episodes is None and r.horizon is None for r in war)
    assert any(r.scenario == "fall" and r.episodes for r in found)


def test_ledger_refuses_sales_of_unknown_collateral(spark):
    from tidewright.operators.portfolio import ledger

    order = "account long, seq long, action string, side string, contracts int, fill_price double, spot double, strike double, kind string"
    rows = [(1, 1, "open", "sell", 1, 1.0, None, 100.0, "call"), (1, 2, "open", "sell", 1, 1.0, 100.0, None, "call"), (1, 3, "open", "sell", 1, 1.0, 100.0, None, "put"),
            (1, 4, "open", "buy", 1, 1.0, 100.0, None, "call"), (1, 5, "expire", "buy", None, None, 100.0, None, "call"), (1, 6, "close", "sell", 1, 2.0, 100.0, None, "call")]
    got = ledger(spark.createDataFrame(rows, order)).orderBy("seq").collect()
    assert [r.status for r in got] == ["refused", "refused", "refused", "done", "waiting", "done"]
    assert got[-1].collateral == 0 and got[-1].open_positions == 0 and abs(got[-1].realized - 98.7) < 1e-9


def test_signals_with_a_memory_start_with_their_fold(spark):
    rng = np.random.default_rng(5)
    b = bars(spark, 100 * np.exp(np.cumsum(rng.normal(0, 0.012, 520))))
    walked = bt.walk_forward(b, "regime-trend", 420, 50, grid=[{"fast": 5, "slow": 20, "hurst_threshold": 0.5}]).orderBy("fold", "ts").collect()
    want = []
    for fold in (0, 1):
        start = fold * 50 + 420 - 401
        own = b.filter((bt.F.col("ts") >= DAY + dt.timedelta(days=start)) & (bt.F.col("ts") < DAY + dt.timedelta(days=fold * 50 + 470)))
        signals = bt.grid_signals(own, "regime-trend", [{"fast": 5, "slow": 20, "hurst_threshold": 0.5}])
        want += [(fold, r.ts, r.exposure, round(r.equity, 6)) for r in bt.run_backtest(signals).orderBy("ts").collect()]
    assert [(r.fold, r.ts, r.exposure, round(r.equity, 6)) for r in walked] == want and len(want) == 100
    assert {r[2] for r in want} <= {0.0, 1.0} and sum(r[2] for r in want) > 0


def test_printed_figures_keep_their_sign(spark):
    df = spark.createDataFrame([(-0.03, "-0.0"), (0.03, "0.0"), (0.0, "0.0"), (-0.05, "-0.1"), (12.25, "12.3"), (None, None)], "x double, want string")
    assert all(r.got == r.want for r in df.select(F.when(F.col("x").isNotNull(), printed("x", 1)).alias("got"), "want").collect())


def test_volatility_is_computed_once_per_lookback(spark):
    b = bars(spark, [100.0 + i % 7 for i in range(90)])
    plan = bt.grid_signals(b, "vol-target", bt.GRIDS["vol-target"])._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert 0 < plan.count("aggregate(zip_with") <= 2 * len({p["lookback"] for p in bt.GRIDS["vol-target"]})


def test_reversion_frames_are_computed_once_per_window(spark):
    b = bars(spark, [100.0 + i % 7 for i in range(90)])
    plan = bt.grid_signals(b, "mean-reversion", bt.GRIDS["mean-reversion"])._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert 0 < plan.count("stddev_samp(") <= 2 * len({p["window"] for p in bt.GRIDS["mean-reversion"]})


def test_greek_curves_are_dealt_out_and_compiled(spark, capsys):
    row = [("A", 1, "call", 900.0, 950.0, 0.1, 0.04, 0.2)]
    book = spark.createDataFrame(row, "symbol string, contract_id long, kind string, strike double, spot double, years double, rate double, vol double").coalesce(1)
    curves = greek_curves(book)
    assert curves.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        greek_curves(book).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000  # larger methods are never compiled by the JVM


def test_sessions_of_many_blocks_are_folded_without_a_hash_table(spark):
    rows = [("A", DAY + dt.timedelta(days=d), b, float(k), (d * 7 + b * 5 + k * 3) % 11 - 5, b * 10 + k, 1, 1, 1, 1.0, 0.05)
            for d in range(3) for b in range(1 + 2 * d) for k in range(4)]
    ticks = spark.createDataFrame(rows, "symbol string, ts date, block long, qty double, step int, l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_discount double")
    days = tick_bars(ticks)
    plan = days._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "HashAggregate" not in plan
    assert days.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # symbols are dealt out
    base = 0.0
    for r in days.orderBy("ts").collect():
        run = np.cumsum([x[4] for x in sorted(rows, key=lambda x: x[5]) if x[1] == r.ts])
        root = np.sqrt(len(run))
        want = [100 * np.exp(0.0025 * (base + v / root)) for v in (run[0], run.max(), run.min(), run[-1])]
        assert [r.open, r.high, r.low, r.close] == pytest.approx(want, abs=1e-4) and r.volume == sum(x[3] for x in rows if x[1] == r.ts)
        base += run[-1] / root


def test_recurrences_share_their_sorts(spark):
    b = bars(spark, [100.0 + i % 7 for i in range(90)])
    sorts = lambda df: len(re.findall(r"\bSort \[", df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]))
    assert sorts(bt.with_inputs(b, "rsi", bt.GRIDS["rsi"])) <= 6  # once by time, once a period, and by time for the running sums
    means = [("close", 2 / 6, "a"), ("close", 2 / 21, "b"), ("volume", 0.06, "c")]
    assert sorts(scan.ewm_means(b, means)) <= 4
    together, alone = scan.ewm_means(b, means), b
    for mean in means:
        alone = scan.ewm_mean(alone, *mean)
    assert together.collect() == alone.select(together.columns).collect()


def test_calendar_tables_go_to_the_symbols(spark):
    targets = spark.createDataFrame([("A", DAY, 1.0), ("B", DAY, -1.0)], "symbol string, ts date, target double").repartition(4, "symbol")
    factors = spark.createDataFrame([("X", DAY, 0.5), ("Y", DAY, 0.1), ("A", DAY, 0.2), ("X", None, 1.0)], "factor_id string, ts date, value double")
    pairs = factor_history(targets, factors)
    assert sorted((r.symbol, r.factor_id) for r in pairs.collect()) == [("A", "X"), ("A", "Y"), ("B", "A"), ("B", "X"), ("B", "Y")]
    plan = pairs.groupBy("symbol", "factor_id").count()._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan  # the targets' own exchange


def test_queries_that_read_bars_again_keep_them():
    assert {"q2_attribution_bundle", "sca21_bundle_numbers", "q9_bundle_facts", "q4_scenario_library", "q4_dated_episodes"} <= REUSE


def test_run_summaries_read_their_bars_once(spark):
    b = bars(spark, [100.0 + (i * 7) % 13 for i in range(90)]).repartition(4, "symbol")
    points = [("buy-and-hold", {}), ("ma-crossover", {"fast": 5, "slow": 20}), ("mean-reversion", {"window": 21})]
    summary = bt.run_summary(bt.run_backtest(bt.run_signals(b, points)))
    plan = summary._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan  # the bars' own exchange
    assert len(re.findall(r"\bWindow \[", plan)) <= 10 and "SortAggregate" not in plan
    alone = [bt.run_summary(bt.run_backtest(bt.grid_signals(b, s, [p], i))).first() for i, (s, p) in enumerate(points)]
    assert summary.orderBy("run_id").collect() == alone


def test_summaries_count_rows_without_a_value(spark):
    rows = [100.0, 110.0, None, 99.0, 99.0, 120.0, None, 90.0, 130.0]
    held = [10.0, 10.0, None, 11.0, 12.0, 12.0, 12.0, 12.0, None]
    df = spark.createDataFrame([("A", 0, DAY + dt.timedelta(days=i), e, h, 1.5, i % 2 == 0) for i, (e, h) in enumerate(zip(rows, held))],
                               "symbol string, run_id long, ts date, equity double, benchmark double, cost double, traded boolean")
    r = bt.run_summary(df).first()
    assert (r.n_periods, r.trades, r.total_costs) == (7, 5, 13.5) and r.benchmark_return_pct == pytest.approx(20.0)
    assert r.total_return_pct == pytest.approx(30.0) and r.max_drawdown_pct == pytest.approx(-25.0) and r.max_drawdown_bars == 1  # 120 to 90, at once
    assert r.win_rate_pct == pytest.approx(60.0) and r.excess_return_pct == pytest.approx(10.0)
    assert bt.run_summary(df.withColumn("benchmark", F.when(F.col("ts") < F.lit(DAY + dt.timedelta(days=2)), F.col("benchmark")))).count() == 0
