"""Rule back-tests as window expressions over (symbol, run) series.

A bar's signal is filled at the next open and marked at that bar's close. With e the exposure held
after the trade, w the weight drifted to before it and c the cost rate, equity grows per bar by a
factor of those three alone, so equity is a running product. Cost makes w depend on the previous
bar's w, but with a derivative of about c (below 1e-3), so a handful of substitutions of the lagged
weight reach double precision: no sequential scan and no Python, whatever the number of runs. The
substitutions are one expression over the last few exposures and opens, which one window fetches.
``Execution.substitutions`` is that number for its cost rate and exposure limit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import walks
from tidewright.operators import windows as win
from tidewright.operators.stats import performance_stats
from tidewright.session import checkpointed, dealt

RUN = ["symbol", "run_id"]
HURST_WINDOW = 400
ROWS_AT_ONCE = 50_000  # bars that a walk over arrays takes together, beside those of the last symbol


@dataclass(frozen=True)
class Execution:
    """Execution assumptions; costs in basis points of the notional traded."""

    initial_cash: float = 10_000.0
    commission_bps: float = 1.0
    slippage_bps: float = 5.0
    allow_short: bool = False
    max_exposure: float = 1.0

    @property
    def cost_rate(self) -> float:
        return (self.commission_bps + self.slippage_bps) / 10_000.0

    @property
    def substitutions(self) -> int:
        """Steps until the dropped term, (2 * cost * exposure)^(n + 1), is below double precision."""
        shrink = 2 * self.cost_rate * self.max_exposure
        return 0 if shrink <= 0 else max(1, math.ceil(math.log(1e-17) / math.log(min(shrink, 0.5))) - 1)


def run_backtest(signals: DataFrame, ex: Execution | None = None, keys: list[str] | None = None) -> DataFrame:
    """Equity, exposure, costs and benchmark per bar.

    ``signals`` has (keys, ts, open, close, signal, warmup): one row per bar, ``signal`` the target
    exposure decided at that bar (NULL holds the previous one), ``warmup`` the bars before trading.
    """
    ex = ex or Execution()
    keys = keys or RUN
    c = ex.cost_rate
    w = Window.partitionBy(*keys).orderBy("ts")
    prefix = w.rowsBetween(Window.unboundedPreceding, 0)
    low = -ex.max_exposure if ex.allow_short else 0.0
    # greatest and least skip NULL, so an unknown signal has to be kept unknown by hand.
    clipped = F.when(F.col("signal").isNotNull(), F.least(F.greatest(F.col("signal"), F.lit(low)), F.lit(ex.max_exposure)))
    pos = F.row_number().over(w)
    s = signals.withColumn("pos", pos)
    s = s.withColumn("want", F.when(F.col("pos") >= F.greatest("warmup", F.lit(1)), clipped))
    s = s.withColumn("e", F.coalesce(F.last("want", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = s.filter(F.col("pos") > F.greatest("warmup", F.lit(1)))
    # From here on every row is a traded bar: e is filled at its open and marked at its close.
    t = t.select(*keys, "ts", "open", "close", "e")
    back = ex.substitutions + 1
    t = t.select("*", *[F.lag(c, k).over(w).alias(f"{c}_{k}") for c in ("e", "open") for k in range(1, back + 2)]).withColumns({"e_0": F.col("e"), "open_0": F.col("open")})
    # Exposure before each of the last bars, and the growth of its open. Before the first bar there is nothing, which weighs nothing.
    known = {f"p{k}": F.coalesce(f"e_{k + 1}", F.lit(0.0)) for k in range(back + 1)}
    known |= {f"g{k}": F.when(F.col(f"e_{k + 1}").isNull(), 1.0).otherwise(F.col(f"open_{k}") / F.col(f"open_{k + 1}")) for k in range(back + 1)}
    t = t.select(*keys, "ts", "open", "close", "e", F.col("e_1").alias("pe"), *[v.alias(n) for n, v in known.items()])

    def drifted(k: int, before: Column | None) -> Column:
        """The weight k bars ago from that of the bar before it."""
        p, grown = F.col(f"p{k}"), F.col(f"p{k}") * F.col(f"g{k}")
        return grown / (1 - p + grown if before is None else 1 - p - c * F.abs(p - before) + grown)

    pw = reduce(lambda before, k: drifted(k, before), range(back, 0, -1), None)
    t = t.select(*keys, "ts", "open", "close", "e", "pe", "p0", "g0", pw.alias("pw"))
    step = 1 - F.col("p0") - c * F.abs(F.col("p0") - F.col("pw")) + F.col("p0") * F.col("g0")
    t = t.select(*keys, "ts", "open", "close", "e", "pe", drifted(0, F.col("pw")).alias("w"), F.when(F.col("pe").isNull(), 0.0).otherwise(F.ln(step)).alias("grown"))
    # Portfolio value at each fill, before the trade.
    t = t.select("*", (ex.initial_cash * F.exp(F.sum("grown").over(prefix))).alias("v"), F.first("open").over(prefix).alias("first_open"))
    paid = c * F.abs(F.col("e") - F.col("w"))
    equity = F.col("v") * (1 - F.col("e") - paid + F.col("e") * F.col("close") / F.col("open"))
    bench = ex.initial_cash * (1 - c) / F.col("first_open") * F.col("close")
    return t.select(
        *keys, "ts", F.col("e").alias("exposure"), equity.alias("equity"), bench.alias("benchmark"), (F.col("v") * paid).alias("cost"),
        (F.abs(F.col("e") - F.coalesce("pe", F.lit(0.0))) > 1e-12).alias("traded"),
    )


def run_summary(result: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Headline statistics of each run beside buy-and-hold over the same window."""
    keys = keys or RUN
    held = F.when(F.col("benchmark").isNotNull(), F.col("ts"))
    more = {
        "trades": F.sum(F.col("traded").cast("long")), "total_costs": F.sum("cost"), "__n": F.count("benchmark"),
        "benchmark_return_pct": (F.max_by("benchmark", held) / F.min_by("benchmark", held) - 1) * 100,
    }
    s = performance_stats(result, keys, more=more).filter("__n >= 3").drop("__n")
    return s.withColumn("excess_return_pct", F.col("total_return_pct") - F.col("benchmark_return_pct"))


# --- signals: functions from bars to a Column over the past only ----------------------------------

def buy_and_hold(**_) -> tuple[Column, int]:
    return F.lit(1.0), 1


def _mean_above(fast: int, slow: int, w) -> Column:
    """Whether the fast mean is above the slow one, from the running sum of closes: a mean costs one lag, not a frame."""
    def mean(n: int) -> Column:
        return (F.col("close_sum") - F.coalesce(F.lag("close_sum", n).over(w), F.lit(0.0))) / n
    # Running sums carry rounding noise of about 1e-12; means as close as that count as equal.
    return (mean(fast) - mean(slow) > 1e-10 * F.abs(mean(slow))).cast("double")


def ma_crossover(fast: int, slow: int, w=None) -> tuple[Column, int]:
    """Needs ``bar`` and ``close_sum`` (running count and sum)."""
    return F.when(F.col("bar") < slow, 0.0).otherwise(_mean_above(fast, slow, w or win.by_symbol())), slow + 1


def regime_trend(fast: int, slow: int, hurst_threshold: float = 0.5, w=None) -> tuple[Column, int]:
    """A crossover that stands aside while the held Hurst exponent is low; needs ``close_sum`` and ``hurst_<warm-up>``."""
    warm = max(slow, HURST_WINDOW) + 1
    return F.when(F.col(f"hurst_{warm}") < hurst_threshold, 0.0).otherwise(_mean_above(fast, slow, w or win.by_symbol())), warm


def rsi_threshold(period: int = 14, oversold: float = 30.0, overbought: float = 70.0) -> tuple[Column, int]:
    """Needs an ``rsi_<period>`` column."""
    r = F.col(f"rsi_{period}")
    return F.when(r.isNull(), 0.0).when(r <= oversold, 1.0).when(r >= overbought, 0.0).otherwise(0.5), period * 3


def vol_target(target_vol: float, lookback: int, w=None, vol: Column | None = None) -> tuple[Column, int]:
    """Needs a ``log_ret`` column, or the volatility in percent as ``vol``."""
    vol = win.fixed_weight_ewma_vol("log_ret", lookback, 0.94, w or win.by_symbol()) * 100 if vol is None else vol
    return F.when(vol > 1e-6, F.least(target_vol / vol, F.lit(1.0))).otherwise(0.0), lookback + 1


def mean_reversion(window: int = 21, entry_z: float = -1.0, exit_z: float = 0.5, w=None, mean: Column | None = None, sd: Column | None = None) -> tuple[Column, int]:
    """Takes the trailing ``mean`` and ``sd`` of closes from columns where they are given."""
    frame = win.trailing(window, w)
    sd = F.stddev_samp("close").over(frame) if sd is None else sd
    z = (F.col("close") - (F.avg("close").over(frame) if mean is None else mean)) / sd
    ramp = F.when(z <= entry_z, 1.0).when(z >= exit_z, 0.0).otherwise((exit_z - z) / (exit_z - entry_z))
    return F.when(sd > 1e-9, ramp).otherwise(0.0), window + 1


def momentum(lookback: int, skip: int, w=None) -> tuple[Column, int]:
    w = w or win.by_symbol()
    recent = F.lag("close", skip).over(w) if skip else F.col("close")
    past = F.lag("close", lookback).over(w)
    return F.when(past > 0, (recent > past).cast("double")).otherwise(0.0), lookback + 2


STRATEGIES = {
    "buy-and-hold": buy_and_hold, "ma-crossover": ma_crossover, "rsi": rsi_threshold, "vol-target": vol_target,
    "mean-reversion": mean_reversion, "momentum": momentum, "regime-trend": regime_trend,
}

# Signals that depend on where their history starts (a mean with a long memory, refresh days counted from the first bar).
FROM_START = {"rsi", "regime-trend"}

# Parameter grids searched by walk-forward selection.
GRIDS = {
    "buy-and-hold": [{}],
    "ma-crossover": [{"fast": a, "slow": b} for a, b in ((10, 50), (20, 100), (50, 200), (5, 20))],
    "rsi": [{"period": p, "oversold": a, "overbought": b} for p, a, b in ((14, 30, 70), (14, 20, 80), (7, 30, 70), (21, 35, 65))],
    "vol-target": [{"target_vol": v, "lookback": n} for v in (10.0, 15.0, 20.0) for n in (40, 60)],
    "mean-reversion": [{"window": n, "entry_z": a, "exit_z": b} for n in (21, 63) for a, b in ((-1.0, 0.5), (-1.5, 0.0), (-2.0, 0.5))],
    "momentum": [{"lookback": n, "skip": k} for n in (126, 252) for k in (0, 21)],
    "regime-trend": [{"fast": a, "slow": b, "hurst_threshold": h} for a, b in ((20, 100), (50, 200)) for h in (0.5, 0.55)],
}

# Sweep axes (name, values) per strategy.
AXES = {
    "ma-crossover": (("fast", [5, 10, 15, 20, 30, 40, 50]), ("slow", [50, 80, 110, 140, 175, 210, 250])),
    "rsi": (("period", [7, 10, 14, 18, 21, 25, 28]), ("oversold", [20, 23, 27, 30, 33, 37, 40])),
    "vol-target": (("target_vol", [8, 10, 12, 15, 18, 21, 25]), ("lookback", [20, 35, 50, 60, 80, 100, 120])),
    "mean-reversion": (("window", [10, 21, 32, 42, 63, 95, 126]), ("entry_z", [-2.5, -2.2, -1.8, -1.5, -1.2, -0.8, -0.5])),
    "momentum": (("lookback", [63, 105, 126, 168, 189, 252, 378]), ("skip", [0, 3, 5, 10, 15, 21, 42])),
}


def with_inputs(bars: DataFrame, strategy: str, grid: list[dict]) -> DataFrame:
    """Add the columns the strategy's signals read (bar number, running sum, log return, RSI per period, Hurst exponent per warm-up)."""
    return _with_inputs(bars, [(strategy, p) for p in grid], {strategy})


def _with_inputs(bars: DataFrame, points: list[tuple[str, dict]], strategies: set[str]) -> DataFrame:
    from tidewright.operators.diagnostics import held_hurst
    from tidewright.operators.scan import wilder_rsis

    of = lambda strategy, name: sorted({p[name] for s, p in points if s == strategy})
    if "rsi" in strategies:
        bars = wilder_rsis(bars, {n: f"rsi_{n}" for n in of("rsi", "period")})
    if "regime-trend" in strategies:
        for warm in sorted({regime_trend(**p)[1] for s, p in points if s == "regime-trend"}):
            bars = held_hurst(bars, warm, HURST_WINDOW, out=f"hurst_{warm}")
    bars = bars.select("*", win.log_return("close").alias("log_ret"), win.position().alias("bar"), F.sum("close").over(win.whole_prefix()).alias("close_sum"))
    if "vol-target" in strategies:  # once per lookback, whatever the number of targets that read it
        bars = bars.select("*", *[(win.fixed_weight_ewma_vol("log_ret", n, 0.94) * 100).alias(f"vol_{n}") for n in of("vol-target", "lookback")])
    if "mean-reversion" in strategies:  # likewise once per window
        frames = {n: win.trailing(n) for n in of("mean-reversion", "window")}
        bars = bars.select("*", *[c for n, f in frames.items() for c in (F.avg("close").over(f).alias(f"mean_{n}"), F.stddev_samp("close").over(f).alias(f"sd_{n}"))])
    return bars


def _given(strategy: str, params: dict) -> dict[str, Column]:
    """Columns of ``with_inputs`` that a signal would otherwise compute again at every grid point."""
    if strategy == "vol-target":
        return {"vol": F.col(f"vol_{params['lookback']}")}
    if strategy == "mean-reversion":
        return {"mean": F.col(f"mean_{params['window']}"), "sd": F.col(f"sd_{params['window']}")}
    return {}


def grid_signals(bars: DataFrame, strategy: str, grid: list[dict], first_id: int = 0, spread: bool = False) -> DataFrame:
    """One row per bar and grid point: (symbol, run_id, ts, open, close, pos, signal, warmup).

    All grid points are columns of one pass over the bars, then unfolded, so indicators are computed
    once and the bars are shuffled once. With many symbols the runs stay in their symbol's partition;
    ``spread`` deals them out by (symbol, run) for the case of few symbols and many points.
    """
    return run_signals(bars, [(strategy, p) for p in grid], first_id, spread)


def run_signals(bars: DataFrame, points: list[tuple[str, dict]], first_id: int = 0, spread: bool = False) -> DataFrame:
    """``grid_signals`` of points (strategy, parameters) of any strategies: one pass over the bars for all of them."""
    base = _with_inputs(bars, points, {s for s, _ in points})
    runs = []
    for i, (strategy, params) in enumerate(points):
        signal, warmup = STRATEGIES[strategy](**params, **_given(strategy, params))
        runs.append((i + first_id, signal, warmup))
    df = base.select("symbol", "ts", "open", "close", "bar", *[x.cast("double").alias(f"s{i}") for i, x, _ in runs])
    points = F.array(*[F.struct(F.lit(i).cast("long").alias("run_id"), F.col(f"s{i}").alias("signal"), F.lit(n).alias("warmup")) for i, _, n in runs])
    out = df.select("symbol", "ts", "open", "close", "bar", F.explode(points).alias("p")).select("symbol", "p.run_id", "ts", "open", "close", "bar", "p.signal", "p.warmup")
    return dealt(out, "symbol", "run_id") if spread else out


def sweep(bars: DataFrame, strategy: str, fixed: dict | None = None, ex: Execution | None = None) -> DataFrame:
    """Sharpe and return at every point of the strategy's two-parameter grid; NULL where the parameters contradict each other."""
    (xn, xs), (yn, ys) = AXES[strategy]
    grid = [{xn: x, yn: y, **(fixed or {})} for y in ys for x in xs]
    valid = [p for p in grid if not (xn == "fast" and p["fast"] >= p["slow"]) and not (xn == "lookback" and p.get("skip", 0) >= p["lookback"])]
    stats = performance_stats(run_backtest(grid_signals(bars, strategy, valid, spread=True), ex), RUN).select(*RUN, "sharpe", "total_return_pct")
    ids = {(p[xn], p[yn]): i for i, p in enumerate(valid)}
    cells = F.array(*[F.struct(F.lit(float(p[xn])).alias(xn), F.lit(float(p[yn])).alias(yn), F.lit(ids.get((p[xn], p[yn]))).cast("long").alias("run_id")) for p in grid])
    surface = bars.select("symbol").distinct().select("symbol", F.explode(cells).alias("c")).select("symbol", "c.*")
    return surface.join(stats, ["symbol", "run_id"], "left").select("symbol", xn, yn, "run_id", "sharpe", "total_return_pct")


def folds(bars: DataFrame, train: int, test: int, anchored: bool = False) -> DataFrame:
    """Consecutive, non-overlapping test windows per symbol, by bar position (one-based)."""
    n = bars.groupBy("symbol").agg(F.count("*").alias("n")).filter(F.col("n") >= train + test)
    count = F.floor((F.col("n") - train) / test)
    f = n.select("symbol", F.posexplode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("i", "fold"))
    begin = F.col("fold") * test + train
    return f.select("symbol", "fold", (F.lit(1).cast("long") if anchored else begin - train + 1).alias("train_start"), begin.alias("train_end"),
                    (begin + 1).alias("test_start"), (begin + test).alias("test_end"))


def in_folds(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    """Each row once for every fold from ``first`` to ``last`` (expressions of its ``bar``)."""
    r = rows.withColumn("__first", F.greatest(first, F.lit(0)).cast("long")).withColumn("__last", last.cast("long")).filter("__first <= __last")
    return r.withColumn("fold", F.explode(F.sequence("__first", "__last"))).drop("__first", "__last")


def fold_leaks(bars: DataFrame, train: int = 504, test: int = 126) -> DataFrame:
    """Per symbol: rows that some fold selects on, rows that it is evaluated on, and rows that are both, which must be none."""
    f = folds(bars, train, test)
    b = bars.select("symbol", "ts", win.position().alias("bar"))
    sides = in_folds(b, F.ceil((F.col("bar") - train - test) / test), F.floor((F.col("bar") - 1) / test)).join(f, ["symbol", "fold"])
    sides = sides.select("symbol", "fold", "ts", F.col("bar").between(F.col("train_start"), F.col("train_end")).alias("selects"), F.col("bar").between(F.col("test_start"), F.col("test_end")).alias("tests"))
    rows = sides.groupBy("symbol", "fold", "ts").agg(F.max("selects").alias("selects"), F.max("tests").alias("tests"))
    n = lambda c: F.sum(c.cast("long"))
    return rows.groupBy("symbol").agg(n(F.col("selects")).alias("selected"), n(F.col("tests")).alias("evaluated"), n(F.col("selects") & F.col("tests")).alias("overlap"))


def walk_forward(bars: DataFrame, strategy: str, train: int = 504, test: int = 126, ex: Execution | None = None,
                 grid: list[dict] | None = None) -> DataFrame:
    """Out-of-sample returns: each fold picks the grid point with the best train Sharpe and trades the next window.

    Signals of ``FROM_START`` are computed within a fold's bars: its training bars, then its test bars with the warm-up of the point
    it picked; other signals read a fixed number of bars. Settings whose Sharpe ratios agree to nine digits are tied, and the first
    one is taken, as it is where no setting has a ratio.

    Where ``functions.walks`` has the strategy, a symbol's folds are slices of its arrays, so that bars are neither shuffled nor sorted
    again for each fold and point. Symbols with an unknown or impossible price go the way of the windows, which know NULL.
    """
    grid = grid or GRIDS[strategy]
    points = [(p, max(STRATEGIES[strategy](**p)[1], 1)) for p in grid]
    if strategy not in walks.HELD or any(warmup + 2 > train for _, warmup in points):
        return _walk_by_windows(bars, strategy, train, test, ex, grid)
    price = lambda c: (F.col(c) > 0) & (F.col(c) < math.inf)
    whole = F.col("symbol").isNotNull() & F.col("ts").isNotNull() & price("open") & price("close")
    odd = checkpointed(bars.filter(~F.coalesce(whole, F.lit(False))).select(F.col("symbol").alias("__odd")).distinct())
    if odd.isEmpty():
        return _walk_by_arrays(bars, strategy, points, train, test, ex)
    same = F.col("symbol").eqNullSafe(F.col("__odd"))
    plain = _walk_by_arrays(bars.join(odd, same, "left_anti"), strategy, points, train, test, ex)
    return plain.unionByName(_walk_by_windows(bars.join(odd, same, "left_semi"), strategy, train, test, ex, grid))


def _walk_by_arrays(bars: DataFrame, strategy: str, points: list[tuple[dict, int]], train: int, test: int, ex: Execution | None) -> DataFrame:
    """``walk_forward`` of symbols whose prices are all known, one shuffle of the bars; a task holds the symbols of a few batches."""
    ex = ex or Execution()
    # The window leaves a symbol's rows together and in order; their numbers say where a symbol begins, and are checked.
    numbered = dealt(bars.select("symbol", "ts", F.col("open").cast("double").alias("open"), F.col("close").cast("double").alias("close")), "symbol")
    numbered = numbered.withColumn("bar", win.position())

    def solved(batches):
        t = pa.Table.from_batches(batches).combine_chunks()
        bar = t["bar"].to_numpy()
        begin = np.flatnonzero(bar == 1)
        size = np.diff(np.append(begin, len(bar)))
        if not np.array_equal(bar, np.arange(len(bar)) - np.repeat(begin, size) + 1):
            raise ValueError("bars are not in the order of their symbols")
        n = np.where(size >= train + test, (size - train) // test, 0)
        fold = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ends = np.repeat(begin, n) + train + fold * test
        for which, k, rows, found in walks.walked(t["open"].to_numpy(), t["close"].to_numpy(), ends, strategy, points, train, test, ex):
            own = t.select(["symbol", "ts"]).take(pa.array(rows.ravel()))
            run = {"symbol": own["symbol"].combine_chunks(), "fold": np.repeat(fold[which], test), "run_id": np.full(rows.size, k), "ts": own["ts"].combine_chunks()}
            yield from pa.table(run | {c: v.ravel() for c, v in found.items()}).to_batches()

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            begin = np.flatnonzero(batch.column("bar").to_numpy() == 1)
            if rows >= ROWS_AT_ONCE and len(begin):
                yield from solved([*held, batch.slice(0, begin[-1])])
                batch, held, rows = batch.slice(begin[-1]), [], 0
            held.append(batch)
            rows += batch.num_rows
        if rows:
            yield from solved(held)

    kinds = dict(numbered.dtypes)
    return numbered.mapInArrow(run, f"symbol {kinds['symbol']}, fold bigint, run_id bigint, ts {kinds['ts']}, exposure double, equity double, benchmark double, cost double, traded boolean")


def _walk_by_windows(bars: DataFrame, strategy: str, train: int, test: int, ex: Execution | None, grid: list[dict]) -> DataFrame:
    """``walk_forward`` for any signal and for unknown prices.

    Most signals read a fixed number of bars, so one signal table serves every fold: folds are slices of it by position, which each
    bar lists by arithmetic, and all (fold, point) runs are back-tested together. Signals of ``FROM_START`` are computed within the slices.
    """
    f = folds(bars, train, test)
    fold_keys = ["symbol", "fold", "run_id"]
    selecting = (F.ceil((F.col("bar") - train) / test), F.floor((F.col("bar") - 1) / test))
    lead = F.greatest("warmup", F.lit(1))
    scoring = (F.ceil((F.col("bar") - train - test) / test), F.floor((F.col("bar") - train - 1 + lead) / test))
    if strategy in FROM_START:
        numbered = bars.select("symbol", "ts", "open", "close", win.position().alias("bar"))
        cut = _signals_within(in_folds(numbered, *selecting).join(f, ["symbol", "fold"]), strategy, grid, ["symbol", "fold", "train_start", "train_end"])
    else:
        signals = grid_signals(bars, strategy, grid, spread=True)
        cut = in_folds(signals, *selecting).join(f, ["symbol", "fold"])
    # A signal inside a fold may only use the fold's own bars once warm-up has passed, which warmup ensures.
    fits = F.col("train_end") - F.col("train_start") + 1 >= F.col("warmup") + 2
    trained = performance_stats(run_backtest(cut.filter(fits), ex, fold_keys), fold_keys)
    order = Window.partitionBy("symbol", "fold").orderBy(F.desc_nulls_last(F.round("sharpe", 9)), "run_id")
    picked = trained.withColumn("r", F.row_number().over(order)).filter("r = 1")
    best = f.join(picked.select("symbol", "fold", "run_id"), ["symbol", "fold"], "left").withColumn("run_id", F.coalesce("run_id", F.lit(0)))
    if strategy not in FROM_START:
        return run_backtest(in_folds(signals, *scoring).join(best, fold_keys), ex, fold_keys)
    warm = {i: STRATEGIES[strategy](**p)[1] for i, p in enumerate(grid)}
    parts = []
    for n in sorted(set(warm.values())):
        chosen = best.filter(F.col("run_id").isin([i for i, k in warm.items() if k == n])).withColumnRenamed("run_id", "picked")
        slices = in_folds(numbered.withColumn("warmup", F.lit(n)), *scoring).drop("warmup").join(chosen, ["symbol", "fold"])
        parts.append(_signals_within(slices, strategy, grid, ["symbol", "fold", "picked"]).filter("run_id = picked"))
    return run_backtest(reduce(DataFrame.unionByName, parts), ex, fold_keys)


def _signals_within(slices: DataFrame, strategy: str, grid: list[dict], keys: list[str]) -> DataFrame:
    """Signals of every grid point inside each slice (rows with equal ``keys``), as if the slice were a symbol's whole history."""
    own = slices.select(F.struct(*keys).alias("symbol"), "ts", "open", "close")
    s = grid_signals(own, strategy, grid, spread=True)
    return s.select(*[F.col(f"symbol.{k}").alias(k) for k in keys], "run_id", "ts", "open", "close", "signal", "warmup")


def stitched(result: DataFrame, initial: float = 10_000.0) -> DataFrame:
    """One out-of-sample curve per symbol from the folds' own returns (each fold restarts its notional)."""
    w = Window.partitionBy("symbol", "fold").orderBy("ts")
    r = result.select("symbol", "fold", "ts", (F.col("equity") / F.lag("equity").over(w) - 1).alias("ret"), (F.col("benchmark") / F.lag("benchmark").over(w) - 1).alias("bench_ret"))
    prefix = win.whole_prefix()
    r = r.filter("ret IS NOT NULL")
    return r.select("symbol", "ts", (initial * F.exp(F.sum(F.log1p("ret")).over(prefix))).alias("equity"), (initial * F.exp(F.sum(F.log1p("bench_ret")).over(prefix))).alias("benchmark"))


def walk_forward_summary(result: DataFrame, ex: Execution | None = None) -> DataFrame:
    """Folds that beat their benchmark by more than 0.01 points, distinct settings, trades and costs."""
    keys = ["symbol", "fold", "run_id"]
    g = run_summary(result, keys)
    return g.groupBy("symbol").agg(
        F.count("*").alias("folds"), F.sum((F.col("excess_return_pct") > 0.01).cast("long")).alias("folds_beating"), F.countDistinct("run_id").alias("distinct_settings"),
        F.sum("trades").alias("trades"), F.sum("total_costs").alias("total_costs"))


def rule_signal(bars: DataFrame, rule: str, wanted: list[tuple[str, int]]) -> DataFrame:
    """A user rule in Spark SQL over indicator columns.

    NaN and a division by zero are unknown. Unknown is SQL's: a comparison with it, negated or not, is unknown, and a rule that
    is unknown in the end is false.
    """
    known = win.with_indicators(bars, wanted)
    known = known.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in known.dtypes])
    # How a rule divides is fixed when its text becomes an expression: by zero it is to give NULL.
    key = "spark.sql.ansi.enabled"
    before = bars.sparkSession.conf.get(key)
    bars.sparkSession.conf.set(key, "false")
    try:
        return known.withColumn("flag", F.coalesce(F.expr(rule).cast("boolean"), F.lit(False)))
    finally:
        bars.sparkSession.conf.set(key, before)


def diagnose_rule(flags: DataFrame, warmup: int, step: int = 1) -> DataFrame:
    """How often the rule is true and how often it changes its mind, over every step-th bar after warm-up."""
    pos = flags.select("symbol", "ts", "flag", (win.position() - 1).alias("pos"))
    kept = pos.filter((F.col("pos") >= warmup) & (F.pmod(F.col("pos") - warmup, F.lit(step)) == 0))
    k = kept.select("symbol", "flag", F.lag("flag").over(win.by_symbol()).alias("prev"))
    g = k.groupBy("symbol").agg(F.count("*").alias("bars_tested"), F.sum(F.col("flag").cast("long")).alias("times_true"),
                                F.sum(F.coalesce(F.col("flag") != F.col("prev"), F.lit(False)).cast("long")).alias("flips"))
    frac = F.col("times_true") / F.col("bars_tested")
    warn = F.concat_ws(";", F.when(frac >= 0.99, "always_true").when(frac <= 0.01, "never_true"), F.when(F.col("flips") > F.col("bars_tested") * 0.4, "flips_often"))
    return g.select("*", frac.alias("fraction_true"), warn.alias("warnings"), ((frac > 0.01) & (frac < 0.99)).alias("ok"))
