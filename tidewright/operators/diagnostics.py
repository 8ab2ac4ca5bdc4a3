"""Volatility, regime and mean-reversion diagnostics per symbol, and rolling rough volatility."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators import windows as win
from tidewright.operators.scan import ewm_mean

YEAR = 252.0
# Moments and lags of the scaling regression.
MOMENTS = (0.5, 1.0, 1.5, 2.0, 3.0)
LAGS = (1, 2, 3, 4, 5, 8, 12, 16, 24, 32, 48)


def _recent(n: int):
    return F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))) <= n


def close_to_close_vol(bars: DataFrame, window: int = 21) -> DataFrame:
    r = bars.select("symbol", win.log_return("close").alias("r"), _recent(window).alias("in"))
    g = r.groupBy("symbol").agg(F.stddev_samp(F.when(F.col("in"), F.col("r"))).alias("sd"), F.count(F.when(F.col("in"), F.col("r"))).alias("n"))
    return g.select("symbol", F.when(F.col("n") >= 3, F.col("sd") * math.sqrt(YEAR) * 100).alias("close_to_close_pct"))


def yang_zhang_vol(bars: DataFrame, window: int = 21, min_bars: int = 20) -> DataFrame:
    """Overnight, open-to-close and Rogers-Satchell variance combined; close-to-close where that is not positive."""
    prev = F.lag("close").over(win.by_symbol())
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    rs = F.ln(F.col("high") / F.col("close")) * F.ln(F.col("high") / F.col("open")) + F.ln(F.col("low") / F.col("close")) * F.ln(F.col("low") / F.col("open"))
    b = bars.select("symbol", F.ln(F.col("open") / prev).alias("on"), F.ln(F.col("close") / F.col("open")).alias("oc"), rs.alias("rs"),
                    win.log_return("close").alias("r"), back.alias("b"))
    # The oldest bar of the window only provides the previous close.
    last = F.max("b").over(Window.partitionBy("symbol"))
    b = b.withColumn("use", F.col("b") < F.least(F.lit(window + 1), last))
    pick = {c: F.when(F.col("use"), F.col(c)) for c in ("on", "oc", "rs", "r")}
    g = b.groupBy("symbol").agg(
        F.count(pick["on"]).alias("n"), F.var_samp(pick["on"]).alias("von"), F.var_samp(pick["oc"]).alias("voc"), F.avg(pick["rs"]).alias("mrs"),
        F.stddev_samp(F.when(F.col("b") <= window, F.col("r"))).alias("sd"))
    k = 0.34 / (1.34 + (F.col("n") + 1) / (F.col("n") - 1))
    var = F.col("von") + k * F.col("voc") + (1 - k) * F.col("mrs")
    cc = F.col("sd") * math.sqrt(YEAR) * 100
    return g.select("symbol", F.when(F.col("n") + 1 >= min_bars, F.when(var > 0, F.sqrt(F.when(var > 0, var) * YEAR) * 100).otherwise(cc)).alias("yang_zhang_pct"))


def ewma_vol(bars: DataFrame, decay: float = 0.94, min_rows: int = 20) -> DataFrame:
    """RiskMetrics volatility of each symbol's last session."""
    r = bars.select("symbol", "ts", win.log_return("close").alias("r")).withColumn("sq", F.col("r") * F.col("r"))
    e = ewm_mean(r, "sq", 1 - decay, "v")
    g = e.groupBy("symbol").agg(F.max_by("v", "ts").alias("v"), F.count("r").alias("n"))
    return g.select("symbol", F.when(F.col("n") >= min_rows, F.sqrt(F.col("v") * YEAR) * 100).alias("ewma_pct"), "n")


def vol_regime(ewma: Column, long_run: Column) -> Column:
    ratio = ewma / F.when(long_run > 0, long_run)
    return F.when(ratio.isNull(), "unknown").when(ratio > 1.35, "elevated").when(ratio < 0.75, "subdued").otherwise("normal")


def expected_rescaled_range(n: Column) -> Column:
    """Anis-Lloyd expectation of R/S for n independent observations."""
    terms = F.aggregate(F.sequence(F.lit(1), (n - 1).cast("int")), F.lit(0.0), lambda acc, i: acc + F.sqrt((n - i) / i))
    return (n - 0.5) / n * F.pow(n * math.pi / 2, F.lit(-0.5)) * terms


def rescaled_range_hurst(bars: DataFrame, min_rows: int = 120, min_lag: int = 8, steps: int = 12) -> DataFrame:
    """Hurst exponent per symbol from bias-corrected rescaled range over twelve geometric lags."""
    r = bars.select("symbol", "ts", win.log_return("close").alias("r")).filter("r IS NOT NULL")
    series = r.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("ts", "r"))).alias("s")).select("symbol", F.col("s.r").alias("r"))
    return _rescaled_range(series, min_rows, min_lag, steps)


def _chunk_ranges(r: np.ndarray, lag: int) -> float | None:
    """Mean of range over standard deviation of the whole chunks of ``lag`` values; None where every chunk is flat."""
    c = r[: len(r) // lag * lag].reshape(-1, lag)
    dev = c - c.mean(axis=1, keepdims=True)
    cum = np.cumsum(dev, axis=1)
    spread, sd = cum.max(axis=1) - cum.min(axis=1), np.sqrt((dev * dev).sum(axis=1) / (lag - 1))
    ok = (sd > 1e-12) & (spread > 0)
    return float((spread[ok] / sd[ok]).mean()) if ok.any() else None


def _rescaled_range(series: DataFrame, min_rows: int, min_lag: int, steps: int) -> DataFrame:
    """The estimate from (symbol, r), where ``r`` is the array of a series' returns in order.

    A series is one row from here on: chunks of all lags are cut inside it, and the regression sums its dozen points where they lie.
    """
    n = F.size("r")
    top = F.floor(n / 4)
    lag = lambda i: F.when(i == 0, F.lit(min_lag)).when(i == steps - 1, top).otherwise(F.floor(min_lag * F.pow(top / min_lag, i / (steps - 1))))
    lags = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: lag(i).cast("long")))
    x = series.filter(n >= min_rows).select("symbol", "r", F.filter(lags, lambda v: F.floor(F.size("r") / v) >= 2).alias("lags"))

    def run(batches):
        for batch in batches:
            rs, at = batch.column("r"), batch.column("lags")
            cuts, values = rs.offsets.to_numpy(), rs.values.to_numpy(zero_copy_only=False)
            found = [[_chunk_ranges(values[a:b], k) for k in some] for a, b, some in zip(cuts[:-1], cuts[1:], at.to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("symbol"), at, pa.array(found, pa.list_(pa.float64()))], names=["symbol", "lags", "rs"])

    kind = x.schema["symbol"].dataType.simpleString()
    m = x.mapInArrow(run, f"symbol {kind}, lags array<bigint>, rs array<double>").select("symbol", F.explode(F.arrays_zip("lags", "rs")).alias("m")).filter("m.rs IS NOT NULL")
    m = m.select("symbol", F.col("m.lags").alias("lag"), F.col("m.rs").alias("rs"))
    lg = m.select("symbol", F.ln(F.col("lag").cast("double")).alias("x"), (F.ln("rs") - F.ln(expected_rescaled_range(F.col("lag")))).alias("y"))
    g = lg.groupBy("symbol").agg(F.count("*").alias("k"), F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"),
                                 F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy")).filter("k >= 4")
    se = F.sqrt((1 - F.col("r2")) * F.col("syy") / F.col("sxx") / (F.col("k") - 2))
    return g.select("symbol", (F.col("slope") + 0.5).alias("hurst"), se.alias("hurst_se"), F.col("r2").alias("hurst_r2"))


def variance_ratio(bars: DataFrame, q: int = 5) -> DataFrame:
    """Lo-MacKinlay variance ratio and its heteroskedasticity-robust z."""
    r = bars.select("symbol", "ts", win.log_return("close").alias("r")).filter("r IS NOT NULL")
    every = Window.partitionBy("symbol")
    w = win.by_symbol()
    c = r.select("symbol", "ts", (F.col("r") - F.avg("r").over(every)).alias("c"), win.position().alias("pos"))
    c = c.select("*", F.when(F.col("pos") >= q, F.sum("c").over(w.rowsBetween(-(q - 1), 0))).alias("agg"), (F.col("c") * F.col("c")).alias("c2"))
    c = c.select("*", *[(F.col("c2") * F.lag("c2", j).over(w)).alias(f"p{j}") for j in range(1, q)])
    g = c.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("c2").alias("s2"), F.sum(F.col("agg") * F.col("agg")).alias("sq"), *[F.sum(f"p{j}").alias(f"t{j}") for j in range(1, q)])
    n = F.col("n")
    m = q * (n - q + 1) * (1 - q / n)
    ratio = (F.col("sq") / m) / (F.col("s2") / (n - 1))
    den = F.col("s2") * F.col("s2") / n
    theta = sum((F.lit((2.0 * (q - j) / q) ** 2) * F.col(f"t{j}") / den for j in range(1, q)), F.lit(0.0))
    ok = (n >= 10 * q) & (F.col("s2") / (n - 1) > 1e-16)
    g = g.filter(ok).select("symbol", ratio.alias("variance_ratio"), theta.alias("theta"), "n")
    z = F.when(F.col("theta") > 0, (F.col("variance_ratio") - 1) / F.sqrt(F.col("theta") / F.col("n"))).otherwise(0.0)
    return g.select("symbol", "variance_ratio", z.alias("variance_ratio_z"), F.col("n").alias("observations"))


def regime_class(hurst: Column, se: Column, z: Column) -> Column:
    """Trending, mean-reverting or random walk where both agree (or one detects nothing), else unclear."""
    band = F.greatest(2 * se, F.lit(0.05))
    h = F.when(hurst > 0.5 + band, "trending").when(hurst < 0.5 - band, "mean-reverting").otherwise("random walk")
    v = F.when(z > 1.96, "trending").when(z < -1.96, "mean-reverting").otherwise("random walk")
    return F.when(h == v, h).when((h == "random walk") | (v == "random walk"), "random walk").otherwise("unclear")


def regime(bars: DataFrame, q: int = 5) -> DataFrame:
    j = rescaled_range_hurst(bars).join(variance_ratio(bars, q), "symbol")
    return j.withColumn("classification", regime_class(F.col("hurst"), F.col("hurst_se"), F.col("variance_ratio_z")))


def half_life(bars: DataFrame, window: int = 63, min_rows: int = 73) -> DataFrame:
    """AR(1) coefficient with its error, half-life where 0 < b < 1, and the z-score against the last window.

    Whether a unit root is rejected is a separate estimate; see ``estimators.unit_root``.
    """
    b = bars.select("symbol", "ts", "close", F.lag("close").over(win.by_symbol()).alias("prev"), _recent(window).alias("in"))
    recent = F.when(F.col("in"), F.col("close"))
    g = b.groupBy("symbol").agg(
        F.count("*").alias("n"), F.regr_slope("close", "prev").alias("b"), F.regr_r2("close", "prev").alias("r2"), F.regr_sxx("close", "prev").alias("sxx"),
        F.regr_syy("close", "prev").alias("syy"), F.regr_count("close", "prev").alias("m"), F.avg(recent).alias("rolling_mean"), F.stddev_samp(recent).alias("rolling_std"),
        F.max_by("close", "ts").alias("current")).filter(F.col("n") >= min_rows)
    se = F.sqrt((1 - F.col("r2")) * F.col("syy") / F.col("sxx") / (F.col("m") - 2))
    theta = -F.ln(F.when((F.col("b") > 0) & (F.col("b") < 1), F.col("b")))
    z = F.when(F.col("rolling_std") > 1e-12, (F.col("current") - F.col("rolling_mean")) / F.col("rolling_std")).otherwise(0.0)
    return g.select("symbol", z.alias("z_score"), F.when(theta > 1e-12, math.log(2) / theta).alias("half_life_days"), F.col("b").alias("ar_coefficient"),
                    se.alias("ar_standard_error"), "rolling_mean", "rolling_std", F.col("n").alias("observations"))


def with_reasons(bars: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with a row for every symbol of ``bars``: where an estimate is missing, ``error`` says how many sessions there were."""
    every = bars.filter("close IS NOT NULL").groupBy("symbol").agg(F.count("*").alias("__n"))
    j = every.join(found.withColumn("__found", F.lit(True)), "symbol", "left")
    return j.withColumn("error", F.when(F.col("__found").isNull(), F.concat(F.lit("no estimate from "), F.col("__n").cast("string"), F.lit(" sessions")))).drop("__n", "__found")


def realized_vol(bars: DataFrame, n: int = 5, floor: float = 1e-4) -> DataFrame:
    r = bars.select("symbol", "ts", win.log_return("close").alias("r"))
    frame = win.trailing(n)
    sd = F.when(F.count("r").over(frame) == n, F.greatest(F.stddev_samp("r").over(frame), F.lit(floor)))
    return r.select("symbol", "ts", sd.alias("rv"))


def _slope_weights(lags: tuple[int, ...]) -> list[float]:
    x = [math.log(v) for v in lags]
    mean = sum(x) / len(x)
    den = sum((v - mean) ** 2 for v in x)
    return [(v - mean) / den for v in x]


def _abs_moment_log(q: float) -> float:
    """Log of E|N(0,1)|^q."""
    return q / 2 * math.log(2) + math.lgamma((q + 1) / 2) - 0.5 * math.log(math.pi)


def scaling_columns(moment_log: dict[tuple[float, int], Column], moments=MOMENTS, lags=LAGS) -> dict[str, Column]:
    """Hurst, nu and R2 from log structure functions: slopes are fixed dot products with log-lag weights."""
    weights = _slope_weights(lags)
    mean_x = sum(math.log(v) for v in lags) / len(lags)
    zeta, log_nu = [], []
    for q in moments:
        logs = [moment_log[q, lag] for lag in lags]
        slope = sum((w * c for w, c in zip(weights, logs)), F.lit(0.0))
        mean_y = sum(logs, F.lit(0.0)) / len(lags)
        zeta.append(slope)
        log_nu.append((mean_y - slope * mean_x - _abs_moment_log(q)) / q)
    qq = sum(q * q for q in moments)
    hurst = sum((q * z for q, z in zip(moments, zeta)), F.lit(0.0)) / qq
    return {"hurst": hurst, "log_nu": sum(log_nu, F.lit(0.0)) / len(moments), **{f"zeta_{i}": z for i, z in enumerate(zeta)}}


def _finish(df: DataFrame, moments=MOMENTS) -> DataFrame:
    zs = [F.col(f"zeta_{i}") for i in range(len(moments))]
    mean = sum(zs, F.lit(0.0)) / len(moments)
    res = sum(((z - F.col("hurst") * q) * (z - F.col("hurst") * q) for z, q in zip(zs, moments)), F.lit(0.0))
    tot = sum(((z - mean) * (z - mean) for z in zs), F.lit(0.0))
    return df.select("symbol", "ts", "rv", "hurst", F.exp("log_nu").alias("nu"), (1 - res / F.greatest(tot, F.lit(1e-15))).alias("hurst_r2"))


def _log_moments(vol: DataFrame, moments, lags) -> DataFrame:
    """|x - lag(x)|^q for every (lag, q), computed once per row; unknown or zero volatility has no log."""
    v = vol.withColumn("x", F.ln(F.when(F.col("rv") > 1e-8, F.col("rv"))))
    v = v.select("symbol", "ts", "rv", "x", *[F.abs(F.col("x") - F.lag("x", lag).over(win.by_symbol())).alias(f"d_{lag}") for lag in lags])
    return v.select("symbol", "ts", "rv", "x", *[F.pow(f"d_{lag}", F.lit(q)).alias(f"m_{i}_{lag}") for lag in lags for i, q in enumerate(moments)])


def point_rough_vol(vol: DataFrame, moments=MOMENTS, lags=LAGS) -> DataFrame:
    """One scaling estimate over each symbol's whole volatility history."""
    known = vol.filter("rv > 1e-8")
    m = _log_moments(known, moments, lags)
    g = m.groupBy("symbol").agg(*[F.ln(F.avg(f"m_{i}_{lag}")).alias(f"l_{i}_{lag}") for lag in lags for i in range(len(moments))],
                                F.max("ts").alias("ts"), F.max_by("rv", "ts").alias("rv"), F.count("x").alias("n")).filter(F.col("n") >= 3 * max(lags))
    cols = scaling_columns({(q, lag): F.col(f"l_{i}_{lag}") for i, q in enumerate(moments) for lag in lags}, moments, lags)
    return _finish(g.select("symbol", "ts", "rv", *[c.alias(n) for n, c in cols.items()]), moments)


def rolling_rough_vol(vol: DataFrame, window: int = 250, baseline: int = 120, moments=MOMENTS, lags=LAGS) -> DataFrame:
    """Rolling scaling estimate, its lagged median baseline and the drop below it.

    The window means are differences of running sums (a running sum minus itself ``k`` rows ago), so
    the cost per row does not depend on the window length.
    """
    w = win.by_symbol()
    run = win.whole_prefix()
    m = _log_moments(vol, moments, lags)
    names = [f"m_{i}_{lag}" for lag in lags for i in range(len(moments))]
    m = m.select("symbol", "ts", "rv", "x", F.count("x").over(win.trailing(window)).alias("known"), *[F.sum(c).over(run).alias(c) for c in names])

    def mean(i: int, lag: int) -> Column:
        c, k = f"m_{i}_{lag}", window - lag
        total = F.col(c) - F.coalesce(F.lag(c, k).over(w), F.lit(0.0))
        return F.when((F.col("known") == window) & (total > 0), F.ln(total / k))

    m = m.select("symbol", "ts", "rv", *[mean(i, lag).alias(f"l_{i}_{lag}") for lag in lags for i in range(len(moments))])
    cols = scaling_columns({(q, lag): F.col(f"l_{i}_{lag}") for i, q in enumerate(moments) for lag in lags}, moments, lags)
    h = _finish(m.select("symbol", "ts", "rv", *[c.alias(n) for n, c in cols.items()]), moments)
    frame = win.before(baseline)
    base = F.when(F.count("hurst").over(frame) >= baseline // 3, F.percentile("hurst", 0.5).over(frame))
    return h.withColumn("hurst_baseline", base).withColumn("hurst_drop", F.col("hurst_baseline") - F.col("hurst"))


# Lanczos approximation (g = 7, nine terms).
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def gamma(x: Column) -> Column:
    """Gamma function for x > 0.5."""
    z = x - 1
    s = sum((F.lit(c) / (z + i) for i, c in enumerate(LANCZOS[1:], 1)), F.lit(LANCZOS[0]))
    t = z + 7.5
    return math.sqrt(2 * math.pi) * F.pow(t, z + 0.5) * F.exp(-t) * s


def rfsv_forecast(rough: DataFrame, window: int = 250, horizon: int = 21) -> DataFrame:
    """Kernel-weighted volatility forecast ``horizon`` days out; the last value where H is outside (0, 1/2).

    Weights depend on each row's H, so they are built per row over the trailing window's array.
    """
    hist = F.collect_list(F.ln("rv")).over(win.trailing(window))
    df = rough.withColumn("hist", F.reverse(hist))
    h = F.col("hurst")
    rough_ok = (h > 0) & (h < 0.5)
    u = F.sequence(F.lit(0), F.lit(window - 1))
    kernel = F.transform(u, lambda i: F.when(i == 0, 1 / (0.5 + horizon) / (0.5 - h)).otherwise(1 / ((i + 0.5 + horizon) * F.pow(i + 0.5, h + 0.5))))
    df = df.withColumn("k", F.when(rough_ok, kernel))
    total = F.aggregate("k", F.lit(0.0), lambda a, x: a + x)
    dot = F.aggregate(F.zip_with("k", "hist", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    const = gamma(1.5 - h) / (gamma(h + 0.5) * gamma(2 - 2 * h))
    df = df.withColumn("expected", F.when(rough_ok, dot / total).when(h.isNotNull(), F.ln("rv")))
    df = df.withColumn("forecast_variance", F.when(rough_ok, const * F.col("nu") * F.col("nu") * F.pow(F.lit(float(horizon)), 2 * h)).when(h.isNotNull(), 0.0))
    df = df.withColumn("rv_forecast", F.exp(F.col("expected") + 0.5 * F.col("forecast_variance")))
    return df.withColumn("rv_forecast_ratio", F.col("rv_forecast") / F.col("rv")).drop("hist", "k", "expected")


def held_hurst(bars: DataFrame, warm: int, window: int = 400, refresh: int = 21, out: str = "hurst") -> DataFrame:
    """Bars with the Hurst exponent of the last ``window`` returns, estimated at bar ``warm`` and then on multiples of ``refresh``, held in between.

    A refresh row with no estimate counts as 0.5.
    """
    b = bars.select("*", win.log_return("close").alias("__r"), win.position().alias("__bar"))
    at = F.col("__bar")
    due = (at == warm) | ((at > warm) & (at % refresh == 0))
    # A symbol's returns are one array, and every refresh row is a slice of it: its own little series for the rescaled-range estimate.
    every = b.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("__bar", "__r"))).alias("all")).filter(F.size("all") >= warm)
    later = F.filter(F.sequence(F.lit(warm), F.size("all")), lambda k: (k == warm) | (k % refresh == 0))
    x = every.select("symbol", "all", F.explode(later).alias("at"))
    held = F.slice("all", F.greatest(F.col("at") - window + 1, F.lit(1)), F.least(F.col("at"), F.lit(window)))
    known = F.filter(F.transform(held, lambda e: e["__r"]), lambda v: v.isNotNull())
    x = x.select(F.struct("symbol", "at").alias("symbol"), known.alias("r"))
    h = _rescaled_range(x, 120, 8, 12).select(F.col("symbol.symbol").alias("symbol"), F.col("symbol.at").alias("__bar"), F.col("hurst").alias("__h"))
    j = b.join(h, ["symbol", "__bar"], "left").withColumn("__h", F.when(due, F.coalesce("__h", F.lit(0.5))))
    return j.select(*[c for c in bars.columns if c != out], F.last("__h", True).over(win.whole_prefix()).alias(out))


def regime_trend_signal(bars: DataFrame, fast: int, slow: int, threshold: float, window: int = 400, refresh: int = 21) -> DataFrame:
    """Moving-average signal that stands aside while the held Hurst exponent is under ``threshold``."""
    warm = max(slow, window) + 1
    j = held_hurst(bars.select("symbol", "ts", "open", "close"), warm, window, refresh).withColumn("bar", win.position())
    up = F.avg("close").over(win.trailing(fast)) > F.avg("close").over(win.trailing(slow))
    return j.select("symbol", "ts", "open", "close", "hurst", F.when(F.col("bar") >= warm, F.when(F.col("hurst") < threshold, 0.0).otherwise(up.cast("double"))).alias("signal"), F.lit(warm).alias("warmup"))
