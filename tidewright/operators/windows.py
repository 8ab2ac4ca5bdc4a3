"""Trailing, forward and lagged columns per symbol. Positions count sessions, never elapsed time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.nulls import safe_div

def by_symbol():
    """A symbol's rows in time order."""
    return Window.partitionBy("symbol").orderBy("ts")


def trailing(n: int, w=None):
    """The last n rows ending at the current one."""
    w = w or by_symbol()
    return w.rowsBetween(-(n - 1), 0)


def before(n: int, w=None):
    """The n rows before the current one, which is left out."""
    w = w or by_symbol()
    return w.rowsBetween(-n, -1)


def whole_prefix(w=None):
    w = w or by_symbol()
    return w.rowsBetween(Window.unboundedPreceding, 0)


def position(w=None) -> Column:
    w = w or by_symbol()
    return F.row_number().over(w)


def pct_return(c: str, k: int = 1, w=None) -> Column:
    w = w or by_symbol()
    return F.col(c) / F.lag(c, k).over(w) - 1


def log_return(c: str, k: int = 1, w=None) -> Column:
    w = w or by_symbol()
    return F.ln(F.col(c) / F.lag(c, k).over(w))


def change(c: str, k: int = 1, w=None) -> Column:
    w = w or by_symbol()
    return F.col(c) - F.lag(c, k).over(w)


def forward_pct(c: str, h: int, w=None) -> Column:
    """Percent change to the value h rows later; NULL at the end of the series."""
    w = w or by_symbol()
    return (F.lead(c, h).over(w) / F.col(c) - 1) * 100


def forward_log(c: str, h: int, w=None) -> Column:
    w = w or by_symbol()
    return F.ln(F.lead(c, h).over(w) / F.col(c))


def forward_compounded(ret: str, h: int, w=None) -> Column:
    """Return over the next h rows compounded from one-row returns; NULL unless all h are known."""
    w = w or by_symbol()
    frame = w.rowsBetween(1, h)
    total = F.sum(F.log1p(F.col(ret))).over(frame)
    return F.when(F.count(ret).over(frame) == h, F.expm1(total))


def three_way_label(fwd: Column, band: float = 0.004) -> Column:
    """2 above the band, 0 below it, 1 inside or unknown."""
    return F.when(fwd > band, 2).when(fwd < -band, 0).otherwise(1)


def with_lags(df: DataFrame, columns: list[str], lags: list[int], w=None) -> DataFrame:
    """All ``<c>_lag<k>`` columns in one projection, so one sort serves them all."""
    w = w or by_symbol()
    return df.select("*", *[F.lag(c, k).over(w).alias(f"{c}_lag{k}") for c in columns for k in lags])


def rolling_zscore(c: str, n: int, min_periods: int | None = None, w=None) -> Column:
    """(x - mean) / sample std over the trailing window; a constant window is unknown."""
    w = w or by_symbol()
    need = min_periods if min_periods is not None else max(2, n // 2)
    frame = trailing(n, w)
    std = F.stddev_samp(c).over(frame)
    ok = (F.count(c).over(frame) >= need) & (std > 1e-10)
    return F.when(ok, (F.col(c) - F.avg(c).over(frame)) / std)


def drawdown(c: str, w=None) -> Column:
    w = w or by_symbol()
    return F.col(c) / F.max(c).over(whole_prefix(w)) - 1


def compounded(ret: str, w=None) -> Column:
    """Growth of one unit from a return series; an unknown return leaves it unchanged."""
    w = w or by_symbol()
    return F.exp(F.sum(F.log1p(F.coalesce(F.col(ret), F.lit(0.0)))).over(whole_prefix(w)))


def true_range(w=None) -> Column:
    """Largest of the three ranges, skipping those that are unknown on the first row."""
    w = w or by_symbol()
    prev = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def price_features(bars: DataFrame, w=None) -> DataFrame:
    """Candle features, each lagged one bar; needs ``ema5`` and ``ema20`` on the input."""
    w = w or by_symbol()
    df = bars.select(
        "*", log_return("close", 1, w).alias("log_ret"), true_range(w).alias("tr"),
        safe_div(F.col("close") - F.col("open"), F.col("high") - F.col("low")).alias("body"),
    )

    def ago(c: str, k: int = 1) -> Column:
        return F.lag(c, k).over(w)

    def mean(c: str, n: int) -> Column:
        return F.when(F.count(c).over(trailing(n, w)) == n, F.avg(c).over(trailing(n, w)))

    df = df.select(
        "*", mean("volume", 20).alias("vol20"), mean("tr", 14).alias("atr"),
        F.when(F.count("log_ret").over(trailing(20, w)) == 20, F.stddev_samp("log_ret").over(trailing(20, w))).alias("sd20"),
    )
    up = (ago("ema5", 2) < ago("ema20", 2)) & (ago("ema5") > ago("ema20"))
    down = (ago("ema5", 2) > ago("ema20", 2)) & (ago("ema5") < ago("ema20"))
    return df.select(
        *bars.columns,
        safe_div(ago("ema5") - ago("ema20"), ago("ema20")).alias("ema_trend_strength"),
        safe_div(ago("close") - ago("ema20"), ago("ema20")).alias("ema_distance"),
        (ago("close") / ago("close", 13) - 1).alias("momentum_12"),
        safe_div(ago("volume"), ago("vol20")).alias("relative_volume_20"),
        safe_div(ago("volume"), ago("volume", 2)).alias("volume_change"),
        ago("atr").alias("atr_14"),
        safe_div(ago("atr"), ago("close")).alias("atr_percent"),
        ago("sd20").alias("volatility_20"),
        F.when(up, 1).when(down, -1).otherwise(0).alias("ema_cross"),
        ago("body").alias("candle_strength"),
        F.coalesce((ago("close") > ago("ema20")).cast("int"), F.lit(0)).alias("trend_regime"),
    )


# Rule indicators: name -> function of n giving a Column over the past only.
def _vol(n: int, w) -> Column:
    frame = trailing(n, w)
    return F.when(F.count("log_ret").over(frame) >= 2, F.stddev_samp("log_ret").over(frame) * math.sqrt(252.0) * 100)


def _zscore(n: int, w) -> Column:
    frame = trailing(n, w)
    sd = F.stddev_samp("close").over(frame)
    z = F.when(sd > 1e-12, (F.col("close") - F.avg("close").over(frame)) / sd).otherwise(0.0)
    return F.when(F.count("close").over(frame) >= 2, z)


INDICATORS = {
    "sma": lambda n, w=None: F.avg("close").over(trailing(n, w)),
    "vol": lambda n, w=None: _vol(n, w),
    "zscore": lambda n, w=None: _zscore(n, w),
    "ret": lambda n, w=None: pct_return("close", n, w) * 100,
    "highest": lambda n, w=None: F.max("high").over(trailing(n, w)),
    "lowest": lambda n, w=None: F.min("low").over(trailing(n, w)),
}


def with_indicators(bars: DataFrame, wanted: list[tuple[str, int]], w=None) -> DataFrame:
    """Add ``<name>_<n>`` columns; ``ema`` and ``rsi`` come from the recurrence scan."""
    w = w or by_symbol()
    from tidewright.operators.scan import ewm_mean, wilder_rsi

    df = bars.withColumn("log_ret", log_return("close", 1, w))
    for name, n in wanted:
        if name == "ema":
            df = ewm_mean(df, "close", 2.0 / (n + 1), f"ema_{n}")
        elif name == "rsi":
            df = wilder_rsi(df, n, f"rsi_{n}")
    return df.select("*", *[INDICATORS[k](n, w).alias(f"{k}_{n}") for k, n in wanted if k in INDICATORS]).drop("log_ret")


def shock_sigma(window: int, w=None) -> Column:
    """Deviation of the ``window`` values of ``ret`` before a row; NULL unless all of them are known."""
    frame = before(window, w)
    return F.when(F.count("ret").over(frame) == window, F.stddev_samp("ret").over(frame))


def trigger_flag(kind: str, window: int, threshold: float, value: str = "close",
                 market_return: str | None = None, w=None, sigma: Column | None = None) -> Column:
    """1.0 where the condition holds, 0.0 where it does not, NULL where its measure is unknown.

    For ``shock_day`` the input needs a ``ret`` column of one-row returns; ``sigma`` is their ``shock_sigma`` where that is a column
    (a frame is computed again for every mention).
    """
    w = w or by_symbol()
    if kind == "change_pct":
        measure = pct_return(value, window, w) * 100
    elif kind == "change_points":
        measure = change(value, window, w)
    elif kind == "level_below":
        measure = F.col(value)
        return F.when(measure.isNotNull(), (measure < threshold).cast("double"))
    elif kind == "drawdown_pct":
        frame = trailing(window, w)
        peak = F.when(F.count(value).over(frame) >= max(20, window // 4), F.max(value).over(frame))
        measure = (F.col(value) / peak - 1) * 100
        return F.when(measure.isNotNull(), (measure <= threshold).cast("double"))
    elif kind == "shock_day":
        sigma = shock_sigma(window, w) if sigma is None else sigma
        measure = F.when(sigma > 1e-12, F.col("ret") / sigma)
        hit = measure <= threshold
        if market_return:
            hit = hit & F.coalesce(F.col(market_return) * 100 > -1.0, F.lit(False))
        return F.when(measure.isNotNull(), hit.cast("double"))
    else:
        raise ValueError(f"unknown trigger kind {kind!r}")
    hit = measure > threshold if threshold >= 0 else measure < threshold
    return F.when(measure.isNotNull(), hit.cast("double"))


def normalized_surprise(daily: DataFrame, actual: str, consensus: str, window: int, min_periods: int, out: str,
                        w=None) -> DataFrame:
    """Surprise over the std of *earlier* releases, carried forward on the daily calendar.

    A release is a row where ``actual - consensus`` changes. Numbering releases and taking the frame
    over release rows only is done by partitioning on "is a release", so nothing is joined back.
    """
    w = w or by_symbol()
    raw = F.col(actual) - F.col(consensus)
    df = daily.withColumn("__raw", raw)
    prior = F.lag("__raw").over(w)
    df = df.withColumn("__is", F.col("__raw").isNotNull() & (prior.isNull() | (F.col("__raw") != prior)))
    releases = Window.partitionBy("symbol", "__is").orderBy("ts")
    frame = releases.rowsBetween(-window, -1)
    sd = F.when(F.count("__raw").over(frame) >= min_periods, F.stddev_samp("__raw").over(frame))
    # A release whose divisor is unknown has no value of its own; the last known one stays in force.
    df = df.withColumn("__z", F.when(F.col("__is") & (sd > 1e-10), F.col("__raw") / sd))
    return df.withColumn(out, F.last("__z", ignorenulls=True).over(whole_prefix(w))).drop("__raw", "__is", "__z")


def move_observation(bars: DataFrame, lookback: int = 20, w=None) -> DataFrame:
    """Each session's move against the volatility and volume of the sessions before it."""
    w = w or by_symbol()
    df = bars.withColumn("ret", pct_return("close", 1, w))
    prior = before(lookback - 1, w)
    df = df.select(
        "symbol", "ts", "close", F.lag("close").over(w).alias("prior_close"), (F.col("ret") * 100).alias("return_pct"),
        F.count("close").over(before(lookback, w)).alias("context_n"),
        (F.stddev_samp("ret").over(prior) * 100).alias("daily_vol_pct"),
        safe_div("volume", F.avg("volume").over(before(lookback, w))).alias("volume_ratio"),
    )
    sigma = F.when(F.col("daily_vol_pct") <= 1e-9, 0.0).otherwise(F.col("return_pct") / F.col("daily_vol_pct"))
    return df.filter("context_n >= 10").withColumn("sigma_multiple", sigma).withColumn(
        "outlier", outlier_label(F.col("sigma_multiple"))
    )


def outlier_label(sigma: Column) -> Column:
    size = F.abs(sigma)
    return (
        F.when(size >= 3, "3-sigma+").when(size >= 2, "2-sigma").when(size >= 1, "1-sigma").otherwise("typical")
    )


def fixed_weight_ewma_vol(ret: str, n: int, decay: float, w=None) -> Column:
    """Annualised volatility of the last n returns with normalised decaying weights."""
    w = w or by_symbol()
    raw = [decay**k for k in range(n - 1, -1, -1)]
    weights = F.array(*[F.lit(x / sum(raw)) for x in raw])
    squares = F.collect_list(F.col(ret) * F.col(ret)).over(trailing(n, w))
    total = F.aggregate(F.zip_with(squares, weights, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(squares) == n, F.sqrt(total) * math.sqrt(252.0))


def staged_exposure(parts: int, spacing: int, w=None) -> Column:
    """Exposure of an entry in equal parts, one part every ``spacing`` bars."""
    w = w or by_symbol()
    return F.least(F.lit(1.0), (F.floor((position(w) - 1) / spacing) + 1) / parts)


def last_rows(df: DataFrame, n: int) -> DataFrame:
    """The last n rows of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return df.withColumn("__b", F.row_number().over(w)).filter(F.col("__b") <= n).drop("__b")


def indexed_history(bars: DataFrame, n: int, w=None) -> DataFrame:
    """Close with the first of the last n rows set to 100."""
    w = w or by_symbol()
    return last_rows(bars, n).withColumn("indexed", F.col("close") / F.first("close").over(whole_prefix(w)) * 100)
