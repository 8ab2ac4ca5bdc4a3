"""Summaries of equity curves, horizon risk, calibration and plan arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.nulls import safe_div
from tidewright.operators import windows as win


FLAT = 1e-12


def performance_stats(equity: DataFrame, keys: list[str], periods: int = 252, risk_free: float = 0.0, more: dict[str, Column] | None = None) -> DataFrame:
    """Return, volatility, Sharpe, drawdown and win statistics of each equity curve, in one shuffle on its keys.

    A period whose return is zero up to rounding noise is flat: neither a win nor a loss,
    and equal troughs up to that noise count as one, at the first of them. ``more`` are aggregates of all rows
    of ``equity``, also those without a value, from the same pass.
    """
    w = Window.partitionBy(*keys).orderBy("ts")
    prefix = w.rowsBetween(Window.unboundedPreceding, 0)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    known = F.col("equity").isNotNull()
    more = more or {}
    e = (equity if more else equity.select(*keys, "ts", "equity")).select(
        "*", F.when(known, F.count("equity").over(prefix)).alias("pos"), (F.col("equity") / F.last("equity", ignorenulls=True).over(earlier) - 1).alias("ret"),
        ((F.col("equity") / F.max("equity").over(prefix) - 1) * 100).alias("dd"))
    # The last high so far and the deepest fall before are carried along: the last row that falls deeper is the trough, without a look back at all rows.
    depth = F.round("dd", 9)
    e = e.select("*", F.max(F.when(F.col("dd") >= -1e-12, F.col("pos"))).over(prefix).alias("high"), F.coalesce(depth < F.min(depth).over(earlier), F.col("pos") == 1).alias("deeper"))
    per_period = (1 + risk_free) ** (1.0 / periods) - 1
    g = e.groupBy(*keys).agg(
        F.count("equity").alias("n_periods"), F.max_by("equity", "pos").alias("last"), F.min_by("equity", "pos").alias("first"),
        F.stddev_samp("ret").alias("sd"), F.avg("ret").alias("mean"), F.min("dd").alias("max_drawdown_pct"),
        F.max(F.when(F.col("deeper"), F.col("pos"))).alias("trough"), F.max(F.when(F.col("deeper"), F.col("high"))).alias("peak"),
        F.sum((F.col("ret") > FLAT).cast("long")).alias("wins"), F.sum((F.col("ret") < -FLAT).cast("long")).alias("losses"),
        F.avg(F.when(F.col("ret") > FLAT, F.col("ret"))).alias("win"), F.avg(F.when(F.col("ret") < -FLAT, F.col("ret"))).alias("loss"), *[v.alias(n) for n, v in more.items()],
    ).filter("n_periods >= 3")
    growth = F.col("last") / F.col("first")
    moving = F.col("wins") + F.col("losses")
    return g.select(
        *keys, ((growth - 1) * 100).alias("total_return_pct"),
        ((F.pow(growth, periods / (F.col("n_periods") - 1)) - 1) * 100).alias("annualized_return_pct"),
        (F.col("sd") * F.sqrt(F.lit(float(periods))) * 100).alias("annualized_vol_pct"),
        F.when(F.col("sd") > 1e-12, (F.col("mean") - per_period) / F.col("sd") * F.sqrt(F.lit(float(periods)))).alias("sharpe"),
        "max_drawdown_pct", F.when(F.col("max_drawdown_pct") < 0, F.col("trough") - F.col("peak")).otherwise(0).cast("long").alias("max_drawdown_bars"),
        F.when(moving > 0, F.col("wins") / moving * 100).otherwise(0.0).alias("win_rate_pct"),
        safe_div(F.col("win"), F.abs("loss")).alias("payoff_ratio"), "n_periods", *more,
    )


def horizon_risk(bars: DataFrame, horizon: int, min_windows: int = 504) -> DataFrame:
    """Overlapping window returns and square-root-of-time volatility per symbol; NULL-free, short histories left out."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    b = bars.select("symbol", "ts", "close", back.alias("b"), win.pct_return("close").alias("ret"), win.forward_pct("close", horizon).alias("fwd"))
    g = b.groupBy("symbol").agg(
        F.max(F.when(F.col("b") == 1, F.col("close"))).alias("current_price"), (F.stddev_samp(F.when(F.col("b") <= 63, F.col("ret"))) * 100).alias("daily_vol_pct"),
        F.percentile("fwd", 0.1).alias("p10_pct"), F.percentile("fwd", 0.5).alias("median_pct"), F.percentile("fwd", 0.9).alias("p90_pct"),
        F.min("fwd").alias("worst_pct"), F.count("fwd").alias("n_windows"),
    ).filter(F.col("n_windows") >= min_windows)
    vol = F.col("daily_vol_pct") * F.sqrt(F.lit(float(horizon)))
    return g.withColumn("horizon_vol_pct", vol).withColumn("bad_stretch_loss_pct", F.least(2 * vol, F.lit(95.0)))


def size_for_loss(max_loss: Column, amount: Column, bad_loss_pct: Column) -> Column:
    """Amount to invest so that a bad stretch costs about the loss limit."""
    return F.when(bad_loss_pct <= 0, amount).otherwise(F.least(amount, max_loss / (bad_loss_pct / 100)))


def risk_gate(df: DataFrame, risk_fraction: float, max_leverage: float) -> DataFrame:
    """Position size from the stop distance, the leverage it needs, and whether the trade is allowed."""
    size = safe_div(F.col("account") * risk_fraction, F.col("stop_distance"))
    leverage = size / F.col("account")
    return df.select("*", size.alias("position_size"), leverage.alias("leverage_required"), (leverage <= max_leverage).alias("trade_allowed"))


def stop_paths(bars: DataFrame, horizon: int, stop_pct: Column | float) -> DataFrame:
    """Each start's outcome with an exit at the first close at or below the stop, else at the horizon."""
    level = 1 - (F.lit(stop_pct) if isinstance(stop_pct, float) else stop_pct) / 100
    ahead = F.collect_list("close").over(win.by_symbol().rowsBetween(1, horizon))
    p = bars.withColumn("path", ahead).filter(F.size("path") == horizon).withColumn("level", level)
    p = p.withColumn("ratios", F.transform("path", lambda x: x / F.col("close")))
    hit = F.get(F.filter("ratios", lambda r: r <= F.col("level")), F.lit(0))
    return p.select("symbol", "ts", hit.isNotNull().alias("stopped"), ((F.coalesce(hit, F.element_at("ratios", -1)) - 1) * 100).alias("outcome_pct"))


def stop_outcomes(bars: DataFrame, horizon: int, stop_pct: float) -> DataFrame:
    return stop_paths(bars, horizon, stop_pct).groupBy("symbol").agg(
        (F.avg(F.col("stopped").cast("double")) * 100).alias("hit_share_pct"), F.percentile("outcome_pct", 0.1).alias("p10_pct"),
        F.percentile("outcome_pct", 0.5).alias("median_pct"), F.percentile("outcome_pct", 0.9).alias("p90_pct"), F.min("outcome_pct").alias("worst_pct"),
        F.count("*").alias("n_windows"),
    )


def pinball_loss(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean pinball loss over rows (y, level, quantile)."""
    u = F.col("y") - F.col("quantile")
    loss = F.greatest(F.col("level") * u, (F.col("level") - 1) * u)
    return rows.groupBy(*keys).agg(F.avg(loss).alias("pinball"), F.count("*").alias("n"))


def coverage_report(rows: DataFrame, baseline: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """Per level: empirical coverage, its error and standard error, and skill against unconditional quantiles.

    ``rows`` has (keys, y, level, quantile), ``baseline`` (keys, level, base_quantile). The standard
    error uses n / horizon effective rows because overlapping outcomes are not independent.
    """
    return coverage_scores(rows.join(baseline, [*keys, "level"]), keys, horizon)


def coverage_scores(rows: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """``coverage_report`` of rows that carry their own ``base_quantile``."""
    def loss(q: str) -> Column:
        u = F.col("y") - F.col(q)
        return F.greatest(F.col("level") * u, (F.col("level") - 1) * u)
    g = rows.groupBy(*keys, "level").agg(
        F.count("*").alias("n"), F.avg((F.col("y") <= F.col("quantile")).cast("double")).alias("coverage"),
        F.avg(loss("quantile")).alias("pinball"), F.avg(loss("base_quantile")).alias("base_pinball"))
    effective = F.greatest(F.lit(2), F.floor(F.col("n") / horizon))
    se = F.sqrt(F.col("level") * (1 - F.col("level")) / effective)
    err = F.col("coverage") - F.col("level")
    return g.select(*keys, "level", "n", "coverage", err.alias("error"), se.alias("standard_error"),
                    (1 - safe_div("pinball", "base_pinball")).alias("skill"), (F.abs(err) <= 2 * se).alias("calibrated"))


def coverage_verdict(report: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: the level that misses most in standard errors (the lower of equals), by how much, and whether all hold."""
    miss = F.abs("error") / F.col("standard_error")
    worst = F.max(F.struct(F.round(miss, 6).alias("miss"), (-F.col("level")).alias("low")))
    g = report.groupBy(*keys).agg(F.count("*").alias("levels"), worst.alias("w"), F.min("calibrated").alias("calibrated"))
    return g.select(*keys, "levels", (-F.col("w.low")).alias("worst_level"), F.col("w.miss").alias("worst_miss"), "calibrated")


def surface_ruggedness(grid: DataFrame, keys: list[str], x: str, y: str, value: str, reference_steps: float = 4.0) -> DataFrame:
    """Mean neighbour difference over the spread, scaled by grid density, with its verdict."""
    wx = Window.partitionBy(*keys, y).orderBy(x)
    wy = Window.partitionBy(*keys, x).orderBy(y)
    d = grid.select(*keys, x, y, value, F.abs(F.lead(value).over(wx) - F.col(value)).alias("dx"), F.abs(F.lead(value).over(wy) - F.col(value)).alias("dy"))
    g = d.groupBy(*keys).agg(
        (F.max(value) - F.min(value)).alias("spread"), (F.coalesce(F.sum("dx"), F.lit(0.0)) + F.coalesce(F.sum("dy"), F.lit(0.0))).alias("total"),
        (F.count("dx") + F.count("dy")).alias("n"), F.countDistinct(x).alias("nx"), F.countDistinct(y).alias("ny"))
    steps = (F.col("nx") - 1 + F.col("ny") - 1) / 2
    scale = F.when(steps > 0, steps / reference_steps).otherwise(1.0)
    rugged = F.when((F.col("spread") > 1e-9) & (F.col("n") > 0), F.col("total") / F.col("n") / F.col("spread") * scale).otherwise(0.0)
    g = g.withColumn("ruggedness", rugged)
    verdict = F.when(F.col("ruggedness") > 0.35, "sharp").when(F.col("ruggedness") > 0.18, "noticeable").otherwise("similar")
    return g.select(*keys, "ruggedness", verdict.alias("verdict"))
