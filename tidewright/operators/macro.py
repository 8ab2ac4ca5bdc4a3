"""Macro series: point-in-time alignment, features, surprises and releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators import windows as win

# Fixed value: Spark numbers Sunday 1 and Saturday 7.
WEEKEND = (1, 7)


def business_calendar(obs: DataFrame, max_lag: int) -> DataFrame:
    """Weekdays from the first reference date to the last one plus the longest release lag."""
    span = obs.agg(F.min("ref_date").alias("a"), F.date_add(F.max("ref_date"), max_lag).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("ts"))
    return days.filter(~F.dayofweek("ts").isin(*WEEKEND))


def random_walk_consensus(obs: DataFrame) -> DataFrame:
    """The consensus stand-in: the previous observation of the same series."""
    w = Window.partitionBy("series_id").orderBy("ref_date")
    return obs.withColumn("consensus", F.lag("value").over(w))


def align_to_daily(obs: DataFrame, spec: DataFrame, max_lag: int) -> DataFrame:
    """Point-in-time daily table (ts, name, value, consensus): a value counts from its release date on.

    Calendar rows and observations go through one window per series; only calendar rows are kept.
    """
    o = random_walk_consensus(obs).join(spec, "series_id")
    published = o.select(
        "name", F.date_add("ref_date", F.col("lag_days")).alias("ts"), "value",
        F.when(F.col("has_consensus"), F.col("consensus")).alias("consensus"), F.lit(False).alias("is_day"), "ref_date",
    )
    names = spec.agg(F.collect_list("name").alias("names"))
    days = business_calendar(obs, max_lag).join(F.broadcast(names)).select(F.explode("names").alias("name"), "ts")
    days = days.select("name", "ts", F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("consensus"),
                       F.lit(True).alias("is_day"), F.lit(None).cast("date").alias("ref_date"))
    w = Window.partitionBy("name").orderBy("ts", "is_day", "ref_date").rowsBetween(Window.unboundedPreceding, 0)
    filled = published.unionByName(days).select(
        "name", "ts", "is_day", F.last("value", True).over(w).alias("value"), F.last("consensus", True).over(w).alias("consensus")
    )
    return filled.filter("is_day").drop("is_day")


def wide_daily(aligned: DataFrame, names: list[str], with_consensus: list[str]) -> DataFrame:
    """One row per day, one column per series, under the single symbol 'macro'."""
    return aligned.groupBy("ts").agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names],
        *[F.max(F.when(F.col("name") == n, F.col("consensus"))).alias(f"{n}_consensus") for n in with_consensus],
    ).withColumn("symbol", F.lit("macro"))


def macro_features(daily: DataFrame, zscore_window: int = 252, change_windows: tuple[int, ...] = (21, 63),
                   surprise_window: int = 24, lags: tuple[int, ...] = (1, 5, 21)) -> DataFrame:
    """The full feature matrix: levels, z-scores, changes, surprises, and their lags."""
    w = win.by_symbol()
    df = daily.select(
        "*", ((F.col("cpi") / F.lag("cpi", 252).over(w) - 1) * 100).alias("cpi_yoy"),
        (F.col("yield_10y") - F.col("yield_2y")).alias("curve_slope"),
    )
    levels = ["cpi_yoy", "unemployment", "yield_2y", "yield_10y", "credit_spread", "curve_slope"]
    df = df.select(
        "*", *[win.rolling_zscore(c, zscore_window, zscore_window // 2).alias(f"{c}_z") for c in levels],
        *[win.change(c, k).alias(f"{c}_chg{k}") for c in levels for k in change_windows],
    )
    need = max(3, surprise_window // 2)
    for c in ("cpi", "unemployment"):
        df = win.normalized_surprise(df, c, f"{c}_consensus", surprise_window, need, f"{c}_surprise_z")
    base = [*levels, *[f"{c}_z" for c in levels], *[f"{c}_chg{k}" for c in levels for k in change_windows],
            "cpi_surprise_z", "unemployment_surprise_z"]
    return win.with_lags(df.select("symbol", "ts", *base), base, list(lags))


def release_surprises(obs: DataFrame, spec: DataFrame, window: int = 24, need: int = 3) -> DataFrame:
    """Each scheduled release against the mean and std of the changes before it."""
    w = Window.partitionBy("series_id").orderBy("ref_date")
    prior = w.rowsBetween(-window, -1)
    o = obs.join(spec.filter("has_consensus"), "series_id").withColumn("change", F.col("value") - F.lag("value").over(w))
    n, mean, sd = F.count("change").over(prior), F.avg("change").over(prior), F.stddev_samp("change").over(prior)
    return o.select(
        "series_id", "name", "ref_date", F.date_add("ref_date", F.col("lag_days")).alias("release_date"), "value",
        F.lag("value").over(w).alias("previous"), "change",
        F.when((n >= need) & (sd > 1e-10), (F.col("change") - mean) / sd).alias("surprise_z"),
    )
