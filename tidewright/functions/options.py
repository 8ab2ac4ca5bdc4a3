"""Option arithmetic as native columns: quotes, smile formulas and times to expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IV_BAND = (0.01, 4.0)


def quote_columns(q: DataFrame) -> DataFrame:
    """Mid and spread (both sides needed), tradeable, market-order fills and where the iv comes from."""
    both = (F.col("bid") > 0) & (F.col("ask") > 0)
    mid = F.when(both, (F.col("bid") + F.col("ask")) * 0.5)
    spread = F.when(both, F.greatest(F.col("ask") - F.col("bid"), F.lit(0.0)))
    return q.select(
        "*", mid.alias("mid"), spread.alias("spread"), (spread / mid).alias("spread_pct"),
        F.coalesce(F.col("bid").isNotNull() & (F.col("ask") > 0), F.lit(False)).alias("tradeable"),
        F.when(F.col("ask") > 0, F.col("ask")).alias("buy_fill"), F.when(F.col("bid") > 0, F.col("bid")).alias("sell_fill"),
        F.when(F.col("vendor_iv").between(*IV_BAND), "vendor").when(mid.isNotNull(), "solve").otherwise("unavailable").alias("iv_source"),
    )


def svi_variance(a: Column, b: Column, rho: Column, m: Column, sigma: Column, k: Column) -> Column:
    """Total variance of the smile at log-moneyness k."""
    return a + b * (rho * (k - m) + F.sqrt((k - m) * (k - m) + sigma * sigma))


def svi_summary(a: Column, b: Column, rho: Column, sigma: Column) -> dict[str, Column]:
    """Least variance and the two wing slopes."""
    return {"min_variance": a + b * sigma * F.sqrt(1 - rho * rho), "left_slope": b * (1 - rho), "right_slope": b * (1 + rho)}


def years_to_close(expiry: Column, now: Column) -> Column:
    """Years until 16:00 New York on the expiry date, at least one hour."""
    close = F.to_utc_timestamp(F.to_timestamp(F.concat(F.date_format(expiry, "yyyy-MM-dd"), F.lit(" 16:00:00"))), "America/New_York")
    seconds = F.unix_timestamp(close) - F.unix_timestamp(now)
    return F.greatest(seconds / (365.0 * 24 * 3600), F.lit(1 / (365.0 * 24)))


def days_to_expiry(expiry: Column, now: Column) -> Column:
    return F.greatest(F.datediff(expiry, F.to_date(now)), F.lit(0))

