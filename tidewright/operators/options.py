"""Option books as tables: pricing, implied volatility, densities, curves, marks and exposure."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.normal import ncdf, npdf
from tidewright.session import dealt

SHARES = 100
REG_T, REG_T_FLOOR = 0.20, 0.10
TERMS = ["spot", "strike", "years", "rate", "vol", "kind"]


def priced(book: DataFrame, units: str = "desk") -> DataFrame:
    """Price and greeks of every contract in one pass of native columns.

    d1, d2 and their distribution values are columns of their own, so the long rational formula is
    generated twice and not once per greek.
    """
    s, k, t, r, v, kind = (F.col(c) for c in TERMS)
    live = (t > 0) & (v > 0)
    call = kind == "call"
    df = book.select("*", F.when(live, (F.ln(s / k) + (r + v * v / 2) * t) / (v * F.sqrt(t))).alias("__d1"), (k * F.exp(-r * t)).alias("__pv"))
    df = df.withColumn("__d2", F.col("__d1") - v * F.sqrt(t))
    df = df.select("*", ncdf(F.col("__d1")).alias("__n1"), ncdf(F.col("__d2")).alias("__n2"), npdf(F.col("__d1")).alias("__p1"))
    n1, n2, p1, pv = (F.col(c) for c in ("__n1", "__n2", "__p1", "__pv"))
    day, point = (365.0, 100.0) if units == "desk" else (1.0, 1.0)
    worth = F.when(call, F.greatest(s - k, F.lit(0.0))).otherwise(F.greatest(k - s, F.lit(0.0)))
    decay = -s * p1 * v / (2 * F.sqrt(t))
    out = {
        "price": F.when(live, F.when(call, s * n1 - pv * n2).otherwise(pv * (1 - n2) - s * (1 - n1))).otherwise(worth),
        "delta": F.when(live, F.when(call, n1).otherwise(n1 - 1)).otherwise(F.when(call, (s > k).cast("double")).otherwise(-(s < k).cast("double"))),
        "gamma": F.when(live, p1 / (s * v * F.sqrt(t))).otherwise(0.0),
        "vega": F.when(live, s * p1 * F.sqrt(t) / point).otherwise(0.0),
        "theta": F.when(live, (decay + F.when(call, -r * pv * n2).otherwise(r * pv * (1 - n2))) / day).otherwise(0.0),
        "rho": F.when(live, F.when(call, pv * t * n2).otherwise(-pv * t * (1 - n2)) / point).otherwise(0.0),
    }
    return df.select(*book.columns, *[c.alias(n) for n, c in out.items()])


def _solve_batch(pdf: pd.DataFrame, low: float, high: float, min_vega: float) -> np.ndarray:
    """Safeguarded Newton on a whole batch of quotes at once; NaN where nothing is implied."""
    s, k, t, r, p = (pdf[c].to_numpy(float) for c in ("spot", "strike", "years", "rate", "price"))
    call = (pdf["kind"] == "call").to_numpy()
    ok = (t > 0) & (s > 0) & (k > 0) & (p > 0)
    t, s_, k_ = np.where(ok, t, 1.0), np.where(ok, s, 1.0), np.where(ok, k, 1.0)
    pv = k_ * np.exp(-r * t)
    intrinsic = np.where(call, np.maximum(s_ - k_, 0), np.maximum(k_ - s_, 0))
    floor = np.maximum(intrinsic - (k_ - pv), 0)
    ok &= (p >= floor - 1e-9) & (p <= np.where(call, s_, k_) + 1e-9)

    def value(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d1 = (np.log(s_ / k_) + (r + v * v / 2) * t) / (v * np.sqrt(t))
        d2 = d1 - v * np.sqrt(t)
        c = s_ * _cdf(d1) - pv * _cdf(d2)
        return np.where(call, c, c - s_ + pv), s_ * np.exp(-d1 * d1 / 2) / np.sqrt(2 * np.pi) * np.sqrt(t)

    lo, hi, v = np.full(len(p), low), np.full(len(p), high), np.full(len(p), 0.25)
    done = np.zeros(len(p), bool)
    for _ in range(60):
        price, vega = value(v)
        err = price - p
        done |= np.abs(err) < 1e-7
        if (done | ~ok).all():
            break
        hi, lo = np.where(~done & (err > 0), v, hi), np.where(~done & (err <= 0), v, lo)
        step = v - err / np.where(vega > 1e-8, vega, np.inf)
        inside = (vega > 1e-8) & (step > lo) & (step < hi)
        v = np.where(done, v, np.where(inside, step, (lo + hi) / 2))
    _, vega = value(v)
    good = ok & done & (v > low) & (v < high) & (vega / 100 >= min_vega)
    return np.where(good, v, np.nan)


def _cdf(x: np.ndarray) -> np.ndarray:
    """Normal distribution by the same rational formula as the native columns."""
    from tidewright.functions.normal import DEN, NUM

    a = np.abs(x)
    e = np.exp(-a * a / 2)
    near = e * np.polyval(NUM, np.minimum(a, 40)) / np.polyval(DEN, np.minimum(a, 40))
    far = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    tail = np.where(a > 37, 0.0, np.where(a < 7.07106781186547, near, far))
    return np.where(x > 0, 1 - tail, tail)


def implied_volatility(quotes: DataFrame, low: float = 0.005, high: float = 5.0, min_vega: float = 0.005) -> DataFrame:
    """Add ``implied_vol`` to quotes (spot, strike, years, rate, price, kind).

    Rows are independent, so the solver runs on Arrow batches inside each partition: no shuffle, and
    NULL where the price is outside its bounds or does not pin a volatility down.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vol = pd.Series(_solve_batch(pdf, low, high, min_vega), index=pdf.index)
            yield pdf.assign(implied_vol=vol.where(vol.notna(), None).astype("float64"))

    out = quotes.mapInPandas(run, quotes.select("*", F.lit(None).cast("double").alias("implied_vol")).schema)
    return out.withColumn("implied_vol", F.when(~F.isnan("implied_vol"), F.col("implied_vol")))


def risk_neutral_density(curve: DataFrame, key: str) -> DataFrame:
    """Second difference of call prices on a non-uniform strike grid, times exp(rT), floored at zero.

    ``curve`` has (key, strike, call, years, rate); a key's grid is a few hundred strikes.
    """
    w = Window.partitionBy(key).orderBy("strike")
    a, b = F.col("strike") - F.lag("strike").over(w), F.lead("strike").over(w) - F.col("strike")
    second = 2 * (a * F.lead("call").over(w) - (a + b) * F.col("call") + b * F.lag("call").over(w)) / (a * b * (a + b))
    out = curve.select(key, "strike", (F.exp(F.col("rate") * F.col("years")) * second).alias("density"))
    return out.filter("density IS NOT NULL").withColumn("density", F.greatest("density", F.lit(0.0)))


def density_moments(density: DataFrame, key: str) -> DataFrame:
    """Mass, mean, variance and skew of each density by the trapezoid rule."""
    w = Window.partitionBy(key).orderBy("strike")
    every = Window.partitionBy(key)

    def area(y: Column) -> Column:
        return (F.lead("strike").over(w) - F.col("strike")) * (y + F.lead(y).over(w)) / 2

    d = density.withColumn("mass", F.sum("__a").over(every)) if "__a" in density.columns else density.withColumn("__a", area(F.col("density"))).withColumn("mass", F.sum("__a").over(every))
    d = d.filter("mass > 1e-3").withColumn("pdf", F.col("density") / F.col("mass"))
    d = d.withColumn("__m", area(F.col("strike") * F.col("pdf"))).withColumn("mean", F.sum("__m").over(every))
    c = F.col("strike") - F.col("mean")
    d = d.select(key, "mass", "mean", area(c * c * F.col("pdf")).alias("v"), area(c * c * c * F.col("pdf")).alias("s"))
    g = d.groupBy(key).agg(F.first("mass").alias("mass"), F.first("mean").alias("mean"), F.sum("v").alias("variance"), F.sum("s").alias("third"))
    return g.filter("variance > 0").select(key, "mass", "mean", "variance", (F.col("third") / F.pow("variance", F.lit(1.5))).alias("skew"))


def return_moments(m: DataFrame, spot: Column) -> DataFrame:
    """Moments of the strike density as moments of the return on spot."""
    return m.withColumns({"mean_return": F.col("mean") / spot - 1, "variance_return": F.col("variance") / (spot * spot), "skew_return": F.col("skew")})


def payoff_points(book: DataFrame, n: int = 41, low: float = 0.7, width: float = 0.6) -> DataFrame:
    """Payoff at expiry of each contract on a grid of underlying prices."""
    p = book.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("step"))
    x = F.col("spot") * (low + width * F.col("step") / (n - 1))
    value = F.when(F.col("kind") == "call", F.greatest(x - F.col("strike"), F.lit(0.0))).otherwise(F.greatest(F.col("strike") - x, F.lit(0.0)))
    return p.select("contract_id", "step", x.alias("underlying"), value.alias("payoff"))


def greek_curves(book: DataFrame, n: int = 61, low: float = 0.67, width: float = 0.66) -> DataFrame:
    """Price and greeks of each contract across underlying prices a third either way.

    A book is a few bytes a contract, so that a file of millions is read by very few tasks; it is dealt out before it is unfolded.
    """
    p = dealt(book).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("step"))
    return priced(p.withColumn("spot", F.col("spot") * (low + width * F.col("step") / (n - 1))))


def short_collateral(kind: Column, strike: Column, contracts: Column, spot: Column, premium: Column) -> Column:
    """Cash at the strike for a short put; Regulation T with its floor for a short call."""
    shares = contracts * SHARES
    away = F.greatest(strike - spot, F.lit(0.0))
    call = F.greatest((REG_T * spot - away + premium) * shares, (REG_T_FLOOR * spot + premium) * shares, F.lit(0.0))
    return F.when(kind == "put", strike * shares).otherwise(call)


def mark_price(contracts: Column, bid: Column, ask: Column, intrinsic: Column) -> Column:
    """Bid for a long, ask for a short, never below intrinsic."""
    side = F.when(contracts > 0, bid).otherwise(ask)
    return F.greatest(F.when(side > 0, side).otherwise(0.0), F.coalesce(intrinsic, F.lit(0.0)))


def portfolio(positions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Per account: greek exposure, equity, unrealised result, collateral and buying power.

    ``positions`` has (account, contracts, average_price, mark, collateral, greeks); partial sums per
    account are taken before the shuffle, so a large account is no hot spot.
    """
    shares = F.col("contracts") * SHARES
    g = positions.groupBy("account").agg(
        *[F.sum(F.col(x) * shares).alias(f"{x}_exposure") for x in ("delta", "gamma", "theta", "vega")],
        F.sum(F.col("mark") * shares).alias("market_value"), F.sum((F.col("mark") - F.col("average_price")) * shares).alias("unrealized"),
        F.sum("collateral").alias("collateral_held"))
    j = accounts.join(g, "account", "left").na.fill(0.0)
    equity = F.col("cash") + F.col("market_value")
    return j.select("*", equity.alias("equity"), (F.col("cash") - F.col("collateral_held")).alias("buying_power"), ((equity / F.col("starting_cash") - 1) * 100).alias("total_return_pct"))
