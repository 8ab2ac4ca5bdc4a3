"""Option queries. The oracle spells the normal distribution out in SQL."""

from pyspark.sql import functions as F

from tidewright.catalog.registry import longs, query, rounded
from tidewright.catalog.windows import STOCK
from tidewright.functions import options as fo
from tidewright.functions.normal import DEN, NUM, ncdf, npdf
from tidewright.operators import options as op
from tidewright.operators import windows as win
from tidewright.tables import BOOK_SQL, Tables


def ncdf_sql(x: str) -> str:
    a = f"abs({x})"
    def poly(cs):
        out = repr(cs[0])
        for c in cs[1:]:
            out = f"({out} * {a} + {c!r})"
        return out
    near = f"exp(-{a} * {a} / 2) * {poly(NUM)}::DOUBLE / {poly(DEN)}"
    far = f"exp(-{a} * {a} / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65))))) / 2.506628274631"
    tail = f"CASE WHEN {a} > 37 THEN 0 WHEN {a} < 7.07106781186547 THEN {near} ELSE {far} END"
    return f"(CASE WHEN {x} > 0 THEN 1 - ({tail}) ELSE {tail} END)"


def priced_sql(src: str, name: str = "priced") -> str:
    """CTEs that price ``src`` (spot, strike, years, rate, vol, kind) with desk-unit greeks."""
    return f"""{name}_d AS (SELECT *, CASE WHEN years > 0 AND vol > 0 THEN (ln(spot / strike) + (rate + vol * vol / 2) * years) / (vol * sqrt(years)) END AS d1,
  CASE WHEN years > 0 AND vol > 0 THEN (ln(spot / strike) + (rate + vol * vol / 2) * years) / (vol * sqrt(years)) - vol * sqrt(years) END AS d2, strike * exp(-rate * years) AS pv FROM {src}),
{name}_n AS (SELECT *, {ncdf_sql('d1')} AS n1, {ncdf_sql('d2')} AS n2, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS p1 FROM {name}_d),
{name} AS (SELECT *, CASE WHEN d1 IS NULL THEN CASE WHEN kind = 'call' THEN greatest(spot - strike, 0) ELSE greatest(strike - spot, 0) END WHEN kind = 'call' THEN spot * n1 - pv * n2 ELSE pv * (1 - n2) - spot * (1 - n1) END AS price,
  CASE WHEN d1 IS NULL THEN CASE WHEN kind = 'call' THEN CAST(spot > strike AS INT) ELSE -CAST(spot < strike AS INT) END WHEN kind = 'call' THEN n1 ELSE n1 - 1 END AS delta, coalesce(p1 / (spot * vol * sqrt(years)), 0) AS gamma, coalesce(spot * p1 * sqrt(years) / 100, 0) AS vega,
  coalesce((-spot * p1 * vol / (2 * sqrt(years)) + CASE WHEN kind = 'call' THEN -rate * pv * n2 ELSE rate * pv * (1 - n2) END) / 365, 0) AS theta, coalesce(CASE WHEN kind = 'call' THEN pv * years * n2 ELSE -pv * years * (1 - n2) END / 100, 0) AS rho FROM {name}_n)"""


GREEKS = ["price", "delta", "gamma", "vega", "theta", "rho"]
_OUT = ", ".join(f"round({g}, 7) AS {g}" for g in GREEKS)
_EXP = "bk AS (SELECT * REPLACE (CASE WHEN contract_id % 50 = 0 THEN CAST(0 AS DOUBLE) ELSE years END AS years) FROM book)"


def expiring(t: Tables):
    return t.option_book().withColumn("years", F.when(F.col("contract_id") % 50 == 0, 0.0).otherwise(F.col("years")))


@query("sca01_normal_distribution", f"SELECT event_id, round({ncdf_sql('z')}, 10) AS cdf, round(exp(-z * z / 2) / sqrt(2 * pi()), 10) AS pdf FROM (SELECT event_id, (value - 50) / 20 AS z FROM events)")
def _(t: Tables):
    z = (F.col("value") - 50) / 20
    return rounded(t.raw("events").select("event_id", ncdf(z).alias("cdf"), npdf(z).alias("pdf")), 10)


@query("sca02_black_scholes", f"WITH {BOOK_SQL}, {_EXP}, {priced_sql('bk')} SELECT contract_id, round(price, 7) AS price FROM priced")
def _(t: Tables):
    return rounded(op.priced(expiring(t)).select("contract_id", "price"), 7)


@query("sca03_greeks", f"WITH {BOOK_SQL}, {_EXP}, {priced_sql('bk')} SELECT contract_id, {_OUT} FROM priced")
def _(t: Tables):
    return rounded(op.priced(expiring(t)).select("contract_id", *GREEKS), 7)


@query("sca03_greeks_raw_units", f"WITH {BOOK_SQL}, {_EXP}, {priced_sql('bk')} SELECT contract_id, round(vega * 100, 5) AS vega, round(theta * 365, 5) AS theta, round(rho * 100, 5) AS rho FROM priced")
def _(t: Tables):
    return rounded(op.priced(expiring(t), "raw").select("contract_id", "vega", "theta", "rho"), 5)


@query("sca04_implied_volatility", f"""WITH {BOOK_SQL}, bk AS (SELECT * REPLACE (greatest(years, 10 / CAST(365 AS DOUBLE)) AS years) FROM book), {priced_sql('bk')}
SELECT contract_id, round(CASE WHEN vega >= 0.005 THEN vol END, 4) AS implied_vol FROM priced""")
def _(t: Tables):
    """Inverts model prices; the oracle knows the volatility they were made with."""
    b = t.option_book().withColumn("years", F.greatest("years", F.lit(10 / 365.0)))
    q = op.priced(b).select("contract_id", "spot", "strike", "years", "rate", "kind", "price")
    return rounded(op.implied_volatility(q).select("contract_id", "implied_vol"), 4)


@query("sca06_years_to_close", """SELECT o_orderkey AS quote_id, round(greatest((epoch(timezone('America/New_York', expiry + INTERVAL 16 HOUR)) - epoch(now_)) / (365.0 * 24 * 3600), 1 / (365.0::DOUBLE * 24)), 8) AS years, CAST(greatest(CAST(expiry AS DATE) - CAST(now_ AS DATE), 0) AS BIGINT) AS days
FROM (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS expiry, CAST(o_orderdate AS TIMESTAMP) - to_days(CAST(o_custkey % 60 AS INT)) + INTERVAL 12 HOUR AS now_ FROM orders)""")
def _(t: Tables):
    o = t.raw("orders").select(F.col("o_orderkey").alias("quote_id"), F.to_date("o_orderdate").alias("expiry"),
                               (F.to_timestamp(F.date_sub(F.to_date("o_orderdate"), (F.col("o_custkey") % 60).cast("int"))) + F.expr("INTERVAL 12 HOURS")).alias("now"))
    return longs(rounded(o.select("quote_id", fo.years_to_close(F.col("expiry"), F.col("now")).alias("years"), fo.days_to_expiry(F.col("expiry"), F.col("now")).alias("days")), 8))


_SVI = "sv AS (SELECT contract_id, ln(strike / (spot * exp(rate * years))) AS k, vol * vol * years AS w, 0.01 + vol / 100 AS a, 0.1 AS b, -0.3 AS rho, 0.02 AS m, 0.15 AS sg FROM book)"


@query("sca07_svi_smile", f"WITH {BOOK_SQL}, {_SVI} SELECT contract_id, round(k, 8) AS log_moneyness, round(w, 8) AS total_variance, round(a + b * (rho * (k - m) + sqrt((k - m) * (k - m) + sg * sg)), 8) AS smile_variance, round(a + b * sg * sqrt(1 - rho * rho), 8) AS min_variance, round(b * (1 - rho), 8)::DOUBLE AS left_slope, round(b * (1 + rho), 8)::DOUBLE AS right_slope FROM sv")
def _(t: Tables):
    p = {"b": 0.1, "rho": -0.3, "m": 0.02, "sigma": 0.15}
    lit = {k: F.lit(v) for k, v in p.items()}
    k = F.ln(F.col("strike") / (F.col("spot") * F.exp(F.col("rate") * F.col("years"))))
    a = 0.01 + F.col("vol") / 100
    smile = fo.svi_variance(a, lit["b"], lit["rho"], lit["m"], lit["sigma"], k)
    more = fo.svi_summary(a, lit["b"], lit["rho"], lit["sigma"])
    return rounded(t.option_book().select("contract_id", k.alias("log_moneyness"), (F.col("vol") * F.col("vol") * F.col("years")).alias("total_variance"), smile.alias("smile_variance"), *[c.alias(n) for n, c in more.items()]), 8)


# A smile per brand: call prices on every listed strike of the brand at one expiry.
_CURVE = f"""cv AS (SELECT symbol, 'call' AS kind, strike, spot, CAST(0.5 AS DOUBLE) AS years, rate, avg(vol) OVER (PARTITION BY symbol) AS vol FROM (SELECT DISTINCT symbol, strike, spot, rate, CAST(0.2 AS DOUBLE) AS vol FROM (SELECT symbol, round(500 + (strike - 900) * 5, 4) AS strike, spot, rate FROM book))), {priced_sql('cv')},
ds AS (SELECT symbol, strike, greatest(exp(rate * years) * 2 * (hm * cn - (hm + hp) * price + hp * cp) / (hm * hp * (hm + hp)), 0) AS density FROM (SELECT *, strike - lag(strike) OVER w AS hm, lead(strike) OVER w - strike AS hp, lag(price) OVER w AS cp, lead(price) OVER w AS cn FROM priced WINDOW w AS (PARTITION BY symbol ORDER BY strike)) WHERE hm IS NOT NULL AND hp IS NOT NULL)"""


def call_curve(t: Tables):
    b = t.option_book().select("symbol", F.round(500 + (F.col("strike") - 900) * 5, 4).alias("strike"), "spot", "rate").distinct()
    b = b.withColumns({"kind": F.lit("call"), "years": F.lit(0.5), "vol": F.lit(0.2)})
    return op.priced(b).withColumnRenamed("price", "call")


@query("win27_implied_density", f"WITH {BOOK_SQL}, {_CURVE} SELECT symbol, round(strike, 6) AS strike, round(density, 6) AS density FROM ds")
def _(t: Tables):
    return rounded(op.risk_neutral_density(call_curve(t), "symbol"))


_TRAP = "(lead(strike) OVER (PARTITION BY symbol ORDER BY strike) - strike) * ({y} + lead({y}) OVER (PARTITION BY symbol ORDER BY strike)) / 2"
_MOM = f"""ta AS (SELECT *, {_TRAP.format(y='density')} AS a FROM ds), tm AS (SELECT symbol, strike, density / sum(a) OVER (PARTITION BY symbol) AS pdf, sum(a) OVER (PARTITION BY symbol) AS mass FROM ta),
tb AS (SELECT *, strike * pdf AS sp FROM tm), tc AS (SELECT *, {_TRAP.format(y='sp')} AS m FROM tb), td AS (SELECT symbol, strike, pdf, mass, sum(m) OVER (PARTITION BY symbol) AS mean FROM tc WHERE mass > 1e-3),
te AS (SELECT *, power(strike - mean, 2) * pdf AS v, power(strike - mean, 3) * pdf AS s FROM td), tf AS (SELECT symbol, mass, mean, {_TRAP.format(y='v')} AS v, {_TRAP.format(y='s')} AS s FROM te),
mom AS (SELECT symbol, any_value(mass) AS mass, any_value(mean) AS mean, sum(v) AS variance, sum(s) / power(sum(v), 1.5) AS skew FROM tf GROUP BY 1)"""


@query("agg29_density_moments", f"WITH {BOOK_SQL}, {_CURVE}, {_MOM} SELECT symbol, round(mass, 6) AS mass, round(mean, 4) AS mean, round(variance, 2) AS variance, round(skew, 5) AS skew FROM mom")
def _(t: Tables):
    m = op.density_moments(op.risk_neutral_density(call_curve(t), "symbol"), "symbol")
    return rounded(m, 6, mean=4, variance=2, skew=5)


@query("sca08_return_moments", f"WITH {BOOK_SQL}, {_CURVE}, {_MOM} SELECT symbol, round(mean / 950 - 1, 6) AS mean_return, round(variance / 902500, 6) AS variance_return, round(skew, 5) AS skew_return, round(sqrt(variance / 902500 / 0.5), 6) AS annualized_vol, round(mean / (950 * exp(0.04 * 0.5)) - 1, 6) AS forward_error FROM mom")
def _(t: Tables):
    m = op.return_moments(op.density_moments(op.risk_neutral_density(call_curve(t), "symbol"), "symbol"), F.lit(950.0))
    return rounded(m.select("symbol", "mean_return", "variance_return", "skew_return", F.sqrt(F.col("variance_return") / 0.5).alias("annualized_vol"), (F.col("mean") / (950 * F.exp(F.lit(0.04 * 0.5))) - 1).alias("forward_error")), 6, skew_return=5)


_POS = f"""{BOOK_SQL}, {priced_sql('book')}, po AS (SELECT contract_id, symbol AS account, kind, strike, spot, CASE WHEN contract_id % 3 = 0 THEN -1 ELSE 1 END * (1 + contract_id % 4) AS contracts, price * 1.05 AS average_price, CASE WHEN contract_id % 7 <> 0 THEN price * 0.98 END AS bid, price * 1.02 AS ask,
  CASE WHEN kind = 'call' THEN greatest(spot - strike, 0) ELSE greatest(strike - spot, 0) END AS intrinsic, delta, gamma, theta, vega FROM priced),
pm AS (SELECT *, CASE WHEN contracts > 0 THEN 0 WHEN kind = 'put' THEN strike * -contracts * 100 ELSE greatest((0.20 * spot - greatest(strike - spot, 0) + average_price) * -contracts * 100, (0.10 * spot + average_price) * -contracts * 100, 0) END AS collateral,
  CASE WHEN contracts > 0 THEN greatest(coalesce(bid, 0), intrinsic) ELSE greatest(coalesce(ask, 0), intrinsic) END AS mark FROM po)"""


def positions(t: Tables):
    p = op.priced(t.option_book())
    cid = F.col("contract_id")
    p = p.select("contract_id", F.col("symbol").alias("account"), "kind", "strike", "spot", (F.when(cid % 3 == 0, -1).otherwise(1) * (1 + cid % 4)).alias("contracts"), (F.col("price") * 1.05).alias("average_price"),
                 F.when(cid % 7 != 0, F.col("price") * 0.98).alias("bid"), (F.col("price") * 1.02).alias("ask"), "delta", "gamma", "theta", "vega",
                 F.when(F.col("kind") == "call", F.greatest(F.col("spot") - F.col("strike"), F.lit(0.0))).otherwise(F.greatest(F.col("strike") - F.col("spot"), F.lit(0.0))).alias("intrinsic"))
    short = op.short_collateral(F.col("kind"), F.col("strike"), -F.col("contracts"), F.col("spot"), F.col("average_price"))
    return p.select("*", F.when(F.col("contracts") > 0, 0.0).otherwise(short).alias("collateral"), op.mark_price(F.col("contracts"), F.col("bid"), F.col("ask"), F.col("intrinsic")).alias("mark"))


@query("sca16_collateral_and_marks", f"WITH {_POS} SELECT contract_id, round(collateral, 4) AS collateral, round(mark, 6) AS mark FROM pm")
def _(t: Tables):
    return rounded(positions(t).select("contract_id", "collateral", "mark"), 6, collateral=4)


_EXPO = ", ".join(f"round(sum({g} * contracts * 100), 4) AS {g}_exposure" for g in ("delta", "gamma", "theta", "vega"))


@query("agg26_portfolio_exposure", f"WITH {_POS} SELECT account, {_EXPO}, round(sum(mark * contracts * 100), 2) AS market_value, round(sum((mark - average_price) * contracts * 100), 2) AS unrealized, round(1e6 + sum(mark * contracts * 100), 2) AS equity, round(sum(mark * contracts * 100) / 1e6 * 100, 5) AS total_return_pct FROM pm GROUP BY account")
def _(t: Tables):
    p = positions(t)
    accounts = p.select("account").distinct().withColumns({"cash": F.lit(1e6), "starting_cash": F.lit(1e6)})
    r = op.portfolio(p, accounts).drop("cash", "starting_cash", "collateral_held", "buying_power")
    return rounded(r, 4, market_value=2, unrealized=2, equity=2, total_return_pct=5)


@query("agg27_buying_power", f"WITH {_POS} SELECT account, round(sum(collateral), 3) AS collateral_held, round(1e6 - sum(collateral), 3) AS buying_power FROM pm GROUP BY account")
def _(t: Tables):
    p = positions(t)
    accounts = p.select("account").distinct().withColumns({"cash": F.lit(1e6), "starting_cash": F.lit(1e6)})
    return rounded(op.portfolio(p, accounts).select("account", "collateral_held", "buying_power"), 3)


@query("sca17_payoff_grid", f"WITH {BOOK_SQL} SELECT contract_id, CAST(step AS BIGINT) AS step, round(x, 4) AS underlying, round(CASE WHEN kind = 'call' THEN greatest(x - strike, 0) ELSE greatest(strike - x, 0) END, 4) AS payoff FROM (SELECT *, spot * (0.7 + 0.6 * step / 40::DOUBLE) AS x FROM (SELECT *, unnest(range(41)) AS step FROM book))")
def _(t: Tables):
    return longs(rounded(op.payoff_points(t.option_book()), 4))


@query("sca17_greek_curves", f"WITH {BOOK_SQL}, g AS (SELECT * REPLACE (spot * (0.67 + 0.66 * step / 60::DOUBLE) AS spot) FROM (SELECT *, unnest(range(61)) AS step FROM book)), {priced_sql('g')} SELECT contract_id, CAST(step AS BIGINT) AS step, round(price, 5) AS price, round(delta, 7) AS delta, round(gamma, 8) AS gamma, round(vega, 6) AS vega, round(theta, 6) AS theta, round(rho, 6) AS rho FROM priced")
def _(t: Tables):
    return longs(rounded(op.greek_curves(t.option_book()).select("contract_id", "step", *GREEKS), 6, price=5, delta=7, gamma=8))


_OH = f"""r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS b, max(ts) OVER (PARTITION BY symbol) + 30 AS expiry, arg_max(close, ts) OVER (PARTITION BY symbol) AS strike FROM stocks),
h AS (SELECT symbol, ts, 'call' AS kind, close AS spot, strike, greatest((expiry - ts) / 365::DOUBLE, 1 / 365::DOUBLE) AS years, CAST(0.04 AS DOUBLE) AS rate, CAST(0.25 AS DOUBLE) AS vol FROM r WHERE b <= 126), {priced_sql('h')}"""


@query("win28_modelled_option_history", f"{STOCK}, {_OH} SELECT symbol, ts, round(spot / first_value(spot) OVER (PARTITION BY symbol ORDER BY ts) * 100, 5) AS underlying_indexed, round(price / first_value(price) OVER (PARTITION BY symbol ORDER BY ts) * 100, 5) AS option_indexed FROM priced")
def _(t: Tables):
    from pyspark.sql import Window

    every = Window.partitionBy("symbol")
    s = t.stocks().select("symbol", "ts", F.col("close").alias("spot"), F.date_add(F.max("ts").over(every), 30).alias("expiry"), F.max_by("close", "ts").over(every).alias("strike"))
    h = win.last_rows(s, 126).withColumns({"kind": F.lit("call"), "rate": F.lit(0.04), "vol": F.lit(0.25), "years": F.greatest(F.datediff("expiry", "ts") / 365.0, F.lit(1 / 365.0))})
    p = op.priced(h)
    first = win.whole_prefix()
    return rounded(p.select("symbol", "ts", (F.col("spot") / F.first("spot").over(first) * 100).alias("underlying_indexed"), (F.col("price") / F.first("price").over(first) * 100).alias("option_indexed")), 5)
