"""Estimator queries."""

from pyspark.sql import functions as F

from tidewright.catalog.options import ncdf_sql
from tidewright.catalog.registry import query, rounded
from tidewright.catalog.windows import BASE, INDEX, STOCK, STOCK_SQL, W, macro_daily
from tidewright.functions.fits import ADF_LARGE, ADF_MAX, ADF_MIN, ADF_SMALL, ADF_STAR, normal_ppf
from tidewright.operators import diagnostics as dg
from tidewright.operators import estimators as es
from tidewright.operators import forecasters as fc
from tidewright.operators import macro
from tidewright.operators import windows as win
from tidewright.operators.asof import asof_join
from tidewright.operators.filters import usable_quotes
from tidewright.session import checkpointed
from tidewright.tables import Tables

FEATURES = [c for c in BASE if not c.endswith("chg63")]


def design(t: Tables):
    """Macro features per business day with the market's next 21-session return as the target."""
    market = t.bars().filter("symbol = 'AF'").select(F.lit("macro").alias("symbol"), "ts", "close")
    f = macro.macro_features(macro_daily(t), zscore_window=250).select("symbol", "ts", *FEATURES)
    d = asof_join(f, market, ["symbol"], "ts", "ts", ["close"]).drop("src_ts")
    return d.withColumn("y", F.lead("close", 21).over(win.by_symbol()) / F.col("close") - 1).filter("cpi_yoy_z IS NOT NULL AND cpi_surprise_z IS NOT NULL AND unemployment_surprise_z IS NOT NULL")


def forecasts(t: Tables, every: int = 63):
    d = checkpointed(design(t))
    models = es.fit_quantiles(es.training_rows(d, 21, 750, every), FEATURES, "y")
    return es.quantile_moments(es.predict_quantiles(d.select("symbol", "ts", "y", *FEATURES), models, FEATURES, every))


@query("est03_quantile_models")
def _(t: Tables):
    """One penalised quantile regression per refit date and level."""
    m = es.fit_quantiles(es.training_rows(checkpointed(design(t)), 21, 750, 126), FEATURES, "y")
    used = F.size(F.filter("coefficients", lambda c: F.abs(c) > 1e-6)).cast("bigint")
    return rounded(m.select("symbol", "refit", "level", "intercept", used.alias("nonzero"), F.array_join("kept", " ").alias("kept"), "n_train", "error"))


def stock_rows(t: Tables):
    """Each symbol's last return and last five with the next five sessions' return as the target."""
    back = lambda k: win.pct_return("close", k)
    d = t.stocks().select("symbol", "ts", back(1).alias("x"), back(5).alias("x5"), (F.lead("close", 5).over(win.by_symbol()) / F.col("close") - 1).alias("y"))
    return d.filter("x IS NOT NULL AND x5 IS NOT NULL AND y IS NOT NULL")


def stock_design(t: Tables):
    """The same, written once for queries that read it several times."""
    return checkpointed(stock_rows(t))


@query("est03_optimality_certificate", f"""{STOCK}, x AS (SELECT symbol, ts, close / lag(close) OVER {W} - 1 AS x, close / lag(close, 5) OVER {W} - 1 AS x5, lead(close, 5) OVER {W} / close - 1 AS y FROM stocks),
d AS (SELECT symbol, row_number() OVER {W} AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM x WHERE x IS NOT NULL AND x5 IS NOT NULL AND y IS NOT NULL),
k AS (SELECT symbol, unnest(range(CAST(ceil((pos + 5) / 63) AS BIGINT), CAST(least(floor((pos + 5 + 249) / 63), floor(n / 63)) AS BIGINT) + 1)) AS k FROM d)
SELECT symbol, CAST(k * 63 AS BIGINT) AS refit, level, count(*) AS n_train, true AS inside_box, true AS stationary, true AS gap_closed
FROM k, (SELECT unnest([0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95])::DOUBLE AS level) GROUP BY 1, 2, 3 HAVING count(*) >= 9""")
def _(t: Tables):
    """Quantile regressions of all symbols and refit dates, each proved optimal by its dual values."""
    train = es.packed_training(stock_rows(t), ["x", "x5"], "y", 5, 250, 63)
    g = es.packed_certificate(es.fit_packed(train, ["x", "x5"], "y", sums=True), ["x", "x5"], "y")
    return g.withColumn("refit", F.col("refit").cast("bigint"))


_RIDGE_Q = "my + c1 * (x - mx) / sx + c2 * (x5 - m5) / s5 + z * sd"
_SCORED = " UNION ALL ".join(
    f"SELECT '{name}' AS forecaster, symbol, level, y, {q} AS q, cq[i] AS base FROM te JOIN m USING (symbol, k), lv" for name, q in (("random_walk", "z * rw"), ("climatology", "cq[i]"), ("ridge", _RIDGE_Q))
)
FORECASTER_SQL = f"""{STOCK}, x AS (SELECT symbol, ts, close / lag(close) OVER {W} - 1 AS x, close / lag(close, 5) OVER {W} - 1 AS x5, lead(close, 5) OVER {W} / close - 1 AS y FROM stocks),
d AS (SELECT *, row_number() OVER {W} AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM x WHERE x IS NOT NULL AND x5 IS NOT NULL AND y IS NOT NULL),
tr AS (SELECT symbol, x, x5, y, unnest(range(CAST(ceil((pos + 5) / 63) AS BIGINT), CAST(least(floor((pos + 5 + 249) / 63), floor(n / 63)) AS BIGINT) + 1)) AS k FROM d),
s AS (SELECT symbol, k, avg(x) AS mx, avg(x5) AS m5, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(x5) AS s5, sqrt(avg(y * y)) AS rw, quantile_cont(y, {es.LEVELS}::DOUBLE[]) AS cq FROM tr GROUP BY 1, 2 HAVING count(*) >= 10),
z AS (SELECT symbol, k, (x - mx) / sx AS a, (x5 - m5) / s5 AS b, y - my AS y FROM tr JOIN s USING (symbol, k)),
g AS (SELECT symbol, k, sum(a * a) + 1 AS aa, sum(a * b) AS ab, sum(b * b) + 1 AS bb, sum(a * y) AS ay, sum(b * y) AS yb FROM z GROUP BY 1, 2),
o AS (SELECT symbol, k, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS c1, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS c2 FROM g),
e AS (SELECT symbol, k, stddev_samp(z.y - c1 * a - c2 * b) AS sd FROM z JOIN o USING (symbol, k) GROUP BY 1, 2), m AS (SELECT * FROM s JOIN o USING (symbol, k) JOIN e USING (symbol, k)),
te AS (SELECT symbol, x, x5, y, pos // 63 AS k FROM d), lv AS (SELECT unnest({es.LEVELS}::DOUBLE[]) AS level, unnest({[float(v) for v in normal_ppf(es.LEVELS)]}::DOUBLE[]) AS z, unnest(range(1, {len(es.LEVELS) + 1})) AS i),
f AS ({_SCORED}), r AS (SELECT forecaster, symbol, level, count(*) AS n, avg(CAST(y <= q AS INT)) AS coverage, avg(greatest(level * (y - q), (level - 1) * (y - q))) AS p, avg(greatest(level * (y - base), (level - 1) * (y - base))) AS b FROM f GROUP BY 1, 2, 3)
SELECT forecaster, symbol, level, n, round(coverage, 6) AS coverage, round(coverage - level, 6) AS error, round(sqrt(level * (1 - level) / greatest(2, n // 5)), 6) AS standard_error, round(1 - p / b, 6) AS skill,
  abs(coverage - level) <= 2 * sqrt(level * (1 - level) / greatest(2, n // 5)) AS calibrated FROM r"""


@query("agg17_forecaster_scores", FORECASTER_SQL)
def _(t: Tables):
    """Random walk, climatology and ridge of all symbols, refitted every 63 sessions and scored on what came after."""
    f = fc.walk_forward(stock_design(t), [fc.RandomWalk(), fc.Climatology(), fc.Ridge()], ["x", "x5"], "y", 5, 250, 63)
    return rounded(fc.scored(f, 5))


@query("agg17_quantile_forecaster_scores")
def _(t: Tables):
    """The same report of the quantile regressions, whose fits ``est03_optimality_certificate`` proves."""
    f = fc.walk_forward(stock_design(t), [fc.QuantileRegression()], ["x", "x5"], "y", 5, 250, 63)
    return rounded(fc.scored(f, 5))


@query("est13_walk_forward_forecasts")
def _(t: Tables):
    f = forecasts(t)
    return rounded(f.select("symbol", "ts", "refit", F.col("quantiles")[0].alias("q05"), F.col("quantiles")[3].alias("q50"), F.col("quantiles")[6].alias("q95"), "n_train"))


@query("est11_forecast_moments")
def _(t: Tables):
    return rounded(forecasts(t).select("symbol", "ts", "mean", "variance", "skew"))


@query("est04_ridge_baseline")
def _(t: Tables):
    d = checkpointed(design(t))
    r = es.ridge_forecast(d, es.ridge_fits(d, "symbol", FEATURES, "y"), "symbol", FEATURES, "y")
    return rounded(r.select("symbol", "ts", "mean", "variance", "skew"))


_R = f"x AS (SELECT symbol, ts, close / lag(close) OVER {W} - 1 AS x, close / lag(close, 5) OVER {W} - 1 AS x5, lead(close, 5) OVER {W} / close - 1 AS y FROM bars), d AS (SELECT * FROM x WHERE x IS NOT NULL AND x5 IS NOT NULL AND y IS NOT NULL)"


@query("est04_ridge_two_features", f"""{INDEX}, {_R}, s AS (SELECT symbol, avg(x) AS mx, avg(x5) AS m5, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(x5) AS s5, count(*) AS n FROM d GROUP BY 1),
z AS (SELECT d.symbol, (x - mx) / sx AS a, (x5 - m5) / s5 AS b, y - my AS y FROM d JOIN s USING (symbol)), g AS (SELECT symbol, sum(a * a) + 1 AS aa, sum(a * b) AS ab, sum(b * b) + 1 AS bb, sum(a * y) AS ay, sum(b * y) AS yb FROM z GROUP BY 1),
o AS (SELECT symbol, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS c1, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS c2 FROM g),
e AS (SELECT z.symbol, stddev_samp(z.y - c1 * a - c2 * b) AS sd FROM z JOIN o USING (symbol) GROUP BY 1)
SELECT symbol, round(c1 / sx, 6) AS coef_ret, round(c2 / s5, 6) AS coef_ret5, round(sd, 8) AS residual_std, n AS n_train FROM o JOIN s USING (symbol) JOIN e USING (symbol)""")
def _(t: Tables):
    """The ridge fit on two features, where the oracle can solve the normal equations by hand."""
    d = t.bars().select("symbol", "ts", win.pct_return("close").alias("x"), win.pct_return("close", 5).alias("x5"), (F.lead("close", 5).over(win.by_symbol()) / F.col("close") - 1).alias("y"))
    m = es.ridge_fits(d, "symbol", ["x", "x5"], "y")
    return rounded(m.select("symbol", F.col("coefficients")[0].alias("coef_ret"), F.col("coefficients")[1].alias("coef_ret5"), "residual_std", "n_train"), 6, residual_std=8)


@query("est08_garch_forecasts")
def _(t: Tables):
    return rounded(es.garch(t.stocks()), 4)


@query("est08_garch_certificate", f"""{STOCK}, r AS (SELECT symbol, ln(close / lag(close) OVER {W}) AS r FROM stocks), k AS (SELECT symbol, count(*) AS n FROM r WHERE r IS NOT NULL GROUP BY 1 HAVING count(*) >= 60 AND stddev_pop(r * 100) >= 1e-12)
SELECT symbol, n, true AS none_better, true AS stationary FROM k""")
def _(t: Tables):
    """Each symbol's fit has no neighbour in any parameter with a higher likelihood, recomputed by the block scan."""
    s = checkpointed(t.stocks().select("symbol", "ts", "close"))
    points = checkpointed(es.garch_points(s))
    loss = es.garch_likelihood(s, points)
    own, near = F.min(F.when(F.col("point") == 0, F.col("loss"))), F.min("loss")
    fit = points.filter("point = 0").select("symbol", (F.col("alpha") + F.col("beta") < 1).alias("stationary"))
    g = loss.groupBy("symbol").agg(F.max("n").alias("n"), (own <= near + 1e-6).alias("none_better"))
    return g.join(fit, "symbol").select("symbol", "n", "none_better", "stationary")


def pivots_sql(matrix: str, last: str) -> str:
    """Rows left of ``matrix`` (symbol, i, j, v, both triangles) after each column k below ``last`` is eliminated."""
    return f"""(SELECT symbol, 0 AS k, i, j, v, {last} AS last FROM {matrix} UNION ALL
SELECT symbol, k + 1, i, j, v - across * down / top, last FROM (SELECT *, max(CASE WHEN i = k THEN v END) OVER (PARTITION BY symbol, j) AS across, max(CASE WHEN j = k THEN v END) OVER (PARTITION BY symbol, i) AS down,
max(CASE WHEN i = k AND j = k THEN v END) OVER (PARTITION BY symbol) AS top FROM {{name}}) WHERE i > k AND j > k AND k < last)"""


def poly_sql(coef, x: str) -> str:
    return " + ".join(f"{c} * pow({x}, {i})" for i, c in enumerate(coef))


UNIT_ROOT_SQL = f"""WITH RECURSIVE {STOCK_SQL}, p AS (SELECT symbol, close, row_number() OVER {W} - 1 AS t, count(*) OVER (PARTITION BY symbol) AS n, close - avg(close) OVER (PARTITION BY symbol) AS c FROM stocks),
d AS (SELECT symbol, t, n, c, lead(close) OVER (PARTITION BY symbol ORDER BY t) - close AS d, CAST(least(ceil(12 * pow(n / 100, 0.25)), n // 2 - 2) AS BIGINT) AS m FROM p),
x AS MATERIALIZED (SELECT symbol, t, m, 0 AS i, 1.0::DOUBLE AS v FROM d WHERE d IS NOT NULL AND n >= 60 UNION ALL SELECT symbol, t, m, 1, c FROM d WHERE d IS NOT NULL AND n >= 60 UNION ALL SELECT symbol, t, m, 999, d FROM d WHERE d IS NOT NULL AND n >= 60
UNION ALL SELECT a.symbol, a.t, a.m, 1 + k, b.d FROM (SELECT *, unnest(range(1, least(m, t) + 1)) AS k FROM d WHERE d IS NOT NULL AND n >= 60) a JOIN d b ON a.symbol = b.symbol AND b.t = a.t - a.k),
g AS MATERIALIZED (SELECT a.symbol, a.m, a.i, b.i AS j, sum(a.v * b.v) AS v FROM x a JOIN x b ON a.symbol = b.symbol AND a.t = b.t WHERE a.t >= a.m GROUP BY 1, 2, 3, 4),
e AS {pivots_sql("g", "m + 2").format(name="e")},
aic AS (SELECT symbol, k - 2 AS lag, rows * ln(v / rows) + 2 * k AS aic FROM e JOIN (SELECT symbol, max(v) AS rows FROM g WHERE i = 0 AND j = 0 GROUP BY 1) USING (symbol) WHERE i = 999 AND j = 999 AND k >= 2),
best AS (SELECT symbol, arg_min(lag, (aic, lag)) AS lag FROM aic GROUP BY 1),
y AS MATERIALIZED (SELECT symbol, t, lag, CASE WHEN i = 1 THEN 998 WHEN i BETWEEN 2 AND 997 THEN i - 1 ELSE i END AS i, v FROM x JOIN best USING (symbol) WHERE t >= lag AND (i < 2 + lag OR i = 999)),
h AS MATERIALIZED (SELECT a.symbol, a.lag, a.i, b.i AS j, sum(a.v * b.v) AS v FROM y a JOIN y b ON a.symbol = b.symbol AND a.t = b.t GROUP BY 1, 2, 3, 4),
f AS {pivots_sql("h", "lag + 1").format(name="f")},
o AS (SELECT symbol, max(CASE WHEN i = 998 AND j = 998 THEN v END) AS ll, max(CASE WHEN i = 998 AND j = 999 THEN v END) AS lt, max(CASE WHEN i = 999 AND j = 999 THEN v END) AS tt, max(last) - 1 AS lag FROM f WHERE k = last GROUP BY 1),
s AS (SELECT symbol, lag, lt / ll / sqrt((tt - lt * lt / ll) / (rows - lag - 2) / ll) AS s FROM o JOIN (SELECT symbol, max(v) AS rows FROM h WHERE i = 0 AND j = 0 GROUP BY 1) USING (symbol)),
z AS (SELECT symbol, lag, s, CASE WHEN s <= {ADF_STAR} THEN {poly_sql(ADF_SMALL, "s")} ELSE {poly_sql(ADF_LARGE, "s")} END AS z FROM s)
SELECT symbol, round(s, 5) AS adf_statistic, round(CASE WHEN s > {ADF_MAX} THEN 1.0 WHEN s < {ADF_MIN} THEN 0.0 ELSE {ncdf_sql("z")} END, 5) AS adf_pvalue, CAST(lag AS BIGINT) AS lags, CAST(CASE WHEN n < 60 THEN concat(n, ' sessions') END AS VARCHAR) AS error
FROM (SELECT symbol, count(*) AS n FROM stocks GROUP BY 1) LEFT JOIN z USING (symbol)"""


@query("est12_unit_root_tests", UNIT_ROOT_SQL)
def _(t: Tables):
    """Augmented Dickey-Fuller test of every symbol; the oracle eliminates columns of the normal equations one by one."""
    return rounded(es.unit_root(t.stocks()), 5)


@query("agg32_volatility_summary")
def _(t: Tables):
    return rounded(volatility_summary(t), 4)


def volatility_summary(t: Tables):
    s = t.stocks()
    j = dg.close_to_close_vol(s).join(dg.yang_zhang_vol(s), "symbol").join(dg.ewma_vol(s), "symbol").join(es.garch(s), "symbol", "left")
    j = j.withColumn("forecast_pct", F.coalesce("forecast_pct", "ewma_pct"))
    return j.withColumn("regime", dg.vol_regime(F.col("ewma_pct"), F.col("long_run_pct")))


def return_panel(t: Tables):
    r = t.bars().select("symbol", "ts", win.log_return("close").alias("r"))
    cols = ["AF", "NO", "RF", "RO"]
    p = r.filter(F.col("symbol").isin(cols)).groupBy("ts").agg(*[F.max(F.when(F.col("symbol") == c, F.col("r"))).alias(c) for c in cols])
    return p.dropna().withColumn("symbol", F.lit("panel")), cols


@query("est10_window_topology")
def _(t: Tables):
    p, cols = return_panel(t)
    return rounded(es.window_topology(p, cols, window=30))


@query("win19_topology_signal")
def _(t: Tables):
    p, cols = return_panel(t)
    return rounded(es.topology_signal(es.window_topology(p, cols, window=30)))


def day_chains(t: Tables):
    """One option chain per session: strikes around the market's close, a smile around its realised volatility."""
    m = dg.realized_vol(t.bars().filter("symbol = 'AF'"), 21, 0.004).withColumnRenamed("rv", "rv")
    spot = t.bars().filter("symbol = 'AF'").select("ts", F.col("close").alias("spot"))
    day = m.join(spot, "ts").select("ts", "spot", (F.col("rv") * F.sqrt(F.lit(252.0))).alias("vol0")).filter("vol0 IS NOT NULL")
    q = t.raw("lineitem").select(F.to_date("l_shipdate").alias("ts"), ((F.col("l_quantity") - 1) / 49).alias("u"), F.col("l_tax").alias("noise"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    q = q.groupBy("ts", "u").agg(F.min_by("noise", "seq").alias("noise"), F.min("seq").alias("seq"))
    j = q.join(day, "ts")
    half = 2.5 * F.col("vol0") * (21 / 252.0) ** 0.5
    k = (2 * F.col("u") - 1) * half
    iv = F.col("vol0") * (1.1 - 0.15 * k / half + 0.12 * (k / half) * (k / half)) + (F.col("noise") - 0.04) * 0.05
    return j.select(F.col("ts").cast("string").alias("symbol"), (F.col("spot") * F.exp(k)).alias("strike"), iv.alias("iv"), "seq", "spot", F.lit(21 / 252.0).alias("years"), F.lit(0.03).alias("rate"))


@query("est09_smile_fits")
def _(t: Tables):
    c = usable_quotes(day_chains(t))
    forward = F.col("spot") * F.exp(F.col("rate") * F.col("years"))
    q = c.select("symbol", F.ln(F.col("strike") / forward).alias("k"), (F.col("iv") * F.col("iv") * F.col("years")).alias("w"))
    return rounded(es.fit_smiles(q, "symbol").select("symbol", "rmse", "a", "b", "rho", "m", "sigma", "n_quotes", "k_min", "k_max", "error"), 5)


@query("est14_implied_views")
def _(t: Tables):
    return rounded(es.implied_view(usable_quotes(day_chains(t)), "symbol").select("symbol", "mean_return", "variance_return", "skew_return", "atm_vol", "forward_error", "n_quotes", "error"), 4)
