"""Performance, risk and calibration queries."""

from pyspark.sql import functions as F

from tidewright.catalog.filters import FEAT
from tidewright.catalog.registry import longs, query, rounded
from tidewright.catalog.windows import FEATURES, INDEX, STOCK, W, candle_features
from tidewright.operators import stats
from tidewright.operators import windows as win
from tidewright.operators.ranks import exact_quantiles
from tidewright.tables import HOURLY_SQL, Tables


def stats_sql(src: str, keys: str = "symbol", prefix: str = "") -> str:
    p = f"PARTITION BY {keys}"
    x = prefix
    return f"""{x}e AS (SELECT {keys}, ts, equity, row_number() OVER ({p} ORDER BY ts) AS pos, equity / lag(equity) OVER ({p} ORDER BY ts) - 1 AS ret,
    (equity / max(equity) OVER ({p} ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1) * 100 AS dd FROM {src}),
{x}tr AS (SELECT {keys}, arg_min(pos, {{'d': round(dd, 9), 'p': pos}}) AS trough, min(dd) AS worst FROM {x}e GROUP BY {keys}),
{x}st AS (SELECT {", ".join("e." + k for k in keys.split(", "))}, count(*) AS n_periods, arg_max(equity, pos) / arg_min(equity, pos) AS growth, stddev_samp(ret) AS sd, avg(ret) AS mean, max(worst) AS max_drawdown_pct, max(trough) AS trough,
    max(pos) FILTER (dd >= -1e-12 AND pos <= trough) AS peak, count(*) FILTER (ret > 1e-12) AS wins, count(*) FILTER (ret < -1e-12) AS losses, avg(ret) FILTER (ret > 1e-12) AS win, avg(ret) FILTER (ret < -1e-12) AS loss
  FROM {x}e e JOIN {x}tr USING ({keys}) GROUP BY {", ".join("e." + k for k in keys.split(", "))} HAVING count(*) >= 3),
{x}stats AS (SELECT {keys}, (growth - 1) * 100 AS total_return_pct, (power(growth, 252 / (n_periods - 1)) - 1) * 100 AS annualized_return_pct, sd * sqrt(252) * 100 AS annualized_vol_pct,
    CASE WHEN sd > 1e-12 THEN mean / sd * sqrt(252) END AS sharpe, max_drawdown_pct, CAST(CASE WHEN max_drawdown_pct < 0 THEN trough - peak ELSE 0 END AS BIGINT) AS max_drawdown_bars,
    CASE WHEN wins + losses > 0 THEN wins / (wins + losses) * 100 ELSE 0 END AS win_rate_pct, CASE WHEN abs(loss) > 1e-12 THEN win / abs(loss) END AS payoff_ratio, n_periods FROM {x}st)"""


STAT_COLS = ["total_return_pct", "annualized_return_pct", "annualized_vol_pct", "sharpe", "max_drawdown_pct", "win_rate_pct", "payoff_ratio"]
STAT_OUT = ", ".join(f"round({c}, 6) AS {c}" for c in STAT_COLS) + ", max_drawdown_bars, n_periods"


@query("agg14_performance_stats", f"{STOCK}, q AS (SELECT symbol, ts, close AS equity FROM stocks), {stats_sql('q')} SELECT symbol, {STAT_OUT} FROM stats")
def _(t: Tables):
    return rounded(stats.performance_stats(t.stocks().select("symbol", "ts", F.col("close").alias("equity")), ["symbol"]))


@query("agg15_max_drawdown", f"{STOCK}, q AS (SELECT symbol, ts, close AS equity FROM stocks), {stats_sql('q')} SELECT symbol, round(max_drawdown_pct, 8) AS max_drawdown_pct, max_drawdown_bars FROM stats")
def _(t: Tables):
    s = stats.performance_stats(t.stocks().select("symbol", "ts", F.col("close").alias("equity")), ["symbol"])
    return rounded(s.select("symbol", "max_drawdown_pct", "max_drawdown_bars"), 8)


LEVELS = [0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95]
_LV = "[" + ", ".join(str(x) for x in LEVELS) + "]"
_CAL = f"""c AS (SELECT symbol, ts, (close / lag(close) OVER {W} - 1) * 100 AS y FROM stocks), tr AS (SELECT * FROM c WHERE ts < DATE '1999-01-01' AND y IS NOT NULL), te AS (SELECT * FROM c WHERE ts >= DATE '1999-01-01' AND y IS NOT NULL),
fq AS (SELECT symbol, unnest({_LV}::DOUBLE[]) AS level, unnest(quantile_cont(y, {_LV}::DOUBLE[])) AS quantile FROM tr GROUP BY 1), bq AS (SELECT unnest({_LV}::DOUBLE[]) AS level, unnest(quantile_cont(y, {_LV}::DOUBLE[])) AS base_quantile FROM tr),
rr AS (SELECT te.symbol, te.y, fq.level, quantile, base_quantile FROM te JOIN fq USING (symbol) JOIN bq ON bq.level = fq.level)"""


def calibration_rows(t: Tables):
    """Per-symbol train quantiles as the forecast, quantiles over all symbols as the unconditional baseline."""
    c = t.stocks().select("symbol", "ts", (win.pct_return("close") * 100).alias("y")).filter("y IS NOT NULL")
    cut = F.lit("1999-01-01").cast("date")
    train, test = c.filter(F.col("ts") < cut), c.filter(F.col("ts") >= cut)
    levels = F.array(*[F.lit(x) for x in LEVELS])
    fq = train.groupBy("symbol").agg(F.percentile("y", levels).alias("q")).select("symbol", F.explode(F.arrays_zip(levels.alias("level"), F.col("q").alias("quantile"))).alias("z")).select("symbol", "z.level", "z.quantile")
    bq = exact_quantiles(train, [], "y", LEVELS).select(F.explode(F.arrays_zip(levels.alias("level"), F.col("quantiles").alias("base_quantile"))).alias("z")).select("z.*")
    return test.join(fq, "symbol"), bq


@query("agg16_pinball_loss", f"{STOCK}, {_CAL} SELECT symbol, round(avg(greatest(level * (y - quantile), (level - 1) * (y - quantile))), 8) AS pinball, count(*) AS n FROM rr GROUP BY 1")
def _(t: Tables):
    return rounded(stats.pinball_loss(calibration_rows(t)[0], ["symbol"]), 8)


@query("agg17_coverage_report", f"""{STOCK}, {_CAL}, g AS (SELECT symbol, level, count(*) AS n, avg(CAST(y <= quantile AS INT)) AS coverage, avg(greatest(level * (y - quantile), (level - 1) * (y - quantile))) AS p, avg(greatest(level * (y - base_quantile), (level - 1) * (y - base_quantile))) AS b FROM rr GROUP BY 1, 2)
SELECT symbol, level, n, round(coverage, 6) AS coverage, round(coverage - level, 6) AS error, round(sqrt(level * (1 - level) / greatest(2, n // 5)), 6) AS standard_error, round(1 - p / b, 6) AS skill, abs(coverage - level) <= 2 * sqrt(level * (1 - level) / greatest(2, n // 5)) AS calibrated FROM g""")
def _(t: Tables):
    rows, base = calibration_rows(t)
    per_symbol = rows.select("symbol").distinct().join(F.broadcast(base.agg(F.collect_list(F.struct("level", "base_quantile")).alias("b"))))
    base = per_symbol.select("symbol", F.explode("b").alias("x")).select("symbol", "x.*")
    return rounded(stats.coverage_report(rows, base, ["symbol"], 5))


@query("agg17_coverage_verdict", f"""{STOCK}, {_CAL}, g AS (SELECT symbol, level, sqrt(level * (1 - level) / greatest(2, count(*) // 5)) AS se, avg(CAST(y <= quantile AS INT)) - level AS err FROM rr GROUP BY 1, 2)
SELECT symbol, count(*) AS levels, arg_max(level, struct_pack(m := round(abs(err) / se, 6), l := -level)) AS worst_level, max(round(abs(err) / se, 6)) AS worst_miss, bool_and(abs(err) <= 2 * se) AS calibrated FROM g GROUP BY 1""")
def _(t: Tables):
    rows, base = calibration_rows(t)
    per_symbol = rows.select("symbol").distinct().join(F.broadcast(base.agg(F.collect_list(F.struct("level", "base_quantile")).alias("b"))))
    base = per_symbol.select("symbol", F.explode("b").alias("x")).select("symbol", "x.*")
    return rounded(stats.coverage_verdict(stats.coverage_report(rows, base, ["symbol"], 5), ["symbol"]))


@query("agg21_horizon_risk", f"""{INDEX}, b AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS b, close / lag(close) OVER {W} - 1 AS ret, (lead(close, 63) OVER {W} / close - 1) * 100 AS fwd FROM bars),
g AS (SELECT symbol, max(close) FILTER (b = 1) AS current_price, stddev_samp(ret) FILTER (b <= 63) * 100 AS daily_vol_pct, quantile_cont(fwd, 0.1) AS p10_pct, quantile_cont(fwd, 0.5) AS median_pct, quantile_cont(fwd, 0.9) AS p90_pct, min(fwd) AS worst_pct, count(fwd) AS n_windows FROM b GROUP BY 1)
SELECT symbol, current_price, round(daily_vol_pct, 6) AS daily_vol_pct, round(p10_pct, 6) AS p10_pct, round(median_pct, 6) AS median_pct, round(p90_pct, 6) AS p90_pct, round(worst_pct, 6) AS worst_pct, n_windows, round(daily_vol_pct * sqrt(63), 6) AS horizon_vol_pct, round(least(2 * daily_vol_pct * sqrt(63), 95), 6) AS bad_stretch_loss_pct FROM g WHERE n_windows >= 504""")
def _(t: Tables):
    return rounded(stats.horizon_risk(t.bars(), 63))


@query("bt08_stop_outcomes", f"""{STOCK}, p AS (SELECT symbol, close, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) AS path FROM stocks),
o AS (SELECT symbol, [x / close for x in path] AS r FROM p WHERE len(path) = 21), h AS (SELECT symbol, list_filter(r, lambda x: x <= 1 - 3::DOUBLE / 100)[1] AS hit, r[21] AS last FROM o), s AS (SELECT symbol, hit IS NOT NULL AS stopped, (coalesce(hit, last) - 1) * 100 AS out FROM h)
SELECT symbol, round(avg(CAST(stopped AS INT)) * 100, 6) AS hit_share_pct, round(quantile_cont(out, 0.1), 6) AS p10_pct, round(quantile_cont(out, 0.5), 6) AS median_pct, round(quantile_cont(out, 0.9), 6) AS p90_pct, round(min(out), 6) AS worst_pct, count(*) AS n_windows FROM s GROUP BY 1""")
def _(t: Tables):
    return rounded(stats.stop_outcomes(t.stocks(), 21, 3.0))


@query("agg22_prediction_accuracy", f"{STOCK}, p AS (SELECT symbol, close / lag(close, 5) OVER {W} - 1 AS p, lead(close, 5) OVER {W} / close - 1 AS y FROM stocks) SELECT symbol, round(corr(p, y), 6) AS correlation, round(avg(CAST((p > 0) = (y > 0) AS INT)), 6) AS directional_accuracy, round(avg(CAST(y > 0 AS INT)), 6) AS up_share, count(*) AS n FROM p WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY 1")
def _(t: Tables):
    p = t.stocks().select("symbol", win.pct_return("close", 5).alias("p"), (F.lead("close", 5).over(win.by_symbol()) / F.col("close") - 1).alias("y")).dropna()
    same = ((F.col("p") > 0) == (F.col("y") > 0)).cast("double")
    return rounded(p.groupBy("symbol").agg(F.corr("p", "y").alias("correlation"), F.avg(same).alias("directional_accuracy"), F.avg((F.col("y") > 0).cast("double")).alias("up_share"), F.count("*").alias("n")))


@query("sca14_position_sizes", """SELECT o_orderkey AS request_id, round(CASE WHEN bad <= 0 THEN amount ELSE least(amount, max_loss / (bad / 100)) END, 6) AS invest FROM (SELECT o_orderkey, o_totalprice AS amount, o_totalprice / 20 AS max_loss, CAST(o_custkey % 5 * 10 AS DOUBLE) AS bad FROM orders)""")
def _(t: Tables):
    o = t.raw("orders")
    return rounded(o.select(F.col("o_orderkey").alias("request_id"), stats.size_for_loss(F.col("o_totalprice") / 20, F.col("o_totalprice"), (F.col("o_custkey") % 5 * 10).cast("double")).alias("invest")))


@query("sca15_risk_gate", """SELECT o_orderkey AS request_id, account, stop_distance, round(CASE WHEN stop_distance > 1e-12 THEN account * 0.01 / stop_distance END, 6) AS position_size, round(CASE WHEN stop_distance > 1e-12 THEN account * 0.01 / stop_distance END / account, 6) AS leverage_required,
  CASE WHEN stop_distance > 1e-12 THEN account * 0.01 / stop_distance END / account <= 0.5 AS trade_allowed FROM (SELECT o_orderkey, o_totalprice AS account, (o_custkey % 5) / 100.0::DOUBLE AS stop_distance FROM orders)""")
def _(t: Tables):
    o = t.raw("orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_totalprice").alias("account"), ((F.col("o_custkey") % 5) / 100.0).alias("stop_distance"))
    return rounded(stats.risk_gate(o, 0.01, 0.5))


_PAIRS = ["momentum_12", "relative_volume_20", "atr_percent", "volatility_20", "candle_strength"]


_SCREEN = "fw AS (SELECT *, ln(lead(close, 6) OVER (PARTITION BY symbol ORDER BY ts) / close) AS fwd FROM features)"


@query("agg39_correlation_screen", f"{FEAT}, {_SCREEN} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, fwd), 6) AS correlation FROM fw" for c in FEATURES))
def _(t: Tables):
    """Absolute correlation of every feature with the forward return, in one pass."""
    from tidewright.operators.filters import unpivoted

    df = candle_features(t).withColumn("fwd", win.forward_log("close", 6))
    one = df.agg(*[F.corr(c, "fwd").alias(c) for c in FEATURES])
    return rounded(unpivoted(one, FEATURES, "feature", "correlation"))


_ = (HOURLY_SQL, longs, _PAIRS)
