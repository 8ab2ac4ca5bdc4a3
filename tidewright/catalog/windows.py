"""Window queries: returns, labels, lags, scores, recurrences and observations."""

from pyspark.sql import functions as F

from tidewright.catalog.registry import longs, query, rounded
from tidewright.operators import macro
from tidewright.operators import windows as win
from tidewright.operators.scan import ewm_mean, ewm_means, ewm_rsi, wilder_rsi
from tidewright.session import calendar_sized
from tidewright.tables import HOURLY_SQL, INDEX_SQL, MACRO_SQL, SPEC_SQL, STOCK_SQL, Tables

STOCK = f"WITH {STOCK_SQL}"
INDEX = f"WITH {INDEX_SQL}"
W = "(PARTITION BY symbol ORDER BY ts)"


def rows(n, m=0):
    end = "CURRENT ROW" if m == 0 else f"{m} PRECEDING"
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND {end})"


@query("win01_returns", f"""{STOCK} SELECT symbol, ts, round(close / lag(close) OVER {W} - 1, 8) AS ret,
  round(ln(close / lag(close) OVER {W}), 8) AS log_ret, round(close - lag(close, 5) OVER {W}, 8) AS change_5 FROM stocks""")
def _(t: Tables):
    return rounded(t.stocks().select(
        "symbol", "ts", win.pct_return("close").alias("ret"), win.log_return("close").alias("log_ret"),
        win.change("close", 5).alias("change_5")), 8)


@query("win02_forward_returns", f"""{STOCK}, r AS (SELECT *, close / lag(close) OVER {W} - 1 AS ret FROM stocks)
SELECT symbol, ts, round(ln(lead(close, 6) OVER {W} / close), 8) AS fwd_log_6, round((lead(close, 21) OVER {W} / close - 1) * 100, 8) AS fwd_pct_21,
  round(CASE WHEN count(ret) OVER f = 10 THEN exp(sum(ln(1 + ret)) OVER f) - 1 END, 8) AS fwd_comp_10
FROM r WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)""")
def _(t: Tables):
    r = t.stocks().withColumn("ret", win.pct_return("close"))
    return rounded(r.select("symbol", "ts", win.forward_log("close", 6).alias("fwd_log_6"),
                            win.forward_pct("close", 21).alias("fwd_pct_21"),
                            win.forward_compounded("ret", 10).alias("fwd_comp_10")), 8)


@query("win03_three_class_label", f"""WITH {HOURLY_SQL}, f AS (SELECT symbol, ts, ln(lead(close, 6) OVER {W} / close) AS f FROM hourly)
SELECT symbol, ts, CAST(CASE WHEN f > 0.004 THEN 2 WHEN f < -0.004 THEN 0 ELSE 1 END AS BIGINT) AS signal FROM f""")
def _(t: Tables):
    f = t.hourly().select("symbol", "ts", win.forward_log("close", 6).alias("f"))
    return longs(f.select("symbol", "ts", win.three_way_label(F.col("f")).alias("signal")))


_LAGS = ", ".join(f"lag({c}, {k}) OVER {W} AS {c}_lag{k}" for c in ("close", "volume") for k in (1, 5, 21))


@query("win04_lag_columns", f"{STOCK} SELECT symbol, ts, {_LAGS} FROM stocks")
def _(t: Tables):
    return win.with_lags(t.stocks().select("symbol", "ts", "close", "volume"), ["close", "volume"], [1, 5, 21]).drop("close", "volume")


@query("win05_rolling_zscore", f"""{STOCK} SELECT symbol, ts, round(CASE WHEN count(close) OVER f >= 30 AND stddev_samp(close) OVER f > 1e-10
  THEN (close - avg(close) OVER f) / stddev_samp(close) OVER f END, 6) AS close_z FROM stocks WINDOW f AS {rows(59)}""")
def _(t: Tables):
    return rounded(t.stocks().select("symbol", "ts", win.rolling_zscore("close", 60).alias("close_z")))


@query("win09_exponential_means", f"""{STOCK}, r AS (SELECT *, close / lag(close) OVER {W} - 1 AS ret FROM stocks),
l AS (SELECT symbol, ts, list(close) OVER p AS cs, list(ret * ret) FILTER (ret IS NOT NULL) OVER p AS rs FROM r WINDOW p AS {rows('UNBOUNDED')})
SELECT symbol, ts, round(list_reduce(cs, lambda a, x: a * 4 / 6 + x * 2 / 6), 6) AS ema_5,
  round(list_reduce(cs, lambda a, x: a * 19 / 21 + x * 2 / 21), 6) AS ema_20,
  round(sqrt(list_reduce(rs, lambda a, x: a * 0.94 + x * 0.06) * 252), 6) AS riskmetrics_vol FROM l""")
def _(t: Tables):
    df = t.stocks().withColumn("ret", win.pct_return("close")).withColumn("sq", F.col("ret") * F.col("ret"))
    df = ewm_means(df, [("close", 2 / 6, "ema_5"), ("close", 2 / 21, "ema_20"), ("sq", 0.06, "v")])
    return rounded(df.select("symbol", "ts", "ema_5", "ema_20", F.sqrt(F.col("v") * 252).alias("riskmetrics_vol")))


_WTS = "[" + ", ".join(str(0.94**k) for k in range(29, -1, -1)) + "]"


@query("win10_weighted_volatility", f"""{STOCK}, r AS (SELECT *, close / lag(close) OVER {W} - 1 AS ret FROM stocks),
l AS (SELECT symbol, ts, list(ret * ret) FILTER (ret IS NOT NULL) OVER p AS rs FROM r WINDOW p AS {rows(29)})
SELECT symbol, ts, round(CASE WHEN len(rs) = 30 THEN sqrt(list_dot_product(rs, CAST({_WTS} AS DOUBLE[])) / list_sum(CAST({_WTS} AS DOUBLE[]))) * sqrt(252) END, 6) AS ewma_vol FROM l""")
def _(t: Tables):
    r = t.stocks().withColumn("ret", win.pct_return("close"))
    return rounded(r.select("symbol", "ts", win.fixed_weight_ewma_vol("ret", 30, 0.94).alias("ewma_vol")))


_GL = f"""d AS (SELECT symbol, ts, close - lag(close) OVER {W} AS d, row_number() OVER {W} AS pos FROM stocks),
l AS (SELECT symbol, ts, pos, list(greatest(d, 0)) FILTER (d IS NOT NULL) OVER p AS g, list(greatest(-d, 0)) FILTER (d IS NOT NULL) OVER p AS s
  FROM d WINDOW p AS {rows('UNBOUNDED')})"""


@query("win11_rsi_exponential", f"""{STOCK}, {_GL},
a AS (SELECT *, list_reduce(g, lambda a, x: a * 13 / 14 + x / 14) AS ag, list_reduce(s, lambda a, x: a * 13 / 14 + x / 14) AS al FROM l),
r AS (SELECT symbol, ts, CASE WHEN al > 0 THEN 100 - 100 / (1 + ag / al) WHEN ag > 0 THEN 100 END AS rsi FROM a)
SELECT symbol, ts, round(lag(rsi) OVER {W}, 6) AS rsi_14, round((lag(rsi) OVER {W} - 50) / 50, 6) AS rsi_normalized FROM r""")
def _(t: Tables):
    r = ewm_rsi(t.stocks(), 14, "rsi").withColumn("rsi_14", F.lag("rsi").over(win.by_symbol()))
    return rounded(r.select("symbol", "ts", "rsi_14", ((F.col("rsi_14") - 50) / 50).alias("rsi_normalized")))


@query("win12_rsi_wilder", f"""{STOCK}, {_GL},
a AS (SELECT symbol, ts, CASE WHEN pos > 14 THEN list_reduce(list_concat([list_avg(g[1:14])], g[15:]), lambda a, x: (a * 13 + x) / 14) END AS ag,
  CASE WHEN pos > 14 THEN list_reduce(list_concat([list_avg(s[1:14])], s[15:]), lambda a, x: (a * 13 + x) / 14) END AS al FROM l)
SELECT symbol, ts, round(CASE WHEN ag IS NULL THEN NULL WHEN al <= 1e-12 THEN CASE WHEN ag > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + ag / al) END, 6) AS rsi_14 FROM a""")
def _(t: Tables):
    return rounded(wilder_rsi(t.stocks(), 14, "rsi_14").select("symbol", "ts", "rsi_14"))


_FEATURE_SQL = f"""l AS (SELECT *, list(close) OVER p AS cs, ln(close / lag(close) OVER w) AS lr,
    greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
    CASE WHEN abs(high - low) > 1e-12 THEN (close - open) / (high - low) END AS body
  FROM hourly WINDOW p AS {rows('UNBOUNDED')}, w AS {W}),
e AS (SELECT * EXCLUDE (cs), list_reduce(cs, lambda a, x: a * 4 / 6 + x * 2 / 6) AS ema5, list_reduce(cs, lambda a, x: a * 19 / 21 + x * 2 / 21) AS ema20,
    CASE WHEN count(volume) OVER {rows(19)} = 20 THEN avg(volume) OVER {rows(19)} END AS v20,
    CASE WHEN count(tr) OVER {rows(13)} = 14 THEN avg(tr) OVER {rows(13)} END AS atr,
    CASE WHEN count(lr) OVER {rows(19)} = 20 THEN stddev_samp(lr) OVER {rows(19)} END AS sd20 FROM l),
features AS (SELECT symbol, ts, open, high, low, close, volume, ema5, ema20,
    (lag(ema5) OVER w - lag(ema20) OVER w) / lag(ema20) OVER w AS ema_trend_strength,
    (lag(close) OVER w - lag(ema20) OVER w) / lag(ema20) OVER w AS ema_distance,
    lag(close) OVER w / lag(close, 13) OVER w - 1 AS momentum_12, lag(volume) OVER w / lag(v20) OVER w AS relative_volume_20,
    lag(volume) OVER w / lag(volume, 2) OVER w AS volume_change, lag(atr) OVER w AS atr_14, lag(atr) OVER w / lag(close) OVER w AS atr_percent,
    lag(sd20) OVER w AS volatility_20,
    CAST(CASE WHEN lag(ema5, 2) OVER w < lag(ema20, 2) OVER w AND lag(ema5) OVER w > lag(ema20) OVER w THEN 1
      WHEN lag(ema5, 2) OVER w > lag(ema20, 2) OVER w AND lag(ema5) OVER w < lag(ema20) OVER w THEN -1 ELSE 0 END AS BIGINT) AS ema_cross,
    lag(body) OVER w AS candle_strength, CAST(coalesce(CAST(lag(close) OVER w > lag(ema20) OVER w AS INT), 0) AS BIGINT) AS trend_regime
  FROM e WINDOW w AS {W})"""
FEATURES = ["ema_trend_strength", "ema_distance", "momentum_12", "relative_volume_20", "volume_change", "atr_14",
            "atr_percent", "volatility_20", "candle_strength"]


def candle_features(t: Tables):
    df = ewm_mean(t.hourly(), "close", 2 / 6, "ema5")
    return win.price_features(ewm_mean(df, "close", 2 / 21, "ema20"))


@query("win13_price_features", f"WITH {HOURLY_SQL}, {_FEATURE_SQL} SELECT symbol, ts, ema_cross, trend_regime, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES) + " FROM features")
def _(t: Tables):
    return rounded(longs(candle_features(t).select("symbol", "ts", "ema_cross", "trend_regime", *FEATURES)))


@query("win14_open_interest_momentum", f"""WITH {HOURLY_SQL}, oi AS (SELECT date_trunc('hour', ts) AS ts, sum(CAST(json_extract(props, '$.k') AS DOUBLE)) AS oi FROM events GROUP BY 1),
n AS (SELECT symbol, h.ts, oi * close AS notional_oi FROM hourly h JOIN oi ON h.ts = oi.ts),
m AS (SELECT *, CASE WHEN abs(lag(notional_oi) OVER {W}) > 1e-12 THEN notional_oi / lag(notional_oi) OVER {W} END - 1 AS mom FROM n)
SELECT symbol, ts, round(notional_oi, 4) AS notional_oi, round(mom, 4) AS oi_momentum, round(lag(mom, 1) OVER {W}, 4) AS oi_momentum_lag1, round(lag(mom, 5) OVER {W}, 4) AS oi_momentum_lag5 FROM m""")
def _(t: Tables):
    oi = t.raw("events").groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(
        F.sum(F.get_json_object("props", "$.k").cast("double")).alias("oi"))
    df = t.hourly().join(oi, "ts").select("symbol", "ts", (F.col("oi") * F.col("close")).alias("notional_oi"))
    prev = F.lag("notional_oi").over(win.by_symbol())
    df = df.withColumn("oi_momentum", F.when(F.abs(prev) > 1e-12, F.col("notional_oi") / prev) - 1)
    return rounded(win.with_lags(df, ["oi_momentum"], [1, 5]), 4)


@query("win15_rule_indicators", f"""{STOCK}, r AS (SELECT *, ln(close / lag(close) OVER {W}) AS lr FROM stocks)
SELECT symbol, ts, round(avg(close) OVER a, 6) AS sma_20, round(CASE WHEN count(lr) OVER a >= 2 THEN stddev_samp(lr) OVER a * sqrt(252) * 100 END, 6) AS vol_20,
  round(CASE WHEN count(close) OVER a >= 2 THEN CASE WHEN stddev_samp(close) OVER a > 1e-12 THEN (close - avg(close) OVER a) / stddev_samp(close) OVER a ELSE 0 END END, 6) AS zscore_20,
  round((close / lag(close, 10) OVER {W} - 1) * 100, 6) AS ret_10, max(high) OVER b AS highest_50, min(low) OVER b AS lowest_50
FROM r WINDOW a AS {rows(19)}, b AS {rows(49)}""")
def _(t: Tables):
    wanted = [("sma", 20), ("vol", 20), ("zscore", 20), ("ret", 10), ("highest", 50), ("lowest", 50)]
    df = win.with_indicators(t.stocks(), wanted)
    return rounded(df.select("symbol", "ts", *[f"{k}_{n}" for k, n in wanted]))


TRIGGERS = [("change_pct", 5, -5.0), ("change_points", 21, 3.0), ("level_below", 1, 98.0), ("drawdown_pct", 120, -8.0), ("shock_day", 60, -2.0)]


@query("win16_trigger_flags", f"""{STOCK}, {INDEX_SQL}, m AS (SELECT ts, (close / lag(close) OVER (ORDER BY ts) - 1) * 100 AS mret FROM bars WHERE symbol = 'AF'),
r AS (SELECT s.*, mret, close / lag(close) OVER {W} - 1 AS ret FROM stocks s LEFT JOIN m USING (ts)),
x AS (SELECT symbol, ts, close, (close / lag(close, 5) OVER {W} - 1) * 100 AS m1, close - lag(close, 21) OVER {W} AS m2,
  (close / CASE WHEN count(close) OVER a >= 30 THEN max(close) OVER a END - 1) * 100 AS m4,
  ret / CASE WHEN count(ret) OVER b = 60 AND stddev_samp(ret) OVER b > 1e-12 THEN stddev_samp(ret) OVER b END AS m5, mret
  FROM r WINDOW a AS {rows(119)}, b AS {rows(60, 1)})
SELECT symbol, ts, CASE WHEN m1 IS NOT NULL THEN CAST(m1 < -5 AS INT)::DOUBLE END AS change_pct, CASE WHEN m2 IS NOT NULL THEN CAST(m2 > 3 AS INT)::DOUBLE END AS change_points,
  CAST(close < 98 AS INT)::DOUBLE AS level_below, CASE WHEN m4 IS NOT NULL THEN CAST(m4 <= -8 AS INT)::DOUBLE END AS drawdown_pct,
  CASE WHEN m5 IS NOT NULL THEN CAST(m5 <= -2 AND coalesce(mret > -1, false) AS INT)::DOUBLE END AS shock_day FROM x""")
def _(t: Tables):
    market = t.bars().filter("symbol = 'AF'").select("ts", win.pct_return("close").alias("market_ret"))
    df = t.stocks().join(calendar_sized(market), "ts", "left").withColumn("ret", win.pct_return("close"))
    return df.select("symbol", "ts", *[win.trigger_flag(k, n, x, market_return="market_ret").alias(k) for k, n, x in TRIGGERS])


@query("win21_drawdown", f"{STOCK} SELECT symbol, ts, round(close / max(close) OVER {rows('UNBOUNDED')} - 1, 8) AS drawdown FROM stocks")
def _(t: Tables):
    return rounded(t.stocks().select("symbol", "ts", win.drawdown("close").alias("drawdown")), 8)


@query("win22_compounded_equity", f"""{STOCK}, r AS (SELECT *, close / lag(close) OVER {W} - 1 AS ret FROM stocks)
SELECT symbol, ts, round(exp(sum(ln(1 + coalesce(ret, 0))) OVER {rows('UNBOUNDED')}), 6) AS growth FROM r""")
def _(t: Tables):
    r = t.stocks().withColumn("ret", win.pct_return("close"))
    return rounded(r.select("symbol", "ts", win.compounded("ret").alias("growth")))


OBSERVATION_SQL = f"""r AS (SELECT *, close / lag(close) OVER {W} - 1 AS ret FROM {{src}}),
o AS (SELECT symbol, ts, close, lag(close) OVER {W} AS prior_close, ret * 100 AS return_pct, count(close) OVER a AS context_n,
  stddev_samp(ret) OVER {rows(19, 1)} * 100 AS daily_vol_pct, volume / avg(volume) OVER a AS volume_ratio FROM r WINDOW a AS {rows(20, 1)}),
observations AS (SELECT *, CASE WHEN daily_vol_pct <= 1e-9 THEN 0 ELSE return_pct / daily_vol_pct END AS sigma_multiple FROM o WHERE context_n >= 10)"""


@query("win23_move_observations", f"""{STOCK}, {OBSERVATION_SQL.format(src='stocks')}
SELECT symbol, ts, close, prior_close, round(return_pct, 6) AS return_pct, context_n, round(daily_vol_pct, 6) AS daily_vol_pct, round(volume_ratio, 6) AS volume_ratio,
  round(sigma_multiple, 6) AS sigma_multiple, CASE WHEN abs(sigma_multiple) >= 3 THEN '3-sigma+' WHEN abs(sigma_multiple) >= 2 THEN '2-sigma'
  WHEN abs(sigma_multiple) >= 1 THEN '1-sigma' ELSE 'typical' END AS outlier FROM observations""")
def _(t: Tables):
    return rounded(win.move_observation(t.stocks()))


ALIGNED_SQL = f"""{MACRO_SQL}, {SPEC_SQL}, cons AS (SELECT m.*, name, lag_days, has_consensus, lag(value) OVER (PARTITION BY m.series_id ORDER BY ref_date) AS consensus FROM macro_obs m JOIN spec s USING (series_id)),
pub AS (SELECT name, ref_date + lag_days AS ts, value, CASE WHEN has_consensus THEN consensus END AS consensus FROM cons),
cal AS (SELECT CAST(unnest(generate_series(CAST(min(ref_date) AS TIMESTAMP), CAST(max(ref_date) + 43 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ts FROM macro_obs),
grid AS (SELECT ts, name FROM cal, spec WHERE dayofweek(ts) NOT IN (0, 6)),
aligned AS (SELECT g.name, g.ts, v.value, c.consensus FROM grid g ASOF LEFT JOIN pub v ON g.name = v.name AND g.ts >= v.ts
  ASOF LEFT JOIN (SELECT * FROM pub WHERE consensus IS NOT NULL) c ON g.name = c.name AND g.ts >= c.ts),
daily AS (SELECT 'macro' AS symbol, ts, max(value) FILTER (name = 'cpi') AS cpi, max(value) FILTER (name = 'unemployment') AS unemployment, max(value) FILTER (name = 'yield_2y') AS yield_2y,
  max(value) FILTER (name = 'yield_10y') AS yield_10y, max(value) FILTER (name = 'credit_spread') AS credit_spread,
  max(consensus) FILTER (name = 'cpi') AS cpi_consensus, max(consensus) FILTER (name = 'unemployment') AS unemployment_consensus FROM aligned GROUP BY ts)"""
NAMES = ["cpi", "unemployment", "yield_2y", "yield_10y", "credit_spread"]


def macro_daily(t: Tables):
    return macro.wide_daily(macro.align_to_daily(t.macro_obs(), t.series_spec(), 43), NAMES, NAMES[:2])


@query("join04_publication_lag_asof", f"WITH {ALIGNED_SQL} SELECT symbol, ts, " + ", ".join(f"round({c}, 8) AS {c}" for c in [*NAMES, 'cpi_consensus', 'unemployment_consensus']) + " FROM daily")
def _(t: Tables):
    return rounded(macro_daily(t), 8)


_LEVELS = ["cpi_yoy", "unemployment", "yield_2y", "yield_10y", "credit_spread", "curve_slope"]
_SURPRISE = """{c}_chg AS (SELECT ts, raw FROM (SELECT ts, {c} - {c}_consensus AS raw, lag({c} - {c}_consensus) OVER (ORDER BY ts) AS prev FROM daily) WHERE raw IS NOT NULL AND (prev IS NULL OR raw <> prev)),
{c}_s AS (SELECT ts, z FROM (SELECT ts, CASE WHEN count(raw) OVER f >= {need} AND stddev_samp(raw) OVER f > 1e-10 THEN raw / stddev_samp(raw) OVER f END AS z FROM {c}_chg
  WINDOW f AS (ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)) WHERE z IS NOT NULL)"""
MACRO_FEATURES_SQL = ALIGNED_SQL + ", " + ", ".join(_SURPRISE.format(c=c, need=12) for c in ("cpi", "unemployment")) + f""",
lev AS (SELECT *, (cpi / lag(cpi, 252) OVER {W} - 1) * 100 AS cpi_yoy, yield_10y - yield_2y AS curve_slope FROM daily),
base AS (SELECT l.symbol, l.ts, {", ".join("l." + c for c in _LEVELS)}, {", ".join(f"CASE WHEN count(l.{c}) OVER q >= 126 AND stddev_samp(l.{c}) OVER q > 1e-10 THEN (l.{c} - avg(l.{c}) OVER q) / stddev_samp(l.{c}) OVER q END AS {c}_z" for c in _LEVELS)},
  {", ".join(f"l.{c} - lag(l.{c}, {k}) OVER w AS {c}_chg{k}" for c in _LEVELS for k in (21, 63))}, a.z AS cpi_surprise_z, b.z AS unemployment_surprise_z
  FROM lev l ASOF LEFT JOIN cpi_s a ON l.ts >= a.ts ASOF LEFT JOIN unemployment_s b ON l.ts >= b.ts
  WINDOW w AS (PARTITION BY l.symbol ORDER BY l.ts), q AS (PARTITION BY l.symbol ORDER BY l.ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))"""
BASE = [*_LEVELS, *[f"{c}_z" for c in _LEVELS], *[f"{c}_chg{k}" for c in _LEVELS for k in (21, 63)], "cpi_surprise_z", "unemployment_surprise_z"]


@query("win06_macro_features", f"WITH {MACRO_FEATURES_SQL} SELECT symbol, ts, " + ", ".join(f"round({c}, 6) AS {c}" for c in BASE) + ", "
       + ", ".join(f"round(lag({c}, {k}) OVER {W}, 6) AS {c}_lag{k}" for c in BASE for k in (1, 5, 21)) + " FROM base")
def _(t: Tables):
    return rounded(macro.macro_features(macro_daily(t)))


@query("win07_normalized_surprise", f"WITH {ALIGNED_SQL}, {_SURPRISE.format(c='cpi', need=12)}, {_SURPRISE.format(c='unemployment', need=3)} "
       "SELECT d.symbol, d.ts, round(a.z, 6) AS cpi_surprise_z, round(b.z, 6) AS unemployment_surprise_z FROM daily d ASOF LEFT JOIN cpi_s a ON d.ts >= a.ts ASOF LEFT JOIN unemployment_s b ON d.ts >= b.ts")
def _(t: Tables):
    df = win.normalized_surprise(macro_daily(t), "cpi", "cpi_consensus", 24, 12, "cpi_surprise_z")
    df = win.normalized_surprise(df, "unemployment", "unemployment_consensus", 24, 3, "unemployment_surprise_z")
    return rounded(df.select("symbol", "ts", "cpi_surprise_z", "unemployment_surprise_z"))


RELEASE_SQL = f"""{MACRO_SQL}, {SPEC_SQL}, ch AS (SELECT m.series_id, name, ref_date, ref_date + lag_days AS release_date, value, lag(value) OVER w AS previous, value - lag(value) OVER w AS change
  FROM macro_obs m JOIN spec s USING (series_id) WHERE has_consensus WINDOW w AS (PARTITION BY m.series_id ORDER BY ref_date)),
releases AS (SELECT *, CASE WHEN count(change) OVER f >= 3 AND stddev_samp(change) OVER f > 1e-10 THEN (change - avg(change) OVER f) / stddev_samp(change) OVER f END AS surprise_z
  FROM ch WINDOW f AS (PARTITION BY series_id ORDER BY ref_date ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))"""


@query("win08_release_surprise", f"WITH {RELEASE_SQL} SELECT series_id, name, ref_date, release_date, round(value, 8) AS value, round(previous, 8) AS previous, round(change, 8) AS change, round(surprise_z, 8) AS surprise_z FROM releases")
def _(t: Tables):
    return rounded(macro.release_surprises(t.macro_obs(), t.series_spec()), 8)


@query("win24_yield_moves", f"WITH {ALIGNED_SQL} SELECT ts, round(yield_2y - lag(yield_2y) OVER (ORDER BY ts), 8) AS yield_2y, round(yield_10y - lag(yield_10y) OVER (ORDER BY ts), 8) AS yield_10y, round(credit_spread - lag(credit_spread) OVER (ORDER BY ts), 8) AS credit_spread FROM daily")
def _(t: Tables):
    d = macro_daily(t)
    return rounded(d.select("ts", *[win.change(c).alias(c) for c in NAMES[2:]]), 8)


@query("win25_random_walk_consensus", f"WITH {MACRO_SQL} SELECT series_id, ref_date, round(value, 8) AS value, round(lag(value) OVER (PARTITION BY series_id ORDER BY ref_date), 8) AS consensus FROM macro_obs")
def _(t: Tables):
    return rounded(macro.random_walk_consensus(t.macro_obs()), 8)


@query("win26_staged_exposure", f"{STOCK} SELECT symbol, ts, least(1.0::DOUBLE, (floor((row_number() OVER {W} - 1) / 21) + 1) / 4) AS exposure FROM stocks")
def _(t: Tables):
    return t.stocks().select("symbol", "ts", win.staged_exposure(4, 21).alias("exposure"))


@query("win28_indexed_history", f"""{STOCK}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM stocks)
SELECT symbol, ts, round(close / first_value(close) OVER {W} * 100, 6) AS indexed FROM r WHERE back <= 126""")
def _(t: Tables):
    return rounded(win.indexed_history(t.stocks(), 126).select("symbol", "ts", "indexed"))
