"""Filter and projection queries."""

from pyspark.sql import functions as F

from tidewright.catalog.registry import longs, query, rounded
from tidewright.catalog.windows import _FEATURE_SQL, FEATURES, STOCK, W, candle_features
from tidewright.functions.nulls import drop_unknown
from tidewright.operators import filters as fil
from tidewright.operators import windows as win
from tidewright.tables import BOOK_SQL, HOURLY_SQL, Tables

FEAT = f"WITH {HOURLY_SQL}, {_FEATURE_SQL}"
SIGNAL = f"CAST(CASE WHEN ln(lead(close, 6) OVER {W} / close) > 0.004 THEN 2 WHEN ln(lead(close, 6) OVER {W} / close) < -0.004 THEN 0 ELSE 1 END AS BIGINT) AS signal"


def labelled(t: Tables):
    df = candle_features(t)
    return df.withColumn("signal", win.three_way_label(win.forward_log("close", 6)))


@query("fil01_usable_quotes", """WITH q AS (SELECT p_brand AS symbol, CAST(p_size AS DOUBLE) AS strike, CASE WHEN p_partkey % 7 = 0 THEN CAST('nan' AS DOUBLE) ELSE (p_partkey % 40) / 100.0::DOUBLE END AS iv, p_partkey AS seq FROM part)
SELECT symbol, strike, arg_min(iv, seq) AS iv, min(seq) AS seq FROM q WHERE NOT isnan(iv) AND iv > 0 AND strike > 0 GROUP BY 1, 2""")
def _(t: Tables):
    q = t.raw("part").select(F.col("p_brand").alias("symbol"), F.col("p_size").cast("double").alias("strike"),
                             F.when(F.col("p_partkey") % 7 == 0, float("nan")).otherwise((F.col("p_partkey") % 40) / 100.0).alias("iv"), F.col("p_partkey").alias("seq"))
    return fil.usable_quotes(q)


@query("fil02_infinity_to_null", """SELECT event_id, value, 100 / (CAST(json_extract(props, '$.k') AS DOUBLE) - 50) AS ratio FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) <> 50""")
def _(t: Tables):
    d = F.get_json_object("props", "$.k").cast("double") - 50
    df = t.raw("events").select("event_id", "value", F.when(d == 0, float("inf")).otherwise(100 / F.when(d == 0, 1.0).otherwise(d)).alias("ratio"))
    return drop_unknown(df, ["value", "ratio"])


@query("fil03_required_columns", f"{FEAT} SELECT 'momentum_12' AS column_name, count(*) - count(momentum_12) AS nulls FROM features UNION ALL SELECT 'atr_14', count(*) - count(atr_14) FROM features UNION ALL SELECT 'volatility_20', count(*) - count(volatility_20) FROM features")
def _(t: Tables):
    return fil.null_counts(candle_features(t), ["momentum_12", "atr_14", "volatility_20", "close"])


@query("fil04_neutral_rows", f"{FEAT}, s AS (SELECT symbol, ts, momentum_12, {SIGNAL} FROM features) SELECT symbol, ts, round(momentum_12, 6) AS momentum_12, signal, CAST(signal = 2 AS BIGINT) AS direction FROM s WHERE signal <> 1")
def _(t: Tables):
    df = labelled(t).select("symbol", "ts", "momentum_12", "signal")
    return rounded(longs(fil.neutral_filter(df, F.col("signal") == 1)))


@query("fil05_price_sanity", f"{STOCK} SELECT symbol, ts, open, close FROM stocks WHERE open > 0 AND close > 0")
def _(t: Tables):
    return fil.price_sanity(t.stocks()).select("symbol", "ts", "open", "close")


@query("fil06_interactions", f"{FEAT} SELECT symbol, ts, round(momentum_12 * relative_volume_20, 6) AS momentum_12_x_relative_volume_20, round(atr_percent * candle_strength, 6) AS atr_percent_x_candle_strength FROM features")
def _(t: Tables):
    df = fil.interactions(candle_features(t), [("momentum_12", "relative_volume_20"), ("atr_percent", "candle_strength")])
    return rounded(df.select("symbol", "ts", "momentum_12_x_relative_volume_20", "atr_percent_x_candle_strength"))


_SPREAD = " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(stddev_pop({c}), 4) AS spread, stddev_pop({c}) > 1e-12 AS keep FROM n" for c in ("close", "volume", "one"))


@query("fil07_constant_columns", f"WITH {HOURLY_SQL}, n AS (SELECT *, CAST(1 AS DOUBLE) AS one FROM hourly) {_SPREAD}")
def _(t: Tables):
    return rounded(fil.column_spread(t.hourly().withColumn("one", F.lit(1.0)), ["close", "volume", "one"]), 4)


@query("fil08_complete_rows", f"{FEAT} SELECT symbol, ts FROM features WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES))
def _(t: Tables):
    return drop_unknown(candle_features(t), FEATURES).select("symbol", "ts")


@query("fil09_forward_outcome_mask", f"{STOCK}, r AS (SELECT symbol, ts, (close / lag(close, 5) OVER {W} - 1) * 100 AS m, (lead(close, 21) OVER {W} / close - 1) * 100 AS fwd FROM stocks) SELECT symbol, ts, round(fwd, 6) AS fwd FROM r WHERE m < -3 AND fwd IS NOT NULL")
def _(t: Tables):
    df = t.stocks().select("symbol", "ts", win.trigger_flag("change_pct", 5, -3.0).alias("flag"), win.forward_pct("close", 21).alias("fwd"))
    return rounded(df.filter("flag >= 1 AND fwd IS NOT NULL").select("symbol", "ts", "fwd"))


@query("fil12_null_report", f"{STOCK}, r AS (SELECT close / lag(close) OVER {W} - 1 AS ret, lead(close, 21) OVER {W} AS ahead FROM stocks) SELECT 'ret' AS column_name, count(*) - count(ret) AS nulls FROM r UNION ALL SELECT 'ahead', count(*) - count(ahead) FROM r")
def _(t: Tables):
    df = t.stocks().select("close", win.pct_return("close").alias("ret"), F.lead("close", 21).over(win.by_symbol()).alias("ahead"))
    return fil.null_counts(df, ["close", "ret", "ahead"])


@query("sca05_quote_arithmetic", f"""WITH {BOOK_SQL}, q AS (SELECT contract_id, CASE WHEN contract_id % 10 <> 0 THEN strike / 10 ELSE 0 END AS bid, strike / 9 AS ask, CASE WHEN contract_id % 40 = 0 THEN 9 ELSE vol END AS vendor_iv FROM book),
m AS (SELECT *, CASE WHEN bid > 0 AND ask > 0 THEN 0.5 * (bid + ask) END AS mid, CASE WHEN bid > 0 AND ask > 0 THEN greatest(ask - bid, 0) END AS spread FROM q)
SELECT contract_id, round(mid, 6) AS mid, round(spread, 6) AS spread, round(spread / mid, 6) AS spread_pct, bid IS NOT NULL AND ask > 0 AS tradeable, CASE WHEN ask > 0 THEN round(ask, 6) END AS buy_fill, CASE WHEN bid > 0 THEN round(bid, 6) END AS sell_fill,
  CASE WHEN vendor_iv BETWEEN 0.01 AND 4 THEN 'vendor' WHEN mid IS NOT NULL THEN 'solve' ELSE 'unavailable' END AS iv_source FROM m""")
def _(t: Tables):
    from tidewright.functions.options import quote_columns

    cid = F.col("contract_id")
    q = t.option_book().select("contract_id", F.when(cid % 10 != 0, F.col("strike") / 10).otherwise(0.0).alias("bid"), (F.col("strike") / 9).alias("ask"),
                               F.when(cid % 40 == 0, 9.0).otherwise(F.col("vol")).alias("vendor_iv"))
    return rounded(quote_columns(q).drop("bid", "ask", "vendor_iv"))


@query("fil10_expired_positions", f"""{STOCK}, p AS (SELECT o_orderkey AS position_id, 'S' || (o_custkey % (SELECT count(*) FROM supplier)) AS symbol, CAST(o_orderdate AS DATE) AS expiry FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1999-01-01')
SELECT p.position_id, p.symbol, p.expiry, s.close AS settle FROM p ASOF JOIN stocks s ON p.symbol = s.symbol AND p.expiry >= s.ts""")
def _(t: Tables):
    from tidewright.operators.asof import asof_join

    pos = t.raw("orders").select(F.col("o_orderkey").alias("position_id"), F.concat(F.lit("S"), F.col("o_custkey") % t.raw("supplier").count()).alias("symbol"), F.to_date("o_orderdate").alias("expiry"))
    settle = t.stocks().select("symbol", "ts", F.col("close").alias("settle"))
    found = asof_join(pos.filter(F.col("expiry") < F.lit("1999-01-01").cast("date")), settle, ["symbol"], "expiry", "ts", ["settle"])
    return found.filter("settle IS NOT NULL").drop("src_ts")


@query("fil11_stage_failures", f"""{STOCK}, r AS (SELECT symbol, ts, count(*) OVER {W} AS n, volume FROM stocks)
SELECT symbol, ts, concat_ws(';', CASE WHEN n < 60 THEN 'regime' END, CASE WHEN volume < 5 THEN 'forecast' END) AS failed_modules FROM r""")
def _(t: Tables):
    df = t.stocks().select(
        "symbol", "ts", F.when(win.position() < 60, "not enough history").alias("regime_error"), F.when(F.col("volume") < 5, "too little volume").alias("forecast_error"))
    return fil.stage_failures(df, ["regime", "forecast"]).select("symbol", "ts", "failed_modules")


@query("fil11_failure_log", f"""{STOCK}, r AS (SELECT symbol, ts, row_number() OVER {W} AS n, volume FROM stocks)
SELECT 'regime' AS stage, count(*) AS failures, 'not enough history' AS first_error FROM r WHERE n < 60 UNION ALL SELECT 'forecast', count(*), 'too little volume' FROM r WHERE volume < 5""")
def _(t: Tables):
    df = t.stocks().select(
        "symbol", "ts", F.when(win.position() < 60, "not enough history").alias("regime_error"), F.when(F.col("volume") < 5, "too little volume").alias("forecast_error"))
    return fil.failure_log(df, ["regime", "forecast"])
