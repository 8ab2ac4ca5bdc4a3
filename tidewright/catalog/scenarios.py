"""Event-study queries."""

from pyspark.sql import functions as F

from tidewright.catalog.registry import query, rounded
from tidewright.catalog.windows import STOCK, W
from tidewright.operators import scenarios as sc
from tidewright.operators import windows as win
from tidewright.tables import INDEX_SQL, STOCK_SQL, Tables

SCENARIOS = [
    sc.Scenario("supply_shock", "NO", "change_pct", 63, 6.0), sc.Scenario("rate_shock", "RO", "change_points", 126, 0.8),
    sc.Scenario("recession_crash", "AF", "drawdown_pct", 252, -12.0), sc.Scenario("company_shock", "self", "shock_day", 20, -2.5),
    sc.Scenario("melt_up", "AF", "change_pct", 63, 6.0), sc.Scenario("quiet_market", "RF", "level_below", 1, 95.0),
]
_FWD = ", ".join(f"(lead(close, {h}) OVER {W} / close - 1) * 100 AS fwd_{h}" for h in sc.HORIZONS)


def _rows(n, m=0):
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND {'CURRENT ROW' if m == 0 else f'{m} PRECEDING'})"


SCENARIO_SQL = f"""{INDEX_SQL}, {STOCK_SQL}, px AS (SELECT symbol, ts, CASE WHEN symbol = 'RO' AND median(close) OVER (PARTITION BY symbol) > 20 THEN close / 10 ELSE close END AS close FROM bars),
pm AS (SELECT *, (close / lag(close, 63) OVER {W} - 1) * 100 AS c63, close - lag(close, 126) OVER {W} AS p126, (close / CASE WHEN count(close) OVER {_rows(251)} >= 63 THEN max(close) OVER {_rows(251)} END - 1) * 100 AS d252 FROM px),
pf AS (SELECT 'supply_shock' AS scenario, ts, CASE WHEN c63 IS NULL THEN NULL WHEN c63 > 6 THEN 1 ELSE 0 END AS flag FROM pm WHERE symbol = 'NO'
  UNION ALL SELECT 'rate_shock', ts, CASE WHEN p126 IS NULL THEN NULL WHEN p126 > 0.8 THEN 1 ELSE 0 END FROM pm WHERE symbol = 'RO'
  UNION ALL SELECT 'recession_crash', ts, CASE WHEN d252 IS NULL THEN NULL WHEN d252 <= -12 THEN 1 ELSE 0 END FROM pm WHERE symbol = 'AF'
  UNION ALL SELECT 'melt_up', ts, CASE WHEN c63 IS NULL THEN NULL WHEN c63 > 6 THEN 1 ELSE 0 END FROM pm WHERE symbol = 'AF'
  UNION ALL SELECT 'quiet_market', ts, CASE WHEN close < 95 THEN 1 ELSE 0 END FROM pm WHERE symbol = 'RF'),
mk AS (SELECT ts, (close / lag(close) OVER (ORDER BY ts) - 1) * 100 AS mret FROM bars WHERE symbol = 'AF'),
tg AS (SELECT symbol, ts, close, row_number() OVER {W} AS pos, close / lag(close) OVER {W} - 1 AS ret, {_FWD} FROM stocks),
sh AS (SELECT tg.*, mret, CASE WHEN count(ret) OVER s = 20 AND stddev_samp(ret) OVER s > 1e-12 THEN ret / stddev_samp(ret) OVER s END AS m FROM tg LEFT JOIN mk USING (ts) WINDOW s AS (PARTITION BY symbol ORDER BY tg.ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
own AS (SELECT symbol, 'company_shock' AS scenario, ts, pos, fwd_5, fwd_21, fwd_63, CASE WHEN m IS NULL THEN NULL WHEN m <= -2.5 AND coalesce(mret > -1, false) THEN 1 ELSE 0 END AS flag FROM sh),
sn AS (SELECT DISTINCT scenario FROM pf), ex AS (SELECT tg.*, scenario FROM tg, sn),
al AS (SELECT e.*, p.ts AS src_ts, p.flag AS pflag FROM ex e ASOF LEFT JOIN pf p ON e.scenario = p.scenario AND e.ts >= p.ts),
us AS (SELECT *, sum(CAST(ts > src_ts AS INT)) OVER (PARTITION BY symbol, scenario, src_ts ORDER BY ts ROWS UNBOUNDED PRECEDING) AS used FROM al),
fl AS (SELECT symbol, scenario, ts, pos, fwd_5, fwd_21, fwd_63, CASE WHEN used <= 3 THEN pflag END AS flag FROM us UNION ALL SELECT symbol, scenario, ts, pos, fwd_5, fwd_21, fwd_63, flag FROM own),
hit AS (SELECT *, pos - lag(pos) OVER (PARTITION BY symbol, scenario ORDER BY pos) AS step FROM fl WHERE flag >= 1 AND fwd_21 IS NOT NULL),
ep AS (SELECT symbol, scenario, count(*) FILTER (step IS NULL OR step > 10) AS episodes FROM hit GROUP BY 1, 2),
mo AS (SELECT scenario, CAST(NULL AS VARCHAR) AS symbol, date_trunc('month', ts) AS m, max(flag) AS f FROM pf WHERE flag IS NOT NULL GROUP BY 1, 2, 3 UNION ALL SELECT scenario, symbol, date_trunc('month', ts), max(flag) FROM own WHERE flag IS NOT NULL GROUP BY 1, 2, 3),
fq AS (SELECT scenario, symbol, count(*) AS months_observed, count(*) FILTER (f >= 1) AS months_triggered FROM mo GROUP BY 1, 2),
fs AS (SELECT s.symbol, f.scenario, months_observed, months_triggered FROM (SELECT DISTINCT symbol FROM stocks) s JOIN fq f ON f.symbol IS NULL OR f.symbol = s.symbol),
st AS (SELECT symbol, scenario, 5 AS horizon, fwd_5 AS fwd FROM hit UNION ALL SELECT symbol, scenario, 21, fwd_21 FROM hit UNION ALL SELECT symbol, scenario, 63, fwd_63 FROM hit),
oc AS (SELECT symbol, scenario, CAST(horizon AS BIGINT) AS horizon, count(*) AS n_days, quantile_cont(fwd, 0.5) AS median_pct, quantile_cont(fwd, 0.1) AS p10_pct, quantile_cont(fwd, 0.9) AS p90_pct, min(fwd) AS worst_pct, avg(CAST(fwd < 0 AS INT)) * 100 AS share_lower_pct, avg(CAST(fwd > 0 AS INT)) * 100 AS share_higher_pct
  FROM st JOIN ep USING (symbol, scenario) WHERE fwd IS NOT NULL AND episodes >= 2 GROUP BY 1, 2, 3),
measured AS (SELECT fs.symbol, fs.scenario, months_observed, months_triggered, months_triggered / months_observed * 100 AS frequency_pct, coalesce(episodes, 0) AS episodes, horizon, n_days, median_pct, p10_pct, p90_pct, worst_pct, share_lower_pct, share_higher_pct
  FROM fs LEFT JOIN ep ON fs.symbol = ep.symbol AND fs.scenario = ep.scenario LEFT JOIN oc ON fs.symbol = oc.symbol AND fs.scenario = oc.scenario)"""
_R = ["frequency_pct", "median_pct", "p10_pct", "p90_pct", "worst_pct", "share_lower_pct", "share_higher_pct"]


def inputs(t: Tables):
    bars = t.bars()
    market = bars.filter("symbol = 'AF'").select("ts", win.pct_return("close").alias("ret"))
    return t.stocks().select("symbol", "ts", "close"), sc.yield_points(bars.select("symbol", "ts", "close"), "RO"), market


def measured(t: Tables):
    return sc.measure_scenarios(*inputs(t), SCENARIOS)


# Entries of the library whose trigger no price series tells: they stay in the outlook without figures.
UNPRICED = [sc.Scenario("geopolitical_conflict", "none", None), sc.Scenario("policy_change", "none", None)]
_UNPRICED_SQL = "SELECT symbol, scenario, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT symbol FROM stocks), (VALUES " + ", ".join(f"('{s.name}')" for s in UNPRICED) + ") n(scenario)"


@query("q4_scenario_outlook", f"WITH {SCENARIO_SQL} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _R)}) FROM measured")
def _(t: Tables):
    """The whole scenario library measured for every symbol."""
    return rounded(measured(t))


@query("q4_scenario_library", f"WITH {SCENARIO_SQL}, whole AS (SELECT * FROM measured UNION ALL {_UNPRICED_SQL}) SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _R)}) FROM whole")
def _(t: Tables):
    """All entries for every symbol; those without a trigger keep a row without figures."""
    return rounded(sc.measure_scenarios(*inputs(t), [*SCENARIOS, *UNPRICED]))


@query("q4_dated_episodes", f"""WITH {SCENARIO_SQL}, nu AS (SELECT *, sum(CAST(step IS NULL OR step > 10 AS INT)) OVER (PARTITION BY symbol, scenario ORDER BY pos) AS episode FROM hit)
SELECT symbol, scenario, CAST(episode AS BIGINT) AS episode, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS days, CAST(max(pos) - min(pos) + 1 AS BIGINT) AS sessions, round(arg_min(fwd_21, pos), 6) AS after_first_pct FROM nu GROUP BY 1, 2, 3""")
def _(t: Tables):
    """When each scenario held for each symbol: its stretches with dates, and what followed their first day."""
    return rounded(sc.dated_episodes(*inputs(t), SCENARIOS))


_FLAG = f"f AS (SELECT symbol, ts, row_number() OVER {W} AS pos, (close / lag(close, 5) OVER {W} - 1) * 100 AS m FROM stocks)"


@query("agg18_monthly_frequency", f"{STOCK}, {_FLAG}, m AS (SELECT symbol, date_trunc('month', ts) AS mo, max(CAST(m < -3 AS INT)) AS f FROM f WHERE m IS NOT NULL GROUP BY 1, 2) SELECT symbol, count(*) AS months_observed, count(*) FILTER (f >= 1) AS months_triggered FROM m GROUP BY 1")
def _(t: Tables):
    return sc.monthly_frequency(t.stocks().select("symbol", "ts", win.trigger_flag("change_pct", 5, -3.0).alias("flag")), ["symbol"])


@query("agg19_episode_counts", f"{STOCK}, {_FLAG}, h AS (SELECT symbol, pos - lag(pos) OVER (PARTITION BY symbol ORDER BY pos) AS step FROM f WHERE m < -3) SELECT symbol, count(*) FILTER (step IS NULL OR step > 10) AS episodes FROM h GROUP BY 1")
def _(t: Tables):
    f = t.stocks().select("symbol", "ts", win.position().alias("pos"), win.trigger_flag("change_pct", 5, -3.0).alias("flag"))
    return sc.episode_counts(f.filter("flag >= 1"), ["symbol"])


_OUT = "count(*) AS n_days, round(quantile_cont(fwd, 0.5), 6) AS median_pct, round(quantile_cont(fwd, 0.1), 6) AS p10_pct, round(quantile_cont(fwd, 0.9), 6) AS p90_pct, round(min(fwd), 6) AS worst_pct, round(avg(CAST(fwd < 0 AS INT)) * 100, 6) AS share_lower_pct, round(avg(CAST(fwd > 0 AS INT)) * 100, 6) AS share_higher_pct"


@query("agg20_horizon_outcomes", f"{STOCK}, t AS (SELECT symbol, {_FWD} FROM stocks), s AS (SELECT symbol, 5::BIGINT AS horizon, fwd_5 AS fwd FROM t UNION ALL SELECT symbol, 21, fwd_21 FROM t UNION ALL SELECT symbol, 63, fwd_63 FROM t) SELECT symbol, horizon, {_OUT} FROM s WHERE fwd IS NOT NULL GROUP BY 1, 2")
def _(t: Tables):
    """The baseline over all days."""
    return rounded(sc.horizon_outcomes(sc.with_forwards(t.stocks().select("symbol", "ts", "close")), ["symbol"]))


@query("q8_stance_support", f"{STOCK}, t AS (SELECT symbol, (lead(close, 21) OVER {W} / close - 1) * 100 AS fwd FROM stocks) SELECT symbol, round(avg(CAST(fwd > 0 AS INT)) * 100, 6) AS share_up_pct, round(avg(CAST(fwd < 0 AS INT)) * 100, 6) AS share_down_pct, count(fwd) AS n_days FROM t WHERE fwd IS NOT NULL GROUP BY 1")
def _(t: Tables):
    f = t.stocks().select("symbol", win.forward_pct("close", 21).alias("fwd"))
    return rounded(f.groupBy("symbol").agg((F.avg((F.col("fwd") > 0).cast("double")) * 100).alias("share_up_pct"), (F.avg((F.col("fwd") < 0).cast("double")) * 100).alias("share_down_pct"), F.count("fwd").alias("n_days")))
