"""Attribution and peer queries."""

from pyspark.sql import functions as F

from tidewright.catalog.registry import longs, query, rounded
from tidewright.catalog.windows import OBSERVATION_SQL, STOCK, W
from tidewright.operators import evidence as ev
from tidewright.operators import windows as win
from tidewright.session import checkpointed, dealt
from tidewright.tables import INDEX_SQL, STOCK_SQL, Tables

PANEL = ["AF", "AO", "NF", "NO", "RF", "RO"]


def returns_pct(bars):
    return bars.select("symbol", "ts", F.round(win.pct_return("close") * 100, 6).alias("ret"))


def stock_targets(t: Tables):
    return returns_pct(dealt(t.stocks(), "symbol")).withColumnRenamed("ret", "target")


def index_factors(t: Tables):
    return returns_pct(t.bars()).select(F.col("symbol").alias("factor_id"), "ts", F.col("ret").alias("value"))


def scored(t: Tables):
    targets, factors = stock_targets(t), index_factors(t)
    rates = ev.factor_hit_rates(ev.factor_history(targets, factors), ev.today_readings(targets, factors))
    return ev.score_factors(rates)


RATES_SQL = f"""{INDEX_SQL}, {STOCK_SQL}, tg AS (SELECT * FROM (SELECT symbol, ts, round((close / lag(close) OVER {W} - 1) * 100, 6) AS target FROM stocks) WHERE target IS NOT NULL),
fa AS (SELECT * FROM (SELECT symbol AS factor_id, ts, round((close / lag(close) OVER {W} - 1) * 100, 6) AS factor FROM bars) WHERE factor IS NOT NULL),
hist AS (SELECT symbol, factor_id, ts, factor, target FROM tg JOIN fa USING (ts)),
last AS (SELECT symbol, max(ts) AS session, CASE WHEN arg_max(target, ts) > 0 THEN 1 ELSE -1 END AS target_sign FROM tg GROUP BY 1),
ids AS (SELECT DISTINCT factor_id FROM fa), asks AS (SELECT * FROM last, ids),
today AS (SELECT a.symbol, a.factor_id, a.target_sign, f.factor AS today_value FROM asks a ASOF LEFT JOIN fa f ON a.factor_id = f.factor_id AND a.session >= f.ts),
edges AS (SELECT symbol, factor_id, count(*) AS history_n, list_sort(list_distinct(list_concat(quantile_cont(factor, [0.2, 0.4, 0.6, 0.8]), [min(factor), max(factor)]))) AS e FROM hist GROUP BY 1, 2),
binned AS (SELECT h.*, e.history_n, e.e[2:len(e.e)-1] AS inner_edges, len(list_filter(e.e[2:len(e.e)-1], lambda x: x < factor)) AS bin FROM hist h JOIN edges e USING (symbol, factor_id)),
loc AS (SELECT symbol, factor_id, t.target_sign, t.today_value, max(history_n) AS history_n, count(DISTINCT bin) AS bins, least(any_value(len(list_filter(inner_edges, lambda x: x <= t.today_value))), max(bin)) AS today_bin,
  avg(CAST(sign(target) = t.target_sign AS INT)) AS base_rate FROM binned JOIN today t USING (symbol, factor_id) GROUP BY 1, 2, 3, 4),
hits AS (SELECT symbol, factor_id, count(*) AS n, avg(CAST(sign(target) = target_sign AS INT)) AS hit FROM binned JOIN loc USING (symbol, factor_id) WHERE bin = today_bin GROUP BY 1, 2),
rates AS (SELECT l.symbol, l.factor_id, today_value, target_sign, CASE WHEN ok AND n IS NOT NULL AND bins >= 2 THEN today_bin END AS today_bin, CASE WHEN ok AND bins >= 2 THEN hit END AS hit_rate, CASE WHEN ok THEN base_rate END AS base_rate,
  CAST(CASE WHEN NOT ok THEN history_n WHEN bins >= 2 THEN coalesce(n, 0) ELSE 0 END AS BIGINT) AS sample_size FROM (SELECT *, history_n >= 250 AS ok FROM loc) l LEFT JOIN hits h USING (symbol, factor_id)),
s0 AS (SELECT * REPLACE (CASE WHEN sample_size >= 10 THEN hit_rate END AS hit_rate) FROM rates),
scored AS (SELECT *, hit_rate - base_rate AS lift, CASE WHEN hit_rate IS NOT NULL THEN sqrt(greatest(hit_rate * (1 - hit_rate), 0) / sample_size) END AS standard_error,
  coalesce(sqrt(greatest(hit_rate * (1 - hit_rate), 0) / sample_size) > 0 AND abs(hit_rate - base_rate) > 2 * sqrt(greatest(hit_rate * (1 - hit_rate), 0) / sample_size), false) AS beats_base_rate,
  CASE WHEN sample_size >= 100 THEN 'high' WHEN sample_size >= 30 THEN 'moderate' WHEN sample_size >= 10 THEN 'low' ELSE 'none' END AS confidence,
  coalesce(hit_rate * CASE WHEN sample_size >= 100 THEN 1.0 WHEN sample_size >= 30 THEN 0.75 WHEN sample_size >= 10 THEN 0.4 ELSE 0 END, 0) AS rank_score FROM s0)"""


@query("agg07_quintile_hit_rates", f"WITH {RATES_SQL} SELECT symbol, factor_id, today_value, CAST(target_sign AS BIGINT) AS target_sign, CAST(today_bin AS BIGINT) AS today_bin, round(hit_rate, 8) AS hit_rate, round(base_rate, 8) AS base_rate, sample_size FROM rates")
def _(t: Tables):
    targets, factors = stock_targets(t), index_factors(t)
    return rounded(longs(ev.factor_hit_rates(ev.factor_history(targets, factors), ev.today_readings(targets, factors))), 8)


_SCORED_COLS = "symbol, factor_id, round(hit_rate, 8) AS hit_rate, round(lift, 8) AS lift, round(standard_error, 8) AS standard_error, beats_base_rate, confidence, round(rank_score, 8) AS rank_score"


@query("agg08_factor_scores", f"WITH {RATES_SQL} SELECT {_SCORED_COLS} FROM scored")
def _(t: Tables):
    return rounded(scored(t).select("symbol", "factor_id", "hit_rate", "lift", "standard_error", "beats_base_rate", "confidence", "rank_score"), 8)


_RANK = "row_number() OVER (PARTITION BY symbol ORDER BY round(rank_score, 9) DESC, abs(coalesce(round(lift, 9), 0)) DESC, sample_size DESC, factor_id) AS rank"
RANKED_SQL = f"{RATES_SQL}, ranked AS (SELECT *, {_RANK} FROM scored)"


def ranked(t: Tables):
    s = scored(t).withColumn("rank_score", F.round("rank_score", 9)).withColumn("lift", F.round("lift", 9))
    return ev.rank_factors(s)


@query("flagship_factor_attribution", f"WITH {RANKED_SQL}, {OBSERVATION_SQL.format(src='stocks')}, obs AS (SELECT symbol, max(ts) AS session, arg_max(return_pct, ts) AS return_pct, arg_max(sigma_multiple, ts) AS sigma_multiple FROM observations GROUP BY 1) "
       "SELECT symbol, session, round(return_pct, 6) AS return_pct, round(sigma_multiple, 6) AS sigma_multiple, factor_id, rank, round(hit_rate, 8) AS hit_rate, round(base_rate, 8) AS base_rate, sample_size, confidence, beats_base_rate FROM obs JOIN ranked USING (symbol)")
def _(t: Tables):
    """Every symbol's last move, with its factors ranked by track record."""
    obs = win.move_observation(t.stocks()).groupBy("symbol").agg(F.max_by(F.struct("ts", "return_pct", "sigma_multiple"), "ts").alias("o"))
    obs = obs.select("symbol", F.col("o.ts").alias("session"), "o.return_pct", "o.sigma_multiple")
    f = ranked(t).select("symbol", "factor_id", "rank", "hit_rate", "base_rate", "sample_size", "confidence", "beats_base_rate")
    return rounded(longs(obs.join(f, "symbol")), 8, return_pct=6, sigma_multiple=6)


@query("top01_ranked_factors", f"WITH {RANKED_SQL} SELECT symbol, factor_id, rank, beats_base_rate AS supported FROM ranked")
def _(t: Tables):
    return longs(ranked(t).select("symbol", "factor_id", "rank", F.col("beats_base_rate").alias("supported")))


@query("agg09_market_model", f"""WITH {INDEX_SQL}, {STOCK_SQL}, m AS (SELECT ts, round((close / lag(close) OVER (ORDER BY ts) - 1) * 100, 6) AS market FROM bars WHERE symbol = 'AF'),
tg AS (SELECT *, max(ts) OVER (PARTITION BY symbol) AS session FROM (SELECT symbol, ts, round((close / lag(close) OVER {W} - 1) * 100, 6) AS target FROM stocks) WHERE target IS NOT NULL),
j AS (SELECT tg.*, market FROM tg LEFT JOIN m USING (ts)),
g AS (SELECT symbol, count(*) FILTER (ts < session AND market IS NOT NULL) AS sessions, covar_samp(target, market) FILTER (ts < session) AS cov, var_samp(market) FILTER (ts < session) AS v, arg_max(target, ts) AS move_pct, arg_max(market, ts) FILTER (market IS NOT NULL) AS market_pct FROM j GROUP BY 1),
b AS (SELECT *, CASE WHEN sessions >= 250 AND v > 1e-12 THEN cov / v END AS beta FROM g)
SELECT symbol, sessions, move_pct, market_pct, round(beta, 8) AS beta, round(beta * market_pct, 8) AS explained_pct, round(move_pct - beta * market_pct, 8) AS specific_pct, round(CASE WHEN abs(move_pct) > 1e-9 THEN abs(beta * market_pct / move_pct) END * 100, 5) AS explained_share_pct FROM b""")
def _(t: Tables):
    market = returns_pct(t.bars()).filter("symbol = 'AF'").drop("symbol")
    m = ev.market_model(stock_targets(t), market)
    return rounded(m, 8, explained_share_pct=5)


@query("agg10_sector_breadth", f"""WITH {INDEX_SQL}, r AS (SELECT * FROM (SELECT symbol, ts, close / lag(close) OVER {W} - 1 AS ret FROM bars) WHERE ret IS NOT NULL)
SELECT ts, round(count(*) FILTER (ret > 0) / 6.0::DOUBLE * 100, 6) AS rising_pct, round(count(*) FILTER (ret < 0) / 6.0::DOUBLE * 100, 6) AS falling_pct, count(*) AS present FROM r GROUP BY ts""")
def _(t: Tables):
    return rounded(ev.sector_breadth(t.bars().select("symbol", "ts", win.pct_return("close").alias("ret")), PANEL))


WEIGHTS = {"AO": 0.070, "NF": 0.065, "NO": 0.062, "RF": 0.038, "RO": 0.025}


@query("agg11_index_contributions", f"""WITH {INDEX_SQL}, r AS (SELECT symbol, ts, round((close / lag(close) OVER {W} - 1) * 100, 6) AS ret FROM bars),
w(symbol, weight) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in WEIGHTS.items())}),
c AS (SELECT ts, symbol, ret, weight * ret AS contribution, row_number() OVER (PARTITION BY ts ORDER BY abs(weight * ret) DESC, symbol) AS rank FROM r JOIN w USING (symbol) WHERE ret IS NOT NULL)
SELECT c.ts, c.symbol, rank, c.ret, round(contribution, 9) AS contribution, round(CASE WHEN abs(i.ret) > 1e-9 THEN abs(contribution / i.ret) END * 100, 4) AS share_pct FROM c JOIN r i ON i.symbol = 'AF' AND i.ts = c.ts WHERE rank <= 2""")
def _(t: Tables):
    r = returns_pct(t.bars())
    return longs(rounded(ev.index_contributions(r, WEIGHTS, r.filter("symbol = 'AF'")), 9, share_pct=4))


@query("agg12_peer_medians", """WITH m AS (SELECT s_suppkey AS symbol, s_nationkey AS sector, 'profit_margin' AS metric, round(s_acctbal / 10000, 6) AS value FROM supplier),
p AS (SELECT a.symbol, a.sector, a.metric, a.value, count(*) AS peers, median(b.value) AS peer_median FROM m a JOIN m b ON a.sector = b.sector AND a.metric = b.metric AND a.symbol <> b.symbol GROUP BY ALL)
SELECT symbol, CAST(sector AS BIGINT) AS sector, metric, value, peers, round(peer_median, 8) AS peer_median, round((CASE WHEN abs(peer_median) > 1e-12 THEN value / peer_median END - 1) * 100, 4) AS vs_median_pct FROM p WHERE peers >= 3""")
def _(t: Tables):
    m = t.fundamentals().select("symbol", "sector", F.lit("profit_margin").alias("metric"), F.col("profit_margin").alias("value"))
    return longs(rounded(ev.peer_comparison(m), 8, vs_median_pct=4))


TREND_SQL = f"""b AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS b, close / lag(close) OVER {W} - 1 AS ret FROM stocks),
g AS (SELECT symbol, count(*) AS sessions, max(close) FILTER (b = 1) AS current, max(close) FILTER (b = 22) AS c21, max(close) FILTER (b = 64) AS c63, max(close) FILTER (b = 253) AS c252, stddev_samp(ret) FILTER (b <= 252) AS sd, max(close) FILTER (b <= 252) AS high_52w, min(close) FILTER (b <= 252) AS low_52w FROM b GROUP BY 1),
trend AS (SELECT symbol, sessions, current, (current / c21 - 1) * 100 AS return_1m_pct, (current / c63 - 1) * 100 AS return_3m_pct, (current / c252 - 1) * 100 AS return_1y_pct, sd * sqrt(252) * 100 AS annualized_vol_pct, high_52w, low_52w, (current / high_52w - 1) * 100 AS drawdown_pct FROM g WHERE sessions >= 30)"""


@query("agg13_price_trend", f"{STOCK}, {TREND_SQL} SELECT symbol, sessions, current, round(return_1m_pct, 6) AS return_1m_pct, round(return_3m_pct, 6) AS return_3m_pct, round(return_1y_pct, 6) AS return_1y_pct, round(annualized_vol_pct, 6) AS annualized_vol_pct, high_52w, low_52w, round(drawdown_pct, 6) AS drawdown_pct FROM trend")
def _(t: Tables):
    return rounded(ev.price_trend(t.stocks()))


FLAG_BASE_SQL = f"""{STOCK_SQL}, {TREND_SQL}, f AS (SELECT 'S' || s_suppkey AS symbol, s_nationkey AS sector, round(s_acctbal / 10000, 6) AS profit_margin, round((s_acctbal + 1000) / 500, 6) AS trailing_pe, CASE WHEN s_suppkey % 3 <> 0 THEN round((s_acctbal + 1000) / 150000, 6) END AS dividend_yield, round((s_acctbal + 1000) / 4000, 6) AS debt_to_equity FROM supplier),
pm AS (SELECT a.symbol, count(*) AS n, median(b.trailing_pe) AS med FROM f a JOIN f b ON a.sector = b.sector AND a.symbol <> b.symbol GROUP BY 1),
base AS (SELECT f.*, CASE WHEN n >= 3 AND abs(med) > 1e-12 THEN (trailing_pe / med - 1) * 100 END AS pe_vs_median_pct, return_1y_pct, annualized_vol_pct FROM f LEFT JOIN pm USING (symbol) LEFT JOIN trend USING (symbol))"""


def flag_base(t: Tables):
    s = F.col("s_acctbal") + 1000
    f = t.raw("supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("symbol"), F.col("s_nationkey").alias("sector"), F.round(F.col("s_acctbal") / 10000, 6).alias("profit_margin"),
        F.round(s / 500, 6).alias("trailing_pe"), F.when(F.col("s_suppkey") % 3 != 0, F.round(s / 150000, 6)).alias("dividend_yield"), F.round(s / 4000, 6).alias("debt_to_equity"))
    peers = ev.peer_comparison(f.select("symbol", "sector", F.lit("trailing_pe").alias("metric"), F.col("trailing_pe").alias("value")))
    trend = ev.price_trend(t.stocks()).select("symbol", "return_1y_pct", "annualized_vol_pct")
    return f.join(peers.select("symbol", F.col("vs_median_pct").alias("pe_vs_median_pct")), "symbol", "left").join(trend, "symbol", "left")


_RULES = {"loss_making": "profit_margin <= 0", "rich_multiple": "trailing_pe > 0 AND pe_vs_median_pct > 25", "no_dividend": "dividend_yield IS NULL", "high_dividend": "dividend_yield > 0.06",
          "high_debt": "debt_to_equity > 2", "strong_year": "return_1y_pct > 50", "volatile": "annualized_vol_pct > 18"}
FLAGS_SQL = f"{FLAG_BASE_SQL}, flags AS (" + " UNION ALL ".join(f"SELECT symbol, '{k}' AS flag FROM base WHERE {v}" for k, v in _RULES.items()) + ")"


@query("sca18_snapshot_flags", f"WITH {FLAGS_SQL} SELECT * FROM flags")
def _(t: Tables):
    return ev.snapshot_flags(flag_base(t))


def last_observation(t: Tables):
    o = win.move_observation(t.stocks())
    return o.groupBy("symbol").agg(F.max_by(F.struct("outlier", "volume_ratio"), "ts").alias("r")).select("symbol", "r.*")


COUNTER_SQL = f"""{RANKED_SQL}, {OBSERVATION_SQL.format(src='stocks')}, lo AS (SELECT symbol, arg_max(sigma_multiple, ts) AS sg, arg_max(volume_ratio, ts) AS vr FROM observations GROUP BY 1),
kn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(rank_score, 9) DESC, factor_id) AS r FROM scored WHERE hit_rate IS NOT NULL), un AS (SELECT symbol FROM kn GROUP BY 1 HAVING NOT bool_or(beats_base_rate)),
ag AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(rank_score, 9) DESC, factor_id) AS r2 FROM kn WHERE round(lift, 9) < -0.05),
counter AS (SELECT symbol, 'not_unusual' AS item, NULL AS factor_id FROM lo WHERE abs(sg) < 1 UNION ALL SELECT symbol, 'low_volume', NULL FROM lo WHERE vr < 0.8
  UNION ALL SELECT symbol, 'none_beats_chance', factor_id FROM kn JOIN un USING (symbol) WHERE r = 1 UNION ALL SELECT symbol, 'points_other_way', factor_id FROM ag WHERE r2 <= 2)"""


@query("sca19_counter_evidence", f"WITH {COUNTER_SQL} SELECT * FROM counter")
def _(t: Tables):
    s = checkpointed(scored(t).withColumn("rank_score", F.round("rank_score", 9)).withColumn("lift", F.round("lift", 9)))  # read three times
    return ev.counter_evidence(last_observation(t), s)
