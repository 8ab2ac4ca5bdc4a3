"""The product queries: attribution, snapshot, diagnostics, feature tables, fact table and the divergence table."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.catalog import estimators as ce
from tidewright.catalog import evidence as cv
from tidewright.catalog.diagnostics import HALF_SQL, REGIME_SQL
from tidewright.catalog.filters import FEAT, SIGNAL, labelled
from tidewright.catalog.registry import longs, query, rounded
from tidewright.catalog.windows import FEATURES, STOCK, W
from tidewright.functions.nulls import drop_unknown, printed
from tidewright.operators import diagnostics as dg
from tidewright.operators import divergence as dv
from tidewright.operators import estimators as es
from tidewright.operators import evidence as ev
from tidewright.operators import records as rc
from tidewright.operators import windows as win
from tidewright.operators.filters import usable_quotes
from tidewright.session import checkpointed
from tidewright.streaming.state import premium_baselines, replayed
from tidewright.tables import STOCK_SQL, Tables

_GAP = f"""x AS (SELECT symbol, ts, close, lag(close, 20) OVER {W} AS p20, CASE WHEN volume > 4 THEN (close / lag(close, 5) OVER {W} - 1) * 100 END AS g FROM stocks),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS kn FROM x WHERE g IS NOT NULL), kk AS (SELECT symbol, ts, list(g) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS l, kn FROM k),
j AS (SELECT x.symbol, x.ts, x.g, b.l, b.kn FROM x ASOF LEFT JOIN kk b ON x.symbol = b.symbol AND x.ts > b.ts)"""


_BASE = f"WITH {STOCK_SQL}, {_GAP} SELECT symbol, ts, round(g, 6) AS mean_gap, coalesce(kn, 0) >= 20 AS baseline_ready, round(CASE WHEN kn >= 20 THEN list_median(l) ELSE 0 END, 6) AS base_mean_gap FROM j"


def gaps(t: Tables):
    g = F.when(F.col("volume") > 4, win.pct_return("close", 5) * 100)
    return t.stocks().select("symbol", "ts", g.alias("mean_gap")).withColumns({"variance_gap": F.col("mean_gap"), "skew_gap": F.col("mean_gap")})


@query("win20_premium_baseline", _BASE)
def _(t: Tables):
    return rounded(dv.premium_baseline(gaps(t)).select("symbol", "ts", "mean_gap", "baseline_ready", "base_mean_gap"))


@query("win20_stored_baseline", _BASE)
def _(t: Tables):
    """The baseline as a stream in two runs: the second one goes on with the windows that the first one stored."""
    d = checkpointed(gaps(t))
    half = d.agg(F.expr("date_add(min(ts), cast(datediff(max(ts), min(ts)) / 2 as int))")).first()[0]
    late = F.coalesce(F.col("ts") > half, F.lit(False))
    return rounded(replayed([d.filter(~late), d.filter(late)], premium_baselines).select("symbol", "ts", "mean_gap", "baseline_ready", "base_mean_gap"))


_MG = f"m AS (SELECT symbol, ts, 21 / CASE WHEN extract(day FROM ts) = 15 THEN 63.0::DOUBLE ELSE 21.0::DOUBLE END / 1 AS z, CASE WHEN extract(day FROM ts) = 15 THEN 63.0::DOUBLE ELSE 21.0::DOUBLE END / 252 AS years, close / 100 - 1 AS mean, 0.0012 * close / 100 AS variance, (close - 100) / 50 AS skew, 0.002::DOUBLE AS mean_return, 0.0010::DOUBLE AS variance_return, -0.3::DOUBLE AS skew_return, (volume - 25) / 10 AS tda_z, (close - 98) / 100 AS hurst_drop FROM stocks)"
_GP = f"""{_MG}, gp AS (SELECT *, abs(21 - years * 252) / (years * 252) <= 0.25 AS ok FROM m), gg AS (SELECT *, CASE WHEN ok THEN (mean - mean_return) / sqrt(variance_return) END AS mean_gap, CASE WHEN ok THEN ln(variance / variance_return) END AS variance_gap, CASE WHEN ok THEN skew - skew_return END AS skew_gap FROM gp),
fl AS (SELECT *, CASE WHEN tda_z >= 2 THEN 2 WHEN tda_z >= 1 THEN 1 ELSE 0 END AS a, CASE WHEN hurst_drop >= 0.06 THEN 2 WHEN hurst_drop >= 0.03 THEN 1 ELSE 0 END AS b FROM gg), rg AS (SELECT *, ['stable', 'elevated', 'unstable'][greatest(a, b) + 1] AS regime_flag, [1.0::DOUBLE, 0.7, 0.35][greatest(a, b) + 1] AS scale FROM fl),
sc AS (SELECT *, mean_gap + 0.15 * skew_gap AS score, coalesce(tanh(abs(mean_gap + 0.15 * skew_gap)), 0) * scale AS conviction FROM rg),
dc AS (SELECT *, CASE WHEN score IS NULL THEN 'no-trade' WHEN abs(score) < 0.35 THEN 'no-trade' WHEN conviction < 0.30 THEN 'no-trade' WHEN score > 0 THEN 'long' ELSE 'short' END AS decision FROM sc)"""


def model_days(t: Tables):
    """Moments per session made from prices, so that every rule of the ladder is met somewhere."""
    c = F.col("close")
    return t.stocks().select("symbol", "ts", (F.when(F.dayofmonth("ts") == 15, 63.0).otherwise(21.0) / 252).alias("years"), (c / 100 - 1).alias("mean"), (0.0012 * c / 100).alias("variance"), ((c - 100) / 50).alias("skew"),
                             F.lit(0.002).alias("mean_return"), F.lit(0.0010).alias("variance_return"), F.lit(-0.3).alias("skew_return"), ((F.col("volume") - 25) / 10).alias("tda_z"), ((c - 98) / 100).alias("hurst_drop"))


@query("sca09_moment_gaps", f"{STOCK}, {_GP} SELECT symbol, ts, round(mean_gap, 6) AS mean_gap, round(variance_gap, 6) AS variance_gap, round(skew_gap, 6) AS skew_gap FROM gg")
def _(t: Tables):
    return rounded(dv.moment_gaps(model_days(t), 21).select("symbol", "ts", *dv.GAPS))


@query("sca10_regime_flags", f"{STOCK}, {_GP} SELECT symbol, ts, regime_flag, scale FROM rg")
def _(t: Tables):
    return dv.regime_flags(model_days(t)).select("symbol", "ts", "regime_flag", "scale")


def decided(t: Tables):
    d = dv.moment_gaps(model_days(t), 21).withColumns({"baseline_ready": F.lit(True), **{f"base_{g}": F.lit(0.0) for g in dv.GAPS}})
    return dv.decide(dv.regime_flags(d))


@query("sca11_decisions", f"{STOCK}, {_GP} SELECT symbol, ts, round(score, 6) AS score, round(conviction, 6) AS conviction, decision FROM dc")
def _(t: Tables):
    return rounded(decided(t).select("symbol", "ts", "score", "conviction", "decision"))


@query("sca12_sorted_quantiles", f"{STOCK}, q AS (SELECT symbol, ts, list_sort([open, high, low, close]) AS q FROM stocks) SELECT symbol, ts, q[1] AS q1, q[2] AS q2, q[3] AS q3, q[4] AS q4 FROM q")
def _(t: Tables):
    q = t.stocks().select("symbol", "ts", F.array_sort(F.array("open", "high", "low", "close")).alias("q"))
    return q.select("symbol", "ts", *[F.col("q")[i].alias(f"q{i + 1}") for i in range(4)])


@query("sca13_sample_labels", f"{STOCK}, g AS (SELECT symbol, date_trunc('month', ts) AS m, count(*) AS n, (arg_max(close, ts) / arg_min(close, ts) - 1) * 100 AS r FROM stocks GROUP BY 1, 2) SELECT symbol, CAST(m AS DATE) AS month, n, CASE WHEN n >= 100 THEN 'high' WHEN n >= 30 THEN 'moderate' WHEN n >= 10 THEN 'low' ELSE 'none' END AS confidence, CASE WHEN abs(r) < 0.005 THEN 'flat' WHEN r > 0 THEN 'up' ELSE 'down' END AS direction FROM g")
def _(t: Tables):
    g = t.stocks().groupBy("symbol", F.trunc("ts", "month").alias("month")).agg(F.count("*").alias("n"), ((F.max_by("close", "ts") / F.min_by("close", "ts") - 1) * 100).alias("r"))
    return g.select("symbol", "month", "n", ev.confidence(F.col("n")).alias("confidence"), F.when(F.abs("r") < 0.005, "flat").when(F.col("r") > 0, "up").otherwise("down").alias("direction"))


@query("agg23_regime_breakdown", f"{STOCK}, {_GP}, f(regime_flag) AS (VALUES ('stable'), ('elevated'), ('unstable')), g AS (SELECT regime_flag, count(*) AS days, count(*) FILTER (decision IN ('long', 'short')) AS trades, avg(conviction) AS mc, stddev_samp(score) AS sd, max(abs(score)) AS mx FROM dc GROUP BY 1) SELECT f.regime_flag, coalesce(days, 0) AS days, coalesce(trades, 0) AS trades, round(mc, 6) AS mean_conviction, round(sd, 6) AS score_sd, round(mx, 6) AS max_abs_score FROM f LEFT JOIN g USING (regime_flag)")
def _(t: Tables):
    return rounded(dv.regime_breakdown(decided(t)))


@query("sca20_move_texts", f"{STOCK}, {cv.OBSERVATION_SQL.format(src='stocks')} SELECT symbol, ts, symbol || CASE WHEN abs(return_pct) < 0.005 THEN ' was flat ' WHEN return_pct > 0 THEN ' rose ' ELSE ' fell ' END || printf('%.1f', round(abs(round(return_pct, 6)), 1)) || '%' AS sentence FROM observations")
def _(t: Tables):
    o = win.move_observation(t.stocks())
    word = F.when(F.abs("return_pct") < 0.005, " was flat ").when(F.col("return_pct") > 0, " rose ").otherwise(" fell ")
    return o.select("symbol", "ts", F.concat("symbol", word, F.format_string("%.1f", F.round(F.abs(F.round("return_pct", 6)), 1)), F.lit("%")).alias("sentence"))


_TREND_COLS = ["current", "return_1m_pct", "return_3m_pct", "return_1y_pct", "annualized_vol_pct", "high_52w", "low_52w", "drawdown_pct"]


@query("sca21_flattened_numbers", f"{STOCK}, {cv.TREND_SQL}, u AS (" + " UNION ALL ".join(f"SELECT symbol, 'trend.{c}' AS path, {c} AS value FROM trend" for c in _TREND_COLS) + ") SELECT symbol, path, round(value, 6) AS value FROM u WHERE value IS NOT NULL")
def _(t: Tables):
    tr = ev.price_trend(t.stocks())
    u = tr.unpivot(["symbol"], _TREND_COLS, "path", "value").filter("value IS NOT NULL")
    return rounded(u.withColumn("path", F.concat(F.lit("trend."), "path")))


@query("q2_attribution", f"WITH {cv.COUNTER_SQL}, c AS (SELECT symbol, string_agg(item, ';' ORDER BY item) AS counter_items FROM (SELECT DISTINCT symbol, item FROM counter) GROUP BY 1), b AS (SELECT symbol, factor_id, round(hit_rate, 8) AS hit_rate, sample_size, confidence FROM ranked WHERE rank = 1) SELECT b.symbol, factor_id, hit_rate, sample_size, confidence, counter_items FROM b LEFT JOIN c USING (symbol)")
def _(t: Tables):
    """Every symbol's leading factor with what argues against it."""
    s = checkpointed(cv.scored(t).withColumn("rank_score", F.round("rank_score", 9)).withColumn("lift", F.round("lift", 9)))
    best = ev.rank_factors(s).filter("rank = 1").select("symbol", "factor_id", "hit_rate", "sample_size", "confidence")
    items = ev.counter_evidence(cv.last_observation(t), s).groupBy("symbol").agg(F.array_join(F.sort_array(F.collect_set("item")), ";").alias("counter_items"))
    return rounded(best.join(items, "symbol", "left"), 8)


MARKET = "AF"  # the index that every symbol is part of


def bundles(t: Tables):
    """One nested record for each symbol; the premise held against its last move is that it goes on as the session before."""
    s = checkpointed(cv.scored(t).withColumn("rank_score", F.round("rank_score", 9)).withColumn("lift", F.round("lift", 9)))
    o = win.move_observation(t.stocks()).withColumn("before", F.lag("return_pct").over(win.by_symbol()))
    last = F.max_by(F.struct("ts", "return_pct", "sigma_multiple", "volume_ratio", "outlier", "before"), "ts")
    o = checkpointed(o.groupBy("symbol").agg(last.alias("r")).select("symbol", F.col("r.ts").alias("session"), "r.return_pct", "r.sigma_multiple", "r.volume_ratio", "r.outlier", "r.before"))
    counter = rc.counter_items(o, s, o.select("symbol", F.signum("before").alias("direction")))
    ranked = rc.with_relation(ev.rank_factors(s), [MARKET]).select("symbol", "rank", "factor_id", "relation", "hit_rate", "base_rate", "lift", "sample_size", "confidence", "beats_base_rate")
    r = checkpointed(cv.returns_pct(t.bars()))
    market = ev.market_model(cv.stock_targets(t), r.filter(F.col("symbol") == MARKET).drop("symbol"))
    breadth = ev.sector_breadth(t.bars().select("symbol", "ts", win.pct_return("close").alias("ret")), cv.PANEL)
    parts = ev.index_contributions(r, cv.WEIGHTS, r.filter(F.col("symbol") == MARKET)).withColumnRenamed("symbol", "constituent")
    return checkpointed(rc.attribution_bundle(o.drop("before"), ranked, counter, market, breadth, parts))


BUNDLE_SQL = f"""{cv.COUNTER_SQL}, ob AS (SELECT *, lag(return_pct) OVER {W} AS before, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM observations), lob AS (SELECT * FROM ob WHERE back = 1),
items AS (SELECT symbol, item FROM counter UNION ALL SELECT symbol, 'wrong_premise' FROM lob WHERE sign(before) <> sign(return_pct)),
mm AS (SELECT ts, round((close / lag(close) OVER (ORDER BY ts) - 1) * 100, 6) AS market FROM bars WHERE symbol = 'AF'), mj AS (SELECT tg.*, market, max(ts) OVER (PARTITION BY symbol) AS session FROM tg LEFT JOIN mm USING (ts)),
mg AS (SELECT symbol, count(*) FILTER (ts < session AND market IS NOT NULL) AS sessions, covar_samp(target, market) FILTER (ts < session) AS cov, var_samp(market) FILTER (ts < session) AS v, arg_max(target, ts) AS move_pct, arg_max(market, ts) FILTER (market IS NOT NULL) AS market_pct FROM mj GROUP BY 1),
mk AS (SELECT *, CASE WHEN sessions >= 250 AND v > 1e-12 THEN cov / v END AS beta FROM mg),
ir AS (SELECT * FROM (SELECT symbol, ts, close / lag(close) OVER {W} - 1 AS ret FROM bars) WHERE ret IS NOT NULL), br AS (SELECT ts, count(*) FILTER (ret > 0) / 6.0::DOUBLE * 100 AS rising_pct, count(*) FILTER (ret < 0) / 6.0::DOUBLE * 100 AS falling_pct, count(*) AS present FROM ir GROUP BY ts),
w(symbol, weight) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in cv.WEIGHTS.items())}),
co AS (SELECT c.*, CASE WHEN abs(i.ret) > 1e-9 THEN abs(contribution / i.ret) * 100 END AS share_pct FROM (SELECT ts, symbol, round(ret * 100, 6) AS ret, weight * round(ret * 100, 6) AS contribution, row_number() OVER (PARTITION BY ts ORDER BY abs(weight * round(ret * 100, 6)) DESC, symbol) AS rank FROM ir JOIN w USING (symbol)) c
  JOIN (SELECT ts, round(ret * 100, 6) AS ret FROM ir WHERE symbol = 'AF') i USING (ts) WHERE rank <= 2),
fx2 AS (SELECT symbol, string_agg(factor_id, ';' ORDER BY rank) FILTER (factor_id <> 'AF') AS external, string_agg(factor_id, ';' ORDER BY rank) FILTER (factor_id = 'AF') AS mechanical, string_agg(factor_id, ';' ORDER BY rank) FILTER (factor_id <> 'AF' AND beats_base_rate) AS supported, count(*) AS n FROM ranked GROUP BY 1)"""


@query("q2_attribution_bundle", f"""WITH {BUNDLE_SQL}, it AS (SELECT symbol, string_agg(item, ';' ORDER BY item) AS counter_items FROM items GROUP BY 1), cn AS (SELECT ts, string_agg(symbol, ';' ORDER BY rank) AS constituents FROM co GROUP BY 1)
SELECT l.symbol, l.ts AS session, round(return_pct, 6) AS return_pct, round(beta, 6) AS beta, round(move_pct - beta * market_pct, 6) AS specific_pct, round(rising_pct, 6) AS rising_pct, coalesce(constituents, '') AS constituents,
  coalesce(external, '') AS external, coalesce(mechanical, '') AS mechanical, coalesce(supported, '') AS supported, coalesce(counter_items, '') AS counter_items
FROM lob l LEFT JOIN mk USING (symbol) LEFT JOIN br ON br.ts = l.ts LEFT JOIN cn ON cn.ts = l.ts LEFT JOIN fx2 f ON f.symbol = l.symbol LEFT JOIN it ON it.symbol = l.symbol""")
def _(t: Tables):
    """Why every symbol moved: the whole record, here with its lists as text."""
    b = bundles(t)
    text = lambda c: F.array_join(c, ";").alias(c)
    names = F.array_join(F.transform("contributions", lambda c: c["constituent"]), ";").alias("constituents")
    items = F.array_join(F.transform("counterevidence", lambda c: c["item"]), ";").alias("counter_items")
    return rounded(b.select("symbol", "session", "observation.return_pct", "market.beta", "market.specific_pct", "breadth.rising_pct", names, text("external"), text("mechanical"), text("supported"), items))


_MARKET_COLS = {"sessions": "sessions", "move_pct": "move_pct", "market_pct": "market_pct", "beta": "beta", "explained_pct": "beta * market_pct", "specific_pct": "move_pct - beta * market_pct", "explained_share_pct": "CASE WHEN abs(move_pct) > 1e-9 THEN abs(beta * market_pct / move_pct) * 100 END"}
_FACTS_SQL = " UNION ALL ".join(
    [f"SELECT symbol, 'observation.{c}' AS path, CAST({c} AS DOUBLE) AS value FROM lob" for c in ("return_pct", "sigma_multiple", "volume_ratio")]
    + [f"SELECT l.symbol, 'market.{c}', CAST({e} AS DOUBLE) FROM lob l JOIN mk USING (symbol)" for c, e in _MARKET_COLS.items()]
    + [f"SELECT l.symbol, 'breadth.{c}', CAST({c} AS DOUBLE) FROM lob l JOIN br USING (ts)" for c in ("rising_pct", "falling_pct", "present")]
    + [f"SELECT l.symbol, 'contributions[' || (rank - 1) || '].{c}', CAST(co.{c} AS DOUBLE) FROM lob l JOIN co USING (ts)" for c in ("rank", "ret", "contribution", "share_pct")]
    + [f"SELECT l.symbol, 'factors[' || (rank - 1) || '].{c}', CAST({c} AS DOUBLE) FROM lob l JOIN ranked USING (symbol)" for c in ("rank", "hit_rate", "base_rate", "lift", "sample_size")]
)


@query("sca21_bundle_numbers", f"WITH {BUNDLE_SQL}, facts AS ({_FACTS_SQL}) SELECT symbol, path, round(value, 6) AS value FROM facts WHERE value IS NOT NULL")
def _(t: Tables):
    """Every figure of every bundle by its path, found by the schema."""
    return rounded(rc.flattened(bundles(t).drop("session"), ["symbol"]))


@query("q9_bundle_facts", f"""WITH {BUNDLE_SQL}, facts AS ({_FACTS_SQL}), g AS (SELECT symbol, path, value, CASE WHEN path LIKE 'factors%' THEN 'F' WHEN path LIKE 'market%' THEN 'S' WHEN path LIKE 'observation%' THEN 'M' ELSE 'N' END AS fact_group FROM facts WHERE value IS NOT NULL)
SELECT symbol, fact_group || row_number() OVER (PARTITION BY symbol, fact_group ORDER BY path) AS id, fact_group, path, round(value, 6) AS value FROM g""")
def _(t: Tables):
    """Every figure of every bundle with an id that a text can cite, numbered by group and path."""
    n = rc.flattened(bundles(t).drop("session"), ["symbol"])
    group = F.when(F.col("path").startswith("factors"), "F").when(F.col("path").startswith("market"), "S").when(F.col("path").startswith("observation"), "M").otherwise("N")
    n = n.withColumn("fact_group", group)
    place = F.row_number().over(Window.partitionBy("symbol", "fact_group").orderBy("path"))
    return rounded(n.select("symbol", F.concat("fact_group", place.cast("string")).alias("id"), "fact_group", "path", "value"))


_SNAP = f"{cv.FLAGS_SQL}, fs AS (SELECT symbol, string_agg(flag, ';' ORDER BY flag) AS flags FROM flags GROUP BY 1)"


@query("q3_company_snapshot", f"WITH {_SNAP} SELECT symbol, CAST(sector AS BIGINT) AS sector, profit_margin, trailing_pe, round(pe_vs_median_pct, 4) AS pe_vs_median_pct, round(return_1y_pct, 6) AS return_1y_pct, round(annualized_vol_pct, 6) AS annualized_vol_pct, flags FROM base LEFT JOIN fs USING (symbol)")
def _(t: Tables):
    b = cv.flag_base(t)
    flags = ev.snapshot_flags(b).groupBy("symbol").agg(F.array_join(F.sort_array(F.collect_set("flag")), ";").alias("flags"))
    j = b.join(flags, "symbol", "left").select("symbol", "sector", "profit_margin", "trailing_pe", "pe_vs_median_pct", "return_1y_pct", "annualized_vol_pct", "flags")
    return longs(rounded(j, 6, pe_vs_median_pct=4))


@query("q5_native_diagnostics", f"{STOCK}, {REGIME_SQL}, {HALF_SQL} SELECT h.symbol, round(hurst, 6) AS hurst, classification, round(z_score, 5) AS z_score, round(ar_coefficient, 6) AS ar_coefficient FROM half h LEFT JOIN regime r ON h.symbol = r.symbol")
def _(t: Tables):
    s = t.stocks()
    j = dg.half_life(s).join(dg.regime(s), "symbol", "left")
    return rounded(j.select("symbol", "hurst", "classification", "z_score", "ar_coefficient"), 6, z_score=5)


@query("q5_quant_diagnostics")
def _(t: Tables):
    """Volatility, regime and mean reversion of every symbol; a missing model leaves its columns unknown."""
    s = t.stocks()
    j = ce.volatility_summary(t).join(dg.regime(s).select("symbol", "hurst", "variance_ratio", "classification"), "symbol", "full").join(dg.half_life(s).select("symbol", "z_score", "half_life_days"), "symbol", "full").join(es.unit_root(s), "symbol", "left")
    j = j.withColumn("half_life_days", F.when(F.col("adf_pvalue") < 0.05, F.col("half_life_days")))
    return rounded(j.select("symbol", "close_to_close_pct", "yang_zhang_pct", "ewma_pct", "forecast_pct", "persistence", "regime", "hurst", "variance_ratio", "classification", "z_score", "half_life_days", "adf_pvalue"), 4)


@query("q6_feature_table", f"{FEAT}, s AS (SELECT *, ln(lead(close, 6) OVER {W} / close) AS f, {SIGNAL} FROM features) SELECT symbol, ts, close, signal, " + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES) + " FROM s WHERE f IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES))
def _(t: Tables):
    d = labelled(t).withColumn("f", win.forward_log("close", 6))
    return longs(rounded(drop_unknown(d, [*FEATURES, "f"]).select("symbol", "ts", "close", "signal", *FEATURES)))


@query("q9_fact_table", f"""WITH {_SNAP}, v AS (SELECT symbol, 'V' AS grp, 1 AS o, 'Profit margin: ' || printf('%.1f', round(profit_margin * 100, 1)) || '%' AS text, 'fundamentals.profit_margin' AS path FROM base UNION ALL SELECT symbol, 'V', 2, coalesce('Price-to-earnings ratio: ' || printf('%.2f', round(trailing_pe, 2)), 'Price-to-earnings ratio: not available'), 'fundamentals.trailing_pe' FROM base
  UNION ALL SELECT symbol, 'M', 1, 'Price change over 1 year: ' || coalesce(printf('%.1f', round(return_1y_pct, 1)) || '%', 'not available'), 'trend.return_1y_pct' FROM base UNION ALL SELECT symbol, 'C', row_number() OVER (PARTITION BY symbol ORDER BY flag), flag, 'counterevidence.' || flag FROM flags)
SELECT symbol, grp || row_number() OVER (PARTITION BY symbol, grp ORDER BY o) AS id, grp AS fact_group, text, path FROM v""")
def _(t: Tables):
    """Every citable figure with an id per group; a reader's slice is a filter on the group."""
    b = cv.flag_base(t)
    num = lambda c, d, tail="": F.concat(printed(c, d), F.lit(tail))
    rows = [
        b.select("symbol", F.lit("V").alias("fact_group"), F.lit("1").alias("o"), F.concat(F.lit("Profit margin: "), num(F.col("profit_margin") * 100, 1, "%")).alias("text"), F.lit("fundamentals.profit_margin").alias("path")),
        b.select("symbol", F.lit("V"), F.lit("2"), F.coalesce(F.concat(F.lit("Price-to-earnings ratio: "), F.when(F.col("trailing_pe").isNotNull(), num(F.col("trailing_pe"), 2))), F.lit("Price-to-earnings ratio: not available")), F.lit("fundamentals.trailing_pe")),
        b.select("symbol", F.lit("M"), F.lit("1"), F.concat(F.lit("Price change over 1 year: "), F.coalesce(F.when(F.col("return_1y_pct").isNotNull(), num(F.col("return_1y_pct"), 1, "%")), F.lit("not available"))), F.lit("trend.return_1y_pct")),
    ]
    flags = ev.snapshot_flags(b).select("symbol", F.lit("C"), "flag", F.col("flag").alias("t"), F.concat(F.lit("counterevidence."), "flag"))
    u = reduce(DataFrame.union, [*rows, flags])
    n = F.row_number().over(Window.partitionBy("symbol", "fact_group").orderBy("o"))
    return u.select("symbol", F.concat("fact_group", n.cast("string")).alias("id"), "fact_group", "text", "path")


@query("q1_divergence_table")
def _(t: Tables):
    """Per session: macro forecast, implied view, regime readings, gaps against their baseline, decision."""
    f = checkpointed(ce.forecasts(t).select("ts", "mean", "variance", "skew", "n_train", F.col("quantiles")[0].alias("q05"), F.col("quantiles")[3].alias("q50"), F.col("quantiles")[6].alias("q95")))
    view = es.implied_view(usable_quotes(ce.day_chains(t)), "symbol").select(F.to_date("symbol").alias("ts"), "spot", "years", "mean_return", "variance_return", "skew_return", "atm_vol", "forward_error", "n_quotes")
    p, cols = ce.return_panel(t)
    tda = es.topology_signal(es.window_topology(p, cols, window=30)).select("ts", "tda_l1", "tda_z")
    rough = dg.rolling_rough_vol(dg.realized_vol(t.bars().filter("symbol = 'AF'"))).select("ts", F.col("rv").alias("realized_vol"), "hurst", "hurst_baseline", "hurst_drop")
    d = f.join(view, "ts", "left").join(tda, "ts", "left").join(rough, "ts", "left").withColumn("symbol", F.lit("AF"))
    d = checkpointed(d)
    d = dv.decide(dv.regime_flags(dv.premium_baseline(dv.moment_gaps(d, 21)), 0.03, 0.06))
    errors = F.array_compact(F.array(F.when(F.col("spot").isNull(), F.lit("quant_model")), F.when(F.col("tda_l1").isNull(), F.lit("tda")), F.when(F.col("hurst").isNull(), F.lit("rough_vol"))))
    return rounded(longs(d.withColumn("failed_modules", F.array_join(errors, ";"))), 4)
