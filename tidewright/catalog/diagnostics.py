"""Diagnostic queries."""

import math

from tidewright.catalog.registry import query, rounded
from tidewright.catalog.windows import INDEX, STOCK, W, rows
from tidewright.operators import diagnostics as dg
from tidewright.tables import Tables

_LR = f"r AS (SELECT *, ln(close / lag(close) OVER {W}) AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS b FROM stocks)"


@query("agg31_close_to_close_vol", f"{STOCK}, {_LR} SELECT symbol, round(CASE WHEN count(r) >= 3 THEN stddev_samp(r) * sqrt(252) * 100 END, 6) AS close_to_close_pct FROM r WHERE b <= 21 GROUP BY 1")
def _(t: Tables):
    return rounded(dg.close_to_close_vol(t.stocks()))


@query("agg30_yang_zhang_vol", f"""{STOCK}, {_LR.replace('FROM stocks', ', ln(open / lag(close) OVER ' + W + ') AS o_n, ln(close / open) AS oc, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs, count(*) OVER (PARTITION BY symbol) AS cnt FROM stocks')},
g AS (SELECT symbol, count(o_n) AS n, var_samp(o_n) AS v1, var_samp(oc) AS v2, avg(rs) AS m FROM r WHERE b < least(22, cnt) GROUP BY 1), c AS (SELECT symbol, stddev_samp(r) * sqrt(252) * 100 AS cc FROM r WHERE b <= 21 GROUP BY 1),
x AS (SELECT symbol, n, v1 + 0.34 / (1.34 + (n + 1) / (n - 1)) * v2 + (1 - 0.34 / (1.34 + (n + 1) / (n - 1))) * m AS v FROM g)
SELECT symbol, round(CASE WHEN n + 1 >= 20 THEN CASE WHEN v > 0 THEN sqrt(v * 252) * 100 ELSE cc END END, 6) AS yang_zhang_pct FROM x JOIN c USING (symbol)""")
def _(t: Tables):
    return rounded(dg.yang_zhang_vol(t.stocks()))


_HURST_SQL = f"""rr AS (SELECT symbol, r, row_number() OVER {W} - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT symbol, ts, ln(close / lag(close) OVER {W}) AS r FROM stocks) WHERE r IS NOT NULL),
lg AS (SELECT DISTINCT symbol, n, unnest([CASE WHEN i = 0 THEN 8 WHEN i = 11 THEN n // 4 ELSE CAST(floor(8 * pow((n // 4) / 8, i / 11)) AS BIGINT) END for i in range(12)]) AS lag FROM (SELECT DISTINCT symbol, n FROM rr WHERE n >= 120)),
x AS (SELECT rr.symbol, lag, pos // lag AS chunk, pos, r, r - avg(r) OVER (PARTITION BY rr.symbol, lag, pos // lag) AS dev FROM rr JOIN lg ON rr.symbol = lg.symbol WHERE pos // lag < rr.n // lag AND rr.n // lag >= 2),
y AS (SELECT *, sum(dev) OVER (PARTITION BY symbol, lag, chunk ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum FROM x),
c AS (SELECT symbol, lag, chunk, max(cum) - min(cum) AS spread, stddev_samp(r) AS sd FROM y GROUP BY 1, 2, 3), m AS (SELECT symbol, lag, avg(spread / sd) AS rs FROM c WHERE sd > 1e-12 AND spread > 0 GROUP BY 1, 2),
pt AS (SELECT symbol, ln(lag) AS lx, ln(rs) - ln((lag - 0.5) / lag * pow(lag * pi() / 2, -0.5) * list_sum([sqrt((lag - i) / i) for i in range(1, lag)])) AS ly FROM m),
hurst AS (SELECT symbol, regr_slope(ly, lx) + 0.5 AS hurst, sqrt((1 - regr_r2(ly, lx)) * regr_syy(ly, lx) / regr_sxx(ly, lx) / (count(*) - 2)) AS hurst_se, regr_r2(ly, lx) AS hurst_r2 FROM pt GROUP BY 1 HAVING count(*) >= 4)"""
_VR_SQL = f"""vc AS (SELECT symbol, ts, r - avg(r) OVER (PARTITION BY symbol) AS c, row_number() OVER {W} AS pos FROM (SELECT symbol, ts, ln(close / lag(close) OVER {W}) AS r FROM stocks) WHERE r IS NOT NULL),
vg AS (SELECT symbol, c * c AS c2, CASE WHEN pos >= 5 THEN sum(c) OVER {rows(4)} END AS a, {", ".join(f"c * c * lag(c, {j}) OVER {W} * lag(c, {j}) OVER {W} AS p{j}" for j in range(1, 5))} FROM vc),
vs AS (SELECT symbol, count(*) AS n, sum(c2) AS s2, sum(a * a) AS sq, {" + ".join(f"power(2.0::DOUBLE * (5 - {j}) / 5, 2) * sum(p{j})" for j in range(1, 5))} AS tt FROM vg GROUP BY 1),
vr AS (SELECT symbol, n AS observations, (sq / (5 * (n - 4) * (1 - 5.0::DOUBLE / n))) / (s2 / (n - 1)) AS variance_ratio, tt / (s2 * s2 / n) AS theta FROM vs WHERE n >= 50),
vratio AS (SELECT symbol, observations, variance_ratio, CASE WHEN theta > 0 THEN (variance_ratio - 1) / sqrt(theta / observations) ELSE 0 END AS variance_ratio_z FROM vr)"""


def _why(bars, estimates):
    return f"CASE WHEN e.symbol IS NULL THEN 'no estimate from ' || s.n || ' sessions' END AS error FROM (SELECT symbol, count(*) AS n FROM {bars} GROUP BY 1) s LEFT JOIN {estimates} e USING (symbol)"


@query("agg33_rescaled_range_hurst", f"{STOCK}, {_HURST_SQL} SELECT symbol, round(hurst, 6) AS hurst, round(hurst_se, 6) AS hurst_se, round(hurst_r2, 6) AS hurst_r2, {_why("stocks", "hurst")}")
def _(t: Tables):
    s = t.stocks()
    return rounded(dg.with_reasons(s, dg.rescaled_range_hurst(s)))


@query("agg34_variance_ratio", f"{STOCK}, {_VR_SQL} SELECT symbol, round(variance_ratio, 6) AS variance_ratio, round(variance_ratio_z, 6) AS variance_ratio_z, observations FROM vratio")
def _(t: Tables):
    return rounded(dg.variance_ratio(t.stocks()))


REGIME_SQL = f"""{_HURST_SQL}, {_VR_SQL}, rg AS (SELECT symbol, hurst, hurst_se, variance_ratio, variance_ratio_z, CASE WHEN hurst > 0.5 + greatest(2 * hurst_se, 0.05) THEN 'trending' WHEN hurst < 0.5 - greatest(2 * hurst_se, 0.05) THEN 'mean-reverting' ELSE 'random walk' END AS a,
  CASE WHEN variance_ratio_z > 1.96 THEN 'trending' WHEN variance_ratio_z < -1.96 THEN 'mean-reverting' ELSE 'random walk' END AS b FROM hurst JOIN vratio USING (symbol)),
regime AS (SELECT *, CASE WHEN a = b THEN a WHEN 'random walk' IN (a, b) THEN 'random walk' ELSE 'unclear' END AS classification FROM rg)"""


@query("agg35_regime_classes", f"{STOCK}, {REGIME_SQL} SELECT symbol, round(hurst, 6) AS hurst, round(variance_ratio_z, 6) AS variance_ratio_z, classification FROM regime")
def _(t: Tables):
    return rounded(dg.regime(t.stocks()).select("symbol", "hurst", "variance_ratio_z", "classification"))


HALF_SQL = f"""hl AS (SELECT symbol, close, lag(close) OVER {W} AS prev, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS b FROM stocks),
hg AS (SELECT symbol, count(*) AS n, regr_slope(close, prev) AS b, regr_r2(close, prev) AS r2, regr_sxx(close, prev) AS sxx, regr_syy(close, prev) AS syy, regr_count(close, prev) AS m, avg(close) FILTER (b <= 63) AS mean, stddev_samp(close) FILTER (b <= 63) AS sd, max(close) FILTER (b = 1) AS current FROM hl GROUP BY 1),
half AS (SELECT symbol, (current - mean) / sd AS z_score, CASE WHEN b > 0 AND b < 1 THEN ln(2) / -ln(b) END AS half_life_days, b AS ar_coefficient, sqrt((1 - r2) * syy / sxx / (m - 2)) AS ar_standard_error, mean AS rolling_mean, sd AS rolling_std, n AS observations FROM hg WHERE n >= 73)"""


@query("agg36_half_life", f"{STOCK}, {HALF_SQL} SELECT symbol, round(z_score, 5) AS z_score, round(half_life_days, 3) AS half_life_days, round(ar_coefficient, 6) AS ar_coefficient, round(ar_standard_error, 6) AS ar_standard_error, round(rolling_mean, 5) AS rolling_mean, round(rolling_std, 6) AS rolling_std, observations, {_why("stocks", "half")}")
def _(t: Tables):
    s = t.stocks()
    return rounded(dg.with_reasons(s, dg.half_life(s)), 6, z_score=5, half_life_days=3, rolling_mean=5)


_RV = f"lr AS (SELECT symbol, ts, ln(close / lag(close) OVER {W}) AS r FROM bars), rv AS (SELECT symbol, ts, CASE WHEN count(r) OVER {rows(4)} = 5 THEN greatest(stddev_samp(r) OVER {rows(4)}, 0.0001) END AS rv FROM lr)"
_D = ", ".join(f"abs(x - lag(x, {lag}) OVER {W}) AS d_{lag}" for lag in dg.LAGS)


def _roll(lag, q):
    return f"CASE WHEN known = 250 AND avg(pow(d_{lag}, {q})) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {249 - lag} PRECEDING AND CURRENT ROW) > 0 THEN ln(avg(pow(d_{lag}, {q})) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {249 - lag} PRECEDING AND CURRENT ROW)) END"


def _scale_sql(src):
    x = [math.log(v) for v in dg.LAGS]
    mx = sum(x) / len(x)
    den = sum((v - mx) ** 2 for v in x)
    zeta = [" + ".join(f"({(xi - mx) / den!r}) * l_{i}_{lag}" for xi, lag in zip(x, dg.LAGS)) for i in range(5)]
    my = ["(" + " + ".join(f"l_{i}_{lag}" for lag in dg.LAGS) + f") / {len(x)}" for i in range(5)]
    kq = [math.log(2 ** (q / 2) * math.gamma((q + 1) / 2) / math.sqrt(math.pi)) for q in dg.MOMENTS]
    qq = sum(q * q for q in dg.MOMENTS)
    nu = " + ".join(f"((my_{i}) - zeta_{i} * {mx!r} - ({kq[i]!r})) / {q}" for i, q in enumerate(dg.MOMENTS))
    h = "(" + " + ".join(f"{q} * zeta_{i}" for i, q in enumerate(dg.MOMENTS)) + f") / {qq}"
    mz = "(" + " + ".join(f"zeta_{i}" for i in range(5)) + ") / 5"
    res = " + ".join(f"power(zeta_{i} - hurst * {q}, 2)" for i, q in enumerate(dg.MOMENTS))
    tot = " + ".join(f"power(zeta_{i} - mz, 2)" for i in range(5))
    return f"""sc AS (SELECT symbol, ts, rv, {", ".join(f"{z} AS zeta_{i}" for i, z in enumerate(zeta))}, {", ".join(f"{m} AS my_{i}" for i, m in enumerate(my))} FROM {src}),
sh AS (SELECT *, {h} AS hurst, exp(({nu}) / 5) AS nu, {mz} AS mz FROM sc), rough AS (SELECT symbol, ts, rv, hurst, nu, 1 - ({res}) / greatest({tot}, 1e-15) AS hurst_r2 FROM sh)"""


ROUGH_SQL = f"""{_RV}, lx AS (SELECT symbol, ts, rv, ln(rv) AS x FROM rv), dd AS (SELECT *, {_D}, count(x) OVER {rows(249)} AS known FROM lx),
ml AS (SELECT symbol, ts, rv, {", ".join(f"{_roll(lag, q)} AS l_{i}_{lag}" for lag in dg.LAGS for i, q in enumerate(dg.MOMENTS))} FROM dd), {_scale_sql('ml')},
rough_vol AS (SELECT *, CASE WHEN count(hurst) OVER f >= 40 THEN quantile_cont(hurst, 0.5) OVER f END AS hurst_baseline, CASE WHEN count(hurst) OVER f >= 40 THEN quantile_cont(hurst, 0.5) OVER f END - hurst AS hurst_drop FROM rough WINDOW f AS {rows(120, 1)})"""


@query("win17_rolling_rough_vol", f"{INDEX}, {ROUGH_SQL} SELECT symbol, ts, round(hurst, 7) AS hurst, round(nu, 7) AS nu, round(hurst_r2, 5) AS hurst_r2, round(hurst_baseline, 7) AS hurst_baseline, round(hurst_drop, 7) AS hurst_drop FROM rough_vol")
def _(t: Tables):
    return rounded(dg.rolling_rough_vol(dg.realized_vol(t.bars())).drop("rv"), 7, hurst_r2=5)


@query("agg37_point_rough_vol", f"""{INDEX}, {_RV}, lx AS (SELECT symbol, ts, rv, ln(rv) AS x FROM rv WHERE rv > 1e-8), dd AS (SELECT *, {_D} FROM lx),
ml AS (SELECT symbol, max(ts) AS ts, arg_max(rv, ts) AS rv, {", ".join(f"ln(avg(pow(d_{lag}, {q}))) AS l_{i}_{lag}" for lag in dg.LAGS for i, q in enumerate(dg.MOMENTS))} FROM dd GROUP BY 1 HAVING count(*) >= 144), {_scale_sql('ml')}
SELECT symbol, ts, round(rv, 8) AS rv, round(hurst, 7) AS hurst, round(nu, 7) AS nu, round(hurst_r2, 6) AS hurst_r2, {_why("bars", "rough")}""")
def _(t: Tables):
    b = t.bars()
    return rounded(dg.with_reasons(b, dg.point_rough_vol(dg.realized_vol(b))), 8, hurst=7, nu=7, hurst_r2=6)


@query("win18_rough_vol_forecast", f"""{INDEX}, {ROUGH_SQL}, hs AS (SELECT symbol, ts, rv, hurst, nu, list_reverse(list(ln(rv)) FILTER (rv IS NOT NULL) OVER {rows(249)}) AS hist FROM rough_vol),
kk AS (SELECT *, CASE WHEN hurst > 0 AND hurst < 0.5 THEN [CASE WHEN i = 0 THEN 1 / 21.5 / (0.5 - hurst) ELSE 1 / ((i + 0.5 + 21) * pow(i + 0.5, hurst + 0.5)) END for i in range(250)] END AS k FROM hs),
ff AS (SELECT symbol, ts, rv, CASE WHEN k IS NOT NULL THEN list_dot_product(k, hist) / list_sum(k) WHEN hurst IS NOT NULL THEN ln(rv) END AS e, CASE WHEN k IS NOT NULL THEN gamma(1.5 - hurst) / (gamma(hurst + 0.5) * gamma(2 - 2 * hurst)) * nu * nu * pow(21, 2 * hurst) WHEN hurst IS NOT NULL THEN 0 END AS v FROM kk WHERE hurst IS NOT NULL)
SELECT symbol, ts, round(exp(e + 0.5 * v), 7) AS rv_forecast, round(v, 7) AS forecast_variance, round(exp(e + 0.5 * v) / rv, 6) AS rv_forecast_ratio FROM ff""")
def _(t: Tables):
    f = dg.rfsv_forecast(dg.rolling_rough_vol(dg.realized_vol(t.bars()))).filter("hurst IS NOT NULL")
    return rounded(f.select("symbol", "ts", "rv_forecast", "forecast_variance", "rv_forecast_ratio"), 7, rv_forecast_ratio=6)
