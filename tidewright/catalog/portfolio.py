"""Ledger, overlay and plan queries."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.catalog.backtests import scan_sql, signal_inputs
from tidewright.catalog.registry import query, rounded
from tidewright.catalog.windows import INDEX, W, rows
from tidewright.operators import portfolio as pf
from tidewright.streaming.state import order_ledger, replayed
from tidewright.tables import Tables


def orders(t: Tables):
    """Events as orders: mostly opens, 'signup' closes and 'error' expires the oldest line."""
    e, v = t.raw("events"), F.col("value")
    kind = F.col("event_type")
    return e.select(
        F.col("user_id").alias("account"), F.col("event_id").alias("seq"), F.when(kind == "signup", "close").when(kind == "error", "expire").otherwise("open").alias("action"),
        F.when(kind == "view", "sell").otherwise("buy").alias("side"), (1 + F.floor(v) % 5).alias("contracts"), (v / 20 + 0.05).alias("fill_price"),
        (80 + F.col("event_id") % 40).cast("double").alias("spot"), (80 + F.col("user_id") % 40).cast("double").alias("strike"), F.when(F.col("event_id") % 2 == 0, "call").otherwise("put").alias("kind"))


# Each order is one step of its account's recursion; a line is found by its contract, oldest first.
LEDGER_SQL = """WITH RECURSIVE e AS (SELECT user_id AS account, event_id AS seq, CASE event_type WHEN 'signup' THEN 'close' WHEN 'error' THEN 'expire' ELSE 'open' END AS action, event_type = 'view' AS sell, 1 + CAST(floor(value) AS BIGINT) % 5 AS size,
  value / 20 + 0.05 AS fill, CAST(80 + event_id % 40 AS DOUBLE) AS spot, CAST(80 + user_id % 40 AS DOUBLE) AS strike, CASE WHEN event_id % 2 = 0 THEN 'call' ELSE 'put' END AS kind FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY seq) AS k, CASE WHEN sell THEN 1 ELSE -1 END * fill * size * 100 AS premium, 0.65 * size AS fee, greatest(CASE WHEN kind = 'call' THEN spot - strike ELSE strike - spot END, 0) AS worth,
  CASE WHEN NOT sell THEN 0 WHEN kind = 'put' THEN strike * size * 100 ELSE greatest(0.2 * spot - greatest(strike - spot, 0) + fill, 0.1 * spot + fill, 0) * size * 100 END AS need,
  CASE WHEN action <> 'expire' AND NOT coalesce(fill > 0, false) THEN 'refused' WHEN action = 'open' AND NOT coalesce(size > 0, false) THEN 'refused' WHEN action = 'close' AND size < 0 THEN 'refused' ELSE '' END AS early FROM e),
st(account, k, seq, action, status, cash, realized, collateral, lines) AS (
  SELECT DISTINCT account, 0::BIGINT, NULL::BIGINT, '', '', 100000::DOUBLE, 0::DOUBLE, 0::DOUBLE, []::STRUCT(kind VARCHAR, strike DOUBLE, n DOUBLE, price DOUBLE, held DOUBLE)[] FROM o
  UNION ALL SELECT account, k, seq, action, status, CAST(CASE WHEN status <> 'done' THEN cash WHEN action = 'open' THEN cash + premium - fee ELSE cash + price * amount * 100 * sign(line.n) - cost END AS DOUBLE),
    CAST(CASE WHEN status <> 'done' THEN realized WHEN action = 'open' THEN realized - fee ELSE realized + (price - line.price) * amount * 100 * sign(line.n) - cost END AS DOUBLE),
    CAST(CASE WHEN status <> 'done' THEN collateral WHEN action = 'open' THEN collateral + need WHEN amount = abs(line.n) AND len(lines) = 1 THEN 0 ELSE collateral - line.held * amount / abs(line.n) END AS DOUBLE),
    CASE WHEN status <> 'done' THEN lines WHEN action = 'open' THEN list_append(lines, {'kind': kind, 'strike': strike, 'n': CAST(CASE WHEN sell THEN -size ELSE size END AS DOUBLE), 'price': CAST(fill AS DOUBLE), 'held': CAST(need AS DOUBLE)})
      WHEN amount = abs(line.n) THEN list_concat(lines[:i - 1], lines[i + 1:])
      ELSE list_concat(list_append(lines[:i - 1], {'kind': line.kind, 'strike': line.strike, 'n': line.n - sign(line.n) * amount, 'price': line.price, 'held': line.held - line.held * amount / abs(line.n)}), lines[i + 1:]) END
  FROM (SELECT *, CASE WHEN early <> '' THEN early WHEN action = 'open' THEN CASE WHEN need - (premium - fee) > cash - collateral + 1e-9 THEN 'refused' ELSE 'done' END WHEN line IS NULL THEN 'nothing open' WHEN amount > abs(line.n) THEN 'refused' ELSE 'done' END AS status
    FROM (SELECT *, CASE WHEN action = 'expire' OR size = 0 THEN abs(line.n) ELSE CAST(size AS DOUBLE) END AS amount, CASE WHEN action = 'expire' THEN worth ELSE fill END AS price, CASE WHEN action = 'expire' THEN 0 ELSE 0.65 * amount END AS cost
      FROM (SELECT o.*, cash, realized, collateral, lines, coalesce(list_position(list_transform(lines, lambda x: x.kind = o.kind AND x.strike = o.strike), true), 0) AS i, CASE WHEN i > 0 THEN lines[i] END AS line FROM st JOIN o ON o.account = st.account AND o.k = st.k + 1))))
SELECT account, seq, action, status, round(cash, 4) AS cash, round(realized, 4) AS realized, round(collateral, 4) AS collateral, CAST(len(lines) AS BIGINT) AS open_positions FROM st WHERE k > 0"""


@query("bt11_order_ledger", LEDGER_SQL)
def _(t: Tables):
    return rounded(pf.ledger(orders(t)), 4)


@query("bt11_stored_ledger", LEDGER_SQL)
def _(t: Tables):
    """The ledger as a stream in two runs: the second one finds the accounts as the first one left them."""
    o = orders(t)
    half = o.agg(((F.min("seq") + F.max("seq")) / 2).cast("long")).first()[0]
    late = F.coalesce(F.col("seq") > half, F.lit(False))
    return rounded(replayed([o.filter(~late), o.filter(late)], order_ledger), 4)


@query("bt09_option_overlays")
def _(t: Tables):
    b = t.bars()
    return rounded(reduce(DataFrame.unionByName, [pf.option_overlay(b, o[0]) for o in pf.OVERLAYS]), 4)


_STAGED = f"""{INDEX}, c AS (SELECT symbol, count(*) AS n FROM bars GROUP BY 1), st AS (SELECT symbol, unnest(range(0, CAST(ceil((n - 65) / 12.0) AS BIGINT))) AS run_id FROM c WHERE n > 65), p AS (SELECT symbol, ts, open, close, row_number() OVER {W} - 1 AS pos FROM bars),
sig AS (SELECT p.symbol, run_id, ts, open, close, least(1, (floor((pos - run_id * 12) / 12) + 1) / 4)::DOUBLE AS signal, 1 AS warmup FROM p JOIN st ON p.symbol = st.symbol AND pos BETWEEN run_id * 12 AND run_id * 12 + 64), {scan_sql("sig", "symbol, run_id")},
sr AS (SELECT symbol, run_id, arg_max(equity, ts) AS staged, arg_max(benchmark, ts) AS lump FROM result GROUP BY 1, 2)"""


@query("bt07_staged_entries", f"{_STAGED} SELECT symbol, run_id, round(staged, 4) AS staged, round(lump, 4) AS lump FROM sr")
def _(t: Tables):
    return rounded(pf.staged_runs(t.bars(), 63, 10_000.0), 4)


@query("agg38_staged_comparison", f"""{_STAGED} SELECT symbol, count(*) AS starts, round(avg(CAST(staged > lump AS INT)) * 100, 4) AS staged_beat_share_pct, round(quantile_cont(staged, 0.5), 4) AS staged_median, round(quantile_cont(lump, 0.5), 4) AS lump_median, round(min(staged), 4) AS staged_worst, round(min(lump), 4) AS lump_worst,
round(quantile_cont(staged - 10000, 0.1), 4) AS gain_p10, round(quantile_cont(staged - 10000, 0.5), 4) AS gain_median, round(quantile_cont(staged - 10000, 0.9), 4) AS gain_p90 FROM sr GROUP BY 1""")
def _(t: Tables):
    return rounded(pf.staged_comparison(pf.staged_runs(t.bars(), 63, 10_000.0), 10_000.0), 4)


@query("bt12_plans")
def _(t: Tables):
    names = F.array(*[F.lit(s) for s in ("AF", "AO", "NF", "NO", "RF", "RO")])
    r = t.raw("orders").select(F.col("o_orderkey").alias("request_id"), names[(F.col("o_custkey") % 6).cast("int")].alias("symbol"), F.col("o_totalprice").alias("amount"), (F.col("o_totalprice") / 20).alias("max_loss"))
    return rounded(pf.plans(t.bars(), r, 63, 5.0), 2)


@query("bt03_regime_filtered_trend", f"""{INDEX}, x0 AS (SELECT * FROM bars), {signal_inputs("regime-trend", "x0", "symbol")[:-2]} SELECT symbol, ts, round(hurst, 6) AS hurst,
CAST(CASE WHEN b >= 401 THEN CASE WHEN hurst < 0.5 THEN 0 ELSE CAST(avg(close) OVER {rows(19)} > avg(close) OVER {rows(99)} AS INT) END END AS DOUBLE) AS signal FROM x0_v""")
def _(t: Tables):
    from tidewright.operators.diagnostics import regime_trend_signal

    s = regime_trend_signal(t.bars(), 20, 100, 0.5)
    return rounded(s.select("symbol", "ts", "hurst", "signal"))
