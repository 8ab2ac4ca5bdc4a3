"""Back-test queries. The oracle walks the bars one by one; the library uses window expressions."""

from pyspark.sql import functions as F

from tidewright.catalog.aggregates import STAT_OUT, stats_sql
from tidewright.catalog.registry import query, rounded
from tidewright.catalog.windows import INDEX, STOCK, W, rows
from tidewright.operators import backtest as bt
from tidewright.tables import Tables


def scan_sql(src: str, keys: str, c: float = 0.0006, warm: str = "warmup") -> str:
    """Sequential fold with state (cash, units) over each run's bars; ``src`` has keys, ts, open, close, signal, warmup."""
    p = f"PARTITION BY {keys} ORDER BY ts"
    return f"""b0 AS (SELECT {keys}, ts, open, close, signal, {warm} AS wu, row_number() OVER ({p}) AS pos FROM {src}),
b1 AS (SELECT *, coalesce(last_value(CASE WHEN pos >= greatest(wu, 1) AND signal IS NOT NULL THEN least(greatest(signal, 0), 1) END IGNORE NULLS) OVER ({p} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM b0),
b2 AS (SELECT * FROM b1 WHERE pos > greatest(wu, 1)),
b3 AS (SELECT {keys}, list({{'ts': ts, 'o': open, 'c': close, 'e': e}} ORDER BY ts) AS l FROM b2 GROUP BY {keys}),
b4 AS (SELECT {keys}, list_reduce(l, lambda a, x: {{'cash': a.cash + a.units * x.o - x.e * (a.cash + a.units * x.o) - abs(x.e * (a.cash + a.units * x.o) / x.o - a.units) * x.o * {c},
    'units': x.e * (a.cash + a.units * x.o) / x.o, 'out': list_append(a.out, {{'ts': x.ts, 'e': x.e, 'eq': a.cash + a.units * x.o - x.e * (a.cash + a.units * x.o) - abs(x.e * (a.cash + a.units * x.o) / x.o - a.units) * x.o * {c} + x.e * (a.cash + a.units * x.o) / x.o * x.c,
    'cost': abs(x.e * (a.cash + a.units * x.o) / x.o - a.units) * x.o * {c}, 'bm': 10000 * (1 - {c}) / l[1].o * x.c}})}},
    {{'cash': CAST(10000 AS DOUBLE), 'units': CAST(0 AS DOUBLE), 'out': CAST([] AS STRUCT(ts DATE, e DOUBLE, eq DOUBLE, cost DOUBLE, bm DOUBLE)[])}}) AS r FROM b3),
b5 AS (SELECT {keys}, unnest(r.out) AS u FROM b4),
result AS (SELECT {keys}, u.ts AS ts, u.e AS exposure, u.eq AS equity, u.bm AS benchmark, u.cost AS cost FROM b5)"""


_MA = f"CASE WHEN count(close) OVER {rows(49)} < 50 THEN 0 WHEN avg(close) OVER {rows(9)} > avg(close) OVER {rows(49)} THEN 1 ELSE 0 END"
_MR = f"CASE WHEN stddev_samp(close) OVER {rows(20)} > 1e-9 THEN CASE WHEN (close - avg(close) OVER {rows(20)}) / stddev_samp(close) OVER {rows(20)} <= -1 THEN 1 WHEN (close - avg(close) OVER {rows(20)}) / stddev_samp(close) OVER {rows(20)} >= 0.5 THEN 0 ELSE (0.5 - (close - avg(close) OVER {rows(20)}) / stddev_samp(close) OVER {rows(20)}) / 1.5 END ELSE 0 END"
_SIG = f"""sig AS (SELECT symbol, 0::BIGINT AS run_id, ts, open, close, CAST(1 AS DOUBLE) AS signal, 1 AS warmup FROM stocks UNION ALL SELECT symbol, 1, ts, open, close, {_MA}, 51 FROM stocks UNION ALL SELECT symbol, 2, ts, open, close, {_MR}, 22 FROM stocks)"""


def three_runs(t: Tables):
    return bt.run_signals(t.stocks(), [("buy-and-hold", {}), ("ma-crossover", {"fast": 10, "slow": 50}), ("mean-reversion", {"window": 21, "entry_z": -1.0, "exit_z": 0.5})])


@query("bt04_backtest_equity", f"{STOCK}, {_SIG}, {scan_sql('sig', 'symbol, run_id')} SELECT symbol, run_id, ts, round(exposure, 6) AS exposure, round(equity, 5) AS equity, round(benchmark, 5) AS benchmark, round(cost, 6) AS cost FROM result")
def _(t: Tables):
    r = bt.run_backtest(three_runs(t))
    return rounded(r.drop("traded"), 6, equity=5, benchmark=5)


@query("bt04_run_summaries", f"{STOCK}, {_SIG}, {scan_sql('sig', 'symbol, run_id')}, {stats_sql('result', 'symbol, run_id')}, tot AS (SELECT symbol, run_id, sum(cost) AS total_costs FROM result GROUP BY 1, 2) SELECT symbol, run_id, {STAT_OUT}, round(total_costs, 4) AS total_costs FROM stats JOIN tot USING (symbol, run_id)")
def _(t: Tables):
    s = bt.run_summary(bt.run_backtest(three_runs(t)))
    return rounded(s.drop("benchmark_return_pct", "trades", "excess_return_pct"), 6, total_costs=4)


@query("bt01_simple_signals", f"""{STOCK}, d AS (SELECT symbol, ts, close, close - lag(close) OVER {W} AS d, row_number() OVER {W} AS pos FROM stocks), l AS (SELECT *, list(greatest(d, 0)) FILTER (d IS NOT NULL) OVER p AS g, list(greatest(-d, 0)) FILTER (d IS NOT NULL) OVER p AS s FROM d WINDOW p AS {rows('UNBOUNDED')}),
a AS (SELECT symbol, ts, close, CASE WHEN pos > 14 THEN list_reduce(list_concat([list_avg(g[1:14])], g[15:]), lambda a, x: (a * 13 + x) / 14) END AS ag, CASE WHEN pos > 14 THEN list_reduce(list_concat([list_avg(s[1:14])], s[15:]), lambda a, x: (a * 13 + x) / 14) END AS al FROM l),
r AS (SELECT *, CASE WHEN ag IS NULL THEN NULL WHEN al <= 1e-12 THEN CASE WHEN ag > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + ag / al) END AS rsi FROM a)
SELECT symbol, ts, CAST({_MA} AS DOUBLE) AS ma_signal, CAST(CASE WHEN rsi IS NULL THEN 0 WHEN rsi <= 30 THEN 1 WHEN rsi >= 70 THEN 0 ELSE 0.5 END AS DOUBLE) AS rsi_signal FROM r""")
def _(t: Tables):
    b = bt.with_inputs(t.stocks(), "rsi", [{"period": 14}])
    return b.select("symbol", "ts", bt.ma_crossover(10, 50)[0].alias("ma_signal"), bt.rsi_threshold(14, 30, 70)[0].alias("rsi_signal"))


_WTS = "[" + ", ".join(str(0.94**k) for k in range(39, -1, -1)) + "]::DOUBLE[]"


@query("bt02_quant_signals", f"""{STOCK}, r AS (SELECT *, ln(close / lag(close) OVER {W}) AS lr FROM stocks), l AS (SELECT *, list(lr * lr) FILTER (lr IS NOT NULL) OVER {rows(39)} AS sq FROM r),
v AS (SELECT *, CASE WHEN len(sq) = 40 THEN sqrt(list_dot_product(sq, {_WTS}) / list_sum({_WTS})) * sqrt(252) * 100 END AS vol FROM l)
SELECT symbol, ts, round(CASE WHEN vol > 1e-6 THEN least(10 / vol, 1) ELSE 0 END, 6) AS vol_signal, round({_MR}, 6) AS reversion_signal, CAST(CASE WHEN lag(close, 126) OVER {W} > 0 THEN CAST(lag(close, 21) OVER {W} > lag(close, 126) OVER {W} AS INT) ELSE 0 END AS DOUBLE) AS momentum_signal FROM v""")
def _(t: Tables):
    b = bt.with_inputs(t.stocks(), "vol-target", [])
    return rounded(b.select("symbol", "ts", bt.vol_target(10.0, 40)[0].alias("vol_signal"), bt.mean_reversion(21, -1.0, 0.5)[0].alias("reversion_signal"), bt.momentum(126, 21)[0].alias("momentum_signal")))


_GRID = [(10, 50), (20, 100), (50, 200), (5, 20)]
_GSIG = "sig AS (" + " UNION ALL ".join(
    f"SELECT symbol, {i}::BIGINT AS run_id, ts, open, close, row_number() OVER {W} AS bar, CAST(CASE WHEN count(close) OVER {rows(s - 1)} < {s} THEN 0 WHEN avg(close) OVER {rows(f - 1)} > avg(close) OVER {rows(s - 1)} THEN 1 ELSE 0 END AS DOUBLE) AS signal, {s + 1} AS warmup FROM bars"
    for i, (f, s) in enumerate(_GRID)) + ")"
FOLD_SQL = "fd AS (SELECT symbol, CAST(unnest(range((count(*) - 504) // 126)) AS BIGINT) AS fold FROM bars GROUP BY symbol HAVING count(*) >= 630), folds AS (SELECT symbol, fold, fold * 126 + 1 AS train_start, fold * 126 + 504 AS train_end, fold * 126 + 505 AS test_start, fold * 126 + 630 AS test_end FROM fd)"


def _named(sql: str, p: str) -> str:
    for n in ("b0", "b1", "b2", "b3", "b4", "b5"):
        sql = sql.replace(f"{n} AS", f"{p}{n} AS").replace(f"FROM {n}", f"FROM {p}{n}")
    return sql.replace("result AS", f"{p}result AS")


WALK_SQL = f"""{_GSIG}, {FOLD_SQL}, cut AS (SELECT s.symbol, f.fold, s.run_id, ts, open, close, signal, warmup FROM sig s JOIN folds f ON s.symbol = f.symbol AND s.bar BETWEEN train_start AND train_end WHERE 504 >= warmup + 2),
{_named(scan_sql('cut', 'symbol, fold, run_id'), 'tr_')}, {stats_sql('tr_result', 'symbol, fold, run_id', 'tr_')},
pick AS (SELECT symbol, fold, run_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol, fold ORDER BY round(sharpe, 9) DESC NULLS LAST, run_id) AS r FROM tr_stats) WHERE r = 1),
ev AS (SELECT s.symbol, f.fold, s.run_id, ts, open, close, signal, warmup FROM sig s JOIN pick p ON s.symbol = p.symbol AND s.run_id = p.run_id JOIN folds f ON f.symbol = p.symbol AND f.fold = p.fold AND s.bar BETWEEN greatest(test_start - greatest(warmup, 1), 1) AND test_end),
{_named(scan_sql('ev', 'symbol, fold, run_id'), 'te_')}"""


def walked(t: Tables):
    return bt.walk_forward(t.bars(), "ma-crossover")


@query("bt05_walk_forward", f"{INDEX}, {WALK_SQL} SELECT symbol, fold, run_id, count(*) AS bars, round(arg_max(equity, ts), 4) AS final_equity, round(arg_max(benchmark, ts), 4) AS final_benchmark FROM te_result GROUP BY 1, 2, 3")
def _(t: Tables):
    r = walked(t).groupBy("symbol", "fold", "run_id").agg(F.count("*").alias("bars"), F.max_by("equity", "ts").alias("final_equity"), F.max_by("benchmark", "ts").alias("final_benchmark"))
    return rounded(r, 4)


def _weights(n: int) -> str:
    return "[" + ", ".join(str(0.94**k) for k in range(n - 1, -1, -1)) + "]::DOUBLE[]"


def _points(strategy: str, src: str, keys: str) -> list[tuple[str, int, str]]:
    """Signal SQL, warm-up and table of every grid point over ``src`` (keys, ts, open, close)."""
    w = f"(PARTITION BY {keys} ORDER BY ts)"
    over = lambda n: f"OVER (PARTITION BY {keys} ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    out = []
    for p in bt.GRIDS[strategy]:
        if strategy == "momentum":
            n, k = p["lookback"], p["skip"]
            out.append((f"CASE WHEN lag(close, {n}) OVER {w} > 0 THEN CAST(lag(close, {k}) OVER {w} > lag(close, {n}) OVER {w} AS INT) ELSE 0 END", n + 2, src))
        elif strategy == "mean-reversion":
            n, a, b = p["window"], p["entry_z"], p["exit_z"]
            z = f"(close - avg(close) {over(n)}) / stddev_samp(close) {over(n)}"
            out.append((f"CASE WHEN stddev_samp(close) {over(n)} > 1e-9 THEN CASE WHEN {z} <= {a} THEN 1 WHEN {z} >= {b} THEN 0 ELSE ({b} - {z}) / ({b - a}) END ELSE 0 END", n + 1, src))
        elif strategy == "vol-target":
            n = p["lookback"]
            vol = f"sqrt(list_dot_product(sq{n}, {_weights(n)}) / list_sum({_weights(n)})) * sqrt(252) * 100"
            out.append((f"CASE WHEN len(sq{n}) = {n} AND {vol} > 1e-6 THEN least({p['target_vol']} / ({vol}), 1) ELSE 0 END", n + 1, f"{src}_v"))
        elif strategy == "rsi":
            n = p["period"]
            out.append((f"CASE WHEN rsi{n} IS NULL THEN 0 WHEN rsi{n} <= {p['oversold']} THEN 1 WHEN rsi{n} >= {p['overbought']} THEN 0 ELSE 0.5 END", 3 * n, f"{src}_v"))
        else:
            means = f"avg(close) {over(p['fast'])} > avg(close) {over(p['slow'])}"
            out.append((f"CASE WHEN hurst < {p['hurst_threshold']} THEN 0 ELSE CAST({means} AS INT) END", max(p["slow"], 400) + 1, f"{src}_v"))
    return out


def signal_inputs(strategy: str, src: str, keys: str) -> str:
    """CTEs of what the signals read beside closes, bar by bar within ``keys``."""
    w = f"(PARTITION BY {keys} ORDER BY ts)"
    if strategy == "vol-target":
        sq = ", ".join(f"list(lr * lr) FILTER (lr IS NOT NULL) OVER (PARTITION BY {keys} ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS sq{n}" for n in sorted({p["lookback"] for p in bt.GRIDS[strategy]}))
        return f"{src}_r AS (SELECT *, ln(close / lag(close) OVER {w}) AS lr FROM {src}), {src}_v AS (SELECT *, {sq} FROM {src}_r), "
    if strategy == "rsi":
        mean = lambda c, n: f"CASE WHEN pos > {n} THEN list_reduce(list_concat([list_avg({c}[1:{n}])], {c}[{n + 1}:]), lambda a, x: (a * {n - 1} + x) / {n}) END"
        periods = sorted({p["period"] for p in bt.GRIDS[strategy]})
        a = ", ".join(f"{mean('g', n)} AS g{n}, {mean('s', n)} AS s{n}" for n in periods)
        r = ", ".join(f"CASE WHEN g{n} IS NULL THEN NULL WHEN s{n} <= 1e-12 THEN CASE WHEN g{n} > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + g{n} / s{n}) END AS rsi{n}" for n in periods)
        return f"""{src}_d AS (SELECT *, close - lag(close) OVER {w} AS d, row_number() OVER {w} AS pos FROM {src}), {src}_l AS (SELECT *, list(greatest(d, 0)) FILTER (d IS NOT NULL) OVER p AS g, list(greatest(-d, 0)) FILTER (d IS NOT NULL) OVER p AS s FROM {src}_d WINDOW p AS (PARTITION BY {keys} ORDER BY ts ROWS UNBOUNDED PRECEDING)),
{src}_a AS (SELECT * EXCLUDE (g, s), {a} FROM {src}_l), {src}_v AS (SELECT *, {r} FROM {src}_a), """
    if strategy == "regime-trend":
        k, j = f"{keys}, due", " AND ".join(f"x.{c.strip()} = y.{c.strip()}" for c in keys.split(","))
        return f"""{src}_b AS (SELECT *, ln(close / lag(close) OVER {w}) AS r, row_number() OVER {w} AS b FROM {src}), {src}_at AS (SELECT {keys}, b AS due FROM {src}_b WHERE b = 401 OR (b > 401 AND b % 21 = 0)),
{src}_s AS (SELECT {", ".join(f"x.{c.strip()}" for c in keys.split(","))}, due, r, b - (due - 399) AS pos FROM {src}_b x JOIN {src}_at y ON {j} AND b BETWEEN due - 399 AND due),
{src}_g AS (SELECT DISTINCT unnest([CASE WHEN i = 0 THEN 8 WHEN i = 11 THEN 100 ELSE CAST(floor(8 * pow(12.5, i / 11)) AS BIGINT) END for i in range(12)]) AS lag),
{src}_x AS (SELECT {k}, lag, pos // lag AS chunk, pos, r, r - avg(r) OVER (PARTITION BY {k}, lag, pos // lag) AS dev FROM {src}_s, {src}_g WHERE pos // lag < 400 // lag),
{src}_y AS (SELECT *, sum(dev) OVER (PARTITION BY {k}, lag, chunk ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum FROM {src}_x), {src}_c AS (SELECT {k}, lag, chunk, max(cum) - min(cum) AS spread, stddev_samp(r) AS sd FROM {src}_y GROUP BY ALL),
{src}_m AS (SELECT {k}, lag, avg(spread / sd) AS rs FROM {src}_c WHERE sd > 1e-12 AND spread > 0 GROUP BY ALL),
{src}_p AS (SELECT {k}, ln(lag) AS lx, ln(rs) - ln((lag - 0.5) / lag * pow(lag * pi() / 2, -0.5) * list_sum([sqrt((lag - i) / i) for i in range(1, lag)])) AS ly FROM {src}_m),
{src}_h AS (SELECT {k}, regr_slope(ly, lx) + 0.5 AS h FROM {src}_p GROUP BY {k} HAVING count(*) >= 4),
{src}_v AS (SELECT x.*, last_value(CASE WHEN due IS NOT NULL THEN coalesce(h, 0.5) END IGNORE NULLS) OVER (PARTITION BY {", ".join(f"x.{c.strip()}" for c in keys.split(","))} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS hurst
  FROM {src}_b x LEFT JOIN (SELECT * FROM {src}_at LEFT JOIN {src}_h USING ({k})) y ON {j} AND x.b = y.due), """
    return ""


def fold_walk_sql(strategy: str, train: int, test: int) -> str:
    """Walk-forward said fold by fold: every fold cuts its own bars first and computes signals on nothing else."""
    def signals(src: str, keys: str, out: str) -> str:
        union = " UNION ALL ".join(f"SELECT {keys}, {i}::BIGINT AS run, ts, open, close, CAST({sql} AS DOUBLE) AS signal, {n} AS wu FROM {t}" for i, (sql, n, t) in enumerate(_points(strategy, src, keys)))
        return f"{signal_inputs(strategy, src, keys)}{out} AS ({union})"

    warm = ", ".join(f"({i}, {n})" for i, (_, n, _) in enumerate(_points(strategy, "", "symbol")))
    return f"""{STOCK}, num AS (SELECT symbol, ts, open, close, row_number() OVER {W} AS bar FROM stocks), fd AS (SELECT symbol, CAST(unnest(range((count(*) - {train}) // {test})) AS BIGINT) AS fold FROM num GROUP BY symbol HAVING count(*) >= {train + test}),
ts_ AS (SELECT n.symbol, fold, ts, open, close FROM num n JOIN fd ON n.symbol = fd.symbol AND bar BETWEEN fold * {test} + 1 AND fold * {test} + {train}), {signals("ts_", "symbol, fold", "tsig")},
cut AS (SELECT symbol, fold, run AS run_id, ts, open, close, signal, wu AS warmup FROM tsig WHERE {train} >= wu + 2), {_named(scan_sql("cut", "symbol, fold, run_id"), "tr_")}, {stats_sql("tr_result", "symbol, fold, run_id", "tr_")},
warm(run_id, wu) AS (VALUES {warm}), best AS (SELECT symbol, fold, coalesce(arg_max(run_id, (coalesce(round(sharpe, 9), -1e300), -run_id)), 0) AS run_id FROM fd LEFT JOIN tr_stats USING (symbol, fold) GROUP BY 1, 2),
es_ AS (SELECT n.symbol, p.fold, p.run_id, ts, open, close FROM num n JOIN best p ON n.symbol = p.symbol JOIN warm USING (run_id) WHERE bar BETWEEN greatest(fold * {test} + {train} + 1 - wu, 1) AND fold * {test} + {train} + {test}), {signals("es_", "symbol, fold, run_id", "esig")},
ev AS (SELECT symbol, fold, run_id, ts, open, close, signal, wu AS warmup FROM esig WHERE run = run_id), {_named(scan_sql("ev", "symbol, fold, run_id"), "te_")}
SELECT symbol, fold, run_id, count(*) AS bars, round(arg_max(equity, ts), 4) AS final_equity, round(arg_max(benchmark, ts), 4) AS final_benchmark FROM te_result GROUP BY 1, 2, 3"""


def _walk_query(strategy: str, train: int, test: int) -> None:
    @query(f"bt05_walk_{strategy.replace('-', '_')}", fold_walk_sql(strategy, train, test))
    def _(t: Tables):
        r = bt.walk_forward(t.stocks(), strategy, train, test).groupBy("symbol", "fold", "run_id")
        return rounded(r.agg(F.count("*").alias("bars"), F.max_by("equity", "ts").alias("final_equity"), F.max_by("benchmark", "ts").alias("final_benchmark")), 4)


# Every stock has a few hundred sessions; the regime filter needs 401 of them to warm up.
for _strategy, _train, _test in (("momentum", 300, 63), ("mean-reversion", 300, 63), ("vol-target", 300, 63), ("rsi", 300, 63), ("regime-trend", 425, 42)):
    _walk_query(_strategy, _train, _test)


@query("join16_fold_leaks", f"""{INDEX}, {FOLD_SQL}, b AS (SELECT symbol, ts, row_number() OVER {W} AS bar FROM bars), x AS (SELECT b.symbol, fold, ts, bar BETWEEN train_start AND train_end AS a, bar BETWEEN test_start AND test_end AS e FROM b JOIN folds f ON b.symbol = f.symbol AND bar BETWEEN train_start AND test_end)
SELECT symbol, count(*) FILTER (a) AS selected, count(*) FILTER (e) AS evaluated, count(*) FILTER (a AND e) AS overlap FROM x GROUP BY 1""")
def _(t: Tables):
    """No fold of the walk-forward is evaluated on a bar that it was selected on."""
    return bt.fold_leaks(t.bars())


@query("bt05_stitched_curve", f"""{INDEX}, {WALK_SQL}, rt AS (SELECT symbol, ts, equity / lag(equity) OVER (PARTITION BY symbol, fold ORDER BY ts) - 1 AS ret, benchmark / lag(benchmark) OVER (PARTITION BY symbol, fold ORDER BY ts) - 1 AS br FROM te_result)
SELECT symbol, ts, round(10000 * exp(sum(ln(1 + ret)) OVER {rows('UNBOUNDED')}), 4) AS equity, round(10000 * exp(sum(ln(1 + br)) OVER {rows('UNBOUNDED')}), 4) AS benchmark FROM rt WHERE ret IS NOT NULL""")
def _(t: Tables):
    return rounded(bt.stitched(walked(t)), 4)


@query("agg25_walk_forward_summary", f"""{INDEX}, {WALK_SQL}, g AS (SELECT symbol, fold, run_id, (arg_max(equity, ts) / arg_min(equity, ts) - arg_max(benchmark, ts) / arg_min(benchmark, ts)) * 100 AS ex, sum(cost) AS cost FROM te_result GROUP BY 1, 2, 3)
SELECT symbol, count(*) AS folds, count(*) FILTER (ex > 0.01) AS folds_beating, count(DISTINCT run_id) AS distinct_settings, round(sum(cost), 4) AS total_costs FROM g GROUP BY 1""")
def _(t: Tables):
    return rounded(bt.walk_forward_summary(walked(t)).drop("trades"), 4)


_SW = bt.AXES["ma-crossover"]
_POINTS = [(f, s) for s in _SW[1][1] for f in _SW[0][1] if f < s]
_SSIG = f"""ind AS (SELECT symbol, ts, open, close, {", ".join(f"count(close) OVER {rows(n - 1)} AS n{n}, avg(close) OVER {rows(n - 1)} AS a{n}" for n in sorted({x for p in _POINTS for x in p}))} FROM bars), sig AS (""" + " UNION ALL ".join(
    f"SELECT symbol, {i}::BIGINT AS run_id, ts, open, close, CAST(CASE WHEN n{s} < {s} THEN 0 WHEN a{f} > a{s} THEN 1 ELSE 0 END AS DOUBLE) AS signal, {s + 1} AS warmup FROM ind" for i, (f, s) in enumerate(_POINTS)) + ")"
_PT = "pt(run_id, fast, slow) AS (VALUES " + ", ".join(f"({i}, {f}::DOUBLE, {s}::DOUBLE)" for i, (f, s) in enumerate(_POINTS)) + ")"
SWEEP_SQL = f"{_SSIG}, {_PT}, {scan_sql('sig', 'symbol, run_id')}, {stats_sql('result', 'symbol, run_id')}, surface AS (SELECT symbol, run_id, fast, slow, sharpe, total_return_pct FROM stats JOIN pt USING (run_id))"


@query("bt06_parameter_sweep", f"{INDEX}, {SWEEP_SQL} SELECT s.symbol, x.fast, y.slow, round(sharpe, 6) AS sharpe, round(total_return_pct, 6) AS total_return_pct FROM (SELECT DISTINCT symbol FROM bars) s, (SELECT unnest({_SW[0][1]})::DOUBLE AS fast) x, (SELECT unnest({_SW[1][1]})::DOUBLE AS slow) y LEFT JOIN surface z ON z.symbol = s.symbol AND z.fast = x.fast AND z.slow = y.slow")
def _(t: Tables):
    return rounded(bt.sweep(t.bars(), "ma-crossover").drop("run_id"))


@query("top03_best_grid_point", f"{INDEX}, {SWEEP_SQL} SELECT symbol, fast, slow, round(sharpe, 6) AS sharpe FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(sharpe, 9) DESC NULLS LAST, run_id) AS r FROM surface) WHERE r = 1")
def _(t: Tables):
    from pyspark.sql import Window

    s = bt.sweep(t.bars(), "ma-crossover")
    w = Window.partitionBy("symbol").orderBy(F.desc_nulls_last(F.round("sharpe", 9)), "run_id")
    return rounded(s.withColumn("r", F.row_number().over(w)).filter("r = 1").select("symbol", "fast", "slow", "sharpe"))


@query("agg24_surface_ruggedness", f"""{INDEX}, {SWEEP_SQL}, ful AS (SELECT s.symbol, x.fast, y.slow, sharpe FROM (SELECT DISTINCT symbol FROM surface) s, (SELECT DISTINCT fast FROM pt) x, (SELECT DISTINCT slow FROM pt) y LEFT JOIN surface z ON z.symbol = s.symbol AND z.fast = x.fast AND z.slow = y.slow),
df AS (SELECT symbol, sharpe, abs(lead(sharpe) OVER (PARTITION BY symbol, slow ORDER BY fast) - sharpe) AS dx, abs(lead(sharpe) OVER (PARTITION BY symbol, fast ORDER BY slow) - sharpe) AS dy FROM ful),
g AS (SELECT symbol, (sum(dx) + sum(dy)) / (count(dx) + count(dy)) / (max(sharpe) - min(sharpe)) * 6 / 4 AS rugged FROM df GROUP BY 1) SELECT symbol, round(rugged, 6) AS ruggedness, CASE WHEN rugged > 0.35 THEN 'sharp' WHEN rugged > 0.18 THEN 'noticeable' ELSE 'similar' END AS verdict FROM g""")
def _(t: Tables):
    from tidewright.operators.stats import surface_ruggedness

    full = bt.sweep(t.bars(), "ma-crossover")
    (xn, xs), (yn, ys) = bt.AXES["ma-crossover"]
    cells = F.array(*[F.struct(F.lit(float(x)).alias(xn), F.lit(float(y)).alias(yn)) for x in xs for y in ys])
    grid = full.select("symbol").distinct().select("symbol", F.explode(cells).alias("c")).select("symbol", "c.*")
    return rounded(surface_ruggedness(grid.join(full, ["symbol", xn, yn], "left"), ["symbol"], xn, yn, "sharpe"))


@query("bt10_user_rule", f"{STOCK}, r AS (SELECT *, ln(close / lag(close) OVER {W}) AS lr FROM stocks), i AS (SELECT symbol, ts, close, avg(close) OVER {rows(19)} AS sma_20, (close / lag(close, 10) OVER {W} - 1) * 100 AS ret_10, CASE WHEN count(lr) OVER {rows(19)} >= 2 THEN stddev_samp(lr) OVER {rows(19)} * sqrt(252) * 100 END AS vol_20 FROM r) SELECT symbol, ts, coalesce(close > sma_20 AND ret_10 BETWEEN -1 AND 6 AND vol_20 < 40, false) AS flag FROM i")
def _(t: Tables):
    return rule_flags(t).select("symbol", "ts", "flag")


def rule_flags(t: Tables):
    return bt.rule_signal(t.stocks(), "close > sma_20 AND ret_10 BETWEEN -1 AND 6 AND vol_20 < 40", [("sma", 20), ("ret", 10), ("vol", 20)])


@query("agg28_rule_diagnosis", f"""{STOCK}, r AS (SELECT *, ln(close / lag(close) OVER {W}) AS lr, row_number() OVER {W} - 1 AS pos FROM stocks), i AS (SELECT symbol, ts, pos, close > avg(close) OVER {rows(19)} AND (close / lag(close, 10) OVER {W} - 1) * 100 BETWEEN -1 AND 6 AND CASE WHEN count(lr) OVER {rows(19)} >= 2 THEN stddev_samp(lr) OVER {rows(19)} * sqrt(252) * 100 END < 40 AS f FROM r),
k AS (SELECT symbol, coalesce(f, false) AS f, lag(coalesce(f, false)) OVER {W} AS p FROM i WHERE pos >= 22 AND (pos - 22) % 2 = 0), g AS (SELECT symbol, count(*) AS n, count(*) FILTER (f) AS tr, count(*) FILTER (f <> p) AS fl FROM k GROUP BY 1)
SELECT symbol, n AS bars_tested, tr AS times_true, fl AS flips, round(tr / n, 6) AS fraction_true, concat_ws(';', CASE WHEN tr / n >= 0.99 THEN 'always_true' WHEN tr / n <= 0.01 THEN 'never_true' END, CASE WHEN fl > n * 0.4 THEN 'flips_often' END) AS warnings, tr / n > 0.01 AND tr / n < 0.99 AS ok FROM g""")
def _(t: Tables):
    return rounded(bt.diagnose_rule(rule_flags(t), 22, 2))
