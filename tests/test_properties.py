"""Recurrences and back-tests against plain loops, exact ranks, solvers, no look-ahead."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_golden import series
from tidewright.functions import fits
from tidewright.functions.phrases import RULES
from tidewright.operators import backtest as bt
from tidewright.operators import portfolio as pf
from tidewright.operators import windows as win
from tidewright.operators.ranks import exact_quantiles, leave_one_out_median
from tidewright.operators.scan import ewm_mean, wilder_rsi
from tidewright.operators.textaudit import banned_phrase_counts, banned_phrases


def walk(n, seed=1):
    rng = random.Random(seed)
    out = [100.0]
    for _ in range(n - 1):
        out.append(out[-1] * (1 + rng.uniform(-0.02, 0.02)))
    return out


def test_ewm_matches_pandas_with_gaps(spark):
    x = pd.Series(walk(400))
    x[[0, 1, 50, 51, 52, 200]] = np.nan
    df = spark.createDataFrame([("X", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "symbol string, ts int, v double")
    for alpha in (0.5, 0.06):
        got = [r.y for r in ewm_mean(df, "v", alpha, "y").orderBy("ts").collect()]
        want = x.ewm(alpha=alpha, adjust=False).mean()
        for g, w in zip(got, want):
            assert (g is None and np.isnan(w)) or g == pytest.approx(w, rel=1e-12)


def test_rsi_matches_loop(spark):
    c = walk(200, 3)
    got = [r.rsi for r in wilder_rsi(series(spark, c), 14, "rsi").orderBy("ts").collect()]
    d = np.diff(c)
    g, s = np.maximum(d, 0), np.maximum(-d, 0)
    ag, al = g[:14].mean(), s[:14].mean()
    want = [None] * 14 + [100 - 100 / (1 + ag / al)]
    for i in range(14, len(d)):
        ag, al = (ag * 13 + g[i]) / 14, (al * 13 + s[i]) / 14
        want.append(100 - 100 / (1 + ag / al))
    assert got[:14] == want[:14] and got[14:] == pytest.approx(want[14:], rel=1e-10)


def loop_backtest(opens, closes, signal, warm, c, low=0.0, high=1.0):
    cash, units, held, out = 10_000.0, 0.0, 0.0, []
    for i in range(warm - 1, len(closes) - 1):
        held = held if signal[i] is None else min(max(signal[i], low), high)
        v = cash + units * opens[i + 1]
        want = held * v / opens[i + 1]
        cash -= (want - units) * opens[i + 1] + abs(want - units) * opens[i + 1] * c
        units = want
        out.append(cash + units * closes[i + 1])
    return out


@pytest.mark.parametrize("short,limit", [(False, 1.0), (True, 1.0), (True, 3.0)])
def test_backtest_matches_sequential_loop(spark, short, limit):
    c = walk(150, 5)
    o = [x * 1.001 for x in c]
    rng = random.Random(9)
    sig = [None if rng.random() < 0.1 else rng.uniform(-limit, limit) for _ in c]
    days = pd.date_range("2020-01-01", periods=len(c)).date
    df = spark.createDataFrame([("X", 0, d, a, b, s, 20) for d, a, b, s in zip(days, o, c, sig)], "symbol string, run_id long, ts date, open double, close double, signal double, warmup int")
    ex = bt.Execution(allow_short=short, max_exposure=limit, slippage_bps=30.0)
    got = [r.equity for r in bt.run_backtest(df, ex).orderBy("ts").collect()]
    assert got == pytest.approx(loop_backtest(o, c, sig, 20, ex.cost_rate, -limit if short else 0.0, limit), rel=1e-11)


def test_two_symbols_equal_separate_runs_and_future_does_not_matter(spark):
    a, b = series(spark, walk(120, 1), "A"), series(spark, walk(120, 2), "B")
    run = lambda s: {(r.symbol, r.ts, r.run_id): r.equity for r in bt.run_backtest(bt.grid_signals(s, "ma-crossover", [{"fast": 5, "slow": 20}])).collect()}
    both = run(a.unionByName(b))
    assert both == pytest.approx({**run(a), **run(b)}, rel=1e-12)
    short = run(a.filter(F.col("ts") < F.lit("2020-03-20").cast("date")))
    assert short == pytest.approx({k: both[k] for k in short}, rel=1e-12)


def test_exact_quantiles_with_a_hot_group(spark):
    rng = random.Random(4)
    rows = [("hot", float(rng.randint(0, 50))) for _ in range(3000)] + [("cold", rng.gauss(0, 1)) for _ in range(777)]
    got = {r.k: r.quantiles for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [0.1, 1 / 3, 0.5, 0.99]).collect()}
    for k in ("hot", "cold"):
        assert got[k] == pytest.approx(np.quantile([v for g, v in rows if g == k], [0.1, 1 / 3, 0.5, 0.99]))


@pytest.mark.parametrize("n", [2, 3, 4, 5, 8, 9])
def test_leave_one_out_median(spark, n):
    vals = [float(random.Random(n).randint(0, 6)) + i % 2 for i in range(n)]
    got = {r.v: r.peer_median for r in leave_one_out_median(spark.createDataFrame([("s", v) for v in vals], "k string, v double"), ["k"], "v").collect()}
    for i, v in enumerate(vals):
        assert got[v] == pytest.approx(float(np.median(vals[:i] + vals[i + 1:])))


def test_overlay_matches_loop(spark):
    import math

    def price(s, k, t, r, v, kind):
        if t <= 0:
            return max(s - k, 0) if kind == "call" else max(k - s, 0)
        n = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
        d1 = (math.log(s / k) + (r + v * v / 2) * t) / (v * math.sqrt(t))
        c = s * n(d1) - k * math.exp(-r * t) * n(d1 - v * math.sqrt(t))
        return c if kind == "call" else c - s + k * math.exp(-r * t)

    c = walk(200, 8)
    lr = np.diff(np.log(c))
    vol = lambda i: max(float(np.std(lr[i - 40:i], ddof=1)) * math.sqrt(252), 0.05) * 1.15
    for name, expo, legs, mny, sizing in pf.OVERLAYS:
        got = [r.equity for r in pf.option_overlay(series(spark, c), name).orderBy("ts").collect()]
        cash, shares, open_, want = 10_000.0, 0.0, [], []
        for i in range(42, len(c)):
            for k, kind, q, end in [x for x in open_ if x[3] <= i]:
                cash += q * price(c[i], k, 0, 0.04, 1, kind) * 100
            open_ = [x for x in open_ if x[3] > i]
            if not open_:
                if i + 21 >= len(c):
                    break
                target = expo * (cash + shares * c[i]) / c[i]
                cash -= (target - shares) * c[i] + abs(target - shares) * c[i] * 0.0006
                shares, k = target, c[i] * mny
                fair = [price(c[i], k, 21 / 252, 0.04, vol(i), kind) for kind, _ in legs]
                lots = {"covered": shares / 100, "cash-secured": cash / (k * 100), "budget": 0.05 * (cash + shares * c[i]) / (sum(fair) * 100)}[sizing]
                for (kind, sign), f in zip(legs, fair):
                    cash -= sign * lots * f * (1 + 0.02 * sign) * 100
                    open_.append((k, kind, sign * lots, i + 21))
            want.append(cash + shares * c[i] + sum(q * price(c[i], k, (end - i) / 252, 0.04, vol(i), kind) * 100 for k, kind, q, end in open_))
        assert got == pytest.approx(want, rel=1e-9), name


def test_quantile_fit_is_optimal():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(300), rng.normal(size=(300, 4))])
    y = 0.4 * x[:, 1] + rng.normal(size=300) * 0.1
    for tau in (0.05, 0.5, 0.9):
        for alpha in (0.0, 0.01):
            b = fits.quantile_fit(x, y, tau, alpha)
            best = fits.check_objective(x, y, b, tau, alpha)
            for _ in range(300):
                assert fits.check_objective(x, y, b + rng.normal(size=5) * 10 ** rng.uniform(-6, -1), tau, alpha) >= best - 1e-8


def test_moments_of_gaussian_quantiles_are_exact():
    z = fits.normal_ppf(np.array([0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95]))
    m, v, s = fits.quantile_moments(z, (0.3 + 0.2 * z)[None, :])
    assert m[0] == pytest.approx(0.3) and v[0] == pytest.approx(0.04) and s[0] == pytest.approx(0, abs=1e-9)


def test_circle_has_one_loop_and_a_line_none():
    a = np.linspace(0, 2 * np.pi, 24, endpoint=False)
    bars = fits.loop_bars(np.column_stack([np.cos(a), np.sin(a)]))
    life = np.sort(bars[:, 1] - bars[:, 0])[::-1]
    assert life[0] > 0.8 and (len(life) == 1 or life[1] < 0.2)
    assert len(fits.loop_bars(np.column_stack([np.arange(10.0), np.arange(10.0)]))) == 0


def test_smile_is_recovered_and_unit_roots_are_told_apart():
    k = np.linspace(-0.3, 0.3, 31)
    w = 0.02 + 0.12 * (-0.4 * (k - 0.03) + np.hypot(k - 0.03, 0.1))
    a, b, rho, m, s, rmse = fits.svi_fit(k, w)
    assert rmse < 1e-5 and rho == pytest.approx(-0.4, abs=0.02)
    rng = np.random.default_rng(3)
    e = rng.normal(size=500)
    ar = [0.0]
    for x in e:
        ar.append(0.5 * ar[-1] + x)
    assert fits.adf_pvalue(np.array(ar))[1] < 0.01 and fits.adf_pvalue(np.cumsum(e))[1] > 0.05


def test_every_banned_phrase_is_located(spark):
    text = "Prices fell because of it; because  it was due to rates. You should buy now, it will rise."
    got = banned_phrases(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    at = sorted((r.start, r.label) for r in got)
    low = text.lower()
    assert [a for a, _ in at] == [low.index("because"), low.index("because", 15), low.index("due to"), low.index("you should"), low.index("will rise")]
    assert all(low[a:a + 4] in r for (a, _), r in zip(at, [x.excerpt.lower() for x in sorted(got, key=lambda r: r.start)]))


def wordings(pattern):
    """Every text that a phrase rule spells out."""
    group = re.search(r"\(\?:([^()]*)\)(\??)", pattern) or re.search(r"([a-z])(\?)", pattern) or re.search(r"\[([- ]+)\]()", pattern)
    if not group:
        return [pattern.replace(r"\b", "").replace(r"\s+", "  ")]
    choices = list(group[1]) if group[0].startswith("[") else group[1].split("|")
    return [w for c in choices + [""] * bool(group[2]) for w in wordings(pattern[:group.start()] + c + pattern[group.end():])]


def test_needles_are_in_every_wording_and_counts_equal_places(spark):
    spelled = [(w, p) for _, p, _ in RULES for w in wordings(p)]
    assert len(spelled) > 200 and all(re.search(p, w) for w, p in spelled)
    texts = [f"So {w.upper()}, and {w} x{w}" for w, _ in spelled] + [None, "", "the causeway, leadto"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    want = {(i, n): len(re.findall(p, t.lower())) for i, t in enumerate(texts) if t for _, p, n in RULES if re.search(p, t.lower())}
    assert {(r.doc_id, r.label): r.hits for r in banned_phrase_counts(docs).collect()} == want
    places = banned_phrases(docs).groupBy("doc_id", "label").count().collect()
    assert {(r.doc_id, r.label): r["count"] for r in places} == want
    firsts = banned_phrases(docs, labels=["drove", "led to"], first=True).collect()
    assert sorted((r.doc_id, r.label) for r in firsts) == sorted(k for k in want if k[1] in ("drove", "led to"))


def test_stream_bars_equal_batch(spark, tmp_path):
    from tidewright.streaming.bars import hourly_bars

    rows = [(i, (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=7 * i)).to_pydatetime(), "view", float(i % 13)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = hourly_bars(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bars_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {(r.symbol, r.ts): (r.open, r.close, r.volume) for r in spark.table("bars_out").collect()}
    want = {(r.symbol, r.ts): (r.open, r.close, r.volume) for r in hourly_bars(df).collect()}
    assert got == want and len(got) == 35


def test_sinks_write_fixed_decimals(spark, tmp_path):
    from tidewright.sources.sinks import write_clustered, write_csv, write_json

    s = series(spark, walk(30))
    write_csv(s, str(tmp_path / "c"))
    line = spark.read.text(str(tmp_path / "c")).filter("value NOT LIKE 'symbol%'").first().value
    assert len(line.split(",")[2].split(".")[1]) == 6
    write_json(s, str(tmp_path / "j"))
    write_clustered(s, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.parquet(str(tmp_path / "p")).count() == 30
    _ = win
