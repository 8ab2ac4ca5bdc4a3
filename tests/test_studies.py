"""Scenario studies over arrays of sessions against plain loops."""

import datetime as dt
import re

import numpy as np
import pytest

from tidewright.operators import scenarios as sc
from tidewright.operators import windows as win

DAY = dt.date(2021, 1, 1)
SCENARIOS = [
    sc.Scenario("rise", "P", "change_pct", 5, 1.0), sc.Scenario("shock", "self", "shock_day", 20, -1.5), sc.Scenario("low", "Q", "level_below", 1, 101.0),
    sc.Scenario("slide", "self", "change_pct", 3, -2.0), sc.Scenario("war", "none", None), sc.Scenario("unseen", "nowhere", "change_pct", 5, 1.0),
]


def tables(spark):
    """Closes with gaps in the calendar, an unknown close, a short symbol and one without a name; proxies that skip days; a market."""
    rng = np.random.default_rng(4)
    closes, proxies = [], []
    for symbol, n in (("A", 190), ("B", 160), ("short", 12), ("hole", 150), (None, 140)):
        days = sorted(rng.choice(220, n, replace=False).tolist())
        level = 100 * np.exp(np.cumsum(rng.normal(0, 0.015, n)))
        closes += [(symbol, DAY + dt.timedelta(days=d), None if symbol == "hole" and i in (60, 61) else float(x)) for i, (d, x) in enumerate(zip(days, level))]
    for symbol, n in (("P", 120), ("Q", 40), ("M", 200)):
        days = sorted(rng.choice(220, n, replace=False).tolist())
        proxies += [(symbol, DAY + dt.timedelta(days=d), float(x)) for d, x in zip(days, 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n))))]
    make = lambda rows: spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "symbol string, ts date, close double")
    c, p = make(closes), make(proxies)
    return c, p, p.filter("symbol = 'M'").select("ts", win.pct_return("close").alias("ret"))


def series(rows):
    out = {}
    for r in rows:
        out.setdefault(r.symbol, []).append((r.ts, r.close))
    return {k: sorted(v) for k, v in out.items()}


def flagged(x, kind, window, threshold, market):
    """Flag of every row of [(ts, close)]: True, False or None."""
    change = lambda i, k: x[i][1] / x[i - k][1] - 1 if i >= k and x[i][1] is not None and x[i - k][1] is not None else None
    out = []
    for i in range(len(x)):
        m = change(i, window) if kind == "change_pct" else None
        if kind == "level_below":
            out.append(None if x[i][1] is None else x[i][1] < threshold)
        elif kind == "change_pct":
            out.append(None if m is None else m * 100 > threshold if threshold >= 0 else m * 100 < threshold)
        else:
            past = [change(j, 1) for j in range(max(i - window, 0), i)]
            r = change(i, 1)
            ok = len(past) == window and None not in past and r is not None
            out.append(r / np.std(past, ddof=1) <= threshold and market.get(x[i][0]) is not None and market[x[i][0]] * 100 > -1.0 if ok else None)
    return out


def studied(c, p, m):
    """{(symbol, scenario): (months, months raised, hits as (pos, ts, forwards))} by loops."""
    targets, proxies, market = series(c.collect()), series(p.collect()), {r.ts: r.ret for r in m.collect()}
    months = lambda x, f: (len({(t.year, t.month) for (t, _), v in zip(x, f) if v is not None}), len({(t.year, t.month) for (t, _), v in zip(x, f) if v}))
    out = {}
    for s in SCENARIOS:
        proxy = proxies.get(s.driver, [])
        told = flagged(proxy, s.kind, s.window, s.threshold, market) if s.kind and s.driver != "self" else []
        for symbol, x in targets.items():
            if s.driver == "self":
                f = flagged(x, s.kind, s.window, s.threshold, market)
                seen = months(x, f)
            else:
                seen, f = months(proxy, told), []
                for i, (t, _) in enumerate(x):
                    last = max((k for k, (d, _) in enumerate(proxy) if d <= t), default=None)
                    f.append(None if last is None or sum(proxy[last][0] < d <= t for d, _ in x) > 3 else told[last])
            fwd = lambda i, h: (x[i + h][1] / x[i][1] - 1) * 100 if i + h < len(x) and x[i + h][1] is not None and x[i][1] is not None else None
            hits = [(i, x[i][0], {h: fwd(i, h) for h in sc.HORIZONS}) for i in range(len(x)) if f[i] and fwd(i, sc.MAIN_HORIZON) is not None]
            out[symbol, s.name] = (*seen, hits)
    return out


def runs(hits):
    out = []
    for h in hits:
        if out and h[0] - out[-1][-1][0] <= sc.EPISODE_GAP:
            out[-1].append(h)
        else:
            out.append([h])
    return out


def near(v):
    return round(v, 7) if isinstance(v, float) else v


@pytest.mark.parametrize("at_once", (50_000, 1))
def test_studies_equal_loops(spark, monkeypatch, at_once):
    monkeypatch.setattr(sc, "ROWS_AT_ONCE", at_once)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000" if at_once > 1 else "13")
    try:
        c, p, m = tables(spark)
        got = sorted((tuple(near(v) for v in r) for r in sc.measure_scenarios(c, p, m, SCENARIOS).collect()), key=str)
    finally:
        spark.conf.set(key, before)
    want = []
    for (symbol, name), (seen, raised, hits) in studied(c, p, m).items():
        if name == "war":
            want.append((symbol, name, *[None] * 12))
        if not seen:
            continue
        hits = hits if symbol is not None else []  # what follows is joined by symbol
        n, head = len(runs(hits)), (symbol, name, seen, raised, raised / seen * 100)
        found = [(h, sorted(x[2][h] for x in hits if x[2][h] is not None)) for h in sc.HORIZONS if n >= sc.MIN_EPISODES]
        rows = [(h, len(v), *np.percentile(v, [50, 10, 90]).tolist(), v[0], sum(x < 0 for x in v) / len(v) * 100, sum(x > 0 for x in v) / len(v) * 100) for h, v in found if v]
        want += [(*head, n, *r) for r in rows or [(None,) * 8]]
    assert got == sorted((tuple(near(v) for v in r) for r in want), key=str)
    assert {r[1] for r in got if r[7]} == {"rise", "shock", "low", "slide"} and any(r[0] is None for r in got)


def test_dated_episodes_equal_loops(spark):
    c, p, m = tables(spark)
    priced = [s for s in SCENARIOS if s.kind]
    got = sorted((tuple(near(v) for v in r) for r in sc.dated_episodes(c, p, m, priced).collect()), key=str)
    want = [(symbol, name, k, e[0][1], e[-1][1], len(e), e[-1][0] - e[0][0] + 1, near(e[0][2][sc.MAIN_HORIZON]))
            for (symbol, name), (_, _, hits) in studied(c, p, m).items() for k, e in enumerate(runs(hits), 1)]
    assert got == sorted(want, key=str) and len(got) > 20
    assert sc.dated_episodes(c.limit(0), p, m, priced).count() == 0


def test_sessions_are_dealt_once_and_frames_computed_once(spark):
    """However many scenarios there are: one shuffle of the sessions into the session's own number of tasks, one moving deviation."""
    c, p, m = tables(spark)
    for df in (sc.measure_scenarios(c, p, m, SCENARIOS), sc.dated_episodes(c, p, m, [s for s in SCENARIOS if s.kind])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning\(symbol#\d+, \d+\), REPARTITION_BY_NUM", plan)) == plan.count("Exchange hashpartitioning(symbol#") == 1
        assert df._jdf.queryExecution().optimizedPlan().toString().count("stddev_samp(") == 1
