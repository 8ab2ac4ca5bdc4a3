"""Walk-forward selection of rules over arrays of bars: many folds of many series at once.

The arithmetic is that of ``operators.backtest`` on complete series: signals inside a fold, fills at
the next open, drifted weights by the same substitutions. Arrays are (slices, bars); a slice is the
bars of one fold, so nothing is repeated per grid point but the block of slices at hand.
"""

from __future__ import annotations

import math

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

HELD = ("mean-reversion", "vol-target", "rsi", "regime-trend")  # the strategies that have a kernel here
BLOCK = 256  # slices worked on at once


def _moving(x: np.ndarray, n: int) -> np.ndarray:
    return sliding_window_view(x, n, axis=1)


def _rsi(close: np.ndarray, n: int) -> np.ndarray:
    """Wilder's RSI at bars n + 1 and later of each slice, seeded with simple means."""
    move = np.diff(close, axis=1)
    sides = np.stack([np.maximum(move, 0.0), np.maximum(-move, 0.0)])
    out = np.empty((2, len(close), close.shape[1] - n))
    out[:, :, 0] = sides[:, :, :n].mean(axis=2)
    for i in range(n, move.shape[1]):
        out[:, :, i - n + 1] = (out[:, :, i - n] * (n - 1) + sides[:, :, i]) / n
    gain, loss = out
    flat = loss <= 1e-12
    return np.where(flat, np.where(gain > 0, 100.0, 50.0), 100 - 100 / (1 + gain / np.where(flat, 1.0, loss)))


def _lags(n: int, min_lag: int = 8, steps: int = 12) -> list[int]:
    top = n // 4
    lags = [min_lag if i == 0 else top if i == steps - 1 else math.floor(min_lag * (top / min_lag) ** (i / (steps - 1))) for i in range(steps)]
    return [k for k in dict.fromkeys(lags) if n // k >= 2]


def _hurst(r: np.ndarray) -> np.ndarray:
    """Hurst exponent of each row of returns by bias-corrected rescaled range; 0.5 where fewer than four lags have a chunk that moves."""
    x, y = [], []
    for lag in _lags(r.shape[1]):
        c = r[:, : r.shape[1] // lag * lag].reshape(len(r), -1, lag)
        dev = c - c.mean(axis=2, keepdims=True)
        cum = np.cumsum(dev, axis=2)
        spread, sd = cum.max(axis=2) - cum.min(axis=2), np.sqrt((dev * dev).sum(axis=2) / (lag - 1))
        ok = (sd > 1e-12) & (spread > 0)
        ratio, m = np.where(ok, spread / np.where(ok, sd, 1.0), 0.0).sum(axis=1), ok.sum(axis=1)
        expected = (lag - 0.5) / lag * (lag * math.pi / 2) ** -0.5 * sum(math.sqrt((lag - i) / i) for i in range(1, lag))
        x.append(math.log(lag))
        y.append(np.where(m > 0, np.log(np.where(m > 0, ratio, 1.0) / np.maximum(m, 1)) - math.log(expected), np.nan))
    if not x:
        return np.full(len(r), 0.5)
    y = np.array(y).T
    known = ~np.isnan(y)
    k = known.sum(axis=1)
    at = np.where(known, np.array(x), 0.0)
    dx = np.where(known, at - (at.sum(axis=1) / np.maximum(k, 1))[:, None], 0.0)
    sxx = (dx * dx).sum(axis=1)
    found = (k >= 4) & (sxx > 0)
    return np.where(found, (dx * np.where(known, y, 0.0)).sum(axis=1) / np.where(found, sxx, 1.0) + 0.5, 0.5)


def _held_hurst(close: np.ndarray, warm: int, window: int, refresh: int) -> np.ndarray:
    """Exponent held at bars ``warm`` and later: estimated at ``warm``, then on multiples of ``refresh``."""
    bars = np.arange(warm, close.shape[1] + 1)
    due = (bars == warm) | (bars % refresh == 0)
    r = np.diff(np.log(close), axis=1)
    h = np.stack([_hurst(r[:, max(b - 1 - window, 0):b - 1]) for b in bars[due]], axis=1)
    return h[:, np.cumsum(due) - 1]


def signals(strategy: str, params: dict, warmup: int, close: np.ndarray, kept: dict, hurst_window: int = 400) -> np.ndarray:
    """Signal at bar ``warmup`` and each later one of complete slices; ``kept`` holds what grid points share."""
    once = lambda key, make: kept[key] if key in kept else kept.setdefault(key, make())
    if strategy == "mean-reversion":
        n, a, b = params["window"], params["entry_z"], params["exit_z"]
        mean, sd = once(("mr", n), lambda: (lambda m: (m.mean(axis=2), m.std(axis=2, ddof=1)))(_moving(close, n)))
        flat = sd <= 1e-9
        z = (close[:, n - 1:] - mean) / np.where(flat, 1.0, sd)
        return np.where(flat, 0.0, np.where(z <= a, 1.0, np.where(z >= b, 0.0, (b - z) / (b - a))))[:, warmup - n:]
    if strategy == "vol-target":
        n = params["lookback"]
        raw = np.array([0.94**k for k in range(n - 1, -1, -1)])
        vol = once(("vt", n), lambda: np.sqrt(_moving(np.diff(np.log(close), axis=1) ** 2, n) @ (raw / raw.sum())) * math.sqrt(252.0) * 100)
        moves = vol > 1e-6
        return np.where(moves, np.minimum(params["target_vol"] / np.where(moves, vol, 1.0), 1.0), 0.0)[:, warmup - n - 1:]
    if strategy == "rsi":
        n = params["period"]
        r = once(("rsi", n), lambda: _rsi(close, n))
        return np.where(r <= params["oversold"], 1.0, np.where(r >= params["overbought"], 0.0, 0.5))[:, warmup - n - 1:]
    if strategy == "regime-trend":
        total = once("sum", lambda: np.pad(np.cumsum(close, axis=1), ((0, 0), (1, 0))))
        mean = lambda n: (total[:, warmup:] - total[:, warmup - n:total.shape[1] - n]) / n
        slow = mean(params["slow"])
        up = mean(params["fast"]) - slow > 1e-10 * np.abs(slow)
        h = once(("hurst", warmup), lambda: _held_hurst(close, warmup, hurst_window, 21))
        return np.where(h < params.get("hurst_threshold", 0.5), 0.0, up.astype(float))
    raise ValueError(f"no kernel for {strategy!r}")


def _before(x: np.ndarray, first: float) -> np.ndarray:
    """Each row one bar later."""
    return np.concatenate([np.full((len(x), 1), first), x[:, :-1]], axis=1)


def run(signal: np.ndarray, op: np.ndarray, close: np.ndarray, ex) -> dict[str, np.ndarray]:
    """``operators.backtest.run_backtest`` of traded bars: ``signal`` of the bar before each, its open and close."""
    c = ex.cost_rate
    e = np.clip(signal, -ex.max_exposure if ex.allow_short else 0.0, ex.max_exposure)
    p = _before(e, 0.0)
    grown = p * np.concatenate([np.ones((len(op), 1)), op[:, 1:] / op[:, :-1]], axis=1)
    w = grown / (1 - p + grown)
    for _ in range(ex.substitutions):
        w = grown / (1 - p - c * np.abs(p - _before(w, 0.0)) + grown)
    step = 1 - p - c * np.abs(p - _before(w, 0.0)) + grown
    w = grown / step
    v = ex.initial_cash * np.exp(np.cumsum(np.log(step), axis=1))
    paid = c * np.abs(e - w)
    return {"exposure": e, "equity": v * (1 - e - paid + e * close / op), "benchmark": ex.initial_cash * (1 - c) / op[:, :1] * close,
            "cost": v * paid, "traded": np.abs(e - p) > 1e-12}


def sharpe_order(equity: np.ndarray, periods: int = 252) -> np.ndarray:
    """What the selection compares: the Sharpe ratio to nine digits, less than any where it is unknown, least where there are fewer than three bars."""
    if equity.shape[1] < 3:
        return np.full(len(equity), -np.inf)
    ret = equity[:, 1:] / equity[:, :-1] - 1
    sd = ret.std(axis=1, ddof=1)
    moves = sd > 1e-12
    return np.where(moves, np.round(ret.mean(axis=1) / np.where(moves, sd, 1.0) * math.sqrt(periods), 9), -1e300)


def walked(op: np.ndarray, close: np.ndarray, ends: np.ndarray, strategy: str, points: list[tuple[dict, int]], train: int, test: int, ex):
    """Rows of the test windows that begin after ``ends`` training bars (indices into the arrays): yields (fold numbers, run, bar indices, results).

    ``points`` are grid points with their warm-ups, each of which leaves the training window two bars or more.
    """
    for at in range(0, len(ends), BLOCK):
        some = ends[at:at + BLOCK]
        idx = some[:, None] + np.arange(-train, 0)
        o, c, kept = op[idx], close[idx], {}
        scores = []
        for params, warmup in points:
            s = signals(strategy, params, warmup, c, kept)
            scores.append(sharpe_order(run(s[:, :-1], o[:, warmup:], c[:, warmup:], ex)["equity"]))
        best = np.argmax(scores, axis=0)
        for k, (params, warmup) in enumerate(points):
            mine = best == k
            if not mine.any():
                continue
            idx = some[mine][:, None] + np.arange(-warmup, test)
            o, c = op[idx], close[idx]
            s = signals(strategy, params, warmup, c, {})
            yield at + np.flatnonzero(mine), k, idx[:, warmup:], run(s[:, :-1], o[:, warmup:], c[:, warmup:], ex)
