"""Event studies over arrays of sessions: runs of hits and what followed them, for many symbols and scenarios at once.

Rows are the sessions of whole symbols, one symbol after the other, each in the order of time; a bit
of ``hits`` says that a scenario holds in that session. Work is done per scenario and hit, so memory
is bounded by the rows at hand.
"""

from __future__ import annotations

import numpy as np


def beginnings(pos: np.ndarray) -> np.ndarray:
    """Rows on which a symbol begins, from the numbers of its sessions, which are checked."""
    begin = np.flatnonzero(pos == 1)
    size = np.diff(np.append(begin, len(pos)))
    if not np.array_equal(pos, np.arange(len(pos)) - np.repeat(begin, size) + 1):
        raise ValueError("sessions are not in the order of their symbols")
    return begin


def owners(begin: np.ndarray, n: int) -> np.ndarray:
    """The number of each row's symbol."""
    return np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))


def hit_rows(hits: np.ndarray, usable: np.ndarray, owner: np.ndarray, scenarios: int) -> tuple[np.ndarray, np.ndarray]:
    """(group, row) of each hit in a usable row, by group (symbol times scenarios plus scenario) and time."""
    found = [np.flatnonzero((hits >> s & 1).astype(bool) & usable) for s in range(scenarios)]
    group = np.concatenate([owner[rows] * scenarios + s for s, rows in enumerate(found)])
    order = np.argsort(group, kind="stable")
    return group[order], np.concatenate(found)[order]


def episode_starts(group: np.ndarray, pos: np.ndarray, gap: int) -> np.ndarray:
    """Whether a hit is the first of its group or more than ``gap`` sessions after the one before."""
    return np.append(True, (group[1:] != group[:-1]) | (pos[1:] - pos[:-1] > gap))[: len(group)]


def months(known: np.ndarray, hits: np.ndarray, month: np.ndarray, owner: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Per symbol the months with a known flag, and those with a raised one."""
    rows = np.flatnonzero(known)
    if not len(rows):
        return np.zeros(symbols, np.int64), np.zeros(symbols, np.int64)
    o, m = owner[rows], month[rows]
    first = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (m[1:] != m[:-1])))
    raised = np.logical_or.reduceat(hits[rows], first)
    return np.bincount(o[first], minlength=symbols), np.bincount(o[first][raised], minlength=symbols)


def quantile(ordered: np.ndarray, first: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Interpolated quantile of each stretch of ``n`` ordered values that begins at ``first``."""
    at = (n - 1) * p
    low, high = np.floor(at), np.ceil(at)
    a, b = ordered[first + low.astype(np.int64)], ordered[first + high.astype(np.int64)]
    return np.where(a == b, a, (high - at) * a + (at - low) * b)


def outcomes(group: np.ndarray, value: np.ndarray) -> dict[str, np.ndarray]:
    """Summary of the known values of each group; groups without one are left out."""
    known = ~np.isnan(value)
    group, value = group[known], value[known]
    order = np.lexsort((value, group))
    group, value = group[order], value[order]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
    n = np.diff(np.append(first, len(group)))
    if not len(first):
        share = lambda _: np.zeros(0)
    else:
        share = lambda which: np.add.reduceat(which.astype(float), first) / n * 100
    return {"group": group[first], "n_days": n, "median_pct": quantile(value, first, n, 0.5), "p10_pct": quantile(value, first, n, 0.1), "p90_pct": quantile(value, first, n, 0.9),
            "worst_pct": value[first], "share_lower_pct": share(value < 0), "share_higher_pct": share(value > 0)}
