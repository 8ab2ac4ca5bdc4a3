"""Small numeric kernels run inside tasks on one group at a time (a window, a smile, a training set)."""

from __future__ import annotations

import math

import numpy as np


def quantile_fit(x: np.ndarray, y: np.ndarray, tau: float, alpha: float, steps: int = 60) -> np.ndarray:
    """Linear quantile regression with an L1 penalty on all but the first column."""
    return quantile_solution(x, y, tau, alpha, steps)[0]


def quantile_solution(x: np.ndarray, y: np.ndarray, tau: float, alpha: float, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The fit and its dual value for each row, between tau - 1 and tau, which prove it optimal.

    A set by itself and at one level, by the steps of ``quantile_solutions``: where several fits are optimal both give the same one.
    """
    beta, dual = quantile_solutions(x[None], y[None], [tau], alpha, steps)
    return beta[0, 0], dual[0, 0]


def quantile_solutions(x: np.ndarray, y: np.ndarray, taus: list[float], alpha: float, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """``quantile_solution`` of many sets of equal shape at all levels at once: x (sets, rows, columns), y (sets, rows).

    Returns the fits (sets, levels, columns) and the duals (sets, levels, rows). Primal-dual interior point. The penalty is part of the
    data: |u| is the check loss of u plus that of -u, so each coefficient adds two rows with target zero. ``d`` in (0, 1) weighs the rows,
    ``s`` is what it lacks to one, ``u`` and ``v`` are the residual parts above and below the fit. Steps are predicted and corrected, so
    that about 15 close the gap; a fit that has closed it stays where it is while others go on.
    """
    sets, n, p = x.shape
    data, tau = n, np.asarray(taus, float)
    if alpha > 0 and p > 1:
        extra = np.broadcast_to(np.eye(p)[1:] * (n * alpha), (sets, p - 1, p))
        x, y = np.concatenate([x, extra, -extra], 1), np.concatenate([y, np.zeros((sets, 2 * (p - 1)))], 1)
    rows = y.shape[1]
    scale = np.maximum(y.std(axis=1), 1e-12)
    y = (y / scale[:, None])[:, None, :]
    across = np.ascontiguousarray(x.swapaxes(1, 2))
    outer = (x[:, :, :, None] * x[:, :, None, :]).reshape(sets, rows, p * p)
    need = (1 - tau)[None, :, None] * x.sum(axis=1)[:, None, :]
    d = np.repeat(np.broadcast_to((1 - tau)[None, :, None], (1, len(tau), rows)), sets, axis=0)
    beta = np.stack([np.linalg.lstsq(a, b[0], rcond=None)[0] for a, b in zip(x, y)])[:, None, :].repeat(len(tau), axis=1)
    r = y - beta @ across
    u, v, s = np.maximum(r, 0) + 0.1, np.maximum(-r, 0) + 0.1, 1 - d
    for _ in range(steps):
        gap = np.vecdot(u, s) + np.vecdot(v, d)
        going = gap >= 1e-12 * rows
        if not going.any():
            break
        over_s, over_d = 1 / s, 1 / d
        us, vd = u * over_s, v * over_d
        w = 1 / (us + vd)
        r = y - beta @ across
        short = need - d @ x
        lhs = (w @ outer).reshape(sets, len(tau), p, p)
        lhs = lhs + 1e-14 * np.trace(lhs, axis1=2, axis2=3)[:, :, None, None] * np.eye(p)
        lhs[~going] = np.eye(p)
        # The step to a gap of zero, of which only the change of each dual over its two distances is needed.
        dd = w * (r - np.linalg.solve(lhs, ((w * r) @ x - short)[..., None])[..., 0] @ across)
        a, b = dd * over_s, dd * over_d
        worst = np.maximum(np.maximum(a.max(axis=2), 1 - a.min(axis=2)), np.maximum(1 + b.max(axis=2), -b.min(axis=2)))
        mu = ((1 - 1 / np.maximum(worst, 1)) ** 3 * gap / (2 * rows))[:, :, None]
        # The step that is taken: as much of the gap as the first one could not close, less its second-order terms. In place, as memory is the cost.
        a *= (a - 1) * u
        a += over_s * mu
        b *= (b + 1) * v
        b += over_d * mu
        r -= a
        r += b
        db = np.linalg.solve(lhs, ((w * r) @ x - short)[..., None])[..., 0]
        dd = w * (r - db @ across)
        du, dv = us, vd
        du *= dd
        du += a
        du -= u
        dv *= -dd
        dv += b
        dv -= v
        over_s *= dd
        over_d *= dd
        worst = np.maximum(np.maximum(over_s.max(axis=2), -over_d.min(axis=2)), -np.minimum((du / u).min(axis=2), (dv / v).min(axis=2)))
        step = np.where(going, np.minimum(1.0, 0.995 / np.maximum(worst, 0.1)), 0.0)[:, :, None]
        # The distance to one is kept, as 1 - d would round to zero before the others are done.
        beta, d, s, u, v = beta + step * db, d + step * dd, s - step * dd, u + step * du, v + step * dv
    return beta * scale[:, None, None], d[:, :, :data] - (1 - tau)[None, :, None]


def quantile_proofs(x: np.ndarray, y: np.ndarray, taus: list[float], start: np.ndarray, slopes: np.ndarray, dual: np.ndarray) -> dict[str, np.ndarray]:
    """The sums that prove fits of sets of equal length optimal, each (sets, levels): x (sets, rows, features), ``start`` and ``slopes`` on it, ``dual`` (sets, levels, rows).

    They take the models and duals as they are given, on the features as they are; what was computed on the way to them is not used.
    """
    tau = np.asarray(taus, float)[None, :, None]
    mean, sd = x.mean(axis=1), x.std(axis=1)
    varies = (sd > 1e-12)[:, None, :]
    r = y[:, None, :] - start[:, :, None] - slopes @ x.swapaxes(1, 2)
    unit = np.where(varies, (x - mean[:, None, :]) / np.where(varies, sd[:, None, :], 1.0), 0.0)
    return {
        "loss": np.maximum(tau * r, (tau - 1) * r).sum(axis=2), "size": (np.abs(slopes) * sd[:, None, :]).sum(axis=2), "dual": np.vecdot(dual, y[:, None, :]),
        "scale": np.repeat(np.abs(y).sum(axis=1)[:, None], len(taus), axis=1), "low": dual.min(axis=2), "high": dual.max(axis=2), "zero": dual.sum(axis=2), "steep": np.abs(dual @ unit).max(axis=2),
    }


def check_objective(x: np.ndarray, y: np.ndarray, beta: np.ndarray, tau: float, alpha: float) -> float:
    r = y - x @ beta
    return float(np.mean(np.maximum(tau * r, (tau - 1) * r)) + alpha * np.abs(beta[1:]).sum())


def svi_fit(k: np.ndarray, w: np.ndarray, rounds: int = 7, rho_max: float = 0.999) -> tuple[float, float, float, float, float, float]:
    """Raw SVI by least squares: (a, b, rho, m, sigma, rmse) with a, b >= 0 and |rho| bounded.

    For given (m, sigma) the smile is linear in (a, c = b*rho, b); where the free solution leaves the
    feasible cone its edges are tried. All cells of an (m, sigma) grid are solved at once, and the grid
    shrinks around its best cell.
    """
    span = max(float(np.ptp(k)), 1e-6)
    m_lo, m_hi, s_lo, s_hi = k.min() - 0.5 * span, k.max() + 0.5 * span, math.log(1e-3 * span), math.log(2 * span)
    best, found = np.inf, (float(w.mean()), 0.0, 0.0, 0.0, span)
    n = len(k)

    def two(f: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ff, fg, gg, fw, gw = (f * f).sum(1), (f * g).sum(1), (g * g).sum(1), (f * w).sum(1), (g * w).sum(1)
        det = np.where(np.abs(ff * gg - fg * fg) > 1e-18, ff * gg - fg * fg, np.inf)
        return (fw * gg - gw * fg) / det, (gw * ff - fw * fg) / det

    for _ in range(rounds):
        m, ls = (g.ravel() for g in np.meshgrid(np.linspace(m_lo, m_hi, 13), np.linspace(s_lo, s_hi, 13)))
        sg = np.exp(ls)
        z = k - m[:, None]
        h = np.hypot(z, sg[:, None])
        one, none = np.ones_like(z), np.zeros(len(m))
        cols = np.stack([one, z, h], axis=2)
        gram = np.einsum("cni,cnj->cij", cols, cols) + 1e-13 * n * np.eye(3)
        free = np.linalg.solve(gram, np.einsum("cni,n->ci", cols, w)[:, :, None])[:, :, 0]
        options = [(free[:, 0], free[:, 1], free[:, 2])]
        c, b = two(z, h)
        options.append((none, c, b))
        for side in (rho_max, -rho_max):
            edge = h + side * z
            a, b = two(one, edge)
            options.append((a, side * b, b))
            b = np.maximum((edge * w).sum(1) / (edge * edge).sum(1), 0)
            options.append((none, side * b, b))
        options.append((none + max(float(w.mean()), 0.0), none, none))
        for a, c, b in options:
            ok = (a >= 0) & (b >= 0) & (np.abs(c) <= rho_max * b + 1e-15)
            sse = np.where(ok, ((a[:, None] + c[:, None] * z + b[:, None] * h - w) ** 2).sum(1), np.inf)
            i = int(np.argmin(sse))
            if sse[i] < best:
                best, found = float(sse[i]), (float(a[i]), float(b[i]), float(c[i] / b[i]) if b[i] > 0 else 0.0, float(m[i]), float(sg[i]))
        dm, ds = (m_hi - m_lo) / 6, (s_hi - s_lo) / 6
        m_lo, m_hi, s_lo, s_hi = found[3] - dm, found[3] + dm, math.log(found[4]) - ds, math.log(found[4]) + ds
    return (*found, math.sqrt(best / n))


def loop_bars(points: np.ndarray) -> np.ndarray:
    """(birth, death) of every one-dimensional hole of the Rips filtration, cut at the enclosing radius.

    A boundary column is one integer whose bits are edges in filtration order, so reduction is xor.
    """
    n = len(points)
    dist = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
    cut = float(dist.max(axis=1).min())
    i, j = np.triu_indices(n, 1)
    length = dist[i, j]
    keep = np.flatnonzero(length <= cut)
    order = keep[np.argsort(length[keep], kind="stable")]
    if cut <= 0 or len(order) < 3:
        return np.empty((0, 2))
    rank = np.full((n, n), -1)
    rank[i[order], j[order]] = np.arange(len(order))
    born = length[order]
    a, b, c = np.array([(p, q, r) for p in range(n - 2) for q in range(p + 1, n - 1) for r in range(q + 1, n)]).T
    sides = np.stack([rank[a, b], rank[a, c], rank[b, c]])
    sides = sides[:, (sides >= 0).all(axis=0)]
    sides = sides[:, np.argsort(sides.max(axis=0), kind="stable")]
    # Edges that join two components can never be the top of a reduced column.
    root = list(range(n))

    def find(p: int) -> int:
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    cycle = []
    for p, q in zip(i[order].tolist(), j[order].tolist()):
        p, q = find(p), find(q)
        cycle.append(p == q)
        root[p] = q
    open_cycles = sum(cycle)
    pivot: dict[int, int] = {}
    bars = []
    for e, f, g in sides.T.tolist():
        col = (1 << e) ^ (1 << f) ^ (1 << g)
        top = max(e, f, g)
        value = born[top]
        while col:
            low = col.bit_length() - 1
            if low not in pivot:
                break
            col ^= pivot[low]
        if col:
            low = col.bit_length() - 1
            pivot[low] = col
            if value > born[low]:
                bars.append((born[low], value))
            if len(pivot) == open_cycles:
                break
    bars += [(born[x], cut) for x, is_cycle in enumerate(cycle) if is_cycle and x not in pivot and born[x] < cut]
    return np.array(bars).reshape(-1, 2)


def landscape_norms(bars: np.ndarray, layers: int = 5, grid: int = 200) -> tuple[float, float]:
    """L1 and L2 norms of the first layers of the persistence landscape."""
    if not len(bars):
        return 0.0, 0.0
    t = np.linspace(bars[:, 0].min(), bars[:, 1].max(), grid)
    tents = np.maximum(0, np.minimum(t - bars[:, :1], bars[:, 1:] - t))
    top = -np.sort(-tents, axis=0)[:layers]
    return float(np.trapezoid(top, t, axis=1).sum()), float(np.sqrt(np.trapezoid(top**2, t, axis=1).sum()))


def normal_ppf(p: np.ndarray) -> np.ndarray:
    """Inverse normal by bisection on the error function (levels are few and fixed)."""
    def one(q: float) -> float:
        lo, hi = -9.0, 9.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < q else (lo, mid)
        return (lo + hi) / 2
    return np.array([one(float(q)) for q in p])


def quantile_moments(z: np.ndarray, q: np.ndarray, nodes: int = 96) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, variance and skew of rows of quantiles at normal scores z, for all rows at once.

    Between scores the quantile function is the monotone cubic with weighted-harmonic slopes; outside
    it continues straight with the end slope (at least a small part of the average one).
    """
    q = np.sort(q, axis=1)
    h = np.diff(z)
    d = np.diff(q, axis=1) / h
    slope = np.zeros_like(q)
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        mid = (w1 + w2) / (w1 / d[:, :-1] + w2 / d[:, 1:])
    slope[:, 1:-1] = np.where(d[:, :-1] * d[:, 1:] > 0, mid, 0)

    def end(h0: float, h1: float, d0: np.ndarray, d1: np.ndarray) -> np.ndarray:
        e = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        e = np.where(np.sign(e) != np.sign(d0), 0, e)
        return np.where((np.sign(d0) != np.sign(d1)) & (np.abs(e) > 3 * np.abs(d0)), 3 * d0, e)

    slope[:, 0], slope[:, -1] = end(h[0], h[1], d[:, 0], d[:, 1]), end(h[-1], h[-2], d[:, -1], d[:, -2])
    least = 1e-3 * np.maximum(q[:, -1] - q[:, 0], 1e-10) / (z[-1] - z[0])
    tail0, tail1 = np.maximum(slope[:, 0], least), np.maximum(slope[:, -1], least)
    x, wt = np.polynomial.hermite.hermgauss(nodes)
    x, wt = math.sqrt(2) * x, wt / math.sqrt(math.pi)
    at = np.clip(np.searchsorted(z, x) - 1, 0, len(h) - 1)
    s = (x - z[at]) / h[at]
    inside = (q[:, at] * (1 + 2 * s) * (1 - s) ** 2 + slope[:, at] * h[at] * s * (1 - s) ** 2
              + q[:, at + 1] * s * s * (3 - 2 * s) + slope[:, at + 1] * h[at] * s * s * (s - 1))
    val = np.where(x < z[0], q[:, :1] + tail0[:, None] * (x - z[0]), np.where(x > z[-1], q[:, -1:] + tail1[:, None] * (x - z[-1]), inside))
    mean = val @ wt
    c = val - mean[:, None]
    var = (c**2) @ wt
    ok = var > 1e-10
    return mean, np.where(ok, var, np.nan), np.where(ok, (c**3) @ wt / np.where(ok, var, 1) ** 1.5, np.nan)


GARCH_STEP = np.array([0.01, 0.002, 0.002, 0.02])  # of log omega over the variance, alpha, beta and log degrees of freedom: the fit beats its neighbours at these steps
GARCH_LOW, GARCH_HIGH = np.array([math.log(1e-3), 0.0, 0.0, math.log(2.1)]), np.array([0.0, 0.5, 0.999, math.log(60.0)])


def student_constant(nu: float) -> float:
    """What minus twice the log density of a scaled Student-t has besides its logarithms of variance and square."""
    return 2 * (math.lgamma(nu / 2) - math.lgamma((nu + 1) / 2)) + math.log(math.pi * (nu - 2))


def garch_start(r: np.ndarray) -> float:
    """Variance before the first return: squares of the first 75, weighted by powers of 0.94."""
    weight = 0.94 ** np.arange(min(75, len(r)))
    return float(np.sum(r[: len(weight)] ** 2 * weight) / weight.sum())


def garch_losses(r: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minus twice the log likelihood of each point (rows of the four parameters), and the variance after the last return."""
    omega, al, be, dof = np.exp(points[:, 0]) * float(np.mean(r**2)), points[:, 1], points[:, 2], np.exp(points[:, 3])
    s2, total = np.full(len(points), garch_start(r)), np.zeros(len(points))
    for x in r:
        total += np.log(s2) + (dof + 1) * np.log1p(x * x / (s2 * (dof - 2)))
        s2 = omega + al * x * x + be * s2
    const = np.array([student_constant(v) for v in dof])
    return np.where(al + be < 1, total + len(r) * const, np.inf), s2


def garch_neighbours(point: np.ndarray) -> np.ndarray:
    """The point, and what lies a step up or down each parameter within the bounds."""
    around = [point] + [point + sign * step for step in np.diag(GARCH_STEP) for sign in (-1, 1)]
    return np.array([p for p in around if (p >= GARCH_LOW - 1e-12).all() and (p <= GARCH_HIGH + 1e-12).all() and p[1] + p[2] < 1])


def garch_fit(r: np.ndarray, horizon: int, rounds: int = 6) -> tuple[float, float, float, float, float, np.ndarray]:
    """GARCH(1,1) with Student-t errors on percent returns: (horizon variance, omega, alpha, beta, nu, point).

    All candidates of a round share one pass over the series; the box shrinks around the best for some rounds. Then a pattern of
    three values a parameter moves with its best cell, and halves its steps where that is the middle, down to ``GARCH_STEP``.
    """
    lo, hi = GARCH_LOW.copy(), GARCH_HIGH.copy()
    best, point, end = np.inf, (lo + hi) / 2, 0.0

    def better(axes) -> bool:
        nonlocal best, point, end
        points = np.stack([g.ravel() for g in np.meshgrid(*axes, indexing="ij")], 1)
        loss, s2 = garch_losses(r, points)
        i = int(np.argmin(loss))
        if loss[i] < best:
            best, point, end = float(loss[i]), points[i], float(s2[i])
            return True
        return False

    for k in range(rounds):
        better([np.linspace(a, b, m) for a, b, m in zip(lo, hi, (6, 6, 8, 4) if k == 0 else (5, 5, 5, 4))])
        half = (hi - lo) * 0.3
        lo, hi = np.maximum(point - half, GARCH_LOW), np.minimum(point + half, GARCH_HIGH)
    scale = 16.0
    while scale >= 1:
        step = GARCH_STEP * scale
        if not better([np.unique(np.clip([v - d, v, v + d], a, b)) for v, d, a, b in zip(point, step, GARCH_LOW, GARCH_HIGH)]):
            scale /= 2
    var = float(np.mean(r**2))
    omega, alpha, beta, nu = math.exp(point[0]) * var, point[1], point[2], math.exp(point[3])
    path, s2 = [], end
    for _ in range(horizon):
        path.append(s2)
        s2 = omega + (alpha + beta) * s2
    return float(np.mean(path)), omega, float(alpha), float(beta), nu, point


POINTS_AT_ONCE = 16384
STEPS_A_LOG = 8


def _garch_losses_of(series: list[np.ndarray], points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``garch_losses`` of several series, longest first, each at its own points (series, points, parameters).

    Factors of the likelihood are multiplied over a few steps before a logarithm is taken.
    """
    sizes = np.array([len(r) for r in series])
    omega, al, be, dof = np.exp(points[:, :, 0]) * np.array([float(np.mean(r**2)) for r in series])[:, None], points[:, :, 1].copy(), points[:, :, 2].copy(), np.exp(points[:, :, 3])
    k = dof - 2
    s2 = np.repeat(np.array([garch_start(r) for r in series])[:, None], points.shape[1], axis=1)
    total, wide, low, t = np.zeros_like(s2), np.ones_like(s2), np.ones_like(s2), np.empty_like(s2)
    squares = np.zeros((sizes[0], len(series)))
    for i, r in enumerate(series):
        squares[: len(r), i] = r * r
    left = [int((sizes > at).sum()) for at in range(sizes[0])]
    with np.errstate(all="ignore"):
        for at, m in enumerate(left):
            if at == 0 or m != left[at - 1]:
                s, u, a, b, o, scaled, above, below, xs = s2[:m], t[:m], al[:m], be[:m], omega[:m], k[:m], wide[:m], low[:m], squares[:, :m, None]
            xx = xs[at]
            np.multiply(s, scaled, u)
            np.add(u, xx, u)
            np.multiply(above, u, above)
            np.multiply(below, s, below)
            np.multiply(s, b, s)
            np.multiply(a, xx, u)
            np.add(s, u, s)
            np.add(s, o, s)
            if at % STEPS_A_LOG == STEPS_A_LOG - 1 or at == sizes[0] - 1:
                total += (dof + 1) * np.log(wide) - dof * np.log(low)
                wide[:], low[:] = 1.0, 1.0
        known = {v: student_constant(v) for v in np.unique(dof)}
        const = np.vectorize(known.__getitem__, otypes=[float])(dof) - (dof + 1) * np.log(k)
        return np.where(al + be < 1, total + sizes[:, None] * const, np.inf), s2


def _grids(axes: list[np.ndarray]) -> np.ndarray:
    """(series, points, parameters) from one (series, values) array per parameter, the last one running fastest."""
    full = [len(axes[0]), *[a.shape[1] for a in axes]]
    spread = [np.broadcast_to(a.reshape([len(a), *[a.shape[1] if i == j else 1 for i in range(len(axes))]]), full) for j, a in enumerate(axes)]
    return np.stack([g.reshape(full[0], -1) for g in spread], 2)


def garch_fits(series: list[np.ndarray], horizon: int, rounds: int = 6) -> list[tuple[float, float, float, float, float, np.ndarray]]:
    """``garch_fit`` of many series: the same search, with the candidates of several series in one pass."""
    if not series:
        return []
    order = sorted(range(len(series)), key=lambda i: -len(series[i]))
    rs = [np.asarray(series[i], float) for i in order]
    count = len(rs)
    lo, hi = np.tile(GARCH_LOW, (count, 1)), np.tile(GARCH_HIGH, (count, 1))
    best, point, end = np.full(count, np.inf), (lo + hi) / 2, np.zeros(count)

    def better(ids: np.ndarray, axes: list[np.ndarray]) -> np.ndarray:
        hit = np.zeros(len(ids), bool)
        some = max(1, POINTS_AT_ONCE // math.prod(a.shape[1] for a in axes))
        for at in range(0, len(ids), some):
            own = ids[at : at + some]
            grid = _grids([a[at : at + some] for a in axes])
            loss, s2 = _garch_losses_of([rs[i] for i in own], grid)
            i, rows = np.argmin(loss, axis=1), np.arange(len(own))
            won = loss[rows, i] < best[own]
            took = own[won]
            best[took], point[took], end[took] = loss[rows, i][won], grid[rows, i][won], s2[rows, i][won]
            hit[at : at + some] = won
        return hit

    every = np.arange(count)
    for k in range(rounds):
        better(every, [np.linspace(lo[:, j], hi[:, j], m, axis=1) for j, m in enumerate((6, 6, 8, 4) if k == 0 else (5, 5, 5, 4))])
        half = (hi - lo) * 0.3
        lo, hi = np.maximum(point - half, GARCH_LOW), np.minimum(point + half, GARCH_HIGH)
    scale = np.full(count, 16.0)
    while (scale >= 1).any():
        ids = np.flatnonzero(scale >= 1)
        step = GARCH_STEP * scale[ids, None]
        hit = better(ids, [np.stack([np.clip(point[ids, j] + side * step[:, j], GARCH_LOW[j], GARCH_HIGH[j]) for side in (-1, 0, 1)], 1) for j in range(4)])
        scale[ids[~hit]] /= 2
    out: list = [None] * count
    for i, r in enumerate(rs):
        omega, alpha, beta, nu = math.exp(point[i, 0]) * float(np.mean(r**2)), point[i, 1], point[i, 2], math.exp(point[i, 3])
        path, s2 = [], end[i]
        for _ in range(horizon):
            path.append(s2)
            s2 = omega + (alpha + beta) * s2
        out[order[i]] = (float(np.mean(path)), omega, float(alpha), float(beta), nu, point[i].copy())
    return out


# MacKinnon (1994) response surface for one series with a constant.
ADF_SMALL, ADF_LARGE = (2.1659, 1.4412, 3.8269e-2), (1.7339, 9.3202e-1, -1.2745e-1, -1.0368e-2)
ADF_MIN, ADF_STAR, ADF_MAX = -18.83, -1.61, 2.74


def adf_pvalue(y: np.ndarray) -> tuple[float, float, int]:
    """Augmented Dickey-Fuller statistic (constant, lags by AIC on a common sample), p-value and lag."""
    n = len(y)
    most = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    d = np.diff(y)

    def fit(lag: int, skip: int) -> tuple[float, float]:
        rows = np.arange(skip, len(d))
        x = np.column_stack([y[rows], *[d[rows - i] for i in range(1, lag + 1)], np.ones(len(rows))])
        q, r = np.linalg.qr(x)
        beta = np.linalg.solve(r, q.T @ d[rows])
        res = d[rows] - x @ beta
        rss = float(res @ res)
        inv = np.linalg.inv(r)
        se = math.sqrt(rss / (len(rows) - x.shape[1]) * float(inv[0] @ inv[0]))
        return len(rows) * math.log(rss / len(rows)) + 2 * x.shape[1], float(beta[0]) / se

    lag = min(range(most + 1), key=lambda k: fit(k, most)[0])
    stat = fit(lag, lag)[1]
    return stat, dickey_fuller_p(stat), lag


def dickey_fuller_p(stat: float) -> float:
    if stat > ADF_MAX:
        return 1.0
    if stat < ADF_MIN:
        return 0.0
    coef = ADF_SMALL if stat <= ADF_STAR else ADF_LARGE
    z = sum(c * stat**i for i, c in enumerate(coef))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def nested_unit_root(rows: int, own: np.ndarray, level: np.ndarray, plain: np.ndarray, levels: float, squares: float, head: np.ndarray, head_level: np.ndarray,
                     tail: np.ndarray) -> tuple[float, float, int]:
    """``adf_pvalue`` from sums over the ``rows`` changes that have all lags behind them.

    ``own[k]``, ``level[k]`` and ``plain[k]`` sum the change k sessions back times the change, times the level before it, and alone;
    ``levels`` and ``squares`` sum that level and its square. The products of two lags are those of the lags one shorter, shifted by
    one session, so that they follow from ``head`` and ``tail``, the first and last changes. One Cholesky factor of the products of
    (constant, level, lag 1, lag 2, ...) holds the factor of every shorter order, hence the squared residuals of all orders at once.
    """
    most = len(own) - 1
    lags = np.empty((most + 1, most + 1))
    lags[0], lags[:, 0] = own, own
    for i in range(most):
        lags[i + 1, 1:] = lags[i, :-1] + head[most - 1 - i] * head[::-1] - tail[most - 1 - i] * tail[::-1]
    size = most + 3
    gram = np.empty((size, size))  # constant, level, lags from 1, and the change itself last
    order = [*range(1, most + 1), 0]
    gram[2:, 2:] = lags[np.ix_(order, order)]
    gram[0, 2:] = gram[2:, 0] = plain[order]
    gram[1, 2:] = gram[2:, 1] = level[order]
    gram[:2, :2] = [[rows, levels], [levels, squares]]
    unit = np.sqrt(np.diag(gram))
    scaled = gram / np.outer(unit, unit)
    root = np.linalg.cholesky(scaled[:-1, :-1])
    along = np.linalg.solve(root, scaled[:-1, -1])
    rss = unit[-1] ** 2 * (1 - np.cumsum(along**2))[1:]
    if rss.min() <= 1e-13 * unit[-1] ** 2:
        raise ValueError("the lags explain the changes exactly")
    lag = int(np.argmin(rows * np.log(rss / rows) + 2 * (np.arange(most + 1) + 2)))
    # The chosen order is fitted on all changes that have its own lags behind them.
    keep = [0, *range(2, 2 + lag), 1, size - 1]
    final, more = gram[np.ix_(keep, keep)], most - lag
    early = [[1.0, *head[t - 1 :: -1][:lag], head_level[t], head[t]] if lag else [1.0, head_level[t], head[t]] for t in range(lag, most)]
    if early:
        final = final + np.array(early).T @ np.array(early)
    unit = np.sqrt(np.diag(final))
    root = np.linalg.cholesky(final / np.outer(unit, unit))
    # The last two rows of the factor: what is left of level and change beside all other columns.
    slope, left = root[-1, -2], root[-1, -1]
    stat = slope / left * math.sqrt(rows + more - (lag + 2))
    return float(stat), dickey_fuller_p(float(stat)), lag
