"""Networks and joint boosting trained over blocks, against plain NumPy."""

import math
import random

import numpy as np
import pytest

from tidewright.operators import boosting as bo
from tidewright.operators import network as nw
from tidewright.operators import training as tr

FEATURES = ["a", "b", "c"]


def rows(n=400, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = (rng.gauss(0, 1) for _ in FEATURES)
        y = 2 if a + 0.3 * rng.gauss(0, 1) > 0.6 else 0 if b > 0.4 else 1
        out.append((f"s{i % 3}", i, a, b, c, y, "train" if i < 0.6 * n else "validation" if i < 0.8 * n else "test"))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "symbol string, ts long, a double, b double, c double, signal int, split string")


def plain(data, split):
    some = sorted(r for r in data if r[6] == split and None not in r)
    return np.array([r[2:5] for r in some]), np.array([r[5] for r in some], float), np.ones(len(some))


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(40, 3)), rng.integers(0, 3, 40).astype(float), rng.uniform(0.5, 2, 40)
    theta = nw.initial(3, 3, 7) + rng.normal(0, 0.1, len(nw.initial(3, 3, 7)))
    loss, grad, _ = nw.gradient(theta, x, y, w, 3, w.sum(), None)
    for k in rng.choice(len(theta), 60, replace=False):
        step = np.zeros(len(theta))
        step[k] = 1e-5
        slope = (nw.gradient(theta + step, x, y, w, 3, w.sum(), None)[0] - nw.gradient(theta - step, x, y, w, 3, w.sum(), None)[0]) / 2e-5
        assert math.isclose(slope, grad[k], rel_tol=1e-3, abs_tol=1e-6)


def test_one_block_is_plain_training(spark):
    data = rows()
    blocks = tr.packed(frame(spark, data), FEATURES, "signal", ["symbol", "ts"])
    model = nw.fit_network(blocks, FEATURES, epochs=12, every=5, rate=0.01, seed=3)
    x, y, w = plain(data, "train")
    theta, running = nw.initial(3, 3, 3), np.concatenate([np.full(h, float(k)) for h in nw.HIDDEN for k in (0, 1)])
    m, v, best = np.zeros(len(theta)), np.zeros(len(theta)), (-1.0, None)
    vx, vy, _ = plain(data, "validation")
    for epoch in range(12):
        _, g, stats = nw.gradient(theta, x, y, w, 3, w.sum(), np.random.default_rng((3, epoch, 0)))
        g = g + 1e-4 * theta
        running = 0.9 * running + 0.1 * stats
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.01 * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.999 ** (epoch + 1))) + 1e-8)
        if epoch in (0, 5, 10, 11):
            cells = np.zeros((3, 3))
            np.add.at(cells, (vy.astype(int), nw.forward(theta, running, vx, 3).argmax(1)), 1)
            best = max(best, (tr.macro_f1(cells), theta.tolist()), key=lambda b: b[0])
    assert [h[0] for h in model.history] == [0, 5, 10, 11]
    assert math.isclose(best[0], model.best_f1) and np.allclose(best[1], model.theta, atol=1e-9)


def test_training_stops_by_itself_and_can_be_stored(spark, tmp_path):
    data = rows(900)
    df = frame(spark, data)
    blocks = tr.packed(df, FEATURES, "signal", ["symbol", "ts"], block_rows=100)
    assert blocks.filter("split = 'train'").count() > 3
    model = nw.fit_network(blocks, FEATURES, epochs=400, patience=30, rate=0.02, save_to=str(tmp_path / "net"))
    assert model.epoch < 399 and model.history[-1][1] < 0.7 * model.history[0][1] and model.best_f1 > 0.7
    again = nw.Network.load(spark, str(tmp_path / "net"))
    assert np.allclose(again.theta, model.theta) and again.best_f1 == model.best_f1
    test = df.filter("split = 'test'")
    got = nw.with_own_probabilities(nw.with_probabilities(test, nw.weights_table(again, spark), FEATURES), model).collect()
    assert all(abs(r[f"p_{c}"] - r.own[c]) < 1e-9 for r in got for c in range(3)) and all(r.prediction == int(np.argmax(r.own)) for r in got)
    assert sum(r.prediction == r.signal for r in got) > 0.8 * len(got)


def test_sums_do_not_depend_on_how_they_are_added(spark, monkeypatch):
    blocks = tr.packed(frame(spark, rows()), FEATURES, "signal", ["symbol", "ts"], block_rows=20).filter("split = 'train'")
    part = lambda split, block, x, y, w: np.array([len(y), x[:, 0].sum()])
    count = blocks.count()
    whole = tr.summed(blocks, count, part, 2)
    monkeypatch.setattr(tr, "FAN", 3)
    assert count > 9 and np.allclose(tr.summed(blocks, count, part, 2), whole) and whole[0] == 240
    assert np.allclose(whole[1], plain(rows(), "train")[0][:, 0].sum())


def test_unknown_values_and_empty_parts(spark):
    data = rows(60)
    holes = [("x", 1, None, 0.0, 0.0, 1, "train"), ("x", 2, 0.0, 0.0, 0.0, None, "train")]
    blocks = tr.packed(frame(spark, data + holes), FEATURES, "signal", ["symbol", "ts"])
    assert {r.split: r.rows for r in blocks.collect()} == {"train": 36, "validation": 12, "test": 12}
    no_check = blocks.filter("split = 'train'")
    assert len(nw.fit_network(no_check, FEATURES, epochs=3, every=1).history) == 3
    assert bo.fit_boosted(no_check, FEATURES, [[0.0]] * 3, rounds=2).best == 2
    nothing = blocks.filter("split = 'test'")
    assert nw.fit_network(nothing, FEATURES).history == [] and bo.fit_boosted(nothing, FEATURES, [[]] * 3).rounds == []
    got = bo.scored(frame(spark, data[:2] + holes[:1]), bo.fit_boosted(nothing, FEATURES, [[]] * 3).table(spark), FEATURES).collect()
    assert [r.prediction for r in got] == [0, 0, None] and got[2].p_1 is None and abs(got[0].p_1 - 1 / 3) < 1e-12


def test_boosted_trees_against_a_plain_search(spark):
    """Without drawing rows or columns each round must take the best split of each open node."""
    data = rows()
    df = frame(spark, data)
    edges = bo.bin_edges(df, FEATURES, 8)
    x, y, _ = plain(data, "train")
    assert np.allclose(edges[0], np.quantile(x[:, 0], [k / 8 for k in range(1, 8)]))
    blocks = tr.packed(df, FEATURES, "signal", ["symbol", "ts"], block_rows=70)
    model = bo.fit_boosted(blocks, FEATURES, edges, rounds=3, depth=2, rate=0.5, subsample=1.0, columns=1.0)
    margin = np.zeros((len(y), 3))

    def grow(at, node, tree, g, h, level):
        total = g[at].sum(), h[at].sum()
        score = lambda part: g[part].sum() ** 2 / (h[part].sum() + 1)
        best = (0.0, None)
        for f in range(3) if level < 2 else ():
            for e in edges[f]:
                left, right = at & (x[:, f] <= e), at & (x[:, f] > e)
                gain = 0.5 * (score(left) + score(right) - score(at))
                if h[left].sum() >= 1 and h[right].sum() >= 1 and gain > best[0] + 1e-9:
                    best = (gain, (f, e, left, right))
        if best[1] is None:
            tree[node] = (None, -0.5 * total[0] / (total[1] + 1), at)
        else:
            f, e, left, right = best[1]
            tree[node] = (f, e, None)
            grow(left, 2 * node, tree, g, h, level + 1)
            grow(right, 2 * node + 1, tree, g, h, level + 1)

    for r in range(3):
        p = np.exp(margin) / np.exp(margin).sum(1, keepdims=True)
        step = np.zeros_like(margin)
        for c in range(3):
            tree: dict = {}
            grow(np.ones(len(y), bool), 1, tree, p[:, c] - (y == c), 2 * p[:, c] * (1 - p[:, c]), 0)
            got = model.rounds[r][c]
            assert set(got) == set(tree)
            for node, (f, v, at) in tree.items():
                if f is None:
                    assert got[node][0] < 0 and math.isclose(got[node][2], v, rel_tol=1e-9)
                    step[at, c] = v
                else:
                    assert got[node][0] == f and edges[f][got[node][1]] == v
        margin += step


def test_boosting_stops_and_scores_alike(spark, tmp_path):
    data = rows(900)
    df = frame(spark, data)
    blocks = tr.packed(df, FEATURES, "signal", ["symbol", "ts"], block_rows=200)
    edges = bo.bin_edges(df, FEATURES, 16)
    model = bo.fit_boosted(blocks, FEATURES, edges, rounds=60, depth=3, rate=0.4, patience=4)
    same = bo.fit_boosted(blocks.repartition(3), FEATURES, edges, rounds=60, depth=3, rate=0.4, patience=4)
    assert model.rounds == same.rounds and model.best == int(np.argmin(model.losses)) < 60 and len(model.losses) == model.best + 5
    model.save(spark, str(tmp_path / "trees"))
    nodes = spark.read.parquet(str(tmp_path / "trees"))
    test = df.filter("split = 'test'")
    got = {r.ts: r for r in bo.scored(test, nodes, FEATURES, depth=3).collect()}
    for r in bo.walked(test, nodes, ["ts"], FEATURES, depth=3).groupBy("ts").pivot("class", [0, 1, 2]).sum("margin").collect():
        p = bo._softmax(np.array([r[1:]]))[0]
        assert all(math.isclose(p[c], got[r.ts][f"p_{c}"], rel_tol=1e-9) for c in range(3))
    assert sum(r.prediction == r.signal for r in got.values()) > 0.85 * len(got)
    shares = bo.gains(nodes).collect()
    assert math.isclose(sum(r.importance for r in shares), 1.0) and {r.feature for r in shares} <= set(FEATURES)


@pytest.mark.parametrize("cells, want", [([[1, 0], [0, 1]], 1.0), ([[0, 2], [0, 2]], (2 * 2 / 6) / 2), ([[0, 0], [0, 0]], 0.0)])
def test_macro_f1(cells, want):
    assert math.isclose(tr.macro_f1(np.array(cells)), want)
