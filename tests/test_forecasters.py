"""The walk-forward evaluator against plain loops, with a forecaster of one's own."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidewright.functions import fits
from tidewright.operators import estimators as es
from tidewright.operators import forecasters as fc


class LastSeen:
    """Says the last position that it learned from, so that leaks show."""

    name, quantile_levels = "last_seen", [0.5]

    def fit(self, train, features, target):
        return train.groupBy("symbol", "refit").agg(F.count("*").alias("n_train"), F.max("at").alias("model"), F.lit(None).cast("string").alias("error"))

    def predict_quantiles(self, model, x):
        return F.array(model + 0 * x[0])


def rows(spark, n=150):
    rng, out = random.Random(3), []
    for s in ("A", "B"):
        for i in range(n):
            a = rng.gauss(0, 1)
            out.append((s, i, float(i + 1), a, 0.4 * a + rng.gauss(0, 1)))
    out += [("tiny", i, float(i + 1), 0.1 * i, 1.0) for i in range(8)] + [("A", n + 1, None, 0.0, 1.0), ("A", n + 2, 1.0, 0.0, None)]
    return spark.createDataFrame(out, "symbol string, ts long, at double, a double, y double")


def test_forecasts_learn_only_from_outcomes_that_are_known(spark):
    got = fc.walk_forward(rows(spark), [LastSeen()], ["at"], "y", 5, 40, 20).collect()
    assert {r.symbol for r in got} == {"A", "B"} and len(got) == 2 * (150 - 19)
    for r in got:
        assert r.refit == (r.ts + 1) // 20 * 20 and r.quantile == r.refit - 5 and r.forecaster == "last_seen"


def test_each_forecaster_equals_its_loop(spark):
    data = rows(spark)
    models = [fc.RandomWalk(), fc.Climatology(), fc.Ridge(), fc.QuantileRegression()]
    table = fc.walk_forward(data, models, ["a"], "y", 5, 40, 20).checkpoint()
    got = {(r.forecaster, r.symbol, r.ts, r.level): r for r in table.collect()}
    z = fits.normal_ppf(np.array(es.LEVELS))
    plain = [r for r in data.collect() if r.symbol == "B"]
    a, y = np.array([r.a for r in plain]), np.array([r.y for r in plain])
    for at in (19, 60, 149):
        refit = (at + 1) // 20 * 20
        part = slice(max(0, refit - 5 - 40), refit - 5)
        ta, ty = a[part], y[part]
        u = (ta - ta.mean()) / ta.std()
        beta = u @ (ty - ty.mean()) / (u @ u + 1)
        spread = np.std(ty - ty.mean() - beta * u, ddof=1)
        fit = fits.quantile_fit(np.column_stack([np.ones(len(u)), u]), ty, 0.5, 0.001)
        for i, level in enumerate(es.LEVELS):
            assert abs(got["random_walk", "B", at, level].quantile - z[i] * np.sqrt(np.mean(ty**2))) < 1e-9
            base = np.quantile(ty, level)
            assert abs(got["climatology", "B", at, level].quantile - base) < 1e-9 and abs(got["ridge", "B", at, level].base_quantile - base) < 1e-9
            assert abs(got["ridge", "B", at, level].quantile - (ty.mean() + beta * (a[at] - ta.mean()) / ta.std() + z[i] * spread)) < 1e-9
        assert abs(got["quantile_regression", "B", at, 0.5].quantile - (fit[0] + fit[1] * (a[at] - ta.mean()) / ta.std())) < 1e-6
    assert all(r.symbol != "tiny" for r in got.values())
    report = {(r.forecaster, r.symbol, r.level): r for r in fc.scored(table, 5).collect()}
    assert len(report) == 4 * 2 * 7 and report["climatology", "A", 0.5].skill == 0
    assert (report["ridge", "B", 0.5].n, report["ridge", "A", 0.5].n) == (131, 132)  # A has one more row whose "a" and "y" are known
    assert report["ridge", "B", 0.5].skill > report["random_walk", "B", 0.5].skill


def test_empty_rows_give_no_forecasts(spark):
    assert fc.walk_forward(rows(spark).limit(0), [fc.RandomWalk(), fc.Ridge()], ["a"], "y", 5, 40, 20).count() == 0
