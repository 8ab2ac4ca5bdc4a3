"""Fits that carry their own proof: duals of quantile regressions, likelihoods around GARCH fits, ridge moments by key."""

import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidewright.functions import fits
from tidewright.operators import estimators as es


DAY = dt.date(2020, 1, 1)


def training(spark, n=120):
    rng = random.Random(4)
    rows = []
    for s in ("A", "B"):
        for i in range(n):
            a = rng.gauss(0, 1)
            rows.append((s, 0, a, 5.0, 0.5 * a + rng.gauss(0, 1) * (1 + 0.3 * abs(a))))
    rows += [("tiny", 0, float(i), 5.0, float(i)) for i in range(4)]
    return spark.createDataFrame(rows, "symbol string, refit long, a double, flat double, y double")


def test_duals_prove_a_quantile_fit_and_refuse_another(spark):
    train = training(spark)
    models = es.fit_quantiles(train, ["a", "flat"], "y")
    duals = es.quantile_duals(train, ["a", "flat"], "y").checkpoint()
    good = es.quantile_certificate(duals, models, ["a", "flat"]).collect()
    assert len(good) == 14 and all(r.inside_box and r.stationary and r.gap_closed and r.n_train == 120 for r in good)
    moved = models.withColumn("coefficients", F.transform("coefficients", lambda c: c + 0.05))
    assert not any(r.gap_closed for r in es.quantile_certificate(duals, moved, ["a", "flat"]).collect())
    raised = duals.withColumn("dual", F.col("dual") + 0.01)
    assert not any(r.stationary for r in es.quantile_certificate(raised, models, ["a", "flat"]).collect())


def test_duals_lie_below_every_loss():
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(200), rng.normal(size=(200, 2))])
    y = x @ [0.1, 0.5, 0.0] + rng.standard_t(3, 200)
    for tau in (0.1, 0.5, 0.9):
        beta, dual = fits.quantile_solution(x, y, tau, 0.01)
        bound = float(dual @ y) / 200
        assert math.isclose(fits.check_objective(x, y, beta, tau, 0.01), bound, rel_tol=1e-7)
        assert all(fits.check_objective(x, y, beta + rng.normal(0, 0.1, 3), tau, 0.01) >= bound - 1e-9 for _ in range(20))


def bars(spark, n=150):
    rng = np.random.default_rng(5)
    rows = []
    for s, (omega, alpha, beta) in {"A": (0.1, 0.1, 0.8), "B": (0.5, 0.05, 0.3)}.items():
        price, s2 = 100.0, 1.0
        for i in range(n):
            r = math.sqrt(s2) * rng.standard_t(6) * math.sqrt(4 / 6)
            s2 = omega + alpha * r * r + beta * s2
            price *= math.exp(r / 100)
            rows.append((s, i, price))
    rows += [("short", i, 100.0 + i) for i in range(20)] + [("flat", i, 50.0) for i in range(100)]
    return spark.createDataFrame(rows, "symbol string, ts long, close double")


def test_likelihood_by_the_scan_is_the_loop(spark):
    b = bars(spark)
    points = es.garch_points(b).checkpoint()
    got = {(r.symbol, r.point): (r.n, r.loss) for r in es.garch_likelihood(b, points).collect()}
    assert {s for s, _ in got} == {"A", "B"}
    data = b.toPandas()
    for s in ("A", "B"):
        x = np.diff(np.log(data[data.symbol == s].sort_values("ts").close.to_numpy())) * 100
        point = fits.garch_fit(x, 21)[5]
        near = fits.garch_neighbours(point)
        loss, _ = fits.garch_losses(x, near)
        assert all(math.isclose(got[s, k][1], v, rel_tol=1e-9) for k, v in enumerate(loss)) and got[s, 0][0] == 149
        assert loss[0] <= loss.min() + 1e-9 and len(near) >= 6


def test_ridge_of_far_apart_keys_and_small_ones(spark):
    rng = random.Random(1)
    rows = []
    for k, level in (("far", 1e9), ("near", 0.0)):
        for _ in range(200):
            x = rng.gauss(0, 1)
            rows.append((k, level + x, level * 2 + 3 * x + rng.gauss(0, 0.01)))
    rows += [("few", float(i), float(i)) for i in range(5)] + [("none", None, 1.0), ("near", float("nan"), 1.0)]
    got = {r.k: r for r in es.ridge_fits(spark.createDataFrame(rows, "k string, x double, y double"), "k", ["x"], "y", ridge=0.0).collect()}
    assert set(got) == {"far", "near", "few", "none"} and got["few"].error == "5 rows" and got["none"].error == "0 rows" and got["few"].coefficients is None
    assert abs(got["far"].coefficients[0] - 3) < 0.01 and abs(got["near"].coefficients[0] - 3) < 0.01 and got["near"].n_train == 200


def test_short_histories_come_back_with_a_reason(spark):
    from tidewright.operators import diagnostics as dg

    b = bars(spark)
    for found, known in ((dg.rescaled_range_hurst(b), {"A", "B"}), (dg.half_life(b), {"A", "B", "flat"}), (dg.point_rough_vol(dg.realized_vol(b)), {"A", "B"})):
        got = {r.symbol: r.error for r in dg.with_reasons(b, found).collect()}
        assert set(got) == {"A", "B", "short", "flat"} and {s for s, e in got.items() if e is None} <= known | {"flat"}
        assert got["short"] == "no estimate from 20 sessions" and got["A"] is None


def test_unit_roots_from_sums_equal_regressions_order_by_order(spark):
    rng = np.random.default_rng(8)
    series = {"walk": 100 + np.cumsum(rng.normal(size=400)), "short": np.arange(59.0), "flat": np.full(80, 3.0), "single": np.array([1.0])}
    back = [0.0, 0.0, 0.0]
    for e in rng.normal(size=300):
        back.append(0.5 * back[-1] + 0.3 * back[-3] + e)
    series["reverting"] = 1e4 + np.array(back)
    series["least"] = rng.normal(size=60)
    rows = [(s, i, float(v)) for s, y in series.items() for i, v in enumerate(y)] + [("walk", 1000, None), ("walk", 1001, math.nan)]
    got = {r.symbol: r for r in es.unit_root(spark.createDataFrame(rows, "symbol string, ts long, close double").repartition(5)).collect()}
    assert set(got) == set(series)
    for s in ("walk", "reverting", "least"):
        stat, p, lag = fits.adf_pvalue(series[s])
        assert got[s].lags == lag and abs(got[s].adf_statistic - stat) < 1e-7 and abs(got[s].adf_pvalue - p) < 1e-7 and got[s].error is None
    assert (got["short"].error, got["flat"].error, got["single"].error) == ("59 sessions", "no change", "1 sessions")
    assert got["flat"].lags is None and got["flat"].adf_pvalue is None
    empty = spark.createDataFrame([], "symbol string, ts long, close double")
    assert es.unit_root(empty).count() == 0


def test_packed_quantile_fits_are_the_single_ones(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(3, 40, 2)), rng.normal(size=(3, 40))
    z = np.concatenate([np.ones((3, 40, 1)), x], 2)
    beta, dual = fits.quantile_solutions(z, y, [0.1, 0.5, 0.9], 0.01)
    for i in range(3):
        for j, tau in enumerate((0.1, 0.5, 0.9)):
            one, proof = fits.quantile_solution(z[i], y[i], tau, 0.01)
            assert np.allclose(beta[i, j], one, atol=1e-8) and np.allclose(dual[i, j], proof, atol=1e-6)
    rows = [(s, DAY + dt.timedelta(days=i), float(rng.normal()), 0.0, float(rng.normal())) for s in "AB" for i in range(70 if s == "A" else 12)]
    df = spark.createDataFrame(rows, "symbol string, ts date, a double, flat double, y double")
    packed = es.packed_training(df, ["a", "flat"], "y", 5, 20, 10).checkpoint()
    sizes = {(r.symbol, r.refit): len(r.rows) for r in packed.collect()}
    plain = {(r.symbol, r.refit): r["count"] for r in es.training_rows(df, 5, 20, 10).groupBy("symbol", "refit").count().collect()}
    assert sizes == plain and sizes["B", 10] == 5 and sizes["A", 70] == 20
    fitted = es.fit_packed(packed, ["a", "flat"], "y", proofs=True).checkpoint()
    assert {(r.symbol, r.refit): r.error for r in fitted.collect()}["B", 10] == "5 rows for 1 features"
    proved = es.packed_certificate(fitted, ["a", "flat"], "y").collect()
    assert len(proved) == 6 * 7 and all(r.inside_box and r.stationary and r.gap_closed for r in proved)
    moved = fitted.withColumn("fits", F.transform("fits", lambda f: f.withField("intercept", f["intercept"] + 0.05)))
    assert not any(r.gap_closed for r in es.packed_certificate(moved, ["a", "flat"], "y").collect())


def test_quantile_fits_close_their_gap_in_few_steps():
    rng = np.random.default_rng(6)
    taus = [0.05, 0.25, 0.5, 0.95]
    z = np.concatenate([np.ones((4, 250, 1)), rng.normal(size=(4, 250, 2))], 2)
    y = rng.normal(size=(4, 250))
    y[3] = np.round(y[3])  # ties; these fits are done at other steps than the rest, and wait unchanged
    beta, dual = fits.quantile_solutions(z, y, taus, 0.001, steps=20)
    proof = fits.quantile_proofs(z[:, :, 1:], y, taus, beta[:, :, 0], beta[:, :, 1:], dual)
    size = np.abs(beta[:, :, 1:]).sum(axis=2)  # the kernel's penalty, on columns as it got them
    assert np.all(proof["loss"] + 250 * 0.001 * size - proof["dual"] <= 1e-8 * proof["scale"])
    assert np.all(proof["low"] >= np.array(taus) - 1 - 1e-9) and np.all(proof["high"] <= np.array(taus) + 1e-9) and np.all(np.abs(proof["zero"]) < 1e-8)


def test_sums_of_a_proof_are_those_of_its_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(s, DAY + dt.timedelta(days=i), float(rng.normal()), 0.0, float(rng.normal())) for s in "AB" for i in range(70 if s == "A" else 12)]
    packed = es.packed_training(spark.createDataFrame(rows, "symbol string, ts date, a double, flat double, y double"), ["a", "flat"], "y", 5, 20, 10).checkpoint()
    few = es.fit_packed(packed, ["a", "flat"], "y", sums=True)
    assert "rows" not in few.columns and "dual:array" not in few.schema.simpleString()  # nothing of a row's size leaves the fit
    order = lambda df: sorted(tuple(r) for r in df.collect())
    assert order(es.packed_certificate(few, ["a", "flat"], "y")) == order(es.packed_certificate(es.fit_packed(packed, ["a", "flat"], "y", proofs=True), ["a", "flat"], "y"))
    moved = few.withColumn("fits", F.transform("fits", lambda f: f.withField("loss", f["loss"] + 0.05)))
    assert not any(r.gap_closed for r in es.packed_certificate(moved, ["a", "flat"], "y").collect())


def test_rescaled_range_keeps_a_series_in_one_row(spark):
    from tidewright.operators import diagnostics as dg

    b = bars(spark, 420)
    plan = dg.rescaled_range_hurst(b)._jdf.queryExecution().executedPlan().toString()
    assert "chunk" not in plan and "lag#" not in plan.split("MapInArrow")[-1]
    held = dg.held_hurst(b.withColumn("open", F.col("close")), 401)
    got = {r.ts: r.hurst for r in held.filter("symbol = 'A'").collect()}
    series = b.filter("symbol = 'A'")
    for at in (401, 420):
        own = dg.rescaled_range_hurst(series.filter(F.col("ts").between(at - 401, at - 1))).first()
        assert math.isclose(got[at - 1], own.hurst, rel_tol=1e-9)
    assert got[399] is None and got[410] == got[400]


def test_garch_fits_of_many_series_are_the_single_ones():
    rng = np.random.default_rng(8)
    series = [rng.standard_t(5, n) * (1 + i) for i, n in enumerate((90, 60, 75))]
    for x, got in zip(series, fits.garch_fits(series, 21)):
        assert np.allclose(got[:5], fits.garch_fit(x, 21)[:5], rtol=1e-9) and np.allclose(got[5], fits.garch_fit(x, 21)[5])
    assert fits.garch_fits([], 21) == []
