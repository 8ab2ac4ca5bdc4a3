"""Forecasters behind one walk-forward evaluator.

A forecaster has a ``name``, ``quantile_levels``, ``fit(train, features, target)`` and ``predict_quantiles(model, x)``. ``fit`` gets the
rows of every (symbol, refit) at once and returns one row for each: (symbol, refit, n_train, model, error), where ``model`` is any
column and ``error`` says why there is none. ``predict_quantiles`` is a column: the sorted quantiles of a row from its model and its
array of features. So all fits of all symbols run as one grouped job, and forecasting is a join and an expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import fits
from tidewright.functions.nulls import drop_unknown
from tidewright.operators import estimators as es
from tidewright.operators import stats
from tidewright.operators import windows as win
from tidewright.operators.asof import asof_join
from tidewright.session import checkpointed

KEY = ["symbol", "refit"]
MIN_ROWS = 10


def _scores(levels: list[float]) -> list[float]:
    return [float(v) for v in fits.normal_ppf(np.array(levels))]


def _few(n: str = "n_train") -> Column:
    return F.when(F.col(n) < MIN_ROWS, F.concat(F.col(n).cast("string"), F.lit(" rows")))


@dataclass
class RandomWalk:
    """No drift: normal quantiles around zero, as wide as the outcomes' root mean square."""

    name: str = "random_walk"
    quantile_levels: list[float] = field(default_factory=lambda: list(es.LEVELS))

    def fit(self, train: DataFrame, features: list[str], target: str) -> DataFrame:
        g = train.groupBy(*KEY).agg(F.count("*").alias("n_train"), F.sqrt(F.avg(F.col(target) * F.col(target))).alias("spread"))
        return g.select(*KEY, "n_train", F.when(F.col("n_train") >= MIN_ROWS, F.col("spread")).alias("model"), _few().alias("error"))

    def predict_quantiles(self, model: Column, x: Column) -> Column:
        return F.array_sort(F.array(*[model * z for z in _scores(self.quantile_levels)]))


@dataclass
class Climatology:
    """The outcomes' own quantiles, whatever the features say: the baseline of every skill."""

    name: str = "climatology"
    quantile_levels: list[float] = field(default_factory=lambda: list(es.LEVELS))

    def fit(self, train: DataFrame, features: list[str], target: str) -> DataFrame:
        levels = F.array(*[F.lit(float(v)) for v in self.quantile_levels])
        g = train.groupBy(*KEY).agg(F.count("*").alias("n_train"), F.percentile(target, levels).alias("quantiles"))
        return g.select(*KEY, "n_train", F.when(F.col("n_train") >= MIN_ROWS, F.col("quantiles")).alias("model"), _few().alias("error"))

    def fit_packed(self, packed: DataFrame, features: list[str], target: str) -> DataFrame:
        n = F.col("n_train")
        g = packed.select(*KEY, F.size("rows").cast("long").alias("n_train"), F.array_sort(F.transform("rows", lambda e: e[target])).alias("y"))
        at = [(n - 1) * float(v) for v in self.quantile_levels]
        y = lambda i: F.get("y", i.cast("int"))
        between = [F.when(F.floor(k) == F.ceil(k), y(F.floor(k))).otherwise((F.ceil(k) - k) * y(F.floor(k)) + (k - F.floor(k)) * y(F.ceil(k))) for k in at]
        return g.select(*KEY, "n_train", F.when(n >= MIN_ROWS, F.array(*between)).alias("model"), _few().alias("error"))

    def predict_quantiles(self, model: Column, x: Column) -> Column:
        return F.array_sort(model)


@dataclass
class Ridge:
    """Normal quantiles around a ridge regression, as wide as its residuals."""

    name: str = "ridge"
    penalty: float = 1.0
    quantile_levels: list[float] = field(default_factory=lambda: list(es.LEVELS))

    def fit(self, train: DataFrame, features: list[str], target: str) -> DataFrame:
        m = es.ridge_fits(train, KEY, features, target, self.penalty, MIN_ROWS)
        model = F.when(F.col("error").isNull(), F.struct("intercept", "coefficients", "residual_std"))
        return m.select(*KEY, "n_train", model.alias("model"), "error")

    def predict_quantiles(self, model: Column, x: Column) -> Column:
        mean = model["intercept"] + es.dot(model["coefficients"], x)
        return F.array_sort(F.array(*[mean + model["residual_std"] * z for z in _scores(self.quantile_levels)]))


@dataclass
class QuantileRegression:
    """One penalised quantile regression per level."""

    name: str = "quantile_regression"
    alpha: float = 0.001
    max_features: int | None = None
    quantile_levels: list[float] = field(default_factory=lambda: list(es.LEVELS))

    def fit(self, train: DataFrame, features: list[str], target: str) -> DataFrame:
        return self.fit_packed(es.pack(train, features, target, KEY), features, target)

    def fit_packed(self, packed: DataFrame, features: list[str], target: str) -> DataFrame:
        m = es.fit_packed(packed, features, target, self.quantile_levels, self.alpha, self.max_features, KEY)
        return m.select(*KEY, "n_train", F.when(F.col("error").isNull(), F.sort_array("fits")).alias("model"), "error")

    def predict_quantiles(self, model: Column, x: Column) -> Column:
        return F.array_sort(F.transform(model, lambda e: e["intercept"] + es.dot(e["coefficients"], x)))


def walk_forward(rows: DataFrame, forecasters: list, features: list[str], target: str, horizon: int, lookback: int, every: int) -> DataFrame:
    """(forecaster, symbol, ts, refit, level, y, quantile, base_quantile): every forecast made out of sample, one row a level.

    ``rows`` has (symbol, ts, features, target); those with an unknown feature or outcome are left out. Each forecaster is refitted every
    ``every`` rows of a symbol on the ``lookback`` rows that end ``horizon`` rows before, so that no outcome it learns from overlaps a
    forecast. A row is forecast by the last refit at or before it that gave a model; without one it has no forecast. ``base_quantile`` is
    what the outcomes of the last such refit alone would say.
    """
    known = drop_unknown(rows.select("symbol", "ts", *features, F.col(target).alias("y")), [*features, "y"])
    known = checkpointed(known.withColumn("slot", F.floor(win.position() / every) * every))
    unfolded = checkpointed(es.training_rows(known.drop("slot"), horizon, lookback, every)) if any(not hasattr(f, "fit_packed") for f in forecasters) else None
    packed = es.packed_training(known, features, "y", horizon, lookback, every)
    slots = known.select("symbol", "slot").distinct()

    def fitted(f) -> DataFrame:
        return f.fit_packed(packed, features, "y") if hasattr(f, "fit_packed") else f.fit(unfolded, features, "y")

    def joined(f) -> DataFrame:
        m = fitted(f).filter("error IS NULL AND model IS NOT NULL")
        found = asof_join(slots, m, ["symbol"], "slot", "refit", ["model"]).filter("model IS NOT NULL")
        return known.join(found.withColumnRenamed("src_ts", "refit"), ["symbol", "slot"])

    x = F.array(*[F.col(c).cast("double") for c in features])
    parts = []
    for f in forecasters:
        levels, base = F.array(*[F.lit(float(v)) for v in f.quantile_levels]), Climatology(quantile_levels=f.quantile_levels)
        told = joined(f).select("symbol", "ts", "refit", "slot", "y", f.predict_quantiles(F.col("model"), x).alias("quantiles"))
        plain = asof_join(slots, fitted(base).filter("error IS NULL"), ["symbol"], "slot", "refit", ["model"])
        told = told.join(plain.select("symbol", "slot", F.col("model").alias("base")), ["symbol", "slot"], "left")
        flat = told.select("symbol", "ts", "refit", "y", F.explode(F.arrays_zip(levels.alias("level"), F.col("quantiles").alias("quantile"), F.col("base").alias("base_quantile"))).alias("q"))
        parts.append(flat.select(F.lit(f.name).alias("forecaster"), "symbol", "ts", "refit", "q.level", "y", "q.quantile", "q.base_quantile"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scored(forecasts: DataFrame, horizon: int) -> DataFrame:
    """The coverage report of each forecaster, symbol and level."""
    return stats.coverage_scores(forecasts, ["forecaster", "symbol"], horizon)
