"""A weighted classifier network (two hidden layers, batch normalisation, dropout), trained by gradients summed over blocks.

Each epoch is one job: a block's task runs forward and backward on the block with the block's own normalisation statistics,
and returns the gradient of its share of the weighted loss; the driver, which holds nothing but the parameters, adds them up
and takes one Adam step. On one block this is plain full-batch training. Running statistics are averaged over blocks by rows.
Training stops by itself once macro-F1 on the validation rows has not grown for a while, and the best state is kept.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.training import macro_f1, summed

EPS = 1e-5  # of the normalisation
HIDDEN = (32, 16)
KEEP = (0.7, 0.8)  # share of units that dropout keeps in each hidden layer


@dataclass
class Network:
    features: list[str]
    classes: int
    theta: list[float]  # parameters, layer by layer
    running: list[float]  # mean and variance of each hidden layer
    epoch: int = 0
    best_f1: float = -1.0
    history: list[tuple[int, float, float, float]] = field(default_factory=list)  # (epoch, train loss, validation loss, macro-F1)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Network:
        return cls(**json.loads(spark.read.text(path).first()[0]))


def shapes(features: int, classes: int, hidden: tuple[int, ...] = HIDDEN) -> list[tuple[int, ...]]:
    """Weights, offsets, scale and shift of every hidden layer, then weights and offsets of the last one."""
    out, size = [], features
    for h in hidden:
        out += [(size, h), (h,), (h,), (h,)]
        size = h
    return [*out, (size, classes), (classes,)]


def unpacked(theta: np.ndarray, like: list[tuple[int, ...]]) -> list[np.ndarray]:
    ends = np.cumsum([int(np.prod(s)) for s in like])
    return [part.reshape(s) for part, s in zip(np.split(theta, ends[:-1]), like)]


def initial(features: int, classes: int, seed: int) -> np.ndarray:
    """Uniform weights within one over the root of a layer's inputs; scale one, shift zero."""
    rng, out = np.random.default_rng(seed), []
    like = shapes(features, classes)
    for at, s in enumerate(like):
        if len(s) == 2:
            bound = s[0] ** -0.5
            out.append(rng.uniform(-bound, bound, s).ravel())
        elif at % 4 == 1:  # offsets of the layer whose weights came before
            out.append(rng.uniform(-bound, bound, s))
        else:
            out.append(np.full(s, 1.0 if at % 4 == 2 else 0.0))
    return np.concatenate(out)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def forward(theta: np.ndarray, running: np.ndarray, x: np.ndarray, classes: int) -> np.ndarray:
    """Log probabilities by the running statistics."""
    parts = unpacked(theta, shapes(x.shape[1], classes))
    stats = np.split(running, np.cumsum([h for h in HIDDEN for _ in (0, 1)])[:-1])
    for layer in range(len(HIDDEN)):
        w, b, scale, shift = parts[4 * layer : 4 * layer + 4]
        z = (x @ w + b - stats[2 * layer]) / np.sqrt(stats[2 * layer + 1] + EPS)
        x = np.maximum(scale * z + shift, 0)
    return log_softmax(x @ parts[-2] + parts[-1])


def gradient(theta: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, total: float, rng: np.random.Generator | None) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted loss over ``total`` weight, its gradient, and the block's statistics (mean and unbiased variance by layer)."""
    parts = unpacked(theta, shapes(x.shape[1], classes))
    m, kept, stats = len(x), [], []
    for layer, keep in enumerate(KEEP):
        weights, b, scale, shift = parts[4 * layer : 4 * layer + 4]
        z = x @ weights + b
        mean, var = z.mean(0), z.var(0)
        stats += [mean, var * m / max(1, m - 1)]
        unit = (z - mean) / np.sqrt(var + EPS)
        out = scale * unit + shift
        mask = (out > 0) * ((rng.random(out.shape) < keep) / keep if rng else 1.0)
        kept.append((x, unit, np.sqrt(var + EPS), mask))
        x = out * mask
    logs = log_softmax(x @ parts[-2] + parts[-1])
    at = y.astype(int)
    loss = -float((w * logs[np.arange(m), at]).sum()) / total
    up = np.exp(logs)
    up[np.arange(m), at] -= 1
    up *= (w / total)[:, None]
    grads = [up.sum(0), x.T @ up]
    up = up @ parts[-2].T
    for layer in range(len(KEEP) - 1, -1, -1):
        below, unit, std, mask = kept[layer]
        up = up * mask
        own = [(up * unit).sum(0), up.sum(0)]
        up = up * parts[4 * layer + 2]
        up = (up - up.mean(0) - unit * (up * unit).mean(0)) / std
        grads += [own[1], own[0], up.sum(0), below.T @ up]
        up = up @ parts[4 * layer].T
    return loss, np.concatenate([g.ravel() for g in reversed(grads)]), np.concatenate(stats)


def fit_network(blocks: DataFrame, features: list[str], classes: int = 3, epochs: int = 3000, patience: int = 100, every: int = 10, rate: float = 0.001,
                decay: float = 1e-4, seed: int = 42, save_to: str | None = None) -> Network:
    """Train on the 'train' blocks of ``training.packed``; stop on the 'validation' blocks.

    Every ``every`` epochs the validation loss and macro-F1 are taken; the rate halves after three such rounds without a lower
    loss, training ends after ``patience`` epochs without a higher macro-F1 or at ``epochs``. ``save_to`` is a folder for the best
    state, written whenever it improves. Without training rows the initial network comes back; without validation rows
    the last state is kept.
    """
    sizes = {r["split"]: (r["b"], r["n"]) for r in blocks.groupBy("split").agg(F.count("*").alias("b"), F.sum("rows").alias("n")).collect()}
    train, check = blocks.filter("split = 'train'"), blocks.filter("split = 'validation'")
    theta = initial(len(features), classes, seed)
    running = np.concatenate([np.full(h, float(k)) for h in HIDDEN for k in (0, 1)])
    model = Network(features, classes, theta.tolist(), running.tolist())
    if "train" not in sizes:
        return model
    count, rows = sizes["train"]
    width, tail = len(theta), len(running)
    weight = summed(train, count, lambda s, b, x, y, w: np.array([w.sum()]), 1)[0]
    first, second = np.zeros(width), np.zeros(width)
    low, stale, waited = np.inf, 0, 0
    for epoch in range(epochs):
        now = theta

        def part(split, block, x, y, w, epoch=epoch, now=now):
            loss, grad, stats = gradient(now, x, y, w, classes, weight, np.random.default_rng((seed, epoch, block)))
            return np.concatenate([[loss], grad, stats * len(x)])

        sums = summed(train, count, part, 1 + width + tail)
        loss, grad = float(sums[0]), sums[1 : 1 + width] + decay * theta
        running = 0.9 * running + 0.1 * sums[1 + width :] / rows
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta - rate * (first / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(second / (1 - 0.999 ** (epoch + 1))) + 1e-8)
        if epoch % every and epoch != epochs - 1:
            continue
        model.epoch = epoch
        if "validation" not in sizes:
            model.theta, model.running = theta.tolist(), running.tolist()
            model.history.append((epoch, loss, float("nan"), float("nan")))
            continue
        state = (theta, running)

        def judged(split, block, x, y, w, state=state):
            logs = forward(*state, x, classes)
            cells = np.zeros((classes, classes))
            np.add.at(cells, (y.astype(int), logs.argmax(1)), 1)
            return np.concatenate([[-(w * logs[np.arange(len(y)), y.astype(int)]).sum(), w.sum()], cells.ravel()])

        sums = summed(check, sizes["validation"][0], judged, 2 + classes * classes)
        val, f1 = float(sums[0] / sums[1]), macro_f1(sums[2:].reshape(classes, classes))
        model.history.append((epoch, loss, val, f1))
        low, stale = (val, 0) if val < low * (1 - 1e-4) else (low, stale + 1)
        if stale > 3:
            rate, stale = rate / 2, 0
        if f1 > model.best_f1:
            model.best_f1, waited = f1, 0
            model.theta, model.running = theta.tolist(), running.tolist()
            if save_to:
                model.save(blocks.sparkSession, save_to)
        else:
            waited += every
        if waited >= patience:
            break
    return model


def weights_table(model: Network, spark: SparkSession) -> DataFrame:
    """(layer, input, output, weight) with normalisation folded in; input -1 is the offset. As many rows as parameters."""
    parts = unpacked(np.array(model.theta), shapes(len(model.features), model.classes))
    stats = np.split(np.array(model.running), np.cumsum([h for h in HIDDEN for _ in (0, 1)])[:-1])
    rows = []
    for layer in range(len(HIDDEN) + 1):
        w, b = parts[4 * layer], parts[4 * layer + 1]
        if layer < len(HIDDEN):
            factor = parts[4 * layer + 2] / np.sqrt(stats[2 * layer + 1] + EPS)
            w, b = w * factor, (b - stats[2 * layer]) * factor + parts[4 * layer + 3]
        rows += [(layer, i, j, float(w[i, j])) for i in range(w.shape[0]) for j in range(w.shape[1])] + [(layer, -1, j, float(b[j])) for j in range(len(b))]
    return spark.createDataFrame(rows, "layer int, input int, output int, weight double")


def _unit(before: str, rectify: bool):
    """A unit of a layer from its row of weights and its offset."""

    def run(row: Column, offset: Column) -> Column:
        z = F.aggregate(F.zip_with(row, F.col(before), lambda a, b: a * b), offset, lambda s, v: s + v)
        return F.greatest(z, F.lit(0.0)) if rectify else z

    return run


def with_probabilities(rows: DataFrame, weights: DataFrame, features: list[str], classes: int = 3) -> DataFrame:
    """``rows`` with p_0, p_1, ... and prediction, by column expressions over the table of weights (no Python, no shuffle)."""
    table: dict[int, dict[int, list[tuple[int, float]]]] = {}
    for r in weights.collect():  # the model
        table.setdefault(r["layer"], {}).setdefault(r["output"], []).append((r["input"], r["weight"]))
    out = rows.withColumn("__0", F.array(*[F.col(f).cast("double") for f in features]))
    last = max(table)
    for layer in sorted(table):
        rows_of = F.array(*[F.array(*[F.lit(w) for i, w in sorted(table[layer][j]) if i >= 0]) for j in sorted(table[layer])])
        offsets = F.array(*[F.lit(dict(table[layer][j])[-1]) for j in sorted(table[layer])])
        out = out.withColumn(f"__{layer + 1}", F.zip_with(rows_of, offsets, _unit(f"__{layer}", layer < last)))
    top = F.array_max(f"__{last + 1}")
    out = out.withColumn("__e", F.transform(f"__{last + 1}", lambda z: F.exp(z - top)))
    total = F.aggregate("__e", F.lit(0.0), lambda s, v: s + v)
    out = out.withColumns({f"p_{c}": F.col("__e")[c] / total for c in range(classes)})
    best = F.lit(0)
    for c in range(1, classes):
        best = F.when(F.col(f"p_{c}") > F.greatest(*[F.col(f"p_{k}") for k in range(c)], F.lit(-1.0)), c).otherwise(best)
    return out.withColumn("prediction", best).drop("__e", *[f"__{k}" for k in range(last + 2)])


def with_own_probabilities(rows: DataFrame, model: Network) -> DataFrame:
    """``rows`` with ``own``, the class probabilities by the network's own forward pass, in Arrow batches."""
    theta, running, features, classes = np.array(model.theta), np.array(model.running), model.features, model.classes
    kind = pa.list_(pa.float64())

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False).astype(np.float64) for f in features], 1)
            own = np.exp(forward(theta, running, x, classes)) if len(x) else x
            yield batch.append_column("own", pa.array(own.tolist(), kind))

    return rows.mapInArrow(run, rows.select("*", F.lit(None).cast("array<double>").alias("own")).schema)
