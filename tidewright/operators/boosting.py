"""Joint multi-class boosting: in each round one tree a class on second-order gradients of the softmax loss, grown level by level.

A level is one job: every block's task bins its rows, places them in the trees so far and returns histograms of gradient and
curvature by (class, node, feature, bin); their sum decides all splits of the level. The same job returns the validation
loss of the rounds before. Trees are a table of nodes, from which rows can be scored by joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.ranks import exact_quantiles
from tidewright.operators.training import summed

NODE = "round int, class int, node int, feature string, threshold double, value double, gain double"


@dataclass
class Boosted:
    features: list[str]
    classes: int
    edges: list[list[float]]  # thresholds of each feature, ascending
    rounds: list[list[dict[int, tuple]]] = field(default_factory=list)  # by round and class: node -> (feature or -1, edge, value, gain)
    losses: list[float] = field(default_factory=list)  # validation loss before each round
    best: int = 0

    def table(self, spark: SparkSession) -> DataFrame:
        """Nodes of the best rounds: inner ones with feature and threshold (smaller values go to 2 * node), leaves with a value."""
        rows = []
        for r, trees in enumerate(self.rounds[: self.best]):
            for c, tree in enumerate(trees):
                for node, (f, edge, value, gain) in sorted(tree.items()):
                    rows.append((r, c, node, self.features[f] if f >= 0 else None, float(self.edges[f][edge]) if f >= 0 else None, None if f >= 0 else float(value), float(gain)))
        return spark.createDataFrame(rows, NODE)

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(path)


def bin_edges(rows: DataFrame, features: list[str], bins: int = 32, digits: int = 9) -> list[list[float]]:
    """Distinct inner quantiles of the training rows' features, rounded to ``digits``, at most ``bins`` - 1 a feature."""
    long = rows.filter("split = 'train'").select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], features, "feature", "value").filter("value IS NOT NULL")
    found = exact_quantiles(long, ["feature"], "value", [k / bins for k in range(1, bins)])
    by = {r["feature"]: sorted({round(q, digits) for q in r["quantiles"]}) for r in found.collect()}  # one row a feature
    return [by.get(f, []) for f in features]


def _placed(tree: dict[int, tuple], binned: np.ndarray) -> np.ndarray:
    """The node of each row: the leaf that it reaches, or the open node."""
    at = np.ones(len(binned), np.int64)
    for node in sorted(tree):
        f, edge, _, _ = tree[node]
        if f >= 0:
            here = at == node
            at[here] = 2 * node + (binned[here, f] > edge)
    return at


def _margins(rounds: list, binned: np.ndarray, classes: int) -> np.ndarray:
    out = np.zeros((len(binned), classes))
    for trees in rounds:
        for c, tree in enumerate(trees):
            value = np.zeros(max(tree) + 1)
            for node, (f, _, v, _) in tree.items():
                value[node] = v if f < 0 else 0.0
            out[:, c] += value[_placed(tree, binned)]
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_boosted(blocks: DataFrame, features: list[str], edges: list[list[float]], classes: int = 3, rounds: int = 500, depth: int = 4, rate: float = 0.05, subsample: float = 0.8,
                columns: float = 0.8, penalty: float = 1.0, least: float = 1.0, patience: int = 30, seed: int = 42) -> Boosted:
    """Train on the 'train' blocks of ``training.packed`` until the validation log loss has not fallen for ``patience`` rounds.

    Rows of a round are drawn by a generator seeded with round and block, the columns of a tree by one seeded with round and class, so that reruns
    agree. A split needs a curvature of ``least`` on both sides and a positive gain; ties go to the first feature, then the lowest
    threshold. Without validation rows all rounds run; without training rows there is no tree.
    """
    model = Boosted(features, classes, edges)
    sizes = {r["split"]: r["b"] for r in blocks.groupBy("split").agg(F.count("*").alias("b")).collect()}
    if "train" not in sizes:
        return model
    used = blocks.filter("split IN ('train', 'validation')")
    count = sizes["train"] + sizes.get("validation", 0)
    size = max((len(e) for e in edges), default=0) + 1
    cuts = [np.array(e) for e in edges]
    low = np.inf
    for r in range(rounds + 1):
        trees: list[dict[int, tuple]] = [{} for _ in range(classes)]
        rng = [np.random.default_rng((seed, r, c)) for c in range(classes)]
        chosen = [np.sort(g.choice(len(features), max(1, round(columns * len(features))), replace=False)) for g in rng]
        for level in range(depth):
            nodes = 1 << level
            width = 2 + classes * nodes * len(features) * size * 2

            def part(split, block, x, y, w, done=model.rounds, now=trees, level=level, nodes=nodes, width=width, r=r):
                binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
                p = _softmax(_margins(done, binned, classes))
                at = y.astype(int)
                if split == "validation":
                    out = np.zeros(width)
                    out[:2] = (-(w * np.log(np.maximum(p[np.arange(len(y)), at], 1e-300))).sum(), w.sum()) if level == 0 else (0.0, 0.0)
                    return out
                w = w * (np.random.default_rng((seed, r, classes, block)).random(len(y)) < subsample)
                sums = np.zeros((classes, nodes, len(features), size, 2))
                for c in range(classes):
                    place = _placed(now[c], binned) - nodes
                    inside = (place >= 0) & (w > 0)
                    g, h = (w * (p[:, c] - (at == c)))[inside], (w * np.maximum(2 * p[:, c] * (1 - p[:, c]), 1e-16))[inside]
                    for f in range(len(features)):
                        cell = place[inside] * size + binned[inside, f]
                        for k, v in enumerate((g, h)):
                            sums[c, :, f, :, k] = np.bincount(cell, v, nodes * size).reshape(nodes, size)
                return np.concatenate([[0.0, 0.0], sums.ravel()])

            total = summed(used, count, part, width)
            if level == 0 and total[1]:
                model.losses.append(float(total[0] / total[1]))
                if model.losses[-1] < low:
                    low, model.best = model.losses[-1], r
                if r - model.best >= patience:
                    return model
            elif level == 0:
                model.best = r
            if r == rounds:
                break
            _grow(trees, total[2:].reshape(classes, nodes, len(features), size, 2), level, depth, chosen, cuts, rate, penalty, least)
        if r < rounds:
            model.rounds.append(trees)
    return model


def _grow(trees, sums, level, depth, chosen, cuts, rate, penalty, least) -> None:
    """Split the open nodes of a level where it pays; what does not split, and the last level's children, become leaves."""
    nodes = 1 << level
    for c, tree in enumerate(trees):
        for k in range(nodes):
            node = nodes + k
            if level and tree.get(node // 2, (-1,))[0] < 0:
                continue
            g, h = sums[c, k, 0].sum(0)
            best = (0.0, -1, 0)
            for f in chosen[c]:
                left = np.cumsum(sums[c, k, f], 0)[: len(cuts[f])]
                right = np.array([g, h]) - left
                gain = 0.5 * (left[:, 0] ** 2 / (left[:, 1] + penalty) + right[:, 0] ** 2 / (right[:, 1] + penalty) - g**2 / (h + penalty))
                gain[(left[:, 1] < least) | (right[:, 1] < least)] = 0.0
                top = int(gain.argmax()) if len(gain) else 0
                if len(gain) and gain[top] > best[0] + 1e-9:
                    best = (float(gain[top]), int(f), top)
            gain, f, edge = best
            tree[node] = (f, edge, -rate * g / (h + penalty), gain)
            if f >= 0 and level == depth - 1:
                left = sums[c, k, f, : edge + 1].sum(0)
                for child, (a, b) in ((2 * node, left), (2 * node + 1, np.array([g, h]) - left)):
                    tree[child] = (-1, 0, -rate * a / (b + penalty), 0.0)


def scored(rows: DataFrame, nodes: DataFrame, features: list[str], classes: int = 3, depth: int = 4) -> DataFrame:
    """``rows`` with p_0, p_1, ... and prediction, by walking the table of nodes as arrays of a single row.

    The table is model-sized (rounds x classes x nodes), so that it travels as a literal map; no Python and no shuffle. A row with an
    unknown feature gets NULL probabilities. Without trees all classes are as likely.
    """
    tree: dict[tuple[int, int], dict[int, tuple]] = {}
    for n in nodes.collect():  # the model
        tree.setdefault((n["round"], n["class"]), {})[n["node"]] = (n["feature"], n["threshold"], n["value"])
    flat = lambda k, pick, kind: F.array(*[F.array(*[F.lit(pick(tree[key].get(i))) for i in range(2 << depth)]) for key in sorted(tree) if key[1] == k]).cast(f"array<array<{kind}>>")
    place = {f: i for i, f in enumerate(features)}
    x = F.array(*[F.col(f).cast("double") for f in features])
    known = F.lit(True)
    for f in features:
        known = known & F.col(f).isNotNull()
    out = rows.withColumn("__x", x).withColumn("__known", known)
    for k in range(classes):
        if not any(key[1] == k for key in tree):
            out = out.withColumn(f"__z{k}", F.lit(0.0))
            continue
        packs = F.arrays_zip(
            flat(k, lambda n: place[n[0]] if n and n[0] is not None else None, "int").alias("f"), flat(k, lambda n: n[1] if n else None, "double").alias("t"), flat(k, lambda n: n[2] if n else None, "double").alias("v")
        )

        def leaf(pack):
            at = F.lit(1)
            for _ in range(depth):
                f = pack["f"][at]
                at = F.when(f.isNull(), at).otherwise(at * 2 + (F.col("__x")[f] > pack["t"][at]).cast("int"))
            return pack["v"][at]

        out = out.withColumn(f"__z{k}", F.aggregate(packs, F.lit(0.0), lambda s, pack: s + leaf(pack)))
    top = F.greatest(*[F.col(f"__z{k}") for k in range(classes)])
    out = out.withColumns({f"__e{k}": F.exp(F.col(f"__z{k}") - top) for k in range(classes)})
    total = sum((F.col(f"__e{k}") for k in range(1, classes)), F.col("__e0"))
    out = out.withColumns({f"p_{k}": F.when(F.col("__known"), F.col(f"__e{k}") / total) for k in range(classes)})
    best = F.lit(0)
    for k in range(1, classes):
        best = F.when(F.col(f"__z{k}") > F.greatest(*[F.col(f"__z{j}") for j in range(k)], F.lit(float("-inf"))), k).otherwise(best)
    return out.withColumn("prediction", F.when(F.col("__known"), best)).drop("__x", "__known", *[f"__z{k}" for k in range(classes)], *[f"__e{k}" for k in range(classes)])


def walked(rows: DataFrame, nodes: DataFrame, keys: list[str], features: list[str], classes: int = 3, depth: int = 4) -> DataFrame:
    """(keys, class, margin) by joins with the table of nodes, one level a join: how any SQL engine can score the model."""
    model = F.broadcast(nodes)  # rounds x classes x nodes, whatever the rows
    trees = model.select("round", "class").distinct().withColumn("__all", F.lit(1))
    values = F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.array(*[F.col(f).cast("double") for f in features]))
    now = rows.select(*keys, values.alias("values"), F.lit(1).alias("__all")).join(F.broadcast(trees), "__all").withColumn("node", F.lit(1))
    for _ in range(depth):
        met = now.join(model.select("round", "class", "node", "feature", "threshold"), ["round", "class", "node"])
        step = F.when(F.col("feature").isNull(), F.col("node")).otherwise(F.col("node") * 2 + (F.col("values")[F.col("feature")] > F.col("threshold")).cast("int"))
        now = met.select(*keys, "values", "round", "class", step.alias("node"))
    return now.join(model.select("round", "class", "node", "value"), ["round", "class", "node"]).groupBy(*keys, "class").agg(F.sum("value").alias("margin"))


def gains(nodes: DataFrame) -> DataFrame:
    """Mean gain of each feature's splits as a share of all, largest first."""
    by = nodes.filter("feature IS NOT NULL").groupBy("feature").agg(F.avg("gain").alias("gain"), F.count("*").alias("splits"))
    total = by.agg(F.sum("gain").alias("__sum"))
    return by.join(F.broadcast(total)).select("feature", (F.col("gain") / F.col("__sum")).alias("importance"), "splits").orderBy(F.desc("importance"), "feature")
