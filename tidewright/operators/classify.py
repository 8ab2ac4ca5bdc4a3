"""Classifier reports: splits, scaling, weights, confusion, scores, feature pairs, and models by Spark ML."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.ranks import exact_quantiles, positions


def chronological_split(df: DataFrame, cuts: tuple[float, ...] = (0.60, 0.75), names: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """Label each symbol's rows by time: positions below int(n * cut) belong to the earlier part."""
    pos = F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1
    n = F.count("*").over(Window.partitionBy("symbol"))
    out = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names))):
        out = F.when(pos < F.floor(n * cut), name).otherwise(out)
    return df.withColumn("split", out)


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scale by the train rows' mean and population std (one aggregate row, broadcast)."""
    train = df.filter("split = 'train'").agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    j = df.join(F.broadcast(train))
    scaled = {c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 1e-12, F.col(f"s_{c}")).otherwise(1.0) for c in columns}
    return j.withColumns(scaled).select(*df.columns)


def class_weights(train: DataFrame, label: str, classes: int = 3) -> DataFrame:
    """Per class: N / (count * k), and its square root."""
    g = train.groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    raw = total / (F.col("n") * classes)
    return g.select(label, "n", raw.alias("weight"), F.sqrt(raw).alias("soft_weight"))


def confusion(df: DataFrame, actual: str, pred: str) -> DataFrame:
    """Counts per (actual, predicted): the only pass over the rows; every score below comes from it."""
    return df.groupBy(F.col(actual).cast("long").alias("actual"), F.col(pred).cast("long").alias("pred")).agg(F.count("*").alias("n"))


def confusion_matrix(cells: DataFrame, classes: list[int]) -> DataFrame:
    return cells.groupBy("actual").agg(*[F.sum(F.when(F.col("pred") == c, F.col("n")).otherwise(0)).alias(f"pred_{c}") for c in classes])


def scores(cells: DataFrame, classes: list[int]) -> DataFrame:
    """Accuracy, unweighted macro-F1, majority baseline and the improvement over it."""
    hit = F.sum(F.when(F.col("actual") == F.col("pred"), F.col("n")).otherwise(0))
    f1s, sizes = [], []
    for c in classes:
        tp = F.sum(F.when((F.col("actual") == c) & (F.col("pred") == c), F.col("n")).otherwise(0))
        pos, said = F.sum(F.when(F.col("actual") == c, F.col("n")).otherwise(0)), F.sum(F.when(F.col("pred") == c, F.col("n")).otherwise(0))
        f1s.append(F.when(pos + said > 0, 2 * tp / (pos + said)).otherwise(0.0))
        sizes.append(pos)
    acc, base = hit / F.sum("n"), F.greatest(*sizes) / F.sum("n")
    return cells.agg(acc.alias("accuracy"), (sum(f1s[1:], f1s[0]) / len(classes)).alias("macro_f1"), base.alias("baseline"), (acc - base).alias("improvement"))


def precision_by_class(cells: DataFrame) -> DataFrame:
    return cells.groupBy("pred").agg(F.sum("n").alias("signals"), (F.sum(F.when(F.col("actual") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("precision"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve from average ranks of the scores, counted range by range."""
    p = positions(df, [], score)
    pos = df.filter(F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"))
    j = p.join(pos, score)
    rank = F.col("lo") + (F.col("n") + 1) / 2
    g = j.agg(F.sum(rank * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return g.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))


def tercile_cuts(df: DataFrame, features: list[str]) -> DataFrame:
    """One row: a map from feature to its (lower, upper) tercile."""
    long = df.unpivot([], features, "feature", "value")
    q = exact_quantiles(long, ["feature"], "value", [1 / 3, 2 / 3])
    return q.agg(F.map_from_entries(F.collect_list(F.struct("feature", "quantiles"))).alias("cuts"))


def feature_pairs(df: DataFrame, features: list[str], label: str = "signal", classes: list[int] | None = None, min_rows: int = 15,
                  include_medium: bool = False) -> DataFrame:
    """Class distribution per pair of feature terciles; small groups are hidden, ties go to the lowest class.

    A row yields one entry per feature pair (a fixed number), counted before the shuffle; rows are
    never paired with each other.
    """
    classes = classes or [0, 1, 2]
    d = df.join(F.broadcast(tercile_cuts(df, features)))

    def bucket(f: str) -> Column:
        lo, hi = F.col("cuts")[f][0], F.col("cuts")[f][1]
        inside = F.when((F.col(f) > lo) & (F.col(f) < hi), "MEDIUM") if include_medium else F.lit(None)
        return F.when(F.col(f) <= lo, "LOW").when(F.col(f) >= hi, "HIGH").otherwise(inside)

    d = d.select(label, *[bucket(f).alias(f) for f in features])
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("la"), F.col(b).alias("lb")) for a, b in combinations(features, 2)])
    x = d.select(label, F.explode(pairs).alias("p")).filter("p.la IS NOT NULL AND p.lb IS NOT NULL")
    combo = F.concat_ws(" ", F.col("p.a"), F.col("p.la"), F.lit("+"), F.col("p.b"), F.col("p.lb"))
    g = x.groupBy(combo.alias("combo")).agg(F.count("*").alias("n"), *[F.sum((F.col(label) == c).cast("long")).alias(f"n_{c}") for c in classes])
    g = g.filter(F.col("n") >= min_rows)
    top = F.greatest(*[F.col(f"n_{c}") for c in classes])
    dominant = F.lit(None).cast("long")
    for c in reversed(classes):
        dominant = F.when(F.col(f"n_{c}") == top, F.lit(c).cast("long")).otherwise(dominant)
    return g.select("combo", "n", *[(F.col(f"n_{c}") / F.col("n") * 100).alias(f"pct_{c}") for c in classes], dominant.alias("dominant"), (top / F.col("n") * 100).alias("dominant_pct"))


# --- models -----------------------------------------------------------------------------------------

def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def with_row_weights(df: DataFrame, label: str, classes: int) -> DataFrame:
    w = class_weights(df.filter("split = 'train'"), label, classes).select(label, F.col("soft_weight").alias("weight"))
    return df.join(F.broadcast(w), label, "left").na.fill(1.0, ["weight"])


def boosted_direction(df: DataFrame, features: list[str], label: str, iterations: int = 30, depth: int = 4):
    """Binary boosted trees with early stopping on the validation rows."""
    v = _vectors(with_row_weights(df, label, 2), features).withColumn("is_val", F.col("split") == "validation")
    model = GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxIter=iterations, maxDepth=depth, stepSize=0.05, subsamplingRate=0.8,
                          validationIndicatorCol="is_val", seed=42).fit(v.filter("split <> 'test'"))
    return model, v


def perceptron(df: DataFrame, features: list[str], label: str, classes: int = 3, iterations: int = 60):
    """A 32-16 network. The classifier has no weight column, batch norm or dropout, unlike the original script."""
    v = _vectors(df, features).withColumn(label, F.col(label).cast("double"))
    model = MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=[len(features), 32, 16, classes], maxIter=iterations, seed=42).fit(v.filter("split = 'train'"))
    return model, v


def huber_regression(df: DataFrame, features: list[str], target: str):
    v = _vectors(df, features)
    model = LinearRegression(featuresCol="features", labelCol=target, loss="huber", maxIter=100).fit(v.filter("split = 'train'"))
    return model, v


def importances(model, features: list[str], spark) -> DataFrame:
    """Feature importances, largest first."""
    rows = [(f, float(x)) for f, x in zip(features, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def probabilities(scored: DataFrame, classes: int) -> DataFrame:
    p = vector_to_array("probability")
    return scored.withColumns({f"p_{c}": p[c] for c in range(classes)})


def regime_filtered(scored: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Rows the regime model does not call neutral, relabelled to a binary direction."""
    return scored.filter(vector_to_array("probability")[1] < threshold).withColumn("direction", (F.col("signal") == 2).cast("int"))
