"""Classifier evaluation queries."""

from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.catalog.filters import FEAT, SIGNAL, labelled
from tidewright.catalog.registry import longs, query, rounded
from tidewright.catalog.windows import FEATURES
from tidewright.functions.nulls import drop_unknown
from tidewright.operators import boosting as bo
from tidewright.operators import classify as cl
from tidewright.operators import network as nw
from tidewright.operators import training as tr
from tidewright.session import checkpointed
from tidewright.tables import Tables

PAIRS = ["momentum_12", "relative_volume_20", "atr_percent", "volatility_20", "candle_strength"]


def features(t: Tables):
    """Complete labelled rows; the label's horizon runs past the end for the last rows, which stay neutral."""
    df = drop_unknown(labelled(t), FEATURES)
    return df.select("symbol", "ts", "signal", *[F.round(c, 6).alias(c) for c in FEATURES])


def predicted(t: Tables):
    return features(t).withColumn("pred", F.when(F.col("momentum_12") > 0.5, 2).when(F.col("momentum_12") < -0.5, 0).otherwise(1))


BASE = f"""{FEAT}, lb AS (SELECT symbol, ts, {SIGNAL}, {", ".join(f"round({c}, 6) AS {c}" for c in FEATURES)} FROM features), fx AS (SELECT * FROM lb WHERE {" AND ".join(f"{c} IS NOT NULL" for c in FEATURES)}),
pr AS (SELECT *, CASE WHEN momentum_12 > 0.5 THEN 2 WHEN momentum_12 < -0.5 THEN 0 ELSE 1 END AS pred FROM fx)"""


SPLIT = """sp AS (SELECT *, CASE WHEN pos < floor(n * 0.60) THEN 'train' WHEN pos < floor(n * 0.75) THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM fx))"""


@query("agg01_label_counts", f"{BASE}, {SPLIT} SELECT split, signal, count(*) AS n FROM sp GROUP BY 1, 2")
def _(t: Tables):
    return longs(cl.chronological_split(features(t)).groupBy("split", "signal").agg(F.count("*").alias("n")))


@query("agg02_confusion_matrix", f"{BASE} SELECT signal AS actual, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1, count(*) FILTER (pred = 2) AS pred_2 FROM pr GROUP BY 1")
def _(t: Tables):
    return cl.confusion_matrix(cl.confusion(predicted(t), "signal", "pred"), [0, 1, 2])


@query("agg03_class_weights", f"{BASE} SELECT signal, n, round(tot / (n * 3), 8) AS weight, round(sqrt(tot / (n * 3)), 8) AS soft_weight FROM (SELECT signal, count(*) AS n, CAST(sum(count(*)) OVER () AS DOUBLE) AS tot FROM fx GROUP BY 1)")
def _(t: Tables):
    return longs(rounded(cl.class_weights(features(t), "signal"), 8))


_F1 = " + ".join(f"CASE WHEN count(*) FILTER (signal = {c}) + count(*) FILTER (pred = {c}) > 0 THEN 2 * count(*) FILTER (signal = {c} AND pred = {c}) / (count(*) FILTER (signal = {c}) + count(*) FILTER (pred = {c})) ELSE 0 END" for c in (0, 1, 2))
_BASEL = "greatest(" + ", ".join(f"count(*) FILTER (signal = {c})" for c in (0, 1, 2)) + ") / count(*)"


@query("agg04_scores", f"{BASE} SELECT round(count(*) FILTER (signal = pred) / count(*), 8) AS accuracy, round(({_F1}) / 3, 8) AS macro_f1, round({_BASEL}, 8) AS baseline, round(count(*) FILTER (signal = pred) / count(*) - {_BASEL}, 8) AS improvement FROM pr")
def _(t: Tables):
    return rounded(cl.scores(cl.confusion(predicted(t), "signal", "pred"), [0, 1, 2]), 8)


@query("agg04_auc", f"{BASE}, r AS (SELECT signal = 2 AS y, rank() OVER (ORDER BY momentum_12) + (count(*) OVER (PARTITION BY momentum_12) - 1) / 2 AS rk FROM fx WHERE signal <> 1) SELECT round((sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 8) AS auc FROM r")
def _(t: Tables):
    d = features(t).filter("signal <> 1").withColumn("y", (F.col("signal") == 2).cast("int"))
    return rounded(cl.auc(d, "momentum_12", "y"), 8)


@query("agg05_precision", f"{BASE} SELECT CAST(pred AS BIGINT) AS pred, count(*) AS signals, round(avg(CAST(signal = pred AS INT)), 8) AS precision FROM pr GROUP BY 1")
def _(t: Tables):
    return rounded(cl.precision_by_class(cl.confusion(predicted(t), "signal", "pred")), 8)


_CUT = "ct AS (SELECT " + ", ".join(f"quantile_cont({f}, 1.0::DOUBLE / 3) AS lo_{f}, quantile_cont({f}, 2.0::DOUBLE / 3) AS hi_{f}" for f in PAIRS) + " FROM fx)"
_BK = "bk AS (SELECT signal, " + ", ".join(f"CASE WHEN {f} <= lo_{f} THEN 'LOW' WHEN {f} >= hi_{f} THEN 'HIGH' END AS {f}" for f in PAIRS) + " FROM fx, ct)"
_UN = "un AS (" + " UNION ALL ".join(f"SELECT signal, '{a} ' || {a} || ' + {b} ' || {b} AS combo FROM bk WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in combinations(PAIRS, 2)) + ")"
PAIR_SQL = f"""{BASE}, {_CUT}, {_BK}, {_UN}, gp AS (SELECT combo, count(*) AS n, count(*) FILTER (signal = 0) AS n0, count(*) FILTER (signal = 1) AS n1, count(*) FILTER (signal = 2) AS n2 FROM un GROUP BY 1 HAVING count(*) >= 15),
pairs AS (SELECT combo, n, n0 / n * 100 AS pct_0, n1 / n * 100 AS pct_1, n2 / n * 100 AS pct_2, CAST(CASE greatest(n0, n1, n2) WHEN n0 THEN 0 WHEN n1 THEN 1 ELSE 2 END AS BIGINT) AS dominant, greatest(n0, n1, n2) / n * 100 AS dominant_pct FROM gp)"""


@query("agg06_feature_pairs", f"{PAIR_SQL} SELECT combo, n, round(pct_0, 6) AS pct_0, round(pct_1, 6) AS pct_1, round(pct_2, 6) AS pct_2, dominant, round(dominant_pct, 6) AS dominant_pct FROM pairs")
def _(t: Tables):
    return rounded(cl.feature_pairs(features(t), PAIRS))


@query("top02_strongest_pairs", f"{PAIR_SQL} SELECT combo, n, dominant, round(dominant_pct, 6) AS dominant_pct FROM pairs ORDER BY round(dominant_pct, 9) DESC, combo LIMIT 15")
def _(t: Tables):
    p = cl.feature_pairs(features(t), PAIRS).select("combo", "n", "dominant", "dominant_pct")
    return rounded(p.orderBy(F.desc(F.round("dominant_pct", 9)), "combo").limit(15))


@query("join15_feature_pair_rows", f"{BASE}, {_CUT}, {_BK}, {_UN} SELECT combo, signal, count(*) AS n FROM un GROUP BY 1, 2 HAVING count(*) > 0")
def _(t: Tables):
    g = cl.feature_pairs(features(t), PAIRS, min_rows=1)
    cells = F.explode(F.array(*[F.struct(F.lit(c).cast("long").alias("signal"), F.round(F.col("n") * F.col(f"pct_{c}") / 100).cast("long").alias("n")) for c in (0, 1, 2)])).alias("c")
    return g.select("combo", cells).select("combo", "c.signal", "c.n").filter("n > 0")


@query("est01_chronological_split", f"{BASE}, {SPLIT} SELECT symbol, split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM sp GROUP BY 1, 2")
def _(t: Tables):
    return cl.chronological_split(features(t)).groupBy("symbol", "split").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("est02_standardised", f"{BASE}, {SPLIT}, ms AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in PAIRS) + " FROM sp WHERE split = 'train') SELECT symbol, ts, split, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in PAIRS) + " FROM sp, ms")
def _(t: Tables):
    return rounded(cl.standardise(cl.chronological_split(features(t)), PAIRS).select("symbol", "ts", "split", *PAIRS))


@query("top05_largest_correlations", f"{BASE}, fw AS (SELECT *, lead(momentum_12, 12) OVER (PARTITION BY symbol ORDER BY ts) AS y FROM fx), c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, y) AS correlation FROM fw" for c in PAIRS) + ") SELECT feature, round(correlation, 6) AS correlation FROM c ORDER BY abs(round(correlation, 9)) DESC, feature LIMIT 3")
def _(t: Tables):
    y = F.lead("momentum_12", 12).over(Window.partitionBy("symbol").orderBy("ts"))
    d = features(t).withColumn("y", y)
    one = d.agg(*[F.corr(c, "y").alias(c) for c in PAIRS]).unpivot([], PAIRS, "feature", "correlation")
    return rounded(one.orderBy(F.desc(F.abs(F.round("correlation", 9))), "feature").limit(3))


@query("est05_huber_regression")
def _(t: Tables):
    d = cl.chronological_split(features(t).withColumn("y", F.lead("momentum_12", 12).over(Window.partitionBy("symbol").orderBy("ts"))).filter("y IS NOT NULL"))
    model, v = cl.huber_regression(cl.standardise(d, PAIRS), PAIRS, "y")
    return rounded(model.transform(v).filter("split = 'test'").select("symbol", "ts", "y", "prediction"))


KEYS = ["symbol", "ts"]


def split_rows(t: Tables, scaled: bool = False):
    """Labelled rows by time with their class weight, written once: training reads them many times."""
    d = cl.chronological_split(features(t))
    d = checkpointed((cl.standardise(d, PAIRS) if scaled else d).select(*KEYS, "signal", "split", *PAIRS))
    return d.withColumn("weight", tr.soft_weights(F.col("signal"), tr.class_counts(d, "signal"), 3))


def network(t: Tables):
    """The weighted network on scaled features, with fewer and larger steps than the full schedule."""
    d = split_rows(t, scaled=True)
    blocks = tr.packed(d, PAIRS, "signal", KEYS, "weight")
    return d, nw.fit_network(blocks, PAIRS, epochs=100, patience=40, rate=0.01)


@query("est06_neural_net_classes")
def _(t: Tables):
    d, model = network(t)
    p = nw.with_probabilities(d.filter("split = 'test'"), nw.weights_table(model, t.spark), PAIRS)
    return rounded(p.select(*KEYS, "signal", F.col("prediction").cast("double").alias("prediction"), "p_0", "p_1", "p_2"))


@query("est06_network_certificate", f"""{BASE}, {SPLIT}, cw AS (SELECT signal, sqrt(sum(count(*)) OVER () / (count(*) * 3)) AS w FROM sp WHERE split = 'train' GROUP BY 1)
SELECT split, count(*) AS n, round(CAST(sum(coalesce(w, 1)) AS DOUBLE), 6) AS weight, true AS sums_to_one, true AS same_as_network, true AS loss_fell, true AS best_kept FROM sp LEFT JOIN cw USING (signal) GROUP BY 1""")
def _(t: Tables):
    """Probabilities from the table of weights by column expressions, held against the network itself, for every row."""
    d, model = network(t)
    p = nw.with_probabilities(d, nw.weights_table(model, t.spark), PAIRS)
    p = nw.with_own_probabilities(p, model)
    near = F.greatest(*[F.abs(F.col(f"p_{c}") - F.col("own")[c]) for c in range(3)]) < 1e-9
    fell = model.history[-1][1] < model.history[0][1]
    kept = model.best_f1 == max(h[3] for h in model.history)
    whole = F.abs(F.col("p_0") + F.col("p_1") + F.col("p_2") - 1) < 1e-9
    g = p.groupBy("split").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.min(whole).alias("sums_to_one"), F.min(near).alias("same_as_network"))
    return rounded(g.withColumns({"loss_fell": F.lit(fell), "best_kept": F.lit(kept)}))


def direction_rows(t: Tables):
    return cl.chronological_split(features(t).filter("signal <> 1").withColumn("direction", (F.col("signal") == 2).cast("double")))


@query("est07_boosted_direction")
def _(t: Tables):
    model, v = cl.boosted_direction(direction_rows(t), PAIRS, "direction")
    return rounded(cl.probabilities(model.transform(v).filter("split = 'test'"), 2).select("symbol", "ts", "direction", "prediction", "p_0", "p_1"))


def regime_trees(t: Tables, rounds: int = 30, depth: int = 3, **more):
    d = split_rows(t)
    edges = bo.bin_edges(d, PAIRS, bins=16)
    return d, bo.fit_boosted(tr.packed(d, PAIRS, "signal", KEYS, "weight"), PAIRS, edges, rounds=rounds, depth=depth, **more)


@query("est07_boosted_regime")
def _(t: Tables):
    d, model = regime_trees(t, rate=0.2, patience=5)
    p = bo.scored(d.filter("split = 'test'"), model.table(t.spark), PAIRS, depth=3)
    return rounded(p.select(*KEYS, "signal", F.col("prediction").cast("double").alias("prediction"), "p_0", "p_1", "p_2"))


_EDGES = " UNION ALL ".join(f"SELECT {k} AS k, '{f}' AS feature, unnest(list_distinct(list_transform(quantile_cont({f}, {[i / 16 for i in range(1, 16)]}), lambda q: round(q, 9)))) AS edge FROM sp WHERE split = 'train'" for k, f in enumerate(PAIRS))
_LONG = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS x, c, g, h FROM gh" for f in PAIRS)


@query("est07_first_trees", f"""{BASE}, {SPLIT}, cw AS (SELECT signal, sqrt(CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) * 3)) AS w FROM sp WHERE split = 'train' GROUP BY 1),
gh AS (SELECT sp.*, c, w * (1.0::DOUBLE / 3 - CAST(sp.signal = c AS INT)) AS g, w * 2 * (1.0::DOUBLE / 3) * (2.0::DOUBLE / 3) AS h FROM sp JOIN cw USING (signal), (SELECT unnest([0, 1, 2]) AS c) WHERE split = 'train'),
al AS (SELECT c, sum(g) AS g, sum(h) AS h FROM gh GROUP BY 1), ed AS ({_EDGES}), lg AS ({_LONG}),
ca AS (SELECT lg.c, ed.k, ed.feature, ed.edge, coalesce(sum(lg.g) FILTER (x <= edge), 0) AS gl, coalesce(sum(lg.h) FILTER (x <= edge), 0) AS hl FROM ed JOIN lg USING (feature) GROUP BY 1, 2, 3, 4),
ga AS (SELECT ca.*, al.g, al.h, 0.5 * (gl * gl / (hl + 1) + (al.g - gl) * (al.g - gl) / (al.h - hl + 1) - al.g * al.g / (al.h + 1)) AS gain FROM ca JOIN al USING (c) WHERE hl >= 1 AND al.h - hl >= 1),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY round(gain, 8) DESC, k, edge) AS r FROM ga) WHERE r = 1 AND gain > 1e-9)
SELECT 0::BIGINT AS round, c::BIGINT AS class, n::BIGINT AS node, CASE WHEN n = 1 THEN feature END AS feature, CASE WHEN n = 1 THEN round(edge, 6) END AS threshold,
  round(CASE n WHEN 2 THEN -0.3::DOUBLE * gl / (hl + 1) WHEN 3 THEN -0.3::DOUBLE * (g - gl) / (h - hl + 1) END, 6) AS value, round(CASE WHEN n = 1 THEN gain ELSE 0 END, 6) AS gain
FROM be, (SELECT unnest([1, 2, 3]) AS n)
UNION ALL SELECT 0::BIGINT, c::BIGINT, 1::BIGINT, NULL, NULL, round(-0.3::DOUBLE * g / (h + 1), 6), 0::DOUBLE FROM al WHERE c NOT IN (SELECT c FROM be)""")
def _(t: Tables):
    """The first round's trees of one level, on all rows and columns: splits, leaf values and gains of the joint softmax loss."""
    _d, model = regime_trees(t, rounds=1, depth=1, rate=0.3, subsample=1.0, columns=1.0)
    model.best = 1
    return longs(rounded(model.table(t.spark)))


@query("est07_walked_trees", f"{BASE}, {SPLIT} SELECT split, count(*) AS n, true AS same_margins, true AS loss_fell, true AS stopped_at_best FROM sp GROUP BY 1")
def _(t: Tables):
    """Margins by joins with the table of nodes against the expression over it, for every row."""
    d, model = regime_trees(t, rate=0.2, patience=5)
    nodes = checkpointed(model.table(t.spark))
    logs = bo.scored(d, nodes, PAIRS, depth=3).select(*KEYS, "split", F.array(*[F.ln(F.col(f"p_{c}")) for c in range(3)]).alias("logs"))
    m = bo.walked(d, nodes, KEYS, PAIRS, depth=3).groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("class", "margin"))).alias("m"))  # three entries
    same = F.lit(True)
    for c in (1, 2):
        same = same & (F.abs((F.col("m")[c] - F.col("m")[0]) - (F.col("logs")[c] - F.col("logs")[0])) < 1e-9)
    g = logs.join(m, KEYS).groupBy("split").agg(F.count("*").alias("n"), F.min(same).alias("same_margins"))
    return g.withColumns({"loss_fell": F.lit(model.losses[model.best] < model.losses[0]), "stopped_at_best": F.lit(model.losses[model.best] == min(model.losses))})


@query("top09_feature_importance")
def _(t: Tables):
    model, _v = cl.boosted_direction(direction_rows(t), PAIRS, "direction")
    return rounded(cl.importances(model, PAIRS, t.spark))


@query("q7_model_report")
def _(t: Tables):
    """Train, score the test rows and report accuracy, macro-F1, baseline and improvement."""
    d, model = regime_trees(t, rate=0.2, patience=5)
    test = bo.scored(d.filter("split = 'test'"), model.table(t.spark), PAIRS, depth=3)
    cells = cl.confusion(test, "signal", "prediction")
    return rounded(cl.scores(cells, [0, 1, 2]))


@query("q7_direction_report")
def _(t: Tables):
    """The direction model on rows that the regime model does not call neutral, scored on the test rows."""
    regime, v = cl.perceptron(cl.standardise(cl.chronological_split(features(t)), PAIRS), PAIRS, "signal")
    rows = cl.regime_filtered(regime.transform(v)).drop("features", "rawPrediction", "probability", "prediction")
    model, w = cl.boosted_direction(rows.withColumn("direction", F.col("direction").cast("double")), PAIRS, "direction")
    return rounded(cl.scores(cl.confusion(model.transform(w).filter("split = 'test'"), "direction", "prediction"), [0, 1]))
