"""Nested records and their figures."""

from pyspark.sql import functions as F

from tidewright.operators import records as rc


def test_figures_of_any_depth(spark):
    schema = """symbol string, a struct<x:double,flag:boolean,when:date,inner:struct<list:array<struct<v:int,tags:array<string>,m:map<string,struct<q:float>>>>>>,
      peers array<map<string,bigint>>, plain decimal(10,2), matrix array<array<double>>, text string"""
    rows = [
        ("A", (1.5, True, None, ([(7, ["t"], {"k": (0.5,), "n": None}), (None, None, None), None],)), [{"P1": 3, "P2": None}, None, {}], None, [[1.0, float("nan")], None, []], "9"),
        ("B", None, None, None, None, None),
        ("C", (None, None, None, None), [], None, [], "x"),
        ("C", (2.0, False, None, ([],)), None, None, None, None),
    ]
    got = sorted((r.symbol, r.path, r.value) for r in rc.flattened(spark.createDataFrame(rows, schema), ["symbol"]).collect())
    assert got == [
        ("A", "a.inner.list[0].m['k'].q", 0.5), ("A", "a.inner.list[0].v", 7.0), ("A", "a.x", 1.5), ("A", "matrix[0][0]", 1.0), ("A", "peers[0]['P1']", 3.0), ("C", "a.x", 2.0),
    ]
    plain = spark.createDataFrame([("A", "x")], "symbol string, text string")
    assert rc.flattened(plain, ["symbol"]).count() == 0 and rc.flattened(plain.limit(0), ["symbol"]).columns == ["symbol", "path", "value"]


def bundle(spark):
    obs = spark.createDataFrame([("A", 5, 2.0, "typical"), ("B", 6, -1.0, "1-sigma"), ("C", 5, 0.0, "typical")], "symbol string, session long, return_pct double, outlier string")
    factor = "symbol string, rank int, factor_id string, hit_rate double, beats_base_rate boolean"
    ranked = rc.with_relation(spark.createDataFrame([("A", 2, "ext1", 0.6, True), ("A", 1, "own", 0.9, True), ("A", 3, "ext2", None, False)], factor), ["own"])
    claims = spark.createDataFrame([("A", -1), ("B", -1), ("C", 1), ("Z", 1), ("B", None)], "symbol string, direction int")
    counter = rc.wrong_premise(obs, claims)
    market = spark.createDataFrame([("A", 1.25)], "symbol string, beta double")
    breadth = spark.createDataFrame([(5, 50.0), (9, 1.0)], "ts long, rising_pct double")
    parts = spark.createDataFrame([(5, 2, "q"), (5, 1, "p"), (6, 1, "r")], "ts long, rank int, constituent string")
    return rc.attribution_bundle(obs, ranked, counter, market, breadth, parts)


def test_bundles_keep_order_relation_and_gaps(spark):
    got = {r.symbol: r for r in bundle(spark).collect()}
    assert set(got) == {"A", "B", "C"}
    a, b = got["A"], got["B"]
    assert a.external == ["ext1", "ext2"] and a.mechanical == ["own"] and a.supported == ["ext1"]  # a part of the move is never support for it
    assert [f.factor_id for f in a.factors] == ["own", "ext1", "ext2"] and a.market.beta == 1.25 and a.breadth.rising_pct == 50.0
    assert [c.constituent for c in a.contributions] == ["p", "q"] and [c.item for c in a.counterevidence] == ["wrong_premise"]
    assert b.market is None and b.breadth is None and b.factors == [] and b.external == [] and [c.constituent for c in b.contributions] == ["r"] and b.counterevidence == []
    assert [c.item for c in got["C"].counterevidence] == ["wrong_premise"]  # flat is neither up nor down
    figures = rc.flattened(bundle(spark).drop("session"), ["symbol"]).filter(F.col("symbol") == "A").collect()
    assert {r.path for r in figures} >= {"factors[1].hit_rate", "observation.return_pct", "market.beta", "contributions[0].rank", "breadth.rising_pct"}
