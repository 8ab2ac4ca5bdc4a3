"""Exact order statistics of groups of any size.

``percentile`` keeps a whole group in one task. Here distinct values are counted first, value ranges
come from a mergeable sketch, and exact positions are counted inside each range, so a group that
holds a third of all rows is still spread over many tasks. The sketch only balances the ranges; the
positions, and so the quantiles, are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 128


def positions(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per (keys, distinct value): its count ``n``, rows below it ``lo`` and rows in the group ``total``."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    probs = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, probs, 1000).alias("cuts"))
    one = ["__one"] if not keys else []
    if one:
        counts, cuts = counts.withColumn("__one", F.lit(1)), cuts.withColumn("__one", F.lit(1))
    k = keys or one
    ranged = counts.join(cuts, k).withColumn("rng", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")
    totals = ranged.groupBy(*k, "rng").agg(F.sum("n").alias("m"))
    wk = Window.partitionBy(*k).orderBy("rng")
    offsets = totals.select(
        *k, "rng", F.coalesce(F.sum("m").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"),
        F.sum("m").over(Window.partitionBy(*k)).alias("total"),
    )
    inside = Window.partitionBy(*k, "rng").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(offsets, [*k, "rng"]).withColumn("lo", F.col("off") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return out.drop("rng", "off", *one)


def value_at(value: str, index: Column) -> Column:
    """Aggregate over ``positions`` rows: the value at a zero-based index of the sorted group."""
    hit = (F.col("lo") <= index) & (index < F.col("lo") + F.col("n"))
    return F.max(F.when(hit, F.col(value)))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], out: str = "quantiles") -> DataFrame:
    """Linear-interpolated quantiles per group as an array, one row per group."""
    p = positions(df, keys, value)
    cols = []
    for i, q in enumerate(probs):
        at = (F.col("total") - 1) * F.lit(q)
        cols += [value_at(value, F.floor(at)).alias(f"__a{i}"), value_at(value, F.ceil(at)).alias(f"__b{i}"),
                 F.max(at - F.floor(at)).alias(f"__f{i}")]
    g = p.groupBy(*keys).agg(*cols, F.max("total").alias("n"))
    quantiles = F.array(*[F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * F.col(f"__f{i}") for i in range(len(probs))])
    return g.select(*keys, "n", quantiles.alias(out))


def leave_one_out_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per (keys, distinct value): the median of the group with one such row left out, and its size.

    Only the middle values of a group matter, so no pair of members is ever formed.
    """
    p = positions(df, keys, value)
    others = F.col("total") - 1
    lower = F.floor((others - 1) / 2)
    middle = p.groupBy(*keys).agg(
        value_at(value, lower).alias("a"), value_at(value, lower + 1).alias("b"), value_at(value, lower + 2).alias("c")
    )
    j = p.join(middle, keys)
    before = F.col("lo") <= lower
    first = F.when(before, F.col("b")).otherwise(F.col("a"))
    second = F.when(F.col("lo") <= lower + 1, F.col("c")).otherwise(F.col("b"))
    med = F.when(others % 2 == 1, first).otherwise((first + second) / 2)
    return j.select(*keys, value, others.alias("peers"), F.when(others > 0, med).alias("peer_median"))
