"""Row screens and data-quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.nulls import clean_double, require_columns


def usable_quotes(chain: DataFrame, seq: str = "seq") -> DataFrame:
    """Quotes with finite positive strike and iv; of equal strikes the first one is kept."""
    ok = chain.filter((clean_double("strike") > 0) & (clean_double("iv") > 0))
    rest = [c for c in chain.columns if c not in ("symbol", "strike")]
    first = ok.groupBy("symbol", "strike").agg(F.min_by(F.struct(*rest), seq).alias("r"))
    return first.select("symbol", "strike", *[F.col(f"r.{c}").alias(c) for c in rest])


def neutral_filter(df: DataFrame, neutral: Column) -> DataFrame:
    """Drop neutral rows and relabel the outer classes 0 and 2 to 0 and 1."""
    return df.filter(~neutral).withColumn("direction", (F.col("signal") == 2).cast("int"))


def price_sanity(bars: DataFrame) -> DataFrame:
    """Finite rows only; a non-positive price raises when the row is read."""
    require_columns(bars, ["open", "close"])
    known = bars.filter(clean_double("open").isNotNull() & clean_double("close").isNotNull())
    bad = (F.col("open") <= 0) | (F.col("close") <= 0)
    check = F.when(bad, F.raise_error(F.concat(F.lit("non-positive price for "), F.col("symbol"))).cast("double"))
    return known.withColumn("close", F.coalesce(check, F.col("close")))


def interactions(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs})


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long report (column_name, nulls) of the columns that have unknown values, in one pass."""
    counts = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in columns])
    return unpivoted(counts, columns, "column_name", "nulls").filter("nulls > 0")


def unpivoted(df: DataFrame, columns: list[str], name: str, value: str, keep: list[str] | None = None) -> DataFrame:
    return df.unpivot(keep or [], columns, name, value)


def column_spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population std of each column and whether it varies enough to be a feature, in one pass."""
    spread = df.agg(*[F.stddev_pop(c).alias(c) for c in columns])
    return unpivoted(spread, columns, "column_name", "spread").withColumn("keep", F.col("spread") > 1e-12)


def stage_failures(df: DataFrame, stages: list[str]) -> DataFrame:
    """Add ``failed_modules``: names of the stages whose ``<stage>_error`` is set, in stage order."""
    names = F.array(*[F.when(F.col(f"{s}_error").isNotNull(), F.lit(s)) for s in stages])
    return df.withColumn("failed_modules", F.array_join(F.array_compact(names), ";"))


def failure_log(df: DataFrame, stages: list[str], order: str = "ts") -> DataFrame:
    """Per stage: number of failures and the first error text."""
    parts = [
        df.filter(F.col(f"{s}_error").isNotNull())
        .agg(F.count("*").alias("failures"), F.min_by(f"{s}_error", order).alias("first_error"))
        .select(F.lit(s).alias("stage"), "failures", "first_error")
        for s in stages
    ]
    return reduce(DataFrame.unionByName, parts).filter("failures > 0")
