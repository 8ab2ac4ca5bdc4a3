"""Lookups by tolerance, by prefix and by alias, all as equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions.fixed import ALIASES, CURRENCIES, SEARCH_KEYS


def strike_tolerance_join(positions: DataFrame, quotes: DataFrame, tolerance: float, first_by: str) -> DataFrame:
    """Match strikes closer than ``tolerance``; of several quotes the first by ``first_by``.

    A position looks into its own grid cell and the two next to it, so the join is on equality.
    """
    cell = F.floor(F.col("strike") / tolerance)
    p = positions.select("*", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")).withColumnRenamed("strike", "held")
    q = quotes.withColumn("cell", cell)
    near = p.join(q, ["symbol", "kind", "cell"]).filter(F.abs(F.col("held") - F.col("strike")) < tolerance)
    return near.groupBy("position_id").agg(F.min(first_by).alias(first_by))


def search_table(spark: SparkSession) -> DataFrame:
    """Every prefix of every search key, and every ticker, pointing to its symbol (a literal of bounded size)."""
    rows = [(i, k, s, n) for i, (k, s, n) in enumerate(SEARCH_KEYS)]
    keys = spark.createDataFrame(rows, "pos int, key string, symbol string, kind string")
    prefixes = keys.select("pos", "symbol", "kind", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("query"))
    tickers = keys.select("pos", "symbol", "kind", F.lower("symbol").alias("query"))
    return prefixes.unionByName(tickers).groupBy("query", "symbol", "kind").agg(F.min("pos").alias("pos"))


def search_symbols(queries: DataFrame, table: DataFrame, limit: int) -> DataFrame:
    """Matches per query: an exact ticker first, then table order; at most ``limit``."""
    hit = queries.join(F.broadcast(table), "query")
    exact = F.when(F.lower("symbol") == F.col("query"), 0).otherwise(1)
    w = Window.partitionBy("query").orderBy(exact, "pos")
    return hit.select("query", "symbol", "kind", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= limit)


def resolve_symbols(tokens: DataFrame, column: str) -> DataFrame:
    """Spelling to ticker: alias, then currency pair, then class share, else the token itself."""
    spark = tokens.sparkSession
    alias = spark.createDataFrame(list(ALIASES.items()), "token string, target string")
    codes = "|".join(CURRENCIES)
    t = tokens.withColumn("token", F.regexp_replace(F.upper(F.trim(column)), r"^\$+", ""))
    pair = F.regexp_replace("token", "/", "")
    is_pair = pair.rlike(f"^({codes})({codes})$")
    known = F.col("target").isNotNull()
    return t.join(F.broadcast(alias), "token", "left").select(
        column,
        F.when(known, F.col("target")).when(is_pair, pair)
        .when(F.col("token").rlike(r"^[A-Z]{1,5}\.[A-Z]$"), F.regexp_replace("token", r"\.", "-"))
        .otherwise(F.col("token")).alias("ticker"),
        F.when(known, F.col("target").endswith("=X")).otherwise(is_pair).alias("is_fx"),
    )
