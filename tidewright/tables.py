"""Bindings: how the engine's logical tables are derived from the driver's parquet tables.

Every binding is a Spark job over whole tables. The grain of a derived table bounds the size of one
group: a symbol has at most one bar per session (or hour), however many raw rows it has, so windows
per symbol are bounded by the calendar. Raw rows are only ever grouped by (symbol, session, block),
and a block holds the rows of a bounded range of order keys, so a hot symbol spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.session import checkpointed, dealt

ORDERS_PER_BLOCK = 1 << 18
STEP = 0.0025
TIE_BREAK = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"]

# Macro series id, column name, release lag in days, scheduled monthly release or not.
SERIES_SPEC = [
    ("1-URGENT", "cpi", 43, True),
    ("2-HIGH", "unemployment", 36, True),
    ("3-MEDIUM", "yield_2y", 1, False),
    ("4-NOT SPECIFIED", "yield_10y", 1, False),
    ("5-LOW", "credit_spread", 1, False),
]


def tick_bars(ticks: DataFrame) -> DataFrame:
    """Daily bars from ticks(symbol, ts, block, qty, step, <tie-break columns>).

    The log price is a running sum of integer steps over all ticks of a symbol, scaled per session
    by the root of its tick count (so volatility does not depend on table size). The running sum is
    built in three levels - inside a block, over the blocks of a session, over the sessions of a
    symbol - so no task ever holds all ticks of one symbol.
    """
    inside = (
        Window.partitionBy("symbol", "ts", "block")
        .orderBy(*TIE_BREAK)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    blocks = (
        ticks.withColumn("run", F.sum("step").over(inside))
        .groupBy("symbol", "ts", "block")
        .agg(
            F.sum("step").alias("total"),
            F.max("run").alias("hi"),
            F.min("run").alias("lo"),
            F.min_by("step", F.struct(*TIE_BREAK)).alias("first"),
            F.sum("qty").alias("qty"),
            F.count("*").alias("n"),
        )
    )
    # A session's blocks are folded by running windows over one sort; a hash table of sessions would hold a task's whole share of them.
    session = Window.partitionBy("symbol", "ts").orderBy("block")
    so_far = session.rowsBetween(Window.unboundedPreceding, 0)
    days = (
        blocks.withColumn("base", F.sum("total").over(so_far) - F.col("total"))
        .select(
            "symbol", "ts",
            F.first("first").over(so_far).alias("o"),
            F.max(F.col("base") + F.col("hi")).over(so_far).alias("h"),
            F.min(F.col("base") + F.col("lo")).over(so_far).alias("l"),
            F.sum("total").over(so_far).alias("c"),
            F.sum("qty").over(so_far).alias("volume"),
            F.sqrt(F.sum("n").over(so_far)).alias("root"),
            F.lead("block").over(session).isNull().alias("whole"),
        )
        .filter("whole")
    )
    earlier = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    # A task's share of symbols is what all windows that follow sort; merged by size, few bytes of bars would be few, large shares.
    series = dealt(days, "symbol").withColumn("base", F.coalesce(F.sum(F.col("c") / F.col("root")).over(earlier), F.lit(0.0)))

    def price(off: str) -> Column:
        return F.round(100 * F.exp(STEP * (F.col("base") + F.col(off) / F.col("root"))), 4)

    return series.select(
        "symbol", "ts",
        price("o").alias("open"), price("h").alias("high"),
        price("l").alias("low"), price("c").alias("close"), "volume",
    )


def bars_sql(symbol: str, name: str = "bars") -> str:
    """The same bars in plain SQL (one window per symbol), for the oracle."""
    return f"""{name}_t AS (SELECT {symbol} AS symbol, CAST(l_shipdate AS DATE) AS ts, l_quantity AS qty,
    CAST(round(l_discount * 100) AS INT) - 5 AS step,
    row_number() OVER (PARTITION BY {symbol}, l_shipdate
      ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount) AS seq
  FROM lineitem),
{name}_p AS (SELECT *, sum(step) OVER (PARTITION BY symbol, ts ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run,
    count(*) OVER (PARTITION BY symbol, ts) AS n FROM {name}_t),
{name}_d AS (SELECT symbol, ts, max(CASE WHEN seq = 1 THEN run END) AS o, max(run) AS h, min(run) AS l,
    max(CASE WHEN seq = n THEN run END) AS c, sum(qty) AS volume, sqrt(max(n)) AS root
  FROM {name}_p GROUP BY symbol, ts),
{name}_b AS (SELECT *, coalesce(sum(c / root) OVER (PARTITION BY symbol ORDER BY ts
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM {name}_d),
{name} AS (SELECT symbol, ts, round(100 * exp(0.0025 * (base + o / root)), 4) AS open,
    round(100 * exp(0.0025 * (base + h / root)), 4) AS high, round(100 * exp(0.0025 * (base + l / root)), 4) AS low,
    round(100 * exp(0.0025 * (base + c / root)), 4) AS close, volume FROM {name}_b)"""


INDEX_SQL = bars_sql("l_returnflag || l_linestatus")
STOCK_SQL = bars_sql("'S' || l_suppkey", "stocks")
HOURLY_SQL = """hourly AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
    arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close,
    CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"""
MACRO_SQL = """macro_obs AS (SELECT o_orderpriority AS series_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH')
    THEN CAST(date_trunc('month', o_orderdate) AS DATE) ELSE CAST(o_orderdate AS DATE) END AS ref_date,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) // count(*) AS DOUBLE) / 1000000 AS value FROM orders GROUP BY 1, 2)"""
SPEC_SQL = """spec(series_id, name, lag_days, has_consensus) AS (VALUES ('1-URGENT', 'cpi', 43, true),
    ('2-HIGH', 'unemployment', 36, true), ('3-MEDIUM', 'yield_2y', 1, false),
    ('4-NOT SPECIFIED', 'yield_10y', 1, false), ('5-LOW', 'credit_spread', 1, false))"""
BOOK_SQL = """book AS (SELECT p_brand AS symbol, p_partkey AS contract_id,
    CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS kind, p_retailprice AS strike, CAST(950 AS DOUBLE) AS spot,
    p_size / CAST(365 AS DOUBLE) AS years, CAST(0.04 AS DOUBLE) AS rate, 0.10 + (p_partkey % 40) / CAST(100 AS DOUBLE) AS vol FROM part)"""
FUND_SQL = """fundamentals AS (SELECT s_suppkey AS symbol, s_nationkey AS sector,
    round(s_acctbal / 10000, 6) AS profit_margin FROM supplier)"""


class Tables:
    """Logical tables over one folder of parquet files."""

    def __init__(self, spark: SparkSession, path: str, reuse: bool = False):
        """With ``reuse`` the session bars are written once to the checkpoint folder and read from there:
        for queries that need them several times, a small table instead of repeated raw scans."""
        self.spark = spark
        self.path = path
        self.reuse = reuse
        self._kept: dict[str, DataFrame] = {}

    def _once(self, name: str, symbol: Column) -> DataFrame:
        if not self.reuse:
            return tick_bars(self._ticks(symbol))
        if name not in self._kept:
            self._kept[name] = checkpointed(tick_bars(self._ticks(symbol)))
        return self._kept[name]

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def _ticks(self, symbol: Column) -> DataFrame:
        return self.raw("lineitem").select(
            symbol.alias("symbol"),
            F.to_date("l_shipdate").alias("ts"),
            F.floor(F.col("l_orderkey") / ORDERS_PER_BLOCK).alias("block"),
            F.col("l_quantity").alias("qty"),
            (F.round(F.col("l_discount") * 100).cast("int") - 5).alias("step"),
            *TIE_BREAK,
        )

    def bars(self) -> DataFrame:
        """Index-like daily bars: a few symbols with long histories."""
        return self._once("bars", F.concat("l_returnflag", "l_linestatus"))

    def stocks(self) -> DataFrame:
        """Stock-like daily bars: one symbol per supplier, so symbols grow with the table."""
        return self._once("stocks", F.concat(F.lit("S"), F.col("l_suppkey")))

    def hourly(self) -> DataFrame:
        """Hourly candles from raw events: open and close by ingest order, partial aggregates only."""
        return (
            self.raw("events")
            .groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("ts"))
            .agg(
                F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"),
                F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"),
                F.count("*").cast("double").alias("volume"),
            )
        )

    def macro_obs(self) -> DataFrame:
        """Two monthly and three daily series; the mean is in whole cents, so it is exact."""
        monthly = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        day = F.to_date("o_orderdate")
        return (
            self.raw("orders")
            .groupBy(
                F.col("o_orderpriority").alias("series_id"),
                F.when(monthly, F.trunc(day, "month")).otherwise(day).alias("ref_date"),
            )
            .agg((F.expr("sum(cast(round(o_totalprice * 100) as bigint)) div count(*)") / 1000000).alias("value"))
        )

    def series_spec(self) -> DataFrame:
        return F.broadcast(
            self.spark.createDataFrame(
                SERIES_SPEC, "series_id string, name string, lag_days int, has_consensus boolean"
            )
        )

    def option_book(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_brand").alias("symbol"), F.col("p_partkey").alias("contract_id"),
            F.when(F.col("p_partkey") % 2 == 0, "call").otherwise("put").alias("kind"),
            F.col("p_retailprice").alias("strike"), F.lit(950.0).alias("spot"),
            (F.col("p_size") / 365.0).alias("years"), F.lit(0.04).alias("rate"),
            (0.10 + (F.col("p_partkey") % 40) / 100.0).alias("vol"),
        )

    def fundamentals(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").alias("sector"),
            F.round(F.col("s_acctbal") / 10000, 6).alias("profit_margin"),
        )
