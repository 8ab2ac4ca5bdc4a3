"""Joins in time: as-of, bounded as-of, interval and episode joins over sorted series.

An as-of join is a union of the distinct asks and the right side, followed by one window per key ("last known value");
requests meet their answer by equality on key and time. A window holds at most one ask per key and time, so a key with most of
all requests is no large group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str,
              values: list[str], skip_null_values: bool = False) -> DataFrame:
    """For each left row the last right row at or before it (``src_ts`` is that row's time).

    With ``skip_null_values`` every value is its own last known one; otherwise the values of the one
    last row are taken together, NULLs included. A left row without a key or time finds nothing.
    """
    a = left.select(*keys, F.col(left_ts).alias("__t")).distinct().select(
        *keys, "__t", F.lit(1).alias("__side"),
        F.lit(None).cast(right.schema[right_ts].dataType).alias("src_ts"),
        *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values],
    )
    b = right.select(
        *keys, F.col(right_ts).alias("__t"), F.lit(0).alias("__side"),
        F.col(right_ts).alias("src_ts"), *values,
    )
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b)
    if skip_null_values:
        cols = [F.last(v, ignorenulls=True).over(w).alias(v) for v in ["src_ts", *values]]
        found = both.select(*keys, "__t", "__side", *cols)
    else:
        last = F.last(F.when(F.col("__side") == 0, F.struct("src_ts", *values)), ignorenulls=True).over(w)
        found = both.select(*keys, "__t", "__side", last.alias("__m")).select(
            *keys, "__t", "__side", *[F.col(f"__m.{v}").alias(v) for v in ["src_ts", *values]]
        )
    found = found.filter("__side = 1").drop("__side").withColumnRenamed("__t", left_ts)
    return left.join(found, [*keys, left_ts], "left").select(*left.columns, "src_ts", *values)


def bounded_asof_join(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, limit: int) -> DataFrame:
    """As-of join that fills at most ``limit`` left rows in a row after a source date.

    The last source row counts even where its value is NULL; an exact date match uses none of the limit.
    """
    joined = asof_join(left, right, [key], ts, ts, [value])
    stretch = Window.partitionBy(key, "src_ts").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum((F.col(ts) > F.col("src_ts")).cast("int")).over(stretch)
    return joined.withColumn("__used", used).withColumn(value, F.when(F.col("__used") <= limit, F.col(value))).drop("__used", "src_ts")


def interval_join(events: DataFrame, targets: DataFrame, event_date: str, target_date: str, days: int) -> DataFrame:
    """Events within +/- ``days`` of each target date.

    Each target lists its 2 * days + 1 candidate dates, so this is an equi-join (no nested loop).
    """
    spread = F.explode(F.sequence(F.date_sub(target_date, days), F.date_add(target_date, days))).alias(event_date)
    return targets.select("*", spread).join(events, event_date)


def episode_returns(bars: DataFrame, episodes: DataFrame) -> DataFrame:
    """Percent change across dated episodes, from the last close before the start to the last close in it.

    ``episodes`` is a literal table of a few rows, so each bar row is matched to it by broadcast and
    reduced at once by partial aggregation per (symbol, episode).
    """
    return (
        bars.join(F.broadcast(episodes), F.col("ts") <= F.col("end_date"))
        .groupBy("symbol", "episode")
        .agg(
            F.min("ts").alias("first_ts"), F.first("start_date").alias("start_date"),
            F.expr("max_by(close, ts) FILTER (WHERE ts < start_date)").alias("base"),
            F.max_by("close", "ts").alias("last"),
        )
        .select(
            "symbol", "episode",
            F.when((F.col("first_ts") <= F.col("start_date")) & (F.col("base") > 0), (F.col("last") / F.col("base") - 1) * 100).alias("return_pct"),
        )
    )


def overlap_count(selection: DataFrame, evaluated: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``selection`` whose keys also appear in ``evaluated``: must be zero for a clean test."""
    return selection.join(evaluated.select(*keys).distinct(), keys, "left_semi").agg(F.count("*").alias("overlap"))
