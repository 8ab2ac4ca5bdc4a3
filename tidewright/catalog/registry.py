"""Registry of the queries: a Spark callable, and plain SQL to check it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Queries that read the session bars several times.
REUSE = {
    "flagship_factor_attribution", "agg07_quintile_hit_rates", "agg08_factor_scores", "top01_ranked_factors", "sca19_counter_evidence", "q2_attribution",
    "q4_scenario_outlook", "q5_quant_diagnostics", "q5_native_diagnostics", "q1_divergence_table", "agg17_coverage_report", "agg32_volatility_summary",
    "agg35_regime_classes", "bt05_walk_forward", "bt05_stitched_curve", "agg25_walk_forward_summary",
    "q2_attribution_bundle", "sca21_bundle_numbers", "q9_bundle_facts", "q4_scenario_library", "q4_dated_episodes",
    "agg24_surface_ruggedness", "bt09_option_overlays", "bt12_plans", "est14_implied_views", "est09_smile_fits",
    "bt05_walk_momentum", "bt05_walk_mean_reversion", "bt05_walk_vol_target", "bt05_walk_rsi", "bt05_walk_regime_trend",
}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with its oracle SQL if there is one."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, sf_dir, reuse=name in REUSE))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double so that two engines' last-bit differences do not show; -0.0 becomes 0.0.

    ``special`` names columns that get their own number of digits.
    """
    return df.select(
        *[
            (F.round(F.col(f"`{n}`"), special.get(n, digits)) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def longs(df: DataFrame) -> DataFrame:
    """Integer columns as BIGINT, the type the oracle reports."""
    return df.select(
        *[F.col(f"`{n}`").cast("bigint").alias(n) if t in ("int", "smallint", "tinyint") else F.col(f"`{n}`") for n, t in df.dtypes]
    )
