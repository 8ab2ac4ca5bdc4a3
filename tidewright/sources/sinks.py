"""Writers: CSV with fixed decimals, JSON record trees, and parquet clustered by symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    """CSV with a header and doubles at a fixed number of decimals."""
    cols = [
        F.when(F.col(n).isNotNull(), F.format_string(f"%.{digits}f", F.col(n))).alias(n) if t == "double" else F.col(n)
        for n, t in df.dtypes
    ]
    df.select(*cols).write.mode("overwrite").option("header", "true").csv(path)


def to_json_rows(df: DataFrame, key: str) -> DataFrame:
    """Each row as one JSON document next to its key."""
    return df.select(key, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("document"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_clustered(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Parquet by symbol bucket, sorted inside each file, so a symbol filter prunes folders and row groups."""
    (
        df.withColumn("bucket", F.pmod(F.hash("symbol"), F.lit(buckets)))
        .repartition("bucket", F.year("ts"))
        .sortWithinPartitions("symbol", "ts")
        .write.mode("overwrite").partitionBy("bucket").parquet(path)
    )
