"""Landed payloads to typed tables: candles, open interest, macro JSON, option pages, fundamentals, news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.fixed import FUNDAMENTAL_FIELDS, PLAUSIBLE_CEILING
from tidewright.functions.nulls import clean_double, require_columns

BAR_SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def read_bars(spark, path: str, fmt: str = "parquet", schema: str = BAR_SCHEMA) -> DataFrame:
    """Scan bars with a declared schema (no inference), so pruning and pushdown reach the files."""
    reader = spark.read.schema(schema)
    return (reader.option("header", "true") if fmt == "csv" else reader).format(fmt).load(path)


def candles_to_bars(raw: DataFrame) -> DataFrame:
    """Exchange candles with an epoch-millisecond ``timestamp`` to typed bars."""
    return require_columns(raw, ["timestamp"]).select(
        *[c for c in raw.columns if c != "timestamp"], F.timestamp_millis("timestamp").alias("ts")
    )


def parse_open_interest(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Open-interest JSON rows: rename, project, coerce numerics (a bad number is NULL)."""
    p = F.from_json(payload, "timestamp bigint, sumOpenInterest string, sumOpenInterestValue string")
    return raw.select(*[c for c in raw.columns if c != payload], p.alias("p")).select(
        *[c for c in raw.columns if c != payload], F.timestamp_millis("p.timestamp").alias("ts"),
        F.expr("try_cast(p.sumOpenInterest AS double)").alias("open_interest"),
        F.expr("try_cast(p.sumOpenInterestValue AS double)").alias("open_interest_value"),
    )


def normalize_ohlcv(raw: DataFrame, seq: str, stamp: str) -> DataFrame:
    """One bar per symbol and day: the last ingested duplicate wins, unknown closes are dropped.

    The winner is picked by a partial aggregate, so duplicates collapse before the shuffle.
    """
    fields = ["open", "high", "low", "close", "volume"]
    require_columns(raw, [*fields, seq, stamp])
    day = F.to_date(stamp)
    best = raw.groupBy("symbol", day.alias("ts")).agg(F.max_by(F.struct(*fields), seq).alias("r"))
    return best.select("symbol", "ts", *[F.col(f"r.{c}").alias(c) for c in fields]).filter(
        F.col("close").isNotNull() & ~F.isnan("close")
    )


def parse_observations(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Macro API documents to (series_id, ref_date, value); the missing marker and bad numbers are skipped."""
    body = F.from_json(payload, "observations array<struct<date: string, value: string>>")
    rows = raw.select("series_id", F.explode(body["observations"]).alias("o"))
    return rows.select(
        "series_id", F.expr("CAST(try_to_timestamp(o.date, 'yyyy-MM-dd') AS date)").alias("ref_date"),
        F.expr("try_cast(nullif(o.value, '.') AS double)").alias("value"),
    ).filter("value IS NOT NULL AND ref_date IS NOT NULL")


def fold_contracts(contracts: DataFrame) -> DataFrame:
    """Option snapshot rows to one row per (symbol, strike, expiry): last price per side, first known IV."""
    ok = contracts.filter("strike IS NOT NULL AND expiry IS NOT NULL AND side IN ('call', 'put')")
    return ok.groupBy("symbol", "strike", "expiry").agg(
        F.expr("max_by(price, seq) FILTER (WHERE side = 'call')").alias("call_price"),
        F.expr("max_by(price, seq) FILTER (WHERE side = 'put')").alias("put_price"),
        F.expr("min_by(iv, seq) FILTER (WHERE iv IS NOT NULL)").alias("iv"),
    )


def vendor_quotes(calls: DataFrame, puts: DataFrame) -> DataFrame:
    """Vendor call and put tables to quote rows; blanks and NaN are unknown, counts default to zero."""
    both = calls.withColumn("kind", F.lit("call")).unionByName(puts.withColumn("kind", F.lit("put")))
    price = {c: clean_double(F.expr(f"try_cast({v} AS double)")) for c, v in
             [("strike", "strike"), ("bid", "bid"), ("ask", "ask"), ("last", "lastPrice"), ("vendor_iv", "impliedVolatility")]}
    count = {c: F.coalesce(clean_double(F.expr(f"try_cast({v} AS double)")), F.lit(0.0)).cast("bigint") for c, v in
             [("volume", "volume"), ("open_interest", "openInterest")]}
    return both.select("symbol", "expiry", "kind", *[x.alias(c) for c, x in {**price, **count}.items()]).filter("strike > 0")


def normalize_fundamentals(raw: DataFrame, info: str = "info") -> DataFrame:
    """Vendor field map to our names as fractions, with missing and implausible fields listed."""

    def known(vendor: str, percent: bool) -> Column:
        x = clean_double(F.expr(f"try_cast({info}['{vendor}'] AS double)"))
        return x / 100.0 if percent else x

    entries = F.array(*[F.struct(F.lit(n).alias("key"), known(v, p).alias("value")) for v, n, p in FUNDAMENTAL_FIELDS])
    ceiling = F.create_map(*[x for k, v in PLAUSIBLE_CEILING.items() for x in (F.lit(k), F.lit(v))])
    df = raw.withColumn("__e", entries)
    present = F.filter("__e", lambda e: e["value"].isNotNull())
    odd = F.filter(present, lambda e: F.coalesce(F.abs(e["value"]) > ceiling[e["key"]], F.lit(False)))
    return df.select(
        *[c for c in raw.columns if c != info],
        F.map_from_entries(present).alias("values"),
        F.transform(F.filter("__e", lambda e: e["value"].isNull()), lambda e: e["key"]).alias("missing"),
        F.map_from_entries(F.transform(odd, lambda e: F.struct(e["key"], F.format_string("%.2f", e["value"])))).alias("suspicious"),
    )


def normalize_headlines(raw: DataFrame, limit: int) -> DataFrame:
    """News items (symbol, seq, item JSON) to rows: first ``limit`` per symbol, nested fields with fallback."""
    first = Window.partitionBy("symbol").orderBy("seq")

    def get(path: str) -> Column:
        nested, flat = F.get_json_object("item", f"$.content.{path}"), F.get_json_object("item", f"$.{path}")
        return F.when(F.get_json_object("item", "$.content").isNotNull(), nested).otherwise(flat)

    top = raw.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= limit)
    stamp = F.coalesce(get("pubDate"), get("displayTime"))
    return top.select(
        "symbol", "seq", get("title").alias("title"),
        F.coalesce(get("provider.displayName"), F.lit("unknown")).alias("publisher"),
        F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd'T'HH:mm:ssX")).alias("published"),
        get("canonicalUrl.url").alias("url"),
    ).filter("title IS NOT NULL AND title <> ''")


def history(bars: DataFrame, symbols: list[str] | None, start: str, end: str, min_rows: int) -> DataFrame:
    """Bars of many symbols in a date range (both pushed to the scan); symbols with too few rows are left out."""
    df = bars.filter(F.col("ts").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if symbols is not None:
        df = df.filter(F.col("symbol").isin(symbols))
    n = F.count("*").over(Window.partitionBy("symbol"))
    return df.withColumn("__n", n).filter(F.col("__n") >= min_rows).drop("__n")
