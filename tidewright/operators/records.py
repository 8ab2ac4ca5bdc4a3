"""Nested evidence records: one bundle for each symbol, and every figure of any record as a row with its path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators import evidence as ev

NUMBER = "array<struct<path:string,value:double>>"


def _none() -> Column:
    return F.array().cast(NUMBER)


def _numbers(value: Column, kind: T.DataType, path: Column) -> Column:
    """All known numbers below ``value`` as (path, value); the schema decides the shape, so that this is one expression."""
    if isinstance(kind, T.StructType):
        parts = [_numbers(value.getField(f.name), f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields]
        return F.concat(*parts) if parts else _none()
    if isinstance(kind, T.ArrayType):
        each = lambda item, i: _numbers(item, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))
        return F.coalesce(F.flatten(F.transform(value, each)), _none())
    if isinstance(kind, T.MapType):
        each = lambda e: _numbers(e["value"], kind.valueType, F.concat(path, F.lit("['"), e["key"].cast("string"), F.lit("']")))
        return F.coalesce(F.flatten(F.transform(F.map_entries(value), each)), _none())
    if isinstance(kind, T.NumericType):
        number = value.cast("double")
        return F.when(number.isNotNull() & ~F.isnan(number), F.array(F.struct(path.alias("path"), number.alias("value"))).cast(NUMBER)).otherwise(_none())
    return _none()


def flattened(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, value): every number of the other columns, however deep, as ``a.b[0].c['k']``; no shuffle.

    Booleans, texts and dates are no figures; unknown numbers, NaN and empty or NULL containers give no row.
    """
    fields = [f for f in records.schema.fields if f.name not in keys]
    found = [_numbers(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name)) for f in fields]
    return records.select(*keys, F.explode(F.concat(*found) if found else _none()).alias("n")).select(*keys, "n.path", "n.value")


def with_relation(factors: DataFrame, mechanical: list[str]) -> DataFrame:
    """Add ``relation``: mechanical for series that the symbols themselves are part of, external for the others."""
    return factors.withColumn("relation", F.when(F.col("factor_id").isin(mechanical), "mechanical").otherwise("external"))


def wrong_premise(observations: DataFrame, claims: DataFrame) -> DataFrame:
    """(symbol, item, factor_id): symbols that did not go where the claim (symbol, direction of -1 or 1) says; a flat move fits no claim."""
    j = observations.select("symbol", F.signum("return_pct").alias("went")).join(claims, "symbol")
    return j.filter("direction IS NOT NULL AND went IS NOT NULL AND direction <> went").select("symbol", F.lit("wrong_premise").alias("item"), F.lit(None).cast("string").alias("factor_id"))


def _listed(df: DataFrame, key: str, order: str, columns: list[str], name: str) -> DataFrame:
    """An array of structs for each key, in order; as many as there are factors, items or constituents."""
    items = F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order])))
    return df.groupBy(key).agg(items.alias(name))


def attribution_bundle(observations: DataFrame, ranked: DataFrame, counter: DataFrame, market: DataFrame, breadth: DataFrame, contributions: DataFrame) -> DataFrame:
    """One record a symbol: its last move, market model, breadth and index constituents of that session, factors and counter-evidence.

    ``observations`` has one row for each symbol (symbol, session, ...); the rest is keyed by symbol, or by ts for breadth and contributions.
    A family without rows for a symbol is NULL there (an empty array for lists). ``external``, ``mechanical`` and ``supported`` are the
    factors of a relation in rank order; supported ones are external and beat their base rate: a series that a symbol is
    part of explains nothing, however often it agrees.
    """
    fields = lambda df, *without: [c for c in df.columns if c not in without]
    pack = lambda df, key, name: df.select(key, F.struct(*fields(df, key)).alias(name))
    out = observations.select("symbol", "session", F.struct(*fields(observations, "symbol", "session")).alias("observation"))
    out = out.join(pack(market, "symbol", "market"), "symbol", "left")
    days = pack(breadth, "ts", "breadth").join(_listed(contributions, "ts", "rank", fields(contributions, "ts"), "contributions"), "ts", "full")
    out = out.join(days.withColumnRenamed("ts", "session"), "session", "left")
    out = out.join(_listed(ranked, "symbol", "rank", fields(ranked, "symbol"), "factors"), "symbol", "left")
    out = out.join(_listed(counter, "symbol", "item", ["item", "factor_id"], "counterevidence"), "symbol", "left")
    for name in ("contributions", "factors", "counterevidence"):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    ids = lambda keep: F.transform(F.filter("factors", keep), lambda f: f["factor_id"])
    return out.withColumns({
        "external": ids(lambda f: f["relation"] == "external"),
        "mechanical": ids(lambda f: f["relation"] == "mechanical"),
        "supported": ids(lambda f: (f["relation"] == "external") & f["beats_base_rate"]),
    })


def counter_items(observations: DataFrame, scored: DataFrame, claims: DataFrame) -> DataFrame:
    """The counter-evidence of each symbol, that its premise is wrong included."""
    return reduce(DataFrame.unionByName, [ev.counter_evidence(observations, scored), wrong_premise(observations, claims)])
