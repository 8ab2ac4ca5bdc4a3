"""Source and sink queries: payloads are built from the tables and parsed by the library."""

from pyspark.sql import functions as F

from tidewright.catalog.registry import longs, query, rounded
from tidewright.operators import macro
from tidewright.sources import market, sinks
from tidewright.tables import BOOK_SQL, HOURLY_SQL, INDEX_SQL, MACRO_SQL, STOCK_SQL, Tables


@query("src01_candle_csv_scan", f"WITH {HOURLY_SQL} SELECT symbol, ts, open, high, low, close, volume FROM hourly")
def _(t: Tables):
    """Candle rows through CSV text and a declared schema."""
    text = t.hourly().select(F.to_csv(F.struct("symbol", "ts", "open", "high", "low", "close", "volume")).alias("line"))
    return text.select(F.from_csv("line", market.BAR_SCHEMA).alias("r")).select("r.*")


@query("src02_exchange_candles", "SELECT event_id, event_type AS symbol, value AS close, CAST(date_trunc('millisecond', ts) AS TIMESTAMP) AS ts FROM events")
def _(t: Tables):
    raw = t.raw("events").select("event_id", F.col("event_type").alias("symbol"), F.col("value").alias("close"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"))
    return market.candles_to_bars(raw)


@query("src03_open_interest", """SELECT event_id, date_trunc('second', ts) AS ts, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS open_interest, value AS open_interest_value FROM events""")
def _(t: Tables):
    """A row of type 'error' carries an unparseable number, which must become NULL."""
    oi = F.when(F.col("event_type") == "error", "n/a").otherwise(F.get_json_object("props", "$.k"))
    body = F.to_json(F.struct((F.unix_seconds(F.col("ts").cast("timestamp")) * 1000).alias("timestamp"), oi.alias("sumOpenInterest"), F.col("value").cast("string").alias("sumOpenInterestValue")))
    return market.parse_open_interest(t.raw("events").select("event_id", body.alias("payload")))


@query("src04_ohlcv_normalised", """SELECT symbol, ts, arg_max(open, seq) AS open, arg_max(high, seq) AS high, arg_max(low, seq) AS low, arg_max(close, seq) AS close, arg_max(volume, seq) AS volume FROM (
  SELECT user_id AS symbol, CAST(ts AS DATE) AS ts, event_id AS seq, value AS open, value + 1 AS high, value - 1 AS low, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS c, value AS volume, coalesce(CASE WHEN event_type <> 'error' THEN value END, -1) AS close FROM events)
  GROUP BY 1, 2 HAVING arg_max(close, seq) <> -1""")
def _(t: Tables):
    """Per user and day the last event wins; an 'error' event has no close, which drops the day."""
    v = F.col("value")
    raw = t.raw("events").select(
        F.col("user_id").alias("symbol"), F.col("ts").alias("stamp"), F.col("event_id").alias("seq"), v.alias("open"), (v + 1).alias("high"),
        (v - 1).alias("low"), F.when(F.col("event_type") != "error", v).alias("close"), v.alias("volume"))
    return market.normalize_ohlcv(raw, "seq", "stamp")


@query("src05_macro_observations", f"WITH {MACRO_SQL} SELECT series_id, ref_date, value FROM macro_obs WHERE extract(day FROM ref_date) <> 13")
def _(t: Tables):
    """Monthly documents per series; day 13 carries the missing marker."""
    o = t.macro_obs()
    value = F.when(F.dayofmonth("ref_date") == 13, ".").otherwise(F.col("value").cast("string"))
    row = F.struct(F.col("ref_date").cast("string").alias("date"), value.alias("value"))
    docs = o.groupBy("series_id", F.trunc("ref_date", "month").alias("m")).agg(F.to_json(F.struct(F.collect_list(row).alias("observations"))).alias("payload"))
    return market.parse_observations(docs)


_CONTRACTS = """c AS (SELECT 'S' || l_suppkey AS symbol, l_quantity AS strike, CAST(date_trunc('month', l_shipdate) AS DATE) AS expiry,
  CASE WHEN l_returnflag = 'N' THEN 'call' WHEN l_returnflag = 'A' THEN 'put' ELSE 'other' END AS side, l_extendedprice AS price,
  CASE WHEN l_tax > 0.02 THEN l_discount END AS iv, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS seq FROM lineitem)"""


@query("src06_option_pages_folded", f"""WITH {_CONTRACTS} SELECT symbol, strike, expiry, arg_max(price, seq) FILTER (side = 'call') AS call_price,
  arg_max(price, seq) FILTER (side = 'put') AS put_price, arg_min(iv, seq) FILTER (iv IS NOT NULL) AS iv FROM c WHERE side IN ('call', 'put') GROUP BY 1, 2, 3""")
def _(t: Tables):
    flag = F.col("l_returnflag")
    c = t.raw("lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), F.col("l_quantity").alias("strike"),
        F.to_date(F.date_trunc("month", "l_shipdate")).alias("expiry"),
        F.when(flag == "N", "call").when(flag == "A", "put").otherwise("other").alias("side"), F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_tax") > 0.02, F.col("l_discount")).alias("iv"),
        (F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("seq"))
    return market.fold_contracts(c)


@query("src07_canonical_chain", f"WITH {BOOK_SQL} SELECT symbol, strike, max(CASE WHEN kind = 'call' THEN spot - strike + 100 END) AS call_price, max(CASE WHEN kind = 'put' THEN strike - spot + 100 END) AS put_price, min(vol) AS iv FROM book GROUP BY symbol, strike")
def _(t: Tables):
    b = t.option_book()
    return b.groupBy("symbol", "strike").agg(
        F.max(F.when(F.col("kind") == "call", F.col("spot") - F.col("strike") + 100)).alias("call_price"),
        F.max(F.when(F.col("kind") == "put", F.col("strike") - F.col("spot") + 100)).alias("put_price"), F.min("vol").alias("iv"))


@query("src08_vendor_quotes", """SELECT p_brand AS symbol, DATE '2024-06-21' AS expiry, CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS kind, p_retailprice AS strike,
  CASE WHEN p_size > 5 THEN p_retailprice / 10 END AS bid, p_retailprice / 9 AS ask, CAST(NULL AS DOUBLE) AS last, p_size / 100.0::DOUBLE AS vendor_iv, CAST(p_size AS BIGINT) AS volume, 0::BIGINT AS open_interest FROM part WHERE p_retailprice > 0""")
def _(t: Tables):
    p = t.raw("part").select(
        F.col("p_brand").alias("symbol"), F.lit("2024-06-21").cast("date").alias("expiry"), "p_partkey", F.col("p_retailprice").cast("string").alias("strike"),
        F.when(F.col("p_size") > 5, F.col("p_retailprice") / 10).otherwise(float("nan")).alias("bid"), (F.col("p_retailprice") / 9).alias("ask"),
        F.lit("").alias("lastPrice"), (F.col("p_size") / 100.0).alias("impliedVolatility"), F.col("p_size").alias("volume"), F.lit(None).cast("string").alias("openInterest"))
    return market.vendor_quotes(p.filter("p_partkey % 2 = 0"), p.filter("p_partkey % 2 = 1")).drop("p_partkey")


@query("src09_fundamentals_normalised", """SELECT s_suppkey AS symbol, CASE WHEN s_nationkey % 4 <> 0 THEN s_acctbal / 100 END AS trailing_pe, (s_acctbal / 100) / 100 AS dividend_yield, s_acctbal / 1000 AS profit_margin,
  CAST(8 + CASE WHEN s_nationkey % 4 = 0 THEN 1 ELSE 0 END - 1 AS BIGINT) AS n_missing, CAST(abs(s_acctbal / 100 / 100) > 0.6 AS BIGINT) + CAST(abs(s_acctbal / 1000) > 5 AS BIGINT) AS n_suspicious FROM supplier""")
def _(t: Tables):
    raw = t.raw("supplier").select(F.col("s_suppkey").alias("symbol"), F.create_map(
        F.lit("trailingPE"), F.when(F.col("s_nationkey") % 4 == 0, "n/a").otherwise((F.col("s_acctbal") / 100).cast("string")),
        F.lit("dividendYield"), (F.col("s_acctbal") / 100).cast("string"), F.lit("profitMargins"), (F.col("s_acctbal") / 1000).cast("string")).alias("info"))
    n = market.normalize_fundamentals(raw)
    return longs(n.select("symbol", *[F.col("values")[c].alias(c) for c in ("trailing_pe", "dividend_yield", "profit_margin")],
                          F.size("missing").alias("n_missing"), F.size("suspicious").alias("n_suspicious")))


@query("src10_headlines", """SELECT conv_id AS symbol, turn AS seq, text AS title, CASE WHEN role = 'user' THEN role ELSE 'unknown' END AS publisher,
  CASE WHEN turn % 2 = 0 THEN TIMESTAMP '2024-01-01 08:30:00' + to_days(CAST(conv_id % 300 AS INT)) END AS published, CAST(NULL AS VARCHAR) AS url
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 6 AND turn % 3 <> 2 AND text <> ''""")
def _(t: Tables):
    """Nested items for even conversations, flat ones for odd; turns 2, 5, ... have no title; odd turns a bad date."""
    day = F.date_format(F.expr("date_add(DATE '2024-01-01', cast(conv_id % 300 as int))"), "yyyy-MM-dd")
    body = F.struct(
        F.when(F.col("turn") % 3 != 2, F.col("text")).alias("title"),
        F.when(F.col("role") == "user", F.struct(F.col("role").alias("displayName"))).alias("provider"),
        F.when(F.col("turn") % 2 == 0, F.concat(day, F.lit("T08:30:00Z"))).otherwise("yesterday").alias("pubDate"))
    item = F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(body.alias("content")))).otherwise(F.to_json(body))
    raw = t.raw("conversations").select(F.col("conv_id").alias("symbol"), F.col("turn").alias("seq"), item.alias("item"))
    return market.normalize_headlines(raw, 6)


@query("src11_many_symbol_history", f"""WITH {STOCK_SQL}, r AS (SELECT * FROM stocks WHERE ts BETWEEN DATE '1996-01-01' AND DATE '1999-12-31')
SELECT symbol, ts, close FROM r WHERE symbol IN (SELECT symbol FROM r GROUP BY symbol HAVING count(*) >= 300)""")
def _(t: Tables):
    return market.history(t.stocks(), None, "1996-01-01", "1999-12-31", 300).select("symbol", "ts", "close")


@query("src12_csv_decimals", f"WITH {INDEX_SQL} SELECT symbol, ts, round(close / 7, 6) AS scaled FROM bars")
def _(t: Tables):
    """Fixed-decimal text and back, as the CSV sink writes it."""
    text = t.bars().select(F.to_csv(F.struct("symbol", F.col("ts").cast("string"), F.format_string("%.6f", F.col("close") / 7))).alias("line"))
    return text.select(F.from_csv("line", "symbol string, ts date, scaled double").alias("r")).select("r.*")


@query("src13_json_documents", f"WITH {INDEX_SQL} SELECT symbol, ts, close, volume FROM bars")
def _(t: Tables):
    """Record trees to JSON documents and back."""
    docs = sinks.to_json_rows(t.bars(), "symbol")
    return docs.select("symbol", F.from_json("document", "ts date, close double, volume double").alias("r")).select("symbol", "r.*")


@query("src14_business_calendar", f"""WITH {MACRO_SQL}, c AS (SELECT CAST(unnest(generate_series(CAST(min(ref_date) AS TIMESTAMP), CAST(max(ref_date) + 43 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ts FROM macro_obs)
SELECT ts FROM c WHERE dayofweek(ts) NOT IN (0, 6)""")
def _(t: Tables):
    return macro.business_calendar(t.macro_obs(), 43)
