"""Join queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.catalog.registry import longs, query, rounded
from tidewright.catalog.windows import INDEX, RELEASE_SQL, STOCK, W, ALIGNED_SQL
from tidewright.functions.fixed import ALIASES, CURRENCIES, SEARCH_KEYS
from tidewright.operators import asof, lookup, macro
from tidewright.operators import windows as win
from tidewright.tables import BOOK_SQL, HOURLY_SQL, INDEX_SQL, STOCK_SQL, Tables


@query("join01_candles_open_interest", f"WITH {HOURLY_SQL}, oi AS (SELECT date_trunc('hour', ts) AS ts, sum(CAST(json_extract(props, '$.k') AS DOUBLE)) AS oi FROM events WHERE event_type = 'click' GROUP BY 1) SELECT symbol, h.ts, close, oi AS open_interest FROM hourly h JOIN oi ON h.ts = oi.ts")
def _(t: Tables):
    oi = t.raw("events").filter("event_type = 'click'").groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.sum(F.get_json_object("props", "$.k").cast("double")).alias("open_interest"))
    return t.hourly().join(oi, "ts", "inner").select("symbol", "ts", "close", "open_interest")


@query("join02_features_target", f"{STOCK}, f AS (SELECT symbol, ts, close - lag(close, 21) OVER {W} AS chg FROM stocks), y AS (SELECT symbol, ts, (lead(close, 21) OVER {W} / close - 1) * 100 AS fwd FROM stocks) SELECT f.symbol, f.ts, round(chg, 6) AS chg, round(fwd, 6) AS fwd FROM f JOIN y ON f.symbol = y.symbol AND f.ts = y.ts WHERE chg IS NOT NULL AND fwd IS NOT NULL")
def _(t: Tables):
    s = t.stocks()
    f = s.select("symbol", "ts", win.change("close", 21).alias("chg")).dropna()
    y = s.select("symbol", "ts", win.forward_pct("close", 21).alias("fwd")).dropna()
    return rounded(f.join(y, ["symbol", "ts"]))


@query("join03_aligned_series", f"WITH {INDEX_SQL}, {STOCK_SQL} SELECT s.symbol, s.ts, s.close, b.close AS market_close FROM stocks s JOIN bars b ON b.symbol = 'AF' AND s.ts = b.ts")
def _(t: Tables):
    m = t.bars().filter("symbol = 'AF'").select("ts", F.col("close").alias("market_close"))
    return t.stocks().select("symbol", "ts", "close").join(m, "ts")


@query("join05_asof_lookup", f"{STOCK}, q AS (SELECT o_orderkey AS request_id, 'S' || (o_custkey % (SELECT count(*) FROM supplier)) AS symbol, CAST(o_orderdate AS DATE) AS asked FROM orders) SELECT q.request_id, q.symbol, q.asked, s.ts AS src_ts, s.close FROM q ASOF LEFT JOIN stocks s ON q.symbol = s.symbol AND q.asked >= s.ts")
def _(t: Tables):
    q = t.raw("orders").select(F.col("o_orderkey").alias("request_id"), F.concat(F.lit("S"), F.col("o_custkey") % t.raw("supplier").count()).alias("symbol"), F.to_date("o_orderdate").alias("asked"))
    return asof.asof_join(q, t.stocks().select("symbol", "ts", "close"), ["symbol"], "asked", "ts", ["close"])


@query("join06_bounded_asof", f"""{STOCK}, src AS (SELECT symbol, ts AS src_ts, CASE WHEN extract(day FROM ts) < 20 THEN close END AS flag FROM stocks WHERE extract(day FROM ts) % 7 = 0),
j AS (SELECT s.symbol, s.ts, m.src_ts, m.flag FROM stocks s ASOF LEFT JOIN src m ON s.symbol = m.symbol AND s.ts >= m.src_ts),
u AS (SELECT *, sum(CAST(ts > src_ts AS INT)) OVER (PARTITION BY symbol, src_ts ORDER BY ts ROWS UNBOUNDED PRECEDING) AS used FROM j) SELECT symbol, ts, CASE WHEN used <= 3 THEN flag END AS flag FROM u""")
def _(t: Tables):
    s = t.stocks()
    day = F.dayofmonth("ts")
    src = s.filter(day % 7 == 0).select("symbol", "ts", F.when(day < 20, F.col("close")).alias("flag"))
    return asof.bounded_asof_join(s.select("symbol", "ts"), src, "symbol", "ts", "flag", 3)


@query("join07_market_reindexed", f"WITH {INDEX_SQL}, {STOCK_SQL}, m AS (SELECT ts, close / lag(close) OVER (ORDER BY ts) - 1 AS mret FROM bars WHERE symbol = 'AF') SELECT s.symbol, s.ts, round(mret, 8) AS market_ret FROM stocks s LEFT JOIN m ON s.ts = m.ts")
def _(t: Tables):
    m = t.bars().filter("symbol = 'AF'").select("ts", win.pct_return("close").alias("market_ret"))
    return rounded(t.stocks().select("symbol", "ts").join(m, "ts", "left"), 8)


@query("join08_releases_near_dates", f"WITH {RELEASE_SQL}, q AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS asked FROM orders) SELECT asked, series_id, release_date, round(surprise_z, 6) AS surprise_z FROM q JOIN releases r ON r.release_date BETWEEN asked - 2 AND asked + 2")
def _(t: Tables):
    q = t.raw("orders").select(F.to_date("o_orderdate").alias("asked")).distinct()
    rel = macro.release_surprises(t.macro_obs(), t.series_spec()).select("series_id", "release_date", "surprise_z")
    return rounded(asof.interval_join(rel, q, "release_date", "asked", 2))


EPISODES = [("first_slide", "1996-03-01", "1996-09-30"), ("spring_rally", "1997-04-01", "1997-06-30"), ("late_crisis", "2000-09-01", "2001-02-28"), ("too_early", "1990-01-01", "1990-06-30")]
EPISODES_SQL = "episodes(episode, start_date, end_date) AS (VALUES " + ", ".join(f"('{a}', DATE '{b}', DATE '{c}')" for a, b, c in EPISODES) + ")"


def episodes(t: Tables):
    return t.spark.createDataFrame(EPISODES, "episode string, a string, b string").select("episode", F.to_date("a").alias("start_date"), F.to_date("b").alias("end_date"))


@query("join09_episode_returns", f"""{STOCK}, {EPISODES_SQL}, g AS (SELECT symbol, episode, min(ts) AS f, any_value(start_date) AS a, arg_max(close, ts) FILTER (ts < start_date) AS base, arg_max(close, ts) AS last
  FROM stocks JOIN episodes ON ts <= end_date GROUP BY 1, 2) SELECT symbol, episode, round(CASE WHEN f <= a AND base > 0 THEN (last / base - 1) * 100 END, 6) AS return_pct FROM g""")
def _(t: Tables):
    return rounded(asof.episode_returns(t.stocks(), episodes(t)))


@query("join11_strike_tolerance", f"""WITH {BOOK_SQL}, pos AS (SELECT contract_id AS position_id, symbol, kind, strike + CASE WHEN contract_id % 3 = 0 THEN 0.0004 WHEN contract_id % 3 = 1 THEN -0.0004 ELSE 0.01 END AS strike FROM book)
SELECT p.position_id, min(b.contract_id) AS contract_id FROM pos p JOIN book b ON p.symbol = b.symbol AND p.kind = b.kind AND abs(p.strike - b.strike) < 0.001 GROUP BY 1""")
def _(t: Tables):
    b = t.option_book()
    m = F.col("contract_id") % 3
    pos = b.select(F.col("contract_id").alias("position_id"), "symbol", "kind", (F.col("strike") + F.when(m == 0, 0.0004).when(m == 1, -0.0004).otherwise(0.01)).alias("strike"))
    return lookup.strike_tolerance_join(pos, b.select("symbol", "kind", "strike", "contract_id"), 1e-3, "contract_id")


_KEYS_SQL = "keys(pos, key, symbol, kind) AS (VALUES " + ", ".join(f"({i}, '{k}', '{s}', '{n}')" for i, (k, s, n) in enumerate(SEARCH_KEYS)) + ")"
_WORDS = "w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS q FROM documents)"


@query("join12_symbol_search", f"""WITH {_KEYS_SQL}, {_WORDS}, m AS (SELECT q, symbol, kind, min(pos) AS pos FROM w JOIN keys ON starts_with(key, q) OR lower(symbol) = q GROUP BY 1, 2, 3)
SELECT q AS query, symbol, kind, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN lower(symbol) = q THEN 0 ELSE 1 END, pos) AS r FROM m) WHERE r <= 8""")
def _(t: Tables):
    words = t.raw("documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"))).alias("w")).select(F.lower("w").alias("query")).distinct()
    return longs(lookup.search_symbols(words, lookup.search_table(t.spark), 8))


_ALIAS_SQL = "al(token, target) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in ALIASES.items()) + ")"
_FX = "|".join(CURRENCIES)


@query("join13_alias_resolution", rf"""WITH {_ALIAS_SQL}, w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[$A-Za-z./&]+')) AS raw FROM documents), c AS (SELECT raw, ltrim(upper(trim(raw)), '$') AS token FROM w)
SELECT c.raw, CASE WHEN al.target IS NOT NULL THEN al.target WHEN regexp_full_match(replace(c.token, '/', ''), '({_FX})({_FX})') THEN replace(c.token, '/', '')
  WHEN regexp_full_match(c.token, '[A-Z]{{1,5}}\.[A-Z]') THEN replace(c.token, '.', '-') ELSE c.token END AS ticker,
  CASE WHEN al.target IS NOT NULL THEN ends_with(al.target, '=X') ELSE regexp_full_match(replace(c.token, '/', ''), '({_FX})({_FX})') END AS is_fx FROM c LEFT JOIN al ON c.token = al.token""")
def _(t: Tables):
    words = t.raw("documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"([$A-Za-z./&]+)"))).alias("raw")).distinct()
    return lookup.resolve_symbols(words, "raw")


@query("join14_grid_times_symbols", f"{STOCK}, g AS (SELECT symbol, unnest([5, 10, 20]) AS fast FROM (SELECT DISTINCT symbol FROM stocks)) SELECT symbol, CAST(fast AS BIGINT) AS fast, CAST(slow AS BIGINT) AS slow FROM (SELECT symbol, fast, unnest([10, 20, 50]) AS slow FROM g) WHERE fast < slow")
def _(t: Tables):
    grid = F.array(*[F.struct(F.lit(a).alias("fast"), F.lit(b).alias("slow")) for a in (5, 10, 20) for b in (10, 20, 50) if a < b])
    return longs(t.stocks().select("symbol").distinct().select("symbol", F.explode(grid).alias("g")).select("symbol", "g.fast", "g.slow"))


@query("join16_leakage_check", f"{STOCK}, s AS (SELECT symbol, ts FROM stocks WHERE ts < DATE '1999-01-01'), e AS (SELECT symbol, ts FROM stocks WHERE ts >= DATE '1998-12-01') SELECT count(*) AS overlap FROM s WHERE EXISTS (SELECT 1 FROM e WHERE e.symbol = s.symbol AND e.ts = s.ts)")
def _(t: Tables):
    s = t.stocks().select("symbol", "ts")
    return asof.overlap_count(s.filter("ts < DATE '1999-01-01'"), s.filter("ts >= DATE '1998-12-01'"), ["symbol", "ts"])


@query("join17_missing_series", "SELECT s.s_suppkey AS symbol, s.s_nationkey AS sector FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity >= 50 AND l.l_discount = 0.1)")
def _(t: Tables):
    """Required minus present as a left anti join."""
    present = t.raw("lineitem").filter("l_quantity >= 50 AND l_discount = 0.1").select(F.col("l_suppkey").alias("symbol")).distinct()
    return longs(t.raw("supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").alias("sector")).join(present, "symbol", "left_anti"))


@query("set01_union_of_dates", f"WITH {ALIGNED_SQL} SELECT ts FROM cal WHERE dayofweek(ts) NOT IN (0, 6) UNION SELECT ts FROM pub")
def _(t: Tables):
    o = t.macro_obs().join(t.series_spec(), "series_id").select(F.date_add("ref_date", F.col("lag_days")).alias("ts"))
    return macro.business_calendar(t.macro_obs(), 43).union(o).distinct()


@query("set02_concatenated_sides", f"WITH {BOOK_SQL} SELECT contract_id, 'call' AS side, spot - strike AS moneyness FROM book WHERE kind = 'call' UNION ALL SELECT contract_id, 'put', strike - spot FROM book WHERE kind = 'put'")
def _(t: Tables):
    b = t.option_book()
    calls = b.filter("kind = 'call'").select("contract_id", F.lit("call").alias("side"), (F.col("spot") - F.col("strike")).alias("moneyness"))
    puts = b.filter("kind = 'put'").select("contract_id", F.lit("put").alias("side"), (F.col("strike") - F.col("spot")).alias("moneyness"))
    return calls.unionByName(puts)


@query("set03_common_dates", f"{INDEX} SELECT ts FROM bars WHERE symbol = 'AF' INTERSECT SELECT ts FROM bars WHERE symbol = 'NO'")
def _(t: Tables):
    b = t.bars()
    return b.filter("symbol = 'AF'").select("ts").intersect(b.filter("symbol = 'NO'").select("ts"))


@query("set04_required_minus_present", "SELECT DISTINCT o_custkey AS key FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(t: Tables):
    return t.raw("orders").select(F.col("o_custkey").alias("key")).distinct().exceptAll(t.raw("customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query("set05_distinct_first_and_last", "SELECT user_id, CAST(ts AS DATE) AS day, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1, 2")
def _(t: Tables):
    return t.raw("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min_by("event_type", "event_id").alias("first_type"), F.max_by("event_type", "event_id").alias("last_type"))


@query("top04_releases_by_surprise", f"WITH {RELEASE_SQL} SELECT name, ref_date, row_number() OVER (PARTITION BY name ORDER BY coalesce(abs(round(surprise_z, 9)), 0) DESC, ref_date) AS rank FROM releases")
def _(t: Tables):
    r = macro.release_surprises(t.macro_obs(), t.series_spec())
    w = Window.partitionBy("name").orderBy(F.desc(F.coalesce(F.abs(F.round("surprise_z", 9)), F.lit(0.0))), "ref_date")
    return longs(r.select("name", "ref_date", F.row_number().over(w).alias("rank")))


@query("top06_last_rows", f"{STOCK} SELECT symbol, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS b FROM stocks) WHERE b <= 63")
def _(t: Tables):
    return win.last_rows(t.stocks(), 63).select("symbol", "ts", "close")


@query("top07_downsampled_chart", f"""{STOCK}, p AS (SELECT *, row_number() OVER {W} - 1 AS pos, min(low) OVER (PARTITION BY symbol) AS lo, max(high) OVER (PARTITION BY symbol) AS hi FROM stocks)
SELECT symbol, ts, close, lo AS low, hi AS high FROM p WHERE pos % 5 = 0""")
def _(t: Tables):
    every = Window.partitionBy("symbol")
    p = t.stocks().select("symbol", "ts", "close", F.min("low").over(every).alias("low"), F.max("high").over(every).alias("high"), (win.position() - 1).alias("pos"))
    return p.filter("pos % 5 = 0").drop("pos")


@query("top08_chain_by_strike", f"""WITH {BOOK_SQL}, g AS (SELECT symbol, strike, max(CASE WHEN kind = 'call' THEN vol END) AS call_iv, max(CASE WHEN kind = 'put' THEN vol END) AS put_iv, max(spot) AS spot FROM book GROUP BY 1, 2),
n AS (SELECT symbol, arg_min(strike, {{'d': abs(strike - spot), 's': strike}}) AS near FROM g GROUP BY 1) SELECT g.symbol, strike, call_iv, put_iv, strike = near AS at_the_money FROM g JOIN n USING (symbol)""")
def _(t: Tables):
    g = t.option_book().groupBy("symbol", "strike").agg(F.max(F.when(F.col("kind") == "call", F.col("vol"))).alias("call_iv"), F.max(F.when(F.col("kind") == "put", F.col("vol"))).alias("put_iv"), F.max("spot").alias("spot"))
    near = F.min_by("strike", F.struct(F.abs(F.col("strike") - F.col("spot")), "strike"))
    return g.join(g.groupBy("symbol").agg(near.alias("near")), "symbol").select("symbol", "strike", "call_iv", "put_iv", (F.col("strike") == F.col("near")).alias("at_the_money"))


@query("top10_latest_row", f"{STOCK} SELECT symbol, max(ts) AS ts, arg_max(close, ts) AS close, arg_max(volume, ts) AS volume FROM stocks GROUP BY symbol")
def _(t: Tables):
    r = t.stocks().groupBy("symbol").agg(F.max_by(F.struct("ts", "close", "volume"), "ts").alias("r"))
    return r.select("symbol", "r.*")
