"""Which factors have a track record: quantile hit rates against base rates, betas, breadth, peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.fixed import CONFIDENCE
from tidewright.functions.nulls import safe_div
from tidewright.operators import windows as win
from tidewright.operators.ranks import leave_one_out_median
from tidewright.session import calendar_sized

PAIR = ["symbol", "factor_id"]


def factor_history(targets: DataFrame, factors: DataFrame) -> DataFrame:
    """Rows (symbol, factor_id, ts, factor, target) where both sides are known; a factor never explains itself.

    Factors are a few series: they go to the targets, whose rows are repeated by factor within their symbol's partition and not shuffled again.
    """
    f = calendar_sized(factors.filter("value IS NOT NULL").select("factor_id", "ts", F.col("value").alias("factor")))
    t = targets.filter("target IS NOT NULL").select("symbol", "ts", "target")
    return t.join(f, "ts").filter("symbol <> factor_id")


def today_readings(targets: DataFrame, factors: DataFrame) -> DataFrame:
    """Per (symbol, factor): the last factor value on or before the symbol's last session, and the move's sign.

    The latest value per factor and session date comes from the few distinct session dates, not from
    a range join over all targets.
    """
    from tidewright.operators.asof import asof_join

    last = targets.filter("target IS NOT NULL").groupBy("symbol").agg(F.max_by(F.struct("ts", "target"), "ts").alias("r"))
    last = last.select("symbol", F.col("r.ts").alias("session"), F.when(F.col("r.target") > 0, 1).otherwise(-1).alias("target_sign"))
    ids = factors.select("factor_id").distinct()
    asks = last.select("session").distinct().join(F.broadcast(ids.agg(F.collect_set("factor_id").alias("ids"))))
    asks = asks.select("session", F.explode("ids").alias("factor_id"))
    known = factors.filter("value IS NOT NULL").select("factor_id", "ts", F.col("value").alias("today_value"))
    values = asof_join(asks, known, ["factor_id"], "session", "ts", ["today_value"]).drop("src_ts")
    return last.join(values, "session").filter("symbol <> factor_id")


def factor_hit_rates(history: DataFrame, today: DataFrame, n_bins: int = 5, min_rows: int = 250) -> DataFrame:
    """Share of comparable days (same quantile bin as today) on which the target moved the same way.

    Bins are right-closed between quantile edges with duplicates dropped; today is located with
    right-side search and clipped to the last used bin. Counting per bin first means the second
    aggregation sees at most ``n_bins`` rows per pair.
    """
    wk = Window.partitionBy(*PAIR)
    probs = F.array(*[F.lit(i / n_bins) for i in range(n_bins + 1)])
    h = history.withColumn("edges", F.array_distinct(F.percentile("factor", probs).over(wk)))
    inner = F.when(F.size("edges") > 2, F.slice("edges", 2, F.size("edges") - 2)).otherwise(F.array().cast("array<double>"))
    h = h.withColumn("inner", inner)
    h = h.withColumn("bin", F.size(F.filter("inner", lambda e: e < F.col("factor"))))
    bins = h.groupBy(*PAIR, "bin").agg(
        F.count("*").alias("n"), F.sum((F.col("target") > 0).cast("long")).alias("up"),
        F.sum((F.col("target") < 0).cast("long")).alias("down"), F.first("inner").alias("inner"),
    )
    g = bins.groupBy(*PAIR).agg(
        F.sum("n").alias("history_n"), F.sum("up").alias("up"), F.sum("down").alias("down"), F.count("*").alias("bins"),
        F.max("bin").alias("top"), F.first("inner").alias("inner"), F.collect_list(F.struct("bin", "n", "up", "down")).alias("cells"),
    )
    j = g.join(today, PAIR)
    up = F.col("target_sign") > 0
    today_bin = F.least(F.size(F.filter("inner", lambda e: e <= F.col("today_value"))), F.col("top"))
    cell = F.get(F.filter("cells", lambda c: c["bin"] == F.col("today_bin")), F.lit(0))
    j = j.withColumn("today_bin", today_bin).withColumn("cell", cell)
    enough = (F.col("history_n") >= min_rows) & F.col("today_value").isNotNull()
    usable = enough & (F.col("bins") >= 2) & F.col("cell").isNotNull()
    return j.select(
        *PAIR, "today_value", "target_sign", F.when(usable, F.col("today_bin")).alias("today_bin"),
        F.when(usable, F.when(up, F.col("cell.up")).otherwise(F.col("cell.down")) / F.col("cell.n")).alias("hit_rate"),
        F.when(enough, F.when(up, F.col("up")).otherwise(F.col("down")) / F.col("history_n")).alias("base_rate"),
        F.when(usable, F.col("cell.n")).when(~enough & F.col("today_value").isNotNull(), F.col("history_n")).otherwise(0).cast("long").alias("sample_size"),
    )


def confidence(n: Column) -> Column:
    out = F.lit("none")
    for least, name, _ in reversed(CONFIDENCE):
        out = F.when(n >= least, name).otherwise(out)
    return out


def confidence_weight(n: Column) -> Column:
    out = F.lit(0.0)
    for least, _, weight in reversed(CONFIDENCE):
        out = F.when(n >= least, weight).otherwise(out)
    return out


def score_factors(rates: DataFrame) -> DataFrame:
    """Lift, binomial error, whether the lift is more than two errors, confidence and ranking score."""
    df = rates.withColumn("hit_rate", F.when(F.col("sample_size") >= 10, F.col("hit_rate")))
    lift = F.col("hit_rate") - F.col("base_rate")
    se = F.when(F.col("hit_rate").isNotNull(), F.sqrt(F.greatest(F.col("hit_rate") * (1 - F.col("hit_rate")), F.lit(0.0)) / F.when(F.col("sample_size") > 0, F.col("sample_size"))))
    return df.select(
        "*", lift.alias("lift"), se.alias("standard_error"),
        F.coalesce((se > 0) & (F.abs(lift) > 2 * se), F.lit(False)).alias("beats_base_rate"),
        confidence(F.col("sample_size")).alias("confidence"),
        F.coalesce(F.col("hit_rate") * confidence_weight(F.col("sample_size")), F.lit(0.0)).alias("rank_score"),
    )


def rank_factors(scored: DataFrame) -> DataFrame:
    """Rank per symbol by score, size of lift and sample; the factor id settles ties."""
    w = Window.partitionBy("symbol").orderBy(
        F.desc("rank_score"), F.desc(F.abs(F.coalesce(F.col("lift"), F.lit(0.0)))), F.desc("sample_size"), "factor_id")
    return scored.withColumn("rank", F.row_number().over(w))


def market_model(targets: DataFrame, market: DataFrame, min_rows: int = 250) -> DataFrame:
    """Beta before the last session, and the move split into explained and specific parts."""
    m = calendar_sized(market.select("ts", F.col("ret").alias("market")))
    j = targets.join(m, "ts", "left").filter("target IS NOT NULL")
    last = F.max("ts").over(Window.partitionBy("symbol"))
    j = j.withColumn("past", F.col("ts") < last)
    both = F.col("past") & F.col("market").isNotNull()
    g = j.groupBy("symbol").agg(
        F.sum(both.cast("long")).alias("sessions"),
        F.covar_samp(F.when(both, F.col("target")), F.when(both, F.col("market"))).alias("cov"),
        F.var_samp(F.when(both, F.col("market"))).alias("var"),
        F.max_by("target", "ts").alias("move_pct"),
        F.max_by("market", F.when(F.col("market").isNotNull(), F.col("ts"))).alias("market_pct"),
    )
    beta = F.when((F.col("sessions") >= min_rows) & (F.col("var") > 1e-12), F.col("cov") / F.col("var"))
    explained = beta * F.col("market_pct")
    return g.select(
        "symbol", "sessions", "move_pct", "market_pct", beta.alias("beta"), explained.alias("explained_pct"),
        (F.col("move_pct") - explained).alias("specific_pct"), (F.abs(safe_div(explained, F.col("move_pct"), 1e-9)) * 100).alias("explained_share_pct"),
    )


def sector_breadth(returns: DataFrame, sectors: list[str]) -> DataFrame:
    """Per day: percent of the panel's sectors that rose and that fell; absent sectors stay in the denominator."""
    n = float(len(sectors))
    r = returns.filter(F.col("symbol").isin(sectors) & F.col("ret").isNotNull())
    return r.groupBy("ts").agg(
        (F.sum((F.col("ret") > 0).cast("long")) / n * 100).alias("rising_pct"),
        (F.sum((F.col("ret") < 0).cast("long")) / n * 100).alias("falling_pct"), F.count("*").alias("present"),
    )


def index_contributions(returns: DataFrame, weights: dict[str, float], index: DataFrame, top: int = 2) -> DataFrame:
    """Per day: the constituents that moved the index most (static weight times return) and their share of its move."""
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    r = returns.filter(F.col("symbol").isin(list(weights)) & F.col("ret").isNotNull()).withColumn("contribution", w[F.col("symbol")] * F.col("ret"))
    order = Window.partitionBy("ts").orderBy(F.desc(F.abs("contribution")), "symbol")
    r = r.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    j = r.join(index.select("ts", F.col("ret").alias("index_ret")), "ts")
    return j.select("ts", "symbol", "rank", "ret", "contribution", (F.abs(safe_div("contribution", "index_ret", 1e-9)) * 100).alias("share_pct"))


def peer_comparison(metrics: DataFrame, min_peers: int = 3) -> DataFrame:
    """Each member's metric against the median of its sector peers, itself left out."""
    med = leave_one_out_median(metrics, ["sector", "metric"], "value")
    j = metrics.join(med, ["sector", "metric", "value"])
    return j.filter(F.col("peers") >= min_peers).select(
        "symbol", "sector", "metric", "value", "peers", "peer_median",
        ((safe_div(F.col("value"), F.col("peer_median")) - 1) * 100).alias("vs_median_pct"),
    )


def price_trend(bars: DataFrame) -> DataFrame:
    """Month, quarter and year returns, one-year volatility, range and drawdown of each symbol's last session."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    b = bars.select("symbol", "ts", "close", back.alias("b"), win.pct_return("close").alias("ret"))
    year = F.col("b") <= 252
    g = b.groupBy("symbol").agg(
        F.count("*").alias("sessions"), F.max(F.when(F.col("b") == 1, F.col("close"))).alias("current"),
        *[F.max(F.when(F.col("b") == k + 1, F.col("close"))).alias(f"c{k}") for k in (21, 63, 252)],
        F.stddev_samp(F.when(year, F.col("ret"))).alias("sd"), F.max(F.when(year, F.col("close"))).alias("high_52w"),
        F.min(F.when(year, F.col("close"))).alias("low_52w"),
    ).filter("sessions >= 30")
    cur = F.col("current")
    return g.select(
        "symbol", "sessions", "current", *[((cur / F.col(f"c{k}") - 1) * 100).alias(n) for k, n in ((21, "return_1m_pct"), (63, "return_3m_pct"), (252, "return_1y_pct"))],
        (F.col("sd") * F.sqrt(F.lit(252.0)) * 100).alias("annualized_vol_pct"), "high_52w", "low_52w", ((cur / F.col("high_52w") - 1) * 100).alias("drawdown_pct"),
    )


def snapshot_flags(df: DataFrame) -> DataFrame:
    """Long (symbol, flag): what argues against the headline figures. Unknown measures raise no flag."""
    rules = {
        "loss_making": F.col("profit_margin") <= 0,
        "rich_multiple": (F.col("trailing_pe") > 0) & (F.col("pe_vs_median_pct") > 25),
        "no_dividend": F.col("dividend_yield").isNull(),
        "high_dividend": F.col("dividend_yield") > 0.06,
        "high_debt": F.col("debt_to_equity") > 2.0,
        "strong_year": F.col("return_1y_pct") > 50,
        "volatile": F.col("annualized_vol_pct") > 18,
    }
    flags = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return df.select("symbol", F.explode(flags).alias("flag"))


def counter_evidence(observations: DataFrame, scored: DataFrame) -> DataFrame:
    """Long (symbol, item, factor_id): reasons not to read much into the move."""
    own = observations.select("symbol", F.explode(F.array_compact(F.array(
        F.when(F.col("outlier") == "typical", F.lit("not_unusual")), F.when(F.col("volume_ratio") < 0.8, F.lit("low_volume")),
    ))).alias("item"), F.lit(None).cast("string").alias("factor_id"))
    known = scored.filter("hit_rate IS NOT NULL")
    w = Window.partitionBy("symbol").orderBy(F.desc("rank_score"), "factor_id")
    chance = known.groupBy("symbol").agg(F.max(F.col("beats_base_rate").cast("int")).alias("any"), F.max_by("factor_id", F.struct("rank_score")).alias("x"))
    best = known.withColumn("r", F.row_number().over(w)).filter("r = 1").select("symbol", "factor_id")
    none = chance.filter("any = 0").select("symbol").join(best, "symbol").select("symbol", F.lit("none_beats_chance").alias("item"), "factor_id")
    against = known.filter("lift < -0.05").withColumn("r", F.row_number().over(w)).filter("r <= 2")
    return own.unionByName(none).unionByName(against.select("symbol", F.lit("points_other_way").alias("item"), "factor_id"))
