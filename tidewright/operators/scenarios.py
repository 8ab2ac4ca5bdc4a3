"""Event studies: how often a condition held, and what followed when it did."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import studies
from tidewright.operators import windows as win
from tidewright.operators.asof import asof_join
from tidewright.session import calendar_sized, checkpointed, dealt

HORIZONS = (5, 21, 63)
MAIN_HORIZON = 21
EPISODE_GAP = 10
MIN_EPISODES = 2
ROWS_AT_ONCE = 50_000  # sessions studied together, beside those of the last symbol


@dataclass(frozen=True)
class Scenario:
    """A condition on one driver series: ``self`` or the symbol of a proxy."""

    name: str
    driver: str
    kind: str | None  # None: no trigger can be computed from prices
    window: int = 0
    threshold: float = 0.0


def yield_points(proxies: DataFrame, symbol: str) -> DataFrame:
    """A yield series quoted as ten times the yield is brought back to points (its median is above 20)."""
    mid = F.percentile("close", 0.5).over(Window.partitionBy("symbol"))
    return proxies.withColumn("close", F.when((F.col("symbol") == symbol) & (mid > 20), F.col("close") / 10).otherwise(F.col("close")))


def monthly_frequency(flags: DataFrame, keys: list[str]) -> DataFrame:
    """Months with any known flag and months in which it held at all."""
    months = flags.filter("flag IS NOT NULL").groupBy(*keys, F.trunc("ts", "month").alias("m")).agg(F.max("flag").alias("f"))
    return months.groupBy(*keys).agg(F.count("*").alias("months_observed"), F.sum((F.col("f") >= 1).cast("long")).alias("months_triggered"))


def episode_counts(hits: DataFrame, keys: list[str], pos: str = "pos", gap: int = EPISODE_GAP) -> DataFrame:
    """Separate runs of true rows; a gap of more than ``gap`` positions starts a new one."""
    w = Window.partitionBy(*keys).orderBy(pos)
    start = F.col(pos) - F.lag(pos).over(w) > gap
    return hits.select(*keys, F.coalesce(start, F.lit(True)).alias("__start")).groupBy(*keys).agg(F.sum(F.col("__start").cast("long")).alias("episodes"))


def episodes(hits: DataFrame, keys: list[str], pos: str = "pos", gap: int = EPISODE_GAP) -> DataFrame:
    """Dated runs of true rows (keys, episode from 1, first_ts, last_ts, days, sessions): runs no more than ``gap`` positions apart are one.

    ``days`` counts the true rows, ``sessions`` the positions from the first to the last of them.
    """
    w = Window.partitionBy(*keys).orderBy(pos)
    start = F.coalesce(F.col(pos) - F.lag(pos).over(w) > gap, F.lit(True))
    run = hits.withColumn("__start", start.cast("long")).withColumn("episode", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*keys, "episode").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("days"), (F.max(pos) - F.min(pos) + 1).alias("sessions"), F.min_by(f"fwd_{MAIN_HORIZON}", pos).alias("after_first_pct")
    )


def outcome(c: str) -> list[Column]:
    """Summary of forward returns: one set of aggregates."""
    return [
        F.count(c).alias("n_days"), F.percentile(c, 0.5).alias("median_pct"), F.percentile(c, 0.1).alias("p10_pct"),
        F.percentile(c, 0.9).alias("p90_pct"), F.min(c).alias("worst_pct"),
        (F.avg((F.col(c) < 0).cast("double")) * 100).alias("share_lower_pct"), (F.avg((F.col(c) > 0).cast("double")) * 100).alias("share_higher_pct"),
    ]


def horizon_outcomes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Long by horizon from ``fwd_<h>`` columns."""
    stacked = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(h).cast("long").alias("horizon"), F.col(f"fwd_{h}").alias("fwd")) for h in HORIZONS])).alias("x"))
    return stacked.select(*keys, "x.*").filter("fwd IS NOT NULL").groupBy(*keys, "horizon").agg(*outcome("fwd"))


def with_forwards(closes: DataFrame) -> DataFrame:
    return closes.select("symbol", "ts", "close", win.position().alias("pos"), win.pct_return("close").alias("ret"),
                         *[win.forward_pct("close", h).alias(f"fwd_{h}") for h in HORIZONS])


def proxy_flags(proxies: DataFrame, scenarios: list[Scenario]) -> DataFrame:
    """Long (scenario, ts, flag) on each proxy's own calendar."""
    parts = [
        proxies.filter(F.col("symbol") == s.driver).withColumn("ret", win.pct_return("close"))
        .select(F.lit(s.name).alias("scenario"), "ts", win.trigger_flag(s.kind, s.window, s.threshold).alias("flag"))
        for s in scenarios
    ]
    return reduce(DataFrame.unionByName, parts)


def raised_by_date(targets: DataFrame, flags: DataFrame, names: list[str]) -> DataFrame:
    """(ts, src_<i>): for session dates on which proxy scenario i is raised by the last proxy date at or before them, that date; one row a date."""
    dates = targets.select("ts").distinct().select(F.explode(F.array(*[F.lit(n) for n in names])).alias("scenario"), "ts")
    raised = asof_join(dates, flags, ["scenario"], "ts", "ts", ["flag"]).filter("flag >= 1")
    return raised.groupBy("ts").agg(*[F.max(F.when(F.col("scenario") == n, F.col("src_ts"))).alias(f"src_{i}") for i, n in enumerate(names)])


def scenario_sessions(closes: DataFrame, proxies: DataFrame, market: DataFrame, scenarios: list[Scenario], limit: int = 3) -> tuple[DataFrame, DataFrame]:
    """Sessions (symbol, ts, month, pos, fwd_..., hits, known) in which bit i stands for scenario i, and months by proxy scenario.

    Symbols are dealt out once and stay whole and in order, one row a session, whatever the number of scenarios; what holds by date is
    joined by date. A proxy's raised flag reaches at most ``limit`` sessions beyond its date: the one that many sessions back is not later.
    """
    own, others = [s for s in scenarios if s.driver == "self"], [s for s in scenarios if s.driver != "self"]
    x = with_forwards(dealt(closes.select("symbol", "ts", "close"), "symbol"))
    hits, known = [], []
    if others:
        flags = checkpointed(proxy_flags(proxies, others))
        names = [s.name for s in others]
        x = x.join(calendar_sized(raised_by_date(closes, flags, names)), "ts", "left")
        months_seen = monthly_frequency(flags, ["scenario"])
        for i, name in enumerate(names):
            near = F.col("__back").isNull() | (F.col("__back") <= F.col(f"src_{i}"))
            hits.append((scenarios.index(others[i]), F.col(f"src_{i}").isNotNull() & near))
    else:
        months_seen = closes.sparkSession.createDataFrame([], "scenario string, months_observed long, months_triggered long")
    x = x.join(calendar_sized(market.select("ts", F.col("ret").alias("market_ret"))), "ts", "left")
    # What comes last is a window by symbol, so that its rows are together and in order however the joins were done.
    x = x.select("*", F.lag("ts", limit).over(win.by_symbol()).alias("__back"), *[win.shock_sigma(n).alias(f"__sigma{n}") for n in sorted({s.window for s in own if s.kind == "shock_day"})])
    sigma = lambda s: F.col(f"__sigma{s.window}") if s.kind == "shock_day" else None
    x = x.select("*", *[win.trigger_flag(s.kind, s.window, s.threshold, market_return="market_ret", sigma=sigma(s)).alias(f"__own{i}") for i, s in enumerate(own)])
    for i, s in enumerate(own):
        hits.append((scenarios.index(s), F.coalesce(F.col(f"__own{i}") >= 1, F.lit(False))))
        known.append((scenarios.index(s), F.col(f"__own{i}").isNotNull()))
    bits = lambda marks: sum((F.when(c, F.lit(1 << k)).otherwise(0).cast("long") for k, c in marks), F.lit(0).cast("long"))
    month = F.coalesce(F.year("ts") * 12 + F.month("ts"), F.lit(-1)).cast("long")
    return x.select("symbol", "ts", month.alias("month"), F.col("pos").cast("long").alias("pos"), *[f"fwd_{h}" for h in HORIZONS], bits(hits).alias("hits"), bits(known).alias("known")), months_seen


def _over_symbols(sessions: DataFrame, solve, schema: str) -> DataFrame:
    """``solve`` of tables of whole symbols, some ``ROWS_AT_ONCE`` sessions at a time."""
    def run(batches):
        held, rows = [], 0
        for batch in batches:
            begin = np.flatnonzero(batch.column("pos").to_numpy() == 1)
            if rows >= ROWS_AT_ONCE and len(begin):
                yield from solve(pa.Table.from_batches([*held, batch.slice(0, begin[-1])]).combine_chunks()).to_batches()
                batch, held, rows = batch.slice(begin[-1]), [], 0
            held.append(batch)
            rows += batch.num_rows
        if rows:
            yield from solve(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return sessions.mapInArrow(run, schema)


def dated_episodes(closes: DataFrame, proxies: DataFrame, market: DataFrame, scenarios: list[Scenario]) -> DataFrame:
    """``episodes`` of every symbol and scenario whose outcome over the main horizon is known."""
    sessions, _ = scenario_sessions(closes, proxies, market, scenarios)
    names = [s.name for s in scenarios]

    def solve(t: pa.Table) -> pa.Table:
        pos, after = t["pos"].to_numpy(), t[f"fwd_{MAIN_HORIZON}"].to_numpy()
        owner = studies.owners(studies.beginnings(pos), len(pos))
        group, rows = studies.hit_rows(t["hits"].to_numpy(), ~np.isnan(after), owner, len(names))
        first = np.flatnonzero(studies.episode_starts(group, pos[rows], EPISODE_GAP))
        n = np.diff(np.append(first, len(rows)))
        a, z, g = rows[first], rows[first + n - 1], group[first]
        number = np.arange(len(g)) - np.searchsorted(g, g) + 1
        at = lambda c, r: t[c].take(pa.array(r))
        return pa.table({"symbol": at("symbol", a), "scenario": pa.array(names).take(pa.array(g % len(names))), "episode": number, "first_ts": at("ts", a), "last_ts": at("ts", z),
                         "days": n, "sessions": pos[z] - pos[a] + 1, "after_first_pct": after[a]})

    kinds = dict(sessions.dtypes)
    return _over_symbols(sessions, solve, f"symbol {kinds['symbol']}, scenario string, episode bigint, first_ts {kinds['ts']}, last_ts {kinds['ts']}, days bigint, sessions bigint, after_first_pct double")


def measure_scenarios(closes: DataFrame, proxies: DataFrame, market: DataFrame, scenarios: list[Scenario]) -> DataFrame:
    """Per (symbol, scenario, horizon): frequency, episodes and the outcomes that followed.

    Fewer than two episodes give no outcomes, only the frequency and the count; a scenario without a trigger gives a row of
    unknown figures for each symbol.
    """
    priced = [s for s in scenarios if s.kind]
    sessions, seen = scenario_sessions(closes, proxies, market, priced)
    names, unpriced = [s.name for s in priced], [s.name for s in scenarios if not s.kind]
    own = [i for i, s in enumerate(priced) if s.driver == "self"]
    figures = ["median_pct", "p10_pct", "p90_pct", "worst_pct", "share_lower_pct", "share_higher_pct"]

    def solve(t: pa.Table) -> pa.Table:
        pos, hits, known, month = (t[c].to_numpy() for c in ("pos", "hits", "known", "month"))
        begin = studies.beginnings(pos)
        owner = studies.owners(begin, len(pos))
        symbol = t["symbol"].take(pa.array(begin)).combine_chunks()
        k = len(names)
        group, rows = studies.hit_rows(hits, ~np.isnan(t[f"fwd_{MAIN_HORIZON}"].to_numpy()), owner, k)
        if symbol.null_count:  # rows without a symbol belong to no series
            named = symbol.is_valid().to_numpy(zero_copy_only=False)[group // k]
            group, rows = group[named], rows[named]
        runs = np.bincount(group[studies.episode_starts(group, pos[rows], EPISODE_GAP)], minlength=len(begin) * k)
        observed, triggered = np.zeros((len(begin), k), np.int64), np.zeros((len(begin), k), np.int64)
        for s in own:
            observed[:, s], triggered[:, s] = studies.months((known >> s & 1).astype(bool), (hits >> s & 1).astype(bool), month, owner, len(begin))
        told = runs[group] >= MIN_EPISODES
        found = [(h, studies.outcomes(group[told], t[f"fwd_{h}"].to_numpy()[rows[told]])) for h in HORIZONS]
        bare = np.setdiff1d(np.arange(len(begin) * k), np.concatenate([o["group"] for _, o in found]))
        extra = np.repeat(np.arange(len(begin)), len(unpriced))
        g = np.concatenate([o["group"] for _, o in found] + [bare])
        without = len(bare) + len(extra)
        part = lambda c: pa.concat_arrays([pa.array(np.concatenate([o[c] for _, o in found])), pa.nulls(without, pa.float64() if c in figures else pa.int64())])
        unknown = pa.nulls(len(extra), pa.int64())
        mine = np.isin(g % k, own)
        count = lambda x: pa.concat_arrays([pa.array(x.ravel()[g], mask=~mine | (observed.ravel()[g] == 0)), unknown])
        return pa.table({
            "symbol": symbol.take(pa.array(np.concatenate([g // k, extra]))),
            "scenario": pa.array([*names, *unpriced]).take(pa.array(np.concatenate([g % k, k + np.tile(np.arange(len(unpriced)), len(begin))]))),
            "months_observed": count(observed), "months_triggered": count(triggered), "episodes": pa.concat_arrays([pa.array(runs[g]), unknown]),
            "horizon": pa.concat_arrays([pa.array(np.concatenate([np.full(len(o["group"]), h) for h, o in found])), pa.nulls(without, pa.int64())]),
            "n_days": part("n_days"), **{c: part(c) for c in figures}})

    kind = dict(sessions.dtypes)["symbol"]
    told = _over_symbols(sessions, solve, f"symbol {kind}, scenario string, months_observed bigint, months_triggered bigint, episodes bigint, horizon bigint, n_days bigint, {', '.join(f'{c} double' for c in figures)}")
    # The months of a proxy are those of its own calendar, the same for every symbol; a scenario whose months are unknown has no row.
    j = told.join(F.broadcast(seen.select("scenario", F.col("months_observed").alias("__o"), F.col("months_triggered").alias("__t"))), "scenario", "left")
    j = j.withColumns({"months_observed": F.coalesce("months_observed", "__o"), "months_triggered": F.coalesce("months_triggered", "__t")})
    j = j.filter(F.col("months_observed").isNotNull() | F.col("scenario").isin(unpriced))
    return j.select("symbol", "scenario", "months_observed", "months_triggered", (F.col("months_triggered") / F.col("months_observed") * 100).alias("frequency_pct"), "episodes", "horizon", "n_days", *figures)
