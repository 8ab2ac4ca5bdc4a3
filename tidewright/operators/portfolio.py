"""Ledgers, option overlays and staged plans."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators import backtest as bt
from tidewright.operators import stats
from tidewright.operators import windows as win
from tidewright.operators.options import priced
from tidewright.session import dealt

SHARES, COMMISSION, REG_T, REG_T_FLOOR = 100, 0.65, 0.20, 0.10

# Overlay, shares held, legs (kind, sign), strike over spot, sizing.
OVERLAYS = [
    ("covered-call", 1.0, [("call", -1.0)], 1.05, "covered"), ("protective-put", 1.0, [("put", 1.0)], 0.95, "covered"),
    ("cash-secured-put", 0.0, [("put", -1.0)], 0.95, "cash-secured"), ("long-call", 0.0, [("call", 1.0)], 1.02, "budget"),
    ("long-straddle", 0.0, [("call", 1.0), ("put", 1.0)], 1.0, "budget"),
]
LEDGER = "account bigint, seq bigint, action string, status string, cash double, realized double, collateral double, open_positions bigint"


class _Account:
    """Running state of one account: cash, realised result and the open lines of each contract, oldest first."""

    def __init__(self, cash: float) -> None:
        self.cash, self.realized, self.collateral, self.count = cash, 0.0, 0.0, 0
        self.lines: dict[tuple, deque] = {}

    @staticmethod
    def contract(r) -> tuple:
        """Kind, strike and expiry; unknown ones are None, so that they are equal to each other."""
        expiry = getattr(r, "expiry", None)
        return (None if pd.isna(r.kind) else r.kind, None if pd.isna(r.strike) else float(r.strike), None if pd.isna(expiry) else str(expiry))

    def apply(self, r) -> str:
        if r.status:
            return r.status
        contract = self.contract(r)
        if r.action == "open":
            effect = r.premium - r.fee
            if r.held - effect > self.cash - self.collateral + 1e-9:
                return "refused"
            self.cash += effect
            self.realized -= r.fee
            self.collateral += r.held
            self.count += 1
            self.lines.setdefault(contract, deque()).append([-r.contracts if r.side == "sell" else r.contracts, r.fill_price, r.held])
            return "done"
        own = self.lines.get(contract)
        if not own:
            return "nothing open"
        n, entry, held = own[0]
        size = abs(n) if r.action == "expire" or not r.contracts else r.contracts
        if size > abs(n):
            return "refused"
        sign = 1 if n > 0 else -1
        fee = 0.0 if r.action == "expire" else COMMISSION * size
        self.cash += r.price * size * SHARES * sign - fee
        self.realized += (r.price - entry) * size * SHARES * sign - fee
        freed = held * size / abs(n)
        self.collateral -= freed
        if size < abs(n):
            own[0] = [n - sign * size, entry, held - freed]
        else:
            own.popleft()
            self.count -= 1
            self.collateral = self.collateral if self.count else 0.0
        return "done"


def _valued(orders: DataFrame) -> DataFrame:
    """Orders with premium, fee, collateral and price as columns, and the status of those that need no state."""
    sell, size = F.col("side") == "sell", F.col("contracts")
    premium = F.col("fill_price") * size * SHARES
    call = F.greatest(REG_T * F.col("spot") - F.greatest(F.col("strike") - F.col("spot"), F.lit(0.0)) + F.col("fill_price"), REG_T_FLOOR * F.col("spot") + F.col("fill_price"), F.lit(0.0))
    # greatest skips NULL: without a spot or a strike the collateral and the intrinsic value are unknown, not zero.
    known = F.col("spot").isNotNull() & F.col("strike").isNotNull()
    held = F.when(sell, F.when(F.col("kind") == "put", F.col("strike")).otherwise(F.when(known, call)) * size * SHARES).otherwise(0.0)
    value = F.greatest(F.when(F.col("kind") == "call", F.col("spot") - F.col("strike")).otherwise(F.col("strike") - F.col("spot")), F.lit(0.0))
    expires, opens = F.col("action") == "expire", F.col("action") == "open"
    unpriced = ~expires & ~F.coalesce(F.col("fill_price") > 0, F.lit(False))
    unsized = F.when(opens, ~F.coalesce(size > 0, F.lit(False)) | held.isNull()).when(expires, False).otherwise(F.coalesce(size < 0, F.lit(False)))
    status = F.when(expires & ~known, "waiting").when(unpriced | unsized, "refused").otherwise("")
    return orders.withColumns({"contracts": F.coalesce(size, F.lit(0)), "premium": F.when(sell, premium).otherwise(-premium), "fee": F.coalesce(COMMISSION * size, F.lit(0.0)), "held": held, "price": F.when(expires, value).otherwise(F.col("fill_price")), "status": status})


def ledger(orders: DataFrame, starting_cash: float = 100_000.0) -> DataFrame:
    """Fold each account's orders in sequence.

    A contract is its kind, strike and, where the orders have the column, expiry. Opens beyond buying power are refused, and so are orders without a size or a price, sales whose collateral is unknown and closes of more than the contract's oldest line holds;
    a close without a size takes the whole line. An expiry settles the contract's oldest line at intrinsic value, and waits
    while there is no spot or strike. Orders are dealt out by account and sorted by sequence; the fold runs over Arrow batches and
    carries one account's state from batch to batch, so no account's orders are ever held in memory as a whole.
    """
    sorted_orders = dealt(_valued(orders), "account").sortWithinPartitions("account", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.account != current:
                    current, state = r.account, _Account(starting_cash)
                status = state.apply(r)
                out.append((r.account, r.seq, r.action, status, state.cash, state.realized, state.collateral, state.count))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LEDGER.split(", ")])

    return sorted_orders.mapInPandas(run, LEDGER)


def option_overlay(bars: DataFrame, name: str, tenor: int = 21, lookback: int = 40, premium_factor: float = 1.15, spread: float = 0.02,
                   rate: float = 0.04, cost_rate: float = 0.0006, initial: float = 10_000.0, budget: float = 0.05) -> DataFrame:
    """Daily equity of an option overlay rolled every ``tenor`` bars.

    Contracts open on fixed bars, so strikes, fair values and marks are window columns. Only cash and
    shares pass from one roll to the next: they are folded over the symbol's array of rolls (sessions
    / tenor entries) and joined back to its bars.
    """
    _, exposure, legs, moneyness, sizing = next(o for o in OVERLAYS if o[0] == name)
    warm = lookback + 2
    w = win.by_symbol()
    b = bars.select("symbol", "ts", "close", (win.position() - 1).alias("pos"), win.log_return("close").alias("r"), F.count("*").over(Window.partitionBy("symbol")).alias("n"))
    b = b.withColumn("vol", F.greatest(F.stddev_samp("r").over(win.trailing(lookback)) * F.sqrt(F.lit(252.0)), F.lit(0.05)) * premium_factor)
    rolls = F.floor((F.col("n") - 1 - warm) / tenor)
    b = b.filter((F.col("pos") >= warm) & (F.col("pos") <= warm + tenor * rolls) & (F.col("n") >= warm + 2 * tenor))
    b = b.withColumn("cycle", F.floor((F.col("pos") - warm) / tenor)).withColumn("rolls", rolls)
    cyc = Window.partitionBy("symbol", "cycle").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("strike", F.first("close").over(cyc) * moneyness)
    b = b.withColumn("left", (tenor - (F.col("pos") - warm) % tenor) / 252.0)
    for i, (kind, _sign) in enumerate(legs):
        book = b.select("*", F.col("close").alias("spot"), F.col("left").alias("years"), F.lit(rate).alias("rate"), F.lit(kind).alias("kind"))
        b = priced(book).withColumnRenamed("price", f"leg{i}").select(*b.columns, f"leg{i}")
    settle = F.lead("close").over(Window.partitionBy("symbol").orderBy("pos"))
    start = b.filter((F.col("pos") - warm) % tenor == 0).withColumn("settle", settle)
    worth = [F.greatest((F.col("settle") - F.col("strike")) * (1 if k == "call" else -1), F.lit(0.0)) for k, _ in legs]
    fair = F.array(*[F.col(f"leg{i}") for i in range(len(legs))])
    rows = start.filter("settle IS NOT NULL").groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("cycle", F.col("close").alias("spot"), "strike", fair.alias("fair"), F.array(*worth).alias("worth")))).alias("rolls"))

    def step(acc, x):
        equity = acc["cash"] + acc["shares"] * x["spot"]
        target = exposure * equity / x["spot"]
        delta = target - acc["shares"]
        cash = acc["cash"] - delta * x["spot"] - F.abs(delta) * x["spot"] * cost_rate
        total = sum((x["fair"][i] for i in range(1, len(legs))), x["fair"][0])
        now = cash + target * x["spot"]
        contracts = {"covered": target / SHARES, "cash-secured": cash / (x["strike"] * SHARES),
                     "budget": F.when(total * SHARES > 1e-9, budget * now / (total * SHARES)).otherwise(0.0)}[sizing]
        for i, (_k, sign) in enumerate(legs):
            cash = cash - sign * contracts * x["fair"][i] * (1 + sign * spread) * SHARES
        paid = cash
        for i, (_k, sign) in enumerate(legs):
            paid = paid + sign * contracts * x["worth"][i] * SHARES
        entry = F.struct(x["cycle"].alias("cycle"), cash.alias("cash"), target.alias("shares"), contracts.alias("contracts"))
        return F.struct(paid.alias("cash"), target.alias("shares"), F.concat(acc["out"], F.array(entry)).alias("out"))

    empty = F.array().cast("array<struct<cycle:bigint,cash:double,shares:double,contracts:double>>")
    zero = F.struct(F.lit(initial).alias("cash"), F.lit(0.0).alias("shares"), empty.alias("out"))
    states = rows.select("symbol", F.explode(F.aggregate("rolls", zero, step)["out"]).alias("s")).select("symbol", "s.*")
    marked = b.filter("cycle < rolls").join(states, ["symbol", "cycle"])
    value = F.col("cash") + F.col("shares") * F.col("close") + sum((sign * F.col("contracts") * F.col(f"leg{i}") * SHARES for i, (_k, sign) in enumerate(legs)), F.lit(0.0))
    out = marked.select("symbol", "ts", F.lit(name).alias("overlay"), value.alias("equity"), (initial * (1 - cost_rate) / F.first("close").over(w.rowsBetween(Window.unboundedPreceding, 0)) * F.col("close")).alias("benchmark"))
    # An account that reached zero stops there.
    broke = F.coalesce(F.max((F.col("equity") <= 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.withColumn("broke", broke).filter("broke = 0").drop("broke").withColumn("equity", F.greatest("equity", F.lit(1e-6)))


def staged_runs(bars: DataFrame, horizon: int, invest: float, parts: int = 4) -> DataFrame:
    """Staged entry against one lump sum from regularly spaced starts: final values of both per start.

    All starts that the spacing allows are replayed; each bar belongs to the starts whose window covers
    it, found by arithmetic.
    """
    spacing = max(1, min(21, horizon // (parts + 1)))
    b = bars.select("symbol", "ts", "open", "close", (win.position() - 1).alias("pos"), F.count("*").over(Window.partitionBy("symbol")).alias("n"))
    last = F.col("n") - horizon - 2
    b = b.withColumn("step", F.lit(spacing)).withColumn("last", last).filter("last > 0")
    lo = F.greatest(F.ceil((F.col("pos") - horizon - 1) / F.col("step")), F.lit(0))
    hi = F.least(F.floor(F.col("pos") / F.col("step")), F.ceil(F.col("last") / F.col("step")) - 1)
    x = b.withColumn("lo", lo).withColumn("hi", hi).filter("lo <= hi").select("symbol", "ts", "open", "close", "pos", "step", F.explode(F.sequence("lo", "hi")).alias("run_id"))
    age = F.col("pos") - F.col("run_id") * F.col("step")
    signals = x.select("symbol", "run_id", "ts", "open", "close", F.least(F.lit(1.0), (F.floor(age / spacing) + 1) / parts).alias("signal"), F.lit(1).alias("warmup"))
    r = bt.run_backtest(signals, bt.Execution(initial_cash=invest))
    return r.groupBy("symbol", "run_id").agg(F.max_by("equity", "ts").alias("staged"), F.max_by("benchmark", "ts").alias("lump"))


def staged_comparison(runs: DataFrame, invest: float) -> DataFrame:
    gain = F.col("staged") - invest
    return runs.groupBy("symbol").agg(
        F.count("*").alias("starts"), (F.avg((F.col("staged") > F.col("lump")).cast("double")) * 100).alias("staged_beat_share_pct"),
        F.percentile("staged", 0.5).alias("staged_median"), F.percentile("lump", 0.5).alias("lump_median"), F.min("staged").alias("staged_worst"), F.min("lump").alias("lump_worst"),
        F.percentile(gain, 0.1).alias("gain_p10"), F.percentile(gain, 0.5).alias("gain_median"), F.percentile(gain, 0.9).alias("gain_p90"))


def plans(bars: DataFrame, requests: DataFrame, horizon: int, stop_pct: float) -> DataFrame:
    """Three options per request (symbol, amount, max_loss): sized to the limit, full with a stop, staged."""
    risk = stats.horizon_risk(bars, horizon)
    stop = stats.stop_outcomes(bars, horizon, stop_pct).select("symbol", *[F.col(c).alias(f"stop_{c}") for c in ("p10_pct", "median_pct", "p90_pct", "worst_pct")])
    staged = staged_comparison(staged_runs(bars, horizon, 1.0), 1.0).select("symbol", *[F.col(f"gain_{c}") for c in ("p10", "median", "p90")], (F.col("staged_worst") - 1).alias("gain_worst"))
    j = requests.join(risk, "symbol").join(stop, "symbol").join(staged, "symbol")
    j = j.withColumn("invest", F.round(stats.size_for_loss(F.col("max_loss"), F.col("amount"), F.col("bad_stretch_loss_pct")), 2))

    def option(key: str, put, bad, typical, good, worst, stop_price):
        return F.struct(F.lit(key).alias("option"), put.alias("invested"), (F.col("amount") - put).alias("cash"), bad.alias("bad"), typical.alias("typical"), good.alias("good"), worst.alias("worst"), stop_price.alias("stop_price"))

    inv, amt, none = F.col("invest"), F.col("amount"), F.lit(None).cast("double")
    a = option("A", inv, *[inv * F.col(c) / 100 for c in ("p10_pct", "median_pct", "p90_pct", "worst_pct")], none)
    s = option("B", amt, *[amt * F.col(f"stop_{c}") / 100 for c in ("p10_pct", "median_pct", "p90_pct", "worst_pct")], F.round(F.col("current_price") * (1 - stop_pct / 100), 2))
    c = option("C", inv, *[inv * F.col(f"gain_{x}") for x in ("p10", "median", "p90", "worst")], none)
    return j.select("request_id", "symbol", F.explode(F.array(a, s, c)).alias("o")).select("request_id", "symbol", "o.*")
