"""Operators whose state outlives a run: premium baseline and order ledger over streams.

Each key's state lies in Spark's state store, with the stream's checkpoint, so that a run goes on where the run before it stopped, on
whatever executors. What is read of it is bounded: a window of gaps for a symbol, or an account's totals and the contracts that this
run's orders name. Rows of a key are put in order within a micro-batch; a row at or before the last one applied comes too late, is
marked so and changes nothing. Size a micro-batch by the source's options (files must then arrive in order).
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, StructType

from tidewright.operators.divergence import GAPS
from tidewright.operators.portfolio import LEDGER, _Account, _valued
from tidewright.session import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Baseline(StatefulProcessor):
    """Last time seen and the last ``window`` known gaps of one symbol."""

    def __init__(self, window: int, least: int) -> None:
        self.window, self.least = window, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "last timestamp, " + ", ".join(f"{g} array<double>" for g in GAPS))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        day = pd.concat(list(rows)).sort_values("ts", kind="stable")
        last, past = None, deque(maxlen=self.window)
        if self.seen.exists():
            last, *kept = self.seen.get()
            last, past = pd.Timestamp(last), deque(zip(*kept), maxlen=self.window)
        out = []
        for ts, *gap in zip(pd.to_datetime(day["ts"]), *[day[g].astype(float) for g in GAPS]):
            if pd.isna(ts) or (last is not None and ts <= last):
                out.append((None, None, None, None, True))
                continue
            ready = len(past) >= self.least
            out.append((ready, *(np.median(np.array(past), axis=0) if ready else (0.0,) * len(GAPS)), False))
            last = ts
            if np.isfinite(gap).all():
                past.append(tuple(gap))
        if last is not None:
            self.seen.update((last.to_pydatetime(), *([float(p[i]) for p in past] for i in range(len(GAPS)))))
        names = ["baseline_ready", *[f"base_{g}" for g in GAPS], "late"]
        yield pd.concat([day.reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    def close(self) -> None:
        pass


def premium_baselines(gaps: DataFrame, window: int = 60, least: int = 20) -> DataFrame:
    """``divergence.premium_baseline`` over a stream of (symbol, ts, gaps), with the window kept between runs.

    Rows without a time, and rows no later than the last one of their symbol, are ``late``: their baseline is NULL, since the window
    has gone on. Equal times of a symbol therefore count once.
    """
    if not 2 <= least <= window:
        raise ValueError("needs 2 <= least <= window")
    out = StructType(gaps.schema.fields[:]).add("baseline_ready", BooleanType())
    for g in GAPS:
        out = out.add(f"base_{g}", DoubleType())
    out = out.add("late", BooleanType())
    return gaps.groupBy("symbol").transformWithStateInPandas(_Baseline(window, least), out, "Append", "None")


class _Ledger(StatefulProcessor):
    """Totals of one account as a value, its open lines as a map by contract."""

    def __init__(self, starting_cash: float) -> None:
        self.starting_cash = starting_cash

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "last bigint, cash double, realized double, collateral double, open_positions bigint")
        self.lines = handle.getMapState("lines", "kind string, strike double, expiry string", "open array<struct<contracts: double, price: double, held: double>>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        orders = list(pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples(index=False))
        account, last = _Account(self.starting_cash), None
        if self.totals.exists():
            last, account.cash, account.realized, account.collateral, account.count = self.totals.get()
        named = {account.contract(r) for r in orders}
        stored = {c for c in named if self.lines.containsKey(c)}
        for c in stored:
            account.lines[c] = deque(list(line) for line in self.lines.getValue(c)[0])
        out = []
        for r in orders:
            late = last is not None and r.seq <= last
            status = "late" if late else account.apply(r)
            last = last if late else r.seq
            out.append((r.account, r.seq, r.action, status, account.cash, account.realized, account.collateral, account.count))
        for c in named:
            if account.lines.get(c):
                self.lines.updateValue(c, ([tuple(float(x) for x in line) for line in account.lines[c]],))
            elif c in stored:
                self.lines.removeKey(c)
        self.totals.update((int(last), float(account.cash), float(account.realized), float(account.collateral), int(account.count)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LEDGER.split(", ")])

    def close(self) -> None:
        pass


def order_ledger(orders: DataFrame, starting_cash: float = 100_000.0) -> DataFrame:
    """``portfolio.ledger`` over a stream of orders, with each account kept between runs.

    An order whose ``seq`` is not above the account's last one has the status "late" and leaves the account as it is: a source that
    delivers an order twice does not book it twice.
    """
    return _valued(orders).groupBy("account").transformWithStateInPandas(_Ledger(starting_cash), LEDGER, "Append", "None")


def replayed(arrivals: list[DataFrame], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Feed ``arrivals`` to ``operator``, one run each, every one started from the state that the run before it left.

    Inbox, results and state lie in a new folder below the shared one.
    """
    spark = arrivals[0].sparkSession
    home = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    inbox, out, state = (f"{home}/{n}" for n in ("in", "out", "state"))
    for rows in arrivals:
        rows.write.mode("append").parquet(inbox)
        run_available(operator(spark.readStream.schema(rows.schema).parquet(inbox)), out, state)
    return spark.read.parquet(out)


def run_available(stream: DataFrame, out: str, state: str) -> None:
    """One run over all that has arrived since the last one: results are appended to ``out`` as parquet, state is kept in ``state``.

    Both folders must be shared by all executors. The state of these operators needs the RocksDB store; the session's own choice of
    a store is as before once the stream has started.
    """
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)
    try:
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER, before)
    run.awaitTermination()
