"""Streams with stored state: equal to the batch operators after a restart in the middle."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidewright.operators.divergence import GAPS, premium_baseline
from tidewright.operators.portfolio import ledger
from tidewright.streaming.state import order_ledger, premium_baselines, run_available

ORDER = "account long, seq long, action string, side string, contracts int, fill_price double, spot double, strike double, kind string, expiry string"


def _runs(spark, tmp_path, parts, operator):
    """Each part arrives, then a run of its own: a new query from the folder of state."""
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in parts:
        part.write.mode("append").parquet(inbox)
        run_available(operator(spark.readStream.schema(part.schema).parquet(inbox)), out, state)
    return spark.read.parquet(out)


def _gaps(spark, days):
    rows = [(s, date(2020, 1, 1) + timedelta(days=i), None if i % 7 == 3 else float((i * 37 + len(s) * 11) % 29), float(i % 5), -float(i % 11)) for s in ("A", "BB") for i in days]
    return spark.createDataFrame(rows, "symbol string, ts date, mean_gap double, variance_gap double, skew_gap double")


@pytest.mark.parametrize("cuts", [(0, 40, 41, 90), (0, 5, 90)])
def test_baseline_goes_on_after_a_restart(spark, tmp_path, cuts):
    parts = [_gaps(spark, range(a, b)) for a, b in zip(cuts, cuts[1:])]
    got = _runs(spark, tmp_path, parts, lambda s: premium_baselines(s, 15, 6))
    want = premium_baseline(_gaps(spark, range(90)), 15, 6)
    names = ["symbol", "ts", "baseline_ready", *[f"base_{g}" for g in GAPS]]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))
    assert got.filter("late").count() == 0 and got.count() == 180


def test_late_gaps_change_nothing(spark, tmp_path):
    first, again = _gaps(spark, range(0, 40)), _gaps(spark, range(30, 60))
    got = _runs(spark, tmp_path, [first, again], lambda s: premium_baselines(s, 15, 6))
    late = got.filter("late")
    assert late.count() == 20 and late.filter("baseline_ready IS NOT NULL OR base_mean_gap IS NOT NULL").count() == 0
    want = premium_baseline(_gaps(spark, range(60)), 15, 6)
    assert got.filter("NOT late").select("symbol", "ts", "base_skew_gap").exceptAll(want.select("symbol", "ts", "base_skew_gap")).count() == 0
    assert got.filter("NOT late").count() == 120


def test_baseline_of_rows_without_time_or_gaps(spark, tmp_path):
    rows = [("A", None, 1.0, 1.0, 1.0), ("A", date(2020, 1, 1), float("nan"), 1.0, 1.0), (None, date(2020, 1, 1), 1.0, 1.0, 1.0)]
    got = _runs(spark, tmp_path, [spark.createDataFrame(rows, _gaps(spark, [0]).schema)], lambda s: premium_baselines(s, 4, 2))
    assert sorted((r.symbol or "", r.late) for r in got.collect()) == [("", False), ("A", False), ("A", True)]
    with pytest.raises(ValueError):
        premium_baselines(_gaps(spark, [0]), 4, 5)


def _orders(spark, seqs):
    rows = []
    for a in (1, 2, 3):
        for i in seqs:
            kind, strike = ("call", 95.0 + i % 3 * 5) if (i + a) % 2 else ("put", None if i % 10 == 0 else 90.0)
            action = "close" if i % 4 == 3 else "expire" if i % 9 == 8 else "open"
            rows.append((a, i, action, "sell" if i % 5 == 0 else "buy", None if i % 6 == 3 else 1 + i % 3, 1.0 + i % 7, None if i % 36 == 26 else 95.0 + i % 10, strike, kind, "x" if i % 3 else None))
    return spark.createDataFrame(rows, ORDER)


def test_ledger_goes_on_after_a_restart(spark, tmp_path):
    parts = [_orders(spark, range(a, b)) for a, b in ((0, 31), (31, 32), (32, 80))]
    got = _runs(spark, tmp_path, parts, order_ledger)
    want = ledger(_orders(spark, range(80)))
    key = lambda r: (r.account, r.seq)
    a, b = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert len(a) == len(b) == 240 and len({r.status for r in b}) > 3
    for x, y in zip(a, b):
        assert (x.action, x.status, x.open_positions) == (y.action, y.status, y.open_positions)
        assert all(abs(x[c] - y[c]) < 1e-6 for c in ("cash", "realized", "collateral"))


def test_an_order_delivered_twice_is_booked_once(spark, tmp_path):
    got = _runs(spark, tmp_path, [_orders(spark, range(0, 20)), _orders(spark, range(10, 30))], order_ledger)
    want = ledger(_orders(spark, range(30))).groupBy("account").agg(F.round(F.max_by("cash", "seq"), 6).alias("cash"))
    last = got.filter("status <> 'late'").groupBy("account").agg(F.round(F.max_by("cash", "seq"), 6).alias("cash"))
    assert got.filter("status = 'late'").count() == 30
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))
