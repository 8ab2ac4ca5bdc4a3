"""First-order linear recurrences y[t] = d[t] * y[t-1] + b[t] as window sums, without Python.

Inside a block whose total decay is bounded, y is a ratio of prefix sums, which cannot overflow. The
value carried in from the block before has decayed by at least e^-40 one block further on, so two
earlier block ends are enough for double precision. Exponential means, Wilder's RSI and the
RiskMetrics variance are all such recurrences.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 40.0


def linear_recurrence(df: DataFrame, log_decay: Column, add: Column, out: str,
                      keys: list[str] | None = None, order: str = "ts") -> DataFrame:
    """Add ``out`` with the recurrence value; ``log_decay`` is ln(d) <= 0, both must be non-NULL."""
    return linear_recurrences(df, [(log_decay, {out: add})], keys, order)


def linear_recurrences(df: DataFrame, parts: list[tuple[Column, dict[str, Column]]],
                       keys: list[str] | None = None, order: str = "ts") -> DataFrame:
    """Several recurrences: pairs of a log decay and the additions that decay by it, by output name.

    What needs the order of time comes first for all of them, so that rows are sorted once by time and once more for each decay.
    """
    keys = keys or ["symbol"]
    n = range(len(parts))
    w = Window.partitionBy(*keys).orderBy(order)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.select("*", *[F.greatest(ld, F.lit(-SPAN)).alias(f"__ld{i}") for i, (ld, _) in enumerate(parts)],
                  *[add.alias(f"__b_{out}") for _, adds in parts for out, add in adds.items()])
    d = d.select("*", *[F.sum(f"__ld{i}").over(running).alias(f"__s{i}") for i in n])
    d = d.select("*", *[F.floor(-F.col(f"__s{i}") / SPAN).alias(f"__blk{i}") for i in n])
    for i, (_, adds) in enumerate(parts):
        rel = F.col(f"__s{i}") + SPAN * F.col(f"__blk{i}")
        inside = Window.partitionBy(*keys, f"__blk{i}").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        d = d.select("*", *[(F.exp(rel) * F.sum(F.col(f"__b_{out}") * F.exp(-rel)).over(inside)).alias(f"__loc_{out}") for out in adds])
        blocks = Window.partitionBy(*keys).orderBy(f"__blk{i}")
        end = F.struct(F.col(f"__s{i}").alias("s"), *[F.col(f"__loc_{out}").alias(out) for out in adds])
        d = d.select("*", *[F.max_by(end, order).over(blocks.rangeBetween(-k, -k)).alias(f"__end{k}") for k in (1, 2)])

        def carried(k: int, out: str, i: int = i) -> Column:
            return F.coalesce(F.col(f"__end{k}")[out] * F.exp(F.col(f"__s{i}") - F.col(f"__end{k}")["s"]), F.lit(0.0))

        d = d.withColumns({out: F.col(f"__loc_{out}") + carried(1, out) + carried(2, out) for out in adds})
        d = d.drop("__end1", "__end2", f"__ld{i}", f"__s{i}", f"__blk{i}", *[f"__{kind}_{out}" for kind in ("b", "loc") for out in adds])
    return d


def ewm_mean(df: DataFrame, c: str, alpha: float, out: str, keys: list[str] | None = None, order: str = "ts") -> DataFrame:
    """Exponential mean started at the first known value.

    A gap of g unknown rows decays the old value by (1 - alpha)^(g+1) and renormalises; on unknown
    rows the last value stays.
    """
    return ewm_means(df, [(c, alpha, out)], keys, order)


def ewm_means(df: DataFrame, wanted: list[tuple[str, float, str]], keys: list[str] | None = None, order: str = "ts") -> DataFrame:
    """Several exponential means (column, alpha, output), see ``ewm_mean``, with their sorts shared."""
    keys = keys or ["symbol"]
    w = Window.partitionBy(*keys).orderBy(order)
    whole = [(c, out) for c, alpha, out in wanted if alpha >= 1]
    df = df.select("*", *[F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(out) for c, out in whole])
    wanted = [x for x in wanted if x[1] < 1]
    if not wanted:
        return df
    columns = list(dict.fromkeys(c for c, _, _ in wanted))
    df = df.withColumn("__p", F.row_number().over(w))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.select("*", *[(F.col("__p") - F.max(F.when(F.col(c).isNotNull(), F.col("__p"))).over(before)).alias(f"__g{columns.index(c)}") for c in columns])
    parts: dict[tuple[str, float], dict[str, Column]] = {}
    decays = {}
    for c, alpha, out in wanted:
        known, gap = F.col(c).isNotNull(), F.col(f"__g{columns.index(c)}")
        old = F.exp(gap * math.log(1 - alpha))
        first = known & gap.isNull()
        decays[c, alpha] = F.when(first | ~known, 0.0).when(gap == 1, math.log(1 - alpha)).otherwise(F.ln(old / (old + alpha)))
        add = F.when(~known, 0.0).when(first, F.col(c)).when(gap == 1, F.col(c) * alpha).otherwise(F.col(c) * alpha / (old + alpha))
        parts.setdefault((c, alpha), {})[f"__y_{out}"] = add
    res = linear_recurrences(df, [(decays[k], adds) for k, adds in parts.items()], keys, order)
    started = lambda c: F.col(c).isNotNull() | F.col(f"__g{columns.index(c)}").isNotNull()
    res = res.withColumns({out: F.when(started(c), F.col(f"__y_{out}")) for c, _, out in wanted})
    return res.drop("__p", *[f"__g{i}" for i in range(len(columns))], *[f"__y_{out}" for _, _, out in wanted])


def wilder_averages(df: DataFrame, columns: list[str], wanted: dict[int, list[str]]) -> DataFrame:
    """For each n the columns' means of the first n known values, then (old * (n-1) + x) / n, under the names ``wanted`` gives. Values start on the second row."""
    w = Window.partitionBy("symbol").orderBy("ts")
    df = df.withColumn("__p", F.row_number().over(w))
    seeds = [(c, n, out) for n, outs in wanted.items() if n > 1 for c, out in zip(columns, outs)]
    df = df.select("*", *[F.avg(c).over(w.rowsBetween(-(n - 1), 0)).alias(f"__seed_{out}") for c, n, out in seeds])
    parts = []
    for n, outs in wanted.items():
        if n == 1:
            df = df.withColumns({out: F.when(F.col("__p") >= 2, F.col(c)) for c, out in zip(columns, outs)})
            continue
        log_decay = F.when(F.col("__p") > n + 1, math.log((n - 1) / n)).otherwise(0.0)
        add = lambda c, out, n=n: F.when(F.col("__p") == n + 1, F.col(f"__seed_{out}")).when(F.col("__p") > n + 1, F.col(c) / n).otherwise(0.0)
        parts.append((log_decay, {f"__y_{out}": add(c, out) for c, out in zip(columns, outs)}))
    if parts:
        df = linear_recurrences(df, parts)
        df = df.withColumns({out: F.when(F.col("__p") >= n + 1, F.col(f"__y_{out}")) for _, n, out in seeds})
    return df.drop("__p", *[f"__{kind}_{out}" for kind in ("seed", "y") for _, _, out in seeds])


def wilder_rsi(df: DataFrame, n: int, out: str) -> DataFrame:
    """RSI seeded with simple means; flat is 50, no loss at all is 100."""
    return wilder_rsis(df, {n: out})


def wilder_rsis(df: DataFrame, wanted: dict[int, str]) -> DataFrame:
    """RSI of several periods, by output name, see ``wilder_rsi``, with their sorts shared; gains and losses of a period decay together."""
    df = df.withColumn("__prev", F.lag("close").over(Window.partitionBy("symbol").orderBy("ts")))
    known, move = F.col("__prev").isNotNull(), F.col("close") - F.col("__prev")
    df = df.withColumns({"__up": F.when(known, F.greatest(move, F.lit(0.0))), "__dn": F.when(known, F.greatest(-move, F.lit(0.0)))}).drop("__prev")
    df = wilder_averages(df, ["__up", "__dn"], {n: [f"__ag{n}", f"__al{n}"] for n in wanted})

    def rsi(n: int) -> Column:
        gain, loss = F.col(f"__ag{n}"), F.col(f"__al{n}")
        flat = F.when(gain > 0, 100.0).otherwise(50.0)
        return F.when(gain.isNotNull(), F.when(loss <= 1e-12, flat).otherwise(100 - 100 / (1 + gain / loss)))

    return df.withColumns({out: rsi(n) for n, out in wanted.items()}).drop("__up", "__dn", *[f"__a{x}{n}" for x in "gl" for n in wanted])


def ewm_rsi(df: DataFrame, n: int, out: str) -> DataFrame:
    """RSI from exponential means of gains and losses (alpha 1/n)."""
    w = Window.partitionBy("symbol").orderBy("ts")
    move = F.col("close") - F.lag("close").over(w)
    known = F.lag("close").over(w).isNotNull()
    df = df.withColumn("__up", F.when(known, F.greatest(move, F.lit(0.0))))
    df = df.withColumn("__dn", F.when(known, F.greatest(-move, F.lit(0.0))))
    df = ewm_means(df, [("__up", 1.0 / n, "__ag"), ("__dn", 1.0 / n, "__al")])
    rsi = (
        F.when(F.col("__al") > 0, 100 - 100 / (1 + F.col("__ag") / F.col("__al")))
        .when(F.col("__ag") > 0, 100.0)
    )
    return df.withColumn(out, rsi).drop("__up", "__dn", "__ag", "__al")
