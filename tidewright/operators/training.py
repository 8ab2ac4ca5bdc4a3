"""Iterative training over packed blocks: rows are laid out once as binary matrices; each step is one job whose tasks return partial sums.

A block is a hash bucket of rows, ordered inside, and the unit of every sum, so that results do not depend on how blocks fall on
tasks. What reaches the driver is a vector of model size for every ``FAN`` blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.session import checkpointed

BLOCK_ROWS = 16_384  # rows of a block, about
FAN = 256  # partial sums that are added by one task, once there are more blocks than that
PACKED = "split string, block long, rows long, x binary, y binary, w binary"
PARTIAL = "block long, sums binary"


def packed(rows: DataFrame, features: list[str], label: str, keys: list[str], weight: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(split, block, rows, x, y, w): features as a row-major matrix of doubles, labels, weights (1 without a column).

    Rows with an unknown feature or label are left out. ``keys`` identify a row; they choose its block and its place.
    """
    used = rows.na.drop(subset=[*features, label]).select("split", *keys, F.col(label).cast("double").alias("__y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("__w"), F.array(*[F.col(f).cast("double") for f in features]).alias("__x"))
    blocks = used.groupBy("split").agg(F.ceil(F.count("*") / block_rows).alias("__blocks"))  # three rows
    used = used.join(F.broadcast(blocks), "split").withColumn("block", F.pmod(F.xxhash64(*keys), F.col("__blocks"))).drop("__blocks")

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([(k, "ascending") for k in keys])
        x = np.array(table.column("__x").to_pylist(), np.float64)
        y, w = (table.column(c).to_numpy().astype(np.float64) for c in ("__y", "__w"))
        cols = [[table.column("split")[0].as_py()], [table.column("block")[0].as_py()], [len(y)], [x.tobytes()], [y.tobytes()], [w.tobytes()]]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["split", "block", "rows", "x", "y", "w"])

    return checkpointed(used.groupBy("split", "block").applyInArrow(pack, PACKED))


def summed(blocks: DataFrame, count: int, part: Callable[[str, int, np.ndarray, np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum of ``part(split, block, x, y, w)``, vectors of ``width``, over all ``count`` blocks, in the order of the blocks."""

    def run(batches):
        for batch in batches:
            for split, block, rows, x, y, w in zip(*(batch.column(c).to_pylist() for c in ("split", "block", "rows", "x", "y", "w"))):
                found = part(split, block, np.frombuffer(x).reshape(rows, -1), np.frombuffer(y), np.frombuffer(w))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([found.astype(np.float64).tobytes()], pa.binary())], ["block", "sums"])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending")])
        total = sum((np.frombuffer(s) for s in table.column("sums").to_pylist()), np.zeros(width))
        return pa.table([pa.array([table.column("block")[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["block", "sums"])

    parts = blocks.mapInArrow(run, PARTIAL)
    if count > FAN:
        parts = parts.groupBy(F.floor(F.col("block") / FAN).alias("fan")).applyInArrow(add, PARTIAL)
    rows = sorted((r["block"], r["sums"]) for r in parts.collect())
    return sum((np.frombuffer(s) for _, s in rows), np.zeros(width))


def soft_weights(labels: Column, counts: dict[int, int], classes: int) -> Column:
    """Square root of the inverse class frequency, as a column; ``counts`` are those of the training rows."""
    total = sum(counts.values())
    out = F.lit(1.0)
    for c, n in counts.items():
        out = F.when(labels == c, (total / (n * classes)) ** 0.5).otherwise(out)
    return out


def class_counts(rows: DataFrame, label: str) -> dict[int, int]:
    """Training rows by class: as many rows as there are classes."""
    return {int(r[0]): r[1] for r in rows.filter(f"split = 'train' AND {label} IS NOT NULL").groupBy(F.col(label).cast("int")).count().collect()}


def macro_f1(cells: np.ndarray) -> float:
    """Unweighted mean of F1 over the classes that occur, from counts [actual, predicted]."""
    hit, said, was = np.diag(cells), cells.sum(0), cells.sum(1)
    some = said + was > 0
    return float(np.mean(2 * hit[some] / (said + was)[some])) if some.any() else 0.0
