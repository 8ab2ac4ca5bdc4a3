"""Hard-negative mining by a secondary-sort shuffle.

Scores of (anchor, row) pairs become keys (anchor, descending score, kind, id), shuffled by anchor and sorted inside the
partitions by ``repartitionAndSortWithinPartitions``. An iterator reads each anchor's pairs once, from the best score down: a
positive opens a window, and each negative after it goes to the windows that are open, not full and reach down to its score. So
an anchor's pairs are never held together. Positives stand before negatives of the same score, whose ids may be smaller.

What is shuffled is thinned before, without loss: a first pass over the rows finds the positives of a block of anchors (each task
its best few, then a rank over those); a second keeps for every window the first few negatives of a task, which is all that
the window can take from there. So a task sends a bounded number of pairs for an anchor, however many rows it has. Anchors
travel to the tasks in blocks of bounded size, one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.rdd import portable_hash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import checkpointed

ANCHORS = 16_384  # anchors of a block, about; with 64 components 8 MB
TILE = 1 << 21  # scores that a task works on at once, about
LONGEST = (1 << 63) - 1
PAIR = "anchor_id long, variant int, score long, kind int, vec_id long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
Flat = tuple[np.ndarray, np.ndarray, np.ndarray]


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: in doubles where these hold every partial sum, else in whole numbers, held at the bounds of a long."""
    top = max(1.0, float(np.abs(anchors).max(initial=0))) * max(1.0, float(np.abs(rows).max(initial=0))) * max(1, rows.shape[1])
    if top < 2.0**53:
        return (anchors @ rows.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(anchors) @ whole(rows).T, -LONGEST, LONGEST).astype(np.int64)


def _first(flat: Flat, most: int) -> Flat:
    """Of (group, score, id), each once, the ``most`` first of each group by falling score, then id."""
    group, score, ids = flat
    order = np.lexsort((ids, -score, group))
    group, score, ids = group[order], score[order], ids[order]
    fresh = np.ones(len(group), bool)
    fresh[1:] = (group[1:] != group[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
    group, score, ids = group[fresh], score[fresh], ids[fresh]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
    rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
    keep = rank < most
    return group[keep], score[keep], ids[keep]


def _floor(flat: Flat, groups: int, most: int) -> np.ndarray:
    """The score that a group's next entry must reach: that of its last one where it is full."""
    out = np.full(groups, -LONGEST)
    ends = np.flatnonzero(np.concatenate([flat[0][1:] != flat[0][:-1], [True]])) if len(flat[0]) else np.zeros(0, int)
    full = ends[np.diff(np.concatenate([[-1], ends])) == most]
    out[flat[0][full]] = flat[1][full]
    return out


class Anchors:
    """A block of anchors: by length of vector their scaled components; labels and ids of all."""

    def __init__(self, rows: list, scale: float):
        self.ids = np.array([r["vec_id"] for r in rows], np.int64)
        self.variants = np.array([r["variant"] for r in rows], np.int64)
        self.labels = np.array([r["label"] for r in rows], np.int64)
        self.at = {n: np.array([i for i, r in enumerate(rows) if len(r["embedding"]) == n]) for n in {len(r["embedding"]) for r in rows}}
        self.scaled = {n: scaled([rows[i]["embedding"] for i in at], n, scale) for n, at in self.at.items()}
        self.scale, self.room = scale, max(1, TILE // max(1, len(rows)))

    def tiles(self, batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor indices, scores, ids and labels of rows) of bounded size; rows of one vector length at a time."""
        held: dict[int, list] = {}
        for batch in batches:
            for vec_id, label, vector in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "embedding"))):
                if len(vector) in self.at:
                    rows = held.setdefault(len(vector), [])
                    rows.append((vec_id, label, vector))
                    if len(rows) >= self.room:
                        yield self._tile(held.pop(len(vector)))
        for rows in held.values():
            yield self._tile(rows)

    def _tile(self, rows: list):
        ids, labels, vectors = zip(*rows)
        n = len(vectors[0])
        return self.at[n], _scores(self.scaled[n], scaled(vectors, n, self.scale)), np.array(ids, np.int64), np.array(labels, np.int64)


def scaled(vectors, n: int, scale: float) -> np.ndarray:
    return np.floor(scale * np.array(vectors, np.float64).reshape(len(vectors), n))


def _join(a: Flat, b: Flat) -> Flat:
    return tuple(np.concatenate(x) for x in zip(a, b))


NONE: Flat = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _batch(anchors: Anchors, flat: Flat, kind: int) -> pa.RecordBatch:
    at, score, ids = flat
    cols = [pa.array(anchors.ids[at]), pa.array(anchors.variants[at], pa.int32()), pa.array(score), pa.array(np.full(len(at), kind), pa.int32()), pa.array(ids)]
    return pa.RecordBatch.from_arrays(cols, ["anchor_id", "variant", "score", "kind", "vec_id"])


def _positives(shared, most: int):
    """Each anchor's best rows of its label in this task."""

    def run(batches):
        anchors, best = shared.value, NONE
        for at, score, ids, labels in anchors.tiles(batches):
            floor = _floor(best, len(anchors.ids), most)[at]
            a, r = np.nonzero((anchors.labels[at][:, None] == labels[None]) & (score >= floor[:, None]) & (anchors.ids[at][:, None] != ids[None]))
            best = _first(_join(best, (at[a], score[a, r], ids[r])), most)
        yield _batch(anchors, best, 0)

    return run


def _negatives(shared, most: int, low: int, high: int):
    """Of this task's rows of other labels, the first few of each window."""

    def run(batches):
        anchors, tops = shared.value  # tops: scores of each anchor's positives, best first; -LONGEST where it has fewer
        groups = tops.size
        bottoms = np.array([[-((-low * int(p)) // high) if p > -LONGEST else LONGEST for p in row] for row in tops], np.int64).reshape(tops.shape)
        best = NONE
        for at, score, ids, labels in anchors.tiles(batches):
            floor = np.maximum(_floor(best, groups, most).reshape(tops.shape), bottoms)
            a, r = np.nonzero((score >= floor[at].min(axis=1)[:, None]) & (score <= tops[at].max(axis=1)[:, None]) & (anchors.labels[at][:, None] != labels[None]) & (anchors.ids[at][:, None] != ids[None]))
            a, s, i = at[a], score[a, r], ids[r]
            for k in range(tops.shape[1]):
                inside = (s <= tops[a, k]) & (s >= floor[a, k])
                best = _join(best, (a[inside] * tops.shape[1] + k, s[inside], i[inside]))
            best = _first(best, most)
        found = _first((best[0] // tops.shape[1], best[1], best[2]), groups * most + 1)  # a pair of several windows once
        yield _batch(anchors, found, 1)

    return run


def _windows(positives: int, negatives: int, low: int, high: int):
    """Read sorted keys (anchor, variant, -score, kind, id); hold the open windows of one anchor."""

    def run(pairs):
        now, last, opened = None, None, []
        for key, _ in pairs:
            if key == last:
                continue
            last = key
            anchor, variant, turned, kind, vec_id = key
            if (anchor, variant) != now:
                now, opened = (anchor, variant), []
            score = -turned
            if kind == 0:
                if len(opened) < positives:
                    opened.append([vec_id, score, 0])
                continue
            for window in opened:
                if window[2] < negatives and low * window[1] <= high * score:
                    window[2] += 1
                    yield anchor, window[0], window[2], vec_id, window[1], score

    return run


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for (vec_id, embedding, label) rows.

    Anchors are rows whose vec_id ``every`` divides. A score is the integer inner product of the components, each first
    floor(scale * x); higher scores come first, ties by smaller vec_id. An anchor's positives are its first other rows of the same
    label; a positive's negatives are the first rows of another label with low * positive <= high * negative <= high * positive.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part; a vector of another length than
    the anchor's has no score with it. Rows with an anchor's id are never its positives or negatives. Rows of a label that
    repeat an id with an equal score count once; anchors that repeat an id with another label or vector are anchors of their own
    under that id. Scores beyond a long are held at its bounds. Other columns are ignored. An anchor without positives, or a
    positive without negatives in its window, has no row; a table without anchors gives an empty result.
    """
    spark = vectors.sparkSession
    good = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).filter(
        "vec_id is not null and label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    asked = good.filter(F.col("vec_id") % every == 0).distinct()
    asked = checkpointed(asked.withColumn("variant", F.row_number().over(Window.partitionBy("vec_id").orderBy("label", "embedding"))))
    blocks = -(-asked.count() // ANCHORS)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks)))
    pairs = [spark.createDataFrame([], PAIR)]
    order = Window.partitionBy("anchor_id", "variant").orderBy(F.desc("score"), "vec_id")
    for b in range(blocks):
        rows = asked.filter(block == b).collect()  # about ANCHORS
        if not rows:
            continue
        anchors = Anchors(rows, scale)
        shared = spark.sparkContext.broadcast(anchors)
        best = good.mapInArrow(_positives(shared, positives), PAIR).distinct()
        best = checkpointed(best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives))
        tops = np.full((len(rows), positives), -LONGEST)
        where = {(r["vec_id"], r["variant"]): i for i, r in enumerate(rows)}
        for r in best.collect():  # at most ``positives`` an anchor
            tops[where[r["anchor_id"], r["variant"]], r["place"] - 1] = r["score"]
        again = spark.sparkContext.broadcast((anchors, tops))
        pairs += [best.drop("place"), checkpointed(good.mapInArrow(_negatives(again, negatives, low, high), PAIR))]
        shared.destroy()
        again.destroy()
    scored = pairs[0]
    for more in pairs[1:]:
        scored = scored.union(more)
    keyed = scored.rdd.map(lambda r: ((r[0], r[1], -r[2], r[3], r[4]), None))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_anchor = keyed.repartitionAndSortWithinPartitions(parts, lambda key: portable_hash(key[:2]))
    return spark.createDataFrame(by_anchor.mapPartitions(_windows(positives, negatives, low, high)), RESULT)
