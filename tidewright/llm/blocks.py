"""Which keys of a document also occur in other documents: keys are shuffled in packed blocks, not as rows.

A task sends each key of a chunk once, for the chunk's smallest document that has it, so a key that a third of all documents
share travels once per chunk. Documents that share a key inside the chunk are answered there.

Only 32 bits of a key travel; with its block's number they stand for it. Blocks hold about as many keys at every input size, so
that one key in some thousands is taken for another's: what ``shared`` finds are candidates, unless second hashes go with them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.words import mix

BLOCK_KEYS = 1_000_000
ASK = "block long, kind int, docs binary, sizes binary, keys binary, checks binary"
SINGLE, MULTI, DIRECT = 0, 1, 2
Keyed = tuple[np.ndarray, np.ndarray, np.ndarray | None]


def block_count(df: DataFrame, bytes_per_key: float = 6.0) -> int:
    """Blocks for as many keys as the texts of ``df`` may hold; follows the input's size."""
    size = df.select(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(8, int(size / bytes_per_key / BLOCK_KEYS) + 1)


def _block(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def short(keys: np.ndarray, blocks: int) -> np.ndarray:
    """What ``shared`` returns for these keys."""
    return (_block(keys, blocks) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def _rows(kind: int, docs: np.ndarray, keys: np.ndarray, checks: np.ndarray | None, blocks: int, out: list) -> None:
    """Pack (document, key) pairs into one row a block; inside it keys stand by document."""
    if not len(keys):
        return
    block = _block(keys, blocks)
    order = np.lexsort((docs, block))
    docs, keys, block = docs[order], keys[order].astype(np.uint32), block[order]
    checks = checks[order] if checks is not None else None
    cut = np.flatnonzero(np.diff(block)) + 1
    for lo, hi in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(block)]])):
        d = docs[lo:hi]
        new = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1])
        sizes = np.diff(np.append(new, len(d))).astype(np.uint32)
        out.append((int(block[lo]), kind, d[new].tobytes(), sizes.tobytes(), keys[lo:hi].tobytes(), checks[lo:hi].tobytes() if checks is not None else b""))


def _requests(docs: np.ndarray, keys: np.ndarray, checks: np.ndarray | None, blocks: int) -> list:
    """What a chunk sends for its (document, key) pairs."""
    order = np.lexsort((docs, checks, keys)) if checks is not None else np.lexsort((docs, keys))
    docs, keys = docs[order], keys[order]
    checks = checks[order] if checks is not None else None
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    if checks is not None:
        first[1:] |= checks[1:] != checks[:-1]
    same = np.concatenate([[False], ~first[1:] & (docs[1:] == docs[:-1])]) if len(keys) else first
    if same.any():  # a key counts once for a document
        docs, keys, first = docs[~same], keys[~same], first[~same]
        checks = checks[~same] if checks is not None else None
    if not len(keys):
        return []
    group = np.cumsum(first) - 1
    multi = np.bincount(group)[group] > 1
    out: list = []
    for kind, which in ((SINGLE, first & ~multi), (MULTI, first & multi), (DIRECT, ~first)):
        _rows(kind, docs[which], keys[which], checks[which] if checks is not None else None, blocks, out)
    return out


def _frame(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


ASK_ARROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("docs", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary()), ("checks", pa.binary())])


def ask(df: DataFrame, keyed: Callable[[Iterable[pa.RecordBatch]], Iterator[Keyed]], blocks: int) -> DataFrame:
    """One row for each block and chunk. ``keyed`` yields (documents, keys, second hashes or None) for each chunk of ``df``."""

    def run(batches):
        for docs, keys, checks in keyed(batches):
            rows = _requests(docs, keys, checks, blocks)
            for at in range(0, len(rows), 2000):
                yield _frame(rows[at : at + 2000], ASK_ARROW)

    return df.mapInArrow(run, ASK)


def _by_doc(docs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents once each in order, their numbers of keys, and the keys by document."""
    order = np.argsort(docs, kind="stable")
    docs, keys = docs[order], keys[order]
    new = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    return docs[new], np.diff(np.append(new, len(docs))).astype(np.uint32), keys


def _pairs(table: pa.Table, kind: type) -> list[tuple[np.ndarray, np.ndarray]]:
    """(document, key) arrays of each packed row."""
    rows = zip(*(table.column(c).to_pylist() for c in ("docs", "sizes", "keys")))
    return [(np.repeat(np.frombuffer(d, np.int64), np.frombuffer(n, np.uint32)), np.frombuffer(k, kind)) for d, n, k in rows]


def shared(asked: DataFrame, blocks: int, smaller: bool = False) -> DataFrame:
    """(doc_id, n, keys): the document's keys that also occur elsewhere, packed; one row for each document that has any.

    With ``smaller``, only those that occur in a document with a smaller id. Keys are equal when both hashes are. Answers
    travel packed as well, by bucket of documents, of which there are as many as blocks.
    """
    reply = pa.schema([("bucket", pa.int64()), ("docs", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary())])
    told = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("keys", pa.binary())])

    def answer(table: pa.Table) -> pa.Table:
        kinds, high = table.column("kind").to_numpy(), np.uint64(table.column("block")[0].as_py() << 32)
        pairs = _pairs(table, np.uint32)
        hits = [pair for pair, kind in zip(pairs, kinds) if kind == DIRECT]
        open_ = [i for i, kind in enumerate(kinds) if kind != DIRECT]
        if open_:
            d, k = (np.concatenate([pairs[i][j] for i in open_]) for j in (0, 1))
            m = np.concatenate([np.full(len(pairs[i][1]), kinds[i] == MULTI) for i in open_])
            raw = table.column("checks").to_pylist()
            c = np.concatenate([np.frombuffer(raw[i], np.uint64) for i in open_])
            order = np.lexsort((c, k)) if len(c) else np.argsort(k)
            d, k, m = d[order], k[order], m[order]
            first = np.ones(len(k), bool)
            first[1:] = k[1:] != k[:-1]
            if len(c):
                c = c[order]
                first[1:] |= c[1:] != c[:-1]
            group = np.cumsum(first) - 1
            hit = d > np.minimum.reduceat(d, np.flatnonzero(first))[group] if smaller else m | (np.bincount(group)[group] > 1)
            hits.append((d[hit], k[hit]))
        d, k = (np.concatenate([h[j] for h in hits]) for j in (0, 1))
        bucket = mix(d.astype(np.uint64)) % np.uint64(blocks)
        rows = []
        for b in np.unique(bucket):
            docs, sizes, keys = _by_doc(d[bucket == b], k[bucket == b].astype(np.uint64) | high)
            rows.append((int(b), docs.tobytes(), sizes.tobytes(), keys.tobytes()))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), reply.types)], schema=reply) if rows else reply.empty_table()

    def merge(table: pa.Table) -> pa.Table:
        pairs = _pairs(table, np.uint64)
        docs, sizes, keys = _by_doc(*(np.concatenate([p[j] for p in pairs]) for j in (0, 1)))
        ends = np.cumsum(sizes)
        return pa.table([pa.array(docs), pa.array(sizes.astype(np.int64)), pa.array([keys[e - n : e].tobytes() for e, n in zip(ends, sizes)], pa.binary())], schema=told)

    replies = asked.groupBy("block").applyInArrow(answer, "bucket long, docs binary, sizes binary, keys binary")
    return replies.groupBy("bucket").applyInArrow(merge, "doc_id long, n long, keys binary")
