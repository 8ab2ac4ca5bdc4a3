"""Substring dedup by level-wise doubling: word windows repeated at one length alone are extended to about twice that length.

The first length is half the shortest window; of its windows only the smallest hash of each full window is looked up, which is
the same in every copy, so a quarter of the positions is shuffled. A longer window is looked up only where what it consists of
was repeated at the length before; this goes on to the wanted length, or until nothing survives. Keys travel in packed blocks
(``blocks``); at the last length two hashes of the words must agree, 128 bits in all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.blocks import ask, block_count, shared, short
from tidewright.llm.words import chunks, mix, window_hashes, word_hashes
from tidewright.session import checkpointed

BASE_WORDS = 7
NONE_KEPT = hashlib.sha256(b"").hexdigest()


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` numbers in a row, from each position on."""
    reach, pad = 1, np.full(width, np.iinfo(np.uint64).max, np.uint64)
    while reach < width:
        step = min(reach, width - reach)
        h = np.minimum(h, np.concatenate([h, pad])[step : step + len(h)])
        reach += step
    return h


def _anchors(words: np.ndarray, counts: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of 2 * base - 1 words the key of its smallest base window, and whether the window is inside its text."""
    keys, _ = window_hashes(words, counts, base)
    _, inside = window_hashes(words, counts, 2 * base - 1)
    return mix(_smallest(keys, base)), inside


def _first_level(base: int):
    def run(batches):
        for ids, texts in chunks(batches):
            words, counts = word_hashes(texts)
            keys, inside = _anchors(words, counts, base)
            yield np.repeat(np.array(ids, np.int64), counts)[inside], keys[inside], None

    return run


def _survivors(words: np.ndarray, counts: np.ndarray, found: list, length: int, before: int | None, base: int, blocks: int) -> np.ndarray:
    """Which windows of ``length`` consist of repeated ones of the level ``before`` (None: of the first level)."""
    if before is None:
        keys, _ = _anchors(words, counts, base)
        parts = [0]
    else:
        keys, _ = window_hashes(words, counts, before)
        parts = [0, length - before]
    keys = short(keys, blocks)
    known = np.zeros(len(words) + length, bool)
    at = 0
    for n, some in zip(counts, found):
        known[at : at + n] = np.isin(keys[at : at + n], np.frombuffer(b"".join(some or ()), np.uint64))
        at += n
    _, inside = window_hashes(words, counts, length)
    for p in parts:
        inside = inside & known[p : p + len(words)]
    return inside


def _next_level(length: int, before: int | None, base: int, blocks: int, last: bool):
    def run(batches):
        for ids, texts, found in chunks(batches):
            words, counts = word_hashes(texts)
            which = _survivors(words, counts, found, length, before, base, blocks)
            keys, _ = window_hashes(words, counts, length)
            checks = window_hashes(words, counts, length, seed=1)[0][which] if last else None
            yield np.repeat(np.array(ids, np.int64), counts)[which], keys[which], checks

    return run


def _sha(text: bytes | None) -> tuple[int, str]:
    words = (text or b"").split()
    return len(words), hashlib.sha256(b" ".join(words)).hexdigest()


def _profile(window: int):
    """(doc_id, sha) of each text that has a window."""

    def run(batches):
        for ids, texts in chunks(batches):
            rows = [(i, sha) for i, (n, sha) in zip(ids, map(_sha, texts)) if n >= window]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.string()])], ["doc_id", "sha"])

    return run


def _counted(texts_too: bool):
    """Word count and digest of each text; the text only where some of its windows may be repeated, or if all are asked for."""

    def run(batches):
        for ids, texts, found, copies in chunks(batches):
            told = [_sha(t) for t in texts]
            copy = [s in (c or ()) for (_, s), c in zip(told, copies)]
            live = [None if c else f for c, f in zip(copy, found)]
            kept = [t if texts_too or f else None for t, f in zip(texts, live)]
            cols = [pa.array(ids, pa.int64()), pa.array([n for n, _ in told], pa.int64()), pa.array([s for _, s in told])]
            cols += [pa.array(kept, pa.binary()), pa.array(copy, pa.bool_()), pa.array(live, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "sha", "text", "copy", "found"])

    return run


def _cut(window: int, blocks: int, texts_too: bool):
    def run(batches):
        for ids, n_words, sha, texts, copy, found in chunks(batches):
            words, counts = word_hashes(texts)
            keys, inside = window_hashes(words, counts, window)
            keys = short(keys, blocks) if len(keys) else keys
            rows, at = [], 0
            for doc, n, digest, text, copied, some in zip(ids, n_words, sha, texts, copy, found):
                removed, kept = 0, None
                if copied:
                    removed, digest, kept = n, NONE_KEPT, b""
                elif some:
                    hit = np.flatnonzero(inside[at : at + n] & np.isin(keys[at : at + n], np.frombuffer(b"".join(some), np.uint64)))
                    depth = np.bincount(hit, minlength=n + 1) - np.bincount(hit + window, minlength=n + 1)[: n + 1]
                    covered = np.cumsum(depth)[:n] > 0
                    removed = int(covered.sum())
                    kept = b" ".join([w for w, c in zip(text.split(), covered.tolist()) if not c])
                    digest = hashlib.sha256(kept).hexdigest()
                if texts_too and kept is None and text is not None:
                    kept = b" ".join(text.split())
                rows.append((doc, n, removed, digest, kept if texts_too and text is not None else None))
                at += n if text is not None else 0
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.string(), pa.string()])], names)

    return run


def remove_repeats(docs: DataFrame, window: int = 13, texts: bool = True) -> DataFrame:
    """Remove each word that lies in a window of ``window`` words which also starts in a document with a smaller doc_id.

    (doc_id, n_words, n_removed, kept_sha256, kept) for each row of ``docs`` (doc_id, text; other columns are ignored); kept
    is the kept words joined by one space, null for a null text, and left out without ``texts``. All windows are judged on the input. A null, empty or
    blank text has no words. A row with a null doc_id keeps its words and is not compared. Rows that repeat a doc_id are one
    document for the comparison: none is smaller than the other. An empty table gives an empty result.
    """
    base = min(BASE_WORDS, (window + 1) // 2)
    lengths = [min(window, 2 * base - 1)]
    while lengths[-1] < window:
        lengths.append(min(window, 2 * lengths[-1]))
    docs = docs.select("doc_id", "text")
    known = docs.filter("doc_id is not null")
    blocks = block_count(known)
    blocks = max(8, blocks // 4)
    gathered = lambda hits: hits.select("doc_id", F.array("keys").alias("found"))
    found = gathered(shared(ask(known, _first_level(base), blocks), blocks))
    # Texts of the same words: every window of the later ones starts in the first, so that these need no lookup.
    told = checkpointed(known.mapInArrow(_profile(window), "doc_id long, sha string"))
    first = told.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")).filter("rows > 1")
    copies = told.join(first, "sha").filter("doc_id > first_id").groupBy("doc_id").agg(F.collect_set("sha").alias("copies"))
    facts = found.join(copies, "doc_id", "full").hint("shuffle_hash")
    work = docs.join(facts, "doc_id", "left").mapInArrow(_counted(texts), "doc_id long, n_words long, sha string, text binary, copy boolean, found array<binary>")
    work = checkpointed(work)
    live = work.filter("found is not null").select("doc_id", "text", "found")
    before = None
    for length in lengths:
        last = length == window
        hits = shared(ask(live, _next_level(length, before, base, blocks, last), blocks), blocks, smaller=last)
        if not last:
            live = checkpointed(live.drop("found").join(gathered(hits), "doc_id"))
        before = length
    row = ["doc_id", "n_words", "sha", "text", "copy", "found"]
    cut = gathered(hits).withColumnRenamed("found", "hit").hint("shuffle_hash")
    plain = work.filter("found is null").select(row)
    rest = work.filter("found is not null").drop("found").join(cut, "doc_id", "left").withColumnRenamed("hit", "found").select(row)
    done = plain.union(rest).mapInArrow(_cut(window, blocks, texts), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return done if texts else done.drop("kept")
