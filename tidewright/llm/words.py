"""Words, shingles and hashes of whole texts, a few megabytes of text at a time.

A word is a run of bytes other than space, tab, LF, VT, FF and CR; ``bytes.split`` cuts at exactly those.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 20  # of text that a task works on at once
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[list, ...]]:
    """Columns of the batches as lists, regrouped to about ``most`` bytes of text; the column ``text`` comes as bytes."""
    held: list[list] | None = None
    size = 0
    for batch in batches:
        names = batch.schema.names
        cols = [batch.column(i).cast(pa.binary()).to_pylist() if n == text else batch.column(i).to_pylist() for i, n in enumerate(names)]
        at = names.index(text)
        if held is None:
            held = [[] for _ in names]
        for row in zip(*cols):
            for store, value in zip(held, row):
                store.append(value)
            size += len(row[at] or b"")
            if size >= most:
                yield tuple(held)
                held, size = [[] for _ in names], 0
    if held and held[0]:
        yield tuple(held)


def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


PART_BYTES = 2 << 20
A_BLANK = re.compile(rb"[\x20\x09-\x0D]")
SIZE = PART_BYTES + (1 << 16)
BASE = 0x9E3779B97F4A7C15 | 1
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
BYTES = mix(np.arange(1, 257, dtype=np.uint64))  # a random number for each byte
LOWER = BYTES.copy()
LOWER[65:91] = BYTES[97:123]
_POWERS: dict[int, np.ndarray] = {}


def powers(size: int, base: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < size:
        _POWERS[base] = _powers(max(size, SIZE), base)
    return _POWERS[base][:size]


def _hashed(part: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of bytes that end with a blank."""
    raw = np.frombuffer(part, np.uint8)
    blank = BLANK[raw]
    before = np.concatenate([[True], blank[:-1]])
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * powers(len(raw), BASE), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * powers(len(raw), pow(BASE, -1, 1 << 64))[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), starts


def word_hashes(texts: list, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the number of words of each text.

    The hash of a word is a polynomial in its bytes, taken from one running sum over the texts; ``lower`` reads A-Z as a-z.
    Long texts are read in parts that end between words, as the sums take many times a part's bytes.
    """
    joined = b" ".join([x or b"" for x in texts]) + b" "
    found, at = [], 0
    while at < len(joined):
        blank = A_BLANK.search(joined, min(at + PART_BYTES, len(joined) - 1))
        hashes, starts = _hashed(joined[at : blank.end()], LOWER if lower else BYTES)
        found.append((hashes, starts + at))
        at = blank.end()
    hashes, starts = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    edges = np.cumsum([len(x or b"") + 1 for x in texts])
    return hashes, np.diff(np.searchsorted(starts, edges), prepend=0).astype(np.int64)


def window_hashes(words: np.ndarray, counts: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``width`` words from each word on, and whether that window stays inside its text."""
    total = len(words)
    if total == 0:
        return words, np.zeros(0, bool)
    out = np.zeros(total, np.uint64)
    padded = np.concatenate([mix(words + np.uint64(seed)), np.zeros(width, np.uint64)])
    for k in range(width):
        out *= STEP
        out += padded[k : k + total]
    ends = np.cumsum(counts)
    room = np.repeat(ends, counts) - np.arange(total)
    return mix(out), room >= width


def shingles(texts: list, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased word shingles of the texts, repeats included, and the text's index of each.

    A text with fewer words than ``width`` is one shingle, its whole sequence; one without words has none.
    """
    words, counts = word_hashes(texts, lower=True)
    hashes, inside = window_hashes(words, counts, width)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        starts = np.cumsum(counts) - counts
        for i in short:
            at = int(starts[i])
            value = np.uint64(xxhash.xxh3_64_intdigest(words[at : at + int(counts[i])].tobytes(), seed=7))
            hashes[at], inside[at] = value, True
    return hashes[inside], np.repeat(np.arange(len(texts), dtype=np.int64), counts)[inside]


def shingle_sets(texts: list, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hashes sorted by text, the text's index of each, and set sizes."""
    hashes, owner = shingles(texts, width)
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    return hashes, owner, np.bincount(owner, minlength=len(texts)).astype(np.int64)


def spoken(texts: list, width: int = 5) -> list[set[bytes]]:
    """The same shingles as bytes, where hashes will not do."""
    out = []
    for t in texts:
        words = (t or b"").lower().split()
        out.append({b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    return out


def keep_rows(df, decide):
    """The rows of ``df`` for whose texts ``decide(list of bytes) -> list of bool`` says true; no shuffle, all columns."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            keep: list = []
            part: list = []
            size = 0
            for t in texts:
                part.append(t)
                size += len(t or b"")
                if size >= CHUNK_BYTES:
                    keep += decide(part)
                    part, size = [], 0
            keep += decide(part) if part else []
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
