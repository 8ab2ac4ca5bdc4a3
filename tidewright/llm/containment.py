"""Benchmark decontamination: size-partitioned MinHash containment search, verified on the shingles themselves.

An item with n shingles is contained in a document when the document has at least percent / 100 of them. So of the item's
n - ceil(n * percent / 100) + 1 smallest shingle hashes the document must have one: this bottom-k MinHash sketch misses
nothing, however long the document. Items are partitioned by size (powers of two) and k follows from a partition's largest
size. Documents are scanned, never shuffled: their shingles are looked up in the sketches and the candidates' shingles are
counted byte by byte. Items come in blocks of bounded size, each broadcast for one scan; a large benchmark takes more scans.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.words import chunks, keep_rows, shingle_sets, shingles, spoken

BLOCK_BYTES = 2 << 20  # of item text in a block
BITS = 20


class Sketches:
    """Bottom-k sketches of a block of items, looked up by hash, and the items' shingles."""

    def __init__(self, ids: list, texts: list, width: int, percent: int):
        self.ids, self.width, self.percent = ids, width, percent
        keys, _, sizes = shingle_sets(texts, width)
        hashes, owners = [], []
        for i, (end, n) in enumerate(zip(np.cumsum(sizes).tolist(), sizes.tolist())):
            if n:
                largest = (1 << n.bit_length()) - 1  # of the item's size partition
                k = largest - -(-largest * percent // 100) + 1
                hashes.append(keys[end - n : end][:k])
                owners.append(np.full(min(n, k), i))
        hashes, owners = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.uint64), (owners, np.int64)))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners = hashes[order], owners[order]
        self.some = np.zeros(1 << BITS, bool)
        self.some[self.hashes >> np.uint64(64 - BITS)] = True
        self.sets = spoken(texts, width)

    def candidates(self, texts: list) -> list[tuple[int, int]]:
        """(text, item) by index where the text has a hash of the item's sketch."""
        keys, owner = shingles(texts, self.width)
        may = self.some[keys >> np.uint64(64 - BITS)]
        keys, owner = keys[may], owner[may]
        lo, hi = np.searchsorted(self.hashes, keys, "left"), np.searchsorted(self.hashes, keys, "right")
        hit = hi > lo
        return sorted({(int(o), int(i)) for o, a, b in zip(owner[hit], lo[hit], hi[hit]) for i in self.owners[a:b]})

    def search(self, texts: list) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) by index for all items that a text contains."""
        out, at, own = [], -1, set()
        for t, i in self.candidates(texts):
            if t != at:
                at, own = t, spoken([texts[t]], self.width)[0]
            common = len(self.sets[i] & own)
            if common * 100 >= len(self.sets[i]) * self.percent:
                out.append((t, i, common))
        return out


def _blocks(items: DataFrame, width: int, percent: int):
    """A broadcast of each block of items; a block's text is about BLOCK_BYTES, or one item."""
    spark = items.sparkSession
    items = items.filter("item_id is not null and text is not null").select("item_id", "text")
    size = items.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()  # bounded by BLOCK_BYTES
        yield spark.sparkContext.broadcast(Sketches([r[0] for r in rows], [r[1].encode() for r in rows], width, percent))


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for each document and benchmark item that it contains.

    Shingles are of lower-cased words; a text with fewer than ``width`` words is one shingle, its whole sequence, so a very
    short item is found only as a whole text. Null, empty or blank texts and items, and items without an id, match nothing.
    A row with a null doc_id is searched and reported with null. Repeated rows are reported for each row. Empty tables give
    an empty result; other columns are ignored.
    """

    def scan(index):
        def run(batches):
            for ids, texts in chunks(batches):
                found = index.value.search(texts)
                sets = index.value.sets
                rows = [(ids[t], index.value.ids[i], c, len(sets[i]), c / len(sets[i])) for t, i, c in found]
                if rows:
                    types = [pa.int64()] * 4 + [pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "item_id", "n_shared", "n_item", "containment"])

        return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, n_shared long, n_item long, containment double")

    return reduce(DataFrame.union, [scan(index) for index in _blocks(items, width, percent)])


def decontaminated(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    for index in _blocks(items, width, percent):
        docs = keep_rows(docs, lambda texts, index=index: _free(index.value, texts))
    return docs


def _free(index: Sketches, texts: list) -> list[bool]:
    held = {t for t, _, _ in index.search(texts)}
    return [i not in held for i in range(len(texts))]
