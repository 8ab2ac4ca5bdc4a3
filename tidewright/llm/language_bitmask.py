"""Language ID with language-bitmask n-gram filters.

Letter trigrams (with word edges) are counted by language over all training texts; a trigram belongs to the languages where its
share is at least ``min_share`` and not under 1 / ``rivals`` of its share in any other language. So a language has at most
1 / min_share trigrams, however large the corpus, and the model's size is bounded. The filters are bit-sliced: row i of one
table holds bit i of every language's Bloom filter, so the AND of a trigram's k rows is the mask of all languages that contain
it. A text's hits are counted by language, corrected for the false positives that the language's fill lets expect, and the
largest count decides.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.words import STEP, chunks, keep_rows, mix
from tidewright.session import checkpointed

MIN_SHARE = 1e-5
RIVALS = 20
PROBES = 4
ROWS_A_GRAM = 12
UNKNOWN = "und"
HELD = 3_000_000  # counted trigrams that a task holds before it passes them on
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTER[0]


def grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of three code points in 63 bits, with 0 for whatever is no letter, and the text's index of each."""
    low = [(t or b"").decode("utf-8", "replace").lower() for t in texts]
    points = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points[~_letters()[points]] = 0
    middle = np.flatnonzero(points)
    codes = (points[middle - 1] << np.uint64(42)) | (points[middle] << np.uint64(21)) | points[middle + 1]
    return codes, np.searchsorted(np.cumsum([len(x) + 1 for x in low]), middle, "left")


def _count(batches):
    """(lang, gram, n) of a task's texts; each language's counts are merged before they are passed on."""

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)

    def out():
        for lang, parts in held.items():
            keys, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    held: dict[str, list] = {}
    for langs, texts in chunks(batches):
        for lang in set(langs):
            codes, _ = grams([t for t, x in zip(texts, langs) if x == lang])
            if len(codes):
                held.setdefault(lang, []).append(np.unique(codes, return_counts=True))
                if len(held[lang]) > 8:
                    held[lang] = [merged(held[lang])]
        if sum(len(k) for parts in held.values() for k, _ in parts) > HELD:
            yield from out()
            held = {}
    yield from out()


@dataclass
class LanguageFilters:
    """Bit-sliced Bloom filters: ``table[row, word]`` holds bit ``language`` of that row in each 64-language word."""

    languages: list[str]
    table: np.ndarray
    wrong: np.ndarray  # by language: share of absent trigrams that a filter reports

    @classmethod
    def build(cls, languages: list[str], members: list[tuple[str, int]]) -> LanguageFilters:
        most = max([1, *np.bincount([languages.index(x) for x, _ in members], minlength=1).tolist()]) if members else 1
        rows = 1 << int(most * ROWS_A_GRAM).bit_length()
        table = np.zeros((rows, len(languages) // 64 + 1), np.uint64)
        for i, lang in enumerate(languages):
            own = np.array([g for x, g in members if x == lang], np.int64).astype(np.uint64)
            for at in cls.rows(own, rows):
                table[at, i // 64] |= np.uint64(1) << np.uint64(i % 64)
        fill = [((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))]
        return cls(languages, table, np.array(fill) ** PROBES)

    @staticmethod
    def rows(codes: np.ndarray, rows: int):
        for j in range(PROBES):
            yield mix(codes + np.uint64((j + 1) * int(STEP) % (1 << 64))) >> np.uint64(65 - rows.bit_length())

    def scores(self, texts: list) -> tuple[list[str], np.ndarray]:
        """Predicted language and its corrected share of the text's trigrams; ``und`` and 0 where there is no letter."""
        codes, owner = grams(texts)
        masks = np.full((len(codes), self.table.shape[1]), np.iinfo(np.uint64).max, np.uint64)
        for at in self.rows(codes, len(self.table)):
            masks &= self.table[at]
        n = np.bincount(owner, minlength=len(texts)).astype(float)
        best, which = np.full(len(texts), -1.0), np.zeros(len(texts), int)
        for i in range(len(self.languages)):
            hit = ((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(bool)
            hits = np.bincount(owner[hit], minlength=len(texts))
            right = np.maximum(0, hits - n * self.wrong[i]) / (1 - self.wrong[i] + 1e-12)
            which[right > best] = i
            best = np.maximum(best, right)
        known = (n > 0) & bool(self.languages)
        return [self.languages[w] if k else UNKNOWN for w, k in zip(which, known)], np.where(known, np.minimum(1.0, best / np.maximum(n, 1)), 0.0)


def learning(docs: DataFrame) -> Column:
    """True for documents that may be learned from: crc32 of the id as text is no multiple of 5."""
    return F.crc32(docs["doc_id"].cast("string")) % 5 != 0


def learn(docs: DataFrame, min_share: float = MIN_SHARE, rivals: float = RIVALS) -> LanguageFilters:
    """Filters from the text and lang of all rows of ``docs`` that may be learned from; what reaches the driver is bounded."""
    rows = docs.filter(learning(docs) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counted = checkpointed(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    share = counted.join(counted.groupBy("lang").agg(F.sum("n").alias("total")), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    often = share.filter(F.col("share") >= min_share)
    top = often.groupBy("gram").agg(F.max("share").alias("top"))
    members = often.join(top, "gram").filter(F.col("share") * rivals >= F.col("top")).select("lang", "gram")
    languages = sorted(r[0] for r in counted.select("lang").distinct().collect())
    return LanguageFilters.build(languages, [(r[0], r[1]) for r in members.toLocalIterator()])


def languages(docs: DataFrame, model: LanguageFilters) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs`` (doc_id, text; other columns are ignored).

    A text that is null or has no letter is ``und`` with score 0, and so is any text if no language was learned. Equal counts
    go to the language that sorts first. A null doc_id is predicted like any other and counts as not held out. Repeated rows
    give repeated results; an empty table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for ids, texts in chunks(batches):
            names, score = model.value.scores(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names), pa.array(score)], ["doc_id", "lang_pred", "score"])

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(~learning(found), F.lit(False)).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, model: LanguageFilters, min_score: float) -> DataFrame:
    """The rows of ``docs`` whose language is known with ``min_score`` or more, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(model)

    def decide(texts: list) -> list[bool]:
        names, score = model.value.scores(texts)
        return [n != UNKNOWN and s >= min_score for n, s in zip(names, score)]

    return keep_rows(docs, decide)
