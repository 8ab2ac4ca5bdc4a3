"""Personal data by weak supervision: labelers vote on candidate spans, and their agreement trains the span classifier.

Candidates are the base patterns' matches, those of them that fail their check, and looser spellings. Five labelers vote on each:
its pattern, its checksum or range, a gazetteer, the words before it and its edges. Votes are summed by pattern of votes over
all documents, a table of bounded size; expectation-maximisation on it estimates each labeler's reliability by kind and the
chance that a pattern is personal data. A logistic regression on votes and length is trained towards these chances and decides
on the candidates that are not base matches; base matches stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.words import chunks
from tidewright.session import checkpointed

KINDS = ("email", "ip", "card", "phone")
VOTERS, LENGTHS = 5, 8
NO, NONE, YES = 0, 1, 2
ACCEPT = 0.9
STEPS = 60

# Base patterns. Lookbehind (a match starts with a run of digits) and possessive repeats only save tries that cannot match.
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,63}){1,6}"),
    "phone": re.compile(r"[0-9]{3}(?:\) ?|[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])"),
}
GAZETTEER = {
    "email": frozenset("com org net edu gov info io de fr es uk eu it nl ch at".split()),
    "phone": ("1", "20", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91"),
    "card": ("34", "37", "4", "51", "52", "53", "54", "55", "60", "62", "65"),
    "ip": ("0.", "127.", "255."),
}
CONTEXT = {
    "email": re.compile(r"mail|contact|write to|correo|schreib|courriel", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|adres|dirección|client", re.I),
    "card": re.compile(r"card|visa|credit|karte|carte|tarjeta|\bpan\b", re.I),
    "phone": re.compile(r"phone|call|\btel|fax|mobile|appel|llam|ruf", re.I),
}
AGAINST = re.compile(r"version|isbn|\bid\b|order|invoice|serial|commit|\bv$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from their @."""
    end, at = 0, text.find("@")
    while at >= 0:
        if domain := DOMAIN.match(text, at + 1):
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                yield start, end
        at = text.find("@", at + 1)


def base_matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(kind, start, end, passes) of every match of a base pattern."""
    for start, end in emails(text):
        yield 0, start, end, True
    for m in IP.finditer(text):
        yield 1, *m.span(), all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        yield 2, *m.span(), 16 <= len(digits) <= 19 and luhn(digits)
    for m in PHONE.finditer(text):
        yield 3, *m.span(), 8 <= sum(c.isdigit() for c in m[0]) <= 15


def loose_matches(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of spellings beyond the base patterns: name (at) host, and local phone numbers."""
    if "(at)" in text or "[at]" in text:
        for m in LOOSE["email"].finditer(text):
            yield 0, *m.span()
    for m in LOOSE["phone"].finditer(text):
        start = m.start()
        if text[start + 3] == ")":
            if text[start - 1 : start] != "(":
                continue
            start -= 1
        if text[max(0, start - 1) : start] not in tuple("0123456789+.-"):
            yield 3, start, m.end()


def _vote(kind: int, span: str, before: str, after: str, base: int) -> int:
    """The votes on a span and its length, as one number."""
    name = KINDS[kind]
    digits = re.sub(r"[^0-9]", "", span)
    if name == "email":
        last = re.split(r"[.\])\s]", span.rstrip(". "))[-1].lower()
        check, known = YES if last.isalpha() else NO, YES if last in GAZETTEER[name] else NONE
    elif name == "ip":
        check, known = YES if base == YES else NO, NO if span.startswith(GAZETTEER[name]) else NONE
    elif name == "card":
        check, known = YES if luhn(digits) and len(digits) >= 13 else NO, YES if digits.startswith(GAZETTEER[name]) else NO
    else:
        check, known = YES if 8 <= len(digits) <= 15 else NO, YES if span[0] == "+" and digits.startswith(GAZETTEER[name]) else NONE
    context = YES if CONTEXT[name].search(before) else NO if AGAINST.search(before) else NONE
    edges = NO if before[-1:].isalnum() or after[:1].isalnum() else YES
    code = 0
    for v in (base, check, known, context, edges):
        code = code * 3 + v
    return (kind * 3**VOTERS + code) * LENGTHS + min(LENGTHS - 1, len(span) // 5)


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]], list[int]]:
    """Base spans, other candidates with their votes, and the votes on all candidates."""
    base, more, codes = [], [], []
    starts: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    for kind, start, end, passes in base_matches(text):
        if passes:
            base.append((kind, start, end))
            starts[kind].append((start, end))
        if passes or end - start >= 7:
            code = _vote(kind, text[start:end], text[max(0, start - 40) : start], text[end : end + 1], YES if passes else NO)
            codes.append(code)
            if not passes and kind == 2 and 13 <= sum(c.isdigit() for c in text[start:end]) <= 15:
                more.append((kind, start, end, code))
    for kind, start, end in loose_matches(text):
        own = starts[kind]
        last = bisect_left(own, (end,)) - 1  # base spans are in order and apart
        if last < 0 or own[last][1] <= start:
            code = _vote(kind, text[start:end], text[max(0, start - 40) : start], text[end : end + 1], NONE)
            codes.append(code)
            more.append((kind, start, end, code))
    return base, more, codes


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


SCAN = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, more array<array<long>>, codes array<long>"


def _scan(batches):
    for ids, texts in chunks(batches):
        rows = []
        for doc, raw in zip(ids, texts):
            base, more, codes = candidates(raw.decode("utf-8", "replace")) if raw else ([], [], [])
            text = _joined(base)
            n = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
            rows.append((doc, *n, hashlib.sha256(text.encode()).hexdigest(), text, more, codes))
        types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64())]
        names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "more", "codes"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


class SpanClassifier:
    """Chance by pattern of votes that a span is personal data."""

    def __init__(self, counts: dict[int, int]):
        codes = np.array(sorted(counts), np.int64)
        weight = np.array([counts[c] for c in codes.tolist()], float)
        self.chance: dict[int, float] = {}
        for kind in range(len(KINDS)):
            own = codes // LENGTHS // 3**VOTERS == kind
            if own.any():
                votes, lengths = self.parts(codes[own])
                soft = self.agreed(votes, weight[own])
                for code, p in zip(codes[own].tolist(), self.fitted(votes, lengths, soft, weight[own])):
                    self.chance[code] = float(p)

    @staticmethod
    def parts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        votes = codes // LENGTHS % 3**VOTERS
        return np.stack([votes // 3 ** (VOTERS - 1 - j) % 3 for j in range(VOTERS)], 1), codes % LENGTHS

    @staticmethod
    def agreed(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Posterior of each pattern by expectation-maximisation over the labelers' reliabilities."""
        score = (votes == YES).sum(1) - (votes == NO).sum(1)
        chance = 1 / (1 + np.exp(-score.astype(float)))
        for _ in range(STEPS):
            prior = np.clip((weight * chance).sum() / weight.sum(), 0.01, 0.99)
            log = np.full(len(votes), np.log(prior / (1 - prior)))
            for j in range(votes.shape[1]):
                yes = np.array([(weight * chance)[votes[:, j] == v].sum() for v in range(3)]) + 1
                no = np.array([(weight * (1 - chance))[votes[:, j] == v].sum() for v in range(3)]) + 1
                log += np.log(yes / yes.sum())[votes[:, j]] - np.log(no / no.sum())[votes[:, j]]
            chance = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        return chance

    @staticmethod
    def fitted(votes: np.ndarray, lengths: np.ndarray, soft: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Logistic regression towards the posteriors, by Newton's method with a ridge."""
        x = np.concatenate([np.ones((len(votes), 1)), *[(votes[:, [j]] == v).astype(float) for j in range(VOTERS) for v in (NO, YES)], lengths[:, None] / LENGTHS], 1)
        w = np.zeros(x.shape[1])
        scale = weight / weight.sum() * min(weight.sum(), 1e4)
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (scale * (soft - p)) - 0.1 * w
            hess = (x * (scale * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
            w = w + np.linalg.solve(hess, grad)
        return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def personal_spans(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of ``docs`` (doc_id, text).

    The counts and the digest are of the base spans; spans adds those that the classifier accepts, by kind and start. Positions
    are code points. A null or empty text has none. Repeated rows and null doc_ids are rows like others; an empty table gives
    an empty result; other columns are ignored.
    """
    scanned = checkpointed(docs.select("doc_id", "text").mapInArrow(_scan, SCAN))
    counts = scanned.select(F.explode("codes").alias("code")).groupBy("code").count()  # at most 4 * 3**5 * 8 rows
    model = SpanClassifier({r[0]: r[1] for r in counts.collect()})
    chance = docs.sparkSession.sparkContext.broadcast(model.chance)

    def extend(batches):
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            for i, more in enumerate(batch.column("more").to_pylist()):
                taken = [(k, s, e) for k, s, e, code in more if chance.value.get(code, 0.0) >= accept]
                if taken:
                    base = [(KINDS.index(k), int(s), int(e)) for k, s, e in (x.split(":") for x in spans[i].split(",") if x)]
                    spans[i] = _joined(base + taken)
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(spans, pa.string())], [*names, "spans"])

    return scanned.mapInArrow(extend, SCAN.partition(", more")[0])
