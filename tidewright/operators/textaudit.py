"""Audits of report texts: banned phrases, numeric claims and their sources, sections, message tags, case scores.

Everything is native string and array functions over whole texts; a text is one row and rules are
columns, so no rule table is joined to the texts and nothing is shuffled until the counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import phrases as ph

UNICODE = "(?U)"


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, UNICODE + r"\s+", " "))


def match_spans(text: Column, pattern: str) -> Column:
    """Array of (start, stop) of every match, zero-based: lengths of the pieces between matches, summed."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pieces = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(pieces, 1, F.greatest(F.size(found), F.lit(0))), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("len")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        return F.struct((a + x["len"]).alias("at"), F.concat(acc["spans"], F.array(F.struct(a.alias("start"), (a + x["len"]).alias("stop")))).alias("spans"))

    return F.aggregate(steps, start, step)["spans"]


def excerpt(text: Column, start: Column, stop: Column, context: int) -> Column:
    left = F.greatest(start - context, F.lit(0))
    return _squeeze(F.substring(text, left + 1, F.least(F.length(text), stop + context) - left))


def _may_hold(text: Column, label: str) -> Column:
    """Whether a lower-cased text contains what every match of the rule does: a search for bytes, far cheaper than a regular expression."""
    return reduce(Column.__or__, [F.contains(text, F.lit(n)) for n in ph.NEEDLES[label]])


def banned_phrases(docs: DataFrame, key: str = "doc_id", text: str = "text", context: int = 30, labels: list[str] | None = None,
                   first: bool = False) -> DataFrame:
    """One row per banned phrase found: (key, kind, label, start, excerpt).

    A rule is tried on a text only if the text contains one of the rule's needles. ``labels`` picks rules; with ``first`` only
    the first place of each rule is returned.
    """
    wanted = [r for r in ph.RULES if labels is None or r[2] in labels]
    low = docs.select(key, text, F.lower(text).alias("low"))
    low = low.filter(reduce(Column.__or__, [_may_hold(F.col("low"), n) for _, _, n in wanted]))
    spans = lambda p, n: F.when(_may_hold(F.col("low"), n), match_spans(F.col("low"), UNICODE + p))
    rules = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("label"), spans(p, n).alias("spans")) for k, p, n in wanted])
    hits = low.select(key, text, F.explode(F.filter(rules, lambda r: F.size(r["spans"]) > 0)).alias("r"))
    each = hits.select(key, text, "r.kind", "r.label", F.explode(F.slice("r.spans", 1, 1) if first else F.col("r.spans")).alias("s"))
    return each.select(key, "kind", "label", F.col("s.start").alias("start"), excerpt(F.col(text), F.col("s.start"), F.col("s.stop"), context).alias("excerpt"))


def banned_phrase_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, label, hits) of the rules found: one search a rule, without places."""
    low = docs.select(key, F.lower(text).alias("low"))
    count = lambda p, n: F.when(_may_hold(F.col("low"), n), F.regexp_count("low", F.lit(UNICODE + p))).otherwise(0)
    rules = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("label"), count(p, n).cast("long").alias("hits")) for k, p, n in ph.RULES])
    found = low.select(key, F.explode(F.filter(rules, lambda r: r["hits"] > 0)).alias("r")).select(key, "r.*")
    return found.groupBy(key, "kind", "label").agg(F.sum("hits").alias("hits"))


def claims_text(text: Column) -> Column:
    """The text with dates, durations, identifiers, rules and list markers taken out."""
    out = text
    for pattern in (ph.ISO_DATE, ph.WRITTEN_DATE, ph.DURATION, ph.IDENTIFIER):
        out = F.regexp_replace(out, UNICODE + pattern, " ")
    out = F.regexp_replace(out, "(?d)" + ph.RULE_LINE, " ")
    return F.regexp_replace(out, "(?d)(?U)" + ph.LIST_MARKER, "$1")


def numeric_claims(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per number a text claims: (key, pos, token, value, decimals)."""
    tokens = F.regexp_extract_all(claims_text(F.col(text)), F.lit(f"({ph.NUMBER})"), F.lit(1))
    n = docs.select(key, F.posexplode(tokens).alias("pos", "token"))
    value = F.expr("try_cast(replace(token, ',', '') AS double)")
    return n.select(key, "pos", "token", value.alias("value"), F.length(F.regexp_extract("token", r"\.(\d*)$", 1)).alias("decimals")).filter("value IS NOT NULL")


def allowed_variants(facts: Column) -> Column:
    """Every way a fact may be printed: sign dropped, percent or fraction, in thousands to trillions, plus 0, 1, 2 and 100."""
    def variants(v: Column) -> Column:
        forms = [v, F.abs(v), v * 100, F.abs(v) * 100, v / 100]
        for scale in (1e3, 1e6, 1e9, 1e12):
            forms += [v / scale, F.abs(v) / scale]
        return F.array(*forms)
    return F.concat(F.array(*[F.lit(x) for x in (0.0, 1.0, 2.0, 100.0)]), F.flatten(F.transform(F.filter(facts, lambda v: v.isNotNull()), variants)))


def _traced(facts: Column, text: str) -> Column:
    """The claims of a text as an array of (pos, token, value, supported); the allowed values are built once a text."""
    tokens = F.regexp_extract_all(claims_text(F.col(text)), F.lit(f"({ph.NUMBER})"), F.lit(1))

    def claim(allowed: Column):
        def one(token: Column, pos: Column) -> Column:
            value = F.replace(token, F.lit(",")).try_cast("double")
            tolerance = 0.5 * F.pow(F.lit(10.0), -F.length(F.regexp_extract(token, r"\.(\d*)$", 1))) + 1e-9
            met = F.exists(allowed, lambda a: F.abs(value - a) <= tolerance)
            return F.struct(pos.alias("pos"), token.alias("token"), value.alias("value"), met.alias("supported"))

        return one

    found = F.flatten(F.transform(F.array(allowed_variants(facts)), lambda allowed: F.transform(tokens, claim(allowed))))
    return F.filter(found, lambda c: c["value"].isNotNull())


def trace_claims(docs: DataFrame, facts: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each claim with whether some allowed value rounds to it at its printed precision.

    Claims meet their text's facts (a bundle holds tens of them) inside the row; only the claims leave it, and nothing is joined.
    """
    return docs.select(key, F.explode(_traced(facts, text)).alias("c")).select(key, "c.*")


def trace_summary(docs: DataFrame, facts: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Claims and supported claims of each text that has any, counted inside the row and then by key."""
    c = docs.select(key, _traced(facts, text).alias("c")).filter(F.size("c") > 0)
    c = c.select(key, F.size("c").cast("long").alias("n"), F.size(F.filter("c", lambda x: x["supported"])).cast("long").alias("m"))
    return c.groupBy(key).agg(F.sum("n").alias("numbers_checked"), F.sum("m").alias("numbers_matched")).withColumn("passed", F.col("numbers_checked") == F.col("numbers_matched"))


def section_coverage(docs: DataFrame, sections: list[str], labels: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Missing sections, and how many required labels appear (none is an error, some a warning)."""
    up, low = F.upper(text), F.lower(text)
    missing = F.array_compact(F.array(*[F.when(~F.contains(up, F.lit(s.upper())), F.lit(s)) for s in sections]))
    present = sum((F.contains(low, F.lit(x.lower())).cast("int") for x in labels), F.lit(0))
    d = docs.select(key, F.array_join(missing, ";").alias("missing_sections"), present.alias("labels_present"))
    status = F.when(F.col("labels_present") == 0, "error").when(F.col("labels_present") < len(labels), "warning").otherwise("ok")
    return d.withColumn("label_status", status)


def first_marker(low: Column, markers: list[str]) -> Column:
    """Zero-based place of the earliest plain marker, NULL when there is none."""
    places = [F.when(F.instr(low, m) > 0, F.instr(low, m) - 1) for m in markers]
    return F.least(*places)


def first_pattern(low: Column, patterns: list[str]) -> Column:
    """Zero-based place of the earliest regular-expression match: the length of the text before it."""
    places = [F.when(low.rlike(UNICODE + p), F.length(F.split(low, UNICODE + p, 2)[0])) for p in patterns]
    return F.least(*places)


def direction(low: Column) -> Column:
    """Sign of the first direction word, after multi-word phrases are folded into one word."""
    out = low
    for pattern, word in ph.DIRECTION_PHRASES:
        out = F.regexp_replace(out, UNICODE + pattern, word)
    words = F.regexp_extract_all(out, F.lit(r"([a-z][a-z\-']*)"), F.lit(1))
    known = F.array(*[F.lit(w) for w in ph.DOWN + ph.UP])
    first = F.get(F.filter(words, lambda w: F.array_contains(known, w)), F.lit(0))
    return F.when(first.isNull(), "unspecified").when(F.array_contains(F.array(*[F.lit(w) for w in ph.DOWN]), first), "down").otherwise("up")


def tag_messages(messages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Kind of question (outlook, attribution, snapshot) and direction of each message."""
    low = messages.select(*keys, F.lower(text).alias("low"))
    d = low.select(*keys, first_pattern(F.col("low"), ph.OUTLOOK).alias("o"), first_marker(F.col("low"), ph.ATTRIBUTION).alias("a"),
                   first_marker(F.col("low"), ph.SNAPSHOT).alias("s"), direction(F.col("low")).alias("direction"))
    o, a, s = F.col("o"), F.col("a"), F.col("s")
    kind = (
        F.when(o.isNotNull() & (a.isNull() | (o < a)), "outlook").when(a.isNotNull() & (s.isNull() | (a <= s)), "attribution")
        .when(s.isNotNull(), "snapshot").when(F.col("direction") != "unspecified", "attribution").otherwise("snapshot")
    )
    return d.select(*keys, kind.alias("kind"), "direction")


def score_cases(cases: DataFrame) -> DataFrame:
    """Deterministic score of a case (claims, falsifiers, counter-answer, coverage), blended with a judge's share."""
    total = F.col("claims") + F.col("dropped_claims")
    evidence = F.when(total > 0, F.col("claims") / total * F.least(F.col("claims"), F.lit(3)) / 3).otherwise(0.0)
    falsifiers = F.least(F.col("falsifiers"), F.lit(2)) / 2
    counter = F.when(~F.col("challenged"), 0.5).when(F.col("concedes").isNull(), 0.0).when(F.col("concedes"), 0.25).otherwise(1.0)
    coverage = F.when(F.col("scenario_count") > 0, F.least(F.col("cited_scenarios"), F.lit(2)) / 2).otherwise(0.5)
    det = 0.35 * evidence + 0.15 * falsifiers + 0.25 * counter + 0.25 * coverage
    d = cases.withColumn("deterministic", det)
    return d.withColumn("total", F.when(F.col("judge").isNull(), F.col("deterministic")).otherwise(0.8 * F.col("deterministic") + 0.2 * F.col("judge")))


def rank_cases(scored: DataFrame, key: str, order: str, clear_margin: float = 0.12) -> DataFrame:
    """Rank per debate, mark the weakest for elimination, and say whether the leader is clear."""
    w = Window.partitionBy(key).orderBy(F.desc("total"), order)
    every = Window.partitionBy(key)
    d = scored.withColumn("rank", F.row_number().over(w)).withColumn("n", F.count("*").over(every))
    lead = F.when(F.col("rank") == 1, F.col("total") - F.lead("total").over(w))
    d = d.withColumn("margin", lead).withColumn("outcome", F.when(F.col("n") < 2, "fallback").when(F.max("margin").over(every) >= clear_margin, "clear").otherwise("several"))
    return d.withColumn("drop_next", (F.col("rank") == F.col("n")) & (F.col("n") > 2)).drop("n")
