"""Text audit queries over whole texts. Reports and questions are the tables' texts with a few words replaced."""

from functools import reduce

from pyspark.sql import functions as F

from tidewright.catalog.registry import longs, query, rounded
from tidewright.functions import phrases as ph
from tidewright.operators import textaudit as ta
from tidewright.tables import Tables

SWAPS = [(" with ", " because of "), (" by ", " driven by "), (" this ", " is a buy "), (" from ", " will rise from "), (" que ", " definitely ")]
ASKS = [(" with ", " why "), (" for ", " outlook "), (" by ", " fell "), (" this ", " tell me about "), (" from ", " rally "), (" that ", " sold  off ")]


def swap_sql(col: str, swaps) -> str:
    return reduce(lambda acc, s: f"replace({acc}, '{s[0]}', '{s[1]}')", swaps, col)


def swapped(c, swaps):
    return reduce(lambda acc, s: F.replace(acc, F.lit(s[0]), F.lit(s[1])), swaps, c)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def reports(t: Tables):
    return t.raw("documents").select("doc_id", swapped(F.col("text"), SWAPS).alias("text"))


_RULES = "rules(kind, pattern, label) AS (VALUES " + ", ".join(f"({quoted(k)}, {quoted(p)}, {quoted(n)})" for k, p, n in ph.RULES) + ")"
_REPORTS = f"reports AS (SELECT doc_id, {swap_sql('text', SWAPS)} AS text FROM documents)"
_CASES = "CASE " + " ".join(f"WHEN label = {quoted(n)} THEN regexp_extract_all(low, {quoted(p)})" for _, p, n in ph.RULES) + " END"


@query("txt1_banned_phrase_counts", f"WITH {_REPORTS}, {_RULES}, x AS (SELECT doc_id, kind, label, len({_CASES}) AS hits FROM (SELECT doc_id, lower(text) AS low FROM reports), rules) SELECT doc_id, kind, label, hits FROM x WHERE hits > 0")
def _(t: Tables):
    return ta.banned_phrase_counts(reports(t))


@query("txt1_banned_phrase_excerpts", f"""WITH {_REPORTS}, a AS (SELECT doc_id, text, lower(text) AS low FROM reports), b AS (SELECT doc_id, text, length(regexp_extract(low, '(?s)^(.*?)\\bdriven by\\b', 1)) AS start FROM a WHERE regexp_matches(low, '\\bdriven by\\b'))
SELECT doc_id, CAST(start AS BIGINT) AS start, trim(regexp_replace(substring(text, greatest(start - 30, 0) + 1, least(length(text), start + 39) - greatest(start - 30, 0)), '\\s+', ' ', 'g')) AS excerpt FROM b""")
def _(t: Tables):
    """First place of one phrase per report, with its surroundings."""
    hits = ta.banned_phrases(reports(t), labels=["driven by"], first=True)
    first = hits.groupBy("doc_id").agg(F.min_by(F.struct("start", "excerpt"), "start").alias("r"))
    return longs(first.select("doc_id", "r.*"))


_IDENT = r"\b\w*[A-Za-z_]\w*\d\w*\b|\b\w*\d\w*[A-Za-z_]\w*\b"
_CLEAN = "text"
for _p, _r in ((ph.ISO_DATE, " "), (ph.WRITTEN_DATE, " "), (ph.DURATION, " "), (_IDENT, " "), (ph.RULE_LINE, " "), (ph.LIST_MARKER, r"\1")):
    _CLEAN = f"regexp_replace({_CLEAN}, {quoted(_p)}, {quoted(_r)}, 'g')"
_TOKENS = f"tk AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS token FROM (SELECT doc_id, regexp_extract_all({_CLEAN}, {quoted(ph.NUMBER)}) AS l FROM documents))"
_NUMS = f"{_TOKENS}, nm AS (SELECT *, try_cast(replace(token, ',', '') AS DOUBLE) AS value, length(split_part(token, '.', 2)) AS decimals FROM tk)"


@query("txt2_numeric_claims", f"WITH {_NUMS} SELECT doc_id, CAST(pos AS BIGINT) AS pos, token, value, CAST(decimals AS BIGINT) AS decimals FROM nm WHERE value IS NOT NULL")
def _(t: Tables):
    return longs(ta.numeric_claims(t.raw("documents").select("doc_id", "text")))


_TRACE = f"""{_NUMS}, fc AS (SELECT d.doc_id, [CAST(n_chars AS DOUBLE), CAST(quality AS DOUBLE), CAST(toxic AS DOUBLE), CAST(d.doc_id AS DOUBLE) / 7] AS facts FROM documents d LEFT JOIN labels USING (doc_id)),
al AS (SELECT doc_id, list_concat([0::DOUBLE, 1, 2, 100], flatten([[v, abs(v), v * 100, abs(v) * 100, v / 100, v / 1e3, abs(v) / 1e3, v / 1e6, abs(v) / 1e6, v / 1e9, abs(v) / 1e9, v / 1e12, abs(v) / 1e12] for v in facts if v IS NOT NULL])) AS allowed FROM fc),
tr AS (SELECT nm.*, len(list_filter(allowed, lambda a: abs(value - a) <= 0.5 * power(10.0::DOUBLE, -decimals) + 1e-9)) > 0 AS supported FROM nm JOIN al USING (doc_id) WHERE value IS NOT NULL)"""


def claims(t: Tables):
    d = t.raw("documents").join(t.raw("labels"), "doc_id", "left")
    return d, F.array(*[F.col(c).cast("double") for c in ("n_chars", "quality", "toxic")], F.col("doc_id") / 7)


@query("txt3_unsupported_claims", f"WITH {_TRACE} SELECT doc_id, CAST(pos AS BIGINT) AS pos, token FROM tr WHERE NOT supported")
def _(t: Tables):
    return longs(ta.trace_claims(*claims(t)).filter("NOT supported").select("doc_id", "pos", "token"))


@query("txt3_trace_summary", f"WITH {_TRACE} SELECT doc_id, count(*) AS numbers_checked, count(*) FILTER (supported) AS numbers_matched, count(*) = count(*) FILTER (supported) AS passed FROM tr GROUP BY 1")
def _(t: Tables):
    return ta.trace_summary(*claims(t))


_SECT = ["License", "Version", "the reason"]
_LABS = ["warranties", "token", "of the", "and"]


@query("txt4_section_coverage", "SELECT doc_id, concat_ws(';', " + ", ".join(f"CASE WHEN NOT contains(upper(text), '{s.upper()}') THEN '{s}' END" for s in _SECT) + ") AS missing_sections, "
       + " + ".join(f"CAST(contains(lower(text), '{x}') AS BIGINT)" for x in _LABS) + " AS labels_present, CASE " + " + ".join(f"CAST(contains(lower(text), '{x}') AS INT)" for x in _LABS)
       + " WHEN 0 THEN 'error' WHEN 4 THEN 'ok' ELSE 'warning' END AS label_status FROM documents")
def _(t: Tables):
    return longs(ta.section_coverage(t.raw("documents"), _SECT, _LABS))


_ASK = f"asks AS (SELECT conv_id, turn, lower({swap_sql('text', ASKS)}) AS low FROM conversations)"


def _first(markers):
    return "least(" + ", ".join(f"CASE WHEN strpos(low, {quoted(m)}) > 0 THEN strpos(low, {quoted(m)}) - 1 END" for m in markers) + ")"


def _first_re(patterns):
    return "least(" + ", ".join(f"CASE WHEN regexp_matches(low, {quoted(p)}) THEN length(regexp_extract(low, {quoted('(?s)^(.*?)(?:' + p + ')')}, 1)) END" for p in patterns) + ")"


_FOLD = "low"
for _p, _w in ph.DIRECTION_PHRASES:
    _FOLD = f"regexp_replace({_FOLD}, {quoted(_p)}, '{_w}', 'g')"
_DN = "[" + ", ".join(quoted(w) for w in ph.DOWN) + "]"
_ALLW = "[" + ", ".join(quoted(w) for w in ph.DOWN + ph.UP) + "]"


@query("txt5_message_tags", f"""WITH {_ASK}, p AS (SELECT conv_id, turn, {_first_re(ph.OUTLOOK)} AS o, {_first(ph.ATTRIBUTION)} AS a, {_first(ph.SNAPSHOT)} AS s, list_filter(regexp_extract_all({_FOLD}, '[a-z][a-z\\-'']*'), lambda w: list_contains({_ALLW}, w))[1] AS w FROM asks),
d AS (SELECT *, CASE WHEN w IS NULL THEN 'unspecified' WHEN list_contains({_DN}, w) THEN 'down' ELSE 'up' END AS direction FROM p)
SELECT conv_id, turn, CASE WHEN o IS NOT NULL AND (a IS NULL OR o < a) THEN 'outlook' WHEN a IS NOT NULL AND (s IS NULL OR a <= s) THEN 'attribution' WHEN s IS NOT NULL THEN 'snapshot' WHEN direction <> 'unspecified' THEN 'attribution' ELSE 'snapshot' END AS kind, direction FROM d""")
def _(t: Tables):
    asks = t.raw("conversations").select("conv_id", "turn", swapped(F.col("text"), ASKS).alias("text"))
    return ta.tag_messages(asks, ["conv_id", "turn"])


_CASE_SQL = """cs AS (SELECT conv_id, turn, length(text) % 5 AS claims, length(text) % 3 AS dropped, turn % 4 AS falsifiers, length(text) % 2 = 0 AS challenged, CASE WHEN turn % 3 = 0 THEN NULL ELSE turn % 3 = 1 END AS concedes, turn % 3 AS cited, 3 AS sc, CASE WHEN conv_id % 2 = 0 THEN (length(text) % 10) / 10::DOUBLE END AS judge FROM conversations),
ds AS (SELECT *, 0.35::DOUBLE * CASE WHEN claims + dropped > 0 THEN claims / (claims + dropped) * least(claims, 3) / 3 ELSE 0 END + 0.15::DOUBLE * least(falsifiers, 2) / 2 + 0.25::DOUBLE * CASE WHEN NOT challenged THEN 0.5 WHEN concedes IS NULL THEN 0 WHEN concedes THEN 0.25 ELSE 1 END + 0.25::DOUBLE * least(cited, 2) / 2 AS det FROM cs),
tt AS (SELECT *, round(CASE WHEN judge IS NULL THEN det ELSE 0.8 * det + 0.2 * judge END, 9) AS total FROM ds), rk AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY total DESC, turn) AS rank, count(*) OVER (PARTITION BY conv_id) AS n FROM tt),
mg AS (SELECT *, CASE WHEN rank = 1 THEN total - lead(total) OVER (PARTITION BY conv_id ORDER BY rank) END AS margin FROM rk)"""


@query("txt6_case_scores", f"WITH {_CASE_SQL} SELECT conv_id, turn, round(total, 6) AS total, rank, CASE WHEN n < 2 THEN 'fallback' WHEN max(round(margin, 9)) OVER (PARTITION BY conv_id) >= 0.12 THEN 'clear' ELSE 'several' END AS outcome, rank = n AND n > 2 AS drop_next FROM mg")
def _(t: Tables):
    n = F.length("text")
    c = t.raw("conversations").select(
        "conv_id", "turn", (n % 5).alias("claims"), (n % 3).alias("dropped_claims"), (F.col("turn") % 4).alias("falsifiers"), (n % 2 == 0).alias("challenged"),
        F.when(F.col("turn") % 3 != 0, F.col("turn") % 3 == 1).alias("concedes"), (F.col("turn") % 3).alias("cited_scenarios"), F.lit(3).alias("scenario_count"),
        F.when(F.col("conv_id") % 2 == 0, (n % 10) / 10.0).alias("judge"))
    s = ta.score_cases(c).withColumn("total", F.round("total", 9))
    r = ta.rank_cases(s, "conv_id", "turn").select("conv_id", "turn", "total", "rank", "outcome", "drop_next")
    return longs(rounded(r))
