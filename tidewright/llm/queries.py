"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.capture_index import captures, write_archive
from tidewright.llm.containment import contained_items
from tidewright.llm.curriculum import curriculum_mix
from tidewright.llm.hard_negatives import mine
from tidewright.llm.language_bitmask import languages, learn
from tidewright.llm.level_doubling import remove_repeats
from tidewright.llm.licence_digests import COPYRIGHT, HEAD, NO_NAMES, NO_WORD, SPELLINGS, known, licence_scan, register
from tidewright.llm.line_chunks import dedup_lines
from tidewright.llm.merkle import tampered_manifest
from tidewright.llm.multi_index import nearest
from tidewright.llm.ngram_jaccard import ngram_jaccard_join
from tidewright.llm.path_templates import judge_urls
from tidewright.llm.weak_pii import personal_spans
from tidewright.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(read)``, where ``read(table)`` gives a table of the input folder."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            settings(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def settings(spark: SparkSession) -> None:
    """UTC, and Arrow batches of few texts, as a text may be long."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")


@query("op5_ngram_jaccard", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower_text, '[^\x20\x09-\x0D]+') AS ws
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text FROM documents)
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.doc_id WHERE r.m < l.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.m AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id) r ON r.doc_id = d.doc_id""")
def op5(read):
    """Shingle count and component of near copies of every document."""
    return ngram_jaccard_join(read("documents"))


@query("op4_substring_dedup", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
m AS (SELECT g, min(doc_id) AS first_id FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM g JOIN m USING (g), (SELECT unnest(range(0, 13)) AS k) WHERE doc_id > first_id),
k AS (
  SELECT w.doc_id, count(*) AS n, sum(CAST(c.i IS NOT NULL AS INT)) AS r, coalesce(string_agg(CASE WHEN c.i IS NULL THEN word END, ' ' ORDER BY p.i), '') AS kept
  FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w) p JOIN w USING (doc_id) LEFT JOIN c ON c.doc_id = p.doc_id AND c.i = p.i GROUP BY 1
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id""")
def op4(read):
    """Words left in every document once windows of 13 words seen in smaller documents are removed."""
    return remove_repeats(read("documents"), window=13, texts=False)


SHINGLES = r"""
  SELECT DISTINCT id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+4], ' ') END AS g
  FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM (
    SELECT id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM {}
  ) WHERE len(ws) > 0)"""


@query("op9_benchmark_decontamination", f"""
WITH d AS ({SHINGLES.format("(SELECT doc_id AS id, text FROM documents)")}), q AS ({SHINGLES.format("(SELECT item_id AS id, text FROM benchmark)")}),
n AS (SELECT id, count(*) AS n FROM q GROUP BY id)
SELECT d.id AS doc_id, q.id AS item_id, count(*) AS n_shared, n.n AS n_item, count(*) / n.n AS containment
FROM q JOIN d ON d.g = q.g JOIN n ON n.id = q.id GROUP BY d.id, q.id, n.n HAVING count(*) * 100 >= n.n * 80""")
def op9(read):
    """Benchmark items that documents contain, with the share of their shingles."""
    return contained_items(read("documents"), read("benchmark"))


@query("op2_language_bitmask")
def op2(read):
    """Language of every document."""
    docs = read("documents")
    return languages(docs, learn(docs))


@query("op10_line_chunks", r"""
WITH l AS (SELECT doc_id, i, s[i] AS line, CAST('0x' || left(md5(s[i]), 8) AS BIGINT) AS h
  FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL))),
b AS (SELECT *, CAST((h + 31 * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 4 = 0 AS INT) AS ends FROM l),
p AS (SELECT *, sum(ends) OVER (PARTITION BY doc_id ORDER BY i) - ends AS part FROM b),
c AS (SELECT doc_id, part, min(i) AS start, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM p GROUP BY doc_id, part
  HAVING count(*) >= 2 AND bool_or(regexp_matches(line, '[^ \t\r]'))),
r AS (SELECT doc_id, part FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, start) AS k FROM c) WHERE k > 1)
SELECT d.doc_id, coalesce(count(p.i), 0) AS n_lines, coalesce(sum(CAST(r.part IS NOT NULL AS BIGINT)), 0)::BIGINT AS n_removed,
  CASE WHEN any_value(d.text) IS NULL THEN NULL ELSE sha256(coalesce(string_agg(CASE WHEN r.part IS NULL THEN line END, chr(10) ORDER BY p.i), '')) END AS kept_sha256
FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = p.doc_id AND r.part = p.part GROUP BY d.doc_id""")
def op10(read):
    """Lines of every document, and its text's digest once chunks of lines seen earlier are removed."""
    found = dedup_lines(read("documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


MIX_SQL = r"""
WITH z AS (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM {docs}),
t AS (SELECT source, sum(size) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM z GROUP BY source),
w AS (SELECT *, [5, 2, 1][k % 3 + 1] AS w, [1.5, 1.0, 0.5][k % 3 + 1]::DOUBLE AS r0, [0.5, 1.0, 1.5][k % 3 + 1]::DOUBLE AS r1, sum(s) OVER () AS total FROM t),
o AS (SELECT *, total - coalesce(sum(3 * s) OVER (ORDER BY 3 * s / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER (ORDER BY 3 * s / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share, row_number() OVER (ORDER BY 3 * s / w, k) AS n FROM w),
v AS (SELECT *, min(n) FILTER (3 * s * share >= rest * w) OVER () AS m FROM o),
g AS (SELECT v.*, CASE WHEN v.n < v.m THEN (3 * v.s)::DOUBLE ELSE (v.w * u.rest)::DOUBLE / u.share::DOUBLE END AS target FROM v, (SELECT rest, share FROM v WHERE n = m) u),
q AS (SELECT z.*, g.s::BIGINT AS source_size, target, r0, r1, round(target)::BIGINT AS need, coalesce(sum(size) OVER (PARTITION BY z.source ORDER BY md5(z.doc_id::VARCHAR)
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM z JOIN g ON z.source IS NOT DISTINCT FROM g.source),
y AS (SELECT *, CASE WHEN source_size > 0 THEN (need // source_size) * size + greatest(0, least(size, need - (need // source_size) * source_size - ahead)) ELSE 0 END::BIGINT AS taken FROM q)
SELECT {cols}, size, source_size, target, taken, round(CASE WHEN taken > 0 THEN CASE WHEN r1 = r0 THEN ahead / need
  ELSE (sqrt(greatest(r0 * r0 + 2 * (r1 - r0) * (ahead / need), 0)) - r0) / (r1 - r0) END END, 9) AS position FROM y"""


@query("op8_curriculum_mix", MIX_SQL.format(docs="documents", cols="doc_id"))
def op8(read):
    """Words that the mix takes of every document, and when."""
    found = curriculum_mix(read("documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


@query("op6_multi_index")
def op6(read):
    """Twenty nearest vectors found for each query vector."""
    return nearest(read("embeddings"))


@query("op7_path_templates")
def op7(read):
    """Verdict on every page's url, by rule or by path template."""
    return judge_urls(read("pages"))


def _canonical_sql(text: str) -> str:
    """Canonical form in SQL, of the same constants."""
    out = f"replace({text}, chr(13), '')"
    for name in NO_NAMES:
        out = f"replace({out}, 'Copyright {name}', 'copyright {name}')"
    out = f"lower(regexp_replace({out}, '{COPYRIGHT}', '', 'g'))"
    for before, after in SPELLINGS:
        out = f"replace({out}, '{before}', '{after}')"
    return f"regexp_replace({out}, '{NO_WORD}', ' ', 'g')"


@query("op3_licence_digests", f"""
WITH b AS (SELECT id, trim(regexp_replace({_canonical_sql("text")}, '[ \\n]+', ' ', 'g')) AS body FROM (VALUES {", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in known())}) v(id, text)),
k AS (SELECT md5(body) AS digest, min(id) AS license_id, min(string_split(body, ' ')[:{HEAD}]) AS head, min(len(string_split(body, ' '))) AS n FROM b WHERE body <> '' GROUP BY 1),
c AS (SELECT doc_id, row_number() OVER () AS row, {_canonical_sql("text")} AS canon FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, row, i AS line, trim(s[i]) AS body FROM (SELECT doc_id, row, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, row, string_split(canon, chr(10)) AS s FROM c))),
n AS (SELECT doc_id, row, line, len(string_split(body, ' ')) AS n, sum(len(string_split(body, ' '))) OVER (PARTITION BY row ORDER BY line) AS stop FROM l WHERE body <> ''),
w AS (SELECT row, string_split(trim(regexp_replace(canon, '[ \\n]+', ' ', 'g')), ' ') AS words FROM c),
t AS (SELECT DISTINCT n.doc_id, n.row, n.line, n.n, stop - n.n AS start, k.n AS size, len(words) AS whole, words[stop - n.n + 1 : stop - n.n + k.n] AS part FROM n JOIN w USING (row) JOIN (SELECT DISTINCT head, n FROM k) k ON words[stop - n.n + 1 : stop - n.n + {HEAD}] = k.head),
f AS (SELECT t.*, md5(array_to_string(part, ' ')) AS digest FROM t JOIN n e ON e.row = t.row AND e.stop = t.start + t.size)
SELECT doc_id, o AS line, license_id, digest FROM (SELECT doc_id, 0::BIGINT AS o, digest FROM f WHERE size = whole UNION ALL SELECT doc_id, line, digest FROM f WHERE size = n OR size < whole) JOIN k USING (digest)""")
def op3(read):
    """Texts, lines and runs of lines that are a known licence."""
    docs = read("documents")
    return licence_scan(docs, register(docs.sparkSession))


@query("op1_weak_pii")
def op1(read):
    """Personal data in every document."""
    return personal_spans(read("documents"))


@query("op11_capture_index", r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS size, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS least FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5))::BIGINT >> CAST(15 - i % 4 * 5 AS INT)) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
FROM d""")
def op11(read):
    """Records of all pages, read back from archives through their capture index."""
    pages = read("pages")
    folder = f"{shared_folder(pages.sparkSession)}/captures-{uuid.uuid4().hex}"
    write_archive(pages, folder, min_bytes=0)
    found = captures(pages.sparkSession, folder, pages.select("url"), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op12_merkle_manifest", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)] AS fields,
    CASE WHEN doc_id IS NULL THEN false ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295) % 5 = 0 END AS tampered FROM documents
), f AS (
  SELECT *, list_append(fields, text) AS kept, list_append(fields, CASE WHEN tampered THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END) AS shown FROM d
), h AS (
  SELECT doc_id, source, sha256(array_to_string(list_transform(kept, lambda v: coalesce(octet_length(encode(v)) || ':' || v, '-')), '')) AS leaf,
    sha256(array_to_string(list_transform(shown, lambda v: coalesce(octet_length(encode(v)) || ':' || v, '-')), '')) AS presented FROM f
), l AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM h
), b(tree, lvl, i, n, d) AS (
  SELECT tree, 0, i, n, leaf FROM l
  UNION ALL SELECT tree, lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY i)) FROM b WHERE n > 1 GROUP BY tree, lvl, i // 16, n
), t(lvl, i, n, d) AS (
  SELECT 0, tree, (SELECT count(*) FROM b WHERE n = 1), d FROM b WHERE n = 1
  UNION ALL SELECT lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lvl, i // 16, n
), bs AS (
  SELECT tree, lvl, i, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS x, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS y
  FROM b WHERE n > 1 WINDOW w AS (PARTITION BY tree, lvl, i // 16 ORDER BY i)
), ts AS (
  SELECT lvl, i, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS x, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS y
  FROM t WHERE n > 1 WINDOW w AS (PARTITION BY lvl, i // 16 ORDER BY i)
), steps AS (
  SELECT l.tree, l.i, bs.lvl AS step, x, y FROM l JOIN bs ON bs.tree = l.tree AND bs.i = CAST(floor(l.i / pow(16, bs.lvl)) AS BIGINT)
  UNION ALL SELECT l.tree, l.i, 1000 + ts.lvl, x, y FROM l JOIN ts ON ts.i = CAST(floor(l.tree / pow(16, ts.lvl)) AS BIGINT)
), path AS (SELECT tree, i, list(x ORDER BY step) AS xs, list(y ORDER BY step) AS ys FROM steps GROUP BY tree, i),
g(tree, i, k, d, xs, ys) AS (
  SELECT l.tree, l.i, 0, presented, coalesce(xs, []), coalesce(ys, []) FROM l LEFT JOIN path USING (tree, i)
  UNION ALL SELECT tree, i, k + 1, sha256(xs[k + 1] || d || ys[k + 1]), xs, ys FROM g WHERE k < len(xs)
)
SELECT l.doc_id, leaf, b.d AS subroot, t.d AS root, sha256(array_to_string(list_transform(range(1, len(g.xs) + 1), lambda k: g.xs[k] || g.ys[k]), '')) AS proof_sha256,
  g.d AS folded_root, g.d = t.d AS verified
FROM l JOIN b ON b.tree = l.tree AND b.n = 1 JOIN g ON g.tree = l.tree AND g.i = l.i AND g.k = len(g.xs), t WHERE t.n = 1""")
def op12(read):
    """Leaf, roots and proof of every document, and what folding a tampered copy gives."""
    return tampered_manifest(read("documents"))


@query("op13_hard_negatives", r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""")
def op13(read):
    """Hard negatives of every anchor, below each of its positives; every seventh label is off by one."""
    vectors = read("embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", moved))
