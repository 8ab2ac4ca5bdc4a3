"""Line dedup by content-defined chunks, in DataFrame functions only.

A document's lines are cut into chunks where a rolling hash over the hashes of the last two lines meets a fixed remainder, so a
passage is cut alike wherever it stands, from its third line on (``mixed`` has a better rule of two lines, and chunks of two
lines at least). Chunks of several lines that occur more than once are candidates by
digest; the candidates' bytes are then compared by grouping and joining on the text itself, and all but the first occurrence
(smallest doc_id, then line) are removed. Only digests of chunks are shuffled for the search, texts for the candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.session import checkpointed

EVERY = 4  # a line ends a chunk with a chance of one in so many
ROLL = 31
MIXED_EVERY = 2  # with ``mixed``: ends that follow an end do not count, so one line in four ends a chunk
SPANS = "__chunk_spans"
KEY = "__chunk_text"
ID = "__chunk_doc"


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _ends(lines: DataFrame, mixed: bool) -> DataFrame:
    """``lines`` with the line numbers, from 1, at which chunks end.

    With ``mixed``, a line is marked by high bits of a hash of it and the line before, and ends a chunk unless the line before
    is marked too, the first line is it or only one line would follow: chunks have two lines or more, by content alone, and a
    run of equal lines is cut at its edges only.
    """
    if mixed:
        marked = lines.withColumn("h", F.expr(f"transform(lines, (x, i) -> i > 0 and shiftrightunsigned(xxhash64(if(i > 0, lines[i - 1], ''), x), 32) % {MIXED_EVERY} = 0)"))
        return marked.withColumn("ends", F.expr("filter(sequence(1, size(lines)), i -> i = size(lines) or (i > 1 and i < size(lines) - 1 and h[i - 1] and not h[i - 2]))"))
    hashed = lines.withColumn("h", F.expr("transform(lines, x -> cast(conv(left(md5(x), 8), 16, 10) as bigint))"))
    return hashed.withColumn("ends", F.expr(f"filter(sequence(1, size(lines)), i -> i = size(lines) or (h[i - 1] + {ROLL} * if(i > 1, h[i - 2], 0L)) % {EVERY} = 0)"))


def _chunks(docs: DataFrame, min_lines: int, mixed: bool = False) -> DataFrame:
    """(ID, KEY, start, n, digest) of each chunk of ``min_lines`` lines or more that holds more than blanks."""
    lines = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").alias(ID), F.xxhash64("text").alias(KEY), _lines("text").alias("lines"))
    cuts = _ends(lines, mixed).withColumn("cuts", F.expr("transform(ends, (e, k) -> named_struct('start', if(k = 0, 0, ends[k - 1]), 'n', e - if(k = 0, 0, ends[k - 1])))"))
    long = cuts.withColumn("cuts", F.expr(f"filter(cuts, c -> c.n >= {min_lines})"))
    told = long.select(ID, KEY, F.expr("transform(cuts, c -> named_struct('start', c.start, 'n', c.n, 'digest', if(exists(slice(lines, c.start + 1, c.n), x -> x rlike '[^ \\\\t\\\\r]'), md5(array_join(slice(lines, c.start + 1, c.n), '\\n')), null)))").alias("c"))
    # inline_outer: for inline the optimizer adds a filter that splits the text again for each element.
    return told.select(ID, KEY, F.inline_outer("c")).filter("digest is not null")


def _spans(rows: DataFrame, *fields: str) -> DataFrame:
    return rows.groupBy(ID, KEY).agg(F.collect_list(F.struct(*fields)).alias(SPANS))


def _with_spans(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """Documents with their spans, found by id and text."""
    return docs.join(spans.hint("shuffle_hash"), (docs["doc_id"] == spans[ID]) & (F.xxhash64(docs["text"]) == spans[KEY]), how)


def repeated_chunks(docs: DataFrame, min_lines: int = 2, mixed: bool = False) -> DataFrame:
    """(ID, KEY, start, n) of every chunk, equal byte for byte, whose first occurrence is elsewhere; start counts from 0."""
    chunk = checkpointed(_chunks(docs, min_lines, mixed))
    # Checkpointed sums are dealt out anew for the joins, which can then split a digest that a third of all rows have.
    twice = checkpointed(chunk.groupBy("digest").agg(F.count("*").alias("c")).filter("c > 1").select("digest"))
    candidates = _spans(chunk.join(twice, "digest"), "start", "n", "digest")
    held = _with_spans(docs.select("doc_id", "text"), candidates, "inner").select(ID, KEY, _lines("text").alias("lines"), SPANS)
    bytes_ = held.select(ID, KEY, F.expr(f"transform({SPANS}, c -> named_struct('start', c.start, 'n', c.n, 'digest', c.digest, 'body', array_join(slice(lines, c.start + 1, c.n), '\\n')))").alias("c"), F.size("lines"))
    bytes_ = checkpointed(bytes_.select(ID, KEY, F.inline_outer("c")))
    first = checkpointed(bytes_.groupBy("digest", "body").agg(F.min(F.struct(F.col(ID), F.col("start"))).alias("first")))
    later = bytes_.join(first, ["digest", "body"]).filter((F.col(ID) != F.col(f"first.{ID}")) | (F.col("start") != F.col("first.start")))
    return later.select(ID, KEY, "start", "n").distinct()


def dedup_lines(docs: DataFrame, min_lines: int = 2, mixed: bool = False) -> DataFrame:
    """``docs`` with all its columns, the text without repeated chunks, and n_lines and n_removed (replacing such columns).

    A line ends at LF. A null text stays null and has no lines; an empty text has one, empty. Rows with a null doc_id stay as
    they are and are not compared. Rows that repeat a doc_id count as one document: an occurrence is its doc_id and line, so
    equal rows keep the same chunks. An empty table gives an empty result. ``mixed`` cuts by the rule of ``_ends`` that finds
    more; op10_line_chunks and the pipeline are held to the other one by their SQL and test.
    """
    found = _with_spans(docs, _spans(repeated_chunks(docs, min_lines, mixed), "start", "n"), "left")
    cut = found.withColumn(KEY, F.when(F.col(SPANS).isNotNull(), F.flatten(F.expr(f"transform({SPANS}, s -> sequence(s.start, s.start + s.n - 1))"))))
    lines = cut.withColumn(ID, F.when(F.col(SPANS).isNotNull(), _lines("text")))
    kept = F.expr(f"array_join(transform(array_except(sequence(0, size({ID}) - 1), {KEY}), i -> {ID}[i]), '\\n')")
    told = lines.withColumns({
        "n_lines": F.coalesce(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long"),
        "n_removed": F.when(F.col(SPANS).isNotNull(), F.size(KEY)).otherwise(0).cast("long"),
        SPANS: F.when(F.col(SPANS).isNotNull(), kept).otherwise(F.col("text")),
    })
    return told.withColumn("text", F.col(SPANS)).drop(SPANS, KEY, ID)
