"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Each source gets a share of all words by weight, at most a number of passes over itself; what it cannot use is shared again by
weight. Over training time from 0 to 1 a source's weight moves in a line from its start to its end factor. The integral of that
schedule is the source's cumulative demand; its inverse gives the time at which the source's stream has reached a document, and
the documents are range-sorted by it. A source's stream is its documents in hash order. The words before a document are a
running sum inside a block of hash values plus the sums of the blocks before, so that a source with a third of all rows is
spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import checkpointed

WEIGHTS = (5, 2, 1)
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))  # schedule factor at the start and at the end, by weight
PASSES = 3
BLOCK_DOCS = 4096
MOST_SOURCES = 50_000  # broadcast up to so many sources, joined beyond
WORD = r"[^\x20\x09-\x0D]+"
OWN = ["__mix_source", "__mix_block"]


def _picked(values, rank: str) -> Column:
    """``values`` in turn by rank from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(rank) % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, ramps=RAMPS, passes: int = PASSES) -> DataFrame:
    """(source, docs, source_size, target, ramp_from, ramp_to) from rows of (source, size), one row a source; null is one."""
    total = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    own = total.withColumn("rank", rank).withColumn("weight", _picked(weights, "rank").cast("decimal(38,0)"))
    own = own.withColumns({"cap": F.col("source_size").cast("decimal(38,0)") * passes, "all": F.sum(F.col("source_size").cast("decimal(38,0)")).over(Window.partitionBy())})
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    own = own.withColumns({
        "left": F.col("all") - F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "share": F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)),
    })
    # The first source, by how soon it is used up, whose share of what is left it can serve; those before it are used up.
    serves = F.col("cap").cast("double") * F.col("share").cast("double") >= F.col("left").cast("double") * F.col("weight").cast("double")
    own = own.withColumn("level", F.min(F.when(serves, F.struct(F.col("cap") / F.col("weight"), "rank", "left", "share"))).over(Window.partitionBy()))
    before = F.struct(F.col("cap") / F.col("weight"), F.col("rank")) < F.struct(F.col("level.col1"), F.col("level.rank"))
    target = F.when(before, F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("level.left")).cast("double") / F.col("level.share").cast("double"))
    return own.select("source", "docs", "source_size", target.alias("target"), _picked([r[0] for r in ramps], "rank").alias("ramp_from"), _picked([r[1] for r in ramps], "rank").alias("ramp_to"))


def training_time(share: Column, start: Column, end: Column) -> Column:
    """Inverse of cumulative demand: when a ramp from ``start`` to ``end`` (mean 1) has used ``share`` of the target."""
    slope = end - start
    return F.when(slope == 0, share).otherwise((F.sqrt(F.greatest(start * start + 2 * slope * share, F.lit(0.0))) - start) / slope)


def curriculum_mix(docs: DataFrame, weights=WEIGHTS, ramps=RAMPS, passes: int = PASSES) -> DataFrame:
    """``docs`` with all its columns and size, source_size, target, taken and position (replacing such columns), by position.

    size counts the words of the text, 0 for null; taken is the words the mix takes, repeats counted, at most ``passes`` times
    size; position is the training time from 0 to 1 of the document's first use, null (and last) if nothing is taken. A null
    source is a source of its own. Documents stand in a source's stream by md5 of doc_id, equal ones by doc_id, null last, and
    size. Repeated rows are rows of their own. If no text has a word, all sizes and targets are 0. An empty table gives an
    empty result.
    """
    block_key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).withColumn("__mix_key", block_key)
    sizes = checkpointed(sized.select("source", "size", "__mix_key"))
    plan = checkpointed(source_targets(sizes, weights, ramps, passes))
    if plan.count() <= MOST_SOURCES:
        plan = F.broadcast(plan)
    plan = plan.withColumnRenamed("source", OWN[0]).withColumn("need", F.round("target").cast("long"))

    def placed(rows: DataFrame) -> DataFrame:
        """Rows with their source's figures and block; blocks follow the order of the key."""
        out = rows.drop("source_size", "target").join(plan, rows["source"].eqNullSafe(plan[OWN[0]]))
        blocks = F.ceil(F.col("docs") / BLOCK_DOCS).cast("long")
        return out.withColumn(OWN[1], F.shiftright(F.shiftright("__mix_key", 20) * blocks, 40))

    block = placed(sizes).groupBy(*OWN).agg(F.sum("size").alias("__mix_sum"))
    ahead = F.sum("__mix_sum").over(Window.partitionBy(OWN[0]).orderBy(OWN[1]).rowsBetween(Window.unboundedPreceding, -1))
    block = block.select(F.col(OWN[0]).alias("__b0"), F.col(OWN[1]).alias("__b1"), F.coalesce(ahead, F.lit(0)).alias("__mix_ahead"))
    rows = placed(sized)
    rows = rows.join(block, rows[OWN[0]].eqNullSafe(block["__b0"]) & (rows[OWN[1]] == block["__b1"]))
    inside = Window.partitionBy(*OWN).orderBy("__mix_key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__mix_at", F.col("__mix_ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    full = F.when(F.col("source_size") > 0, F.expr("need div source_size")).otherwise(F.lit(0))
    rows = rows.withColumn("__mix_full", full)
    rest = F.greatest(F.lit(0), F.least("size", F.col("need") - F.col("__mix_full") * F.col("source_size") - F.col("__mix_at")))
    rows = rows.withColumn("taken", (F.col("__mix_full") * F.col("size") + rest).cast("long"))
    time = training_time(F.col("__mix_at") / F.col("need"), F.col("ramp_from"), F.col("ramp_to"))
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, time))
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "position")]
    return rows.select(*keep, "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")
