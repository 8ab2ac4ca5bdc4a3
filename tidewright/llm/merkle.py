"""Merkle manifest of a dataset by sibling-shift self-joins.

Rows are leaves, numbered within their group by a range sort, so that a group with a third of all rows is numbered by many
tasks. Nodes are rows (tree, idx, digest). At every level the node of slot zero of a run computes the indices of its siblings,
idx + 1 to idx + width - 1 (XOR 1 where width is two), and an equijoin on (tree, idx) fetches their digests; the slot-zero row
then emits the parent, the hash of the run. All groups climb together, those that are down to one node wait. Their last nodes
form one more tree, whose top is the root of the dataset.

Proofs come from the top down: each run hands its members the digests left and right of them, followed by what its own node was
handed, so that a proof is built where it is hashed and never shuffled for a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import checkpointed

WIDTH = 16
PATH = "array<struct<l:string,r:string>>"


def field(value: Column) -> Column:
    """A value as it is hashed: its bytes behind their number, or a dash for none."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def numbered(rows: DataFrame, group: str | None, *order: str) -> DataFrame:
    """``rows`` with ``idx``, their place from 0 within the group, nulls first, and ``n``, the group's rows; a range sort, then counts by (group, range).

    With a group also ``tree``, the group's own place among the groups. Rows meet their counts by (group, range), so that none
    of these keys holds more rows than a range.
    """
    keys = [F.col(c).asc_nulls_first() for c in ([group] if group else []) + list(order)]
    placed = checkpointed(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    by, part = F.col(group) if group else F.lit(0), F.shiftright("__at", 33)
    starts = placed.groupBy(by.alias("__group"), part.alias("__part")).agg(F.min("__at").alias("__from"), F.count("*").alias("__n"))
    every = Window.partitionBy("__group")
    ahead = F.sum("__n").over(every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select("__group", "__part", (F.coalesce(ahead, F.lit(0)) - F.col("__from")).alias("__shift"), F.sum("__n").over(every).alias("n"))  # a group's ranges
    if group:
        starts = checkpointed(starts)
        trees = numbered(starts.select(F.col("__group").alias("__name")).distinct(), None, "__name").select(F.col("__name").alias("__tree"), F.col("idx").alias("tree"))
        starts = starts.join(trees, F.col("__group").eqNullSafe(F.col("__tree"))).drop("__tree")
    met = placed.join(starts, F.col("__group").eqNullSafe(by) & (F.col("__part") == part))
    return met.withColumn("idx", F.col("__at") + F.col("__shift")).drop("__at", "__group", "__part", "__shift")


def _runs(nodes: DataFrame, width: int) -> DataFrame:
    """Parents (tree, idx, n, digest, kids) of nodes (tree, idx, n, digest)."""
    zero = nodes.filter(F.col("idx") % width == 0).select("tree", "n", F.col("idx").alias("zero"))
    sibling = F.col("zero").bitwiseXOR(F.col("slot")) if width == 2 else F.col("zero") + F.col("slot")
    asked = zero.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).select("tree", "n", "zero", sibling.alias("idx"))
    met = asked.join(nodes.drop("n"), ["tree", "idx"])
    kids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"])  # at most ``width``
    parents = met.groupBy("tree", "zero", "n").agg(kids.alias("kids"))
    up = lambda c: F.floor(F.col(c) / width).cast("long")
    return parents.select("tree", up("zero").alias("idx"), F.ceil(F.col("n") / width).cast("long").alias("n"), F.sha2(F.array_join("kids", ""), 256).alias("digest"), "kids")


def climb(nodes: DataFrame, width: int = WIDTH) -> tuple[DataFrame, list[DataFrame]]:
    """The last node of each tree (tree, digest, level) and, level by level, the runs below; ``nodes`` are (tree, idx, n, digest)."""
    tops, levels = [], []
    while True:
        tops.append(nodes.filter("n = 1").select("tree", "digest", F.lit(len(levels)).alias("level")))
        more = nodes.filter("n > 1").select("tree", "idx", "n", "digest")
        if more.isEmpty():
            break
        nodes = checkpointed(_runs(more, width))
        levels.append(nodes)
    out = tops[0]
    for top in tops[1:]:
        out = out.union(top)
    return out, levels


def _step(slot: Column) -> Column:
    """What stands left and right of a slot among the kids of a run."""
    left = F.array_join(F.slice("kids", 1, slot), "")
    right = F.array_join(F.slice("kids", slot + 2, F.size("kids")), "")
    return F.array(F.struct(left.alias("l"), right.alias("r")))


def handed_down(levels: list[DataFrame], tops: DataFrame, width: int = WIDTH) -> DataFrame:
    """(tree, run, kids, path, top) for the lowest runs, with null kids for trees of one leaf; ``tops`` are (tree, level, path, top)."""
    own = lambda level: tops.filter(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("idx"), "path", "top")
    runs = None
    paths = own(len(levels))
    for level in range(len(levels) - 1, -1, -1):
        runs = levels[level].select("tree", "idx", "kids").join(paths, ["tree", "idx"])
        if level:
            below = runs.select("tree", "idx", "kids", "path", "top", F.posexplode("kids").alias("slot", "digest"))
            below = below.select("tree", (F.col("idx") * width + F.col("slot")).alias("idx"), F.concat(_step(F.col("slot")), "path").alias("path"), "top")
            paths = checkpointed(below.union(own(level)))
    single = own(0).select("tree", "idx", F.lit(None).cast("array<string>").alias("kids"), "path", "top")
    out = runs.select("tree", "idx", "kids", "path", "top").union(single) if levels else single
    return out.withColumnRenamed("idx", "run")


def proven(nodes: DataFrame, handed: DataFrame, width: int = WIDTH) -> DataFrame:
    """``nodes`` (tree, idx, ...) with their path and the top of their tree."""
    slot = (F.col("idx") % width).cast("int")
    met = nodes.withColumn("run", F.floor(F.col("idx") / width).cast("long")).join(handed, ["tree", "run"])
    return met.withColumn("path", F.when(F.col("kids").isNull(), F.col("path")).otherwise(F.concat(_step(slot), "path"))).drop("run", "kids")


def manifest(leaves: DataFrame, width: int = WIDTH) -> DataFrame:
    """The columns of ``leaves`` (doc_id, source, leaf, presented) with subroot, root, proof_sha256, folded_root and verified.

    ``leaf`` is the digest that the manifest records, ``presented`` the one that is checked against it. Leaves of a source ascend
    by doc_id, nulls first, rows that repeat a doc_id by leaf and presented digest; every ``width`` nodes in a row become the hash of their
    digests, until one is left, the subroot (a lone leaf is its own). Subroots by source, null first, give the root likewise. The
    proof holds the siblings from the leaf to the root, each level left to right; proof_sha256 is the hash of their
    concatenation, folded_root what the presented digest and the proof give. An empty table gives an empty result.
    """
    placed = checkpointed(numbered(leaves.select("doc_id", "source", "leaf", "presented"), "source", "doc_id", "leaf", "presented"))
    subroots, levels = climb(placed.select("tree", "idx", "n", F.col("leaf").alias("digest")), width)
    subroots = checkpointed(subroots)
    trees = subroots.count()
    whole = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(trees).cast("long").alias("n"), "digest", "level")
    top, over = climb(whole.drop("level"), width)
    path = F.array().cast(PATH).alias("path")
    own = proven(whole, handed_down(over, top.select("tree", "level", path, F.col("digest").alias("top")), width), width)
    own = checkpointed(own.select(F.col("idx").alias("tree"), "level", "path", F.col("digest").alias("top")))
    found = top.first()  # one row, none if there is no leaf
    root = F.lit(found["digest"] if found else None).cast("string")
    leaf = proven(placed, handed_down(levels, own, width), width)
    folded = F.aggregate("path", F.col("presented"), lambda d, s: F.sha2(F.concat(s["l"], d, s["r"]), 256))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), ""), 256)
    out = leaf.select("doc_id", "source", "leaf", "presented", F.col("top").alias("subroot"), root.alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered_manifest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for documents (doc_id, source, lang, n_chars, text).

    The manifest records every document; where 5 divides the crc32 of the decimal doc_id, what is checked against it has A-Z of
    the text lower-cased. Nulls in any column are leaves like others (a dash), a null doc_id is never tampered with; repeated
    rows are leaves of their own. Other columns are ignored.
    """
    text = F.col("text")
    name = F.col("doc_id").cast("string")
    changed = F.when(F.crc32(name.cast("binary")) % 5 == 0, F.translate(text, *LOWER)).otherwise(text)
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = leaf_digest(*rest, text)
    leaves = docs.select("doc_id", "source", leaf.alias("leaf"), leaf_digest(*rest, changed).alias("presented"))
    return manifest(checkpointed(leaves), width).drop("source", "presented")
