"""N-gram Jaccard join: the document by shingle incidence matrix times its transpose, in blocks, behind size-derived bounds.

Two sets of n and m shingles with a Jaccard similarity of t or more share at least t * max(n, m) of them. Hence
1. a document of which fewer than t * n shingles occur in any other document has no link: packed shingles are shuffled in
   blocks of the hash range and answered with counts (``blocks``), once over all documents and once over what is left;
2. of the shingles ordered by frequency, the first n - ceil(t * n) + 1 must hold one that the partner has too: only these
   columns of the matrix propose pairs. For a given pair the overlap that it needs follows from both sizes, and with it how
   early the column must stand in either row: pairs that share no column so early are discarded unseen;
3. overlaps of what is left are accumulated by a blocked product of the incidence matrix with its transpose, and held against
   the exact bound of each pair.

Equal sets are one node (their smallest document). Pairs inside one component need no test, so that first each node is tested
with the most central node of its columns, the one with the fewest shingles of its own: a group of thousands of near copies costs
about a pair for each. Columns that then still hold nodes of several components connect the nodes into groups, outside which
there is no link. A group's rows of the matrix lie in blocks of about SIDE entries, apart by size class and by whether they are of
the group's largest component; a task multiplies two blocks whose sizes allow links, at least one of them outside that component,
and returns a forest of the links it found. Groups smaller than a block share one. So pairs just under the bound, of which a group
may have as many as the square of its size, are sums in a task's matrix and never rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.blocks import ask, block_count, shared
from tidewright.llm.graph import components
from tidewright.llm.merkle import numbered
from tidewright.llm.words import chunks, shingle_sets
from tidewright.session import checkpointed

SIDE = 1 << 19  # shingles of a block of documents, about; a product reads two blocks
CELLS = 1 << 22  # sums of a product that are held at once, about


def _profile(width: int, sets: bool):
    """Of each text: set size, digest of the set and, if asked for, the set."""

    def run(batches):
        for ids, texts in chunks(batches):
            keys, owner, n = shingle_sets(texts, width)
            ends = np.cumsum(n)
            cols = [pa.array(ids, pa.int64()), pa.array(n)]
            packed = [keys[e - k : e].tobytes() for e, k in zip(ends, n)]
            cols.append(pa.array([xxhash.xxh3_128_digest(p) if p else None for p in packed], pa.binary()))
            if sets:
                cols.append(pa.array(packed, pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "digest", "keys"][: len(cols)])

    return run


def _keyed_texts(width: int):
    def run(batches):
        for ids, texts in chunks(batches):
            keys, owner, _ = shingle_sets(texts, width)
            yield np.array(ids, np.int64)[owner], keys, None

    return run


def _keyed_sets(batches):
    for batch in batches:
        keys = [np.frombuffer(k, np.uint64) for k in batch.column("keys").to_pylist()]
        yield np.repeat(batch.column("node").to_numpy(), list(map(len, keys))), np.concatenate(keys), None


def _postings(batches):
    for batch in batches:
        for node, n, keys in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "keys"))):
            k = np.frombuffer(keys, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), node)), pa.array(np.full(len(k), n))], ["key", "node", "n"])


def _overlaps(batches):
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("a", "b", "a_keys", "b_keys")]
        common = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(*cols[2:])]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("a_n"), batch.column("b_n"), pa.array(common, pa.int64())], ["a", "b", "a_n", "b_n", "common"])


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose similarity reaches the bound."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("keys").alias(f"{side}_keys")), side)
    found = pairs.mapInArrow(_overlaps, "a long, b long, a_n long, b_n long, common long")
    return found.filter(F.col("common") * (100 + percent) >= percent * (F.col("a_n") + F.col("b_n"))).select("a", "b")


def _need(n: str, m: str, percent: int) -> str:
    """SQL for the overlap that sets of ``n`` and ``m`` shingles need."""
    return f"(({n} + {m}) * {percent} + {99 + percent}) div {100 + percent}"


def _products(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components of (node, n, label, group) rows, from products of two blocks each."""
    kinds = nodes.groupBy("group", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    stat = kinds.groupBy("group").agg(F.max(F.struct("c", "label"))["label"].alias("top"), F.sum("s").alias("total"))
    nodes = checkpointed(nodes.join(stat, "group"))
    small, large = nodes.filter(F.col("total") <= SIDE), nodes.filter(F.col("total") > SIDE)
    shares = -(-(small.agg(F.sum("n")).first()[0] or 0) // SIDE)
    packed = small.select("node", "label", F.concat(F.lit("-"), F.pmod(F.xxhash64("group"), F.lit(max(1, shares))).cast("string")).alias("product"), F.lit(0).alias("side"))
    # sizes that may link are at most one class apart: a class is a little wider than the bound
    size_class = F.floor(F.log("n") / F.log(F.lit(100.0001 / percent))).cast("int")
    large = large.withColumn("class", size_class).withColumn("out", (F.col("label") != F.col("top")).cast("int")).withColumn("cell", F.concat_ws(":", "group", "class", "out"))
    large = numbered(large.select("node", "label", "group", "class", "out", "cell"), "cell", "node")
    room = F.greatest(F.lit(1), F.floor(F.lit(SIDE) / F.pow(F.lit(100.0001 / percent), F.col("class") + 1)))
    large = checkpointed(large.select("node", "label", "group", "class", "out", F.floor(F.col("idx") / room).cast("long").alias("block")))
    blocks = large.select("group", F.struct("class", "out", "block").alias("at")).distinct()
    x, y = blocks.alias("x"), blocks.alias("y")
    pairs = x.join(y, F.expr("x.group = y.group and x.at <= y.at and y.at.class - x.at.class <= 1 and x.at.out + y.at.out > 0"))
    name = F.concat_ws(":", "x.group", "x.at.class", "x.at.out", "x.at.block", "y.at.class", "y.at.out", "y.at.block")
    pairs = pairs.select(name.alias("product"), F.col("x.group").alias("group"), F.col("x.at").alias("x"), F.col("y.at").alias("y"))
    sides = F.explode(F.when(F.col("x") == F.col("y"), F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("at")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("at")), F.struct(F.lit(1).alias("side"), F.col("y").alias("at")))))
    pairs = pairs.select("product", "group", sides.alias("s")).select("product", "group", "s.side", "s.at.*")
    dealt_out = packed.union(large.join(pairs, ["group", "class", "out", "block"]).select("node", "label", "product", "side"))
    rows = dealt_out.join(sets.select("node", "n", "keys"), "node")
    return rows.groupBy("product").applyInArrow(lambda table: _forest(table, percent), "a long, b long")


def _forest(table: pa.Table, percent: int) -> pa.Table:
    """Multiply the rows of side 0 with those of side 1, or with themselves where there are none; links that join two labels."""
    node, n, label, side = (table.column(c).to_numpy() for c in ("node", "n", "label", "side"))
    keys = np.concatenate([np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()])
    row = np.repeat(np.arange(len(node)), n)
    key, df = np.unique(keys, return_inverse=True, return_counts=True)[1:]
    often = df >= max(64, len(node) // 32)  # columns that are cheaper as dense ones
    dense = np.zeros((len(node), int(often.sum())), np.float32)
    at = np.cumsum(often) - 1
    full = often[key]
    dense[row[full], at[key[full]]] = 1
    rest = ~full & (df[key] > 1)
    row, key = row[rest], key[rest]
    order = np.argsort(key, kind="stable")
    holders, start = row[order], np.searchsorted(key[order], np.arange(len(df) + 1))
    begin = np.searchsorted(row, np.arange(len(node) + 1))
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    links, step = [], max(1, CELLS // max(1, len(node)))
    for lo in range(0, len(left), step):
        some = left[lo : lo + step]
        own = np.concatenate([key[begin[i] : begin[i + 1]] for i in some])
        local = np.repeat(np.arange(len(some)), begin[some + 1] - begin[some])
        counts = start[own + 1] - start[own]
        ends = np.cumsum(counts)
        where = np.repeat(start[own] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)
        sums = np.bincount(np.repeat(local, counts) * len(node) + holders[where], minlength=len(some) * len(node)).reshape(len(some), len(node))[:, right]
        sums = sums + (dense[some] @ dense[right].T).astype(np.int64)
        i, j = np.nonzero((sums * (100 + percent) >= percent * (n[some][:, None] + n[right][None])) & (label[some][:, None] != label[right][None]))
        i, j = some[i], right[j]
        _, first = np.unique(np.stack([label[i], label[j]]), axis=1, return_index=True)
        for k in first:
            u, v = root(int(label[i[k]])), root(int(label[j[k]]))
            if u != v:
                parent[u] = v
                links.append((int(node[i[k]]), int(node[j[k]])))
    return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])


def ngram_jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Words are runs of non-blank bytes with A-Z lower-cased. A text shorter than ``width`` words is one shingle; a null, empty
    or blank text has none and no link. Rows with a null doc_id link with nothing and get a null component. Rows that repeat a
    doc_id are rows of their own that carry the same node. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    profile = checkpointed(docs.mapInArrow(_profile(width, False), "doc_id long, n long, digest binary"))
    classes = profile.filter("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"))
    known = docs.filter("doc_id is not null")
    blocks = block_count(known)
    reach = lambda df, keyed, n: shared(ask(df, keyed, n), n).select(F.col("doc_id").alias("node"), F.col("n").alias("hits"))
    enough = F.col("hits") * 100 >= F.col("n") * percent
    left = classes.join(reach(known, _keyed_texts(width), blocks), "node").filter(enough).select("node", "digest")
    own = known.join(left.withColumnRenamed("digest", "want").hint("shuffle_hash"), known.doc_id == F.col("node"))
    sets = own.select("doc_id", "text", "want").mapInArrow(_wanted(width), "node long, n long, digest binary, keys binary")
    sets = checkpointed(sets.dropDuplicates(["digest"]))
    sets = checkpointed(sets.join(reach(sets.select("node", "keys"), _keyed_sets, max(8, blocks // 4)), "node").filter(enough).drop("hits"))

    posting = sets.select("node", "n", "keys").mapInArrow(_postings, "key long, node long, n long")
    often = posting.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = posting.join(often, "key").withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("df", "key")))
    ranked = ranked.withColumn("common", F.count("*").over(Window.partitionBy("node")))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.col("common"))
    columns = ranked.filter(F.col("rank") <= prefix).withColumn("rare", F.col("n") - F.col("common")).select("key", "node", "n", (F.col("rank") + F.col("rare")).alias("rank"), "rare")
    size = columns.groupBy("key").agg(F.count("*").alias("m"), F.min("n").alias("low"), F.min(F.struct("rare", "node")).alias("lead")).filter("m > 1")
    columns = checkpointed(columns.join(size, "key"))
    best = columns.filter("node <> lead.node").groupBy("node").agg(F.min("lead").alias("lead"))
    pairs = best.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()
    links = checkpointed(_links(pairs, sets, percent))
    found = components(links)
    label = columns.join(found, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    label = label.filter(f"rank <= n - {_need('n', f'greatest(low, n * {percent} div 100)', percent)} + 1")
    mixed = label.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min("node").alias("hub")).filter("least <> most")
    label = checkpointed(label.join(mixed, "key").select("node", "n", "label", "hub"))
    group = components(label, "node", "hub").withColumnRenamed("component", "group")
    nodes = label.select("node", "n", "label").distinct().join(group, "node", "left").withColumn("group", F.coalesce("group", "node"))  # roots are not listed
    more = checkpointed(_products(nodes, sets, percent))
    if not more.isEmpty():
        found = components(links.union(more))
    final = classes.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = profile.join(final, "digest", "left")
    own_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own_id.alias("component_id"))


def _wanted(width: int):
    """The set of each text, where its digest is the one that is asked for."""
    profile = _profile(width, True)

    def run(batches):
        for ids, texts, want in chunks(batches):
            batch = next(profile([pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "text"])]))
            keep = pa.array([d == w for d, w in zip(batch.column("digest").to_pylist(), want)])
            yield batch.filter(keep).rename_columns(["node", "n", "digest", "keys"])

    return run
