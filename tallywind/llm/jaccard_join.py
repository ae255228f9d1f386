"""Similarity join of documents on sets of five-word shingles by a MinHash LSH forest, verified exactly.

Texts with equal words are one node. A forest of ``TREES`` tries holds the nodes' MinHash signatures; a matched prefix is shortened, level
by level, until two sets of the least similarity asked for meet in some tree with probability ``RECALL`` (one in a million is missed
at the threshold, fewer above it). Nodes with a common prefix of that depth in a tree are candidates: a star of edges per bucket, not
its pairs. Candidates' components are cut into cells of at most two blocks of ``BLOCK`` nodes, by size of their sets (sets that differ in
size by more than the threshold allows never meet) and by hash; in each cell all pairs are compared exactly by products of incidence
matrices. A cell returns a row per node: its number of links there and the smallest node it is connected to. No pairs are emitted,
nothing is capped, and no group is held whole, however large.

Words are runs of bytes other than white space, A-Z lower-cased. A text of one to four words is one shingle; null and empty texts have
none and link to nothing, but are copies of each other. Repeated rows are copies. Results per row: ``class_id`` (smallest ``doc_id`` of
the texts connected by links, copies included), ``n_links`` (different texts at least that similar), ``copies`` (rows with these words).
Null ids count as larger than all others. An empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywind.session import stage

from .components import components
from .exact_dedup import row_identity, rows_of
from .flat import flat_bytes, mix, ngram_hashes, slices, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
TREES, DEEPEST, RECALL = 40, 8, 1 - 1e-6
BLOCK = 256


def depth_for(similarity: float, trees: int = TREES, recall: float = RECALL) -> int:
    """The longest prefix with which two sets of that similarity meet in a tree with the target recall."""
    depth = DEEPEST
    while depth > 1 and 1 - (1 - similarity ** depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_sets(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows and where each row's start; and the word hashes with the same."""
    hashes, _, _, before = word_hashes(data, starts)
    grams, _, offsets = ngram_hashes(hashes, before, SHINGLE)
    short = np.flatnonzero((np.diff(offsets) == 0) & (np.diff(before) > 0))
    row = np.concatenate([np.repeat(np.arange(len(starts) - 1), np.diff(offsets)), short])
    single = [mix(np.append(hashes[before[r]:before[r + 1]], np.uint64(before[r + 1] - before[r])).cumsum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[-1] for r in short]
    grams = np.concatenate([grams, np.array(single, np.uint64)])
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])]) if len(grams) else np.zeros(0, bool)
    grams, row = grams[new], row[new]
    return grams, np.searchsorted(row, np.arange(len(starts))), hashes, before


def forest_prefixes(grams: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """For each row with shingles, one hash per tree of its first ``depth`` minima; rows without any give zeros."""
    rows = np.flatnonzero(np.diff(starts))
    out = np.zeros((len(starts) - 1, TREES), np.uint64)
    if not len(rows):
        return out
    seeds = mix(np.arange(1, 2 * TREES * DEEPEST + 1, dtype=np.uint64))
    for tree in range(TREES):
        path = np.full(len(rows), tree, np.uint64)
        for level in range(depth):
            i = tree * DEEPEST + level
            h = grams * (seeds[2 * i] | np.uint64(1))
            h ^= h >> np.uint64(31)
            h *= seeds[2 * i + 1] | np.uint64(1)
            path = mix(path + np.minimum.reduceat(h, starts[rows]))
        out[rows, tree] = path
    return out


def _signatures(docs: DataFrame, row, depth: int) -> DataFrame:
    """``row, doc_id, words`` (digest of the words), ``size`` of the set, ``prefixes``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, limit=2 << 20):
            grams, starts, hashes, before = shingle_sets(*flat_bytes(batch.column("text")))
            prefixes = forest_prefixes(grams, starts, depth).view(np.int64)
            digest = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(before, before[1:])]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * TREES), pa.array(prefixes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(digest, pa.binary()), pa.array(np.diff(starts)), lists],
                                             names=["row", "doc_id", "words", "size", "prefixes"])

    named = docs.select(row.alias("row"), "doc_id", "text")
    row_type = named.schema["row"].dataType.simpleString()
    return named.mapInArrow(run, f"row {row_type}, doc_id {id_type}, words binary, size long, prefixes array<long>")


def _cells(members: DataFrame, similarity: float) -> DataFrame:
    """The cells (``cell``, ``side``) that each member (``node, root, size``) is compared in."""
    stratum = F.floor(F.log("size") / F.lit(-log(similarity) + 1e-9))
    sizes = members.groupBy("root").agg(F.count("*").alias("n"))
    small = members.join(sizes.filter(F.col("n") <= BLOCK).select("root"), "root").select("node", F.struct(
        "root", F.lit(-1).alias("s"), F.lit(0).alias("i"), F.lit(-1).alias("t"), F.lit(0).alias("j")).alias("cell"), F.lit(0).alias("side"))
    large = members.join(sizes.filter(F.col("n") > BLOCK).select("root"), "root").withColumn("s", stratum.cast("int"))
    blocks = large.groupBy("root", "s").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    above = blocks.select("root", (F.col("s") - 1).alias("s"), F.col("nb").alias("nb_above"))
    below = blocks.select("root", (F.col("s") + 1).alias("s"), F.col("nb").alias("nb_below"))
    plan = blocks.join(above, ["root", "s"], "left").join(below, ["root", "s"], "left")
    placed = large.join(plan, ["root", "s"]).withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda s, i, t, j, side: F.struct(F.struct("root", s.alias("s"), i.alias("i"), t.alias("t"), j.alias("j")).alias("cell"), side.cast("int").alias("side"))
    own = F.transform(upto(F.col("nb")), lambda o: cell(F.col("s"), F.least(F.col("b"), o), F.col("s"), F.greatest(F.col("b"), o), F.when(o < F.col("b"), 1).otherwise(0)))
    up = F.transform(upto(F.col("nb_above")), lambda o: cell(F.col("s"), F.col("b"), F.col("s") + 1, o, F.lit(0)))
    down = F.transform(upto(F.col("nb_below")), lambda o: cell(F.col("s") - 1, o, F.col("s"), F.col("b"), F.lit(1)))
    wide = placed.select("node", F.explode(F.concat(own, up, down)).alias("x")).select("node", "x.cell", "x.side")
    return small.unionByName(wide)


def compare(sets: list[np.ndarray], side: np.ndarray, whole: bool, similarity: float) -> np.ndarray:
    """Which pairs are similar: all pairs of a whole cell, else those across the two sides. A symmetric matrix."""
    n = len(sets)
    if n < 2:
        return np.zeros((n, n), bool)
    size = np.array([len(s) for s in sets], np.float64)
    row = np.repeat(np.arange(n), size.astype(np.int64))
    unit, where, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(often > 1) - 1  # a shingle of one set is in no intersection
    use = often[where] > 1
    column, row = rank[where[use]], row[use]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    columns = int(column[-1]) + 1 if len(column) else 0
    common, width = np.zeros((n, n), np.float64), min(8192, max(columns, 1))
    for low in range(0, columns, width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((n, width), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        common += part @ part.T
    near = common >= similarity * (size[:, None] + size[None, :] - common) - 1e-9
    near &= (common > 0) & ~np.eye(n, dtype=bool)
    return near if whole else near & (side[:, None] != side[None, :])


def _local_roots(near: np.ndarray, node: np.ndarray) -> np.ndarray:
    label = node.copy()
    while True:
        new = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(1))
        if (new == label).all():
            return label
        label = new


def _verify(shipped: DataFrame, similarity: float) -> DataFrame:
    """``node, links, root`` for every member of every cell."""
    def run(batches):
        held, key = [], None

        def close():
            node = np.array([h[0] for h in held], np.int64)
            near = compare([h[2] for h in held], np.array([h[1] for h in held]), key[1] == -1 or (key[1] == key[3] and key[2] == key[4]), similarity)
            return node, near.sum(1), _local_roots(near, node)

        out: list[list] = [[], [], []]
        for batch in batches:
            cells, node, side = batch.column("cell").to_pylist(), batch.column("node").to_pylist(), batch.column("side").to_pylist()
            sets = batch.column("grams")
            for i, c in enumerate(cells):
                now = (c["root"], c["s"], c["i"], c["t"], c["j"])
                if now != key and held:
                    for o, x in zip(out, close()):
                        o.extend(x.tolist())
                    held = []
                key = now
                if held and held[-1][0] == node[i]:
                    continue  # a repeated row brought its node twice
                held.append((node[i], side[i], np.frombuffer(sets[i].as_py(), np.uint64)))
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["node", "links", "root"])
                out = [[], [], []]
        if held:
            for o, x in zip(out, close()):
                o.extend(x.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["node", "links", "root"])

    count = int(shipped.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shipped.repartition(count, "cell").sortWithinPartitions("cell", "node").mapInArrow(run, "node long, links long, root long")


def _with_grams(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, grams`` for the rows of ``wanted`` (``row, node``)."""
    def run(batches):
        for batch in slices(batches):
            grams, starts, _, _ = shingle_sets(*flat_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([grams[a:b].tobytes() for a, b in zip(starts, starts[1:])], pa.binary())], names=["node", "grams"])

    return docs.join(wanted, "row").select("node", "text").mapInArrow(run, "node long, grams binary")


def _classes(numbered: DataFrame, row, similarity: float) -> DataFrame:
    """``row, doc_id, class_doc, class_row, n_links, copies`` for every row."""
    signed = stage(_signatures(numbered, row, depth_for(similarity)), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    nodes = stage(signed.groupBy("words").agg(F.min(first).alias("least"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("prefixes").alias("prefixes"))
                  .withColumn("node", F.monotonically_increasing_id()), "nodes")
    buckets = nodes.filter("size > 0").select("node", F.posexplode("prefixes").alias("tree", "prefix"))
    heads = buckets.groupBy("tree", "prefix").agg(F.min("node").alias("head"), F.max("node").alias("last")).filter("head < last").drop("last")
    candidates = buckets.join(heads, ["tree", "prefix"]).filter("node != head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    members = stage(components(candidates).join(nodes.select("node", "size", F.col("least.row").alias("row")), "node"), "members")
    grams = stage(_with_grams(numbered.select(row.alias("row"), "text"), members.select("row", "node")), "grams")
    checked = stage(_verify(_cells(members, similarity).join(grams, "node"), similarity), "checked")
    links = checked.groupBy("node").agg(F.sum("links").alias("n_links")).filter("n_links > 0")
    roots = components(checked.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = (nodes.select("words", "node", "least", "copies").join(links, "node", "left").join(roots, "node", "left")
             .select("words", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "node").alias("root"), "least"))
    known = stage(known, "known")
    least = known.groupBy("root").agg(F.min("least").alias("class"))
    return signed.select("row", "doc_id", "words").join(known.join(least, "root").select("words", "copies", "n_links", "class"), "words")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_links, copies``."""
    found = _classes(docs.select("doc_id", "text"), row_identity(), similarity)
    return found.select("doc_id", F.col("class.doc_id").alias("class_id"), "n_links", "copies")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their class (one of equal rows), with all their columns."""
    found = _classes(docs.select("doc_id", "text"), row_identity(), similarity)
    return rows_of(docs, stage(found.filter(F.col("row") == F.col("class.row")).select("row"), "staying"))
