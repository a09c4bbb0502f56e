"""N-gram Jaccard join by MinHash banding.

The n-gram set of each text gives a signature of minima; bands of it are hashed, and the band hashes are what is shuffled.
Band and row counts follow from the threshold and the recall wanted at the threshold itself. Texts with equal sets are one
node from then on. Nodes that share a band are tied to the smallest of the band, and the connected candidates are verified
on their full sets, block against block: a block holds a bounded number of n-grams, so that no task grows with a group, and
yields for each node its count of links and one tie, never the pairs themselves.

A document without words has no n-grams, no links and is a class of its own. Fewer words than an n-gram are one n-gram.
Null ids are kept and linked like others; a class is named by its smallest id. Further columns are not read, so that none
can clash. Candidates are tied by a 64-bit hash of a set, and verified on the sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, small, stored
from .pytext import mixed, shingle_set, tidied

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 256
#: N-grams and nodes that a block holds on average; a task verifies two blocks at a time.
BLOCK_GRAMS, BLOCK_NODES = 200_000, 256


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the longest bands, which let the fewest false candidates through, whose number for the recall keeps within `most` hashes."""
    best = None
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - p)) if p < 1 else 1
        if bands * rows > most:
            break
        best = bands, rows
    if not best:
        raise ValueError("the recall needs more hashes than allowed")
    return best


def _batches(size: int, bands: int, rows: int):
    rng = np.random.default_rng(20)
    a, b = (rng.integers(1, 2**63, bands * rows, dtype=np.uint64) for _ in range(2))
    a |= np.uint64(1)
    marks = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys, sizes = [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), size)
                sizes.append(len(s))
                if not len(s):
                    nodes.append(None)
                    keys.append(None)
                    continue
                low = np.full(bands * rows, 2**64 - 1, np.uint64)
                for at in range(0, len(s), 2048):
                    np.minimum(low, (s[at : at + 2048, None] * a + b).min(axis=0), out=low)
                low, key = mixed(low).reshape(bands, rows), marks
                for r in range(rows):
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + low[:, r])
                nodes.append(xxhash.xxh64_intdigest(s.tobytes()))
                keys.append(key.view(np.int64))
            nodes = pa.array([None if x is None else x - 2**64 if x >= 2**63 else x for x in nodes], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("same"), nodes, pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc", "same", "node", "grams", "bands"])

    return tidied(sign)


def _sets(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x.as_py(), size) for x in batch.column("text")]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["node", "set"])

    return tidied(sets)


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The matrix of the sizes of all intersections of two sets."""
    n = len(sets)
    if n <= 4:
        out = np.zeros((n, n))
        for i in range(n):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            out[i, i] = len(sets[i])
        return out
    gram = np.concatenate(sets)
    of = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(gram, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, of = column[shared], of[shared]
    rank = np.cumsum(times > 1) - 1
    column = rank[column]
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    out, width = np.zeros((n, n), np.float32), 4096
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for k, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = np.zeros((n, width), np.float32)
        part[of[low:high], column[low:high] - k * width] = 1
        out += part @ part.T
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out


def link_matrix(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    common, n = common_counts(sets).astype(np.float64), np.array([len(s) for s in sets], np.float64)
    links = common >= threshold * (n[:, None] + n[None, :] - common) - 1e-9
    np.fill_diagonal(links, False)
    return links


def _roots(links: np.ndarray, names: np.ndarray) -> np.ndarray:
    root = names.copy()
    while True:
        near = np.where(links, root[None, :], np.iinfo(np.int64).max).min(axis=1)
        step = np.minimum(root, near)
        if (step == root).all():
            return root
        root = step


def _verify(threshold: float):
    """From rows sorted by (comp, x, y), block pair by block pair: node, tie (a node it is linked to by links of these blocks, the smallest), links, many."""

    def pair(key: tuple, rows: list) -> tuple:
        nodes = np.array([r[0] for r in rows], np.int64)
        copies = np.array([r[1] for r in rows], np.float64)
        block = np.array([r[2] for r in rows])
        links = link_matrix([r[3] for r in rows], threshold)
        if key[1] != key[2]:  # links within a block are those of (x, x), also if no node fell into the other
            links &= block[:, None] != block[None, :]
        return nodes, _roots(links, nodes), (links @ copies).astype(np.int64)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*done, strict=True)], names=["node", "tie", "links"])

        key, held, done, n = None, [], [], 0
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("comp", "x", "y")), strict=True))
            nodes, copies, blocks, sets = (batch.column(c) for c in ("node", "copies", "block", "set"))
            for i, k in enumerate(keys):
                if k != key and held:
                    done.append(pair(key, held))
                    n += len(held)
                    held = []
                    if n >= 5000:
                        yield out(done)
                        done, n = [], 0
                key = k
                held.append((nodes[i].as_py(), copies[i].as_py(), blocks[i].as_py(), sets[i].values.to_numpy().view(np.uint64).copy()))
        if held:
            done.append(pair(key, held))
        if done:
            yield out(done)

    return tidied(verify)


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", block_grams: int = BLOCK_GRAMS, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """doc, same, class_id, class_key and n_links for each row of docs.

    n_links counts the other rows at the threshold or above; classes are what links connect. class_id is the smallest doc of
    the class (null if no row of it has an id), class_key names the class also then, and is null for a row without words.
    same is a hash of the text: rows with equal doc and same are copies of one another.
    """
    bands, rows = banding(threshold, recall)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("same"), F.col(text_col).alias("text"))
    signed = stored(texts.mapInArrow(_batches(size, bands, rows), "doc long, same long, node long, grams long, bands array<long>"), "signed")
    held = signed.where("node is not null")
    nodes = stored(held.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc").alias("doc"), F.max("grams").alias("grams")), "nodes")

    keys = held.select("node", "bands").dropDuplicates(["node"]).select("node", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key", "low")
    edges = stored(keys.join(small(stored(buckets, "buckets")), "key").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), "candidates")
    comps = components(edges).withColumnRenamed("root", "comp").join(nodes, "node")
    comps = stored(comps, "components")

    sizes = comps.groupBy("comp").agg(F.greatest(F.ceil(F.sum("grams") / block_grams), F.ceil(F.count("*") / block_nodes)).cast("int").alias("blocks"))
    placed = comps.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")).cast("int"))
    # one text of each node, found by its id and hash, as ids may be null or repeated
    firsts = signed.select("doc", "same", "node").join(small(comps.select("node", F.col("doc").alias("first"))), "node").where(F.col("doc").eqNullSafe(F.col("first")))
    wanted = stored(firsts.groupBy("node", "first").agg(F.min("same").alias("held")).drop("node"), "wanted")
    sets = texts.join(small(wanted), (F.col("same") == F.col("held")) & F.col("doc").eqNullSafe(F.col("first")), "left_semi").select("text").mapInArrow(_sets(size), "node long, set array<long>")
    sets = stored(sets.join(small(comps.select("node")), "node", "left_semi").dropDuplicates(["node"]), "sets")
    dealt = placed.join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("comp", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "node", "copies", "block", "set")
    pairs = dealt.repartition("comp", "x", "y").sortWithinPartitions("comp", "x", "y").mapInArrow(_verify(threshold), "node long, tie long, links long")
    pairs = stored(pairs, "verified")

    links = pairs.groupBy("node").agg(F.sum("links").alias("links")).where("links > 0")
    classes = components(pairs.where("node <> tie").select(F.col("node").alias("a"), F.col("tie").alias("b")).distinct())
    linked = nodes.join(classes, "node")
    names = linked.groupBy("root").agg(F.min("doc").alias("class_id"))
    linked = linked.join(names, "root").join(links, "node").select("node", "root", "class_id", "links")
    every = signed.select("doc", "same", "node").join(nodes.select("node", "copies", F.col("doc").alias("first")), "node", "left").join(linked, "node", "left")
    return every.select("doc", "same", F.coalesce("class_id", "first", "doc").alias("class_id"), F.coalesce("root", "node").alias("class_key"), F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"))
