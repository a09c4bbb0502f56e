"""The trie of conversation prefixes: which prefixes are shared, by how many, and what sharing them saves.

A node is a distinct sequence of first turns, named by a 128-bit digest (the exclusive-or of hashes of each turn with its
place), so that a turn's row knows its node and, without that turn, the node's parent. Sums over subtrees go up by pointer
jumping: in a round each node adds what the nodes have gathered that point to it, and pointers double their reach. After k
rounds a node has summed its descendants less than 2**k levels below it, so a trie of depth d takes about log d rounds, and
nodes nearer to the root than a pointer reaches take no part in the jump. A round is a grouped sum and two equi-joins,
written to the shared folder.

Turns are ordered by number (null first), then role and text; a repeated number is a further turn. A null role or text is
empty. Rows without a conv_id belong to no conversation and are left out. Running digests are built level by level over
spans of 64 places, so that no window holds a long conversation, and the ids that end at a node are hashed as a stream of
sorted blocks of 4,096 ids, so that no list of copies is held at once. An empty table has no nodes, not even a root. Only
conv_id, turn, role and text are read, so that no other column can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_stored, stored

SPAN = 64
ID_BITS = 12
NO_TURN = -(2**63)
NODE = ["p1", "p2"]
PARENT = ["q1", "q2"]


def placed(turns: DataFrame) -> DataFrame:
    """(conv, pos, r1, r2, bytes): each turn's place from 1, two hashes of its role and text, and the bytes of its text."""
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("span", F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(NO_TURN)))
    number = F.row_number().over(W.partitionBy("conv", "span").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    hashes = [F.xxhash64(F.lit(k), F.sha2("role", 256), "text").alias(f"r{k}") for k in (1, 2)]
    rows = rows.select("conv", "span", number.alias("rn"), *hashes, F.octet_length("text").cast("long").alias("bytes"))
    before = F.sum("n").over(W.partitionBy("conv").orderBy("span").rowsBetween(W.unboundedPreceding, -1))
    spans = rows.groupBy("conv", "span").agg(F.count("*").alias("n")).select("conv", "span", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(spans, ["conv", "span"]).select("conv", (F.col("before") + F.col("rn")).alias("pos"), "r1", "r2", "bytes")


def shared_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from the first of its five."""
    return F.crc32(conv.cast("string").cast("binary")) % 9


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, pos, r1, r2, bytes) of the rebuilt conversations: the first h turns of conversation c - c % 5, then c's own after its first h. turns: `placed`."""
    own = turns.withColumns({"h": shared_turns(F.col("conv")), "base": F.col("conv") - F.col("conv") % 5})
    lengths = turns.groupBy(F.col("conv").alias("base")).agg(F.count("*").alias("length"))
    rest = own.where("pos > h").join(lengths, "base", "left")
    taken = F.least("h", F.coalesce("length", F.lit(0)))
    rest = rest.select("conv", (F.col("pos") - F.col("h") + taken).alias("pos"), "r1", "r2", "bytes")
    heads = turns.where("pos <= 8").withColumnRenamed("conv", "base")  # h is at most 8, so a base has 8 rows here and 5 conversations
    given = own.select("conv", "h", "base").distinct().join(heads, "base").where("pos <= h").select("conv", "pos", "r1", "r2", "bytes")
    return given.unionByName(rest)


def running(rows: DataFrame, top: int) -> DataFrame:
    """(conv, pos, p1, p2): the exclusive-or of e1 and of e2 up to each place of a conversation; top is the last place there is. Spans of places are summed, the sums' running values built the same way, and added to those within a span."""
    up_to = [F.bit_xor(f"e{k}") for k in (1, 2)]
    if top <= SPAN:
        over = W.partitionBy("conv").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
        return rows.select("conv", "pos", *[x.over(over).alias(p) for x, p in zip(up_to, NODE, strict=True)])
    rows = rows.withColumn("span", F.floor(F.col("pos") / SPAN))
    sums = rows.groupBy("conv", "span").agg(*[x.alias(f"e{k}") for k, x in enumerate(up_to, 1)]).withColumnRenamed("span", "pos")
    before = running(sums, top // SPAN).join(sums, ["conv", "pos"])
    before = before.select("conv", F.col("pos").alias("span"), *[F.col(f"p{k}").bitwiseXOR(F.col(f"e{k}")).alias(f"b{k}") for k in (1, 2)])
    over = W.partitionBy("conv", "span").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    within = rows.select("conv", "pos", "span", *[x.over(over).alias(f"w{k}") for k, x in enumerate(up_to, 1)])
    return within.join(before, ["conv", "span"]).select("conv", "pos", *[F.col(f"w{k}").bitwiseXOR(F.col(f"b{k}")).alias(f"p{k}") for k in (1, 2)])


def chained(turns: DataFrame) -> DataFrame:
    """(conv, pos, bytes, p1, p2, q1, q2): each turn with the digest of the prefix it ends and of the one before it."""
    named = turns.select("conv", "pos", "bytes", *[F.xxhash64(F.lit(k), "pos", "r1", "r2").alias(f"e{k}") for k in (1, 2)])
    top = turns.agg(F.max("pos")).first()[0] or 0
    both = named.join(running(named.select("conv", "pos", "e1", "e2"), top), ["conv", "pos"])
    return both.select("conv", "pos", "bytes", *NODE, *[F.col(f"p{k}").bitwiseXOR(F.col(f"e{k}")).alias(f"q{k}") for k in (1, 2)])


def rolled_up(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """(p1, p2, *sums): each of the sums over a node's subtree. nodes: p1, p2, depth, q1, q2 and the values of the nodes themselves."""
    state, reach = stored(nodes, "sums"), 1
    deepest = state.agg(F.max("depth")).first()[0] or 0
    while reach <= deepest:
        gain = state.where(F.col("depth") >= reach).groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(*[F.sum(c).alias(f"more_{c}") for c in sums])
        grown = state.join(gain, NODE, "left").select(*NODE, "depth", *PARENT, *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums])
        far = grown.where(F.col("depth") >= 2 * reach)
        above = state.where(F.col("depth") >= reach).select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("q1").alias("n1"), F.col("q2").alias("n2"))
        far = far.join(above, PARENT).select(*NODE, "depth", F.col("n1").alias("q1"), F.col("n2").alias("q2"), *sums)
        before, state = state, stored(far.unionByName(grown.where(F.col("depth") < 2 * reach)), "sums")
        drop_stored(before)
        reach *= 2
    return state.select(*NODE, *sums)


def hashed_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (p1, p2, part), ordered: (p1, p2, ends_sha256) of each node's parts joined by commas, read once and never held together."""
    key, state = None, None

    def done(keys: list[tuple], digests: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(digests, pa.string())], names=[*NODE, "ends_sha256"])

    for batch in batches:
        keys, digests = [], []
        for p1, p2, part in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (p1, p2) == key:
                state.update(b",")
            else:
                if state:
                    keys.append(key)
                    digests.append(state.hexdigest())
                key, state = (p1, p2), hashlib.sha256()
            state.update(part.encode())
        yield done(keys, digests)
    if state:
        yield done([key], [state.hexdigest()])


def ends(found: DataFrame, convs: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256) of the nodes where a conversation ends."""
    last = found.groupBy("conv").agg(F.max(F.struct("pos", *NODE)).alias("at"))
    at = convs.join(last, "conv", "left").select("conv", *[F.coalesce(f"at.{p}", F.lit(0).cast("long")).alias(p) for p in NODE])
    blocks = at.groupBy(*NODE, F.shiftright("conv", ID_BITS).alias("block")).agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    parts = blocks.select(*NODE, "block", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("part"))
    return parts.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "part").mapInArrow(hashed_streams, "p1 long, p2 long, ends_sha256 string")


def trie(turns: DataFrame, rebuild=rebuilt) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node. `rebuild` makes the conversations of the placed turns; None takes them as they are."""
    own = stored(placed(turns), "turns")
    convs = stored(own.select("conv").distinct(), "convs")
    found = stored(chained(rebuild(own) if rebuild else own), "chained")
    nodes = found.groupBy(*NODE).agg(F.min("conv").alias("conv_id"), F.min("pos").cast("long").alias("depth"), *[F.min(q).alias(q) for q in PARENT], F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*[zero.alias(p) for p in NODE], "conv_id", zero.alias("depth"), *[F.lit(None).cast("long").alias(q) for q in PARENT], "n_convs", zero.alias("bytes"))
    nodes = nodes.unionByName(root)
    children = nodes.where("depth > 0").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)), "nodes")
    values = nodes.select(*NODE, "depth", *PARENT, (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    inner = nodes.where("n_children > 0").select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.where("depth > 0").join(inner, PARENT).select(*NODE, "parent_conv_id")
    out = nodes.join(rolled_up(values, ["n_leaves", "saved_tokens"]), NODE).join(below, NODE, "left").join(ends(found, convs), NODE, "left")
    empty = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
