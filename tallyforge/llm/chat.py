"""Chat formatting after collapsing cumulative snapshots of conversations.

A log often holds the same conversation at several lengths. Each turn is hashed with its place, and the exclusive-or of the
turns so far is the rolling hash of that prefix; two such hashes make 128 bits. A conversation whose hash is that of a proper
prefix of another goes by an anti-join, of equal ones the smallest id stays, and the rest is rendered.

The rolling hash is built in two levels, within ranges of `SPAN` turn numbers and over ranges, so that no window holds a
long conversation's turns. Turns are ordered by number (null first), role and text; a repeated number is a further turn.
A null role is `unknown` and a null text is empty. A row without an id is a conversation by itself, as nothing tells which rows
without one belong together; it comes after those with ids. Role markers inside a text are broken up.
Only conv_id, turn, role and text are read, so that no further column can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

SPAN = 64
NO_TURN = -(2**63)
# The markers of the chat format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), F.replace(F.replace(text, F.lit(OPEN), F.lit("< |im_start|>")), F.lit(CLOSE), F.lit("< |im_end|>")), F.lit(CLOSE + "\n"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv, pos, n_turns, role, text, p1, p2: each turn with its place from 1, its conversation's length and the hashes of the prefix that it ends. conv: whether there is no id, and the id or a number of the row's own."""
    own = F.struct(F.col("conv_id").isNull().alias("lost"), F.coalesce(F.col("conv_id").cast("long"), F.monotonically_increasing_id()).alias("id"))
    rows = turns.select(own.alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("span", F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(NO_TURN)))
    own = W.partitionBy("conv", "span").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumn("rn", F.row_number().over(own))
    over = W.partitionBy("conv").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("conv")
    spans = rows.groupBy("conv", "span").agg(F.count("*").alias("n"))
    spans = spans.select("conv", "span", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("n_turns"))
    rows = rows.join(spans, ["conv", "span"]).withColumn("pos", F.col("before") + F.col("rn"))
    for k in (1, 2):
        rows = rows.withColumn(f"h{k}", F.xxhash64(F.lit(k), "pos", F.sha2("role", 256), "text"))
    sums = rows.groupBy("conv", "span").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    sums = sums.select("conv", "span", *[F.coalesce(F.bit_xor(f"h{k}").over(over), F.lit(0)).alias(f"b{k}") for k in (1, 2)])
    so_far = W.partitionBy("conv", "span").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.join(sums, ["conv", "span"])
    return rows.select("conv", "pos", "n_turns", "role", "text", *[F.col(f"b{k}").bitwiseXOR(F.bit_xor(f"h{k}").over(so_far)).alias(f"p{k}") for k in (1, 2)])


def maximal(chained: DataFrame) -> DataFrame:
    """(conv, n_turns) of the conversations that no other one contains as a prefix; of equal ones the smallest."""
    final = chained.where("pos = n_turns").groupBy("n_turns", "p1", "p2").agg(F.min("conv").alias("conv"))
    inner = chained.where("pos < n_turns").select(F.col("pos").alias("n_turns"), "p1", "p2").distinct()
    return final.join(inner, ["n_turns", "p1", "p2"], "left_anti").select("conv", "n_turns")


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and text of the maximal conversations."""
    chained = stored(prefixes(turns), "chained")
    kept = chained.select("conv", "pos", rendered_turn(F.col("role"), F.col("text")).alias("part")).join(maximal(chained), "conv")
    whole = kept.groupBy("conv", "n_turns").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("parts"))
    return whole.select(F.when(~F.col("conv.lost"), F.col("conv.id")).alias("conv_id"), F.col("n_turns").cast("long").alias("n_turns"), F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("text"))
