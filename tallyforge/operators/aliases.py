"""Whether an option's label adds exactly one piece after its context, told by joins with the vocabulary as a trie.

Pieces are taken greedily: at each place the longest piece of the vocabulary. A label then adds one piece and changes none
before it if it is a piece itself and no piece reaches from a place where one of the context's pieces begins over the
context's end into the label. The trie has a row for each piece and each way to cut it in two, so that such a piece is found
by an equi-join of what stands from a piece's beginning to the context's end, and of the label's beginnings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trie(vocabulary: DataFrame) -> DataFrame:
    """(prefix, continuation, id) for each cut of each piece of a vocabulary (piece, id); the whole piece after the empty prefix too."""
    at = F.explode(F.sequence(F.lit(0), F.length("piece") - 1)).alias("at")
    cut = vocabulary.where(F.length("piece") > 0).select("piece", "id", at)
    return cut.select(F.substring("piece", F.lit(1), F.col("at")).alias("prefix"), F.substring("piece", F.col("at") + 1, F.length("piece")).alias("continuation"), "id")


def endings(contexts: DataFrame, longest: int) -> DataFrame:
    """(context, ending): what stands from the beginning of each of a context's pieces to its end, as far as a piece can reach."""
    pieces = F.slice("pieces", F.greatest(F.size("pieces") - longest + 1, F.lit(1)), longest)
    tails = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, i, F.size(pieces)), ""))
    listed = contexts.where(F.size("pieces") > 0).select("context", F.explode(F.array_distinct(tails)).alias("ending"))
    return listed.where(F.length("ending") < longest)


def alias_problems(contexts: DataFrame, labels: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(context, label, reason, other) of labels that are not one piece after their context, or whose piece another label has too.

    contexts: context, pieces (its greedy pieces, in order). labels: context, label. vocabulary: piece, id; several pieces may have one id.
    """
    longest = vocabulary.agg(F.max(F.length("piece"))).first()[0] or 0
    cuts = trie(vocabulary)
    whole = cuts.where("prefix = ''").select(F.col("continuation").alias("label"), "id")
    own = labels.join(whole, "label", "left")
    out = own.where("id is null").select("context", "label", F.lit("is not one piece").alias("reason"), F.lit(None).cast("string").alias("other"))
    begins = labels.where(F.length("label") > 0).select("context", "label", F.explode(F.transform(F.sequence(F.lit(1), F.length("label")), lambda n: F.substring("label", F.lit(1), n))).alias("continuation"))
    reaching = begins.join(endings(contexts, longest), "context").join(cuts.withColumnRenamed("prefix", "ending"), ["ending", "continuation"])
    crossed = reaching.groupBy("context", "label").agg(F.min(F.concat("ending", "continuation")).alias("other"))
    out = out.unionByName(crossed.select("context", "label", F.lit("is joined by a piece of the context").alias("reason"), "other"))
    shared = own.where("id is not null").groupBy("context", "id").agg(F.array_sort(F.collect_set("label")).alias("all")).where(F.size("all") > 1)
    named = shared.select("context", F.explode("all").alias("label"), "all")
    others = F.array_join(F.array_remove(F.col("all"), F.col("label")), ",")
    return out.unionByName(named.select("context", "label", F.lit("has the piece of another label").alias("reason"), others.alias("other")))
