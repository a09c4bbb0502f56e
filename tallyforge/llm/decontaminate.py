"""Benchmark decontamination with a positional inverted index of the training texts.

The index is a table of postings (rid, term, pos), one row for each word whose term the benchmark has at all: other terms
cannot take part in a match. One further posting of the empty term closes each document; its pos is the document's length.
Windows are matched from their rarest term: its postings, less its offset in the window, are the candidate starts, and each
further term's offset-adjusted postings are intersected with them, the rare ones first and the common ones at the end, when
few starts are left. A term's posting may stand up to `slop` words from its place: that is a proximity match, and a phrase
match if all stand at their places, so that both come from the same intersection. Only the benchmark's windows and vocabulary are ever broadcast, if a count shows them small.

A window is `size` consecutive words of an item; a shorter item is one window, an item without words none. Null texts have
no words. Rows that repeat a doc_id are matched and returned one by one. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, stored, words

SIZE = 10
#: The number of the empty term.
END = -1
#: Words that a term may stand from its place in a proximity match.
SLOP = 2
#: Terms of a window that are intersected first, the rarest among them; the others follow in a second step.
FIRST = 3


def windows(items: DataFrame, size: int = SIZE, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(wid, terms) of the distinct windows and (wid, item) of the items that hold them."""
    listed = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    each = listed.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))), lambda i: F.slice("w", i, size))).alias("terms"))
    each = stored(each.distinct(), "windows")
    wid = stored(each.select("terms").distinct().withColumn("wid", F.monotonically_increasing_id()), "wids")
    return wid, each.join(small(wid), "terms").select("wid", "item")


def numbered(wid: DataFrame) -> DataFrame:
    """(term, number) of the windows' vocabulary: postings hold the number, which is shorter than the term."""
    terms = wid.select(F.explode("terms").alias("term")).distinct()
    return stored(terms.withColumn("number", F.monotonically_increasing_id()), "vocabulary")


def build_postings(docs: DataFrame, vocabulary: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index (rid, doc, term, pos): of all terms, or of those of `vocabulary` (`numbered`), then by their numbers; the closing posting's term is empty, or `END`."""
    tokens = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc"), F.concat(words(F.col(text_col)), F.array(F.lit(""))).alias("w"))
    postings, end = tokens.select("rid", "doc", F.posexplode("w").alias("pos", "term")), F.lit("")
    if vocabulary is not None:
        ends = vocabulary.sparkSession.createDataFrame([("", END)], "term string, number long")
        postings = postings.join(small(vocabulary.union(ends)), "term").drop("term").withColumnRenamed("number", "term")
        end = F.lit(END)
    return stored(postings.select("rid", F.when(F.col("term") == end, F.col("doc")).alias("doc"), "term", "pos"), "postings")


def ranked_terms(wid: DataFrame, postings: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(wid, len, off, term, rank): the terms of the windows that can occur, ranked from the rarest; numbers of the vocabulary, if postings hold these."""
    terms = wid.select("wid", F.size("terms").alias("len"), F.posexplode("terms").alias("off", "word"))
    terms = terms.join(small(vocabulary).withColumnsRenamed({"term": "word", "number": "term"}), "word") if vocabulary is not None else terms.withColumn("term", F.col("word"))
    counts = small(stored(postings.groupBy("term").agg(F.count("*").alias("cf")), "counts"))  # the terms of the benchmark that occur
    each = W.partitionBy("wid")
    return stored(
        terms.join(counts, "term", "left").withColumn("least", F.min(F.coalesce("cf", F.lit(0))).over(each)).where("least > 0")
        .select("wid", "len", "off", "term", F.row_number().over(each.orderBy("cf", "word", "off")).alias("rank")), "ranked")


def occurrences(postings: DataFrame, ranked: DataFrame, slop: int = 0) -> DataFrame:
    """(rid, wid, start, len, exact) of every occurrence of every window: its rarest term stands at its place for `start`, each other term at most `slop` words from its own; exact if all stand at their own."""
    found = postings.join(small(ranked.where("rank = 1").select("wid", "len", "off", "term")), "term")
    found = found.select("rid", "wid", "len", (F.col("pos") - F.col("off")).alias("start")).where(F.col("start") >= -slop).withColumn("exact", F.col("start") >= 0)
    found = stored(found, "starts")
    row, width = ["rid", "wid", "len", "start", "exact"], 2 * slop + 1
    for low, high in ((2, FIRST), (FIRST + 1, None)):
        terms = ranked.where((F.col("rank") >= low) & (F.col("rank") <= high if high else F.lit(True))).select("wid", "off", "term")
        terms = stored(terms, "terms")
        here = postings.join(small(terms.select("term").distinct()), "term", "left_semi").join(small(found.where(F.col("len") >= low).select("rid").distinct()), "rid", "left_semi")
        here = here.select("rid", "term", "pos", F.floor(F.col("pos") / width).alias("cell"))
        place = F.col("start") + F.col("off")
        wanted = found.join(small(terms), "wid").select(*row, "off", "term", place.alias("place"))
        cells = F.array_distinct(F.array(*[F.floor((F.col("place") + x) / width) for x in (-slop, slop)]))  # where a place's neighbours can be
        near = wanted.withColumn("cell", F.explode(cells)).join(here, ["rid", "term", "cell"]).where(F.abs(F.col("pos") - F.col("place")) <= slop)
        held = near.groupBy(*row, "off").agg(F.max(F.col("pos") == F.col("place")).alias("own"))
        whole = held.groupBy(*row).agg(F.count("*").alias("n"), F.min("own").alias("own"))
        whole = whole.where(F.col("n") == (F.least("len", F.lit(high)) if high else F.col("len")) - (low - 1))
        whole = whole.select("rid", "wid", "len", "start", (F.col("exact") & F.col("own")).alias("exact"))
        found = stored(whole.union(found.where(F.col("len") < low)), "starts")
    return found.select("rid", "wid", "start", "len", "exact")


def phrase_matches(postings: DataFrame, ranked: DataFrame) -> DataFrame:
    """(rid, wid, start, len) of every exact occurrence of every window."""
    return occurrences(postings, ranked).where("exact").drop("exact")


def proximity_matches(postings: DataFrame, ranked: DataFrame, slop: int = SLOP) -> DataFrame:
    """(rid, wid, start): the occurrences within the slop, exact ones among them."""
    return occurrences(postings, ranked, slop).select("rid", "wid", "start")


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", slop: int = SLOP) -> DataFrame:
    """For each row of docs: doc, n_words, n_hit, items (sorted strings; empty if none), spans (start, length of the exact occurrences) and near_items, those with a window within the slop, items included."""
    wid, holders = windows(items, size, item_col, text_col)
    vocabulary = numbered(wid)
    postings = build_postings(docs, vocabulary, id_col, text_col)
    matches = occurrences(postings, ranked_terms(wid, postings, vocabulary), slop)
    exact = matches.where("exact")
    end, before = F.col("start") + F.col("len"), W.partitionBy("rid").orderBy("start", "len").rowsBetween(W.unboundedPreceding, -1)
    parts = exact.select("rid", "start", "len").distinct().withColumn("seen", F.coalesce(F.max(end).over(before), F.lit(0)))
    spans = F.array_sort(F.collect_list(F.struct("start", F.col("len").alias("length")))).alias("spans")
    hits = parts.groupBy("rid").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "seen"))).alias("n_hit"), spans)
    held = matches.groupBy("rid", "wid").agg(F.max("exact").alias("exact")).join(small(holders), "wid")
    item = F.col("item").cast("string")
    held = held.groupBy("rid").agg(F.array_sort(F.collect_set(F.when(F.col("exact"), item))).alias("items"), F.array_sort(F.collect_set(item)).alias("near_items"))
    every = postings.where(F.col("term") == END).select("rid", "doc", F.col("pos").cast("long").alias("n_words"))
    none, no_spans = F.array().cast("array<string>"), F.array().cast("array<struct<start:int,length:int>>")
    return every.join(hits, "rid", "left").join(held, "rid", "left").select(
        "doc", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("spans", no_spans).alias("spans"), F.coalesce("near_items", none).alias("near_items"))
