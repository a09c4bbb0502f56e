"""The queries opN_<name>: each applies its operator to a whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, decontaminate, html_extract, language, licenses, line_dedup, near_join, pieces, prefix_trie, quality, simhash, substrings
from .common import stored, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids of the best segmentation, scores of the N best, others: each further one as edits of the best; see `pieces`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_texts(docs, pieces.load()).withColumn("n_pieces", F.size("ids").cast("long"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns: the items with a window in the document within the slop, counted and as a digest like the exact ones."""
    out = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    listed = [[F.size(c).cast("long").alias(f"n_{c}"), F.sha2(F.array_join(c, ","), 256).alias(f"{c}_sha256")] for c in ("items", "near_items")]
    return out.select(F.col("doc").alias("doc_id"), "n_words", "n_hit", *listed[0], (F.col("n_hit") > 0).alias("contaminated"), *listed[1])


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.format_conversations(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "n_turns", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns, for ids divisible by 20: n_same, the other rows with its fingerprint; n_near, the other
    fingerprints found within the radius of the search; nearest_distance and nearest_doc_id, the nearest of them and the
    smallest doc_id that has it."""
    chained = simhash.with_next(table(spark, sf_dir, "documents"))
    changed = simhash.edited(F.col("text"), F.col("next_text"))
    row = ["bucket", "place", "doc", "same", "next_doc", "next_same"]
    kept = [*row, "n_chars", "edited_sha"]
    given = chained.select(*row, F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2(changed, 256)).alias("edited_sha"), F.array("text", changed).alias("both"))
    prints = simhash.fingerprints(given.select(*kept, F.posexplode("both").alias("kind", "t")), [*kept, "kind"], "t")
    sides = [F.max(F.when(F.col("kind") == k, F.col("fingerprint"))).alias(c) for k, c in enumerate(("fingerprint", "edited"))]
    prints = stored(prints.groupBy(*kept).agg(*sides).withColumn("asked", F.coalesce(F.col("doc") % 20 == 0, F.lit(False))), "prints")

    following = prints.select(F.col("doc").alias("next_doc"), F.col("same").alias("next_same"), F.col("fingerprint").alias("following")).dropDuplicates(["next_doc", "next_same"])
    held = prints.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min(F.when(F.col("doc") != simhash.LEAST, F.col("doc"))).alias("first"))
    near = simhash.search(prints, "asked").join(held.select(F.col("fingerprint").alias("nearest"), F.col("first").alias("nearest_doc_id")), "nearest", "left")
    near = near.select("fingerprint", "n_near", F.col("distance").alias("nearest_distance"), "nearest_doc_id")
    found = held.select("fingerprint", (F.col("n") - 1).alias("n_same")).join(near, "fingerprint")
    every = prints.join(following, ["next_doc", "next_same"])
    out = every.where("asked").join(found, "fingerprint").unionByName(every.where("not asked"), allowMissingColumns=True)
    return out.select(
        F.when(F.col("doc") != simhash.LEAST, F.col("doc")).alias("doc_id"), "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"),
        simhash.hex_string(F.col("fingerprint")).alias("fingerprint"), simhash.hex_string(F.col("edited")).alias("edited_fingerprint"),
        simhash.likeness(F.col("fingerprint"), F.col("edited")).alias("near_edited"), simhash.likeness(F.col("fingerprint"), F.col("following")).alias("near_next"),
        "n_same", "n_near", "nearest_distance", "nearest_doc_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, quality.ratings(table(spark, sf_dir, "labels")), top=2)
    return quality.score(docs, model).select("doc_id", "expected_grade", F.col("tail").alias("p_top"), (F.col("tail") >= quality.LEAST_TAIL).alias("keep"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.held_out(F.col("doc_id"))
    names, p = language.learn(docs.where(F.col("doc_id").isNotNull() & ~out))
    return language.identify(docs.select("doc_id", out.alias("held_out"), "text"), names, p).drop("text")


def op9_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_classes(table(spark, sf_dir, "documents")).select(F.col("doc").alias("doc_id"), "class_id", "n_links")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a file of a tree source/block of 4096/block of 64. One whose first line is a statement is a LICENSE of its
    directory; of those, ids that leave 0 or 1 when divided by 7 are moved to the source's directory or the block's of 4096."""
    docs = table(spark, sf_dir, "documents")
    blocks = [F.floor(F.col("doc_id") / n).cast("string") for n in (4096, 64)]
    first = F.lower(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)).rlike(licenses.CUE)
    name = F.concat(F.when(first, F.lit("LICENSE-")).otherwise(F.lit("text-")), F.col("doc_id").cast("string"))
    moved = F.when(first, F.pmod(F.col("doc_id"), F.lit(7)))
    outer = F.when(F.coalesce(moved != 0, F.lit(True)), blocks[0])
    inner = F.when(F.coalesce(moved > 1, F.lit(True)), blocks[1])
    files = docs.select(F.col("doc_id").alias("rid"), F.concat_ws("/", "source", outer, inner, name).alias("path"), "text")
    return licenses.scan(files).withColumnRenamed("rid", "doc_id")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroids.digest(F.col("centroid")).alias("centroid_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_line_dedup": op2_line_dedup,
    "op3_pieces": op3_pieces,
    "op4_decontamination": op4_decontamination,
    "op5_chat": op5_chat,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_language": op8_language,
    "op9_near_join": op9_near_join,
    "op10_licenses": op10_licenses,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_centroids": op12_centroids,
    "op13_prefix_trie": op13_prefix_trie,
}
