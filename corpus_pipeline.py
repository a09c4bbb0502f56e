"""The training-data pipeline: stages over documents, each written as Parquet and read again by the next.

quality      documents whose probability of the top grade is under 0.7 go
lines        lines that a document with a smaller id holds go, and n_chars follows; a document goes that lost lines and has
             nothing but blank ones left, or whose lines are, in any order, all those of one with a smaller id
near         of each class of near-duplicates the document with the smallest id stays
benchmark    documents that hold a window of a benchmark item go
pieces       the documents that are left, encoded

Rows with null ids are decided like others, after those with an id. A null or empty text has no lines to lose, no words to be near
or contaminated by, and no pieces: only the quality stage can drop it, by what the model makes of no features. Of rows that
repeat one another, id and text, one is left by the near stage if they have words, and all if they have none; rows of one id
with different texts are one document to the line stage and documents of their own to the others. Ties go to the smallest id,
then to the smaller hash of the text. Texts are read whole at any length. An empty table gives an empty one at each stage.
Columns with the names that stages use for themselves stay as they are. No SQL gives the same rows, as the first stage is a
trained model; the tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, line_dedup, near_join, pieces, quality
from tallyforge.llm.common import ascii_lower, drop_stored, small, stored, table, unused

#: Chunks that a worker remembers, less than the default: the stages before leave the executors less room.
KEPT_CHUNKS = 40_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, quality.ratings(table(spark, sf_dir, "labels")), top=2)
    return quality.score(docs, model).where(F.col("tail") >= quality.LEAST_TAIL).select(docs.columns)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lines, doc, first, last = unused(docs, "__lines", "__doc", "__first", "__last")
    held = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: ascii_lower(line_dedup.stripped(x))), lambda x: x != "")
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(line_dedup.LAST))
    marked = docs.withColumn(lines, F.sha2(F.array_join(F.sort_array(held), "\n"), 256))
    copied = marked.groupBy(lines).agg(F.min(place).alias(first), F.max(place).alias(last)).where(F.col(first) < F.col(last)).select(lines, first)
    out = line_dedup.dedup_lines(marked).withColumn(doc, place).join(small(stored(copied, "copied")), lines, "left")
    own = F.exists(F.split("text", "\n"), lambda x: line_dedup.stripped(x) != "") & ~F.coalesce(F.col(first) < F.col(doc), F.lit(False))
    return out.where((F.col("n_dropped") == 0) | own).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: that with the smallest id, null ids last. Rows without words are no copies of one another and stay."""
    doc, same, place = unused(docs, "__doc", "__same", "__place")
    classes = stored(near_join.near_classes(docs).select("doc", "same", "class_key").withColumn("place", F.coalesce("doc", F.lit(line_dedup.LAST))), "classes")
    least = classes.groupBy("class_key").agg(F.min("place").alias("place"))
    texts = classes.join(least, ["class_key", "place"]).groupBy("class_key", "place", "same").agg(F.count("*").alias("n"), F.min("doc").alias("doc"))
    kept = texts.groupBy("class_key", "place").agg(F.min("doc").alias(doc), F.min("same").alias(same), F.min_by("n", "same").alias("n"))
    kept = stored(kept.select(doc, same, "n"), "kept")
    alone = classes.where("class_key is null").select(F.col("doc").alias(doc), F.col("same").alias(same)).distinct()
    named = docs.withColumn(place, F.xxhash64("text"))
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(place) == F.col(same))
    single = named.join(kept.where("n = 1").drop("n").union(alone), match, "left_semi")
    repeated = named.join(small(kept.where("n > 1").drop("n")), match, "left_semi").dropDuplicates(["doc_id", place])
    return single.union(repeated).select(docs.columns)


def unseen_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    doc, same, own = unused(docs, "__doc", "__same", "__own")
    row = F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("same"))
    named = docs.select(row.alias("doc_id"), "text")
    hit = decontaminate.contamination(named, table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    hit = stored(hit.select(F.col("doc.doc_id").alias(doc), F.col("doc.same").alias(same)).distinct(), "contaminated")
    match = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(f"{own}.same") == F.col(same))
    return docs.withColumn(own, row).join(hit, match, "left_anti").select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(docs, pieces.load(), kept=KEPT_CHUNKS, lasting=False, keep_text=True)


STAGES = [("quality", good_quality), ("lines", new_lines), ("near", one_of_each), ("benchmark", unseen_benchmarks), ("pieces", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if last is not None:
            drop_stored(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
