"""Decisions and predictions derived from the benchmark tables by plain arithmetic, which SQL can do as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import first_best, softmax

STATUSES = ["F", "O", "P"]
CLASSES = [f"c{i}" for i in range(10)]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
CHOICES = ["a", "b", "insufficient"]
QUESTION = "Which status does the order have?"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def with_prediction(rows: DataFrame) -> DataFrame:
    """probabilities and prediction_id of option_ids and option_logits."""
    rows = rows.withColumn("probabilities", softmax(F.col("option_logits")))
    return rows.withColumn("prediction_id", first_best(F.col("option_ids"), F.col("probabilities")))


def order_rows(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """D1: the status of an order among three, with logits from its keys and price; `shift` makes other models."""
    o = table(spark, sf_dir, "orders")
    logits = F.array(((F.col("o_orderkey") + shift) * 7919 % 101) / 25.0, (F.col("o_custkey") * 104729 % 103) / 25.0, (F.floor("o_totalprice") % 97) / 25.0)
    return with_prediction(o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("label"), _strings(STATUSES).alias("option_ids"), logits.alias("option_logits"), (F.col("o_totalprice") / 100000).alias("total_seconds"), F.col("o_custkey").alias("input_tokens")))


GOLD = ["id", "ordinal", "dataset", "label", "option_ids"]


def gold_and_predictions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.select(*GOLD), as_predictions(rows)


def as_predictions(rows: DataFrame) -> DataFrame:
    """The prediction columns; those that the rows lack are null."""
    from ..schemas import PREDICTION

    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in PREDICTION.fields])


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2: ten classes, with the first ten dimensions as logits."""
    v = table(spark, sf_dir, "embeddings")
    logits = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 10)
    return with_prediction(v.select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("ordinal"), F.lit("ten").alias("dataset"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"), _strings(CLASSES).alias("option_ids"), logits.alias("option_logits"), "embedding"))


def mixed_predictions(rows: DataFrame) -> DataFrame:
    """D3: predictions of which some are missing, some record an error, some do not sum to one or are not the most probable."""
    k = F.col("ordinal")
    error = F.when(k % 23 == 0, F.struct(F.lit("ValueError").alias("type"), F.lit("too long").alias("message")))
    wrong = F.when((k % 23 != 0) & (k % 29 == 0), F.transform("probabilities", lambda x: x * 1.1)).otherwise(F.col("probabilities"))
    other = F.when((k % 23 != 0) & (k % 29 != 0) & (k % 31 == 0), F.when(F.col("prediction_id") == "c0", "c1").otherwise("c0")).otherwise(F.col("prediction_id"))
    rows = rows.where(k % 17 != 0).select("id", "dataset", "option_ids", error.alias("error"), wrong.alias("probabilities"), other.alias("prediction_id"))
    return as_predictions(rows.withColumns({"probabilities": F.when(F.col("error").isNull(), F.col("probabilities")), "prediction_id": F.when(F.col("error").isNull(), F.col("prediction_id"))}))


def variant_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """D4: five variants of a decision among three, as gold and predictions; the reversed one stores its options in reverse."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 10).alias("e"))

    def dims(low: int) -> Column:
        return F.slice("e", low, 3)

    def plus(low: int) -> Column:
        return F.zip_with(dims(1), dims(low), lambda a, b: a + 0.5 * b)

    kinds = [("original", dims(1)), ("option_reversal", plus(4)), ("question_reworded", plus(7)), ("irrelevant_context", plus(10)), ("missing_evidence", plus(13))]
    each = F.array(*[F.struct(F.lit(k).alias("variant"), x.alias("l")) for k, x in kinds])
    rows = v.select("vec_id", F.explode(each).alias("v")).select("vec_id", "v.variant", "v.l")
    back = F.col("variant") == "option_reversal"
    label = F.when(F.col("variant") == "missing_evidence", "insufficient").otherwise(F.try_element_at(_strings(CHOICES), (F.col("vec_id") % 3 + 1).cast("int")))
    rows = rows.select(
        F.concat_ws("/", F.col("vec_id").cast("string"), "variant").alias("id"), F.col("vec_id").alias("ordinal"), F.col("vec_id").alias("group_id"), "variant", F.lit("owned-robustness").alias("dataset"), label.alias("label"),
        F.when(back, F.reverse(_strings(CHOICES))).otherwise(_strings(CHOICES)).alias("option_ids"), F.when(back, F.reverse("l")).otherwise(F.col("l")).alias("option_logits"))
    rows = with_prediction(rows)
    return rows.select(*GOLD, "group_id", "variant"), as_predictions(rows)


def order_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions in full: the state is an object of an order's fields."""
    o = table(spark, sf_dir, "orders")
    options = F.array(*[F.struct(F.lit(s).alias("id"), F.lit(f"The order has status {s}.").alias("description")) for s in STATUSES])
    return o.select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("dataset"), F.col("o_custkey").cast("string").alias("group_id"), F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer"))).alias("state_json"), F.lit(QUESTION).alias("question"), options.alias("options"), F.col("o_orderstatus").alias("label"))
