"""Scoring as a stream: decisions that arrive as files are scored once each, and what can't be scored becomes an error row.

A decision's time is its field `created`, or that of its file. A stream remembers the ids of the last `delay` before its
watermark and no longer: its state follows the rate of arrival, not the time it has run. What comes later than that is not
compared with that state; it is scored already, which the output tells, or it becomes an error row. So do unknown ids (a join
with the static table of decisions), lines that are no decisions, and decisions that don't hold.

Scored rows, which repeat the names of all fields and the model, are compressed as they are written.

Of each batch the output has the folders `scored/batch=N`, `errors/batch=N` and `times/batch=N`, the latest time seen so far. A batch
that is repeated after a failure replaces its own folders, so that nothing is scored twice.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.validate import row_reason
from ..schemas import DECISION, PREDICTION
from ..sources.readers import WHITE, holds

TIMED = T.StructType([*DECISION.fields, T.StructField("created", T.TimestampType()), T.StructField("_broken", T.StringType())])
ERROR = "id string, reason string, at timestamp"
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true"}


def arriving_decisions(spark: SparkSession, folder: str, known: DataFrame | None, files_a_batch: int | None) -> DataFrame:
    """(id, at, reason, row): the lines of arriving files, each with its time and why it can't be scored, or null."""
    reader = spark.readStream.option("lineSep", "\n")
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    lines = reader.text(folder).where(F.length(F.btrim("value", F.lit(WHITE))) > 0)
    parsed = F.from_json("value", TIMED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    text = F.when(F.schema_of_variant("r.state") == "STRING", F.to_json("r.state")).otherwise(F.get_json_object("value", "$.state"))
    rows = lines.select("value", F.col("_metadata.file_modification_time").alias("filed"), parsed.alias("r"))
    rows = rows.select("r.*", text.alias("state_json"), F.coalesce("r.created", "filed").alias("at"), "value").drop("state", "created")
    rows = rows.withColumns({"option_ids": F.transform("options", lambda o: o["id"]), "id": F.coalesce("id", F.sha2("value", 256))})
    reason: Column = F.when(F.col("_broken").isNotNull(), "not a decision").otherwise(row_reason())
    if known is not None:
        listed = known.select("id").distinct().withColumn("known", F.lit(True))
        rows = rows.join(listed, "id", "left")
        reason = F.coalesce(reason, F.when(F.col("known").isNull(), "Unknown id"))
    fields = [c for c in rows.columns if c not in ("at", "_broken", "value", "known")]
    return rows.select("id", "at", reason.alias("reason"), F.struct(*fields).alias("row"))


def latest(spark: SparkSession, out: str, number: int):
    """The latest time of all batches before one, as the batch before it has it on record; None if there was none."""
    path = f"{out}/times/batch={number - 1}"
    if not holds(spark, path):
        return None
    return spark.read.schema("at timestamp").json(path).agg(F.max("at")).first()[0]


def score_stream(spark: SparkSession, arriving: str, out: str, checkpoint: str, scorer, trigger: dict | None = None, *, known: DataFrame | None = None, delay: str = "1 day", files_a_batch: int | None = None):
    """The running query. known: a table whose ids are the only ones to be scored."""
    rows = arriving_decisions(spark, arriving, known, files_a_batch).withWatermark("at", delay)
    # Rows that the state lets through once, and beside them all, to tell late ones from repeated ones.
    once = rows.dropDuplicatesWithinWatermark(["id"]).withColumn("fresh", F.lit(True))
    # Of these only id, reason and time are looked at.
    both = once.unionByName(rows.withColumns({"fresh": F.lit(False), "row": F.lit(None).cast(rows.schema["row"].dataType)}))

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist(StorageLevel.DISK_ONLY)  # a batch can be all that has arrived
        try:
            fresh = batch.where("fresh")
            seen = latest(spark, out, number)
            errors = fresh.where("reason is not null").select("id", "reason", "at")
            if seen is not None:
                late = batch.where("NOT fresh").where(F.col("at") <= F.lit(seen) - F.expr(f"INTERVAL '{delay}'"))
                late = late.select("id", F.coalesce("reason", F.lit("late")).alias("reason"), "at").dropDuplicates(["id"])
                if late.limit(1).count():
                    for name, schema in (("scored", PREDICTION), ("errors", ERROR)):
                        if holds(spark, f"{out}/{name}/batch=*"):
                            told = spark.read.schema(schema).json(f"{out}/{name}").withColumn("batch", F.col("batch").cast("int"))
                            late = late.join(told.where(F.col("batch") < number).select("id"), "id", "left_anti")
                    errors = errors.unionByName(late)
            errors.write.mode("overwrite").json(f"{out}/errors/batch={number}")
            scorer.score(fresh.where("reason is null").select("row.*")).write.mode("overwrite").option("compression", "gzip").json(f"{out}/scored/batch={number}")
            batch.agg(F.greatest(F.max("at"), F.lit(seen).cast("timestamp")).alias("at")).write.mode("overwrite").json(f"{out}/times/batch={number}")
        finally:
            batch.unpersist()

    # The ids of the last `delay` lie in RocksDB on the executors' disks, not in their heaps. A stream takes the settings of its start.
    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        return both.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def scored_stream(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(PREDICTION).json(f"{out}/scored")


def stream_errors(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(ERROR).json(f"{out}/errors")
