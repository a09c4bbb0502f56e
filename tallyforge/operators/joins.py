"""Joins and set operations between decisions, predictions, runs and subsets. All are equi-joins, left to the planner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unknown_ids(predictions: DataFrame, gold: DataFrame, key: str = "id", n: int | None = None) -> DataFrame:
    """Predicted ids without a decision, in order; the first n."""
    found = predictions.select(key).join(gold.select(key), key, "left_anti").orderBy(key)
    return found if n is None else found.limit(n)


def pending(gold: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return gold.join(done.select(key), key, "left_anti")


def of_dataset(predictions: DataFrame, gold: DataFrame, dataset: str, key: str = "id") -> DataFrame:
    return predictions.join(gold.where(F.col("dataset") == dataset).select(key), key, "left_semi")


def in_order(sources: list[DataFrame], name: str = "source_rank") -> DataFrame:
    """All rows of the sources with the place of their source; missing columns are null."""
    first, *rest = [s.withColumn(name, F.lit(i)) for i, s in enumerate(sources)]
    for s in rest:
        first = first.unionByName(s, allowMissingColumns=True)
    return first


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def set_comparison(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: only_left, only_right, shared and whether the sets of keys are equal."""
    both = a.select(key).distinct().withColumn("l", F.lit(1)).join(b.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared")).withColumn("equal", (F.col("only_left") + F.col("only_right")) == 0)


def changed_rows(subset: DataFrame, source: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Keys of the subset that the source lacks or holds with other values."""
    s = source.select(F.col(key).alias("_k"), F.struct(*columns).alias("_v"))
    same = F.struct(*columns).eqNullSafe(F.col("_v"))
    return subset.join(s, F.col(key) == F.col("_k"), "left").where(F.col("_k").isNull() | ~same).select(key)


def correction_map(recorded: DataFrame, correct: DataFrame, key: str, value: str, state: str, label: str) -> DataFrame:
    """Key, recorded and correct value, hash of the state, label; both tables must have the same keys and differ in the value alone."""
    a = recorded.select(key, F.col(value).alias(f"recorded_{value}"), F.col(state).alias("_s"), F.col(label).alias("_l"))
    b = correct.select(key, F.col(value).alias(f"correct_{value}"), state, label)
    both = a.join(b, key, "full")
    broken = F.col(f"recorded_{value}").isNull() | F.col(f"correct_{value}").isNull() | ~F.col("_s").eqNullSafe(F.col(state)) | ~F.col("_l").eqNullSafe(F.col(label))
    checked = F.when(broken, F.raise_error(F.concat(F.lit("correction changes more than the value: "), F.col(key).cast("string"))).cast("string")).otherwise(F.sha2(state, 256))
    return both.select(key, f"recorded_{value}", f"correct_{value}", checked.alias("state_sha256"), label)


def models_and_runs(models: DataFrame, runs: DataFrame) -> DataFrame:
    """Every model with its run's columns; status not_run if it has none."""
    return models.join(runs, "model_id", "left").withColumn("status", F.coalesce("status", F.lit("not_run")))


def hidden_runs(report: DataFrame, runs: DataFrame) -> DataFrame:
    """Report entries given as not run of which a run on the same benchmark exists."""
    return report.where("status = 'not_run'").join(runs, ["model_id", "benchmark_sha256"], "left_semi")


def matching_runs(runs: DataFrame, manifests: DataFrame) -> DataFrame:
    """Runs whose model id, file hash and size are those of a pinned manifest."""
    return runs.join(manifests, ["model_id", "gguf_sha256", "gguf_bytes"], "left_semi")


def missing_keys(required: list[str], keys):
    """The required names that an array column lacks; empty if it is a superset."""
    return F.array_except(F.array(*map(F.lit, required)), keys)
