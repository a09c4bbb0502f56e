"""Constraints as columns: the reason why a row does not hold, null if it does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, first_best, softmax, text_hash
from ..schemas import CONFIG_FIELDS, LEAST_OPTIONS, LOGIT_TOLERANCE, MASS_TOLERANCE, MOST_OPTIONS, SUM_TOLERANCE


class ConstraintError(ValueError):
    pass


def _filled(c: str) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def row_reason(state: str = "state_json") -> Column:
    """Why a decision is malformed. state: JSON text."""
    ids = F.transform("options", lambda o: o["id"])
    no_option = F.exists("options", lambda o: o.isNull() | F.coalesce(F.length(o["id"]) == 0, F.lit(True)) | F.coalesce(F.length(o["description"]) == 0, F.lit(True)))
    return (
        F.when(~(_filled("id") & _filled("dataset") & _filled("question") & _filled("label")), "id, dataset, question and label must be filled")
        .when(F.col(state).isNull() | F.col(state).isin('""', "{}", "[]", "null") | ~F.substring(state, 1, 1).isin('"', "{", "["), "state must be a filled text, object or array")
        .when(F.col("options").isNull() | ~F.size("options").between(LEAST_OPTIONS, MOST_OPTIONS), "2 to 26 options are needed")
        .when(no_option, "each option needs an id and a description")
        .when(F.size(F.array_distinct(ids)) != F.size(ids), "option ids must be distinct")
        .when(~F.array_contains(ids, F.col("label")), "label must be an option")
    )


def prediction_reason(p: str = "p", g: str = "g") -> Column:
    """Why a prediction struct does not hold for its decision struct (with option_ids); the checks in the fixed order, the first that fails."""
    def c(name: str) -> Column:
        return F.col(f"{p}.{name}")

    expected = F.col(f"{g}.option_ids")
    probabilities, logits, aliases = c("probabilities"), c("option_logits"), c("alias_token_ids")
    total = F.aggregate(probabilities, F.lit(0.0), lambda s, x: s + x)
    far = F.exists(F.arrays_zip(probabilities.alias("a"), softmax(logits).alias("b")), lambda z: F.abs(z["a"] - z["b"]) > LOGIT_TOLERANCE)
    numbers = ["total_seconds", "forward_seconds", "peak_process_rss_bytes", "input_tokens"]
    reason = (
        F.when(~c("id").eqNullSafe(F.col(f"{g}.id")) | ~c("option_ids").eqNullSafe(expected), "prediction does not align with the decision")
        .when(c("dataset").isNotNull() & (c("dataset") != F.col(f"{g}.dataset")), "prediction dataset differs")
        .when(c("error").isNotNull(), "prediction records an error")
        .when(probabilities.isNull() | (F.size(probabilities) != F.size(expected)), "probabilities have the wrong shape")
        .when(~F.forall(probabilities, lambda x: finite(x) & (x >= 0)), "probabilities must be finite and nonnegative")
        .when(F.abs(total - 1) > SUM_TOLERANCE, "probabilities must sum to one")
        .when(~c("prediction_id").eqNullSafe(first_best(expected, probabilities)), "prediction must be the first most probable option")
        .when(aliases.isNotNull() & ((F.size(aliases) != F.size(expected)) | ~F.forall(aliases, lambda x: F.coalesce(x >= 0, F.lit(False))) | (F.size(F.array_distinct(aliases)) != F.size(aliases))), "alias ids must be distinct and nonnegative")
        .when(logits.isNotNull() & ((F.size(logits) != F.size(expected)) | ~F.forall(logits, finite)), "logits must be finite and align with the options")
        .when(logits.isNotNull() & far, "probabilities do not match the logits")
        .when(c("prompt").isNotNull() & F.col(f"{p}.prompt.text").isNull(), "prompt must have a text")
        .when(c("prompt").isNotNull() & ~F.col(f"{p}.prompt.sha256").eqNullSafe(text_hash(F.col(f"{p}.prompt.text"))), "prompt hash differs from its text")
    )
    for n in numbers:
        x = c(n).cast("double")
        reason = reason.when(c(n).isNotNull() & (~finite(x) | (x < 0)), f"{n} must be finite and nonnegative")
    mass = c("allowed_token_mass")
    return reason.when(c("forward_seconds") > c("total_seconds"), "forward time exceeds the total").when(mass.isNotNull() & (~finite(mass) | ~mass.between(0, 1 + MASS_TOLERANCE)), "allowed mass must be between 0 and 1")


def manifest_reason() -> Column:
    """Why a model manifest (a row of its fields) is malformed."""
    number, size = F.col("parameters_billion"), F.col("effective_parameters_billion")
    revision = F.col("upstream_revision")
    complete = F.lit(True)
    for x in ("repository", "revision", "filename", "bytes", "sha256", "quantization"):
        complete = complete & F.col(f"gguf.{x}").isNotNull()
    return (
        F.when(F.col("gguf").isNull() | F.col("alias_compatibility").isNull() | F.col("benchmark_context_tokens").isNull(), "fields are missing")
        .when(~finite(number) | (number <= 0), "parameter count must be finite and positive")
        .when((number > 4) & ~F.col("parameter_basis").eqNullSafe("effective"), "more than 4 billion parameters need effective sizing")
        .when(F.col("parameter_basis").eqNullSafe("effective") & ~F.coalesce((size > 0) & (size <= 4), F.lit(False)), "effective size must be above 0 and at most 4")
        .when(~(_filled("id") & _filled("family") & _filled("upstream") & _filled("license")), "id, family, upstream and license must be filled")
        .when(revision.isNotNull() & ~revision.rlike("^[0-9a-f]{40}$"), "upstream revision must be a commit")
        .when(F.col("benchmark_context_tokens") < 1, "context must be positive")
        .when(~F.coalesce(F.col("alias_compatibility.status").isin("verified", "incompatible", "unverified"), F.lit(False)) | ~F.coalesce(F.length("alias_compatibility.detail") > 0, F.lit(False)), "alias compatibility needs a status and a detail")
        .when(~complete, "file metadata is incomplete")
        .when(F.col("gguf.bytes") < 1, "file size must be positive")
        .when(~F.col("gguf.sha256").rlike("^[0-9a-f]{64}$"), "file hash must have 64 hexadecimal digits")
        .when(~F.col("gguf.revision").rlike("^[0-9a-f]{40}$"), "file revision must be a commit")
    )


def configuration(model: str) -> Column:
    """The scoring configuration of a model struct; equal for runs that can be compared."""
    return F.struct(*[F.col(f"{model}.{x}").alias(x) for x in CONFIG_FIELDS])


def configuration_differs(a: str, b: str) -> Column:
    return ~configuration(a).eqNullSafe(configuration(b))


def duplicates(rows: DataFrame, key: str = "id") -> DataFrame:
    """(key, n) of the keys that stand more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(rows: DataFrame, key: str = "id") -> None:
    bad = duplicates(rows, key).orderBy(key).limit(5).collect()
    if bad:
        raise ConstraintError(f"Duplicate {key}: {[r[key] for r in bad]}")


def require_count(rows: DataFrame, n: int, what: str) -> None:
    have = rows.count()
    if have != n:
        raise ConstraintError(f"Expected {n} {what}, received {have}")


def require_valid(rows: DataFrame, reason: Column) -> None:
    """A row that doesn't hold is an error: the first by id. One job counts them, as a limit would read all rows in rounds of ever more partitions."""
    if rows.agg(F.count(reason)).first()[0]:
        bad = rows.withColumn("_reason", reason).where("_reason is not null").orderBy("id").select("id", "_reason").first()
        raise ConstraintError(f"{bad['id']}: {bad['_reason']}")


def require_valid_unique(rows: DataFrame, reason: Column, key: str = "id") -> int:
    """Every row holds, which is said first, and no key stands twice: one pass over rows that do. Returns their number."""
    each = rows.select(key, reason.alias("_reason")).groupBy(key).agg(F.count("*").alias("n"), F.count("_reason").alias("_bad"))
    found = each.agg(F.count_if((F.col("n") > 1) | (F.col("_bad") > 0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if found["bad"]:
        require_valid(rows, reason)
        require_unique(rows, key)
    return found["rows"]
