"""Evaluation of predictions against gold decisions, for all rows and for each dataset in one aggregation.

A decision is ok, missing (no prediction) or invalid (a prediction that breaks a constraint or records an error). Missing
and invalid rows count as wrong; losses are null unless every row of the group is ok.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import bin_of, brier, index_of
from ..schemas import BINS, FIXED_CLASS_DATASETS, LEAST_PROBABILITY
from ..sources.shared import kept
from .validate import prediction_reason

#: Measurements of a prediction that are summed up where they are given.
MEASURES = ["total_seconds", "allowed_token_mass", "peak_process_rss_bytes", "input_tokens"]


def scored(gold: DataFrame, predictions: DataFrame, by: list[str] | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """Each decision with status, error, prediction_id, correct, nll, brier, confidence, bin and its measurements.

    gold: id, dataset, option_ids, label and any others. predictions: the columns of the prediction schema. by: columns of
    both that say, with the id, which prediction belongs to which decision, such as the run. more: further columns by name,
    from the structs p of the prediction (null if there is none) and g of the decision, and from the reason why it doesn't hold.
    """
    kept, key = gold.columns, {c: f"_{c}" for c in ["id", *(by or [])]}
    both = gold.select(*[F.col(c).alias(k) for c, k in key.items()], F.struct(*kept).alias("g"))
    both = both.join(predictions.select(*[F.col(c).alias(k) for c, k in key.items()], F.struct("*").alias("p")), list(key.values()), "left")
    failed = F.coalesce(F.concat(F.coalesce("p.error.type", F.lit("Error")), F.lit(": "), F.coalesce("p.error.message", F.lit(""))), F.lit("Malformed error"))
    reason = F.when(F.col("p.error").isNotNull(), failed).otherwise(prediction_reason("p", "g"))
    both = both.withColumn("reason", F.when(F.col("p").isNotNull(), reason))
    ok = F.col("p").isNotNull() & F.col("reason").isNull()
    both = both.withColumn("status", F.when(F.col("p").isNull(), "missing").when(ok, "ok").otherwise("invalid"))

    def valid(x: Column) -> Column:
        return F.when(F.col("status") == "ok", x)

    place = index_of(F.col("g.option_ids"), F.col("g.label"))
    probabilities = F.col("p.probabilities")
    out = both.select(
        *[F.col(f"g.{c}").alias(c) for c in kept], "status", F.col("reason").alias("error"),
        valid(F.col("p.prediction_id")).alias("prediction_id"),
        valid(probabilities).alias("probabilities"),
        F.coalesce(valid(F.col("p.prediction_id") == F.col("g.label")), F.lit(False)).alias("correct"),
        valid(-F.log(F.greatest(F.try_element_at(probabilities, place), F.lit(LEAST_PROBABILITY)))).alias("nll"),
        valid(brier(probabilities, place)).alias("brier"),
        valid(F.array_max(probabilities)).alias("confidence"),
        *[valid(F.col(f"p.{m}").cast("double")).alias(m) for m in MEASURES if m in predictions.columns],
        *[x.alias(c) for c, x in (more or {}).items()],
    )
    return out.withColumn("bin", bin_of(F.col("confidence"), BINS))


def _aggregates(rows: DataFrame, percentiles: bool = True) -> list[Column]:
    whole = F.count_if(F.col("status") == "ok") == F.count("*")
    out = [
        F.count("*").alias("rows"), F.count_if("correct").alias("correct_predictions"), F.count_if(F.col("status") == "ok").alias("valid_predictions"),
        F.coalesce(F.try_divide(F.count_if(F.col("status") == "ok"), F.count("*")), F.lit(0.0)).alias("coverage"),
        F.try_divide(F.count_if("correct"), F.count("*")).alias("accuracy"),
        F.when(whole, F.avg("nll")).alias("nll"), F.when(whole, F.avg("brier")).alias("brier"),
    ]
    if "total_seconds" in rows.columns:
        total = F.coalesce(F.sum("total_seconds"), F.lit(0.0))
        out += [total.alias("latency_total"), F.try_divide(F.count("total_seconds"), F.nullif(total, F.lit(0.0))).alias("decisions_per_second")]
    if "allowed_token_mass" in rows.columns:
        out.append(F.avg("allowed_token_mass").alias("mass_mean"))
    if "peak_process_rss_bytes" in rows.columns:
        out.append(F.max("peak_process_rss_bytes").alias("rss_max"))
    if "input_tokens" in rows.columns:
        out.append(F.avg("input_tokens").alias("input_tokens_mean"))
    if percentiles:
        out += [F.percentile(m, q).alias(f"{name}_p{int(q * 100)}") for m, (name, fractions) in PERCENTILES.items() if m in rows.columns for q in fractions]
    return out


def summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, rates, losses and measurements of scored rows; over all rows if `by` is empty. No buffer grows with a group."""
    by = by or []
    out = (rows.groupBy(*by) if by else rows).agg(*_aggregates(rows, percentiles=False))
    held = {m: x for m, x in PERCENTILES.items() if m in rows.columns}
    return beside(out, measure_percentiles(rows, held, by), by) if held else out


def summary_all(rows: DataFrame) -> DataFrame:
    """The summary over all rows (dataset null, overall true) and of each dataset, in one pass."""
    each = rows.groupingSets([[], [F.col("dataset")]], F.col("dataset")).agg(*_aggregates(rows), F.grouping("dataset").alias("overall"))
    return each.withColumn("overall", F.col("overall") == 1)


def reliability_bins(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each bin with rows: its edges, count, mean confidence and accuracy. A confidence above 1 is in no bin."""
    found = rows.where("bin is not null").groupBy(*(by or []), "bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    return found.select(*(by or []), (F.col("bin") / BINS).alias("lower"), ((F.col("bin") + 1) / BINS).alias("upper"), "n", "mean_confidence", "accuracy")


def calibration_error(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Expected calibration error; rows in no bin count in the total alone. Null without valid rows."""
    each = rows.where("status = 'ok'").groupBy(*(by or []), "bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg(F.col("correct").cast("double")).alias("a"))
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("c") - F.col("a"))).otherwise(F.lit(0.0))
    whole = [F.try_divide(F.sum(gap), F.sum("n")).alias("ece_10_bin")]
    return each.groupBy(*by).agg(*whole) if by else each.agg(*whole)


def confusion(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of (label, prediction_id); null for no valid prediction."""
    return rows.groupBy(*(by or []), "label", "prediction_id").agg(F.count("*").alias("n"))


def class_counts(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each declared class: true positives, and how often it is gold and predicted. A row adds two short rows, not one for each option."""
    by = by or []
    ends = F.array(F.struct(F.col("label").alias("class"), F.lit(1).alias("gold"), F.lit(0).alias("given"), F.col("correct").cast("int").alias("hit")), F.struct(F.col("prediction_id").alias("class"), F.lit(0).alias("gold"), F.lit(1).alias("given"), F.lit(0).alias("hit")))
    seen = rows.select(*by, F.inline(ends)).where("class is not null").groupBy(*by, "class").agg(*[F.sum(x).alias(x) for x in ("gold", "given", "hit")])
    declared = rows.select(*by, "option_ids").distinct().select(*by, F.explode("option_ids").alias("class")).distinct()
    out = declared.join(seen, [*by, "class"], "left")
    return out.select(*by, "class", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("gold", "given", "hit")])


def macro_f1(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean over all declared classes of 2TP / (2TP + FP + FN), 0 where that is undefined."""
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("gold") + F.col("given")), F.lit(0.0))
    counts = class_counts(rows, by)
    return counts.groupBy(*by).agg(F.avg(f1).alias("macro_f1")) if by else counts.agg(F.avg(f1).alias("macro_f1"))


def gated_macro_f1(rows: DataFrame, fixed: list[str] | None = None) -> DataFrame:
    """(dataset, macro_f1): null unless the dataset has fixed classes and all its rows the same set of options."""
    fixed = FIXED_CLASS_DATASETS if fixed is None else fixed
    sets = rows.groupBy("dataset").agg(F.count_distinct(F.array_sort("option_ids")).alias("sets"))
    shared = sets.withColumn("shared", F.col("dataset").isin(fixed) & (F.col("sets") == 1))
    return shared.join(macro_f1(rows, ["dataset"]), "dataset").select("dataset", F.when(F.col("shared"), F.col("macro_f1")).alias("macro_f1"))


def errors(rows: DataFrame, ordinal: str = "id") -> DataFrame:
    """One row: the list of (id, status, error) of what is not ok, in order. Held by one row, as a report is."""
    return rows.where("status <> 'ok'").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), "id", "status", "error"))), lambda x: F.struct(x["id"].alias("id"), x["status"].alias("status"), x["error"].alias("error"))).alias("errors"))


def full_record(rows: DataFrame) -> DataFrame:
    """Every metric of each dataset as one row, with its bins as an array."""
    bins = reliability_bins(rows, ["dataset"]).groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("lower", "upper", "n", "mean_confidence", "accuracy"))).alias("reliability_bins"))
    out = summary(rows, ["dataset"])
    for more in (gated_macro_f1(rows), calibration_error(rows, ["dataset"]), bins):
        out = out.join(more, "dataset", "left")
    return out


def beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """The left rows with the other columns of the right row of the same group, or null; null groups are equal."""
    own = {c: f"_r_{c}" for c in by}
    on = F.lit(True)
    for c, r in own.items():
        on = on & F.col(c).eqNullSafe(F.col(r))
    return left.join(right.withColumnsRenamed(own), on, "left").drop(*own.values())


def exact_percentiles(rows: DataFrame, value: str, fractions: list[float], by: list[str], pieces: int = 64, counts: str | None = None) -> DataFrame:
    """(by, p50, ...): exact interpolated percentiles of large groups without holding a group in memory. counts: a column that says how often a value stands, in rows that have each value once.

    Equal values are counted first, so that ties are one row. A mergeable sketch cuts each group's values into pieces; counts
    of the pieces tell which hold the wanted ranks, and only the values of those are sorted. The built-in percentile keeps a
    group's distinct values in one aggregation buffer. The counts and the cuts are written: a sketch depends on the order in
    which its parts arrive, so that a second one could cut elsewhere and the ranks would be looked for in other pieces. Counts
    that are given are not written once more.
    """
    data = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"), *([F.col(counts).alias("n")] if counts else []))
    data = data if counts else kept(data.groupBy(*by, "v").agg(F.count("*").alias("n")), "values")
    cuts = kept(data.groupBy(*by).agg(F.percentile_approx("v", [i / pieces for i in range(1, pieces)], 10 * pieces).alias("cuts")), "cuts")
    placed = beside(data, cuts, by).select(*by, "v", "n", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("piece"))
    held = placed.groupBy(*by, "piece").agg(F.sum("n").alias("held"))
    each = W.partitionBy(*by).orderBy("piece")
    held = held.withColumns({"before": F.coalesce(F.sum("held").over(each.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("held").over(W.partitionBy(*by))})
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("total") - 1) * q), F.ceil((F.col("total") - 1) * q)) for q in fractions])))
    wanted = held.withColumn("ranks", F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("held")))).where(F.size("ranks") > 0)
    near = beside(placed, kept(wanted, "wanted"), [*by, "piece"]).where("ranks is not null")
    last = F.sum("n").over(W.partitionBy(*by, "piece").orderBy("v").rowsBetween(W.unboundedPreceding, 0)) + F.col("before")
    own = near.withColumn("last", last).withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("last") - F.col("n")) & (r < F.col("last"))))
    picked = own.select(*by, "total", "v", F.explode("ranks").alias("rank"))
    found = picked.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.col("rank").cast("long"), "v"))).alias("at"), F.max("total").alias("total"))

    def at(q: float) -> Column:
        place = (F.col("total") - 1) * q
        low, high = (F.try_element_at("at", f(place).cast("long")) for f in (F.floor, F.ceil))
        w = place - F.floor(place)
        return F.when(w == 0, low).otherwise(low * (1 - w) + high * w)

    return found.select(*by, *[at(q).alias(f"p{int(q * 100)}") for q in fractions])


PERCENTILES = {"total_seconds": ("latency", [0.5, 0.95]), "allowed_token_mass": ("mass", [0.5]), "peak_process_rss_bytes": ("rss", [0.5]), "input_tokens": ("input_tokens", [0.5])}


def by_measure(found: DataFrame, measures: dict[str, tuple[str, list[float]]], by: list[str], key: str) -> DataFrame:
    """The percentiles of each measurement, which `key` names, in a column each."""
    wanted = [(m, name, q) for m, (name, own) in measures.items() for q in own]
    columns = [F.max(F.when(F.col(key) == m, F.col(f"p{int(q * 100)}"))).alias(f"{name}_p{int(q * 100)}") for m, name, q in wanted]
    return found.groupBy(*by).agg(*columns)


def measure_percentiles(rows: DataFrame, measures: dict[str, tuple[str, list[float]]], by: list[str]) -> DataFrame:
    """The percentiles of all measurements of each group, whose values are counted in one pass over the rows."""
    each = F.array(*[F.struct(F.lit(i).alias("measure"), F.col(m).cast("double").alias("value")) for i, m in enumerate(measures)])
    values = rows.select(*by, F.inline(each))
    found = exact_percentiles(values, "value", sorted({q for _, own in measures.values() for q in own}), [*by, "measure"])
    return by_measure(found, {i: x for i, x in enumerate(measures.values())}, by, "measure")


def large_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """The `summary` by one column at least; both have one form for any number of rows."""
    return summary(rows, by)
