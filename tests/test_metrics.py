"""Metrics on small tables with numbers worked out by hand, and invariants."""

from __future__ import annotations

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators import metrics, robustness, states
from tallyforge.plans import summaries
from tallyforge.plans.runs import summarize
from tallyforge.schemas import PREDICTION

GOLD = "id string, ordinal long, dataset string, label string, option_ids array<string>"
YN = ["yes", "no"]


def gold(spark, rows=(("a", "yes"), ("b", "no")), dataset="boolq-balanced"):
    return spark.createDataFrame([(i, k, dataset, label, YN) for k, (i, label) in enumerate(rows)], GOLD)


def prediction(i, probabilities, given=None, options=None, **more):
    options = options or YN
    base = {"id": i, "option_ids": options, "probabilities": probabilities, "prediction_id": given or options[max(range(len(options)), key=probabilities.__getitem__)], "total_seconds": 1.0, "allowed_token_mass": 0.9}
    return base | more


def predictions(spark, rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in PREDICTION.fields) for r in rows], PREDICTION)


def test_complete(spark):
    found = summarize(gold(spark), predictions(spark, [prediction("a", [0.8, 0.2]), prediction("b", [0.1, 0.9])]))["overall"]
    assert (found["accuracy"], found["macro_f1"], found["coverage"]) == (1, 1, 1)
    assert found["brier"] == pytest.approx(0.05)
    assert found["nll"] == pytest.approx((-math.log(0.8) - math.log(0.9)) / 2)
    assert found["ece_10_bin"] == pytest.approx(0.15)
    assert found["latency_seconds"] == {"p50": 1.0, "p95": 1.0, "total": 2.0, "decisions_per_second": 1.0}


def test_one_missing(spark):
    found = summarize(gold(spark), predictions(spark, [prediction("a", [0.8, 0.2])]))["overall"]
    assert (found["coverage"], found["accuracy"], found["nll"], found["brier"]) == (0.5, 0.5, None, None)
    assert found["errors"] == [{"id": "b", "status": "missing"}]


def test_invalid_and_error_rows(spark):
    rows = [prediction("a", [0.8, 0.2], given="no"), {"id": "b", "option_ids": YN, "error": ("ValueError", "too long")}]
    found = summarize(gold(spark), predictions(spark, rows))["overall"]
    assert [e["status"] for e in found["errors"]] == ["invalid", "invalid"]
    assert found["errors"][1]["error"] == "ValueError: too long"


@pytest.mark.parametrize("more, reason", [
    ({"total_seconds": -1.0}, "total_seconds"), ({"forward_seconds": float("nan")}, "forward_seconds"), ({"forward_seconds": 2.0}, "forward time"),
    ({"allowed_token_mass": 1.1}, "allowed mass"), ({"option_logits": [0.0, 0.0]}, "do not match"), ({"alias_token_ids": [1, 1]}, "alias"), ({"alias_token_ids": [1, -2]}, "alias"),
    ({"prompt": ("v", "0" * 64, "text")}, "hash"), ({"input_tokens": -1}, "input_tokens"), ({"dataset": "other"}, "dataset"), ({"probabilities": [0.7, 0.2]}, "sum"), ({"probabilities": [1.2, -0.2]}, "nonnegative"), ({"probabilities": [0.9]}, "shape"),
])
def test_reasons(spark, more, reason):
    rows = metrics.scored(gold(spark, [("a", "yes")]), predictions(spark, [prediction("a", [0.9, 0.1]) | more])).collect()
    assert rows[0]["status"] == "invalid" and reason in rows[0]["error"]


def test_no_rows(spark):
    rows = metrics.scored(gold(spark, []), predictions(spark, []))
    found = metrics.summary(rows).first()
    assert (found["rows"], found["coverage"], found["accuracy"], found["nll"]) == (0, 0.0, None, None)
    assert metrics.calibration_error(rows).first()["ece_10_bin"] is None


def test_macro_f1_needs_one_class_set(spark):
    assert summarize(gold(spark, dataset="free"), predictions(spark, [prediction("a", [0.8, 0.2])]))["overall"]["macro_f1"] is None
    two = gold(spark, [("a", "yes")]).union(gold(spark, [("b", "no")], "wanli-balanced"))
    assert summarize(two, predictions(spark, [prediction("a", [0.8, 0.2])]))["overall"]["macro_f1"] is None


def many(spark, n=240):
    """Decisions of three datasets, some missing, failed or invalid, with tied and untied measurements."""
    r = random.Random(4)
    decisions = [(f"i{k}", k, ("boolq-balanced", "wanli-balanced", "free")[k % 3], r.choice(YN), YN if k % 3 != 1 or k % 2 else YN[::-1]) for k in range(n)]
    rows = []
    for i, k, dataset, _, options in decisions:
        p = round(r.random(), 2)
        made = prediction(i, [p, 1 - p], options=options, total_seconds=r.choice([0.5, 1.0, r.random()]), input_tokens=r.randrange(9), peak_process_rss_bytes=r.randrange(5) * 1024)
        if dataset != "boolq-balanced":
            made |= r.choice([{}, {}, {}, {"total_seconds": -1.0}, {"allowed_token_mass": None}])
        if k % 17 or dataset == "boolq-balanced":
            rows.append(made)
    return metrics.scored(spark.createDataFrame(decisions, GOLD), predictions(spark, rows))


def test_states_of_random_splits_merge_to_the_summary(spark):
    rows = many(spark).persist()
    want = {(r["dataset"] or ""): r.asDict() for r in metrics.summary_all(rows).collect()}
    shared = {r["dataset"]: r["macro_f1"] for r in metrics.gated_macro_f1(rows).collect()}
    error = {r["dataset"]: r["ece_10_bin"] for r in metrics.calibration_error(rows, ["dataset"]).collect()} | {"": metrics.calibration_error(rows).first()["ece_10_bin"]}
    for seed in (1, 2):
        split = rows.withColumn("part", (F.rand(seed) * 7).cast("int").cast("string"))
        of_parts = states.state(split, ["part"])
        assert of_parts.select("part").distinct().count() == 7
        found = {r["dataset"]: r.asDict() for r in states.summary_of(of_parts.drop("part")).collect()}
        assert set(found) == set(want) and want["boolq-balanced"]["nll"] is not None and want["free"]["nll"] is None
        for d, row in want.items():
            both = {c for c in row if c in found[d]} - {"dataset"}
            assert {"rows", "accuracy", "nll", "brier", "latency_p50", "latency_p95", "mass_mean", "rss_max", "rss_p50", "input_tokens_p50"} <= both
            assert {c: found[d][c] for c in both} == {c: None if row[c] is None else pytest.approx(row[c], rel=1e-12) for c in both}
            assert found[d]["ece_10_bin"] == pytest.approx(error[d], abs=1e-12)
            if d:
                assert found[d]["macro_f1"] == (None if shared[d] is None else pytest.approx(shared[d]))
                bins = [(b["lower"], b["n"], pytest.approx(b["mean_confidence"]), pytest.approx(b["accuracy"])) for b in sorted(metrics.reliability_bins(rows.where(F.col("dataset") == d)).collect())]
                assert [tuple(b)[0::2][:1] + (b["n"], b["mean_confidence"], b["accuracy"]) for b in found[d]["reliability_bins"]] == bins
    rows.unpersist()


def test_more_errors_than_are_listed(spark, monkeypatch):
    monkeypatch.setattr(summaries, "LISTED", 1)
    monkeypatch.setattr(summaries.listed_errors, "__defaults__", (1,))
    found = summarize(gold(spark), predictions(spark, []))["overall"]
    assert found["errors"] == [{"id": "a", "status": "missing"}] and found["errors_not_listed"] == 1


def test_bin_edges(spark):
    values = [0.0, 0.1, 0.8999999999999999, 0.9, 1.0, 1.000001, 0.3, 0.7000000000000001]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "c double").select(S.bin_of(F.col("c"))).collect()]
    assert got == [0, 1, 8, 9, 9, None, 3, 7]


def test_a_confidence_above_one_counts_in_the_total_alone(spark):
    rows = spark.createDataFrame([("ok", 9, 0.95, True), ("ok", None, 1.000001, True)], "status string, bin int, confidence double, correct boolean")
    assert metrics.calibration_error(rows).first()["ece_10_bin"] == pytest.approx(0.05 / 2)


def test_first_best_of_ties_and_softmax(spark):
    row = spark.range(1).select(S.first_best(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(0.5), F.lit(0.5))).alias("x"), S.softmax(F.array(F.lit(1.0), F.lit(float("inf")))).alias("y"), S.softmax(F.array(F.lit(1.0))).alias("z"), S.softmax(F.array(F.lit(0.0), F.lit(0.0))).alias("w")).first()
    assert (row["x"], row["y"], row["z"], row["w"]) == ("a", None, None, [0.5, 0.5])


def variants(spark):
    rows = [("o", "original", ["a", "b", "i"], [0.6, 0.3, 0.1], "a"), ("r", "option_reversal", ["i", "b", "a"], [0.1, 0.6, 0.3], "a"), ("m", "missing_evidence", ["a", "b", "i"], [0.1, 0.1, 0.8], "i")]
    g = spark.createDataFrame([(i, k, "owned-robustness", label, o, "g", v) for k, (i, v, o, _, label) in enumerate(rows)], GOLD + ", group_id string, variant string")
    return g, [prediction(i, p, options=o) for i, _, o, p, _ in rows]


def test_variants_match_by_option(spark):
    g, p = variants(spark)
    found = robustness.robustness(metrics.scored(g, predictions(spark, p))).first()
    assert (found["declared_variant_comparisons"], found["paired_variant_comparisons"], found["argmax_flip_rate"], found["missing_evidence_error_rate"]) == (1, 1, 1.0, 0.0)
    assert found["mean_absolute_probability_movement"] == pytest.approx(0.2)


def test_an_invalid_pair_is_no_pair(spark):
    g, p = variants(spark)
    p[1]["probabilities"], p[2]["prediction_id"] = [0.5, 0.6, 0.3], "a"
    found = robustness.robustness(metrics.scored(g, predictions(spark, p))).first()
    assert (found["valid_pair_coverage"], found["argmax_flip_rate"], found["missing_evidence_error_rate"]) == (0.0, None, 1.0)


def test_published_run(spark):
    """Seven decisions of a published run: confidence and correctness of each give its published calibration, accuracy and latency."""
    given = [(0.9999, True), (0.9918237586617149, False), (0.8421466587413523, True)]
    rows = spark.createDataFrame([("ok", c, ok) for c, ok in given], "status string, confidence double, correct boolean").withColumn("bin", S.bin_of(F.col("confidence")))
    want = (1 * abs(0.8421466587413523 - 1) + 2 * abs((0.9999 + 0.9918237586617149) / 2 - 0.5)) / 3
    assert metrics.calibration_error(rows).first()["ece_10_bin"] == pytest.approx(want, abs=1e-12)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60), st.integers(2, 9))
def test_percentiles(spark, values, pieces):
    rows = spark.createDataFrame([("g", float(v)) for v in values], "k string, v double")
    got = metrics.exact_percentiles(rows, "v", [0.5, 0.95], ["k"], pieces).first()
    want = rows.groupBy("k").agg(F.percentile("v", 0.5).alias("a"), F.percentile("v", 0.95).alias("b")).first()
    assert got["p50"] == pytest.approx(want["a"], rel=1e-12, abs=1e-12) and got["p95"] == pytest.approx(want["b"], rel=1e-12, abs=1e-12)


def test_percentiles_do_not_depend_on_where_a_sketch_cuts(spark, monkeypatch):
    """A sketch that cuts elsewhere each time it is worked out, as one does whose parts arrive in another order."""
    sketch = F.percentile_approx
    shaken = lambda c, q, n: sketch(F.col(c) + F.call_function("reflect", F.lit("java.lang.Math"), F.lit("random")).cast("double") * 400, q, n)
    monkeypatch.setattr(metrics.F, "percentile_approx", shaken)
    rows = spark.range(0, 2000, 1, 4).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"))
    for _ in range(3):
        got = {r["k"]: (r["p50"], r["p95"]) for r in metrics.exact_percentiles(rows, "v", [0.5, 0.95], ["k"]).collect()}
        assert got == {0: (999.0, pytest.approx(1898.1)), 1: (1000.0, pytest.approx(1899.1))}


def test_percentiles_of_a_group_without_a_name(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 5.0)], "k string, v double")
    got = {r["k"]: r["p50"] for r in metrics.exact_percentiles(rows, "v", [0.5], ["k"]).collect()}
    assert got == {None: 1.5, "a": 5.0}


def test_no_summary_holds_the_values_of_a_group_in_a_buffer(spark):
    rows = metrics.scored(gold(spark), spark.createDataFrame([], PREDICTION))
    for by in (None, ["dataset"]):
        assert " percentile(" not in metrics.summary(rows, by)._jdf.queryExecution().optimizedPlan().toString()


def test_states_are_merged_once(spark):
    rows = metrics.scored(gold(spark), spark.createDataFrame([], PREDICTION)).withColumn("part", F.lit(0))
    found = states.summary_of(states.state(rows, ["part"]).drop("part"))
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["dataset"]: r["rows"] for r in found.collect()} == {"": 2, "boolq-balanced": 2}
