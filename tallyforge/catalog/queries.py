"""One query for each operator, over whole tables; computed doubles are rounded to six places."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import templates
from ..operators import aliases, digests, joins, metrics, robustness, select, states, validate
from ..plans import reports, runs
from ..schemas import CONFIG_FIELDS, PREDICTION
from ..sources import converters, parts, readers, sinks, suites
from ..sources.shared import local_path, shared_path
from ..streaming.scoring import score_stream, scored_stream, stream_errors
from . import fixtures as X
from .fixtures import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
PLACES = 6


def query(f):
    @wraps(f)
    def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(spark, sf_dir)
        return out.select(*[F.round(c, PLACES).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])

    QUERIES[f.__name__] = rounded
    return rounded


def _scored(spark, d, shift=0):
    return metrics.scored(*X.gold_and_predictions(X.order_rows(spark, d, shift)))


def _mixed(spark, d):
    rows = X.embedding_rows(spark, d)
    return metrics.scored(rows.select(*X.GOLD), X.mixed_predictions(rows))


BASE = ["rows", "correct_predictions", "valid_predictions", "coverage", "accuracy", "nll", "brier"]


@query
def summary_overall(spark, d):
    return metrics.summary(_scored(spark, d)).select(*BASE, "latency_p50", "latency_p95", "latency_total", "decisions_per_second", "input_tokens_mean", "input_tokens_p50")


@query
def summary_by_dataset(spark, d):
    return metrics.summary(_scored(spark, d), ["dataset"]).select("dataset", *BASE, "latency_p95", "input_tokens_mean")


@query
def summary_grouping_sets(spark, d):
    return metrics.summary_all(_scored(spark, d)).select("dataset", "overall", *BASE)


@query
def scored_rows(spark, d):
    return _scored(spark, d).select("id", "status", "prediction_id", "correct", "nll", "brier", "confidence", "bin")


@query
def multiclass_scored(spark, d):
    rows = X.embedding_rows(spark, d)
    return metrics.scored(*X.gold_and_predictions(rows)).select("id", "prediction_id", "correct", "nll", "brier", "confidence")


@query
def softmax_rows(spark, d):
    return X.order_rows(spark, d).select("id", *[F.get("probabilities", F.lit(i)).alias(f"p{i}") for i in range(3)])


@query
def allowed_mass(spark, d):
    rows = X.embedding_rows(spark, d)
    return rows.select("id", S.allowed_mass(F.col("option_logits"), F.transform("embedding", lambda x: x.cast("double") * 10)).alias("mass"))


@query
def reliability_bins(spark, d):
    return metrics.reliability_bins(_scored(spark, d), ["dataset"])


@query
def ece_by_dataset(spark, d):
    return metrics.calibration_error(_scored(spark, d), ["dataset"])


@query
def ece_overall(spark, d):
    return metrics.calibration_error(_scored(spark, d))


@query
def confusion_counts(spark, d):
    return metrics.confusion(_scored(spark, d), ["dataset"])


@query
def class_counts(spark, d):
    return metrics.class_counts(_mixed(spark, d))


@query
def macro_f1_by_dataset(spark, d):
    return metrics.gated_macro_f1(_scored(spark, d), X.PRIORITIES[:4])


@query
def binary_macro_f1(spark, d):
    both = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    given = F.when(F.col("n_chars") > 1000, "1").otherwise("0")
    rows = both.select(F.col("quality").cast("string").alias("label"), given.alias("prediction_id"), F.array(F.lit("0"), F.lit("1")).alias("option_ids"))
    return metrics.macro_f1(rows.withColumn("correct", F.col("label") == F.col("prediction_id")))


@query
def latency_percentiles(spark, d):
    return metrics.exact_percentiles(table(spark, d, "events"), "value", [0.5, 0.95], ["event_type"])


@query
def throughput(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.sum("value").alias("total"), F.try_divide(F.count("value"), F.nullif(F.sum("value"), F.lit(0.0))).alias("per_second"), F.percentile("value", 0.5).alias("p50"))


@query
def prediction_validity(spark, d):
    return _mixed(spark, d).select("id", "status", "error")


@query
def validity_counts(spark, d):
    return _mixed(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query
def partial_summary(spark, d):
    """Losses are null, as some rows are not ok."""
    return metrics.summary(_mixed(spark, d)).select(*BASE)


@query
def full_record(spark, d):
    rows = metrics.full_record(_scored(spark, d))
    return rows.select("dataset", "rows", "accuracy", "ece_10_bin", F.size("reliability_bins").alias("bins"))


@query
def row_validity(spark, d):
    rows = X.order_decisions(spark, d)
    k = F.col("ordinal")
    broken = rows.withColumns({
        "question": F.when(k % 7 == 0, "").otherwise(F.col("question")), "label": F.when(k % 11 == 0, "X").otherwise(F.col("label")), "state_json": F.when(k % 13 == 0, "{}").otherwise(F.col("state_json")),
        "options": F.when(k % 17 == 0, F.slice("options", 1, 1)).when(k % 19 == 0, F.concat("options", F.slice("options", 1, 1))).otherwise(F.col("options"))})
    return broken.select("id", validate.row_reason().alias("reason"))


@query
def manifest_validity(spark, d):
    k = F.col("p_partkey")
    gguf = F.struct(F.lit("r").alias("repository"), F.substring(F.sha2(k.cast("string"), 256), 1, 40).alias("revision"), F.lit("f").alias("filename"), F.when(k % 11 == 0, 0).otherwise(k + 1).alias("bytes"), F.when(k % 13 == 0, "x").otherwise(F.sha2(k.cast("string"), 256)).alias("sha256"), F.lit("q").alias("quantization"))
    rows = table(spark, d, "part").select(F.col("p_name").alias("id"), F.col("p_brand").alias("family"), F.lit("u").alias("upstream"), F.lit("l").alias("license"), (F.col("p_size") / 10).alias("parameters_billion"), F.when(k % 2 == 0, "effective").alias("parameter_basis"), (F.col("p_size") / 20).alias("effective_parameters_billion"), F.lit(None).cast("string").alias("upstream_revision"), F.when(k % 7 == 0, 0).otherwise(4096).alias("benchmark_context_tokens"), F.struct(F.when(k % 5 == 0, "odd").otherwise("verified").alias("status"), F.lit("d").alias("detail")).alias("alias_compatibility"), gguf.alias("gguf"), k.alias("partkey"))
    return rows.select("partkey", validate.manifest_reason().alias("reason"))


@query
def missing_predictions(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", F.lit(1).alias("there"))
    return docs.join(labels, "doc_id", "left").select("doc_id", F.when(F.col("there").isNull(), "missing").otherwise("ok").alias("status"))


@query
def unknown_predictions(spark, d):
    shifted = table(spark, d, "labels").select((F.col("doc_id") + 500).alias("doc_id"))
    return joins.unknown_ids(shifted, table(spark, d, "documents"), "doc_id")


@query
def unknown_sample(spark, d):
    shifted = table(spark, d, "labels").select((F.col("doc_id") + 500).alias("doc_id"))
    return joins.unknown_ids(shifted, table(spark, d, "documents"), "doc_id", 5)


@query
def pending_rows(spark, d):
    return joins.pending(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


@query
def of_dataset(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("dataset"))
    return joins.of_dataset(table(spark, d, "labels").select("doc_id", "quality"), docs, "fr", "doc_id")


@query
def collect_errors(spark, d):
    found = metrics.errors(_mixed(spark, d), "ordinal")
    return found.select(F.size("errors").alias("n"), F.array_join(F.transform("errors", lambda x: F.concat_ws(":", x["id"], x["status"], F.coalesce(x["error"], F.lit("-")))), ";").alias("errors"))


@query
def balanced_first_n(spark, d):
    return select.balanced_first_n(table(spark, d, "documents"), "lang", 10, "doc_id", ["fr", "en", "es", "de"]).select("doc_id", "lang", "class_rank", "rank")


@query
def balanced_two_level(spark, d):
    return select.balanced_first_n(table(spark, d, "documents"), "lang", 2, "doc_id", ["de", "en"], within=["source"], strict=False).select("source", "lang", "doc_id", "rank")


@query
def first_per_class(spark, d):
    rules = [(t, F.col("event_type") == t) for t in ("purchase", "click", "view", "signup", "error")]
    return select.first_per_selector(table(spark, d, "events").select("event_id", "event_type", "user_id"), rules, "event_id")


@query
def head_per_tier(spark, d):
    return select.head_per_tier(table(spark, d, "events").select("event_id", "event_type"), "event_type", ["view", "error", "click"], 10, "event_id").select("event_id", "event_type", "class_rank", "rank")


@query
def selection_ordinal(spark, d):
    chosen = select.balanced_first_n(table(spark, d, "documents").select("doc_id", "lang"), "lang", 5, "doc_id", ["es", "fr"])
    return select.with_ordinal(chosen, ["class_rank", "rank"]).select("doc_id", "lang", F.col("position").cast("long").alias("position"))


def _bases(spark, d):
    """Every document as a case, one without a text or a source too."""
    options = F.array(*[F.struct(F.lit(x).alias("id"), F.lit(f"It is {x}.").alias("description")) for x in ("yes", "no", "insufficient")])
    q = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select(q.alias("id"), F.lit("Is it so?").alias("question"), F.lit("Does it hold?").alias("reworded_question"), F.col("text").alias("state"), F.lit("Nothing is known.").alias("missing_state"), F.col("source").alias("irrelevant_context"), options.alias("options"), F.when(F.col("doc_id") % 2 == 0, "yes").otherwise("no").alias("label"), F.col("lang").alias("family"), F.lit("r").alias("rationale"), F.lit("m").alias("missing_rationale"), F.lit("s").alias("evidence_span"), F.lit("n").alias("missing_evidence_span"), F.lit("ok").alias("review_status"), F.col("doc_id").alias("ordinal"))


@query
def variant_expansion(spark, d):
    rows = converters.expand_variants(_bases(spark, d), None, strict=False)
    return rows.select("id", "ordinal", "label", "question", F.array_join("option_ids", ",").alias("option_ids"), F.length("state_json").alias("state_length"), F.col("provenance.variant").alias("variant"), F.col("provenance.rationale").alias("rationale"))


@query
def pivot_variants(spark, d):
    rows = converters.expand_variants(_bases(spark, d), None, strict=False).withColumn("variant", F.col("provenance.variant"))
    wide = select.pivot_variants(rows, "group_id", "variant", converters.VARIANTS, "ordinal", ["id", "label"])
    return wide.select("group_id", F.col("original.label").alias("label"), F.col("missing_evidence.label").alias("missing_label"), F.col("option_reversal.id").alias("reversed_id"))


def _variants(spark, d):
    return metrics.scored(*X.variant_rows(spark, d))


@query
def pair_flips(spark, d):
    return robustness.pairs(_variants(spark, d)).groupBy("variant").agg(F.count("*").alias("pairs"), F.count_if("flip").alias("flips"))


@query
def probability_movement(spark, d):
    moved = robustness.pairs(_variants(spark, d)).select("variant", F.explode("moved").alias("m"))
    return moved.groupBy("variant").agg(F.avg("m").alias("movement"))


@query
def missing_evidence_error(spark, d):
    rows = _variants(spark, d).where("variant = 'missing_evidence'")
    return rows.agg(F.count("*").alias("rows"), F.avg((~F.col("correct")).cast("double")).alias("error_rate"))


@query
def robustness_summary(spark, d):
    return robustness.robustness(_variants(spark, d))


@query
def render_prompt(spark, d):
    return X.order_decisions(spark, d).select("id", S.render_plain(F.col("state_json"), F.col("question"), F.col("options")).alias("prompt"))


@query
def prompt_hash(spark, d):
    rows = X.order_decisions(spark, d)
    return rows.select("id", S.prompt_record(S.render_plain(F.col("state_json"), F.col("question"), F.col("options"))).alias("r")).select("id", "r.version", "r.sha256")


@query
def chat_messages(spark, d):
    rows = X.order_decisions(spark, d)
    return rows.select("id", S.chat_messages(F.col("state_json"), F.col("question"), F.col("options")).alias("m")).select("id", F.get("m", F.lit(0))["content"].alias("system"), F.get("m", F.lit(1))["content"].alias("user"))


@query
def label_options(spark, d):
    return X.order_decisions(spark, d).select("id", F.array_join(F.transform(S.labelled(F.col("options")), lambda o: F.concat(o["label"], F.lit("="), o["description"])), "|").alias("labelled"))


@query
def describe_identifier(spark, d):
    name = F.concat_ws("_", F.lit(" Refund"), "p_brand", F.lit("NOT?"), "p_type")
    return table(spark, d, "part").select("p_partkey", S.describe_identifier(name).alias("description"))


@query
def text_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", S.text_hash(F.col("text")).alias("sha256"))


@query
def canonical_json(spark, d):
    text = F.concat(F.lit('{"z": 1, "a": {"y": [1, 2], "b": "é"}, "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return table(spark, d, "events").select("event_id", S.canonical_json(F.parse_json(text)).alias("json"))


@query
def spaced_json(spark, d):
    text = F.concat(F.lit('{"a":"x, \\"y\\": z","n":['), F.col("user_id").cast("string"), F.lit(',2],"o":{"p":null}}'))
    return table(spark, d, "events").select("event_id", S.spaced_json(text).alias("json"))


@query
def value_remap(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.remap(F.col("o_orderstatus"), {"F": "supported", "O": "insufficient", "P": "contradicted"}).alias("label"), S.remap(F.col("o_orderpriority"), {"5-LOW": "low"}, strict=False).alias("priority"))


@query
def reverse_options(spark, d):
    return X.order_decisions(spark, d).select("id", F.array_join(F.transform(F.reverse("options"), lambda o: o["id"]), ",").alias("reversed"))


@query
def coalesce_group(spark, d):
    group = F.when(F.col("o_orderstatus") == "P", "").when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", S.first_filled(group, F.col("o_orderkey").cast("string")).alias("group_id"))


@query
def zip_options(spark, d):
    p = table(spark, d, "part")
    zipped = S.zip_options(F.array("p_brand", "p_type", F.lit("x")), F.array("p_name", F.col("p_size").cast("string")))
    return p.select("p_partkey", F.array_join(F.transform(zipped, lambda o: F.concat(o["id"], F.lit(":"), o["description"])), "|").alias("options"))


@query
def criteria_lookup(spark, d):
    criteria = F.create_map(F.lit("true"), F.lit("It holds."), F.lit("2-HIGH"), F.lit("High."))
    label = F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "P", "no_answer").otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", S.criteria_description(criteria, label).alias("description"))


@query
def path_slashes(spark, d):
    return table(spark, d, "pages").select("page_id", S.forward_slashes(F.translate("url", "/", "\\")).alias("path"))


@query
def number_format(spark, d):
    return table(spark, d, "events").select("event_id", S.number_text(F.when(F.col("event_type") != "error", F.col("value"))).alias("text"))


def _sources(spark, d):
    return joins.in_order([
        table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("kind")),
        table(spark, d, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("role").alias("kind")),
        table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind")),
    ])


@query
def union_sources(spark, d):
    return _sources(spark, d)


@query
def source_counts(spark, d):
    return converters.source_counts(_sources(spark, d))


@query
def duplicate_ids(spark, d):
    return validate.duplicates(_sources(spark, d))


@query
def set_difference(spark, d):
    return joins.difference(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query
def set_equality(spark, d):
    return joins.set_comparison(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query
def key_subset(spark, d):
    keys = F.array("event_type", F.lit("view"))
    return table(spark, d, "events").select("event_id", F.array_join(joins.missing_keys(["click", "view", "error"], keys), ",").alias("missing"))


@query
def derive_subset(spark, d):
    whole = table(spark, d, "documents").select("doc_id", "lang", "source")
    changed = F.when(F.col("doc_id") % 9 == 0, "xx").otherwise(F.col("lang"))
    return joins.changed_rows(whole.where("doc_id % 3 = 0").withColumn("lang", changed), whole, ["lang", "source"], "doc_id")


@query
def correction_map(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    recorded = docs.withColumn("source_row", F.when(F.col("doc_id") % 10 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 1))
    return joins.correction_map(recorded, docs.withColumn("source_row", F.col("doc_id")), "doc_id", "source_row", "text", "lang")


def _runs(spark, d):
    each = [metrics.summary(_scored(spark, d, shift), ["dataset"]).select(F.lit(f"model-{i}").alias("model_id"), F.lit("complete").alias("status"), "dataset", *BASE) for i, shift in ((0, 0), (1, 5), (3, 11))]
    return each[0].unionByName(each[1]).unionByName(each[2])


def _models(spark):
    return spark.range(4).select(F.concat(F.lit("model-"), F.col("id").cast("string")).alias("model_id"))


@query
def comparison_report(spark, d):
    return joins.models_and_runs(_models(spark), _runs(spark, d))


@query
def report_lines(spark, d):
    """The table of a report as text."""
    rows = joins.models_and_runs(_models(spark), _runs(spark, d))
    line = F.format_string("| %s | %s | %d / %d | %s | %s |", "model_id", "dataset", "correct_predictions", "rows", S.number_text(F.col("coverage")), S.number_text(F.col("accuracy")))
    return rows.select("model_id", "dataset", F.when(F.col("status") == "not_run", F.format_string("| %s | Not run | n/a | n/a | n/a |", "model_id")).otherwise(line).alias("line"))


@query
def not_run_models(spark, d):
    runs = table(spark, d, "nation").select(F.concat(F.lit("model-"), F.col("n_nationkey").cast("string")).alias("model_id"), F.lit("complete").alias("status")).where("model_id < 'model-20'")
    models = spark.range(30).select(F.concat(F.lit("model-"), F.col("id").cast("string")).alias("model_id"))
    return joins.models_and_runs(models, runs)


@query
def hidden_runs(spark, d):
    n = table(spark, d, "nation")
    report = n.select(F.col("n_name").alias("model_id"), F.col("n_regionkey").cast("string").alias("benchmark_sha256"), F.when(F.col("n_nationkey") % 2 == 0, "not_run").otherwise("complete").alias("status"))
    runs = n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("model_id"), F.col("n_regionkey").cast("string").alias("benchmark_sha256"))
    return joins.hidden_runs(report, runs)


@query
def matching_runs(spark, d):
    s = table(spark, d, "supplier")
    runs = s.select(F.col("s_name").alias("model_id"), F.sha2("s_name", 256).alias("gguf_sha256"), F.col("s_suppkey").alias("gguf_bytes"))
    pinned = s.select(F.col("s_name").alias("model_id"), F.sha2("s_name", 256).alias("gguf_sha256"), F.when(F.col("s_suppkey") % 4 == 0, -1).otherwise(F.col("s_suppkey")).alias("gguf_bytes"))
    return joins.matching_runs(runs, pinned)


@query
def config_mismatch(spark, d):
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))

    def model(threads):
        from ..schemas import MODEL

        given = {"id": F.lit("m"), "threads": threads}
        return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in MODEL.fields])

    rows = e.select("event_id", model(F.col("k") % 3).alias("a"), model(F.when(F.col("k") % 3 != 2, F.col("k") % 2)).alias("b"))
    return rows.select("event_id", validate.configuration_differs("a", "b").alias("differs"))


@query
def convert_passages(spark, d):
    """Yes and no questions about documents, the first ten of each answer."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("text").alias("passage"), F.lit("Is it good?").alias("question"), (F.col("quality") == 1).alias("answer"), F.col("doc_id").alias("source_row"))
    out = converters.boolq(rows, 3)
    return out.select("id", "ordinal", "group_id", "label", F.array_join("option_ids", ",").alias("option_ids"), F.col("provenance.source_row").alias("source_row"))


@query
def convert_intents(spark, d):
    """Documents by language as intents, the first five of each."""
    rows = table(spark, d, "documents").select("text", F.col("lang").alias("category"), F.col("doc_id").alias("source_row"))
    out = converters.banking77(rows, ["en", "de", "fr", "es"], 5)
    return out.select("id", "ordinal", "group_id", "label", F.array_join(F.transform("options", lambda o: o["description"]), ",").alias("descriptions"), F.col("provenance.source_row").alias("source_row"))


@query
def convert_relations(spark, d):
    """Orders as relations: a structured state, three classes."""
    gold = S.remap(F.col("o_orderstatus"), {"F": "entailment", "O": "neutral", "P": "contradiction"})
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("pairID"), F.col("o_orderpriority").alias("premise"), F.col("o_orderstatus").alias("hypothesis"), gold.alias("gold"), F.col("o_orderkey").alias("ordinal"))
    out = converters.wanli(rows, 20)
    return out.select("id", "ordinal", "group_id", "state_json", "label")


@query
def convert_locales(spark, d):
    """Documents by source and language as locales and intents, the first two of each."""
    rows = table(spark, d, "documents").select(F.lit("all").alias("locale"), F.col("doc_id").alias("id"), F.lit("test").alias("partition"), F.col("lang").alias("intent"), F.col("source").alias("utt"), F.col("doc_id").alias("line"))
    out = converters.massive(rows, ["all"], ["fr", "de", "en", "es"])
    return out.select("id", "ordinal", "group_id", "state_json", "label", F.col("provenance.locale").alias("locale"))


@query
def convert_domains(spark, d):
    """Parts by brand as domains, the first two of each or the one there is."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("question_id"), F.col("p_brand").alias("category"), F.col("p_name").alias("question"), F.array("p_type", F.col("p_size").cast("string"), F.lit("none")).alias("options"), (F.col("p_partkey") % 3).alias("answer_index"), F.col("p_partkey").alias("source_row"))
    return converters.mmlu_pro(rows, 2, strict=False).select("id", "group_id", "label", F.array_join(F.transform("options", lambda o: F.concat(o["id"], F.lit("="), o["description"])), "|").alias("options"))


def _tiers(spark, d):
    e = table(spark, d, "events")
    listed = F.when(F.col("event_type") == "error", F.array(F.lit("It is."), F.lit("It is not.")))
    rows = e.select(F.col("event_type").alias("split"), F.col("event_id").cast("string").alias("id"), F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("user_id").cast("string")).alias("group"), F.lit("f").alias("family"), F.col("props").alias("state_json"), F.lit("Is it?").alias("instructions"), F.array(F.lit("yes"), F.lit("not_so")).alias("labels"), F.create_map(F.lit("true"), F.lit("So it is.")).alias("criteria"), listed.alias("criteria_list"), F.lit("yes").alias("expected"), F.col("event_id").alias("ordinal"))
    return converters.jevbench(rows, None)


@query
def convert_tiers(spark, d):
    """Events as rows of tiers, with criteria by label or in a list."""
    out = _tiers(spark, d)
    return out.select("id", "dataset", "group_id", F.array_join(F.transform("options", lambda o: o["description"]), "|").alias("descriptions"))


# sources and sinks: a table is written and read again

@query
def jsonl_round_trip(spark, d):
    """Create-only JSON Lines, read by a given schema."""
    path = shared_path(spark, "jsonl")
    sinks.write_jsonl(table(spark, d, "documents").select("doc_id", "text", "lang"), path)
    return readers.read_jsonl(spark, path, table(spark, d, "documents").select("doc_id", "text", "lang").schema).drop("ordinal")


def _gold_file(spark, d) -> str:
    """The order decisions as JSON Lines, in order: part files whose names and lines go up."""
    path = shared_path(spark, "gold")
    o = X.order_decisions(spark, d)
    rows = o.select("id", "dataset", "group_id", F.parse_json("state_json").alias("state"), "question", "options", "label", "ordinal")
    sinks.write_jsonl(rows, path, "ordinal")
    return path


@query
def decision_scan(spark, d):
    """Validated decisions with their place in the file, as a rank."""
    rows = readers.read_decisions(spark, _gold_file(spark, d))
    return select.with_place(rows).select("id", "dataset", "label", "state_json", F.size("option_ids").alias("n_options"), "place")


@query
def prediction_scan(spark, d):
    path = shared_path(spark, "predictions")
    sinks.append_jsonl(X.as_predictions(X.order_rows(spark, d)), path)
    return readers.read_predictions(spark, f"{path}/*.json").select("id", "prediction_id", F.array_max("probabilities").alias("confidence"), F.size("option_logits").alias("n"))


@query
def optional_scan(spark, d):
    """Predictions of some orders, and none where no file is."""
    path = shared_path(spark, "predictions")
    sinks.append_jsonl(X.as_predictions(X.order_rows(spark, d)).where("dataset = '1-URGENT'"), path)
    found, none = (readers.read_optional(spark, f"{path}/{x}") for x in ("*.json", "none*.json"))
    return found.select(F.lit("found").alias("of"), "id").union(none.select(F.lit("none"), "id")).groupBy("of").agg(F.count("*").alias("n"))


@query
def appended_progress(spark, d):
    """Two appends to one folder; an id that both hold stands twice."""
    path, rows = shared_path(spark, "progress"), X.as_predictions(X.order_rows(spark, d))
    for k in (0, 1):
        sinks.append_jsonl(rows.where(F.col("id").cast("long") % 3 != k), path)
    return validate.duplicates(spark.read.schema(PREDICTION).json(path))


@query
def csv_round_trip(spark, d):
    path = shared_path(spark, "csv")
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), F.concat(F.col("c_name"), F.lit(', "x"\n'), F.col("c_mktsegment")).alias("c_note"))
    sinks.write_csv(rows, path, ["c_custkey", "c_note"])
    return readers.read_csv(spark, path)


@query
def parquet_places(spark, d):
    return readers.read_parquet(spark, f"{d}/orders.parquet").select("o_orderkey", "source_row")


@query
def tar_members(spark, d):
    """Members of an archive, one for each region, with a line for each nation."""
    path = shared_path(spark, "archive")
    rows = table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("key"), F.to_json(F.struct("n_nationkey", "n_name")).alias("line")).orderBy("n_nationkey").collect()  # the 25 nations
    members: dict[str, str] = {}
    for r in rows:
        members[r["key"]] = members.get(r["key"], "") + r["line"] + "\n"
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as archive:
        for key, text in members.items():
            info = tarfile.TarInfo(f"data/{key}.jsonl")
            info.size = len(text)
            archive.addfile(info, io.BytesIO(text.encode()))
    folder = Path(local_path(path))
    folder.mkdir(parents=True)
    (folder / "nations.tar.gz").write_bytes(raw.getvalue())
    schema = table(spark, d, "nation").select("n_nationkey", "n_name").schema
    return readers.read_tar_jsonl(spark, path, {f"data/{k}.jsonl": k for k in members}, schema).withColumnRenamed("line", "place")


def _documents(spark, d) -> Path:
    """A JSON document for each region in a folder of its own name, and the record of their checksums."""
    folder = Path(local_path(shared_path(spark, "objects")))
    for r in table(spark, d, "region").orderBy("r_regionkey").collect():  # the 5 regions
        (folder / r["r_name"]).mkdir(parents=True)
        sinks.replace_json(folder / f"{r['r_name']}.json", {"r_regionkey": -1})
        sinks.replace_json(folder / f"{r['r_name']}.json", {"r_regionkey": r["r_regionkey"], "r_name": r["r_name"]})
    sinks.write_checksums(folder, sorted(p.name for p in folder.glob("*.json")))
    return folder


@query
def object_scan(spark, d):
    """JSON documents, replaced once, one a row."""
    folder = _documents(spark, d)
    return readers.read_objects(spark, f"file:{folder}/*.json", table(spark, d, "region").select("r_regionkey", "r_name").schema).drop("file")


@query
def directory_listing(spark, d):
    names = readers.directories(_documents(spark, d))
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "place long, r_name string")


@query
def checksum_record(spark, d):
    """Files whose hash differs from the record, after the text of two has changed: one row each."""
    folder = _documents(spark, d)
    sinks.verify_checksums(folder)
    for name in ("ASIA", "EUROPE"):
        sinks.replace_json(folder / f"{name}.json", {"r_name": name})
    recorded = spark.createDataFrame(list(sinks.recorded_checksums(folder).items()), "name string, recorded string")
    actual = readers.file_hashes(spark, f"file:{folder}/*.json").select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    return sinks.checksum_mismatches(recorded, actual).select("name")


@query
def obtained_files(spark, d):
    """A file is fetched into a cache, found there again, and refused when its hash differs."""
    folder = _documents(spark, d)
    out = []
    for path in sorted(folder.glob("*.json")):
        record = readers.Recorded(readers.file_hash(path), path.stat().st_size)
        for said, wanted in (("fetched", record), ("cached", record), ("other", readers.Recorded("0" * 64))):
            try:
                out.append((path.stem, said, readers.file_hash(readers.obtain(folder / "cache" / path.name, path.as_uri(), wanted)) == record.sha256))
            except readers.SourceError:
                out.append((path.stem, "refused", False))
    return spark.createDataFrame(out, "r_name string, step string, same boolean")


# Two published chat templates.
TURNS_TEMPLATE = """{% for message in messages %}{{'<|im_start|>' + message['role'] + '\\n' + message['content'] + '<|im_end|>' + '\\n'}}{% endfor %}{% if add_generation_prompt %}{{ '<|im_start|>assistant\\n' }}{% endif %}"""
INST_TEMPLATE = (
    "{% if messages[0]['role'] == 'system' %}{% set loop_messages = messages[1:] %}{% set system_message = messages[0]['content'] %}{% else %}{% set loop_messages = messages %}{% set system_message = false %}{% endif %}"
    "{% for message in loop_messages %}{% if loop.index0 == 0 and system_message != false %}{% set content = '<<SYS>>\\n' + system_message + '\\n<</SYS>>\\n\\n' + message['content'] %}{% else %}{% set content = message['content'] %}{% endif %}"
    "{% if message['role'] == 'user' %}{{ bos_token + '[INST] ' + content.strip() + ' [/INST]' }}{% elif message['role'] == 'assistant' %}{{ ' ' + content.strip() + ' ' + eos_token }}{% endif %}{% endfor %}"
)


@query
def chat_templates(spark, d):
    """Conversations rendered by two templates, of which one gives the first message another place if it is the system's."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.struct(F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("content")).alias("message"))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "message"))).alias("l"))
    messages = listed.select("conv_id", F.transform("l", lambda x: x["message"]).alias("messages"))
    out = [templates.compiled(t, F.col("messages"), bos_token="<s>", eos_token="</s>") for t in (TURNS_TEMPLATE, INST_TEMPLATE)]
    return messages.select("conv_id", *[F.sha2(x, 256).alias(f"{name}_sha256") for name, x in zip(("turns", "inst"), out, strict=True)])


@query
def digest_difference(spark, d):
    """Which orders differ between the table and a copy in which some are missing, some new and some have another price."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    other = o.where(k % 501 != 7).withColumn("o_totalprice", F.when(k % 1001 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    other = other.unionByName(o.where(k % 2003 == 5).withColumn("o_orderkey", -k))
    paths = [shared_path(spark, f"orders-{name}") for name in ("first", "second")]
    for rows, path in zip((o, other), paths, strict=True):
        digests.save(rows, path, ["o_orderkey"])
    return digests.difference(spark, *paths, ["o_orderkey"])


@query
def core_suite(spark, d):
    """A suite of two sources written and read again: what each dataset has, and where it begins."""
    gold = S.remap(F.col("o_orderstatus"), {"F": "entailment", "O": "neutral", "P": "contradiction"})
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("pairID"), F.col("o_orderpriority").alias("premise"), F.col("o_orderstatus").alias("hypothesis"), gold.alias("gold"), F.col("o_orderkey").alias("ordinal"))
    out = shared_path(spark, "suite")
    suites.build_core({"wanli": converters.wanli(o, 20), "jevbench": _tiers(spark, d)}, out)
    placed = select.with_place(readers.read_decisions(spark, out))
    return placed.groupBy("dataset").agg(F.count("*").alias("n"), F.min("place").alias("first"))


@query
def model_files(spark, d):
    """Files of orders by the last digit of their key, as models' files, against manifests of which two are of other files and one of none."""
    path = shared_path(spark, "models")
    o = table(spark, d, "orders").withColumn("digit", F.col("o_orderkey") % 10)
    o.repartition("digit").write.partitionBy("digit").json(path)
    files = {r["digit"]: r["file"] for r in spark.read.json(path).select("digit", F.col("_metadata.file_path").alias("file")).groupBy("digit").agg(F.min("file").alias("file")).collect()}  # the ten files
    names = {k: f"digit={k}/{f.rpartition('/')[2]}" for k, f in files.items()}
    hashes = {"/".join(r["path"].split("/")[-2:]): r for r in readers.file_hashes(spark, f"{path}/*/*.json").collect()}
    manifests = {}
    for k, name in names.items():
        own, other = hashes[name], hashes[names[(k + 1) % 10]]
        size, sha256 = (other if k == 3 else own)["bytes"], (other if k in (3, 4) else own)["sha256"]
        manifests[f"model-{k}"] = {"gguf": {"filename": "none" if k == 7 else name, "bytes": size, "sha256": sha256}}
    wrong = reports.model_problems(spark, path.removeprefix("file://").removeprefix("file:"), manifests)
    wrong = wrong.select("name", F.regexp_replace("reason", "^has [0-9]+ bytes.*", "has other bytes").alias("reason"))
    n = o.groupBy(F.concat(F.lit("model-"), F.col("digit")).alias("name")).agg(F.count("*").alias("n"))
    return n.join(wrong, "name", "left").select("name", "n", F.coalesce("reason", F.lit("holds")).alias("reason"))


@query
def alias_check(spark, d):
    """Labels after the names of parts, whose words are the pieces: one label is no piece, two have the same, and one is joined to words of some lengths."""
    words = F.split("p_name", " ")
    pieces = F.concat(F.slice(words, 1, 1), F.transform(F.slice(words, 2, 99), lambda w: F.concat(F.lit(" "), w)))
    contexts = table(spark, d, "part").select(F.col("p_partkey").alias("context"), pieces.alias("pieces"))
    own = contexts.select(F.explode("pieces").alias("piece")).distinct()
    joined = own.where(F.length("piece") % 3 == 0).select(F.concat("piece", F.lit("B")).alias("piece"))
    single = spark.createDataFrame([("A", 1), ("B", 2), ("C", 1)], "piece string, id long")
    vocabulary = own.unionByName(joined).withColumn("id", F.xxhash64("piece")).unionByName(single)
    labels = contexts.select("context", F.explode(F.array(*map(F.lit, "ABCZ"))).alias("label"))
    return aliases.alias_problems(contexts, labels, vocabulary)


# runs

MODEL = {c: None for c in CONFIG_FIELDS} | {"id": "model-0", "gguf_sha256": "0" * 64, "gguf_bytes": 1, "threads": 4, "prompt_version": "choice-v1"}


class _OrderScorer(runs.LogitScorer):
    """Scores the order decisions by the logits of the derived orders."""

    def __init__(self, spark, d, shift=0, every=1, model=MODEL):
        logits = X.order_rows(spark, d, shift).where(F.col("ordinal") % every != every - 1 if every > 1 else F.lit(True))
        measured = {"alias_token_ids": F.array(*[F.lit(x).cast("long") for x in (1, 2, 3)]), "forward_seconds": F.col("total_seconds") / 2, "peak_process_rss_bytes": F.col("ordinal") * 1024, "allowed_token_mass": (F.col("ordinal") % 100) / 100.0}
        super().__init__(logits.select(F.concat(F.lit("orders/"), "id").alias("id"), "option_logits", "total_seconds", "input_tokens", *[x.alias(n) for n, x in measured.items()]), model)


def _as_rows(spark, report: dict):
    rows = [(m["model_id"], m["status"], name, x["rows"], x["valid_predictions"], x["correct_predictions"], x["accuracy"], x["macro_f1"], x["nll"], x["ece_10_bin"]) for m in report["models"] for name, x in (m.get("datasets") or {None: dict.fromkeys(("rows", "valid_predictions", "correct_predictions", "accuracy", "macro_f1", "nll", "ece_10_bin"))}).items()]
    return spark.createDataFrame(rows, "model_id string, status string, dataset string, rows long, valid_predictions long, correct_predictions long, accuracy double, macro_f1 double, nll double, ece_10_bin double")


def _gold_folder(spark, d, path: str, only: Column | None = None) -> str:
    """The decisions, or some, as compressed part files in order."""
    o = X.order_decisions(spark, d)
    o = o if only is None else o.where(only)
    fields = ["id", "dataset", "group_id", F.parse_json("state_json").alias("state"), "question", "options", "label", "ordinal"]
    sinks.write_jsonl(o.select(*fields), path, "ordinal", compression="gzip")
    return path


RUN = (
    "dataset string, rows long, valid_predictions long, correct_predictions long, coverage double, accuracy double, errors long, latency_p95 double, mass_mean double, mass_p50 double, "
    "rss_max double, input_tokens_p50 double"
)


def _run_rows(spark, found: dict):
    """A row for each dataset of a run's summary, and for all."""
    columns = ["rows", "valid_predictions", "correct_predictions", "coverage", "accuracy"]
    rows = []
    for name, x in (found["datasets"] | {"all": found["overall"]}).items():
        failed = len(x["errors"]) + x.get("errors_not_listed", 0)
        mass, memory = x["allowed_token_mass"], float(x["peak_process_rss_bytes"]["max"])
        rows.append((name, *(x[c] for c in columns), failed, x["latency_seconds"]["p95"], mass["mean"], mass["p50"], memory, x["input_tokens"]["p50"]))
    return spark.createDataFrame(rows, RUN)


@query
def scored_run(spark, d):
    """A run in two goes, the second after the first had scored a part, verified; every seventh decision has no scores."""
    folder = Path(local_path(shared_path(spark, "run")))
    gold, scorer = _gold_folder(spark, d, str(folder / "gold")), _OrderScorer(spark, d, every=7)
    rows = readers.read_decisions(spark, gold)
    benchmark = {"path": gold, "sha256": parts.content_hashes(spark, [gold])[gold], "rows": rows.count()}
    manifest = {"schema_version": 2, "summary_version": 2, "status": "incomplete", "benchmark": benchmark, "model": MODEL, "environment": {}}
    (folder / "run").mkdir()
    sinks.replace_json(folder / "run" / "manifest.json", manifest)
    parts.append_parts(scorer.score(rows.where("dataset = '1-URGENT'")), str(folder / "run"), compressed=True)
    runs.run_benchmark(spark, gold, folder / "run", scorer, compressed=True)
    return _run_rows(spark, runs.verify_run(spark, folder / "run", gold)[1])


@query
def published_comparison(spark, d):
    """A run derived for a subset, another of the subset itself, their comparison with a model that has none, and the check of the catalogue."""
    root = Path(local_path(shared_path(spark, "publication")))
    gold = _gold_folder(spark, d, str(root / "gold"))
    subset = _gold_folder(spark, d, str(root / "subset"), F.col("group_id").cast("long") % 2 == 0)
    pinned = {f"model-{k}": {"id": f"model-{k}", "gguf": {"sha256": "0" * 64, "bytes": 1}} for k in (0, 1)}
    runs.run_benchmark(spark, gold, root / "runs" / "model-0", _OrderScorer(spark, d), compressed=True)
    runs.derive_run(spark, root / "runs" / "model-0", subset, root / "derived" / "model-0", compressed=True)
    runs.run_benchmark(spark, subset, root / "derived" / "model-1", _OrderScorer(spark, d, 5, model=MODEL | {"id": "model-1"}), compressed=True)
    pinned["model-9"] = {"id": "model-9", "gguf": {"sha256": "0" * 64, "bytes": 1}}
    report = reports.create_comparison(spark, root / "derived", root / "draft", gold=subset, model_ids=sorted(pinned), manifests=pinned)
    for x in report["models"]:
        if "evidence" in x:
            x["evidence"]["run"] = f"derived/{x['model_id']}"
    reports.write_report(report, root / "report")
    reports.create_report(spark, gold, root / "runs" / "model-0", root / "one")
    suites = [{"gold": "gold", "runs": "runs", "models": ["model-0"]}, {"gold": "subset", "runs": "derived", "models": ["model-0", "model-1"]}]
    catalogue = {"frozen_files": {"gold": parts.content_hashes(spark, [gold])[gold]}, "suites": suites, "historical_reports": ["one"], "active_reports": ["report"]}
    counts = reports.verify_publication(spark, root, catalogue, pinned, set(pinned))
    return _as_rows(spark, report).drop("macro_f1", "ece_10_bin").withColumns({k: F.lit(v).cast("long") for k, v in counts.items()})


@query
def merged_states(spark, d):
    """The summary of each dataset and of all from the states of 16 parts: nothing but states is read for it. The masses are binary fractions, whose sums are exact in any order."""
    rows = X.order_rows(spark, d).withColumns({"allowed_token_mass": (F.col("ordinal") % 128) / 128.0, "peak_process_rss_bytes": F.col("ordinal") * 1024})
    split = metrics.scored(*X.gold_and_predictions(rows)).withColumn("part", F.col("ordinal") % 16)
    path = shared_path(spark, "states")
    states.state(split, ["part"]).write.parquet(path)
    columns = ["rows", "valid_predictions", "correct_predictions", "accuracy", "nll", "brier", "ece_10_bin", "latency_p50", "latency_p95", "mass_mean", "mass_p50", "rss_max", "rss_p50", "input_tokens_mean", "input_tokens_p50"]
    return states.summary_of(spark.read.parquet(path).drop("part")).select("dataset", *columns)


@query
def batch_scored(spark, d):
    """Decisions scored in batches by a Python function that fails for some: these alone become error rows."""

    def make():
        def score(batch: pa.RecordBatch) -> pa.Table:
            number = [int(x.rpartition("/")[2]) for x in batch.column("id").to_pylist()]
            odd = [k for k in number if k % 1000 == 7]
            if odd:
                raise ValueError(f"cannot score {odd[0]}")
            first = [k % 3 for k in number]
            return pa.table({"id": batch.column("id"), "prediction_id": [X.STATUSES[k] for k in first], "probabilities": [[0.5 if i == k else 0.25 for i in range(3)] for k in first]})

        return score

    decisions = X.order_decisions(spark, d).withColumn("option_ids", F.transform("options", lambda o: o["id"]))
    found = runs.BatchScorer(make, MODEL).score(decisions)
    return found.select("id", "dataset", "prediction_id", F.array_max("probabilities").alias("confidence"), F.concat_ws(": ", "error.type", "error.message").alias("error"))


@query
def run_consistency(spark, d):
    """Why rows of a run do not hold: foreign ids, other configurations, malformed errors, missing evidence."""
    rows = X.order_rows(spark, d)
    k = F.col("ordinal")
    model = runs.model_column(MODEL)
    other = runs.model_column(MODEL | {"threads": 8})
    given = X.as_predictions(rows.withColumns({
        "id": F.when(k % 11 == 0, F.concat(F.lit("x"), F.col("id"))).otherwise(F.col("id")), "model": F.when(k % 13 == 0, other).otherwise(model), "error": F.when(k % 7 == 0, F.struct(F.lit("E").alias("type"), F.when(k % 2 == 0, "m").alias("message"))),
        "probabilities": F.when((k % 7 != 0) | (k % 3 == 0), F.col("probabilities")), "prediction_id": F.when(k % 7 != 0, F.col("prediction_id")),
        "alias_token_ids": F.when(k % 5 == 0, F.array(*[F.lit(x).cast("long") for x in range(3)])), "prompt": S.prompt_record(F.col("id"), "choice-v1"), "forward_seconds": F.lit(0.0), "peak_process_rss_bytes": F.lit(1), "allowed_token_mass": F.lit(0.5)}))
    return runs.row_problems(rows.select(*X.GOLD), given, MODEL)


@query
def subset_predictions(spark, d):
    """The predictions of a run that a subset of its decisions needs, in the subset's order."""
    gold = X.order_rows(spark, d).where("dataset = '2-HIGH'").select("id", "ordinal")
    return X.as_predictions(X.order_rows(spark, d)).drop("ordinal").join(gold, "id").select("id", "ordinal", "prediction_id")


@query
def cardinality(spark, d):
    """The required count holds, or the selection fails."""
    n = table(spark, d, "nation")
    validate.require_count(n, 25, "nations")
    try:
        validate.require_count(n.where("n_regionkey = 1"), 25, "nations")
        said = ""
    except validate.ConstraintError as error:
        said = str(error)
    return n.agg(F.count("*").alias("n"), F.lit(said).alias("said"))


@query
def measurements(spark, d):
    """Mass, memory and token aggregates of each dataset, by the summary and by the form for many rows, which agree."""
    rows = X.order_rows(spark, d).withColumns({"allowed_token_mass": (F.col("ordinal") % 100) / 100.0, "peak_process_rss_bytes": F.col("ordinal") * 1024})
    scored = metrics.scored(*X.gold_and_predictions(rows))
    columns = ["latency_p50", "latency_p95", "mass_mean", "mass_p50", "rss_max", "rss_p50", "input_tokens_mean", "input_tokens_p50"]
    small, large = (f(scored, ["dataset"]).select("dataset", *columns) for f in (metrics.summary, metrics.large_summary))
    return large.withColumn("form", F.lit("large")).unionByName(small.withColumn("form", F.lit("small")))


@query
def streamed_scores(spark, d):
    """Decisions that arrive as files, some of them twice, each scored once."""
    gold, out = _gold_file(spark, d), shared_path(spark, "streamed")
    fields = "id string, dataset string, group_id string, state variant, question string, options array<struct<id: string, description: string>>, label string"
    urgent = spark.read.text(gold).where("value like '%URGENT%'").select(F.from_json("value", fields).alias("r")).select("r.*")
    sinks.append_jsonl(urgent, gold)
    score_stream(spark, gold, out, shared_path(spark, "stream"), _OrderScorer(spark, d)).awaitTermination()
    return scored_stream(spark, out).select("id", "prediction_id")


@query
def streamed_errors(spark, d):
    """What a stream says of decisions that the known table lacks; the others are scored."""
    gold, out = _gold_file(spark, d), shared_path(spark, "streamed")
    known = X.order_decisions(spark, d).where(F.col("ordinal") % 10 != 3)
    score_stream(spark, gold, out, shared_path(spark, "stream"), _OrderScorer(spark, d), known=known).awaitTermination()
    told = stream_errors(spark, out).groupBy("reason").agg(F.count("*").alias("n"))
    return told.unionByName(scored_stream(spark, out).agg(F.lit("scored").alias("reason"), F.count("*").alias("n")))
