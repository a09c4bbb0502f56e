"""Schemas of decisions, predictions and manifests, and the tolerances of their checks."""

from __future__ import annotations

from pyspark.sql import types as T

SUM_TOLERANCE = 1e-5
LOGIT_TOLERANCE = 1e-7
MASS_TOLERANCE = 1e-8
LEAST_PROBABILITY = 1e-12
LEAST_OPTIONS, MOST_OPTIONS = 2, 26
BINS = 10

# Datasets whose rows share one set of classes, and labels of options in order.
FIXED_CLASS_DATASETS = ["banking77-12-intent", "boolq-balanced", "wanli-balanced", "massive-5-language-12-intent"]
LABELS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OPTION = T.StructType([T.StructField("id", T.StringType()), T.StructField("description", T.StringType())])
OPTIONS = T.ArrayType(OPTION)

PROVENANCE = T.StructType([T.StructField(x, T.StringType()) for x in ("source", "revision", "dataset_version", "source_split", "source_id")] + [T.StructField("source_row", T.LongType())] + [T.StructField(x, T.StringType()) for x in ("locale", "category", "family", "variant", "parent_id", "rationale", "evidence_span", "review_status", "license", "selection")])

#: `state` is text, an object or an array: a variant. `state_json` is its JSON text with the keys in the given order.
DECISION = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("dataset", T.StringType()), T.StructField("group_id", T.StringType()),
    T.StructField("state", T.VariantType()), T.StructField("question", T.StringType()), T.StructField("options", OPTIONS),
    T.StructField("label", T.StringType()), T.StructField("provenance", PROVENANCE)])

ERROR = T.StructType([T.StructField("type", T.StringType()), T.StructField("message", T.StringType())])
PROMPT = T.StructType([T.StructField("version", T.StringType()), T.StructField("sha256", T.StringType()), T.StructField("text", T.StringType())])
# What two runs must share to be scored alike.
CONFIG_FIELDS = ["id", "gguf_sha256", "threads", "context_tokens", "n_gpu_layers", "chat_format", "prompt_rendering", "benchmark_date", "prompt_version", "instruction_sha256", "implementation_sha256"]
MODEL = T.StructType([T.StructField(x, T.LongType() if x in ("threads", "context_tokens", "n_gpu_layers") else T.StringType()) for x in CONFIG_FIELDS] + [T.StructField("gguf_file", T.StringType()), T.StructField("gguf_bytes", T.LongType())])

PREDICTION = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("dataset", T.StringType()), T.StructField("option_ids", T.ArrayType(T.StringType())),
    T.StructField("alias_token_ids", T.ArrayType(T.LongType())), T.StructField("option_logits", T.ArrayType(T.DoubleType())),
    T.StructField("probabilities", T.ArrayType(T.DoubleType())), T.StructField("prediction_id", T.StringType()),
    T.StructField("input_tokens", T.LongType()), T.StructField("allowed_token_mass", T.DoubleType()),
    T.StructField("full_vocab_argmax_id", T.LongType()), T.StructField("full_vocab_argmax_text", T.StringType()),
    T.StructField("forward_seconds", T.DoubleType()), T.StructField("total_seconds", T.DoubleType()),
    T.StructField("peak_process_rss_bytes", T.LongType()), T.StructField("prompt", PROMPT), T.StructField("model", MODEL), T.StructField("error", ERROR)])

# What a complete run holds, and what a scored row must carry as evidence.
RUN_FILES = ["manifest.json", "predictions.jsonl", "summary.json"]
EVIDENCE_FIELDS = ["dataset", "alias_token_ids", "option_logits", "prompt", "input_tokens", "total_seconds", "forward_seconds", "peak_process_rss_bytes", "allowed_token_mass"]
