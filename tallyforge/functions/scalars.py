"""Columns from columns: scoring, hashing, prompt text and small value rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import LABELS

# The instruction of a prompt.
INSTRUCTION = "Apply the question to the evidence. Choose exactly one listed option. Respond with only its option label."


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def canonical_json(value: Column) -> Column:
    """JSON with sorted keys and no blanks of a variant column."""
    return F.to_json(value)


def json_string(text: Column) -> Column:
    """A text as a JSON string, with its quotes."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def spaced_json(text: Column) -> Column:
    """Compact JSON with a blank after each comma and colon outside strings. A control character marks the places meanwhile, as JSON holds none."""
    marked = F.regexp_replace(text, r'("(?:[^"\\]|\\.)*+"|[^",:]++)([,:]?)', "$1$2\x01")
    return F.replace(F.regexp_replace(marked, "([,:])\x01", "$1 "), F.lit("\x01"), F.lit(""))


def describe_identifier(name: Column) -> Column:
    """Underscores to blanks, no question marks, the first letter large and all others small."""
    plain = F.trim(F.replace(F.translate(name, "_", " "), F.lit("?"), F.lit("")))
    return F.concat(F.upper(F.substring(plain, 1, 1)), F.lower(F.substring(plain, F.lit(2), F.length(plain))))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def softmax(logits: Column) -> Column:
    """Probabilities; null unless there are two logits at least and all are finite."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.when((F.size(logits) >= 2) & F.forall(logits, finite), F.transform(logits, lambda x: F.exp(x - top) / total))


def allowed_mass(logits: Column, vocabulary: Column) -> Column:
    """Share of the vocabulary's probability that falls on the options."""
    return F.exp(log_sum_exp(logits) - log_sum_exp(vocabulary))


def first_best(ids: Column, values: Column) -> Column:
    """The id at the first largest value."""
    return F.try_element_at(ids, F.array_position(values, F.array_max(values)).cast("int"))


def index_of(ids: Column, wanted: Column) -> Column:
    """Place from 1; 0 if it is not there."""
    return F.array_position(ids, wanted).cast("int")


def brier(probabilities: Column, gold: Column) -> Column:
    """gold: place from 1."""
    parts = F.transform(probabilities, lambda p, i: F.pow(p - F.when(i + 1 == gold, 1.0).otherwise(0.0), F.lit(2.0)))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def bin_of(confidence: Column, bins: int = 10) -> Column:
    """0..bins-1 by comparison with i/bins, so that no rounding moves an edge; 1 is in the last, above 1 in none."""
    edges = [i / bins for i in range(bins + 1)]
    rules = reduce(lambda when, i: when.when((confidence >= edges[i]) & (confidence < edges[i + 1]), i), range(1, bins), F.when((confidence >= edges[0]) & (confidence < edges[1]), 0))
    return rules.when(confidence == 1.0, bins - 1)


def labelled(options: Column) -> Column:
    """Options as (label, description), labelled A to Z in order."""
    return F.transform(options, lambda o, i: F.struct(F.substring(F.lit(LABELS), i + 1, F.lit(1)).alias("label"), o["description"].alias("description")))


def render_plain(state_json: Column, question: Column, options: Column) -> Column:
    """The prompt as plain text. state_json: the state as JSON text."""
    lines = F.array_join(F.transform(labelled(options), lambda o: F.concat(o["label"], F.lit(". "), o["description"])), "\n")
    return F.concat_ws("\n", F.lit(INSTRUCTION), F.lit(""), F.lit("Evidence:"), spaced_json(state_json), F.lit(""), F.lit("Question:"), question, F.lit(""), F.lit("Options:"), lines, F.lit(""), F.lit("Answer:"))


def chat_messages(state_json: Column, question: Column, options: Column) -> Column:
    """The prompt as a system and a user message, the latter a JSON object."""
    listed = F.array_join(F.transform(labelled(options), lambda o: F.concat(F.lit('{"label": "'), o["label"], F.lit('", "description": '), json_string(o["description"]), F.lit("}"))), ", ")
    body = F.concat(F.lit('{"evidence": '), spaced_json(state_json), F.lit(', "question": '), json_string(question), F.lit(', "options": ['), listed, F.lit("]}"))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(INSTRUCTION).alias("content")), F.struct(F.lit("user").alias("role"), body.alias("content")))


def prompt_record(text: Column, version: str = "choice-v1") -> Column:
    return F.struct(F.lit(version).alias("version"), text_hash(text).alias("sha256"), text.alias("text"))


def remap(value: Column, mapping: dict[str, str], strict: bool = True) -> Column:
    """The mapped value; an unknown one is an error, or itself if not strict."""
    known = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(known, value)
    if not strict:
        return F.coalesce(found, value)
    return F.when(value.isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown value: "), value)).cast("string"))


def zip_options(ids: Column, descriptions: Column) -> Column:
    """Options from two lists, as long as the shorter."""
    n = F.least(F.size(ids), F.size(descriptions))
    return F.transform(F.slice(ids, 1, n), lambda x, i: F.struct(x.alias("id"), F.get(descriptions, i).alias("description")))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in values[:-1]], values[-1])


def criteria_description(criteria: Column, label: Column) -> Column:
    """The criterion of a label (yes and no are under true and false), or else the label with blanks."""
    return F.coalesce(F.try_element_at(criteria, remap(label, {"yes": "true", "no": "false"}, strict=False)), F.translate(label, "_", " "))


def forward_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def number_text(value: Column) -> Column:
    """Three decimals, or n/a for null."""
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%.3f", value))
