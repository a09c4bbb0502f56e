"""Converters of public question sources to decisions: each a selection and a projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import criteria_description, describe_identifier, first_filled, json_string, remap, zip_options
from ..operators.joins import correction_map
from ..operators.select import balanced_first_n, first_per_selector, head_per_tier
from ..operators.validate import require_count, require_unique, require_valid, row_reason
from ..schemas import OPTIONS, PROVENANCE

# The intents and locales that are selected, in order.
BANKING77_INTENTS = ["card_arrival", "card_delivery_estimate", "card_not_working", "cash_withdrawal_not_recognised", "cash_withdrawal_charge", "transaction_charged_twice", "card_payment_not_recognised", "declined_card_payment", "pending_card_payment", "request_refund", "Refund_not_showing_up", "lost_or_stolen_card"]
MASSIVE_INTENTS = ["alarm_set", "alarm_remove", "weather_query", "play_music", "calendar_set", "calendar_query", "email_sendemail", "lists_createoradd", "transport_taxi", "cooking_recipe", "qa_definition", "news_query"]
MASSIVE_LOCALES = ["en-US", "es-ES", "de-DE", "hi-IN", "zh-CN"]
VARIANTS = ["original", "option_reversal", "question_reworded", "irrelevant_context", "missing_evidence"]


@dataclass(frozen=True)
class Source:
    """Where rows come from, as their provenance says."""

    name: str
    revision: str | None = None
    split: str | None = None
    license: str | None = None
    selection: str | None = None


# The pinned sources.
BANKING77 = Source("PolyAI-LDN/task-specific-datasets", "57ec275d8078af65b7731c2a98be812d844a6d6b", "test", "CC-BY-4.0", "first 10 test rows for each of 12 frozen intents")
BOOLQ = Source("google/boolq", "35b264d03638db9f4ce671b711558bf7ff0f80d5", "validation", "CC-BY-SA-3.0", "first 100 validation rows per answer")
WANLI = Source("alisawuffles/WANLI", "61c95318fd71c55b6ba355d76253254615f387ec", "test", "CC-BY-4.0", "first 50 test rows per mapped relation")
MASSIVE = Source("AmazonScience/massive", "ff6bd8e4b27c3543e4f8fe2108f32bb95a6f8740", "test", "CC-BY-4.0", "first 2 test rows for each frozen intent and locale")
MMLU_PRO = Source("TIGER-Lab/MMLU-Pro", "b189ec765aa7ed75c8acfea42df31fdae71f97be", "test", "MIT", "first 5 test rows per category")
JEVBENCH = Source("fstandhartinger/jevbench", "2fa63fa3226cb369795525ed011800f57dcbd894", None, "MIT")
AUTHORED = Source("project-authored", license="MIT")


def provenance(source: Source, **fields: Column) -> Column:
    """The provenance struct; fields without a value are null."""
    fixed = {"source": source.name, "revision": source.revision, "source_split": source.split, "license": source.license, "selection": source.selection}
    return F.struct(*[fields.get(f.name, F.lit(fixed.get(f.name))).cast(f.dataType).alias(f.name) for f in PROVENANCE.fields])


def fixed_options(pairs: list[tuple[str, str]]) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("id"), F.lit(b).alias("description")) for a, b in pairs])


def identifier_options(names: list[str]) -> Column:
    return F.transform(F.array(*map(F.lit, names)), lambda x: F.struct(x.alias("id"), describe_identifier(x).alias("description")))


def decisions(rows: DataFrame, ordinal: Column, *, id: Column, dataset: Column, group_id: Column, state_json: Column, question: Column, options: Column, label: Column, provenance: Column, strict: bool = True) -> DataFrame:
    """The common decision columns with option_ids, in the order of `ordinal`; a malformed row is an error, or stays as it is if not strict."""
    out = rows.select(ordinal.cast("long").alias("ordinal"), id.alias("id"), dataset.alias("dataset"), group_id.cast("string").alias("group_id"), state_json.alias("state_json"), question.alias("question"), options.cast(OPTIONS).alias("options"), label.alias("label"), provenance.alias("provenance"))
    out = out.withColumn("option_ids", F.transform("options", lambda o: o["id"]))
    if strict:
        require_valid(out, row_reason())
    return out


text_state = json_string


def banking77(rows: DataFrame, intents: list[str] | None = None, n: int = 10, source: Source = BANKING77) -> DataFrame:
    """rows: text, category, source_row."""
    intents = intents or BANKING77_INTENTS
    chosen = balanced_first_n(rows, "category", n, "source_row", intents)
    place = (F.col("class_rank") - 1) * n + F.col("rank") - 1
    return decisions(chosen, place, id=F.format_string("banking77/test/%s/%s", "category", place.cast("string")), dataset=F.lit("banking77-12-intent"), group_id=F.col("category"), state_json=text_state(F.col("text")), question=F.lit("Which banking intent best matches the customer message?"), options=identifier_options(intents), label=F.col("category"), provenance=provenance(source, source_row=F.col("source_row")))


def boolq(rows: DataFrame, n: int = 100, source: Source = BOOLQ) -> DataFrame:
    """rows: passage, question, answer, source_row. The classes are taken as no, yes and listed as yes, no."""
    marked = rows.withColumn("label", F.when(F.col("answer"), "yes").otherwise("no"))
    chosen = balanced_first_n(marked, "label", n, "source_row", ["no", "yes"])
    place = (F.col("class_rank") - 1) * n + F.col("rank") - 1
    return decisions(chosen, place, id=F.concat(F.lit("boolq/validation/"), F.col("source_row").cast("string")), dataset=F.lit("boolq-balanced"), group_id=F.col("source_row"), state_json=text_state(F.col("passage")), question=F.col("question"), options=fixed_options([("yes", "The passage supports yes."), ("no", "The passage supports no.")]), label=F.col("label"), provenance=provenance(source, source_row=F.col("source_row")))


def wanli(rows: DataFrame, n: int = 50, source: Source = WANLI) -> DataFrame:
    """rows: id, pairID, premise, hypothesis, gold, ordinal."""
    classes = ["supported", "insufficient", "contradicted"]
    marked = rows.withColumn("label", remap(F.col("gold"), {"entailment": "supported", "neutral": "insufficient", "contradiction": "contradicted"}))
    chosen = balanced_first_n(marked, "label", n, "ordinal", classes)
    place = (F.col("class_rank") - 1) * n + F.col("rank") - 1
    options = fixed_options([("supported", "The premise supports the hypothesis."), ("insufficient", "The premise does not settle the hypothesis."), ("contradicted", "The premise contradicts the hypothesis.")])
    return decisions(chosen, place, id=F.concat(F.lit("wanli/test/"), F.col("id").cast("string")), dataset=F.lit("wanli-balanced"), group_id=F.col("pairID"), state_json=F.to_json(F.struct("premise", "hypothesis")), question=F.lit("What relation does the premise have to the hypothesis?"), options=options, label=F.col("label"), provenance=provenance(source, source_id=F.col("id")))


def massive(rows: DataFrame, locales: list[str] | None = None, intents: list[str] | None = None, n: int = 2, source: Source = MASSIVE) -> DataFrame:
    """rows: locale, id, partition, intent, utt, line (the place in the locale's file)."""
    locales, intents = locales or MASSIVE_LOCALES, intents or MASSIVE_INTENTS
    wanted = rows.where((F.col("partition") == "test") & F.col("locale").isin(locales))
    chosen = balanced_first_n(wanted, "intent", n, "line", intents, within=["locale"])
    rank = F.array_position(F.array(*map(F.lit, locales)), F.col("locale")) - 1
    place = (rank * len(intents) + F.col("class_rank") - 1) * n + F.col("rank") - 1
    return decisions(chosen, place, id=F.format_string("massive/test/%s/%s", "locale", F.col("id").cast("string")), dataset=F.lit("massive-5-language-12-intent"), group_id=F.col("intent"), state_json=text_state(F.col("utt")), question=F.lit("Which intent best matches this request?"), options=identifier_options(intents), label=F.col("intent"), provenance=provenance(source, dataset_version=F.lit("1.1"), source_id=F.col("id"), locale=F.col("locale")))


def mmlu_pro(rows: DataFrame, n: int = 5, source: Source = MMLU_PRO, strict: bool = True) -> DataFrame:
    """rows: question_id, category, question, options (texts), answer_index, source_row. If not strict, a category with fewer than n rows has what it has."""
    chosen = balanced_first_n(rows, "category", n, "source_row", strict=strict)
    ids = F.transform(F.sequence(F.lit(0), F.size("options") - 1), lambda i: F.concat(F.lit("option_"), i.cast("string")))
    place = F.dense_rank().over(W.orderBy("category")) * n + F.col("rank")  # of the few selected rows
    return decisions(chosen, place, id=F.concat(F.lit("mmlu-pro/test/"), F.col("question_id").cast("string")), dataset=F.lit("mmlu-pro-domain-balanced"), group_id=F.col("category"), state_json=F.lit('"Answer using the stated question and options."'), question=F.col("question"), options=zip_options(ids, F.col("options")), label=F.concat(F.lit("option_"), F.col("answer_index").cast("string")), provenance=provenance(source, source_id=F.col("question_id"), category=F.col("category")))


def jevbench(rows: DataFrame, expected: int | None = 231, source: Source = JEVBENCH) -> DataFrame:
    """rows: split, id, group, family, state_json, instructions, labels (texts), criteria (map) or criteria_list, expected, ordinal (over all splits)."""
    names = F.transform("labels", lambda x: x.cast("string"))
    listed = F.col("criteria_list")
    fits = F.when(listed.isNotNull() & (F.size(listed) != F.size("labels")), F.raise_error(F.concat(F.lit("criteria do not match the labels of "), F.col("id"))).cast("string"))
    described = F.when(listed.isNotNull(), listed).otherwise(F.transform(names, lambda x: criteria_description(F.col("criteria"), x)))
    options = F.when(fits.isNull(), zip_options(names, described))
    out = decisions(rows, F.col("ordinal"), id=F.format_string("jevbench/%s/%s", "split", "id"), dataset=F.concat(F.lit("jevbench-"), F.col("split")), group_id=first_filled(F.col("group"), F.col("id")), state_json=F.col("state_json"), question=F.col("instructions"), options=options, label=F.col("expected").cast("string"), provenance=provenance(source, source_id=F.col("id"), source_split=F.col("split"), family=F.col("family")))
    if expected is not None:
        require_count(out, expected, "rows")
    return out


def expand_variants(bases: DataFrame, expected: int | None = 36, source: Source = AUTHORED, strict: bool = True) -> DataFrame:
    """Five decisions from each authored case; a malformed one is an error, or stays as it is if not strict: a state of no text is null.

    bases: id, question, reworded_question, state, missing_state, irrelevant_context, options, label, family, rationale,
    missing_rationale, evidence_span, missing_evidence_span, review_status, ordinal.
    """
    if expected is not None:
        require_count(bases, expected, "cases")
        require_unique(bases)

    def variant(i: int, name: str, **changes: Column) -> Column:
        missing = name == "missing_evidence"
        same = {"state": F.col("state"), "question": F.col("question"), "options": F.col("options"), "label": F.col("label")} | changes
        return F.struct(F.lit(i).alias("place"), F.lit(name).alias("variant"), *[x.alias(k) for k, x in same.items()], F.col("missing_rationale" if missing else "rationale").alias("why"), F.col("missing_evidence_span" if missing else "evidence_span").alias("span"))

    changes = [{}, {"options": F.reverse("options")}, {"question": F.col("reworded_question")}, {"state": F.concat("state", F.lit("\n\nIrrelevant note: "), "irrelevant_context")}, {"state": F.col("missing_state"), "label": F.lit("insufficient")}]
    five = F.array(*[variant(i, name, **c) for i, (name, c) in enumerate(zip(VARIANTS, changes, strict=True))])
    rows = bases.select("id", "family", "review_status", "ordinal", F.explode(five).alias("v"))
    return decisions(rows, F.col("ordinal") * 5 + F.col("v.place"), id=F.concat(F.lit("owned/"), "id", F.lit("/"), "v.variant"), dataset=F.lit("owned-robustness"), group_id=F.col("id"), state_json=F.when(F.col("v.state").isNotNull(), text_state(F.col("v.state"))), question=F.col("v.question"), options=F.col("v.options"), label=F.col("v.label"), provenance=provenance(source, family=F.col("family"), variant=F.col("v.variant"), parent_id=F.col("id"), rationale=F.col("v.why"), evidence_span=F.col("v.span"), review_status=F.col("review_status")), strict=strict)


def suite(sources: list[DataFrame]) -> DataFrame:
    """All sources one after the other; a repeated id is an error."""
    first, *rest = [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)]
    for s in rest:
        first = first.unionByName(s)
    require_unique(first)
    return first


def source_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_rank").agg(F.count("*").alias("rows"))


def smoke_suite(rows: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The first row of each source, in the suite's order."""
    named = [("jevbench", "jevbench-easy"), ("banking77", "banking77-12-intent"), ("boolq", "boolq-balanced"), ("wanli", "wanli-balanced"), ("massive", "massive-5-language-12-intent"), ("mmlu_pro", "mmlu-pro-domain-balanced")]
    rules = [(name, F.col("dataset") == d) for name, d in named]
    rules.append(("owned", (F.col("dataset") == "owned-robustness") & (F.col("provenance.variant") == "original")))
    return first_per_selector(rows, rules, ordinal)


def pilot_suite(rows: DataFrame, n: int = 10, ordinal: str = "ordinal") -> DataFrame:
    """The first n rows of each tier."""
    return head_per_tier(rows, "dataset", ["jevbench-easy", "jevbench-original", "jevbench-hard"], n, ordinal)


def banking77_correction(recorded: DataFrame, corrected: DataFrame) -> DataFrame:
    """id, recorded and correct source row, hash of the state and label of each row, if nothing else differs."""
    def flat(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("dataset") == "banking77-12-intent").select("id", F.col("provenance.source_row").alias("source_row"), F.get_json_object(F.concat(F.lit('{"v":'), "state_json", F.lit("}")), "$.v").alias("state"), "label")

    return correction_map(flat(recorded), flat(corrected), "id", "source_row", "state", "label")
