"""SQL that gives the same rows as the queries."""

from __future__ import annotations


def _softmax(source: str, alias: str) -> str:
    """CTEs that add p, pred, the place of the gold label and the losses to rows with o (options), l (logits) and label."""
    return f"""{alias}_w AS (SELECT *, list_transform(l, lambda x: exp(x - list_max(l))) AS w FROM {source}),
{alias}_p AS (SELECT * EXCLUDE (w), list_transform(w, lambda x: x / list_sum(w)) AS p FROM {alias}_w),
{alias} AS (SELECT *, o[list_position(p, list_max(p))] AS pred FROM {alias}_p)"""


def _losses(source: str, alias: str) -> str:
    return f"""{alias} AS (SELECT *, pred = label AS correct, -ln(greatest(p[list_position(o, label)], 1e-12)) AS nll,
  list_sum(list_transform(p, lambda v, i: (v - CASE WHEN i = list_position(o, label) THEN 1.0 ELSE 0.0 END) ** 2)) AS brier, list_max(p) AS conf FROM {source})"""


def _orders(shift: int = 0) -> str:
    return f"""SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS dataset, o_orderstatus AS label, ['F', 'O', 'P'] AS o, o_totalprice / 100000 AS seconds, o_custkey AS tokens,
  [((o_orderkey + {shift}) * 7919 % 101)::DOUBLE / 25, (o_custkey * 104729 % 103)::DOUBLE / 25, (floor(o_totalprice)::BIGINT % 97)::DOUBLE / 25] AS l FROM orders"""


D1 = f"d1 AS ({_orders()}), {_softmax('d1', 'r1')}, {_losses('r1', 's1')}"
D1B = D1 + ", b1 AS (SELECT *, CASE WHEN conf = 1 THEN 9 ELSE (SELECT max(i) FROM range(10) t(i) WHERE conf >= i / 10.0::DOUBLE) END AS bin FROM s1)"
D2 = f"""d2 AS (SELECT vec_id, vec_id::VARCHAR AS id, 'c' || label AS label, ['c0','c1','c2','c3','c4','c5','c6','c7','c8','c9'] AS o, list_transform(embedding[1:10], lambda x: x::DOUBLE * 10) AS l, embedding FROM embeddings),
{_softmax('d2', 'r2')}, {_losses('r2', 's2')}"""
D3 = D2 + """, m3 AS (SELECT *, CASE WHEN vec_id % 17 = 0 THEN 'missing' WHEN vec_id % 23 = 0 OR vec_id % 29 = 0 OR vec_id % 31 = 0 THEN 'invalid' ELSE 'ok' END AS status,
  CASE WHEN vec_id % 17 = 0 THEN NULL WHEN vec_id % 23 = 0 THEN 'ValueError: too long' WHEN vec_id % 29 = 0 THEN 'probabilities must sum to one' WHEN vec_id % 31 = 0 THEN 'prediction must be the first most probable option' END AS error FROM s2)"""


def _variants() -> str:
    base = "[embedding[1]::DOUBLE * 10, embedding[2]::DOUBLE * 10, embedding[3]::DOUBLE * 10]"
    parts = [f"SELECT vec_id, 'original' AS variant, {base} AS l FROM embeddings"]
    for name, low in (("option_reversal", 4), ("question_reworded", 7), ("irrelevant_context", 10), ("missing_evidence", 13)):
        parts.append(f"SELECT vec_id, '{name}', [embedding[1]::DOUBLE * 10 + 0.5 * (embedding[{low}]::DOUBLE * 10), embedding[2]::DOUBLE * 10 + 0.5 * (embedding[{low + 1}]::DOUBLE * 10), embedding[3]::DOUBLE * 10 + 0.5 * (embedding[{low + 2}]::DOUBLE * 10)] FROM embeddings")
    return " UNION ALL ".join(parts)


D4 = f"""d4 AS (SELECT *, ['a', 'b', 'insufficient'] AS o, CASE WHEN variant = 'missing_evidence' THEN 'insufficient' ELSE ['a', 'b', 'insufficient'][vec_id % 3 + 1] END AS label FROM ({_variants()})),
{_softmax('d4', 'r4')},
pairs AS (SELECT v.vec_id, v.variant, v.pred <> f.pred AS flip, [abs(v.p[1] - f.p[1]), abs(v.p[2] - f.p[2]), abs(v.p[3] - f.p[3])] AS moved
  FROM r4 v JOIN r4 f ON f.vec_id = v.vec_id AND f.variant = 'original' WHERE v.variant NOT IN ('original', 'missing_evidence'))"""

BASE = """count(*) AS rows, count(*) FILTER (WHERE correct) AS correct_predictions, count(*) AS valid_predictions, round(1.0::DOUBLE, 6) AS coverage,
  round(avg(correct::INT), 6) AS accuracy, round(avg(nll), 6) AS nll, round(avg(brier), 6) AS brier"""
EACH_BIN = "SELECT dataset, bin, count(*) AS n, avg(conf) AS c, avg(correct::INT) AS a FROM b1 GROUP BY dataset, bin"
DECISIONS = """d AS (SELECT 'orders/' || o_orderkey AS id, o_orderkey AS k, o_orderpriority AS dataset, o_custkey, o_orderstatus AS label, 'Which status does the order have?' AS question FROM orders)"""
INSTRUCTION = "Apply the question to the evidence. Choose exactly one listed option. Respond with only its option label."
PROMPT = f"""'{INSTRUCTION}' || chr(10) || chr(10) || 'Evidence:' || chr(10) || '{{"priority": "' || dataset || '", "customer": ' || o_custkey || '}}' || chr(10) || chr(10) || 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Options:' || chr(10)
  || 'A. The order has status F.' || chr(10) || 'B. The order has status O.' || chr(10) || 'C. The order has status P.' || chr(10) || chr(10) || 'Answer:'"""
RUNS = " UNION ALL ".join(f"SELECT 'model-{i}' AS model_id, 'complete' AS status, dataset, {BASE} FROM (WITH d AS ({_orders(shift)}), {_softmax('d', 'r')}, {_losses('r', 's')} SELECT * FROM s) GROUP BY dataset" for i, shift in ((0, 0), (1, 5), (3, 11)))
SOURCES = """src AS (SELECT doc_id::VARCHAR AS id, lang AS kind, 0 AS source_rank FROM documents UNION ALL SELECT conv_id || '/' || turn, role, 1 FROM conversations UNION ALL SELECT event_id::VARCHAR, event_type, 2 FROM events)"""
VARIANTS = ["original", "option_reversal", "question_reworded", "irrelevant_context", "missing_evidence"]

SQL: dict[str, str] = {
    "summary_overall": f"WITH {D1} SELECT {BASE}, round(quantile_cont(seconds, 0.5), 6) AS latency_p50, round(quantile_cont(seconds, 0.95), 6) AS latency_p95, round(sum(seconds), 6) AS latency_total, round(count(*) / sum(seconds), 6) AS decisions_per_second, round(avg(tokens), 6) AS input_tokens_mean, round(quantile_cont(tokens, 0.5), 6) AS input_tokens_p50 FROM s1",
    "summary_by_dataset": f"WITH {D1} SELECT dataset, {BASE}, round(quantile_cont(seconds, 0.95), 6) AS latency_p95, round(avg(tokens), 6) AS input_tokens_mean FROM s1 GROUP BY dataset",
    "summary_grouping_sets": f"WITH {D1} SELECT dataset, grouping(dataset) = 1 AS overall, {BASE} FROM s1 GROUP BY GROUPING SETS ((), (dataset))",
    "scored_rows": f"WITH {D1B} SELECT id, 'ok' AS status, pred AS prediction_id, correct, round(nll, 6) AS nll, round(brier, 6) AS brier, round(conf, 6) AS confidence, bin::INT AS bin FROM b1",
    "multiclass_scored": f"WITH {D2} SELECT id, pred AS prediction_id, correct, round(nll, 6) AS nll, round(brier, 6) AS brier, round(conf, 6) AS confidence FROM s2",
    "softmax_rows": f"WITH {D1} SELECT id, round(p[1], 6) AS p0, round(p[2], 6) AS p1, round(p[3], 6) AS p2 FROM r1",
    "allowed_mass": f"WITH {D2}, e AS (SELECT id, l, list_transform(embedding, lambda x: x::DOUBLE * 10) AS v FROM d2) SELECT id, round(list_sum(list_transform(l, lambda x: exp(x - list_max(v)))) / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) AS mass FROM e",
    "reliability_bins": f"WITH {D1B} SELECT dataset, round(bin / 10.0::DOUBLE, 6) AS lower, round((bin + 1) / 10.0::DOUBLE, 6) AS upper, n, round(c, 6) AS mean_confidence, round(a, 6) AS accuracy FROM ({EACH_BIN})",
    "ece_by_dataset": f"WITH {D1B} SELECT dataset, round(sum(n * abs(c - a)) / sum(n), 6) AS ece_10_bin FROM ({EACH_BIN}) GROUP BY dataset",
    "ece_overall": f"WITH {D1B} SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece_10_bin FROM (SELECT bin, count(*) AS n, avg(conf) AS c, avg(correct::INT) AS a FROM b1 GROUP BY bin)",
    "confusion_counts": f"WITH {D1} SELECT dataset, label, pred AS prediction_id, count(*) AS n FROM s1 GROUP BY ALL",
    "class_counts": f"WITH {D3}, ok AS (SELECT label, CASE WHEN status = 'ok' THEN pred END AS pred FROM m3) SELECT c AS class, (SELECT count(*) FROM ok WHERE label = c) AS gold, (SELECT count(*) FROM ok WHERE pred = c) AS given, (SELECT count(*) FROM ok WHERE label = c AND pred = c) AS hit FROM (SELECT 'c' || i AS c FROM range(10) t(i))",
    "macro_f1_by_dataset": f"WITH {D1}, c AS (SELECT dataset, x, count(*) FILTER (WHERE label = x) + count(*) FILTER (WHERE pred = x) AS either, count(*) FILTER (WHERE label = x AND pred = x) AS hit FROM s1, (VALUES ('F'), ('O'), ('P')) t(x) GROUP BY dataset, x) SELECT dataset, CASE WHEN dataset <> '5-LOW' THEN round(avg(CASE WHEN either = 0 THEN 0 ELSE 2.0::DOUBLE * hit / either END), 6) END AS macro_f1 FROM c GROUP BY dataset",
    "binary_macro_f1": "WITH r AS (SELECT quality::VARCHAR AS label, CASE WHEN n_chars > 1000 THEN '1' ELSE '0' END AS pred FROM labels JOIN documents USING (doc_id)), c AS (SELECT x, count(*) FILTER (WHERE label = x) + count(*) FILTER (WHERE pred = x) AS either, count(*) FILTER (WHERE label = x AND pred = x) AS hit FROM r, (VALUES ('0'), ('1')) t(x) GROUP BY x) SELECT round(avg(CASE WHEN either = 0 THEN 0 ELSE 2.0::DOUBLE * hit / either END), 6) AS macro_f1 FROM c",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
    "throughput": "SELECT event_type, round(sum(value), 6) AS total, round(count(value) / sum(value), 6) AS per_second, round(quantile_cont(value, 0.5), 6) AS p50 FROM events GROUP BY event_type",
    "prediction_validity": f"WITH {D3} SELECT id, status, error FROM m3",
    "validity_counts": f"WITH {D3} SELECT status, count(*) AS n FROM m3 GROUP BY status",
    "partial_summary": f"WITH {D3} SELECT count(*) AS rows, count(*) FILTER (WHERE status = 'ok' AND correct) AS correct_predictions, count(*) FILTER (WHERE status = 'ok') AS valid_predictions, round(avg((status = 'ok')::INT), 6) AS coverage, round(avg((status = 'ok' AND correct)::INT), 6) AS accuracy, NULL::DOUBLE AS nll, NULL::DOUBLE AS brier FROM m3",
    "full_record": f"WITH {D1B}, e AS ({EACH_BIN}) SELECT dataset, sum(n)::BIGINT AS rows, round(sum(a * n) / sum(n), 6) AS accuracy, round(sum(n * abs(c - a)) / sum(n), 6) AS ece_10_bin, count(*)::INT AS bins FROM e GROUP BY dataset",
    "row_validity": f"WITH {DECISIONS} SELECT id, CASE WHEN k % 7 = 0 THEN 'id, dataset, question and label must be filled' WHEN k % 13 = 0 THEN 'state must be a filled text, object or array' WHEN k % 17 = 0 THEN '2 to 26 options are needed' WHEN k % 19 = 0 THEN 'option ids must be distinct' WHEN k % 11 = 0 THEN 'label must be an option' END AS reason FROM d",
    "manifest_validity": "SELECT p_partkey AS partkey, CASE WHEN p_size <= 0 THEN 'parameter count must be finite and positive' WHEN p_size > 40 AND p_partkey % 2 <> 0 THEN 'more than 4 billion parameters need effective sizing' WHEN p_partkey % 2 = 0 AND NOT (p_size > 0 AND p_size <= 80) THEN 'effective size must be above 0 and at most 4' WHEN p_partkey % 7 = 0 THEN 'context must be positive' WHEN p_partkey % 5 = 0 THEN 'alias compatibility needs a status and a detail' WHEN p_partkey % 11 = 0 THEN 'file size must be positive' WHEN p_partkey % 13 = 0 THEN 'file hash must have 64 hexadecimal digits' END AS reason FROM part",
    "missing_predictions": "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'ok' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)",
    "unknown_predictions": "SELECT doc_id + 500 AS doc_id FROM labels WHERE doc_id + 500 NOT IN (SELECT doc_id FROM documents)",
    "unknown_sample": "SELECT doc_id + 500 AS doc_id FROM labels WHERE doc_id + 500 NOT IN (SELECT doc_id FROM documents) ORDER BY 1 LIMIT 5",
    "pending_rows": "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)",
    "of_dataset": "SELECT doc_id, quality FROM labels SEMI JOIN (SELECT doc_id FROM documents WHERE lang = 'fr') d USING (doc_id)",
    "collect_errors": f"WITH {D3} SELECT count(*)::INT AS n, string_agg(id || ':' || status || ':' || coalesce(error, '-'), ';' ORDER BY vec_id) AS errors FROM m3 WHERE status <> 'ok'",
    "balanced_first_n": "SELECT doc_id, lang, list_position(['fr','en','es','de'], lang)::BIGINT AS class_rank, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 10",
    "balanced_two_level": "SELECT source, lang, doc_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rank FROM documents WHERE lang IN ('de', 'en')) WHERE rank <= 2",
    "first_per_class": "SELECT (list_position(['purchase','click','view','signup','error'], event_type) - 1)::INT AS selector, min(event_id) AS event_id, event_type, arg_min(user_id, event_id) AS user_id FROM events WHERE event_type IN ('purchase','click','view','signup','error') GROUP BY event_type",
    "head_per_tier": "SELECT event_id, event_type, list_position(['view','error','click'], event_type)::BIGINT AS class_rank, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rank FROM events WHERE event_type IN ('view','error','click')) WHERE rank <= 10",
    "selection_ordinal": "SELECT doc_id, lang, row_number() OVER (ORDER BY list_position(['es','fr'], lang), rank) - 1 AS position FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents WHERE lang IN ('es','fr')) WHERE rank <= 5",
    "variant_expansion": f"""SELECT 'owned/' || doc_id || '/' || v AS id, doc_id * 5 + i - 1 AS ordinal, CASE WHEN i = 5 THEN 'insufficient' WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'no' END AS label, CASE WHEN i = 3 THEN 'Does it hold?' ELSE 'Is it so?' END AS question,
  CASE WHEN i = 2 THEN 'insufficient,no,yes' ELSE 'yes,no,insufficient' END AS option_ids, length(to_json(CASE WHEN i = 5 THEN 'Nothing is known.' WHEN i = 4 THEN text || chr(10) || chr(10) || 'Irrelevant note: ' || source ELSE text END)::VARCHAR)::INT AS state_length, v AS variant, CASE WHEN i = 5 THEN 'm' ELSE 'r' END AS rationale
  FROM documents, (SELECT unnest({VARIANTS}) AS v, unnest(range(1, 6)) AS i)""",
    "pivot_variants": "SELECT doc_id::VARCHAR AS group_id, CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'no' END AS label, 'insufficient' AS missing_label, 'owned/' || doc_id || '/option_reversal' AS reversed_id FROM documents",
    "pair_flips": f"WITH {D4} SELECT variant, count(*) AS pairs, count(*) FILTER (WHERE flip) AS flips FROM pairs GROUP BY variant",
    "probability_movement": f"WITH {D4} SELECT variant, round(sum(list_sum(moved)) / (3 * count(*)), 6) AS movement FROM pairs GROUP BY variant",
    "missing_evidence_error": f"WITH {D4} SELECT count(*) AS rows, round(avg((pred <> label)::INT), 6) AS error_rate FROM r4 WHERE variant = 'missing_evidence'",
    "robustness_summary": f"WITH {D4}, m AS (SELECT count(*) AS n, avg((pred <> label)::INT) AS e FROM r4 WHERE variant = 'missing_evidence') SELECT (SELECT count(*) FROM r4 WHERE variant NOT IN ('original', 'missing_evidence')) AS declared_variant_comparisons, count(*) AS paired_variant_comparisons, 1.0::DOUBLE AS valid_pair_coverage, round(avg(flip::INT), 6) AS argmax_flip_rate, round(sum(list_sum(moved)) / (3 * count(*)), 6) AS mean_absolute_probability_movement, (SELECT n FROM m) AS missing_evidence_rows, round((SELECT e FROM m), 6) AS missing_evidence_error_rate FROM pairs",
    "render_prompt": f"WITH {DECISIONS} SELECT id, {PROMPT} AS prompt FROM d",
    "prompt_hash": f"WITH {DECISIONS} SELECT id, 'choice-v1' AS version, sha256({PROMPT}) AS sha256 FROM d",
    "chat_messages": f"""WITH {DECISIONS} SELECT id, '{INSTRUCTION}' AS system, '{{"evidence": {{"priority": "' || dataset || '", "customer": ' || o_custkey || '}}, "question": "' || question || '", "options": [{{"label": "A", "description": "The order has status F."}}, {{"label": "B", "description": "The order has status O."}}, {{"label": "C", "description": "The order has status P."}}]}}' AS user FROM d""",
    "label_options": f"WITH {DECISIONS} SELECT id, 'A=The order has status F.|B=The order has status O.|C=The order has status P.' AS labelled FROM d",
    "describe_identifier": "WITH n AS (SELECT p_partkey, trim(replace(replace(' Refund_' || p_brand || '_NOT?_' || p_type, '_', ' '), '?', '')) AS x FROM part) SELECT p_partkey, upper(x[1]) || lower(x[2:]) AS description FROM n",
    "text_hash": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "canonical_json": """SELECT event_id, '{"a":{"b":"é","y":[1,2]},"k":' || (props->>'$.k') || ',"z":1}' AS json FROM events""",
    "spaced_json": """SELECT event_id, '{"a": "x, \\"y\\": z", "n": [' || user_id || ', 2], "o": {"p": null}}' AS json FROM events""",
    "value_remap": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'supported' WHEN 'O' THEN 'insufficient' WHEN 'P' THEN 'contradicted' END AS label, CASE o_orderpriority WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS priority FROM orders",
    "reverse_options": "SELECT 'orders/' || o_orderkey AS id, 'P,O,F' AS reversed FROM orders",
    "coalesce_group": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE o_orderkey::VARCHAR END AS group_id FROM orders",
    "zip_options": "SELECT p_partkey, p_brand || ':' || p_name || '|' || p_type || ':' || p_size AS options FROM part",
    "criteria_lookup": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'It holds.' WHEN o_orderstatus = 'P' THEN 'no answer' WHEN o_orderpriority = '2-HIGH' THEN 'High.' ELSE o_orderpriority END AS description FROM orders",
    "path_slashes": "SELECT page_id, url AS path FROM pages",
    "number_format": "SELECT event_id, CASE WHEN event_type = 'error' THEN 'n/a' ELSE format('{:.3f}', value) END AS text FROM events",
    "union_sources": f"WITH {SOURCES} SELECT * FROM src",
    "source_counts": f"WITH {SOURCES} SELECT source_rank, count(*) AS rows FROM src GROUP BY source_rank",
    "duplicate_ids": f"WITH {SOURCES} SELECT id, count(*) AS n FROM src GROUP BY id HAVING count(*) > 1",
    "set_difference": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    "set_equality": "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_left, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS only_right, (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS shared, NOT EXISTS (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) AND NOT EXISTS (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) AS equal",
    "key_subset": "SELECT event_id, array_to_string(list_filter(['click', 'view', 'error'], lambda x: x <> 'view' AND x <> event_type), ',') AS missing FROM events",
    "derive_subset": "SELECT doc_id FROM documents WHERE doc_id % 9 = 0",
    "correction_map": "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN doc_id ELSE doc_id + 1 END AS recorded_source_row, doc_id AS correct_source_row, sha256(text) AS state_sha256, lang FROM documents",
    "comparison_report": f"WITH r AS ({RUNS}) SELECT model_id, coalesce(status, 'not_run') AS status, dataset, rows, correct_predictions, valid_predictions, coverage, accuracy, nll, brier FROM (SELECT 'model-' || i AS model_id FROM range(4) t(i)) LEFT JOIN r USING (model_id)",
    "report_lines": f"WITH r AS ({RUNS}) SELECT model_id, dataset, CASE WHEN status IS NULL THEN '| ' || model_id || ' | Not run | n/a | n/a | n/a |' ELSE '| ' || model_id || ' | ' || dataset || ' | ' || correct_predictions || ' / ' || rows || ' | ' || format('{{:.3f}}', coverage) || ' | ' || format('{{:.3f}}', correct_predictions::DOUBLE / rows) || ' |' END AS line FROM (SELECT 'model-' || i AS model_id FROM range(4) t(i)) LEFT JOIN r USING (model_id)",
    "not_run_models": "SELECT 'model-' || i AS model_id, CASE WHEN EXISTS (SELECT 1 FROM nation WHERE n_nationkey = i AND 'model-' || n_nationkey < 'model-20') THEN 'complete' ELSE 'not_run' END AS status FROM range(30) t(i)",
    "hidden_runs": "SELECT n_name AS model_id, n_regionkey::VARCHAR AS benchmark_sha256, 'not_run' AS status FROM nation WHERE n_nationkey % 6 = 0",
    "matching_runs": "SELECT s_name AS model_id, sha256(s_name) AS gguf_sha256, s_suppkey AS gguf_bytes FROM supplier WHERE s_suppkey % 4 <> 0",
    "config_mismatch": "WITH e AS (SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events) SELECT event_id, (k % 3) IS DISTINCT FROM (CASE WHEN k % 3 <> 2 THEN k % 2 END) AS differs FROM e",
    "convert_passages": "WITH r AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS label, row_number() OVER (PARTITION BY quality = 1 ORDER BY doc_id) AS rank FROM documents JOIN labels USING (doc_id)) SELECT 'boolq/validation/' || doc_id AS id, (CASE WHEN label = 'yes' THEN 3 ELSE 0 END + rank - 1)::BIGINT AS ordinal, doc_id::VARCHAR AS group_id, label, 'yes,no' AS option_ids, doc_id AS source_row FROM r WHERE rank <= 3",
    "convert_intents": "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank, list_position(['en','de','fr','es'], lang) AS c FROM documents) SELECT 'banking77/test/' || lang || '/' || ((c - 1) * 5 + rank - 1) AS id, ((c - 1) * 5 + rank - 1)::BIGINT AS ordinal, lang AS group_id, lang AS label, 'En,De,Fr,Es' AS descriptions, doc_id AS source_row FROM r WHERE rank <= 5 AND c IS NOT NULL",
    "convert_relations": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rank, list_position(['F','O','P'], o_orderstatus) AS c FROM orders) SELECT 'wanli/test/' || o_orderkey AS id, ((c - 1) * 20 + rank - 1)::BIGINT AS ordinal, o_custkey::VARCHAR AS group_id, '{"premise":"' || o_orderpriority || '","hypothesis":"' || o_orderstatus || '"}' AS state_json, ['supported','insufficient','contradicted'][c] AS label FROM r WHERE rank <= 20""",
    "convert_locales": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank, list_position(['fr','de','en','es'], lang) AS c FROM documents) SELECT 'massive/test/all/' || doc_id AS id, ((c - 1) * 2 + rank - 1)::BIGINT AS ordinal, lang AS group_id, '"' || source || '"' AS state_json, lang AS label, 'all' AS locale FROM r WHERE rank <= 2""",
    "convert_domains": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank FROM part) SELECT 'mmlu-pro/test/' || p_partkey AS id, p_brand AS group_id, 'option_' || (p_partkey % 3) AS label, 'option_0=' || p_type || '|option_1=' || p_size || '|option_2=none' AS options FROM r WHERE rank <= 2",
    "convert_tiers": "SELECT 'jevbench/' || event_type || '/' || event_id AS id, 'jevbench-' || event_type AS dataset, CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR ELSE user_id::VARCHAR END AS group_id, CASE WHEN event_type = 'error' THEN 'It is.|It is not.' ELSE 'So it is.|not so' END AS descriptions FROM events",
    "jsonl_round_trip": "SELECT doc_id, text, lang FROM documents",
    "decision_scan": f"""WITH {DECISIONS} SELECT id, dataset, label, '{{"customer":' || o_custkey || ',"priority":"' || dataset || '"}}' AS state_json, 3 AS n_options, row_number() OVER (ORDER BY k) - 1 AS place FROM d""",
    "prediction_scan": f"WITH {D1} SELECT id, pred AS prediction_id, round(conf, 6) AS confidence, 3 AS n FROM s1",
    "optional_scan": "SELECT 'found' AS of, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT'",
    "appended_progress": "SELECT o_orderkey::VARCHAR AS id, 2 AS n FROM orders WHERE o_orderkey % 3 = 2",
    "csv_round_trip": """SELECT c_custkey::VARCHAR AS c_custkey, c_name || ', "x"' || chr(10) || c_mktsegment AS c_note, row_number() OVER () - 1 AS source_row FROM customer""",
    "parquet_places": "SELECT o_orderkey, row_number() OVER () - 1 AS source_row FROM orders",
    "tar_members": "SELECT n_regionkey::VARCHAR AS key, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS place, n_nationkey, n_name FROM nation",
    "object_scan": "SELECT r_regionkey, r_name FROM region",
    "directory_listing": "SELECT row_number() OVER (ORDER BY r_name) - 1 AS place, r_name FROM region",
    "checksum_record": "SELECT r_name || '.json' AS name FROM region WHERE r_name IN ('ASIA', 'EUROPE')",
    "obtained_files": "SELECT r_name, step, same FROM region, (VALUES ('fetched', true), ('cached', true), ('refused', false)) v(step, same)",
    "scored_run": f"""WITH {D1}, t AS (SELECT *, id::BIGINT AS k, id::BIGINT % 7 <> 6 AS ok FROM s1)
SELECT coalesce(dataset, 'all') AS dataset, count(*) AS rows, count(*) FILTER (WHERE ok) AS valid_predictions, count(*) FILTER (WHERE ok AND correct) AS correct_predictions,
  round(count(*) FILTER (WHERE ok) / count(*), 6) AS coverage, round(count(*) FILTER (WHERE ok AND correct) / count(*), 6) AS accuracy, count(*) FILTER (WHERE NOT ok) AS errors,
  round(quantile_cont(seconds, 0.95) FILTER (WHERE ok), 6) AS latency_p95, round(avg((k % 100) / 100.0::DOUBLE) FILTER (WHERE ok), 6) AS mass_mean, round(quantile_cont((k % 100) / 100.0::DOUBLE, 0.5) FILTER (WHERE ok), 6) AS mass_p50,
  max(k * 1024) FILTER (WHERE ok)::DOUBLE AS rss_max, round(quantile_cont(tokens, 0.5) FILTER (WHERE ok), 6) AS input_tokens_p50 FROM t GROUP BY GROUPING SETS ((), (dataset))""",
    "published_comparison": " UNION ALL ".join(f"SELECT 'model-{i}' AS model_id, 'complete' AS status, dataset, count(*) AS rows, count(*) AS valid_predictions, count(*) FILTER (WHERE correct) AS correct_predictions, round(avg(correct::INT), 6) AS accuracy, round(avg(nll), 6) AS nll, 3 AS verified_runs, 2 AS verified_reports FROM (WITH d AS (SELECT * FROM ({_orders(shift)}) WHERE tokens % 2 = 0), {_softmax('d', 'r')}, {_losses('r', 's')} SELECT * FROM s) GROUP BY dataset" for i, shift in ((0, 0), (1, 5))) + " UNION ALL SELECT 'model-9', 'not_run', NULL, NULL, NULL, NULL, NULL, NULL, 3, 2",
    "run_consistency": """SELECT id, reason FROM (SELECT CASE WHEN k % 11 = 0 THEN 'x' ELSE '' END || k AS id, CASE WHEN k % 11 = 0 THEN 'Unknown prediction id' WHEN k % 13 = 0 THEN 'model or configuration differs'
  WHEN k % 7 = 0 THEN CASE WHEN NOT (k % 2 = 0 AND k % 3 <> 0) THEN 'malformed error' END WHEN k % 5 <> 0 THEN 'evidence is missing' END AS reason FROM (SELECT o_orderkey AS k FROM orders)) WHERE reason IS NOT NULL""",
    "subset_predictions": f"WITH {D1} SELECT id, id::BIGINT AS ordinal, pred AS prediction_id FROM s1 WHERE dataset = '2-HIGH'",
    "cardinality": "SELECT count(*) AS n, 'Expected 25 nations, received ' || count(*) FILTER (WHERE n_regionkey = 1) AS said FROM nation",
    "measurements": f"""WITH {D1}, t AS (SELECT *, (id::BIGINT % 100) / 100.0::DOUBLE AS mass, id::BIGINT * 1024 AS rss FROM s1),
m AS (SELECT dataset, round(quantile_cont(seconds, 0.5), 6) AS latency_p50, round(quantile_cont(seconds, 0.95), 6) AS latency_p95, round(avg(mass), 6) AS mass_mean, round(quantile_cont(mass, 0.5), 6) AS mass_p50, max(rss)::DOUBLE AS rss_max, quantile_cont(rss, 0.5)::DOUBLE AS rss_p50, round(avg(tokens), 6) AS input_tokens_mean, quantile_cont(tokens, 0.5)::DOUBLE AS input_tokens_p50 FROM t GROUP BY dataset)
SELECT * FROM m, (VALUES ('large'), ('small')) f(form)""",
    "streamed_scores": f"WITH {D1} SELECT 'orders/' || id AS id, pred AS prediction_id FROM s1",
    "merged_states": f"""WITH {D1B}, e1 AS (SELECT *, id::BIGINT % 128 / 128.0::DOUBLE AS mass, id::BIGINT * 1024 AS rss FROM b1), g AS (SELECT dataset, bin, conf, correct FROM b1 UNION ALL SELECT '', bin, conf, correct FROM b1),
  x AS (SELECT dataset, sum(abs(c - h)) / sum(n) AS ece FROM (SELECT dataset, bin, count(*) AS n, sum(conf) AS c, sum(correct::INT) AS h FROM g GROUP BY dataset, bin) GROUP BY dataset)
  SELECT * FROM (SELECT coalesce(dataset, '') AS dataset, count(*) AS rows, count(*) FILTER (WHERE correct) AS correct_predictions, count(*) AS valid_predictions, round(avg(correct::INT), 6) AS accuracy, round(avg(nll), 6) AS nll, round(avg(brier), 6) AS brier,
    round(quantile_cont(seconds, 0.5), 6) AS latency_p50, round(quantile_cont(seconds, 0.95), 6) AS latency_p95, round(avg(mass), 6) AS mass_mean, round(quantile_cont(mass, 0.5), 6) AS mass_p50, max(rss)::DOUBLE AS rss_max, round(quantile_cont(rss, 0.5), 6) AS rss_p50,
    round(avg(tokens), 6) AS input_tokens_mean, round(quantile_cont(tokens, 0.5), 6) AS input_tokens_p50 FROM e1 GROUP BY GROUPING SETS ((), (dataset))) JOIN (SELECT dataset, round(ece, 6) AS ece_10_bin FROM x) USING (dataset)""",
    "batch_scored": """SELECT 'orders/' || o_orderkey AS id, o_orderpriority AS dataset, CASE WHEN o_orderkey % 1000 <> 7 THEN ['F', 'O', 'P'][o_orderkey % 3 + 1] END AS prediction_id, CASE WHEN o_orderkey % 1000 <> 7 THEN 0.5::DOUBLE END AS confidence,
  CASE WHEN o_orderkey % 1000 = 7 THEN 'ValueError: cannot score ' || o_orderkey ELSE '' END AS error FROM orders""",
    "streamed_errors": "SELECT CASE WHEN o_orderkey % 10 = 3 THEN 'Unknown id' ELSE 'scored' END AS reason, count(*) AS n FROM orders GROUP BY 1",
    "chat_templates": """WITH c AS (SELECT conv_id, list({'r': coalesce(role, 'user'), 't': coalesce(text, '')} ORDER BY turn) AS l FROM conversations GROUP BY conv_id),
s AS (SELECT *, l[1].r = 'system' AS sys, CASE WHEN l[1].r = 'system' THEN l[2:] ELSE l END AS m FROM c),
k AS (SELECT *, list_transform(m, lambda x, i: {'r': x.r, 't': trim(CASE WHEN i = 1 AND sys THEN '<<SYS>>' || chr(10) || l[1].t || chr(10) || '<</SYS>>' || chr(10) || chr(10) ELSE '' END || x.t, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))}) AS p FROM s)
SELECT conv_id, sha256(array_to_string(list_transform(l, lambda x: '<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>' || chr(10)), '') || '<|im_start|>assistant' || chr(10)) AS turns_sha256,
  sha256(array_to_string(list_transform(p, lambda x: CASE x.r WHEN 'user' THEN '<s>[INST] ' || x.t || ' [/INST]' WHEN 'assistant' THEN ' ' || x.t || ' </s>' ELSE '' END), '')) AS inst_sha256 FROM k""",
    "digest_difference": """SELECT o_orderkey, CASE WHEN o_orderkey % 501 = 7 THEN 'removed' ELSE 'changed' END AS change, 1 AS n_left, CASE WHEN o_orderkey % 501 = 7 THEN 0 ELSE 1 END AS n_right
  FROM orders WHERE o_orderkey % 501 = 7 OR o_orderkey % 1001 = 3 UNION ALL SELECT -o_orderkey, 'added', 0, 1 FROM orders WHERE o_orderkey % 2003 = 5""",
    "core_suite": """WITH e AS (SELECT 'jevbench-' || event_type AS dataset, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events),
w AS (SELECT row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rank FROM orders)
SELECT dataset, count(*) AS n, min(place) AS first FROM e GROUP BY dataset UNION ALL SELECT 'wanli-balanced', count(*), (SELECT count(*) FROM events) FROM w WHERE rank <= 20""",
    "model_files": """SELECT 'model-' || k AS name, n, CASE k WHEN 3 THEN 'has other bytes' WHEN 4 THEN 'has another hash than recorded' WHEN 7 THEN 'is not there' ELSE 'holds' END AS reason FROM (SELECT o_orderkey % 10 AS k, count(*) AS n FROM orders GROUP BY 1)""",
    "alias_check": """WITH p AS (SELECT p_partkey AS context, CASE WHEN len(w) > 1 THEN ' ' ELSE '' END || w[-1] AS last FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part))
SELECT context, label, reason, other FROM p, (VALUES ('Z', 'is not one piece', NULL), ('A', 'has the piece of another label', 'C'), ('C', 'has the piece of another label', 'A')) v(label, reason, other)
UNION ALL SELECT context, 'B', 'is joined by a piece of the context', last || 'B' FROM p WHERE length(last) % 3 = 0""",
}
