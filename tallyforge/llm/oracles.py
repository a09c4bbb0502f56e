"""SQL for the queries that SQL can express on whole tables."""

from .decontaminate import SLOP
from .license_texts import TEMPLATES
from .licenses import CLOSED, COMMENT, CUE, DECLARES, DENIES, LICENSE_NAMES, SEVERAL, SPDX

#: Strip, lower-case and test a line as the operator does.
_KEY = "translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP2 = f"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT doc_id, line, pos, {_KEY} AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (SELECT doc_id, line, pos, coalesce(first < doc_id, false) AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP4 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, w[i:i + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
grams AS (SELECT doc_id, i, n, w[i:i + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, i, n, item_id FROM grams JOIN wins USING (win)),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id),
places AS (SELECT DISTINCT win, unnest(win) AS term, generate_subscripts(win, 1) - 1 AS o FROM wins),
posts AS (SELECT doc_id, term, p FROM (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM d) WHERE term IN (SELECT term FROM places)),
freq AS (SELECT term, count(*) AS cf FROM posts GROUP BY term),
rare AS (SELECT win, arg_min({{'t': places.term, 'o': o}}, {{'cf': coalesce(cf, 0), 't': places.term, 'o': o}}) AS r FROM places LEFT JOIN freq USING (term) GROUP BY win),
starts AS (SELECT doc_id, win, p - r.o AS s FROM rare JOIN posts ON posts.term = r.t),
around AS (SELECT doc_id, starts.win, s, o, term, unnest(range(s + o - {SLOP}, s + o + {SLOP} + 1)) AS p FROM starts JOIN places ON places.win = starts.win),
close AS (SELECT doc_id, win, s FROM around SEMI JOIN posts USING (doc_id, term, p) GROUP BY doc_id, win, s HAVING count(DISTINCT o) = len(win)),
near AS (SELECT doc_id, count(*) AS n_near, string_agg(s, ',' ORDER BY s) AS nl FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM close JOIN wins USING (win)) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0) AS n_near_items, sha256(coalesce(nl, '')) AS near_items_sha256
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))) AS g FROM d WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS class_id, (SELECT count(*) FROM links WHERE a = doc_id) AS n_links FROM d
"""

OP5 = """
WITH convs AS (SELECT lost, id, list(struct_pack(r := coalesce(role, 'unknown'), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS l
  FROM (SELECT conv_id IS NULL AS lost, coalesce(conv_id, row_number() OVER ()) AS id, turn, role, text FROM conversations) GROUP BY lost, id),
kept AS (SELECT a.lost, a.id, a.l FROM convs a WHERE NOT EXISTS (SELECT 1 FROM convs b WHERE a.l[1] = b.l[1] AND a.l = b.l[1:len(a.l)] AND (len(b.l) > len(a.l) OR b.lost < a.lost OR b.lost = a.lost AND b.id < a.id))),
texts AS (SELECT CASE WHEN NOT lost THEN id END AS conv_id, len(l) AS n_turns, list_aggregate(list_transform(l, lambda x: '<|im_start|>' || x.r || chr(10) || replace(replace(x.t, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10)), 'string_agg', '') AS text FROM kept)
SELECT conv_id, n_turns, length(text) AS n_chars, sha256(text) AS text_sha256 FROM texts
"""

_VALUES = ", ".join("({}, '{}', '{}')".format(i, x, y.replace("'", "''")) for i, (x, y) in enumerate(TEMPLATES))
_NAMES = ", ".join(f"'{x}'" for x in LICENSE_NAMES)
_FIRST = f"regexp_matches(lower(split_part(coalesce(text, ''), chr(10), 1)), '{CUE}')"
OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', source, CASE WHEN NOT ({_FIRST} AND doc_id % 7 = 0) THEN (doc_id // 4096)::VARCHAR END, CASE WHEN NOT ({_FIRST} AND doc_id % 7 < 2) THEN (doc_id // 64)::VARCHAR END) AS dir,
  CASE WHEN {_FIRST} THEN 'LICENSE-' ELSE 'text-' END || doc_id AS name FROM documents),
heads AS (SELECT doc_id, l, list_position(list_transform(l, lambda x: regexp_matches(x, '{COMMENT}')), false) AS past FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM d)),
parts AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t]+', '\\1' || chr(10), 'g'), chr(10))) AS x FROM d
  UNION ALL SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '\n[ \t\r]*\n', chr(1), 'g'), '([.!?])[ \t\r\n]+', '\\1' || chr(1), 'g'), chr(1))) FROM d
  UNION ALL SELECT doc_id, array_to_string(CASE WHEN coalesce(past, 0) = 0 THEN l ELSE l[1:past - 1] END, chr(10)) FROM heads),
s AS (SELECT doc_id, x AS st FROM parts WHERE regexp_matches(lower(x), '{CUE}') UNION SELECT doc_id, text FROM d WHERE name LIKE 'LICENSE-%' AND regexp_matches(lower(text), '{CUE}')),
u AS (SELECT DISTINCT st FROM s WHERE NOT (regexp_matches(lower(st), '{DENIES}') AND NOT regexp_matches(st, '{SEVERAL}'))),
told AS (SELECT doc_id, bool_or(regexp_matches(lower(st), '{DECLARES}')) AS declares FROM s GROUP BY doc_id),
x AS (SELECT doc_id, regexp_replace(regexp_extract(text, '{SPDX}', 1), '{CLOSED}', '') AS e FROM d),
spdx AS (SELECT doc_id, CASE WHEN contains(e, ' ') THEN e ELSE regexp_replace(e, '-(only|or-later)$', '') END AS e FROM x WHERE e <> ''),
t AS (SELECT * FROM (VALUES {_VALUES}) v(tid, license, text)),
terms AS (SELECT 'u' || st AS k, unnest(w) AS term FROM (SELECT st, {_WORDS.replace("text", "st")} AS w FROM u) UNION ALL SELECT 't' || tid, unnest({_WORDS}) FROM t),
tf AS (SELECT k, term, count(*) AS tf FROM terms GROUP BY k, term),
idf AS (SELECT term, ln(((SELECT count(*) FROM u) + (SELECT count(*) FROM t) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY term),
w AS (SELECT k, term, tf * idf AS w FROM tf JOIN idf USING (term)),
n AS (SELECT k, sqrt(sum(w * w)) AS n FROM w GROUP BY k),
c AS (SELECT a.k AS k, b.k AS tk, sum(a.w * b.w) AS dot FROM w a JOIN w b USING (term) WHERE a.k[1] = 'u' AND b.k[1] = 't' GROUP BY a.k, b.k),
sc AS (SELECT c.k[2:] AS st, license, round(dot / x.n / y.n, 9) AS score FROM c JOIN n x ON x.k = c.k JOIN n y ON y.k = c.tk JOIN t ON 't' || tid = c.tk),
own AS (SELECT doc_id, arg_min(license, (-score, license)) AS license, max(score) AS score FROM s JOIN sc USING (st) WHERE score >= 0.6 GROUP BY doc_id),
q AS (SELECT d.doc_id, dir, dir || '/' || name AS path, coalesce(e, license) AS license, CASE WHEN e IS NOT NULL THEN 1.0::DOUBLE ELSE score END AS score, coalesce(declares, false) AS declares, regexp_replace(lower(name), '[.\\-_].*$', '') IN ({_NAMES}) AS holder
  FROM d LEFT JOIN own USING (doc_id) LEFT JOIN told USING (doc_id) LEFT JOIN spdx USING (doc_id)),
r AS (SELECT doc_id, dir, path, coalesce(license, CASE WHEN declares OR holder THEN 'unknown' END) AS license, score, holder FROM q),
h AS (SELECT dir, arg_min(license, (coalesce(-score, 1), path)) AS license, max(score) AS score, arg_min(path, (coalesce(-score, 1), path)) AS path FROM r WHERE license IS NOT NULL AND holder GROUP BY dir),
up AS (SELECT r.doc_id, arg_max(h.license, length(h.dir)) AS license, arg_max(h.score, length(h.dir)) AS score, arg_max(h.path, length(h.dir)) AS path FROM r JOIN h ON r.dir = h.dir OR starts_with(r.dir, h.dir || '/') WHERE r.license IS NULL GROUP BY r.doc_id)
SELECT r.doc_id, r.path, coalesce(r.license, up.license) AS license, CASE WHEN r.license IS NOT NULL THEN r.score ELSE up.score END AS score, CASE WHEN r.license IS NOT NULL THEN r.path ELSE up.path END AS source_path FROM r LEFT JOIN up USING (doc_id)
"""

OP11 = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, w[i:i + 49] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT win, min(doc_id) AS first FROM wins GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, list(DISTINCT p) AS l FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM wins JOIN firsts USING (win) WHERE first < doc_id) GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(l), 0) AS n_removed, CASE WHEN l IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(l, i)) END AS k FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""


def _lloyd(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    """Plain Lloyd, one step a common table expression."""
    out = [f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT {k}))"""]
    for i in range(rounds + 1):
        out.append(f"""a{i} AS (SELECT vec_id, any_value(v.v) AS v, arg_min(c.c, (list_sum(list_transform(range(1, {dims + 1}), lambda j: (v.v[j] - c.v[j]) * (v.v[j] - c.v[j]))), c.c)) AS c,
  min(list_sum(list_transform(range(1, {dims + 1}), lambda j: (v.v[j] - c.v[j]) * (v.v[j] - c.v[j])))) AS distance FROM v, c{i} c GROUP BY vec_id)""")
        if i < rounds:
            out.append(f"""s{i} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY c, j),
m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM s{i} GROUP BY c),
c{i + 1} AS (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))""")
    return ",\n".join(out) + f"""
SELECT vec_id, a.c::INTEGER AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c
"""


#: CRC-32 bit by bit: a step for each character of the decimal number, then eight for its bits.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(s) + 1), lambda i: [ascii(s[i]), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""
OP13 = f"""
WITH convs AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hs AS (SELECT c, l, ({_CRC}) % 9 AS h FROM (SELECT c, l, c::VARCHAR AS s FROM convs)),
built AS (SELECT a.c, list_concat(coalesce(b.l[1:h], []), coalesce(a.l[h + 1:], [])) AS l FROM hs a LEFT JOIN convs b ON b.c = a.c - a.c % 5),
pre AS (SELECT c, d, l[1:d] AS k, len(l) = d AS ends FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM built)),
nodes AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '') AS e FROM pre GROUP BY d, k),
kids AS (SELECT n.d, n.k, count(x.d) AS n_children FROM nodes n LEFT JOIN nodes x ON x.d = n.d + 1 AND x.k[1:n.d] = n.k GROUP BY n.d, n.k),
own AS (SELECT d, k, n_children, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(k[d].t) END AS saved FROM nodes JOIN kids USING (d, k)),
up AS (SELECT d, k, unnest(range(0, d + 1)) AS ad, n_children, saved FROM own),
sums AS (SELECT ad AS d, k[1:ad] AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, sha256(n.e) AS ends_sha256
FROM nodes n JOIN kids USING (d, k) JOIN sums USING (d, k) LEFT JOIN nodes p ON p.d = n.d - 1 AND p.k = n.k[1:p.d]
"""

ORACLES = {
    "op2_line_dedup": OP2,
    "op4_decontamination": OP4,
    "op5_chat": OP5,
    "op9_near_join": OP9,
    "op10_licenses": OP10,
    "op11_substring_dedup": OP11,
    "op12_centroids": _lloyd(),
    "op13_prefix_trie": OP13,
}
