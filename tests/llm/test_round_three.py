"""Substring dedup, centroid clustering and the prefix trie against brute force and SQL, with edge rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from duck import same_rows
from pyspark.sql import functions as F

from tallyforge.llm import centroids, html_extract, license_texts, licenses, prefix_trie, substrings
from tallyforge.llm.oracles import ORACLES
from tallyforge.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, n_words string, __doc int"


@pytest.mark.parametrize("name", ["op11_substring_dedup", "op12_centroids", "op13_prefix_trie"])
def test_same_rows_as_sql(spark, data, name):
    same_rows(QUERIES[name](spark, data), ORACLES[name], data)


# passages

def passages_by_hand(rows):
    """(words, kept text) of each row: windows of each row, looked up among all rows with a smaller id."""
    key = [2**63 if i is None else i for i, _ in rows]
    split = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    least = {}
    for k, w in zip(key, split, strict=True):
        for i in range(len(w) - 49):
            win = tuple(w[i : i + 50])
            least[win] = min(least.get(win, k), k)
    out = []
    for k, w in zip(key, split, strict=True):
        gone = {p for i in range(len(w) - 49) if least[tuple(w[i : i + 50])] < k for p in range(i, i + 50)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def passage_rows():
    r = random.Random(5)
    def some(n, of=4000):
        return [f"w{r.randrange(of)}" for _ in range(n)]
    shared, other, edge = some(90), some(50), some(49)
    out = [(10, None), (11, ""), (12, " \t\n\x0b\x0c\r "), (13, "one"), (14, " ".join(shared))]
    for i in range(20, 40):
        own = [some(r.randrange(0, 120)), shared[r.randrange(0, 45) :][: r.randrange(30, 90)], some(r.randrange(0, 60)), other, edge, some(7)]
        out.append((i, "".join(w + r.choice([" ", "\n", "\t", "  ", " \x1c "]) for part in own for w in part)))
    out += [(50, "x " * 400), (51, "x " * 130 + "y " + "x " * 60), (52, "a b " * 90), (53, "b a " * 70), (54, "\x00 " * 60), (55, "\x00 \x00\x00 " * 40)]
    out += [(60, " ".join(shared)), (60, " ".join(shared)), (60, " ".join(other + shared)), (None, " ".join(shared)), (None, " ".join(some(80))), (5, " ".join(other))]
    out += [(None, out[-2][1]), (70, "Zoë ß 😀 " * 40), (71, "Zoë ß 😀 " * 30), (72, " ".join(shared[:60] + ["y" * 3000] + shared[60:]))]
    return out


@pytest.mark.parametrize("piece", [1 << 19, 700])
def test_passages(spark, monkeypatch, piece):
    rows = passage_rows()
    monkeypatch.setattr(substrings, "PIECE", piece)
    got = list(substrings.runs([None if t is None else t.encode() for _, t in rows]))
    assert len(got) > 1 or piece > 700
    want = sorted(map(repr, zip([i for i, _ in rows], passages_by_hand(rows), strict=True)))
    given = spark.createDataFrame([(i, t, "en", "clash", 1) for i, t in rows], DOCS)
    out = substrings.dedup_passages(given.repartition(5))
    assert sorted(out.columns) == sorted(["doc_id", "lang", "__doc", "text", "n_words", "n_removed"])
    assert sorted(repr((r["doc_id"], (r["n_words"], r["n_removed"], r["text"]))) for r in out.collect()) == want


def test_pieces_of_a_long_text_hash_like_the_whole(monkeypatch):
    r = random.Random(2)
    text = " ".join(f"w{r.randrange(300)}" * r.choice([1, 1, 30]) for _ in range(3000)).encode()
    def all_windows():
        parts = list(substrings.windows([b"a b c", text]))
        return sorted(zip(*[np.concatenate([p[i] for p in parts]).tolist() for i in range(5)], strict=True))
    whole = all_windows()
    monkeypatch.setattr(substrings, "PIECE", 400)
    assert len(list(substrings.pieces([text]))) > 5 and all_windows() == whole and len(whole) == 2951


def test_the_sketch_never_underestimates(spark):
    """With a sketch as small as can be, cells collide and no repeated anchor is missed."""
    texts = [t for _, t in passage_rows()]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    full = {(r["row"], r["cell"]) for r in substrings.repeated_cells(docs, substrings.BLOCK_BITS).collect()}
    held = defaultdict(set)
    for i, t in enumerate(texts):
        for _, _, _, h, _, _ in substrings.runs([None if t is None else t.encode()]):
            for x in h.tolist():
                held[x].add(i)
    many = [h for h, own in held.items() if len(own) > 1]
    assert many and all((row, (h >> shift) % (1 << substrings.BLOCK_BITS)) in full for h in many for row, shift in enumerate(substrings.ROWS))


def test_passages_of_an_empty_table(spark):
    out = substrings.dedup_passages(spark.createDataFrame([], DOCS))
    assert out.count() == 0 and set(out.columns) >= {"doc_id", "text", "n_words", "n_removed"}


# clusters

VECTORS = "vec_id long, embedding array<double>, cluster string, v int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "clash", 1) for i, v in rows], VECTORS)


def clustered(frame, **options):
    return sorted((r["vec_id"], r["cluster"], r["distance"]) for r in centroids.cluster(frame, **options).collect())


def clusters_by_hand(rows, k=16, rounds=3, seed=1):
    """(vec_id, cluster, distance) by plain Lloyd over whole vectors."""
    vectors = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows]
    order = sorted(vectors, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        owners = [nearest(v)[1] for _, v in vectors]
        for c in range(len(centroids)):
            own = [v for (_, v), o in zip(vectors, owners, strict=True) if o == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in vectors]


@pytest.mark.parametrize(("n", "spread"), [(300, 1.0), (40, 0.02), (5, 1.0), (60, 5e4)])
def test_clusters(spark, n, spread):
    r = np.random.default_rng(n)
    rows = [(i, list(r.normal(size=64) * spread)) for i in range(n)] + [(i, [0.25] * 64) for i in range(n, n + 6)] + [(0, [0.5] * 64)]
    odd = [(900, None), (901, [1.0] * 63), (902, [1.0] * 65), (903, [float("nan")] * 64), (904, [1.0] * 63 + [float("inf")]), (905, [1.0] * 63 + [None]), (906, [])]
    assert clustered(vectors(spark, rows + odd)) == sorted(clusters_by_hand(rows))


def test_clusters_by_few_centroids_and_many_rounds(spark):
    r = np.random.default_rng(1)
    rows = [(i, list(r.normal(size=64))) for i in range(200)]
    assert clustered(vectors(spark, rows), k=3, rounds=30) == sorted(clusters_by_hand(rows, k=3, rounds=30))


def test_each_round_compares_only_what_moved():
    """A vector whose own centroid stayed is compared with the moved ones alone; the centroids that stayed are not looked at, so wrong ones change nothing."""
    import pyarrow as pa

    v = np.arange(256).reshape(4, 64) % 7
    rows = pa.RecordBatch.from_arrays([pa.array([0, 1, 2, 3]), pa.array(v.tolist(), pa.list_(pa.int32())), pa.array([0, 1, 1, 2], pa.int32()), pa.array([5, 0, 10**9, 7]), pa.array([None] * 4, pa.int32())], names=["vec_id", "v", "cluster", "distance", "was"])
    centres = [v[0].tolist(), v[1].tolist(), [10**4] * 64]
    (out,) = list(centroids.reassign(centres, [2])([rows]))
    assert out.column("cluster").to_pylist() == [0, 1, 1, int(centroids.squared(v[3:], np.array(centres))[0].argmin())]
    assert out.column("distance").to_pylist()[:3] == [5, 0, 10**9] and out.column("was").to_pylist() == [0, 1, 1, 2]


def test_sums_and_hashes_of_clusters(spark):
    r = np.random.default_rng(9)
    rows = [(i, list(r.normal(size=64))) for i in range(100)]
    out = centroids.cluster(vectors(spark, rows)).withColumn("sha", centroids.digest(F.col("centroid"))).collect()
    for row in out:
        own = [x for x in out if x["cluster"] == row["cluster"]]
        assert row["cluster_inertia"] == sum(x["distance"] for x in own) and row["inertia"] == sum(x["distance"] for x in out)
        assert row["sha"] == hashlib.sha256(",".join(map(str, row["centroid"])).encode()).hexdigest()
        scaled = np.floor(np.array(rows[row["vec_id"]][1]) * 64)
        assert row["distance"] == int(((scaled - np.array(row["centroid"])) ** 2).sum())


def test_no_vectors_and_far_ones(spark):
    assert clustered(vectors(spark, [])) == [] and clustered(vectors(spark, [(1, None)])) == []
    far = [(1, [1e300] * 64), (2, [-1e300] * 64), (None, [1e300] * 64), (4, [0.0] * 64)]
    found = {r["vec_id"]: (r["cluster"], r["distance"]) for r in centroids.cluster(vectors(spark, far), k=2, rounds=2).collect()}
    assert len(found) == 4 and found[1][0] == found[None][0] and all(d >= 0 for _, d in found.values())


# prefixes

TURNS = "conv_id long, turn long, role string, text string, pos string, p1 int"


def trie_by_hand(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c in turns:
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c - 5 * int(c / 5))
        made[c] = turns.get(base, [])[:h] + turns[c][h:] if rebuild else turns[c]
    members = defaultdict(list)
    for c, t in made.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    def below(node):
        yield node
        for x in children[node]:
            yield from below(x)
    out = []
    for node, convs in members.items():
        tree = list(below(node))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in tree if x)
        end = ",".join(map(str, sorted(c for c in convs if len(made[c]) == len(node))))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), sum(not children[x] for x in tree), saved, hashlib.sha256(end.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(frame, **options):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in names) for r in prefix_trie.trie(frame, **options).collect()), key=repr)


def turn_rows():
    r = random.Random(3)
    rows = []
    for c in [*range(40), 20_003, 20_004, 20_007, 90_000, -3, -5, -10, 2**40, 2**40 + 1]:
        for t in range(r.choice([1, 2, 3, 5, 8, 12])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", r.choice(["Héllo", "ok", "", None, f"t{r.randrange(3)}"])))
    rows += [(c, t, "user", "same") for c in (100, 105, 5_000, 12_005, 30_010) for t in range(4)]  # copies in several blocks of ids
    rows += [(7, None, None, "first"), (7, None, "a", None), (8, 1, "user", "again"), (8, 1, "user", "again"), (None, 1, "user", "x"), (None, None, None, None), (50, 3, "us", "er"), (51, 3, "u", "ser")]
    return rows


def test_trie(spark):
    rows = turn_rows()
    frame = spark.createDataFrame([(*x, "clash", 1) for x in rows], TURNS).repartition(4)
    assert trie_rows(frame) == trie_by_hand(rows)
    assert trie_rows(frame, rebuild=None) == trie_by_hand(rows, rebuild=False)


def test_trie_of_long_conversations(spark):
    """Two that share 150 of 300 turns, numbered alike or not at all: spans within spans, and nine rounds of doubling."""
    rows = [(c, t, "user", f"{c if t >= 150 else 0} {t}") for c in (10, 15) for t in range(300)] + [(20, None, "user", f"{t:03}") for t in range(200)]
    frame = spark.createDataFrame([(*x, "clash", 1) for x in rows], TURNS)
    assert trie_rows(frame, rebuild=None) == trie_by_hand(rows, rebuild=False)


def test_trie_of_nothing(spark):
    assert trie_rows(spark.createDataFrame([], TURNS)) == [] and trie_rows(spark.createDataFrame([(None, 1, "a", "b", None, None)], TURNS)) == []


# licences that are not known, denied, or given as expressions

ECLIPSE = "Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\")."


@pytest.mark.parametrize(("path", "text", "name"), [
    ("LICENSE.md", ECLIPSE, "EPL-2.0"), ("x.c", "// Licensed under the EUPL, Version 1.2\nint x;", "EUPL-1.2"), ("x.c", "# All rights reserved. Proprietary and confidential.", "unknown"),
    ("x.c", "# This file is not covered by the MIT License.", "unknown"), ("x.c", "not licensed under the GNU GPL, version 2", "unknown"), ("x.c", "# no longer released under the MIT License.\n", "unknown"),
    ("x.c", "// SPDX-License-Identifier: MIT OR Apache-2.0\n", "MIT OR Apache-2.0"), ("x.c", "/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */", "GPL-2.0-only WITH Linux-syscall-note"),
    ("x.c", "<!-- SPDX-License-Identifier: LicenseRef-Own -->", "LicenseRef-Own"), ("x.c", "# SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"), ("x.c", "# SPDX-License-Identifier:\n", None),
    ("LICENSE", "Some words that no one has used before.", "unknown"), ("LICENSE", "", "unknown"), ("COPYING", None, "unknown"), ("NOTICE", "This product includes work of others.", None), ("x.c", "Copyright 2020 Someone. All rights reserved.", None),
    ("x.c", "Licensed under the zlib License.", "Zlib"), ("x.md", "Boost Software License, Version 1.0", "BSL-1.0"), ("x.md", "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "OFL-1.1"),
])
def test_own_statements(spark, path, text, name):
    assert licenses.scan(spark.createDataFrame([(1, f"r/{path}", text)], "rid long, path string, text string")).first()["license"] == name


def test_an_unrecognised_licence_file_stops_inheritance(spark):
    rows = [
        (1, "LICENSE", "Released under the MIT License."), (2, "z/LICENSE.md", "Words of our own."), (3, "z/a/x.c", "code"), (4, "y/x.c", "code"), (5, "y/n.c", "# This file is not covered by the MIT License."),
        (6, "w/NOTICE", "Thanks to all."), (7, "w/x.c", "code"), (8, "z/b/LICENSE", ECLIPSE), (9, "z/b/x.c", "code"), (10, "v/LICENSE-a", "Words of our own."), (11, "v/LICENSE-b", "Licensed under the ISC License."), (12, "v/x.c", "code")]
    out = {r["rid"]: (r["license"], r["source_path"], r["score"] is None) for r in licenses.scan(spark.createDataFrame(rows, "rid long, path string, text string")).collect()}
    assert out[2] == ("unknown", "z/LICENSE.md", True) and out[3] == ("unknown", "z/LICENSE.md", True) and out[4] == ("MIT", "LICENSE", False)
    assert out[5] == ("unknown", "y/n.c", True) and out[6][:2] == out[7][:2] == ("MIT", "LICENSE") and out[9] == ("EPL-2.0", "z/b/LICENSE", False)
    assert out[12][:2] == ("ISC", "v/LICENSE-b") and out[10][0] == "unknown"


def test_there_are_thirty_licences_and_more():
    assert len(license_texts.NAMES) >= 30 and {"EPL-2.0", "EUPL-1.2", "CDDL-1.0", "Zlib", "BSL-1.0", "Artistic-2.0", "OFL-1.1", "MS-PL"} <= set(license_texts.NAMES)


# regions of pages on hosts that have a template

def prose(k, n, salt):
    r = random.Random(f"{k} {salt}")
    return " ".join(r.choice(["river", "stone", "winter", "letter", "garden", "window", "market", "silver"]) + str(r.randrange(90)) for _ in range(n))


def around(k, inner):
    return f"<html><head><title>T {k}</title></head><body><nav><a href=/>Home</a> <a href=/a>About</a></nav><div class=top><span>Site name</span></div>{inner}<footer>Contact and imprint</footer></body></html>"


def article_beside_a_sidebar(k):
    a = prose(k, 30, "a")
    return f"<main><article><p>{a}</p></article><aside class=sidebar><p>{prose(k, 90, 'b')}</p></aside></main>", [a]


def article_above_comments(k):
    a = prose(k, 30, "a")
    return f"<div id=page><article><p>{a}</p></article><div class=comments>{''.join(f'<div class=c><p>{prose(k, 20, j)}</p></div>' for j in range(6))}</div></div>", [a]


def two_articles(k):
    a, b = prose(k, 60, "a"), prose(k, 25, "b")
    return f"<main><article class=lead><p>{a}</p></article><article class=second><p>{b}</p></article></main>", [a, b]


def a_short_second_article(k):
    a, b = prose(k, 90, "a"), prose(k, 8, "b")
    return f"<main><article class=lead><p>{a}</p></article><article class=second><p>{b}</p></article></main>", [a, b]


def two_parts(k):
    a, b = prose(k, 60, "a"), prose(k, 20, "b")
    return f"<div class=w1><div class=x1><p>{a}</p></div><div class=x2><p>{b}</p></div></div>", [a, b]


def article_with_sources(k):
    a, links = prose(k, 40, "a"), [prose(k, 3, j) for j in range(4)]
    return f"<main><article><p>{a}</p><ul>{''.join(f'<li><a href=/s{j}>{x}</a></li>' for j, x in enumerate(links))}</ul></article></main>", [a, *links]


def article_with_headings_of_the_host(k):
    a, b = prose(k, 30, "a"), prose(k, 30, "b")
    return f"<main><article><h1>{prose(k, 4, 'h')}</h1><h2>Summary</h2><p>{a}</p><h2>Details</h2><p>{b}</p><p>Reported by the same desk.</p></article></main>", [prose(k, 4, "h"), "Summary", a, "Details", b, "Reported by the same desk."]


def article_with_ambiguous_names(k):
    parts = [prose(k, 20, j) for j in range(4)]
    return f"<main><article><p>{parts[0]}</p><div class=more><p>{parts[1]}</p></div><div class=social-history><p>{parts[2]}</p></div><section class=discussion><p>{parts[3]}</p></section></article></main>", parts


def article_with_adverts(k):
    a, b = prose(k, 20, "a"), prose(k, 20, "b")
    return f"<main><article><p>{a}</p><p class=advert>{prose(k, 9, 'x')}</p><div style='display:none'><p>{prose(k, 9, 'y')}</p></div><p style=\"color:red; visibility: hidden\">{prose(k, 9, 'z')}</p><p>{b}</p></article></main>", [a, b]


def article_with_references(k):
    a = prose(k, 30, "a")
    return f"<main><article><p>{a} A&<b>amp;</b>B &lt;{k}&gt; x&amp;lt;y</p></article></main>", [f"{a} A&amp;B <{k}> x&lt;y"]


CASES = [article_beside_a_sidebar, article_above_comments, two_articles, a_short_second_article, two_parts, article_with_sources, article_with_headings_of_the_host, article_with_ambiguous_names, article_with_adverts, article_with_references]


def test_regions_on_hosts_with_a_template(spark):
    """Six pages a host: each gives the text worked out by hand, whether or not a template is deduced."""
    rows, want = [], {}
    for c, case in enumerate(CASES):
        for k in range(6):
            inner, blocks = case(k)
            rows.append((100 * c + k, f"http://h{c}.example/{k}", around(k, inner), "extra"))
            want[100 * c + k] = "\n".join(blocks)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    marked = html_extract.templates(html_extract.hosts(pages))
    assert marked.count() == len(CASES)
    for deduce in (True, False):
        got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(pages, deduce=deduce).collect()}
        wrong = {CASES[i // 100].__name__: (got[i], want[i]) for i in want if got[i] != want[i]}
        assert deduce and not wrong or not deduce and set(wrong) <= {"two_parts"}, wrong


def test_a_long_page_on_a_host_with_a_template(spark):
    long = [prose(0, 40, j) for j in range(1500)]
    rows = [(k, f"http://long.example/{k}", around(k, f"<main><article>{''.join(f'<p>{x}</p>' for x in (long if k == 0 else [prose(k, 30, 1)]))}</article></main>"), "e") for k in range(6)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert got[0] == "\n".join(long) and got[1] == prose(1, 30, 1)
