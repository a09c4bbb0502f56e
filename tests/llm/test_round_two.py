"""Edge rows, brute force and clashing columns of the text operators."""

from __future__ import annotations

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import common, decontaminate, html_extract, language, licenses, line_dedup, near_join, pieces, quality, simhash
from tallyforge.llm.common import table
from tallyforge.llm.pytext import find_words, shingle_set
from tallyforge.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in zip(range(len(texts)) if ids is None else ids, texts, strict=True)], DOCS)


# pages: the template decides

def nameless(k):
    """No article element and no telling name; what surrounds the article differs from page to page."""
    parts = "".join(f"<div class='d4'><p>Part {j} of story {k}, with words enough to be the running text.<p>And more of {j} in {k}</div>" for j in range(2))
    return f"""<html><body><div class=a1><a href=/>Home {k}</a> <a href=/x>Section {k}</a></div><div class=b2>An offer of day {k}</div><div class=c3><h2>Title {k}</h2>
    <div class=f6>{parts}</div></div><div class=e5>Printed for {k}</div></body></html>"""


def nameless_text(k):
    return "\n".join([f"Title {k}", *(x for j in range(2) for x in (f"Part {j} of story {k}, with words enough to be the running text.", f"And more of {j} in {k}"))])


def test_slots_of_the_template_hold_the_article(spark):
    rows = [(k, f"http://plain.example/{k}", nameless(k)) for k in range(9)] + [(50, "http://one.example/", nameless(50))]
    pages = spark.createDataFrame(rows, PAGES)
    want = {k: nameless_text(k) for k in range(9)}
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(pages).collect()}
    assert {k: got[k] for k in want} == want and got[50] != nameless_text(50)
    assert {r["page_id"]: r["text"] for r in html_extract.extract_pages(pages, roles=False).collect()} == got | {50: got[50]}
    off = {r["page_id"]: r["text"] for r in html_extract.extract_pages(pages, deduce=False).collect()}
    assert all(off[k] != want[k] and f"An offer of day {k}" in off[k] for k in want)


def test_templates_dealt_to_groups_of_pages(spark):
    rows = [(k, f"http://h{k % 3}.example/{k}", nameless(k)) for k in range(40)] + [(99, None, "<p>x"), (98, "http://h0.example/", None)]
    pages = spark.createDataFrame(rows, PAGES)
    whole = sorted(map(tuple, html_extract.extract_pages(pages).collect()))
    assert whole == sorted(map(tuple, html_extract.extract_pages(pages, sent=0, a_task=4).collect()))
    assert {p: t for p, _, t in whole} == {k: nameless_text(k) for k in range(40)} | {99: "x", 98: ""}


def test_template_alone_finds_every_article_of_the_table(spark, data):
    pages = table(spark, data, "pages")
    many = html_extract.hosts(pages).groupBy("host").count().where(f"count >= {html_extract.LEAST_PAGES}").select("host")
    chosen = html_extract.hosts(pages).join(many, "host", "left_semi").drop("host").cache()
    whole = {r["page_id"]: r["text"] for r in html_extract.extract_pages(chosen).collect()}
    template = {r["page_id"]: r["text"] for r in html_extract.extract_pages(chosen, roles=False).collect()}
    neither = {r["page_id"]: r["text"] for r in html_extract.extract_pages(chosen, deduce=False, roles=False).collect()}
    assert whole and template == whole and all(neither[k] != whole[k] for k in whole)


def test_repeated_pages_keep_their_text(spark):
    rows = [(k, "http://copies.example/", nameless(1)) for k in range(7)]
    got = {r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {nameless_text(1)} or all(nameless_text(1) in x for x in got)


@pytest.mark.parametrize("page", ["<a " * 333_000, "<div>" * 200_000, "<div>" * 100_000 + "</p>" * 100_000, '<a "' * 250_000 + ">", "<!--" * 250_000, "<p class='x" * 90_000 + ">", "<li>x" * 200_000])
def test_long_broken_pages(page):
    began = time.perf_counter()
    html_extract.main_text(page, {1: (1, 0)})
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("page, text", [
    ("<div><div class='entry-content'><p>short</p></div><div class='entry-content'><p>the longer of the two</p></div></div>", "short\nthe longer of the two"),
    ("<body><p>before</p><div class='text'>inside</div><p>after</p><div class='odd'>other</div></body>", "before\ninside\nafter"),
    ("<article><p class='more'>a</p><p class='follow-up'>b</p><div class='share'>c</div></article>", "a\nb"),
    ("<article>one</article><article>two</article>", "one\ntwo"), ("a < b <p>c<d> e", "a < b\nc e"), ('<p title="a > b">x</p><p title="open>y</p>', "x\ny"),
])
def test_nothing_of_an_article_is_lost(page, text):
    assert html_extract.main_text(page, None) == text


# components

def test_rounds_of_a_chain(spark, monkeypatch):
    rounds, write = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: rounds.append(name) or write(df, name))
    found = common.components(spark.range(200).selectExpr("id + 1 a", "id b")).collect()
    assert {r["root"] for r in found} == {0} and len(found) == 201
    assert rounds.count("down") <= 20


# pieces

def test_further_segmentations(spark, data):
    v = pieces.load()
    texts = table(spark, data, "documents").select("doc_id", "text")
    encoder, rows = pieces.Encoder(v), {r["doc_id"]: r for r in QUERIES["op3_pieces"](spark, data).collect()}
    for r in texts.collect():
        out, own = rows[r["doc_id"]], encoder.n_best(r["text"])
        changes = [[tuple(x) for x in one] for one in out["others"]]
        assert [ids for _, ids in own] == [out["ids"], *(pieces.edited(out["ids"], x) for x in changes)] if own else out["ids"] == []
        assert all(pieces.decode(ids, v) == r["text"] for _, ids in own) and out["scores"] == sorted(out["scores"], reverse=True)


def test_long_chunks_are_not_remembered():
    encoder = pieces.Encoder(pieces.load())
    for k in range(20):
        text = "".join(chr(0x4E00 + (7 * k + i * i) % 2000) for i in range(3000))
        assert pieces.decode(encoder.encode(text)[0].tolist(), encoder.v) == text
    assert sum(map(len, encoder.known)) < 1000


# decontamination

def near_by_hand(texts, items, size, slop):
    every = [find_words(t) for t in texts]
    count = {}
    for w in every:
        for x in w:
            count[x] = count.get(x, 0) + 1
    out = [set() for _ in texts]
    for item, t in items:
        w = find_words(t)
        for win in {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else ():
            if any(x not in count for x in win):
                continue
            rare = min(range(len(win)), key=lambda o: (count[win[o]], win[o], o))
            for d, words in enumerate(every):
                starts = [p - rare for p, x in enumerate(words) if x == win[rare]]
                if any(all(o == rare or win[o] in words[max(0, s + o - slop) : max(0, s + o + slop + 1)] for o in range(len(win))) for s in starts):
                    out[d].add(str(item))
    return [sorted(x) for x in out]


def test_proximity_by_hand(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 14))) for _ in range(30)] + [None, ""]
    items = [(k, " ".join(rng.choice(list("abcdefgh"), rng.integers(1, 6)))) for k in range(6)] + [(9, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size, slop in ((3, 1), (4, 2), (2, 0)):
        out = decontaminate.contamination(docs(spark, texts), bench, size, slop=slop).orderBy("doc").collect()
        assert [r["near_items"] for r in out] == near_by_hand(texts, [(i, t) for i, t in items if t], size, slop)
        assert all(set(r["items"]) <= set(r["near_items"]) for r in out)
        if slop == 0:
            assert all(r["items"] == r["near_items"] for r in out)


# quality

def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    rank, of = rng.integers(0, 4, 40), np.repeat(np.arange(40), 5)
    column, theta = rng.integers(0, 6, 200), np.concatenate([[-0.5], rng.normal(0, 0.3, 2), rng.normal(0, 0.5, 6)])
    value, grad = quality.likelihood(theta, 3, rank, of, column, 0.01)
    by_hand = 0.0
    t = theta[0] + np.array([0, np.exp(theta[1]), np.exp(theta[1]) + np.exp(theta[2])])
    for i in range(40):
        z = theta[3:][column[of == i]].sum()
        above = [1.0, *(1 / (1 + np.exp(t - z))), 0.0]
        by_hand += np.log(above[rank[i]] - above[rank[i] + 1]) / 40
    assert value == pytest.approx(by_hand - 0.005 * (theta[3:] ** 2).sum())
    for k in range(len(theta)):
        step = np.zeros(len(theta))
        step[k] = 1e-6
        slope = (quality.likelihood(theta + step, 3, rank, of, column, 0.01)[0] - quality.likelihood(theta - step, 3, rank, of, column, 0.01)[0]) / 2e-6
        assert grad[k] == pytest.approx(slope, abs=1e-6)


def test_the_order_of_rows_changes_no_weight(spark, data):
    given, graded = table(spark, data, "documents"), quality.ratings(table(spark, data, "labels"))
    one, two = (quality.train(x, graded, top=2) for x in (given, given.orderBy(F.desc("doc_id")).repartition(5)))
    assert (one.weights == two.weights).all() and (one.thresholds == two.thresholds).all()


# languages

def test_sets_of_languages_by_enumeration():
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.full(60, 0.15), 4) * 0.999 + 0.001 / 60
    p /= p.sum(axis=1, keepdims=True)
    for share in ([1, 0, 0, 0], [0.6, 0.4, 0, 0], [0.4, 0.35, 0.25, 0], [0, 0, 0.9, 0.1]):
        counts = rng.multinomial(3000, np.array(share) @ p)
        cost = language.PENALTY * np.log(counts.sum())
        best = max((subset for n in (1, 2, 3, 4) for subset in itertools.combinations(range(4), n)), key=lambda s: language.proportions(counts.astype(float), p[list(s)])[1] - cost * len(s))
        chosen, own = language.languages(counts, p, np.log(p))
        assert set(chosen) == set(best) and own.sum() == pytest.approx(1)
        assert chosen[int(own.argmax())] == int(np.argmax(share))


def test_letters_and_scores(spark, tmp_path):
    rows = [(k, x * 20, lang, "s", 1) for k, (x, lang) in enumerate([("the cat and the hat of ", "en"), ("der hund und die katze ", "de")] * 6)]
    rows += [(100, "\u00bd \u00b2 \u2460", "en", "s", 1), (101, "a", None, "s", 1), (None, "the cat and the dog", "de", "s", 1), (None, None, None, None, None), (102, "1 2 _ ...", "en", "s", 1), (0, rows[0][1], "en", "s", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op8_language"](spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert got[100]["lang_pred"] == got[102]["lang_pred"] == "und" and got[100]["score"] == 0
    assert got[101]["lang_pred"] in ("en", "de") and got[101]["score"] < 0.7 < got[0]["score"] <= 1
    assert sorted(r["lang_pred"] for r in out if r["doc_id"] is None) == ["en", "und"]
    assert (language.trigrams("a\u2014b") == language.trigrams("a b")).all()
    docs(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op8_language"](spark, f"{tmp_path}/none").count() == 0


# licences

BSD = "Copyright (c) 2020, Someone. All rights reserved.\n\n" + next(t for x, t in licenses.TEMPLATES if x == "BSD-3-Clause" and t.startswith("Redistribution"))
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
code"""


@pytest.mark.parametrize("path, text, name", [
    ("x.c", "// SPDX-License-Identifier: MIT\nint main;", "MIT"), ("x.c", "# SPDX-License-Identifier: GPL-2.0-or-later\n", "GPL-2.0"), ("x.c", "# SPDX-License-Identifier: ISC\n", "ISC"),
    ("x.c", "# SPDX-License-Identifier: Apache-2.0\n", "Apache-2.0"), ("LICENSE", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", "Apache-2.0"), ("x.py", GPL, "GPL-3.0"),
    ("x.py", GPL.replace("version 3", "version 2"), "GPL-2.0"), ("LICENSE", BSD, "BSD-3-Clause"), ("COPYING", BSD.replace(next(t for x, t in licenses.TEMPLATES if x == "BSD-3-Clause" and t.startswith("3.")), ""), "BSD-2-Clause"),
    ("LICENSE.md", "ISC License\n\nCopyright 2019 X\n\n" + next(t for x, t in licenses.TEMPLATES if x == "ISC" and "DISCLAIMS" in t), "ISC"), ("x.c", "Licensed under the Apache License", "Apache-2.0"),
    ("x.md", "The license of a driver was renewed in spring, and nothing else happened that year.", None), ("x.md", "no cue", None),
])
def test_usual_wordings(spark, path, text, name):
    assert licenses.scan(spark.createDataFrame([(1, f"r/{path}", text)], "rid long, path string, text string")).first()["license"] == name


def test_rows_of_one_id(spark, tmp_path):
    rows = [(1, "Licensed under the Apache License, Version 2.0.\nx", "en", "s", 1), (1, "nothing here", "en", "t", 1), (None, "Licensed under the Apache License", "en", "u", 1), (None, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = sorted((repr(r["doc_id"]), repr(r["license"]), r["source_path"]) for r in QUERIES["op10_licenses"](spark, str(tmp_path)).collect())
    assert [x[:2] for x in out] == [("1", "'Apache-2.0'"), ("1", "None"), ("None", "'Apache-2.0'"), ("None", "None")]


def test_licences_come_from_several_levels(spark, tmp_path):
    says = {0: "Licensed under CC BY 4.0.", 8: "Released under the MIT License.", 72: "Licensed under the ISC License."}
    docs(spark, [says.get(k, "plain text") for k in (0, 1, 8, 72, 73, 5000)], (0, 1, 8, 72, 73, 5000)).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: (r["license"], r["source_path"]) for r in QUERIES["op10_licenses"](spark, str(tmp_path)).collect()}
    assert out[1] == ("MIT", "src0/0/LICENSE-8") and out[73] == ("ISC", "src0/0/1/LICENSE-72") and out[5000] == ("CC-BY-4.0", "src0/LICENSE-0")


# clashing names

EXTRA = ["doc", "same", "node", "term", "pos", "rid", "w", "bucket", "place", "key", "score", "ids", "others", "tail", "n_lines", "__doc", "__same", "__gone", "__lines", "__own", "__place", "lang_pred", "late", "kind", "host", "template"]


def test_columns_of_the_same_names(spark, data):
    few = ["one two three four five six seven", "one two three four five six seven eight", "a line of text here\nand one more line", None, "", "a line of text here\nx"]
    plain = docs(spark, few)
    wide = plain.withColumns({c: F.lit("x") for c in EXTRA})
    items = spark.createDataFrame([(1, "three four five")], "item_id long, text string")
    model = quality.train(plain, spark.createDataFrame([(0, 0), (1, 2), (2, 1), (4, 0)], "doc_id long, grade int"), top=2)
    runs = {
        "lines": (lambda d: line_dedup.dedup_lines(d), ["doc_id", "text", "n_lines", "n_dropped"]), "leaks": (lambda d: decontaminate.contamination(d, items.withColumn("wid", F.lit(1)), 2), None),
        "near": (lambda d: near_join.near_classes(d), None), "prints": (lambda d: simhash.with_next(d), None), "pieces": (lambda d: pieces.encode_texts(d, pieces.load()), ["doc_id", "ids", "scores", "others"]),
        "quality": (lambda d: quality.score(d, model), ["doc_id", "expected_grade", "tail"]), "language": (lambda d: language.identify(d, ["en", "de"], np.full((2, language.BUCKETS), 1 / language.BUCKETS)), ["doc_id", "lang_pred", "score"]),
        "licences": (lambda d: licenses.scan(d.drop("path", "rid").withColumns({"rid": F.col("doc_id"), "path": F.lit("a/b")})), None),
    }
    for name, (run, columns) in runs.items():
        one, two = (sorted(map(repr, (run(d).select(columns) if columns else run(d)).collect())) for d in (plain, wide))
        assert one == two, name
    for stage in (corpus_pipeline.new_lines, corpus_pipeline.one_of_each, corpus_pipeline.unseen_benchmarks, corpus_pipeline.good_quality):
        one, two = stage(spark, plain, data), stage(spark, wide, data)
        assert two.columns == wide.columns and sorted(map(repr, one.collect())) == sorted(map(repr, two.select(plain.columns).collect())), stage


# pipeline by brute force

def test_stages_by_hand(spark, data):
    base = [f"w{i}" for i in range(60)]
    item = next(r["text"] for r in table(spark, data, "benchmark").orderBy("item_id").collect() if len(find_words(r["text"])) >= 12)
    texts = [" ".join(base), " ".join(base[:-2]), " ".join(base), "quite another text of a few words", "before " + item + " after", None, "", " ".join(f"v{i}" for i in range(40)), " ".join(f"v{i}" for i in range(38)), "solo"]
    ids = [5, 3, None, 8, 9, 10, None, None, None, 8]
    given = docs(spark, texts, ids)
    sets = [set(shingle_set(t, 5).tolist()) for t in texts]
    linked = lambda i, j: bool(sets[i]) and bool(sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    want = [i for i in range(len(texts)) if not sets[i] or i == min((j for j in range(len(texts)) if i == j or linked(i, j)), key=lambda j: (ids[j] is None, ids[j] or 0, j))]
    near = corpus_pipeline.one_of_each(spark, given, data).collect()
    assert len(near) == len(want) == 7
    assert sorted((repr(r["doc_id"]), repr(r["text"])) for r in near if "v1 " not in (r["text"] or "")) == sorted((repr(ids[i]), repr(texts[i])) for i in want if "v1 " not in (texts[i] or ""))

    grams = lambda t: {tuple(w[i : i + 10]) for w in [find_words(t)] for i in range(max(1, len(w) - 9)) if w}
    bench = set().union(*(grams(r["text"]) for r in table(spark, data, "benchmark").collect()))
    short = {g for g in bench if len(g) < 10}
    clean = [i for i, t in enumerate(texts) if not grams(t) & bench and not any(tuple(find_words(t)[k : k + len(g)]) == g for g in short for k in range(len(find_words(t))))]
    out = corpus_pipeline.unseen_benchmarks(spark, given, data).collect()
    assert sorted((repr(r["doc_id"]), repr(r["text"])) for r in out) == sorted((repr(ids[i]), repr(texts[i])) for i in clean)

    every = table(spark, data, "documents")
    model = quality.train(every, quality.ratings(table(spark, data, "labels")), top=2)
    kept = {r["doc_id"] for r in corpus_pipeline.good_quality(spark, every, data).collect()}
    for r in every.collect():
        z = float(model.weights[quality.features(r["text"])].sum(dtype=np.float32))
        tail = 1 / (1 + np.exp(model.thresholds[-1] - z))
        assert (r["doc_id"] in kept) == (tail >= quality.LEAST_TAIL)


# chat

TURNS = "conv_id long, turn long, role string, text string"


def test_chats_long_empty_and_of_clashing_columns(spark):
    from tallyforge.llm import chat

    rows = [(1, k, "user", f"turn {k}") for k in range(3000)] + [(2, k, "user", f"turn {k}") for k in range(2999)] + [(None, 1, None, None), (None, 2, "user", "turn 0"), (None, 3, "user", "own"), (None, 4, "user", "own"), (3, None, "user", "x" * 50_000)]
    turns = spark.createDataFrame(rows, TURNS)
    one = sorted(map(repr, chat.format_conversations(turns).collect()))
    wide = turns.withColumns({c: F.lit("x") for c in ("conv", "pos", "span", "p1", "p2", "rn", "n", "n_turns", "before", "part")})
    assert one == sorted(map(repr, chat.format_conversations(wide).collect()))
    assert sorted((repr(r["conv_id"]), r["n_turns"]) for r in chat.format_conversations(turns).collect()) == [("1", 3000), ("3", 1), ("None", 1), ("None", 1)]
    assert chat.format_conversations(turns.limit(0)).count() == 0
