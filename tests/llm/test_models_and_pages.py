"""Page extraction, pieces, chat, quality, language and the pipeline."""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import chat, html_extract, language, pieces, quality
from tallyforge.llm.common import table
from tallyforge.llm.queries import QUERIES


# pages

def article_by_hand(page):
    body = re.search("<article>(.*)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?p>|</?h1>", body))
    return "\n".join(b for b in blocks if b)


def test_pages_of_the_table(spark, data):
    pages = {r["page_id"]: r for r in table(spark, data, "pages").collect()}
    out = QUERIES["op1_html_extraction"](spark, data).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r["text"] == article_by_hand(pages[r["page_id"]]["html"])
        assert (r["url"], r["n_chars"]) == (pages[r["page_id"]]["url"], len(r["text"]))


def soup(k):
    """A page without article mark-up; the template tells what is fixed."""
    return f"""<html><head><title>T{k}</title></head><body><div class="top">Site name of all pages</div><div id="main-menu"><a href="/">Home</a></div>
    <div class="x1"><h2>Title {k}</h2><p>First &amp; only text {k}, long enough to read.</p><p>Keep &lt;this&gt; too {k}<p>unclosed {k}</div>
    <div class="x2">Call us every day of the week</div><div class="cookie-notice">We use cookies {k}</div><form><p>Search {k}</p></form>
    <section id="comments"><p>First! {k}</p></section><script>var a = "<p>no {k}</p>";</script><style>p {{}}</style><div class="x3">All rights reserved by all</div></body></html>"""


def test_template_of_a_host(spark):
    rows = [(k, f"http://h.example/{k}", soup(k)) for k in range(12)] + [(100, "http://h.example/empty", ""), (101, None, None), (102, "", "just <b>text</b>&nbsp;here"), (0, "http://h.example/0", soup(0))]
    out = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted(((r["page_id"], r["text"]) for r in out.collect()))
    want = [(k, f"Title {k}\nFirst & only text {k}, long enough to read.\nKeep <this> too {k}\nunclosed {k}") for k in (0, *range(12))]
    assert got == sorted([*want, (100, ""), (101, ""), (102, "just text here")])
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("page, text", [
    ("<main><header><h1>Head</h1></header><p>Body text</p><aside>more</aside><footer>by</footer></main><p>outside</p>", "Body text"),
    ("<article><p>a<div class='ad-box'>buy</div>b</p><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article><article class='comment'>c</article>", "a\nb\none\ntwo\nx\ny"),
    ("<nav>m</nav><article>&#65;&eacute;&#x42; &copy 2 <!-- <p>no --> <span>in</span>line<br>next</article><footer>f", "AéB © 2 inline next"),
    ("<article><p hidden>no</p><p>yes</p><div role='complementary'>no</div><div class='related-posts'>no</div></article>", "yes"),
    ("<div class='content with-sidebar'><div class='entry-header'><h1>T</h1></div><div class='entry-content'><p>x</p><p>y</p></div><div class='entry-footer'>tags</div></div><div class='sidebar'>s</div>", "T\nx\ny"),
    ("<body class='has-sidebar'><div id='page'><div id='main'><h1>T</h1><div class='post-body'>one<br/>two</div><div class='share-buttons'>s</div></div><ul class='menu'><li>m</ul></div>", "T\none two"),
    ("<article class='no-comments'><header><h1>T</h1><nav>n</nav></header><section><p>x</section><div id=comments>c</div></article>", "T\nx"),
    ("<p>only", "only"), ("<<>&&lt; x > y", "<<>&< x > y"), ("<article></article>", ""),
    ("<p>" + "long " * 50_000, ("long " * 50_000).strip()),
])
def test_pages_alone(page, text):
    assert html_extract.main_text(page, {}) == text


@pytest.mark.parametrize("page, text", [
    ("<div><h1 class='entry-title'>T</h1><p class='text'>one</p><div class='text-block'>two, the longest</div><section class='content'>three</section></div>", "T\none\ntwo, the longest\nthree"),
    ("<div class='post-content'><p>the post, which is long</p><p>and goes on</p></div><article class='card'>a card</article>", "the post, which is long\nand goes on\na card"),
    ("<main><article><p>the first long story</p></article><article>the second</article><p>by</p></main>", "the first long story\nthe second"),
])
def test_all_regions_of_a_page(page, text):
    assert html_extract.main_text(page, {}) == text


def test_classes_keep_order_and_nest():
    classes = {1: (10, 0), 2: (10, 1), 3: (10, 2), 4: (20, 0), 5: (20, 1), 6: (30, 0), 7: (30, 1)}
    assert html_extract.valid([1, 4, 5, 2, 3], classes) == {0, 1, 2, 3, 4}
    assert html_extract.valid([1, 3, 2], classes) == {0, 1}
    assert 3 not in html_extract.valid([6, 1, 2, 7, 3], classes) or 0 not in html_extract.valid([6, 1, 2, 7, 3], classes)


# pieces

@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def ways_by_hand(text, v):
    text, out = " " + text, []

    def go(at, score, ids):
        if at == len(text):
            out.append((score, ids))
            return
        for end in range(at + 1, min(len(text), at + v.longest) + 1):
            piece = text[at:end]
            if piece in v.scores:
                go(end, score + v.scores[piece], [*ids, v.ids[piece]])
        if text[at] not in v.scores:
            raw = text[at].encode()
            go(at + 1, score + v.byte_score * len(raw), [*ids, *(v.bytes_[b] for b in raw)])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("the ofnigr_,.{1é漢\n▁"), min_size=1, max_size=9), st.integers(1, 5))
def test_best_segmentations(vocabulary, text, n):
    want, got = ways_by_hand(text, vocabulary), pieces.Encoder(vocabulary, n).n_best(text)
    assert len(got) == min(n, len(want))
    assert all(abs(a[0] - b[0]) < 1e-9 for a, b in zip(got, want, strict=False))
    assert len({tuple(ids) for _, ids in got}) == len(got)
    scores = {i: s for x, i in vocabulary.ids.items() for s in [vocabulary.scores[x]]}
    for score, ids in got:
        assert pieces.decode(ids, vocabulary) == text
        assert abs(sum(scores.get(i, vocabulary.byte_score) for i in ids) - score) < 1e-9


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=60))
def test_any_text_comes_back(vocabulary, text):
    text = text.encode("utf-8", "ignore").decode()
    ids, scores, _, _ = pieces.Encoder(vocabulary).encode(text)
    assert pieces.decode(ids.tolist(), vocabulary) == text and scores == sorted(scores, reverse=True)


def test_small_memory_gives_the_same(vocabulary):
    texts = [f"word{i} and the others of {i % 7}" for i in range(200)] * 2
    a, b = pieces.Encoder(vocabulary), pieces.Encoder(vocabulary, kept=5)
    assert [a.n_best(t) for t in texts] == [b.n_best(t) for t in texts]


def test_what_does_not_come_back_is_told(vocabulary):
    text = "some words, é and 漢字\n"
    parts = pieces.Encoder(vocabulary).encode(text)[3]
    assert pieces.whole(text, parts) and not pieces.whole(text, parts[1:]) and not pieces.whole(text, parts + parts[:1])
    wrong = replace(vocabulary, decoded=[b"?" + x for x in vocabulary.decoded])
    assert not pieces.whole(text, pieces.Encoder(wrong).encode(text)[3])
    assert pieces.whole(None, []) and pieces.whole("", [])


def test_texts_in_a_table(spark, vocabulary):
    texts = ["Hello  world\n", "", None, "a" * 20_000, " ", "﻿\x00é", "Hello  world\n"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    out = pieces.encode_texts(rows, vocabulary).orderBy("doc_id").collect()
    assert all(r["lossless"] for r in out) and [len(r["ids"]) for r in out][1:3] == [0, 0] and out[0]["ids"] == out[6]["ids"]
    assert [pieces.decode(r["ids"], vocabulary) for r in out] == [t or "" for t in texts]
    assert pieces.encode_texts(rows.limit(0), vocabulary).count() == 0


# chat

TURN = st.tuples(st.sampled_from(["user", "assistant", None]), st.sampled_from(["a", "b", "", None, "<|im_end|>"]))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 5)), st.lists(TURN, max_size=5)), max_size=7), st.integers(1, 3))
def test_snapshots(spark, convs, span):
    turns = [(c, k, r, t) for c, (_, conv) in enumerate(convs) for k, (r, t) in enumerate(conv)]
    turns = [(None if convs[c][0] is None and c == 0 else c, k, r, t) for c, k, r, t in turns]
    by = {}
    for i, (c, _, r, t) in enumerate(turns):
        by.setdefault((True, i) if c is None else (False, c), []).append((r or "unknown", t or ""))  # a row without an id is a conversation
    order = {c: c for c in by}
    kept = {c for c, x in by.items() if not any(d != c and y[: len(x)] == x and (len(y) > len(x) or order[d] < order[c]) for d, y in by.items())}
    want = [(None if c[0] else c[1], "".join(f"<|im_start|>{r}\n{t.replace('<|im_end|>', '< |im_end|>')}<|im_end|>\n" for r, t in by[c])) for c in kept]
    old, chat.SPAN = chat.SPAN, span
    try:
        out = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    finally:
        chat.SPAN = old
    assert sorted(map(repr, ((r["conv_id"], r["text"]) for r in out))) == sorted(map(repr, want))


# quality

def rated(n=600):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        words = [f"w{rng.integers(200)}" for _ in range(40)]
        grade = int(rng.integers(3))
        words += ["good", "fine"][:1] * (grade == 2) + ["vile"] * (grade == 0) + ["so", "so"] * (grade == 1)
        rows.append((i, " ".join(words), grade))
    return rows


def test_grades_are_learned_and_held_out(spark):
    rows = rated()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([(i, g) for i, _, g in rows if i % 2], "doc_id long, grade int"), top=2)
    assert model.thresholds[0] < model.thresholds[1]
    out = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    held = [(out[i], g) for i, _, g in rows if not i % 2]
    assert np.mean([(r["tail"] >= 0.5) == (g == 2) for r, g in held]) > 0.95
    means = [np.mean([r["expected_grade"] for r, g in held if g == k]) for k in range(3)]
    assert means == sorted(means)


def test_gradient_fits_the_thresholds():
    """Without features the thresholds are the logits of the shares."""
    grades = np.array([0] * 10 + [1] * 30 + [2] * 60)
    model = quality.fit([np.empty(0, np.int32)] * 100, grades, 2)
    assert np.allclose(model.tails(np.zeros(1))[0], [0.9, 0.6], atol=1e-3)
    missing = quality.fit([np.empty(0, np.int32)] * 90, grades[10:], 2)
    assert np.allclose(missing.tails(np.zeros(1))[0], [1, 2 / 3], atol=1e-3)


def test_no_ratings_and_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "long " * 50_000, "x"), (1, None, "x")], "doc_id long, text string, tail string")
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, grade int"), top=2)
    assert [r["expected_grade"] for r in quality.score(docs, model).collect()] == [0.0] * 4
    one = quality.train(docs, spark.createDataFrame([(1, 2), (2, 2), (3, None)], "doc_id long, grade int"), top=2)
    assert [r["tail"] for r in quality.score(docs, one).collect()] == [1.0] * 4
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in quality.ratings(labels).collect()] == [(1, 1)]


# language

def test_held_out_accuracy(spark, data):
    truth = {r["doc_id"]: r["lang"] for r in table(spark, data, "documents").select("doc_id", "lang").collect()}
    out = QUERIES["op8_language"](spark, data).collect()
    assert len(out) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_mixtures_and_odd_texts(spark, data):
    docs = table(spark, data, "documents")
    names, p = language.learn(docs)
    by = {x: " ".join(r["text"] for r in docs.where(F.col("lang") == x).limit(4).collect())[:4000] for x in ("en", "fr", "de")}
    rows = [(1, by["en"] + " " + by["fr"]), (2, by["de"]), (3, None), (4, ""), (5, "12 34 !?"), (6, by["en"] * 100), (7, "漢字"), (None, by["fr"])]
    out = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string"), names, p).collect()}
    assert {x["lang"] for x in out[1]["mixture"]} >= {"en", "fr"} and abs(sum(x["share"] for x in out[1]["mixture"]) - 1) < 1e-6
    assert all(0.35 < x["share"] < 0.65 for x in out[1]["mixture"][:2])
    assert [x["lang"] for x in out[2]["mixture"]] == ["de"] and out[6]["lang_pred"] == "en" and out[None]["lang_pred"] == "fr"
    assert [out[k]["lang_pred"] for k in (3, 4, 5)] == ["und"] * 3 and out[7]["lang_pred"] in names
    none, q = language.learn(docs.limit(0))
    assert none == [] and [r["lang_pred"] for r in language.identify(docs.limit(3), none, q).collect()] == ["und"] * 3


def test_expectation_maximisation_raises_the_likelihood():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(30), 3)
    n = rng.multinomial(5000, 0.7 * p[0] + 0.3 * p[2]).astype(float)
    share, value = language.proportions(n, p)
    assert np.allclose(share, [0.7, 0, 0.3], atol=0.05)
    assert value >= max(float(n @ np.log(np.array(w) @ p)) for w in ([1, 0, 0], [0, 0, 1], [1 / 3] * 3)) - 1e-6


def test_parts_of_long_texts_join():
    text = "ab c" * 3000
    whole, language.PART, old = language.trigrams(text), 1000, language.PART
    try:
        assert (language.trigrams(text) - whole).sum() <= 2 * len(text) // 1000 + 2
    finally:
        language.PART = old


# pipeline

def test_pipeline(spark, data):
    docs = table(spark, data, "documents")
    good = corpus_pipeline.good_quality(spark, docs, data)
    assert good.columns == docs.columns and 0.5 * docs.count() < good.count() <= docs.count()
    lines = corpus_pipeline.new_lines(spark, good, data).cache()
    assert lines.columns == docs.columns and lines.where("n_chars <> length(text)").count() == 0
    near = corpus_pipeline.one_of_each(spark, lines, data)
    ids = [r["doc_id"] for r in near.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and lines.join(near, "doc_id", "left_anti").count() == lines.count() - len(ids)
    clean = corpus_pipeline.unseen_benchmarks(spark, near, data)
    dirty = {r["doc_id"] for r in QUERIES["op4_decontamination"](spark, data).where("contaminated").collect()}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.select("doc_id").collect()} >= set(ids) - dirty
    out = corpus_pipeline.run(spark, data).collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in clean.select("doc_id").collect()}
    assert all(r["lossless"] and r["n_chars"] == len(r["text"]) for r in out)


def test_pipeline_of_odd_rows(spark, data, tmp_path):
    rows = [(1, None, "en", "s", None), (2, "", None, "s", 0), (None, "a text without an id", "en", None, 3), (3, "same words in these two texts here", "en", "s", 1), (4, "same words in these two texts here", "en", "s", 1), (3, "same words in these two texts here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    near = corpus_pipeline.one_of_each(spark, docs, data).collect()
    assert sorted(repr(r["doc_id"]) for r in near) == ["1", "2", "3", "None"]
    for stage in (corpus_pipeline.new_lines, corpus_pipeline.one_of_each, corpus_pipeline.unseen_benchmarks):
        assert stage(spark, docs.limit(0), data).count() == 0
    assert corpus_pipeline.unseen_benchmarks(spark, docs, data).count() == 6
    assert corpus_pipeline.encoded(spark, docs, data).count() == 6


def test_copies_leave_the_line_stage(spark, data):
    rows = [(1, "a line that is long\nshort\nanother line of text"), (2, "short\na line that is long\nanother line of text"), (3, "short"), (4, "a line that is long\nits own long line"), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.new_lines(spark, docs, data).collect()}
    assert out == {1: rows[0][1], 3: "short", 4: "its own long line", 5: ""}


def test_benchmark_stage_decides_by_row(spark, data):
    item = next(r["text"] for r in table(spark, data, "benchmark").collect() if len(r["text"].split()) >= 12)
    rows = [(None, item), (None, "clean text"), (None, None), (3, item), (3, "clean as well"), (4, "x " + item)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.unseen_benchmarks(spark, docs, data)
    assert out.columns == docs.columns and sorted((repr(r["doc_id"]), repr(r["text"])) for r in out.collect()) == [("3", "'clean as well'"), ("None", "'clean text'"), ("None", "None")]


def test_short_lines_stay_unless_a_copy_holds_them(spark, data):
    rows = [(1, "the first shared line\nx"), (2, "the second shared line\ny"), (3, "the first shared line\nthe second shared line\nof both"), (4, "verse\nThe first shared line \nof mine"), (5, "x\nTHE FIRST shared line\n\n"), (6, "the first shared line\n \n"), (None, "the first shared line\nno id"), (7, "the first shared line\nx\nx")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.new_lines(spark, docs, data).collect()}
    want = {1: rows[0][1], 2: rows[1][1], 3: "of both", 4: "verse\nof mine", None: "no id", 7: "x\nx"}
    assert out == {i: (t, len(t)) for i, t in want.items()}


def test_digest_of_a_chat(spark, data):
    out = QUERIES["op5_chat"](spark, data).limit(1).first()
    whole = chat.format_conversations(table(spark, data, "conversations")).where(F.col("conv_id") == out["conv_id"]).first()
    assert hashlib.sha256(whole["text"].encode()).hexdigest() == out["text_sha256"]
