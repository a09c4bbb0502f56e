"""Labels after contexts, against a greedy tokenizer."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.operators.aliases import alias_problems, trie


def greedy(text, pieces):
    out = []
    while text:
        piece = max((p for p in pieces if p and text.startswith(p)), key=len)
        out.append(piece)
        text = text[len(piece):]
    return out


def tables(spark, texts, labels, vocabulary):
    contexts = spark.createDataFrame([(i, greedy(t, vocabulary)) for i, t in enumerate(texts)], "context long, pieces array<string>")
    asked = spark.createDataFrame([(i, x) for i in range(len(texts)) for x in labels], "context long, label string")
    return contexts, asked, spark.createDataFrame(list(vocabulary.items()), "piece string, id long")


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text("ab", max_size=7), min_size=1, max_size=4), st.sets(st.text("ab", min_size=1, max_size=4), max_size=8), st.sets(st.text("ab", min_size=1, max_size=3), min_size=1, max_size=4))
def test_labels_against_a_greedy_tokenizer(spark, texts, more, labels):
    vocabulary = {p: i for i, p in enumerate(sorted({"a", "b", *more}))}
    found = {(r["context"], r["label"]) for r in alias_problems(*tables(spark, texts, sorted(labels), vocabulary)).collect()}
    want = {(i, x) for i, t in enumerate(texts) for x in labels if greedy(t + x, vocabulary) != [*greedy(t, vocabulary), x]}
    assert found == want


def test_reasons_and_colliding_labels(spark):
    vocabulary = {"Answer": 1, ":": 2, "A": 3, "B": 3, ":C": 5, "C": 6, "er:D": 7, "D": 8, "F": 9}
    given_ = tables(spark, ["Answer:"], ["A", "B", "C", "D", "E", "F"], vocabulary | {"E": 99})
    contexts, asked, pieces = given_
    found = {(r["label"], r["reason"], r["other"]) for r in alias_problems(contexts, asked, pieces.where("piece <> 'E'")).collect()}
    assert found == {("A", "has the piece of another label", "B"), ("B", "has the piece of another label", "A"), ("C", "is joined by a piece of the context", ":C"), ("E", "is not one piece", None)}
    assert {(r["prefix"], r["continuation"]) for r in trie(pieces.where("piece = ':C'")).collect()} == {("", ":C"), (":", "C")}
    assert alias_problems(contexts.limit(0), asked.limit(0), pieces.limit(0)).count() == 0
