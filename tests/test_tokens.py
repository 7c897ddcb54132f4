"""Golden cases of tokens and sentences, and the offsets' invariant."""

import pytest
from pyspark.sql import functions as F

from notespan.operators import tokens as K

PTB = [
    ("42%", [(0, 2), (2, 3)]),
    ("42,000,000", [(0, 10)]),
    ("first,", [(0, 5), (5, 6)]),
    ("abc(asf", [(0, 3), (3, 4), (4, 7)]),
    ("2.5cm", [(0, 3), (3, 5)]),
    ("2.5cm.", [(0, 3), (3, 6)]),
    ("2x3x4", [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]),
    ("Blah 4x4.5.", [(0, 4), (5, 6), (6, 7), (7, 11)]),
    ("a.m.", [(0, 4)]),
    ("'xyz", [(0, 1), (1, 4)]),
    ("", []),
    (" \t\n", []),
    ("(something), something", [(0, 1), (1, 10), (10, 11), (11, 12), (13, 22)]),
    ("don't", [(0, 2), (2, 5)]),
    ("Pt's", [(0, 2), (2, 4)]),
]


@pytest.mark.parametrize("text,want", PTB)
def test_ptb(text, want):
    assert list(K.ptb_words()(text)) == want


def test_edge_words_drop_one_mark():
    text = "This is a test-sentence, with hyphen-ated words."
    assert [text[a:b] for a, b in K.edge_words(text)] == ["This", "is", "a", "test-sentence", "with", "hyphen-ated", "words"]


def test_model_words_and_segments():
    t = "Seen [**Name 1**] on_4.5\n\nnext\n---\nlast"
    assert [t[a:b] for a, b in K.model_words(t)][:3] == ["Seen", "[**Name 1**]", "on"]
    assert [t[a:b].strip() for a, b in K.segments(t)] == ["Seen [**Name 1**] on_4.5", "next", "last"]


def test_tokens_and_sentences(spark):
    docs = spark.createDataFrame([(1, "  Héllo wörld \n\n second line😀 x"), (2, None), (3, "")], "doc_id long, text string")
    got = K.tokens(docs, K.unicode_words)
    back = got.join(docs.withColumnRenamed("text", "t"), "doc_id").filter(F.substring("t", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("text"))
    assert got.count() == 5 and back.count() == 0
    s = K.sentences(docs).orderBy("sent_id").collect()
    assert [(r.sent_id, r.start, r.text) for r in s] == [(0, 2, "Héllo wörld"), (1, 17, "second line😀 x")]
    grams = K.ngrams(K.sentences(docs), 2).filter("n = 2").orderBy("start").collect()
    assert [r.gram for r in grams] == ["Héllo wörld", "second line😀", "line😀 x"]


def test_model_sentences(spark):
    docs = spark.createDataFrame([(1, "One two. Three four: five")], "doc_id long, text string")
    got = K.model_sentences(docs, lambda ws: [1.0 if w[0].isupper() or w == "five" else -1.0 for w in ws]).orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(0, 8), (9, 20), (21, 25)]


def test_windows(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [7])], "id long, xs array<int>")
    assert sorted(tuple(r.window) for r in K.training_windows(df, "xs", 3).collect()) == [(1, 2, 3), (2, 3, 4), (7,)]
