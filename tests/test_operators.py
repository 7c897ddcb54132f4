"""Golden and brute-force cases of the clinical operators."""

import math

import pytest
from pyspark.sql import functions as F

from notespan.functions import text as T
from notespan.operators import acronyms, concepts, negation, norms, rtf, sections, spans, tagging, tokens


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def words(spark, text):
    return tokens.sentences(one(spark, text), tokens.line_sentences, tokens.unicode_words)


def span(spark, *pairs):
    return spark.createDataFrame([(1, a, b) for a, b in pairs], "doc_id long, start int, end int")


@pytest.fixture(scope="module")
def rules(spark):
    rows = [(["w/o", "evidence", "of"], "PREN"), (["w/o"], "PREN"), (["denies"], "PREN"), (["ruled", "out"], "POST"), (["not", "only"], "PSEU"), (["not"], "PREN")]
    return spark.createDataFrame(rows, "words array<string>, tag string")


def test_negex(spark, rules):
    t = "Given that the pt was w/o evidence of DVT"
    got = negation.negex(words(spark, t), span(spark, (38, 41)), rules).collect()
    assert [tuple(r)[2:4] for r in got] == [(38, 41)]
    trig = {(r.start, r.end) for r in negation.triggers(words(spark, t), rules).collect()}
    assert (22, 25) in trig and (22, 37) in trig
    (r,) = negation.negex(words(spark, "Pt. denies chest pain."), span(spark, (11, 21)), rules).collect()
    assert (r.start, r.end, r.trigger_start) == (11, 22, 4)
    (r,) = negation.negex(words(spark, "DVT was ruled out"), span(spark, (0, 3)), rules).collect()
    assert (r.trigger_start, r.trigger_end) == (8, 17)
    assert negation.negex(words(spark, "DVT is there"), span(spark, (0, 3)), rules).count() == 0
    s, t = words(spark, "not only DVT"), span(spark, (9, 12))
    assert negation.negex(s, t, rules).count() == 1 and negation.negex(s, t, rules, pseudo_negation=True).count() == 0


def test_trie():
    d = negation.Trie()
    d[list("abc")], d[list("abd")] = 1, 2
    assert list(d.matches(list("xabcd"))) == [(3, 3, 1)]
    assert d[list("abd")] == 2 and len(d) == 2 and sorted(map("".join, d)) == ["abc", "abd"]
    del d[list("abc")]
    with pytest.raises(KeyError):
        d[list("abc")]


def test_cues(spark):
    cues = spark.createDataFrame(negation.cue_table(), "side string, kind string, words array<string>")
    kind = lambda t, a, b, **o: [r.kind for r in negation.modifications(words(spark, t), span(spark, (a, b)), cues, **o).collect()]
    assert kind("no fever", 3, 8) == ["negated"]
    assert kind("history of fever", 11, 16) == []  # one-word cues are adjacent
    assert kind("history of fever", 11, 16, cue_scan="full") == ["historical"]
    assert kind("fever unlikely", 0, 5) == ["uncertain"]
    assert kind("no but fever", 7, 12) == [] and kind("fails to reveal fever", 16, 21) == ["negated"]


def test_deepen(spark):
    def dep(i, t, head, rel, upos, at):
        return (1, 0, i, at, at + len(t), t, head, rel, upos)

    deps = spark.createDataFrame([dep(0, "Patient", 1, "nsubj", "NOUN", 0), dep(1, "denies", None, "root", "VERB", 8), dep(2, "pain", 1, "obj", "NOUN", 15), dep(3, "lives", 1, "conj", "VERB", 21), dep(4, "and", 3, "cc", "CCONJ", 27), dep(5, "fever", 3, "obj", "NOUN", 31)], "doc_id long, sent_id int, dep_id long, start int, end int, text string, head_id long, deprel string, upos string")
    terms = spark.createDataFrame([(1, 0, 15, 19), (1, 0, 31, 36)], "doc_id long, sent_id int, start int, end int")
    trig = spark.createDataFrame([(1, 0, 8, 14, "PREN")], "doc_id long, sent_id int, start int, end int, tag string")
    assert [(r.start, r.end) for r in negation.deepen(terms, trig, deps).collect()] == [(15, 19)]


def test_suffixes_and_forms(spark):
    df = spark.createDataFrame([("computer", "R&D", "A+B")], "w string, a string, b string")
    r = df.select(T.suffixes(F.col("w"), 4).alias("s"), T.standard_acronym(F.col("a")).alias("a"), T.standard_acronym(F.col("b")).alias("b")).first()
    assert r.s == ["uter", "ter", "er", "r", ""] and (r.a, r.b) == ("R/D", "A/B")
    forms = [x[0] for x in spark.createDataFrame([("7",), ("3.5",), ("1,000",), ("Abc",)], "w string").select(T.context_form(F.col("w"))).collect()]
    assert forms == ["single_digit", "decimal_number", "big_number", "abc"]
    notes = spark.createDataFrame([("On [**2101-3-4**] [**Known lastname 5**] called [**Telephone/Fax 2**], 5 mg",)], "t string").select(T.clean_notes(F.col("t"))).first()[0]
    assert notes == "on  NAME  # mg" or "NAME" in notes
    tags = spark.createDataFrame([("NP",), ("-LRB-",), ("NN",)], "t string").select(T.known_tag(F.col("t"))).collect()
    assert [t[0] for t in tags] == ["NNP", "(", "NN"]


def test_align():
    assert acronyms.align("md", "medical doctor") == 5 + 3
    assert acronyms.align("", "abc") == -2 and acronyms.align("a", "") == -3


def test_alignment_modes(spark):
    a = spark.createDataFrame([("MD",)], "abbr string")
    b = spark.createDataFrame([("medical doctor",), ("mad dog",), ("mud",), ("other",)], "longform string")
    assert acronyms.align_longforms(a, b).first().longform == "medical doctor"
    assert {r.longform for r in acronyms.align_longforms(a, b, "ties").collect()} == {"medical doctor", "mad dog"}
    assert [r.longform for r in acronyms.align_longforms(a, b, "all").orderBy("rank").collect()] == ["mad dog", "medical doctor", "mud", "other"]


def test_letters(spark):
    w = [("BP",), ("aeiou",), ("42",), ("a",), ("word",), ("hth",)]
    got = {r.w: r.x for r in spark.createDataFrame(w, "w string").select("w", acronyms.looks_abbreviated(F.col("w"), F.col("w") == "hth").alias("x")).collect()}
    assert got == {"BP": True, "aeiou": True, "42": False, "a": False, "word": False, "hth": False}
    long, short = (spark.createDataFrame([(x,) for x in xs], "word string") for xs in (["hello", "yellow", "mellow"], ["hx", "dx", "tx"]))
    lm, sm = acronyms.train_trigrams(long), acronyms.train_trigrams(short)
    probe = spark.createDataFrame([("yello",), ("sx",)], "word string")
    a = {r.word: r.logp for r in acronyms.word_likelihood(probe, lm).collect()}
    b = {r.word: r.logp for r in acronyms.word_likelihood(probe, sm).collect()}
    assert a["yello"] > b["yello"] and b["sx"] > a["sx"]


def test_sparse_vectors(spark):
    r = spark.sql("SELECT map(1, 3D, 2, 4D) AS v, map(2, 1D, 5, 2D) AS w").select(acronyms.magnitude(F.col("v")).alias("m"), acronyms.dot(F.col("v"), F.col("w")).alias("d"), acronyms.added(F.col("v"), F.col("w")).alias("s"), acronyms.normed(F.col("v")).alias("n")).first()
    assert r.m == 5 and r.d == 4 and r.s == {1: 3.0, 2: 5.0, 5: 2.0} and r.n == pytest.approx({1: 0.6, 2: 0.8})


def test_concepts(spark):
    rows, at = [], 0
    for i, (w, tag) in enumerate([("Pain", "NN"), ("in", "IN"), ("the", "DT"), ("left", "JJ"), ("Lower", "JJ"), ("leg", "NN"), (".", ".")]):
        rows.append((1, 0, i, at, at + len(w), w, tag, w.lower()))
        at += len(w) + 1
    sents = concepts.tagged_sentences(spark.createDataFrame(rows, "doc_id long, sent_id int, tok_id int, start int, end int, text string, tag string, norm string"))
    schema = "key string, sui string, cui string, tui string, source int, code string"
    phrase = spark.createDataFrame([("Pain in the left Lower leg", "S", "C1", "T", 0, "x"), ("leg", "S", "C2", "T", 9, "x"), ("PAIN", "S", "C3", "T", 0, "x")], schema)
    bag = spark.createDataFrame([("left leg lower", "S", "C4", "T", 0, "x")], schema)
    got, terms = concepts.detect_concepts(sents, {"phrase": phrase, "lower": phrase.withColumn("key", F.lower("key")), "norm": bag}, spark.createDataFrame([(0, "SRC")], "source int, name string"))
    found = {(r.cui, r.source, r.score) for r in got.collect()}
    assert found == {("C1", "SRC", 1.0), ("C1", "SRC", 0.6), ("C2", "unknown", 1.0), ("C4", "SRC", 0.3)}
    assert {(r.start, r.end) for r in terms.collect()} == {(0, 26), (0, 4), (23, 26), (12, 26)}


def test_norms(spark):
    t = spark.createDataFrame([("according", "VBG"), ("Days", "NNS")], "text string, tag string")
    n = spark.createDataFrame([("according", "VBG", "accord"), ("days", "NNS", "day")], "term string, tag string, norm string")
    assert [r.norm for r in norms.normalize(t, n).orderBy("text").collect()] == ["days", "accord"]
    rows = [(1, "dogs", "noun", "count(thr_plur)", "dog"), (2, "dogs", "noun", "count(thr_plur)", "doggo"), (3, "ran", "verb", "past", "run"), (4, "rerun", "verb", "past", "run"), (5, "x2", "verb", "past", "y")]
    got = {(r.term, r.tag, r.norm) for r in norms.build_norms(spark.createDataFrame(rows, "line long, variant string, category string, agreement string, base string")).collect()}
    assert got == {("dogs", "NNS", "doggo"), ("dogs", "NN", "doggo"), ("ran", "VBD", "run")}


CORPUS = ["The/DT dog/NN runs/VBZ", "A/DT cat/NN sees/VBZ the/DT dog/NN", "Dogs/NNS run/VBP", "the/DT cat/NN runs/VBZ"]


def tagged(spark):
    rows = [(1, s, k, *t.split("/")) for s, line in enumerate(CORPUS) for k, t in enumerate(line.split())]
    return spark.createDataFrame(rows, "doc_id long, sent_id int, tok_id int, text string, tag string")


def test_tagger(spark):
    m = tagging.Model.load(tagging.train(tagged(spark)))
    assert abs(sum(m.lambdas) - 1) < 1e-9
    assert m.decode("The cat runs".split()) == ["DT", "NN", "VBZ"] and m.decode("the dog sees a cat".split()) == ["DT", "NN", "VBZ", "DT", "NN"]
    got = tagging.tag(words(spark, "The dog runs."), m).orderBy("tok_id").collect()
    assert [(r.text, r.start, r.end) for r in got] == [("The", 0, 3), ("dog", 4, 7), ("runs", 8, 12), (".", 12, 13)]
    assert tagging.tag(words(spark, "The dog ."), m, drop_single_char_final=True).count() == 2


def test_viterbi_against_all_paths(spark):
    import itertools

    m = tagging.Model.load(tagging.train(tagged(spark)))
    words_ = "the cat runs dogs".split()
    best, top = None, -math.inf
    for tags in itertools.product(*[sorted(m.emissions(w)) for w in words_]):
        p, a, b = 0.0, "BBS-", "BOS-"
        for w, t in zip(words_, tags):
            p += m.emissions(w)[t] + m.transition(a, b, t + "-")
            a, b = b, t + "-"
        if p > top:
            best, top = list(tags), p
    assert best is None or m.decode(words_, beam=1e9) == best


def test_suffix_model_sequentially(spark):
    counts = {}
    for line in CORPUS:
        for x in line.split():
            w, t = x.split("/")
            k = (w[0].isupper(), w.lower(), t)
            counts[k] = counts.get(k, 0) + 1
    got = {(r.cap, r.suffix, r.tag): r.logp for r in tagging.suffix_model(tagged(spark)).collect()}
    cap = False
    s = {}
    for (c, w, t), n in counts.items():
        if c == cap:
            for k in range(0, min(5, len(w)) + 1):
                s[w[len(w) - k :], t] = s.get((w[len(w) - k :], t), 0) + n
    n = {}
    for (x, t), c in s.items():
        n[x] = n.get(x, 0) + c
    total, tags = n[""], sorted({t for _, t in s})
    prior = {t: s["", t] / total for t in tags}
    weight = {}
    for k in range(1, 6):
        per = {t: sum(c for (x, u), c in s.items() if len(x) == k and u == t) for t in tags}
        shares = [v / sum(per.values()) for v in per.values() if v]
        mean = sum(shares) / len(shares) if shares else 0
        weight[k] = math.sqrt(sum((x - mean) ** 2 for x in shares) / (len(shares) - 1)) if len(shares) > 1 else 0.0
    for (c, x, t), logp in got.items():
        if c != cap:
            continue
        p = prior[t]
        for k in range(1, len(x) + 1):
            y = x[len(x) - k :]
            p = (s.get((y, t), 0) / n[y] + weight[k] * p) / (1 + weight[k])
        assert abs(logp - math.log10(p * n[x] / total / prior[t])) < 1e-9


RTF = [
    (rb"{\rtf1 a\u8901\'b7b}", "a⋅b"),
    (rb"{\rtf1 a\'abb}", "a«b"),
    (rb"{\rtf1 a\v bmk\plain b}", "ab"),
    (rb"{\rtf1 a\v\'ab\u8901\'b7\par\plain b}", "ab"),
    (rb"{\rtf1 one\par two\tab x\~\{y\}\\}", "one\ntwo\tx\u00a0{y}\\"),
    (rb"{\rtf1{\fonttbl{\f0 Arial;}}{\*\unknown gone}kept{\field{\*\fldinst x}{\fldrslt y}}\emdash z}", "kept—z"),
    (rb"{\rtf1 a\bin3 {}}b}", "ab"),
    (rb"{\rtf1\uc0 a\u8364 b}", "a€b"),
    (rb"{\rtf1 x\u-10179?\u-8704?y}", "x😀y"),
    (b"plain {text} \xe9", "plain {text} é"),
]


@pytest.mark.parametrize("data,want", RTF)
def test_rtf(data, want):
    assert rtf.parse(data)[0] == want


def test_rtf_formats(spark):
    assert rtf.parse(rb"{\rtf1 {\b bold} not \ul u\ulnone  end \i it}") == ("bold not u end it", [("bold", 0, 4), ("underlined", 9, 10), ("italic", 15, 17)])
    df = spark.createDataFrame([("e", bytearray(rb"{\rtf1 {\b Head}\par text}")), ("n", None)], "event_id string, content binary")
    got = rtf.rtf_to_text(df)
    assert [tuple(r) for r in rtf.format_spans(got).collect()] == [("e", "bold", 0, 4)]


def test_span_algebra(spark):
    a, b = span(spark, (0, 10), (5, 5), (20, 30)), span(spark, (0, 10), (2, 5), (5, 5), (9, 12), (25, 30))
    brute = sorted((x, y, u, v) for x, y in [(0, 10), (5, 5), (20, 30)] for u, v in [(0, 10), (2, 5), (5, 5), (9, 12), (25, 30)] if u >= x and v <= y)
    for width in (None, 4, 1000):
        got = sorted((r.start, r.end, r.r_start, r.r_end) for r in spans.inside(a, b, width).collect())
        assert got == brute
    assert {(r.start, r.end) for r in spans.at(a, b).collect()} == {(0, 10), (5, 5)}
    assert {(r.start, r.end) for r in spans.at(a, b, anti=True).collect()} == {(20, 30)}
    (r,) = spans.backward(span(spark, (20, 30)), b, 1).collect()
    assert (r.r_start, r.r_end) == (9, 12)
    (r,) = spans.forward(span(spark, (5, 5)), b, 1).collect()
    assert (r.r_start, r.r_end, r["rank"]) == (5, 5, 0)
    assert {r.n for r in spans.counts(a, b).collect()} == {3, 1}


def test_sections_samples_and_metrics(spark):
    s = tokens.sentences(one(spark, "HISTORY:\ntext here\nBold line"))
    fmt = spark.createDataFrame([(1, 19, 28, "bold"), (1, 9, 12, "bold")], "doc_id long, start int, end int, kind string")
    got = {(r.start, r.end) for r in sections.section_headers(s, sections.header_pattern(["^[A-Z ]+:$", "^x$"]), fmt).collect()}
    assert got == {(0, 8), (19, 28)}
    docs = spark.range(1000).withColumnRenamed("id", "doc_id")
    b = sections.batches(docs, 100, 1)
    assert sorted(r["count"] for r in b.groupBy("batch").count().collect()) == [100] * 10
    assert 150 < sections.split(docs, 0.2, 1).filter("part = 'eval'").count() < 250
    blocks = docs.withColumnRenamed("doc_id", "block_id")
    assert sections.split_blocks(blocks, 0.8).filter("part = 'train'").count() == 800
    gold, pred = span(spark, (0, 1), (2, 3), (4, 5)), span(spark, (0, 1), (4, 9))
    m = sections.confusion(gold, pred, ["doc_id", "start"]).first()
    assert (m.tp, m.fp, m.fn) == (2, 0, 1) and m.precision == 1 and abs(m.recall - 2 / 3) < 1e-9
    k = "doc_id long, start int, end int, head_start int, head_end int, deprel string"
    g = spark.createDataFrame([(1, 0, 1, None, None, "root"), (1, 2, 3, 0, 1, "obj")], k)
    p = spark.createDataFrame([(1, 0, 1, None, None, "root"), (1, 2, 3, 0, 1, "nmod")], k)
    assert tuple(sections.attachment(g, p).first()) == (1.0, 0.5)


def test_concept_spans_ignore_marks_around(spark):
    """Punctuation next to a phrase doesn't change what is found."""
    schema = "key string, sui string, cui string, tui string, source int, code string"
    phrase = spark.createDataFrame([("chest pain", "S", "C1", "T", 0, "x")], schema)
    d = {"phrase": phrase, "lower": phrase, "norm": phrase.limit(0)}

    def found(text):
        t = tokens.sentence_tokens(tokens.sentences(one(spark, text), tokens.line_sentences, tokens.ptb_words())).withColumn("tag", F.lit("NN")).withColumn("norm", F.lower("text"))
        return concepts.detect_concepts(concepts.tagged_sentences(t), d)[0].count()

    assert {found(t) for t in ("has chest pain today", "has chest pain, today", "has (chest pain) today", '"chest pain"', "chest pain.")} <= {2, 0} and found("has (chest pain) today") == 2


def test_tagged_words_learns_from_every_document(spark, tmp_path):
    from notespan.plans import catalog

    texts = [(1, "Abcdefg xyz the"), (7, "uvw the zzzz zzzz"), (50, "the"), (None, "qqqqq the")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    given = {(r.doc_id, r.text): r.tag for r in catalog.tagged(spark, str(tmp_path)).collect()}
    got = {(r.doc_id, r.text): r.tag for r in catalog.tagged_words(spark, str(tmp_path)).collect()}
    assert len(given) == 9 and got == given  # every word is known with the one tag that it was seen with


def test_alignment_scores_every_long_form(spark):
    a = spark.createDataFrame([("abc",), ("zz",)], "abbr string")
    names = ["a", "bc", "A b-c", "x/bC d", ""]
    b = spark.createDataFrame([(n,) for n in names], "longform string")
    for abbr in ("abc", "ZZ", ""):
        assert acronyms._align_all(abbr, names).tolist() == [acronyms.align(abbr, n) for n in names]
    for mode in ("best", "ties"):
        got = {}
        for r in acronyms.align_longforms(a, b.filter("longform IN ('a', 'bc')"), mode).collect():
            got.setdefault(r.abbr, set()).add((r.longform, r.score))
        assert got == {"abc": {("bc", 1.0)}, "zz": {("bc", -8.0)} if mode == "best" else {("a", -8.0), ("bc", -8.0)}}
    many = ["x" * k for k in range(1, 60)] + ["ab " * 40, "", "a b c"]
    assert acronyms._align_all("abx", many, 64).tolist() == [acronyms.align("abx", n) for n in many]
