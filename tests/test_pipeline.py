"""Models folders, files an event, stages end to end, and operators that were rewritten, against plain versions."""

import json
import pickle
import random

import pytest
from pyspark.sql import functions as F

from notespan.operators import acronyms, concepts, negation, rtf, spans, tokens
from notespan.plans import pipeline
from notespan.sources import readers, writers


def test_vectorised_tokens_are_those_of_the_generators(spark):
    rng = random.Random(5)
    letters = list("ab é\u0085\xa0 　\n\n\t\r\x0b\x0c\x1c 中𝄞.")
    texts = [None, "", "\n", *["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(200)], "w " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for words in (tokens.plain_words, tokens.unicode_words):
        want = sorted((i, n, a, z, t[a:z]) for i, t in enumerate(texts) for n, (a, z) in enumerate(words(t or "")))
        assert sorted(map(tuple, tokens.tokens(docs, words).collect())) == want
        want = sorted((i, n, a, z, t[a:z], [(a + x, a + y, t[a:z][x:y]) for x, y in words(t[a:z])]) for i, t in enumerate(texts) for n, (a, z) in enumerate(tokens.line_sentences(t or "")))
        got = sorted((*tuple(r)[:5], [tuple(t) for t in r.tokens]) for r in tokens.sentences(docs, words=words).collect())
        assert got == want


def test_nearest_labels_against_all_pairs(spark):
    rng = random.Random(8)
    make = lambda n: [(rng.randrange(4), a, a + rng.randrange(4), k) for k in range(n) for a in [rng.randrange(30)]]
    labels, others = make(60), make(60) + [(9, 1, 2, 99)]
    schema = "doc_id long, start int, end int, k int"
    x, y = spark.createDataFrame(labels, schema), spark.createDataFrame(others, schema)
    for most in (None, 1, 3):
        got = {}
        for r in spans.backward(x, y, most).collect():
            got.setdefault(r.k, {})[r.rank] = (r.r_start, r.r_end)
        for d, a, _, k in labels:
            near = sorted(((s, e) for d2, s, e, _ in others if d2 == d and e <= a), key=lambda p: (p[1], p[0]), reverse=True)[:most]
            assert [got.get(k, {}).get(i) for i in range(len(near))] == near and len(got.get(k, {})) == len(near)
        got = {}
        for r in spans.forward(x, y, most).collect():
            got.setdefault(r.k, {})[r.rank] = (r.r_start, r.r_end)
        for d, _, z, k in labels:
            near = sorted((s, e) for d2, s, e, _ in others if d2 == d and s >= z)[:most]
            assert [got.get(k, {}).get(i) for i in range(len(near))] == near and len(got.get(k, {})) == len(near)


def test_files_of_events(spark, tmp_path):
    events = spark.createDataFrame([("a", "é one\ntwo"), ("sub/b.txt", None), ("../c", "x")], "event_id string, text string").withColumn("json", F.to_json(F.struct("event_id", "text")))
    assert writers.write_files(events, str(tmp_path / "t")) == 3
    assert (tmp_path / "t/a.txt").read_text() == "é one\ntwo" and (tmp_path / "t/sub/b.txt.txt").read_text() == "" and (tmp_path / "t/c.txt").exists()
    assert sorted(p.name for p in (tmp_path / "t").rglob("*.*")) == ["a.txt", "b.txt.txt", "c.txt"]
    for kind in writers.FORMATS:
        writers.write_files(events, str(tmp_path / kind), kind, "json")
        back = readers.read_events(spark, str(tmp_path / kind), "event_id string, text string", kind)
        assert {tuple(r) for r in back.collect()} == {("a", "é one\ntwo"), ("sub/b.txt", None), ("../c", "x")}
    assert pickle.loads((tmp_path / "pickle/a.pickle").read_bytes())["text"] == "é one\ntwo"


def test_texts_as_rtf_come_back(spark):
    texts = ["plain", "back\\slash {braces}\ttab\nline", "é ü Ж 中 𝄞 ~|", "", None, "\x07\x1f"]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "event_id string, text string")
    got = {r.event_id: r for r in rtf.rtf_to_text(rtf.text_to_rtf(docs, 3)).collect()}
    assert [got[str(i)].text for i in range(len(texts))] == [t or "" for t in texts]
    assert [tuple(f) for f in got["1"].formats] == [("bold", 0, 3)] and got["3"].formats == []


def test_known_or_looking_like_an_acronym(spark):
    cands = spark.createDataFrame([(1, k, 0, 1, w) for k, w in enumerate(["BP", "C&C", "xqz", "table", "bpm"])], "doc_id long, tok_id int, start int, end int, text string")
    expansions = spark.createDataFrame([("BP", "blood pressure"), ("C/C", "complaint")], "acronym string, sense string")
    assert {r.text for r in acronyms.acronym_tokens(cands, expansions).collect()} == {"BP", "C&C"}
    short = acronyms.train_trigrams(spark.createDataFrame([(w,) for w in ("bpm", "xqz", "bp", "mri")], "word string"))
    long = acronyms.train_trigrams(spark.createDataFrame([(w,) for w in ("table", "stable", "blood", "pressure")], "word string"))
    got = {r.text for r in acronyms.acronym_tokens(cands, expansions, (short, long), spark.createDataFrame([("XQZ",)], "longform string")).collect()}
    assert got == {"BP", "C&C", "bpm"}
    words = spark.createDataFrame([("bpm",), ("stable",)], "word string")
    assert {tuple(r) for r in acronyms.abbreviated_by_letters(words, short, long).collect()} == {("bpm", True), ("stable", False)}


def test_alignment_is_the_last_tier(spark):
    t = spark.createDataFrame([(1, 0, 0, 2, "BP"), (1, 1, 3, 5, "MD"), (1, 2, 6, 8, "bp")], "doc_id long, tok_id int, start int, end int, text string")
    expansions = spark.createDataFrame([("BP", "blood pressure")], "acronym string, sense string")
    longs = spark.createDataFrame([("medical doctor",), ("blood pressure",), ("table",)], "longform string")
    none = spark.createDataFrame([], "word string, word_id int"), spark.createDataFrame([], "sense string, word_id int, weight double")
    got = {r.tok_id: r.expansion for r in acronyms.score_senses(t, t, expansions, *none, longforms=longs).collect()}
    assert got == {0: "blood pressure", 1: "medical doctor", 2: "blood pressure"}
    assert acronyms.score_senses(t, t, expansions, *none).count() == 2


def test_window_keys_are_those_of_the_windows(spark):
    row = [(0, 0, 2, "Ab", "NN", "ab", None), (1, 4, 6, "of", "IN", "of", None), (2, 6, 8, "cd", "NN", "cd", "Long form"), (3, 9, 10, ".", ".", ".", None), (4, 11, 13, "7", "CD", "7", None)]
    s = spark.createDataFrame([(1, 0, row)], "doc_id long, sent_id int, tokens array<struct<tok_id:int,start:int,end:int,text:string,tag:string,norm:string,expansion:string>>")
    got = {(r.start, r.end, r.tier, r.kind): r.key for r in concepts.window_keys(s, 4).collect()}
    assert {(r.start, r.end) for r in concepts.windows(s, 4).collect()} == {k[:2] for k in got}
    assert got[0, 8, 0, "phrase"] == "Ab ofcd" and got[0, 8, 0, "lower"] == "ab ofcd" and got[0, 8, 1, "phrase"] == "Ab ofLong form" and got[0, 8, 2, "norm"] == "ab cd"
    assert (0, 2, 1, "phrase") not in got and (0, 2, 2, "norm") not in got and got[6, 8, 1, "lower"] == "long form"
    assert got[6, 13, 0, "phrase"] == "cd . 7" and (6, 13, 2, "norm") not in got


def test_document_stages_and_what_they_do_on_errors(spark):
    docs = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "doc_id long, text string")

    def each(text):
        if text == "bad":
            raise KeyError("no")
        return [(len(text), text.upper())]

    for policy, errors in (("skip", None), ("record", {(2, "KeyError: 'no'")})):
        p = pipeline.create(None, ("own",), {"own": pipeline.document_stage("own", each, "n long, up string", policy)})
        labels = p.transform(docs)
        assert {tuple(r) for r in labels["own"].collect()} == {(1, 2, "OK"), (3, 0, "")}
        assert errors is None or {tuple(r) for r in labels["own_errors"].collect()} == errors
    with pytest.raises(Exception, match="no"):
        pipeline.create(None, ("own",), {"own": pipeline.document_stage("own", each, "n long, up string")}).transform(docs)["own"].collect()
    with pytest.raises(ValueError):
        pipeline.document_stage("own", each, "n long", "perhaps")


def test_from_source_files_to_every_label(spark, tmp_path, capsys):
    def put(name, text):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    conso = "".join("|".join([f"C{i:07d}", "ENG", "", "", "", f"S{i:07d}", "", "", "", "", "", "SAB", "PT", f"c{i}", s, "", "N", ""]) + "\n" for i, s in enumerate(["chest pain", "blood pressure", "fever"]))
    sty = "".join(f"C{i:07d}|T{t}|A1|x|\n" for i, t in enumerate(["184", "201", "184"]))
    tree = "( (S (NN HISTORY) (. .)) )\n( (S (NN patient) (VBZ denies) (NN chest) (NN pain) (CC and) (VBZ has) (JJ high) (NN BP) (. .)) )\n( (S (NN patient) (VBZ has) (DT no) (NN fever) (. .)) )\n"
    made = {
        "rules": put("raw/rules", "denies\t\t[PREN]\nno\t\t[PREN]\n"),
        "headers": put("raw/headers", "^[A-Z]+:$\n"),
        "expansions": put("raw/ex", "BP\nblood pressure\nMD\ndoctor|mad dog\n"),
        "lragr": put("raw/lragr", "E1|pains|noun|count(thr_plur)|pain|pain|\n"),
        "treebank": (put("raw/tb/a.mrg", tree), str(tmp_path / "raw/tb"))[1],
        "mrconso": put("raw/conso", conso),
        "mrsty": put("raw/sty", sty),
        "mrxns": put("raw/xns", "ENG|chest pain|C0000000|L1|S0000000|\n"),
        "tuis": put("raw/tuis", "x|T184|y\nx|T201|y\n"),
        "ttys": put("raw/ttys", "x|OB|y\n"),
    }
    models = str(tmp_path / "models")
    pipeline.main(["build-models", models, *[x for k, v in made.items() for x in (f"--{k}", v)]])
    assert set(capsys.readouterr().out.split()) >= {"rules", "known", "suffix", "phrase", "norm", "abbreviation_letters"}
    put("in/a.txt", "HISTORY:\npatient denies chest pain and has high BP .")
    put("in/sub/b.txt", "patient has no fever .\n")
    config = put("all.yml", json.dumps({"components": [{"name": n, "params": {}} for n in pipeline.FULL], "mp_config": {"workers": 4}}))
    pipeline.main(["run", str(tmp_path / "in"), str(tmp_path / "out"), "--models", models, "--config", config, "--include-label-text", "--times"])
    assert "concepts:" in capsys.readouterr().out
    a, b = (json.loads((tmp_path / "out" / f"{n}.json").read_text())["label_indices"] for n in ("a.txt", "sub/b.txt"))
    assert {x["label_text"] for x in a["umls_concepts"]} == {"chest pain", "BP"} and {x["cui"] for x in a["umls_concepts"]} == {"C0000000", "C0000001"}
    assert [x["label_text"] for x in a["negated"]] == ["chest pain", "BP"] and [x["label_text"] for x in b["negated"]] == ["fever"]
    assert [x["expansion"] for x in a["acronyms"]] == ["blood pressure"] and [x["label_text"] for x in a["section_headers"]] == ["HISTORY:"]
    # the tag of "denies" ends the cue's scope
    assert a["modifications"] == [] and [x["kind"] for x in b["modifications"]] == ["negated"] and len(a["sentences"]) == 2 and {x["tag"] for x in b["pos_tags"]} >= {"NN", "VBZ"}
    assert a["norm_forms"] and a["negation_triggers"] and "dependency_negated" not in a
    # with a parser plugged in
    lex = pipeline.Lexicons.load(spark, models)
    lex.parser = lambda words: [(k, "root" if k == 0 else "obj", "VERB" if w in ("denies", "has") else "NOUN") for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, "patient denies chest pain .")], "doc_id long, text string")
    labels = pipeline.create(lex, pipeline.FULL).transform(docs)
    assert [(r.start, r.end) for r in labels["dependency_negated"].collect()] == [(15, 25)] and labels["dependencies"].count() == 5
    with pytest.raises(FileNotFoundError):
        pipeline.Lexicons.load(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        pipeline.from_yaml(put("bad.yml", '{"components": [{"name": "nothing"}]}'))
    assert {c["name"] for c in pipeline.catalog()} == set(pipeline.STAGES) and all(c["outputs"] for c in pipeline.catalog())


def test_tags_end_the_scope_of_a_cue(spark):
    docs = spark.createDataFrame([(1, "no that pain")], "doc_id long, text string")
    terms = spark.createDataFrame([(1, 8, 12)], "doc_id long, start int, end int")
    tags = lambda t: spark.createDataFrame([(1, 0, 0, 0, 2, "no", "DT"), (1, 0, 1, 3, 7, "that", t), (1, 0, 2, 8, 12, "pain", "NN")], "doc_id long, sent_id int, tok_id int, start int, end int, text string, tag string")
    for tag, n in (("WDT", 0), ("IN", 1)):
        x = {"documents": docs, "sentences": tokens.sentences(docs), "pos_tags": tags(tag), "umls_terms": terms}
        assert pipeline.modification_labels(x, {"lexicons": pipeline.Lexicons(), "cue_scan": "full"})["modifications"].count() == n
    assert negation.cue_table()
