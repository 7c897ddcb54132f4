"""Readers, writers, the pipeline, streams, and that the entry points work without the optional parts."""

import json
import subprocess
import sys
from pathlib import Path

from notespan.operators import tokens
from notespan.plans import pipeline
from notespan.sources import readers, writers
from notespan.streaming import watch

ROOT = Path(__file__).resolve().parent.parent


def test_files(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("one\ntwo")
    (tmp_path / "in/sub/b.txt").write_text("three")
    (tmp_path / "in/c.rtf").write_bytes(rb"{\rtf1 x}")
    got = {r.event_id: r.text for r in readers.read_texts(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.txt": "one\ntwo", "sub/b.txt": "three"}
    assert [r.event_id for r in readers.read_binary(spark, str(tmp_path / "in")).collect()] == ["c.rtf"]
    q = watch.run(watch.stream_texts(spark, str(tmp_path / "in")), lambda b: b, str(tmp_path / "out"), str(tmp_path / "check"), available_now=True)
    q.awaitTermination()
    (tmp_path / "in/d.txt").write_text("four")
    q = watch.run(watch.stream_texts(spark, str(tmp_path / "in")), lambda b: b, str(tmp_path / "out"), str(tmp_path / "check"), available_now=True)
    q.awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["four", "one\ntwo", "three"]


def test_lexicons(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    rules = readers.read_rules(spark, put("rules", "no evidence of\t\t[PREN]\nbad line\n"))
    assert [tuple(r) for r in rules.collect()] == [(["no", "evidence", "of"], "PREN")]
    ex = readers.read_expansions(spark, put("ex", "BP\nblood pressure|bullous\nMD\ndoctor\n"))
    assert {tuple(r) for r in ex.collect()} == {("BP", "blood pressure"), ("BP", "bullous"), ("MD", "doctor")}
    assert readers.read_patterns(spark, put("pat", "^A$\n^B$\n")) == "(?md)^A$|^B$"
    v = readers.read_vectors(spark, put("vec", "2 3\nfoo 1 2 3\nbar 4 5 6\n"))
    assert {(r.word, tuple(r.vec)) for r in v.collect()} == {("foo", (1.0, 2.0, 3.0)), ("bar", (4.0, 5.0, 6.0))}
    assert [tuple(r) for r in readers.read_vocabulary(spark, put("chars", "a\nb\n")).orderBy("id").collect()] == [("a", 10), ("b", 11)]
    c = readers.read_mrconso(spark, put("conso", "C1|ENG|x|x|x|S1|x|x|x|x|x|SAB|PT|code|a \"name\"|0|N|\n")).first()
    assert (c.cui, c.sui, c.sab, c.str, c.suppress) == ("C1", "S1", "SAB", 'a "name"', "N")
    note = ",".join(f"c{i}" for i in range(11)) + "\n" + ",".join(["7"] + ["x"] * 9 + ['"two\nlines ""q"""']) + "\n"
    assert tuple(readers.read_notes(spark, put("notes.csv", note)).first()) == (7, 'two\nlines "q"')
    assert tuple(readers.read_gold_csv(spark, put("gold.csv", "end,start,a,b,c,cui,id\n9,4,a,b,c,C1,doc\n")).first()) == ("doc", 4, 9, "C1")


def test_corpora(spark):
    docs = lambda t: spark.createDataFrame([(1, t), (2, None)], "doc_id long, text string")
    ptb = readers.parse_ptb(docs("*comment (\n( (S (NP (DT The) (NN dog)) (VP (VBZ is) (-NONE- *)) (-LRB- -LRB-)))")).orderBy("tok_id").collect()
    assert [(r.tag, r.text, r.start) for r in ptb] == [("DT", "The", 0), ("NN", "dog", 4), ("VBZ", "is", 8), ("-LRB-", "(", 11)]
    conll = "# c\n1\tThe\t_\tDET\tDT\t_\t2\tdet\t_\t_\n2\tdog\t_\tNOUN\tNN\t_\t0\troot\t_\t_\n\n1\tX\t_\tX\tXX\t_\t0\troot\t_\t_\n"
    got = readers.parse_conllu(docs(conll), 1).orderBy("sent_id", "dep_id").collect()
    assert [(r.part, r.sent_id, r.dep_id, r.start, r.head_id) for r in got] == [(0, 0, 1, 0, 2), (0, 0, 2, 4, None), (1, 1, 1, 0, None)]
    ast = spark.createDataFrame([(1, 'c="chest pain" 2:1 2:2||t="problem"||a="absent"')], "doc_id long, text string")
    (r,) = readers.read_i2b2(docs("first line\nno chest pain"), ast).collect()
    assert (r.start, r.end, r.concept_type, r.assertion) == (14, 24, "problem", "absent")
    xml = '<set><sentence><w c="NN">dog</w><w c="*">re</w><w c="VB|VBP">run</w><w c="RB">now</w></sentence></set>'
    assert [(r.text, r.tag) for r in readers.parse_genia(docs(xml)).orderBy("tok_id").collect()] == [("dog", "NN"), ("rerun", "VB"), ("now", "RB")]


def test_pipeline_and_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "HISTORY:\nPt denies chest pain")], "doc_id long, text string")
    terms = spark.createDataFrame([(1, 19, 29)], "doc_id long, start int, end int")
    rules = spark.createDataFrame([(["denies"], "PREN")], "words array<string>, tag string")
    lex = pipeline.Lexicons(rules=rules, headers="^[A-Z]+:$")
    p = pipeline.create(lex, ("sentences", "terms", "negex", "modification", "sections"), {"terms": lambda x, o: {"umls_terms": terms}})
    labels = p.transform(docs)
    assert labels["negated"].count() == 1 and labels["section_headers"].count() == 1 and labels["modifications"].first().kind == "negated"
    row = writers.serialise(docs, {"negated": labels["negated"]}, include_label_text=True).first()
    assert json.loads(row.json)["label_indices"]["negated"][0]["label_text"] == "chest pain"
    path = tmp_path / "p.json"
    pipeline.main(["write-config", str(path)])
    assert [n for n, _ in pipeline.from_yaml(str(path)).stages] == list(pipeline.DEFAULT)
    assert pipeline.flat({"a": {"b": "$HOME", "c": 1}})["a.c"] == 1
    writers.write_model({"m": spark.createDataFrame([("b", 1), ("a", 2)], "key string, v int")}, str(tmp_path / "model"))
    assert writers.read_model(spark, str(tmp_path / "model"), ["m"])["m"].count() == 2
    df, seen = writers.counted(tokens.tokens(docs), "rows")
    df.collect()
    assert seen.get["rows"] == 5


def test_entry_points_without_optional_parts(tmp_path):
    import shutil

    for x in ("notespan", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / x).is_dir() else shutil.copy)(ROOT / x, tmp_path / x)
    shutil.rmtree(tmp_path / "notespan/llm", ignore_errors=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert said.stdout.split()[1] == "False" and int(said.stdout.split()[0]) > 40, said.stderr
