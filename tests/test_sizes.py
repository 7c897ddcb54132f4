"""Steps that were rewritten for larger tables: what a worker holds is bounded, and results are those of plain versions."""

import itertools
import random

import pyarrow as pa
from pyspark.sql import functions as F

from notespan.functions import text as T
from notespan.operators import tokens
from notespan.plans import catalog
from notespan.sources import readers


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_word_vectors_are_cut_in_single_precision(spark, tmp_path):
    folder = table(spark, tmp_path, "embeddings", [(0, [0.009, 0.5])], "vec_id long, embedding array<float>")
    assert catalog.QUERIES["word_vectors"](spark, folder).first().total == 509  # 0.009 is less in double precision


def test_loops_over_texts_give_few_rows_at_a_time():
    schema = pa.schema([("n", pa.int64())])
    assert [b.num_rows for b in tokens.gathered(((k,) for k in range(10)), schema, 4)] == [4, 4, 2]
    seen = []
    first = next(tokens.gathered(((seen.append(k) or k,) for k in itertools.count()), schema))
    assert first.num_rows == tokens._ROWS == len(seen)  # nothing is read ahead
    b = pa.record_batch({"doc_id": pa.array(range(3)), "text": pa.array(["a" * tokens._BATCH, None, "b"])})
    assert [(ids.to_pylist(), len(raw)) for ids, raw, _ in tokens._parts(b)] == [([0, 1], tokens._BATCH), ([2], 1)]


def test_sentences_of_many_tokens(spark):
    texts = [(k, f"w{k} " * (k * 997) + "\n" + "x " * k) for k in range(40)] + [(99, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    got = {(r.doc_id, r.sent_id): [tuple(t) for t in r.tokens] for r in tokens.sentences(docs, tokens.line_sentences, tokens.edge_words).collect()}
    want = {(i, n): [(a + x, a + y, t[a:z][x:y]) for x, y in tokens.edge_words(t[a:z])] for i, t in texts for n, (a, z) in enumerate(tokens.line_sentences(t or ""))}
    assert got == want
    rows = {(r.doc_id, r.tok_id): (r.start, r.end, r.text) for r in tokens.tokens(docs, tokens.edge_words).collect()}
    assert rows == {(i, n): (a, z, t[a:z]) for i, t in texts for n, (a, z) in enumerate(tokens.edge_words(t or ""))}


def test_queries_of_one_pass_shuffle_nothing(spark, tmp_path):
    folder = table(spark, tmp_path, "documents", [(1, "Ab it's. [**x y**] zz"), (2, None)], "doc_id long, text string")
    for name in ("model_tokens", "spaces_after"):
        plan = catalog.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "Join" not in plan, name
    docs = spark.createDataFrame([(1, "a\x0bb c\x1fd  e\n"), (2, None), (3, "f")], "doc_id long, text string")
    for words in (tokens.plain_words, tokens.unicode_words, tokens.edge_words):
        want = tokens.tokens(docs, words).withColumnRenamed("text", "w").join(docs, "doc_id").select("doc_id", "tok_id", T.space_after(F.col("text"), F.col("end")))
        assert sorted(map(tuple, tokens.spaces(docs, words).collect())) == sorted(map(tuple, want.collect()))


def test_runs_are_counted_where_they_are_read(spark):
    docs = spark.createDataFrame([(1, "The cat, the cat. É é\n- a\n"), (2, None), (3, "the CAT " * 50), (4, "one")], "doc_id long, text string")
    for n in (1, 2, 3):
        want = tokens.ngrams(tokens.sentences(docs), n, T.trigger_word).filter(F.col("n") == n).groupBy("gram").agg(F.count("*").alias("n"))
        got = tokens.run_counts(docs, n, T.cleaned_trigger)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_concepts_by_line_and_token_need_no_rows_of_words(spark):
    texts = spark.createDataFrame([(1, "one\n\ttwo  three\n"), (2, None), (3, "a|b c")], "doc_id long, text string")
    mark = lambda at: f'c="x y" {at}||t="p"||a="q"'
    notes = spark.createDataFrame([(1, "\n".join(map(mark, ("2:0 2:1", "1:0 2:0", "2:2 2:2", "9:0 9:0", "0:0 1:0")))), (3, mark("1:0 1:1")), (2, mark("1:0 1:0"))], "doc_id long, text string")
    found = readers.read_i2b2(texts, notes)
    assert sorted((r.doc_id, r.start, r.end) for r in found.collect()) == [(1, 0, 8), (1, 5, 15), (3, 0, 5)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_long_chains_of_modifiers_are_walked_once():
    from notespan.operators import negation

    n = 3000  # each reading of a chain used to read the rest of it twice
    deps = [{"dep_id": k, "start": 2 * k, "end": 2 * k + 1, "text": "w", "head_id": k - 1 if k else None, "deprel": "nmod", "upos": "NOUN"} for k in range(n)]
    terms = [{"start": 2 * k, "end": 2 * k + 1} for k in range(n - 500, n)]
    trig = [{"start": 2 * k, "end": 2 * k + 1, "tag": "PREN"} for k in range(3)]
    assert [(t["start"], g["start"]) for t, g in negation.affirmed(terms, trig, deps)] == [(t["start"], 0) for t in terms]


def test_cues_and_triggers_in_one_long_line(spark):
    from notespan.operators import negation

    rng, words = random.Random(3), ["no", "pain", "but", "likely", "x", "No,", "--", "seen", "not"]
    line = " ".join(rng.choice(words) for _ in range(4000))
    docs = spark.createDataFrame([(1, line), (2, "x but\npain likely\n" + line[:200])], "doc_id long, text string")
    s, toks = tokens.sentences(docs), tokens.tokens(docs)
    terms = toks.filter("text = 'pain'").select("doc_id", "start", "end")
    cues = spark.createDataFrame([("left", "negated", ["no"]), ("left", "negated", ["not", "seen"]), ("left", "other", ["no"]), ("right", "uncertain", ["likely"]), ("right", "negated", ["x", "likely"])], "side string, kind string, words array<string>")
    given = [tuple(r) for r in cues.collect()]
    for scan in ("reference", "full"):
        want = set()
        for r in s.collect():
            t = [tuple(x) for x in r.tokens]
            for i, (a, z, w) in enumerate(t):
                best = None
                for side, near in (("left", t[:i][::-1]), ("right", t[i + 1 :])):
                    for off in range(len(near)):
                        if best or near[off][2] in negation.SCOPE_WORDS:
                            break
                        for n in range(off + 1 if scan == "reference" else 1, 3):
                            run = near[off : off + n]
                            text = [x[2] for x in (run[::-1] if side == "left" else run)]
                            kinds = [k for d, k, e in given if d == side and e == text and len(run) == n]
                            if kinds and not best:
                                best = min(kinds), min(x[0] for x in run), max(x[1] for x in run)
                if w == "pain" and best:
                    want.add((r.doc_id, r.sent_id, a, z, *best))
        assert {tuple(x) for x in negation.modifications(s, terms, cues, scan).collect()} == want


def test_tagging_by_tables_is_tagging_by_the_model(spark):
    from notespan.operators import tagging

    rng, names = random.Random(4), [f"{a}{b}{c}" for a in ("w", "Xy", "z") for b in "aeiou" for c in ("ing", "ed", "s", "")]
    seen = [(k % 7, k // 20, k % 20, 0, 0, rng.choice(names[:40]), rng.choice(("NN", "VB", "JJ"))) for k in range(600)]
    tables = tagging.train(spark.createDataFrame(seen, "doc_id long, sent_id int, tok_id int, start int, end int, text string, tag string"))
    docs = spark.createDataFrame([(k, " ".join(rng.choice([*names, "Qing", "--"]) for _ in range(30)) + (". \nx" if k % 2 else "")) for k in range(12)] + [(50, None)], "doc_id long, text string")
    s = tokens.sentences(docs.repartition(3))
    want = sorted(map(tuple, tagging.tag(s, tagging.Model.load(tables)).collect()))
    for frequent, share in ((0, 200), (5, 1 << 20), (1000, 1)):
        assert sorted(map(tuple, tagging.tag_by_tables(s, tables, share=share, frequent=frequent).collect())) == want


def test_windows_that_no_key_begins_with_are_not_made(spark):
    from notespan.operators import concepts

    schema = "key string, sui string, cui string, tui string, source int, code string"
    make = lambda *keys: spark.createDataFrame([(k, "S", f"C{i}", "T", 0, "x") for i, k in enumerate(keys)], schema)
    d = {"phrase": make("Chest pain", "low BP", "heart"), "lower": make("chest pain", "low bp", "blood pressure x"), "norm": make("pain severe", "back low")}
    token = "struct<tok_id:int,start:int,end:int,text:string,tag:string,norm:string,expansion:string>"
    rng, rows = random.Random(6), []
    for k in range(60):
        at, toks = 0, []
        for i in range(12):
            w = rng.choice(["Chest", "pain", "low", "BP", "the", "Heart", "heart", "severe", "back", "x", ","])
            toks.append((i, at, at + len(w), w, rng.choice(["NN", "CD", "DT"]), w.lower(), "blood pressure" if w == "BP" else None))
            at += len(w) + rng.choice((0, 1, 2))
        rows.append((k, 0, toks))
    s = spark.createDataFrame(rows, f"doc_id long, sent_id int, tokens array<{token}>")
    first = concepts._may_begin(d)
    every, some = concepts.window_keys(s, 3), concepts.window_keys(s, 3, first)
    assert 0 < some.count() < every.count()
    keys = d["phrase"].select(F.lit("phrase").alias("kind"), "key").union(d["lower"].select(F.lit("lower"), "key")).union(d["norm"].select(F.lit("norm"), "key"))
    hits = lambda w: sorted(map(tuple, w.join(keys, ["kind", "key"]).collect()))
    assert hits(some) == hits(every) != []


def test_attachment_within_rows_and_candidates_by_open_tags(spark):
    from notespan.operators import acronyms, sections

    word = "array<struct<start:int,end:int,head_start:int,head_end:int,deprel:string>>"
    rng = random.Random(9)
    make = lambda n: [(2 * k, 2 * k + 1, rng.choice((None, 0)), rng.choice((None, 1)), rng.choice(("a", "b", None))) for k in range(n)]
    rows = [(k, make(6), rng.sample(make(6), rng.choice((4, 6)))) for k in range(30)] + [(90, [], make(1)), (91, make(5), make(5))]
    s = spark.createDataFrame(rows, f"doc_id long, g {word}, p {word}")
    flat = lambda c: s.select("doc_id", F.explode(c).alias("x")).select("doc_id", "x.*")
    assert tuple(sections.attachment_in(s, F.col("g"), F.col("p")).first()) == tuple(sections.attachment(flat("g"), flat("p")).first())
    spans = [(1, a, a + rng.randrange(1, 9)) for a in range(60)]
    toks = spark.createDataFrame([(*x, "w") for x in spans], "doc_id long, start int, end int, text string")
    tags = [(*rng.choice(spans), rng.choice(("NN", "DT", "IN"))) for _ in range(25)]
    want = sorted((d, a, z) for d, a, z in spans if any(a <= s and e <= z and t == "NN" for _, s, e, t in tags))
    got = acronyms.candidates(toks, spark.createDataFrame(tags, "doc_id long, start int, end int, tag string"), 8)
    assert sorted((r.doc_id, r.start, r.end) for r in got.collect()) == want


def test_vocabulary_is_counted_where_texts_are_read(spark):
    from notespan.operators import acronyms

    texts = [(1, "The the 1 12 3.5 1,2 a.b x-y"), (2, "the é\n\nA&b 7"), (3, None), (4, "--"), (5, " 99 THE")]
    for rows in (texts, [*texts, (1, "the new"), (2, "other 12")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        want = acronyms.vocabulary(tokens.tokens(docs)).select("word", "word_id", "df", "idf")
        got = acronyms.document_vocabulary(docs).select("word", "word_id", "df", "idf")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
