"""Vector search, page text, tool calls, and the pipeline."""

import json

import numpy as np
import pytest

import corpus_pipeline
from notespan.llm import chat, html_templates, imi


def test_search_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 10)) + 3 * rng.normal(size=(6, 10))[rng.integers(0, 6, 600)]
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(x)]
    rows[40] = (40, rows[41][1], 0, "x")  # a tie
    rows += [(1000, None, 0, "x"), (1020, [0.0] * 10, 0, "x"), (1040, [1.0] * 9 + [float("nan")], 0, "x"), (1060, [None] + [1.0] * 9, 0, "x"), (1080, [1.0, 2.0], 0, "x"), (None, [1.0] * 10, 0, "x"), rows[0]]
    monkeypatch.setattr(imi, "BLOCK", 50)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cell string")
    got = {}
    for r in imi.search(df).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    x[40] = x[41]
    assert set(got) == set(range(0, 600, 20))
    found = 0
    for q, ranks in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -s))[:20]
        assert sorted(ranks) == list(range(1, 21)) and q not in {v for v, _ in ranks.values()}
        assert all(abs(s[v] - p) < 1e-9 for v, p in ranks.values())
        assert [p for _, p in map(ranks.get, range(1, 21))] == sorted((p for _, p in ranks.values()), reverse=True)
        found += len({v for v, _ in ranks.values()} & set(best.tolist()))
    assert found / (20 * len(got)) >= 0.9
    assert imi.search(df.limit(0)).count() == 0
    few = imi.search(df.filter("vec_id IN (0, 1, 2)")).collect()
    assert [(r.query_id, r.rank) for r in sorted(few, key=lambda r: r.rank)] == [(0, 1), (0, 2)]


def test_only_entries_of_visited_cells_are_scored(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8))
    x[300:500] = x[300] + 1e-3 * rng.normal(size=(200, 8))  # a cell of more than a block
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for block, large in ((40, 60), (5000, 5000)):
        monkeypatch.setattr(imi, "BLOCK", block)
        monkeypatch.setattr(imi, "LARGE", large)
        index = imi.build(imi.usable(df)[0].dropDuplicates(["vec_id", "v"]), 8, 20, 0.6)
        cells = index.cells(x)
        index.counts = np.bincount(cells, minlength=len(index.counts))
        got = {}
        for r in imi.search(df, recall=0.6).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        shares = []
        for q in range(0, 900, 20):
            seen = np.isin(cells, index.visit(x[q], index.share))
            shares.append(seen.mean())
            s = np.where(seen, (x * x[q]).sum(axis=1), -np.inf)
            s[q] = -np.inf
            best = np.lexsort((np.arange(900), -s))[:20]
            assert got.get(q, []) == [b for b in best.tolist() if s[b] > -np.inf]
        assert np.mean(shares) < 0.5
    assert imi.search(df.withColumn("cell", F.lit("x")), every=1000).count() == 20


def test_heap_visits_pairs_in_order():
    rng = np.random.default_rng(1)
    index = imi.Index(rng.normal(size=(7, 3)), rng.normal(size=(5, 3)))
    index.counts[:] = 1
    q = rng.normal(size=6)
    s = (index.one @ q[:3])[:, None] + (index.two @ q[3:])[None]
    assert index.visit(q, 1.0) == np.argsort(-s.ravel(), kind="stable").tolist()


PAGE = "<html><head><title>T {0}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Menu {0}</a></li></ul></nav><div class=\"ad\">Buy {0}</div><aside>side</aside><article><h1>Head {0}</h1><p><b>First   {0} &amp; more<br>next<p>Second<ul><li>one<li>two</ul><div class='comments'><p>reader {0}</p></div></article><form><input><button>go</button></form><footer>&copy; host</footer></body></html>"


def test_page_texts(spark):
    rows = [(i, f"http://h{i % 3}.org/{i}", PAGE.format(i), "x") for i in range(9)] + [(20, None, None, "x"), (21, "http://solo.org/", "<p>Just <i>this</i></p>tail<!-- no --> end", "x"), (22, "bad url", "", "x"), (0, "http://h0.org/0", PAGE.format(0), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = html_templates.main_texts(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    for i in range(9):
        assert by[i] == f"Head {i}\n\nFirst {i} & more next\n\nSecond\n\none\n\ntwo"
    assert by[20] == "" and by[21] == "Just this\n\ntail end" and by[22] == ""
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_templates.main_texts(df.limit(0)).count() == 0


def test_template_tells_content_without_an_article(spark):
    page = "<html><body><div>Shared frame words here</div><div>own {0} text of page {0}</div><div>Shared foot line</div></body></html>"
    pages = [html_templates.Page(page.format(i)) for i in range(5)]
    assert html_templates.extract(pages) == [f"own {i} text of page {i}" for i in range(5)]


SCHEMAS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["string", "null"], "pattern": "^x"}}, "additionalProperties": False}}


def test_calls_are_linked_ordered_and_validated(spark):
    calls = spark.createDataFrame(
        [(1, 0, "a", "add", '{"b": "xy", "a": 1.0}', []), (1, 1, "b", "add", '{"a": -1}', ["a"]), (1, 2, "c", "add", "[1]", ["b", "a"]), (1, 3, "d", "nope", "{}", ["e"]), (1, 4, "e", "add", "{", ["d"]), (1, 5, "a", "add", '{"a": 2}', []), (1, 6, None, "add", None, ["zz"]), (2, 0, "a", "add", '{"a": 1, "z": 1}', ["missing"])],
        "conv_id long, turn long, call_id string, name string, arguments string, uses array<string>",
    )
    results = spark.createDataFrame([(1, 7, "a", "late"), (1, 3, "a", "first"), (2, 9, "q", "orphan"), (1, 9, "b", None), (1, 9, None, "x")], "conv_id long, turn long, call_id string, content string")
    got = {(r.conv_id, r.turn): r for r in chat.link(calls, results, SCHEMAS).collect()}
    assert len(got) == 8
    assert [got[1, t].level for t in range(7)] == [0, 1, 2, -1, -1, 0, 0]
    assert got[1, 0].json == '{"arguments":{"a":1,"b":"xy"},"id":"a","name":"add","result":"first"}' and got[1, 0].valid and got[1, 0].n_results == 2
    assert got[1, 1].errors == "$.a: below minimum" and got[1, 2].errors == "$: not object"
    assert got[1, 3].errors == "unknown tool nope" and got[1, 4].errors == "not JSON" and got[1, 5].status == "repeated"
    assert got[1, 6].status == "open" and got[2, 0].errors == "$.z: unknown"
    assert {r.call_id for r in chat.orphans(calls, results).collect()} == {"q", None}
    assert chat.link(calls.limit(0), results, SCHEMAS).count() == 0


def test_embedded_calls(spark):
    turns = spark.createDataFrame([(1, 0, 'do <tool_call>{"id":"x","name":"add","arguments":{"a":1},"uses":["y"]}</tool_call> now'), (1, 1, None)], "conv_id long, turn long, text string")
    (r,) = chat.embedded_calls(turns).collect()
    assert (r.call_id, r.name, json.loads(r.arguments), r.uses) == ("x", "add", {"a": 1}, ["y"])


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_pipeline_stages(spark, stages):
    from test_documents import brute_jaccard

    columns = stages[0][0].columns
    for _, after in stages[:-1]:
        assert after.columns == columns
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in stages[1])
    want = {i for i, _, _, c in brute_jaccard(list(before.items())) if i == c}
    assert set(after) == want and all(before[i] == t for i, t in after.items())
    good, bad = stages[0][1].count(), stages[0][0].count() - stages[0][1].count()
    assert good > 3 * bad > 0
    assert stages[2][0].count() == stages[2][1].count()
    mixed = [r.doc_id for r in stages[3][1].collect()]
    assert len(mixed) > 0 and max(map(mixed.count, set(mixed))) <= 2
    pieces = stages[4][1].collect()
    assert {p.doc_id for p in pieces} == set(mixed)
    # each document's ids are packed as often as the mix repeats it
    total = {}
    for p in pieces:
        total.setdefault(p.doc_id, [p.doc_tokens, 0])[1] += p.length
    assert all(n == t * mixed.count(i) for i, (t, n) in total.items())


def test_template_text_inside_an_article_is_left_out(spark):
    record = "<div class='rec'><p>Rate this entry now</p><p>own{0} words{0} of{0}</p></div>"
    page = "<html><body><article><h1>Title{0}</h1><p>Written by the whole staff</p>{1}<p>Body{0} of{0}</p></article></body></html>"
    sources = [page.format(i, "".join(record.format(f"{i}x{k}") for k in range(i % 3 + 1))) for i in range(5)]
    want = ["\n\n".join([f"Title{i}", *[f"own{i}x{k} words{i}x{k} of{i}x{k}" for k in range(i % 3 + 1)], f"Body{i} of{i}"]) for i in range(5)]
    assert html_templates.extract([html_templates.Page(s) for s in sources]) == want
    # copies of one page are no template; a small remainder goes with the block before
    assert "Written by" in html_templates.extract([html_templates.Page(sources[0])] * 3)[1]
    df = spark.createDataFrame([(i, f"http://a.org/{i}", s) for i, s in enumerate(sources)], "page_id long, url string, html string").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        assert {r.page_id: r.text for r in html_templates.main_texts(df, 4).collect()} == dict(enumerate(want))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_awkward_arguments_do_not_stop_a_task(spark):
    schemas = {
        "n": {"type": "object", "properties": {"a": {"type": "integer", "exclusiveMaximum": 10**500}, "b": {"anyOf": [{"type": "null"}, {"$ref": "#/$defs/short"}]}, "c": {"uniqueItems": True}, "d": {"oneOf": [{"const": True}, {"type": "number", "multipleOf": 0.1}]}, "e": {"allOf": [{"exclusiveMinimum": 0}], "not": {"enum": [3]}}}, "$defs": {"short": {"type": "string", "maxLength": 2}}}
    }
    given = [
        ('{"a": 1%s}' % ("0" * 400), ""),
        ('{"a": 1%s}' % ("0" * 5000), "not JSON"),
        ('{"a": "\\ud800", "\\udfff": 1}', "$.a: not integer"),
        ('{"a": 1e999}', "not JSON"),
        ("[" * 100_000, "not JSON"),
        ('{"z": ' + "[" * 900 + "]" * 900 + "}", None),
        ('{"b": null, "c": [1, true, "1"], "d": true, "e": 2}', ""),
        ('{"b": "xyz", "c": [1, 1.0], "d": 0.25, "e": 3}', "$.b: none of anyOf; $.c: repeated items; $.d: 0 of oneOf; $.e: is what it must not be"),
        ('{"d": 0.3, "e": 0}', "$.e: below minimum"),
        ("", "not JSON"),
        ("null", "$: not object"),
    ]
    calls = spark.createDataFrame([(1, k, f"c{k}", "n", a, []) for k, (a, _) in enumerate(given)], "conv_id long, turn long, call_id string, name string, arguments string, uses array<string>")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    got = {r.turn: r for r in chat.link(calls, results, schemas).collect()}
    for k, (_, errors) in enumerate(given):
        assert errors is None or got[k].errors == errors
        json.loads(got[k].json)
    assert "\\ud800" in got[2].json and got[0].valid
    for bad in ({"type": "text"}, {"pattern": "("}, {"patternProperties": {}}, {"$ref": "http://x"}, {"$ref": "#/none"}, {"items": [{}]}, {"minimum": "1"}, {"required": "a"}):
        with pytest.raises(ValueError):
            chat.link(calls, results, {"n": {"properties": {"a": bad}}})


def test_levels_in_rounds_and_in_one_task(spark, monkeypatch):
    import random

    rng = random.Random(6)
    rows = [(c, f"n{k}", [f"n{rng.randrange(k + (rng.random() < 0.02) * 3)}" for _ in range(rng.randrange(3)) if k]) for c in range(6) for k in range(40)]
    rows += [(0, "c1", ["c2"]), (0, "c2", ["c1", "n3"]), (0, "c3", ["c1", "n1"]), (5, "s", ["s"])]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, uses array<string>")
    one = sorted(map(tuple, chat.levels(calls).collect()))
    want = []
    for c in range(6):  # brute force: the longest path down, or -1 with a cycle below
        uses = {i: [u for u in us if u in {r[1] for r in rows if r[0] == c}] for d, i, us in rows if d == c}

        def depth(i, above=(), uses=uses):
            if i in above:
                return -1
            below = [depth(u, (*above, i)) for u in uses[i]]
            return -1 if -1 in below else 1 + max(below, default=-1)

        want += [(c, i, depth(i)) for i in uses]
    monkeypatch.setattr(chat, "ONE_TASK", 30)
    assert one == sorted(want) == sorted(map(tuple, chat.levels(calls).collect()))
    assert {x for *_, x in one} >= {-1, 0, 1, 2}


def test_turns_with_nulls_and_repeats(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", "r"), (1, 2, "user", None), (1, 3, None, "x"), (None, 0, "user", "n"), (1, None, "user", "m"), (2, 0, "user", ""), (2, 1, "assistant", "late")]
    got = chat.linked_turns(spark.createDataFrame([(*r, 9, "z") for r in rows], "conv_id long, turn long, role string, text string, level int, json string")).collect()
    assert len(got) == 6
    by = {(r.conv_id, r.turn, r.status): r for r in got}
    assert by[1, 0, "linked"].n_results == 2 and '"result":null' in by[1, 0, "linked"].json and (1, 0, "repeated") in by
    assert by[1, 2, "open"].level == 1 and not by[1, 2, "open"].valid and not by[2, 0, "linked"].valid
    assert chat.linked_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_names_of_parts_are_read_whole():
    inner = '<header class="entry-header"><h1>Title</h1></header><div class="article-header">Lead</div><div class="related-work">Prior art</div><div class="comment-analysis">Of comments</div><div class="search-results">Found</div><div class="share-price">Price</div>'
    outer = '<div class="site-header">Site</div><div id="comments-list">Reader</div><div class="x related-posts">More</div><div class="ad-2">Buy</div><div class="page-nav">Next</div>'
    (text,) = html_templates.extract([html_templates.Page(f"<body>{outer}<article>{inner}{outer.replace('site-header', 'post-comments')}</article></body>")])
    assert text == "Title\n\nLead\n\nPrior art\n\nOf comments\n\nFound\n\nPrice"


def test_page_texts_do_not_depend_on_partitions(spark):
    frame = "<html><body><div>Menu one two three</div><div><p>Read by all</p><p>own{0} words{0}</p></div><p>the last line of {1}</p></body></html>"
    rows = [(i, f"https://big.example.org/{i % 250}", frame.format(i % 250, "big")) for i in range(300)] + [(1000 + i, f"https://s{i % 9}.org/{i}", frame.format(i, "small")) for i in range(40)]
    rows += [(5000, None, None), (5001, "http://x.org", ""), (5002, "http://x.org/q", "<p title='unclosed>a<p>b"), (5003, "http://x.org/l", "<article>" + "<p>w &amp; x" * 20_000), (None, "https://big.example.org/n", frame.format("n", "big"))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(tuple, html_templates.main_texts(df.repartition(n)).collect()), key=repr))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and len(found[0]) == len(rows)
    by = {r[0]: r for r in found[0]}
    assert all(by[i][2] == f"own{i % 250} words{i % 250}" and by[i][4] for i in range(300)) and by[None][2] == "ownn wordsn"
    assert by[5000][2:4] == ("", 0) and by[5003][2].count("w & x") == 20_000
    assert html_templates.main_texts(df.limit(0)).count() == 0


def test_texts_change_without_a_template(spark, monkeypatch):
    page = "<html><body><div>Menu one two three</div><div>own{0} words{0}</div><p>Foot four five</p></body></html>"
    pages = [html_templates.Page(page.format(i)) for i in range(6)]
    assert html_templates.extract(pages) == [f"own{i} words{i}" for i in range(6)]
    monkeypatch.setattr(html_templates, "template", lambda _: [])
    assert all(t.startswith("Menu") for t in html_templates.extract(pages))
