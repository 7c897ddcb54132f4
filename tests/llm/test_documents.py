"""Operators on documents against brute force, on rows that hold every awkward case."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest

from notespan.llm import fingerprint, jaccard, mixing, packing, pii, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, h long, whole string"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def texts():
    rng = random.Random(4)
    vocab = ["w%d" % i for i in range(400)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(30, 90))) for _ in range(12)]
    out = list(base)
    for t in base[:6]:  # near copies: one word of many changed, or the case
        w = t.split(" ")
        for k in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed%d" % k
            out.append(" ".join(v))
        out.append(t.upper())
        out.append(t)
    out += [None, "", " \n\t ", "one", "one", "one two three four", "one two three four five", "É x É x", "naïve café x y", "a\n\nb\r\nc  d"]
    out.append(" ".join(rng.choice(vocab) for _ in range(30_000)))
    out.append("x" * 200_000)
    out.append("Write to jo.doe+x@mail-1.example.com. or a@b or @c.d 1.2.3.4 999.1.1.1 1.2.3.4.5 +49 (30) 1234-5678. 4111 1111 1111 1111 5500-0000-0000-0004 41111111111111112 +1 (017) 555-7713")
    out.append("9" * 50_000 + " a@" * 100 + "1." * 5000 + "+1" * 3000 + "x@y.z@q.r.s")
    out.append("é" * 10 + " Ünï jo@x.org\n" * 3 + "<|endoftext|> it's 12345  done ")
    return out


def rows():
    ts = texts()
    out = [(i * 3, t, "en", "s%d" % (i % 4) if i % 7 else None, len(t or ""), "k", 1, 2, "w") for i, t in enumerate(ts)]
    out.append(out[3])  # a repeated row
    out.append((None, "no id at all here, a b c", "en", None, 3, "k", 1, 2, "w"))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(r[0], i % 2, (i // 2) % 2, "x") for i, r in enumerate(rows())] + [(3, 1, 0, "x"), (9, None, None, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")


def test_base_spans_are_those_of_the_patterns(spark, docs):
    def spec(t):
        out = []
        t = t or ""
        for k, rx in enumerate((EMAIL, IP, CARD, PHONE)):
            if k and len(t) > 40_000:
                t_ = t if k == 2 else t[50_000:]
            else:
                t_ = t
            off = len(t) - len(t_)
            for m in rx.finditer(t_):
                d = re.sub(r"\D", "", m.group())
                ok = [True, all(int(p) <= 255 for p in m.group().split(".")) if k == 1 else True, 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15][k]
                if ok:
                    out.append((m.start() + off, k, m.end() + off))
        return sorted(out)

    got = sorted(pii.personal_data(docs).collect(), key=repr)
    want = []
    for r in rows():
        s = [] if r[1] and r[1][:9] == "x" * 9 else spec(r[1])
        want.append((r[0], *[sum(k == i for _, k, _ in s) for i in range(4)], hashlib.sha256(pii.joined(s).encode()).hexdigest()))
    assert sorted([tuple(r)[:6] for r in got], key=repr) == sorted(want, key=repr)
    assert all(r.spans.startswith("email") for r in got if r.n_email and not r.n_ip)


def test_terms_that_reveal_an_entity_are_found_by_counting(spark):
    rows = [(i, f"order ref{i}x for zorblax of unit b{i} mail z@q.org the end", "s") for i in range(5)]
    rows += [(10 + i, f"plain text {i} with unit and the rest of it", "s") for i in range(60)]
    rows += [(80, "zorblax again", "s"), (81, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    # brute force: shares by the definition
    term = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+")
    n, ctx = len(rows), {}
    for _, t, _ in rows:
        for m in EMAIL.finditer(t or ""):
            ctx.setdefault(m.group(), set()).add(tuple(w.lower() for w in term.findall(t[max(0, m.start() - 80) : m.start()] + "\n" + t[m.end() : m.end() + 80])))
    flagged = set()
    for contexts in ctx.values():
        for w in set(itertools.chain(*contexts)):
            co = sum(w in c for c in contexts)
            df = sum(w in {x.lower() for x in term.findall(t or "")} for _, t, _ in rows)
            if co >= 3 and np.log2(co * n / (df * len(contexts))) / np.log2(n / len(contexts)) >= pii.GENERALISE:
                flagged.add(w)
    assert "zorblax" in flagged and "unit" not in flagged
    for i, t, _ in rows:
        want = [f"term:{m.start()}:{m.end()}" for m in term.finditer(t or "") if m.group().lower() in flagged and not any(e.start() < m.end() and m.start() < e.end() for e in EMAIL.finditer(t))]
        assert [s for s in got[i].split(",") if s.startswith("term")] == want
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "zorblax" not in clean[80] and "[EMAIL]" in clean[0] and clean[10] == rows[5][1] and clean[81] is None


def test_sanitise_keeps_rows_and_columns(docs, empty):
    got = pii.sanitise(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert not any(EMAIL.search(r.text or "") for r in got.collect() if len(r.text or "") < 1000)
    assert pii.sanitise(empty).count() == 0 and pii.personal_data(empty).count() == 0


def test_fingerprints(docs, empty):
    def order(r):
        return (r[0] if r[0] is not None else -(1 << 63)) * -1

    got = fingerprint.fingerprints(docs).collect()
    assert len(got) == len(rows())
    by_id = {r.doc_id: r for r in got}
    ordered = sorted(rows(), key=order)
    shas = sorted(hashlib.sha256(fingerprint.edited(a[1] or "", b[1] or "").encode()).hexdigest() for a, b in zip(ordered, ordered[1:] + ordered[:1]))
    assert sorted(r.edited_sha256 for r in got) == shas
    for r in rows():
        g = by_id[r[0]]
        assert g.n_chars == len(r[1] or "") and g.fingerprint == fingerprint.to_hex(fingerprint.fingerprint(r[1] or ""))
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
    assert fingerprint.fingerprints(empty).count() == 0
    one = fingerprint.fingerprints(docs.filter("doc_id = 0")).first()
    assert one.near_next == 1.0


def test_fingerprints_are_homomorphic():
    a, b = "alpha beta gamma\ndelta epsilon\nzeta", "zeta\nalpha beta gamma\n\ndelta epsilon"
    assert fingerprint.to_hex(fingerprint.fingerprint(a)) == fingerprint.to_hex(fingerprint.fingerprint(b))
    f = fingerprint.add_paragraph(fingerprint.fingerprint(a), b"new one here")
    assert fingerprint.to_hex(f) == fingerprint.to_hex(fingerprint.fingerprint(a + "\nnew one here"))
    f = fingerprint.add_paragraph(f, b"zeta", -1)
    assert fingerprint.to_hex(f) == fingerprint.to_hex(fingerprint.fingerprint("alpha beta gamma\ndelta epsilon\nnew one here"))
    assert fingerprint.likeness(fingerprint.from_hex(fingerprint.to_hex(f)), f) == 1.0


def brute_jaccard(pairs):
    def words(t):
        return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]

    sets = [set(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else set() for w in (words(t) for _, t in pairs)]
    n, root = [0] * len(sets), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        o = len(sets[a] & sets[b])
        if o and 100 * o >= 90 * (len(sets[a]) + len(sets[b]) - o):
            n[a] += 1
            n[b] += 1
            root[find(a)] = find(b)
    comp = {}
    for a, (i, _) in enumerate(pairs):
        comp.setdefault(find(a), []).append(i)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in comp.items()}
    return [(i, len(sets[a]), n[a], least[find(a)]) for a, (i, _) in enumerate(pairs)]


def test_jaccard_join_is_exact(docs, empty):
    got = [tuple(r) for r in jaccard.jaccard_join(docs).collect()]
    want = brute_jaccard([(r[0], r[1]) for r in rows()])
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(w[2] > 0 for w in want) > 20
    assert jaccard.jaccard_join(empty).count() == 0 and jaccard.without_near_copies(empty).count() == 0


def test_jaccard_join_with_shared_passages_and_large_groups(spark, monkeypatch):
    rng = random.Random(9)
    shared = ["p%d" % i for i in range(60)]
    pairs = []
    for i in range(120):  # a passage that all share, and own words around it
        pairs.append((i, " ".join(["o%d" % rng.randrange(10**6) for _ in range(rng.choice([3, 8, 200]))] + shared)))
    core = ["c%d" % rng.randrange(500) for _ in range(150)]
    for i in range(200, 340):  # a group of texts that all differ a little
        w = list(core)
        w[rng.randrange(150)] = "v%d" % i
        pairs.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard, "SETS", 16)
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    got = [tuple(r) for r in jaccard.jaccard_join(docs).collect()]
    assert sorted(got) == sorted(brute_jaccard(pairs))


def test_hot_tokens_are_split_and_no_link_is_lost(spark, monkeypatch):
    rng = random.Random(19)
    monkeypatch.setattr(jaccard, "HOT", 8)
    pairs = []
    for g in range(6):  # groups of linked texts of all sizes, whose tokens are all hot
        core = ["g%d_%d" % (g, k) for k in range(rng.choice([1, 4, 7, 30, 100, 300]))]
        for i in range(60):
            w = core + ["g%d_e%d" % (g, k) for k in range(rng.randrange(1 + len(core) // 6))]
            if w and rng.random() < 0.5:
                w[rng.randrange(len(w))] = "o%d" % rng.randrange(4)
            pairs.append((len(pairs), " ".join(w)))
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    got = [tuple(r) for r in jaccard.jaccard_join(docs).collect()]
    want = brute_jaccard(pairs)
    assert sorted(got) == sorted(want) and sum(w[2] for w in want) > 1000


def test_components_in_rounds(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(500, 540)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {tuple(r) for r in jaccard.components(df).collect()}
    assert {tuple(r) for r in jaccard.components(df, local=0).collect()} == want


def test_one_of_each_group_stays(docs):
    got = jaccard.without_near_copies(docs)
    assert got.columns == docs.columns
    want = {r[0] for r in brute_jaccard([(r[0], r[1]) for r in rows()]) if r[0] is None or r[0] == r[3]}
    ids = [r.doc_id for r in got.collect()]
    assert set(ids) == want and len(ids) == len(set(ids))


def test_mixing_against_sequential_selection(docs, empty):
    from pyspark.sql import functions as F

    got = mixing.mix(docs, F.array("source")).collect()
    size = {}
    for r in rows():
        size[r[3]] = size.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    goal = mixing.targets(size)
    assert abs(sum(t for t, _ in goal.values()) - 1.5 * sum(size.values())) < 1e-3
    taken = {}
    for r in got:
        s = r.sources[0]
        assert r.target == goal[s][0] and r.source_size == size[s] and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert taken == {s: q for s, (_, q) in goal.items()}
    partly = [r for r in got if r.taken % max(1, r.size)]
    assert len(partly) <= len(size)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(7), F.array("source")).collect()), key=repr)
    assert mixing.mix(empty, F.array("source")).count() == 0
    again = mixing.repeated(docs)
    assert again.columns == docs.columns and mixing.repeated(empty).count() == 0
    n = {}
    for r in again.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    for r in got:
        if r.doc_id not in (9, None) and r.size:
            assert n.get(r.doc_id, 0) == int(r.taken / r.size + 0.5)


def test_flow_of_overlapping_sources():
    flow = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 4}, {"a": 10, "b": 20})
    by = {s: sum(f.get(s, 0) for f in flow.values()) for s in "ab"}
    assert by == {"a": 10, "b": 20}
    assert sum(flow[("a", "b")].values()) <= 20 and sum(flow[("b",)].values()) <= 8
    # single copies suffice where they can: 24 words of single copies, so 6 repeated
    assert sum(max(0, sum(f.values()) - n) for (p, f), n in zip(flow.items(), (10, 10, 4))) == 6


def test_packing_round_trip(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs).collect()
    want = sorted(((r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in rows() for ids in [hf.encode(r[1] or "", add_special_tokens=False).ids + [1]]), key=repr)
    encoded = {r[0]: hf.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows()}
    for p in got:
        ids = encoded[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(encoded[p.doc_id]) and p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    covered = {}
    for p in got:
        covered.setdefault(p.doc_id, []).extend(range(p.start, p.start + p.length))
    repeat = {i: sum(r[0] == i for r in rows()) for i in encoded}
    for i, ids in encoded.items():
        assert sorted(covered[i]) == sorted(list(range(len(ids))) * repeat[i])
    assert len(want) == len(rows())
    seqs = {}
    for p in got:
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert packing.pack(empty).count() == 0


def test_walk_visits_all_from_low_degrees():
    nodes = [(1, [2, 3]), (2, [1]), (3, [1, 4]), (4, [3]), (5, [])]
    assert list(packing.walk(nodes)) == [5, 2, 1, 3, 4]


def test_quality_cases(docs, labels, empty, spark):
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert quality.quality(empty, labels).count() == 0
    none = quality.quality(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {1.0}
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_neighbour_votes_are_exact():
    rng = np.random.default_rng(3)
    known = rng.normal(size=(400, 8)).astype(np.float32)
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    y, z = rng.integers(0, 2, 400).astype(np.float32), known[:50] + 0.1
    z = (z / np.linalg.norm(z, axis=1, keepdims=True)).astype(np.float32)
    for got, v in zip(quality._votes(z, known, y), z):
        like = known @ v
        top = np.argsort(-like)[: quality.NEIGHBOURS]
        w = np.maximum(like[top], 1e-6) ** 8
        assert abs(got - (w * y[top]).sum() / w.sum()) < 1e-4


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r for r in labels.collect()}
    for got, label, least in ((quality.quality(docs, labels), "quality", 0.95), (toxicity.toxicity(docs, labels), "toxic", 0.9)):
        scored = [(r.predicted, truth[r.doc_id][label]) for r in got.collect() if r.held_out and r.doc_id in truth]
        assert sum(p == y for p, y in scored) / len(scored) >= least


def test_toxicity_cases(docs, labels, empty):
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_grammar_reads_clauses():
    g = toxicity.Grammar({"idiot": 5.0, "scum$": 3.0})
    (c,) = g.clauses("you are an idiot.")
    assert c["plain"] == 5 and c["aimed"] == 5
    (c,) = g.clauses("he is not an idiot.")
    assert c["negated"] == 5 and c["plain"] == 0
    (c,) = g.clauses("they said that idiots lie.")
    assert c["reported"] == 5
    (c,) = g.clauses('a word, "scum", in quotes')
    assert c["reported"] == 3
    assert list(g.clauses("scummy water")) == []
    (c,) = g.clauses("i will hurt you")
    assert c["threat"] == 1
    assert toxicity.CASCADE[toxicity.START, "I"] == (toxicity.START, "I")


def test_packing_keeps_links_at_any_number_of_partitions(spark):
    rng = random.Random(12)
    lists = [["v%d" % rng.randrange(3000) for _ in range(60)] for _ in range(40)]
    pairs = []
    for i in range(400):  # groups of ten that share most words
        w = list(lists[i % 40])
        for _ in range(i // 40):
            w[rng.randrange(60)] = "x%d" % rng.randrange(10**6)
        pairs.append((i, " ".join(w)))
    rows = packing.tokenised(spark.createDataFrame(pairs, "doc_id long, text string").repartition(3))
    ids = {r.row: r.doc_id for r in rows.select("row", "doc_id").collect()}
    before, orders, kept = spark.conf.get("spark.sql.shuffle.partitions"), [], []
    try:
        for n in (1, 6, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            links = [(r.row, x.other) for r in packing.neighbours(rows.select("row", "sig"), 4).collect() for x in r.near]
            where = {r.row: r for r in packing.places(rows).collect()}
            assert sorted(where) == sorted(ids)
            orders.append(sorted((r.stream, r.at, ids[r.row]) for r in where.values()))
            # A path goes on to a neighbour wherever one is left.
            seq = [row for _, _, row in sorted((r.stream, r.at, r.row) for r in where.values())]
            near = set(links)
            kept.append(sum((a, b) in near for a, b in zip(seq, seq[1:])))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(links) > 400 and orders[0] == orders[1] == orders[2] and min(kept) > 200


def test_packing_cuts_only_links_of_oversized_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 4)
    near = spark.createDataFrame([(0, [(8, 1), (1, 2)]), (2, [(8, 3)]), (4, [(7, 3), (1, 5)])], "row long, near array<struct<like:int,other:long>>")
    roots = {r.row: r.root for r in packing.groups(near, {0: 6}).collect()}
    assert roots == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 5: 2}  # the link of 0 and 2 comes first of likeness 1, but would make five


def test_terms_far_from_an_entity_count_and_copies_do_not(spark):
    filler = "\n".join("line %d of it" % i for i in range(30))
    rows = [(i, f"Name: Zorblax\n{filler}\nunique{i}\nPhone: +1 (017) 555-7713") for i in range(3)]
    rows += [(10 + i, f"Name: other{i}\n{filler}\nplain text") for i in range(200)]
    shares = []
    for copies in (0, 400):
        docs = spark.createDataFrame(rows + [(1000 + k, rows[1][1]) for k in range(copies)], "doc_id long, text string")
        base = pii.found(docs).cache()
        found, _ = pii.disclosing(docs, base)
        shares.append({r.term: r.share for r in found.collect()})
        base.unpersist()
    assert shares[0] == shares[1] and set(shares[0]) == {pii.term_hash("zorblax"), pii.term_hash("phone")}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert not any("Zorblax" in t for t in clean.values()) and clean[10] == rows[3][1]


def test_near_copies_go_by_row_not_by_doc_id(spark):
    core = ["c%d" % i for i in range(120)]

    def near(k):
        w = list(core)
        w[-1] = "v%d" % k  # one shingle of many
        return " ".join(w)

    own = ["own text %d of nothing else here at all" % k for k in range(4)]
    rows = [(1, near(0)), (5, near(1)), (5, own[0]), (5, own[1]), (7, near(2)), (7, near(2)), (8, own[2]), (8, own[2])]
    rows += [(None, near(3)), (None, own[3]), (None, own[3]), (9, ""), (9, ""), (9, None), (None, ""), (1, near(4))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, text string, h string")
    got = jaccard.without_near_copies(docs)
    assert got.columns == docs.columns
    # brute force: of every component the first row by (null last, doc_id); rows without words are alone
    want = [(5, own[0]), (5, own[1]), (8, own[2]), (None, own[3]), (9, ""), (9, ""), (9, None), (None, "")]
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    group = [r for r in kept if r[1] in (near(0), near(4))]
    assert len(group) == 1 and group[0][0] == 1
    assert sorted([r for r in kept if r not in group], key=repr) == sorted(want, key=repr)
    assert all(r.h == "x" for r in got.collect())


def plain_fingerprint(text):
    """The documented sums, paragraph by paragraph and window by window, in whole numbers."""
    exact, near = [0] * fingerprint.EXACT, [0] * fingerprint.NEAR
    for p in text.encode().split(b"\n"):
        if not p.strip():
            continue
        wide = hashlib.shake_128(p).digest(4 * fingerprint.EXACT)
        exact = [(x + int.from_bytes(wide[4 * i : 4 * i + 4], "little")) % 2**32 for i, x in enumerate(exact)]
        p = p + b"\0" * max(0, fingerprint.WINDOW - len(p))
        for k in range(len(p) - fingerprint.WINDOW + 1):
            h = int.from_bytes(p[k : k + 8], "little") * 0x9E3779B97F4A7C15 % 2**64
            h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2**64
            cell = h >> 56
            near[cell % fingerprint.NEAR] += 1 if cell < fingerprint.NEAR else -1
    return exact, near


def test_fingerprints_against_sums_of_whole_numbers(docs):
    def text_of(e, n):
        return b"".join((x % 2**32).to_bytes(4, "little") for x in [*e, *n]).hex()

    def like(a, b):
        if a == b:
            return 1.0
        dot, x, y = (sum(u * v for u, v in zip(p, q)) for p, q in ((a[1], b[1]), (a[1], a[1]), (b[1], b[1])))
        return min(1.0, max(0.0, dot / (x * y) ** 0.5)) if x and y else 0.0

    short = [r for r in rows() if len(r[1] or "") < 5000 and r[0] != 9]
    short = sorted(short, key=lambda r: r[0] if r[0] is not None else -(1 << 63), reverse=True)
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs.sparkSession.createDataFrame(short, SCHEMA)).collect()}
    for r, nxt in zip(short, short[1:] + short[:1]):
        t, u = r[1] or "", nxt[1] or ""
        k = len(t) // 3
        e = t[: len(t) - k] + u[:k]
        f, ef, nf = plain_fingerprint(t), plain_fingerprint(e), plain_fingerprint(u)
        g = got[r[0]]
        assert g.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert g.fingerprint == text_of(*f) and g.edited_fingerprint == text_of(*ef)
        assert abs(g.near_edited - like(f, ef)) < 1e-9 and abs(g.near_next - like(f, nf)) < 1e-9


def test_likeness_of_long_repetitive_texts():
    def near(a, b):
        return fingerprint.likeness(fingerprint.fingerprint(a), fingerprint.fingerprint(b))

    assert near("x" * 65543, "x" * 65542) > 0.999 and near("x" * 40000, "x" * 30000) > 0.999
    assert near("x" * 300_000 + "y" * 100_000, "x" * 300_000) > 0.9
    assert near("ab " * 50_000, "qz " * 50_000) < 0.5


def test_quality_scores_against_dense_vectors(spark):
    rng = random.Random(31)
    vocab = ["word%d" % i for i in range(60)] + ["Cap%d" % i for i in range(20)] + ["LOUD!", "12%", "x", "éa", "buy|buy"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 40))) for _ in range(70)]
    texts += ["again again again again word1", "", None, texts[0], "word1 word1", "unseen other things"]
    labels = [(i, i % 3 == 0) for i in range(40)] + [(5, True), (7, None), (900, True)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: r.score for r in quality.quality(docs, spark.createDataFrame([(i, None if y is None else int(y)) for i, y in labels], "doc_id long, quality int")).collect()}

    def bag(t):
        words, out = re.findall(r"[^\x20\x09-\x0D]+", t or ""), {}
        low = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words]
        for k, w in enumerate(words):
            up, lo = sum("A" <= c <= "Z" for c in w), sum("a" <= c <= "z" for c in w)
            case = 0 if up + lo == 0 else 1 if up == 0 else 2 if "A" <= w[0] <= "Z" and up == 1 else 3 if lo == 0 else 4
            last, n = w.encode()[-1:], len(w.encode())
            kind = 10 if last.isdigit() else b".,!%&$*#|".find(last) + 1 or (0 if last.isalpha() or last[0] > 127 else 11)
            same = [k >= j and low[k] == low[k - j] for j in (1, 2)]
            again = 2 if all(same) else int(same[0])
            for f in (("form", again, case, kind, sum(n > e for e in (1, 2, 4, 7, 11, 16, 25))), ("term", low[k])):
                out[f] = out.get(f, 0) + 1
        return out

    mean = {}
    for i, y in labels:
        if y is not None and i < len(texts) and zlib.crc32(str(i).encode()) % 5:
            mean.setdefault(i, []).append(float(y))
    known = sorted(mean)
    bags = [bag(texts[i]) for i in known]
    names = sorted(set(itertools.chain(*bags)), key=repr)
    idf = {f: np.log((1 + len(known)) / (1 + sum(f in b for b in bags))) + 0.1 for f in names}

    def vector(b):
        v = np.zeros(len(names))
        for kind in ("form", "term"):
            # features that no labelled row has count in the length and nowhere else
            part = {f: (1 + np.log(c)) * idf.get(f, np.log(1 + len(known)) + 0.1) for f, c in b.items() if f[0] == kind}
            size = np.sqrt(sum(x * x for x in part.values()))
            for f, x in part.items():
                if f in idf:
                    v[names.index(f)] = x / size
        return v

    x = np.array([vector(b) for b in bags])
    basis = np.linalg.svd(x, full_matrices=False)[2][: quality.RANK]
    z = x @ basis.T
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = np.array([np.mean(mean[i]) for i in known])
    for i, t in enumerate(texts):
        q = vector(bag(t)) @ basis.T
        if np.linalg.norm(q) < 1e-9:
            assert got[i] == pytest.approx(y.mean(), abs=1e-6)
            continue
        like = z @ (q / np.linalg.norm(q))
        top = np.argsort(-like, kind="stable")[: quality.NEIGHBOURS]
        if len(like) > len(top) and np.sort(-like)[len(top)] - np.sort(-like)[len(top) - 1] < 1e-5:
            continue  # a tie at the edge
        w = np.maximum(like[top], 1e-6) ** 8
        assert got[i] == pytest.approx((w * y[top]).sum() / w.sum(), abs=2e-3)


def test_tied_votes_go_to_the_first():
    known = np.ones((40, 4), np.float32) / 2
    y = np.arange(40, dtype=np.float32)
    for n in (1, 3, 128):
        assert np.allclose(quality._votes(known[:1].repeat(n, 0), known, y), np.mean(y[: quality.NEIGHBOURS]))


def test_grammar_against_rules_read_word_by_word():
    rng = random.Random(77)
    grammar = toxicity.Grammar({"idiot": 5.0, "scum$": 3.0})
    vocab = ["idiot", "idiots", "scum", "scums", "not", "said", "you", "kill", ".", ";", '"', "table", "the", "of"]
    for _ in range(400):
        words = [rng.choice(vocab) for _ in range(rng.randrange(25))]
        want, quoted, clause = [], False, []
        for k, w in enumerate([*words, "."]):
            if w not in (".", ";"):
                clause.append((k, w))
                continue
            plain = negated = reported = hits = 0
            heard = False
            for n, (at, x) in enumerate(clause):
                weight = 5.0 if x.startswith("idiot") else 3.0 if x == "scum" else 0.0
                if weight:
                    hits += 1
                    # one of the three tokens before, in the clause, negates
                    if any(y == "not" for _, y in clause[max(0, n - toxicity.SCOPE) : n]):
                        negated += weight
                    elif heard or quoted:
                        reported += weight
                    else:
                        plain += weight
                heard = heard or x == "said"
                quoted = quoted != (x == '"')
            threat = any(x == "kill" for _, x in clause) and any(x == "you" for _, x in clause)
            if hits or threat:
                want.append((hits, plain, negated, reported, plain if any(x == "you" for _, x in clause) else 0.0, float(threat)))
            clause = []
        got = [(c["hits"], c["plain"], c["negated"], c["reported"], c["aimed"], c["threat"]) for c in grammar.clauses(" ".join(words))]
        assert got == want, words


def test_toxicity_of_ties_clashing_columns_and_null_labels(spark):
    texts = ["you idiot %d" % i for i in range(30)] + ["nice day %d" % i for i in range(30)] + ["", None, "you idiot 1"]
    docs = spark.createDataFrame([(i, t, "x", 1.0, 7) for i, t in enumerate(texts)] + [(None, "you idiot 1", "x", 1.0, 7)], "doc_id long, text string, lang string, score double, toxic int")
    labels = spark.createDataFrame([(i, int(i < 30), "y") for i in range(60)] + [(61, None, "y"), (None, 1, "y"), (3, 1, "y")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(texts) + 1
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].score == by[62][0].score == by[None][0].score and by[60][0].score == by[61][0].score
    assert all(by[i][0].predicted == int(i < 30) for i in range(60)) and not by[None][0].held_out
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs.repartition(5), labels.repartition(3)).collect()}
    assert all(abs(again[i] - by[i][0].score) < 1e-9 for i in range(60))


def test_rows_that_share_a_doc_id_follow_one_another_by_hash(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    pairs = [(None, "text %d of none" % rng.randrange(60)) for _ in range(90)] + [(7, "seven %d" % i) for i in range(40)] + [(i, "own %d" % i) for i in range(20, 35)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    hashed = docs.withColumn("h", F.xxhash64("text")).collect()
    ordered = sorted(hashed, key=lambda r: (-(r.doc_id if r.doc_id is not None else -(1 << 63)), r.h, r.text))
    want = sorted(((r.doc_id, hashlib.sha256(fingerprint.edited(r.text, n.text).encode()).hexdigest()) for r, n in zip(ordered, ordered[1:] + ordered[:1])), key=repr)
    got = fingerprint.fingerprints(docs)
    assert sorted(((r.doc_id, r.edited_sha256) for r in got.collect()), key=repr) == want
    only = docs.filter("doc_id IS NULL")
    assert fingerprint.fingerprints(only).count() == 90


def shuffled(spark, run):
    """Bytes that ``run`` shuffles."""

    def now():
        time.sleep(0.5)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = now()
    run()
    return now() - before


def test_sanitise_shuffles_no_text_for_its_base_spans(spark):
    rng = random.Random(11)
    rows = [(i, "mail a%d@x.org of %s" % (i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz" * 8 + " ", k=4000)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    out, key = [], "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, -1)
    try:
        assert shuffled(spark, lambda: out.extend(pii.sanitise(docs).collect())) < sum(len(t) for _, t in rows) / 4
    finally:
        spark.conf.unset(key)
    assert sorted(out) == [(i, t.replace("a%d@x.org" % i, "[EMAIL]")) for i, t in rows]


def test_sanitise_with_terms_keeps_every_row(spark):
    rows = [(i % 2 or None, f"zorblax {i} mail z@q.org and y{i}@q.org") for i in range(5)] * 2
    rows += [(10 + i, f"plain text {i} x{i}@q.org") for i in range(60)] + [(80, "zorblax again"), (81, None), (82, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in pii.sanitise(docs).collect()), key=repr)
    assert sorted((d for d, _ in got), key=repr) == sorted((d for d, _ in rows), key=repr)
    assert not any(t and ("zorblax" in t or "@" in t) for _, t in got)
    assert {t for d, t in got if d in (81, 82)} == {None, ""} and sum(t == "plain text 7 [EMAIL]" for _, t in got) == 1


def test_frequencies_shuffle_no_row_a_term_of_a_copied_text(spark):
    rng = random.Random(12)
    words = ["w%d" % i for i in range(300)]
    rows = [(i, " ".join(rng.sample(words, 100))) for i in range(600)]
    wanted = spark.createDataFrame([(pii.term_hash(w),) for w in words], "term long").localCheckpoint()
    want = {pii.term_hash(w): sum(w in t.split() for _, t in rows) for w in words}
    sizes = []
    # Copies of other ids, of the same id and without one.
    for more in ([], [(1000 + i, t) for i, t in rows], [*rows[:5], *((None, t) for _, t in rows[3:9]), (None, rows[4][1])]):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string").repartition(4).localCheckpoint()
        base = pii.found(docs).localCheckpoint()
        got = []
        sizes.append(shuffled(spark, lambda: got.extend(pii.frequencies(docs, base, wanted).collect())))
        assert {r.term: r.df for r in got} == want
    assert sizes[1] < 2 * sizes[0] + 100_000
