"""Negation, uncertainty and history of terms: trigger rules (NEG), context cues (MOD), dependencies (DEP)."""

from __future__ import annotations

import itertools
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cleaned_trigger
from ..sources.storage import stored
from .tokens import gathered, texts_of

RANGE = 40
SCOPE_TAGS = ("WDT", "PRP", "VBZ")
SCOPE_WORDS = ("but", "however", "therefore", "otherwise", "except", ";", ":")


_INTS = lambda x: np.asarray(x, np.int32).tobytes()
_FROM = lambda x: np.frombuffer(x, np.int32)
_HITS = "doc_id long, sent_id int, s_start int, s_end int, starts binary, ends binary, hits binary, stops binary"


def _scan(sents: DataFrame, entries: list[list[str]], clean: Callable[[str], str] | None = None, stops: tuple[str, ...] = (), tags: tuple[str, ...] = ()) -> DataFrame:
    """Sentences in which an entry's words follow one another, each once, without its words (NEG1).

    ``starts`` and ``ends`` are its tokens' places, without those that ``clean`` makes
    empty; ``hits`` are first token, number of tokens and number of the entry, all that
    there are; ``stops`` are tokens that are one of ``stops`` in lower case or have one
    of ``tags``. All as whole numbers of four bytes, so that little is shuffled. Words
    are compared as numbers, each distinct one of a part looked at once.
    """
    number: dict[str, int] = {w: k for k, w in enumerate(sorted({w for e in entries for w in e or () if w is not None}))}
    by_first: dict[int, list[tuple[int, list[int], int]]] = {}
    for k, e in enumerate(entries):
        if e and None not in e:
            codes = [number[w] for w in e]
            by_first.setdefault(codes[0], []).append((len(codes), codes, k))
    shared = sents.sparkSession.sparkContext.broadcast((number, by_first))
    tagged = bool(tags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, by_first = shared.value
        heads = np.zeros(len(number) + 2, bool)
        heads[list(by_first)] = True
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                if len(one := part(b.slice(lo, 2048), number, by_first, heads)[0]):
                    yield pa.RecordBatch.from_arrays(one, names=[x.split()[0] for x in _HITS.split(", ")])

    def part(b: pa.RecordBatch, number: dict, by_first: dict, heads: np.ndarray) -> tuple[list]:
        lists = b.column(4)
        flat, off = lists.flatten(), lists.offsets.to_numpy()
        off = (off - off[0]).astype(np.int64)
        first, last = flat.field("start").to_numpy(zero_copy_only=False), flat.field("end").to_numpy(zero_copy_only=False)
        words = flat.field("text").fill_null("").dictionary_encode()
        names, at = words.dictionary.to_pylist(), words.indices.to_numpy()
        other, empty = len(number), len(number) + 1
        made = [clean(w) if clean else w for w in names]
        code = np.array([empty if clean and w == "" else number.get(w, other) for w in made], np.int64)[at] if names else np.zeros(0, np.int64)
        stop = np.array([w.lower() in stops for w in names], bool)[at] if names else np.zeros(0, bool)
        if tagged:
            stop = stop | np.array([t in tags for t in flat.field("tag").to_pylist()], bool)
        kept = code != empty
        before = np.concatenate([[0], np.cumsum(kept)])
        ends = before[off]  # where each sentence's kept tokens end
        first, last, code, stop = first[kept], last[kept], code[kept], stop[kept]
        row = np.repeat(np.arange(len(off) - 1), np.diff(ends))
        found: dict[int, list[int]] = {}
        for i in np.flatnonzero(heads[code]).tolist():
            r = int(row[i])
            for n, codes, k in by_first[int(code[i])]:
                if i + n <= ends[r + 1] and (n == 1 or code[i : i + n].tolist() == codes):
                    found.setdefault(r, []).extend((i - int(ends[r]), n, k))
        if not found:
            return ([],)
        rows = pa.array(list(found))
        cut = [slice(int(ends[r]), int(ends[r + 1])) for r in found]
        out = [b.column(k).take(rows) for k in range(4)]
        out += [pa.array([_INTS(x) for x in c], pa.binary()) for c in ([first[x] for x in cut], [last[x] for x in cut], found.values(), [np.flatnonzero(stop[x]) for x in cut])]
        return (out,)

    return sents.select("doc_id", "sent_id", F.col("start").alias("s_start"), F.col("end").alias("s_end"), "tokens").mapInArrow(run, _HITS)


def _entries(table: DataFrame, *columns: str) -> list:
    """The rows of a list of rules; every worker holds it."""
    return table.select("words", *columns).collect()


def triggers(sents: DataFrame, rules: DataFrame) -> DataFrame:
    """NEG2: doc_id, sent_id, start, end, tag, and the places tok_id and n of every trigger (``rules``: words, tag)."""
    given = _entries(rules, "tag")
    tag = [r.tag for r in given]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for d, s, first, last, hits in texts_of(b):
                first, last = _FROM(first), _FROM(last)
                for p, n, k in _FROM(hits).reshape(-1, 3).tolist():
                    yield d, s, p, n, int(first[p]), int(last[p + n - 1]), tag[k]

    kinds = pa.schema([("doc_id", pa.int64()), *[(c, pa.int32()) for c in ("sent_id", "tok_id", "n", "start", "end")], ("tag", pa.string())])
    found = _scan(sents, [r.words for r in given], cleaned_trigger).select("doc_id", "sent_id", "starts", "ends", "hits")
    return found.mapInArrow(lambda batches: gathered(rows(batches), kinds), "doc_id long, sent_id int, tok_id int, n int, start int, end int, tag string")


def located(places: DataFrame, terms: DataFrame, width: int = 1024) -> DataFrame:
    """doc_id, sent_id, t_start, t_end of terms by the sentences (s_start, s_end) they lie in.

    Joined by buckets of positions, so that a long document is no single key.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    place = places.select("doc_id", "sent_id", "s_start", "s_end", F.explode(F.sequence(bucket("s_start"), bucket("s_end"))).alias("_b"))
    t = terms.select("doc_id", F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    return t.withColumn("_b", bucket("t_start")).join(place, ["doc_id", "_b"]).filter("t_start >= s_start AND t_end <= s_end").select("doc_id", "sent_id", "t_start", "t_end")


def _each_term(scan: DataFrame, terms: DataFrame, decide: Callable, schema: str) -> DataFrame:
    """``decide(starts, ends, hits, stops, terms)`` yields rows for every sentence of ``scan`` that holds terms, which meet it in one list."""
    key, scan = ["doc_id", "sent_id"], stored(scan, "sentences")  # read twice
    t = located(scan.select(*key, "s_start", "s_end"), terms).groupBy(*key).agg(F.collect_list(F.struct("t_start", "t_end")).alias("terms"))
    both = scan.select(*key, "starts", "ends", "hits", "stops").join(t.select(*key, F.col("terms.t_start").alias("a"), F.col("terms.t_end").alias("z")), key)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for d, s, starts, ends, hits, stops, a, z in texts_of(b):
                yield from ((d, s, *r) for r in decide(_FROM(starts), _FROM(ends), _FROM(hits).reshape(-1, 3), _FROM(stops), list(zip(a, z))))

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])
    return both.mapInArrow(lambda batches: gathered(rows(batches), fields), schema)


def negex(sents: DataFrame, terms: DataFrame, rules: DataFrame, token_range: int = RANGE, pseudo_negation: bool = False) -> DataFrame:
    """NEG3, NEG4: negated terms with the trigger that decides: doc_id, sent_id, start, end (of whole tokens), trigger_start, trigger_end.

    The last PREN trigger that ends within ``token_range`` tokens before the term's
    last token, else the first POST trigger that begins so soon after it (Q13).
    With ``pseudo_negation``, triggers that a PSEU trigger covers don't count.
    """
    given = [r for r in _entries(rules, "tag") if r.tag in ("PREN", "POST") or pseudo_negation and r.tag == "PSEU"]
    tag = [r.tag for r in given]

    def decide(starts: np.ndarray, ends: np.ndarray, hits: np.ndarray, _: np.ndarray, terms: list) -> Iterator[tuple]:
        found = [(p, p + n - 1, tag[k]) for p, n, k in hits.tolist()]
        # A trigger counts unless one of the pseudo triggers that begin no later than it reaches its end.
        pseudo = sorted({(g, h) for g, h, t in found if t == "PSEU"})
        reach = list(itertools.accumulate((int(ends[h]) for _, h in pseudo), max))
        begin = [int(starts[g]) for g, _ in pseudo]
        free = lambda g, h: not (k := bisect_right(begin, int(starts[g]))) or reach[k - 1] < int(ends[h])
        pre = sorted({(h, g) for g, h, t in found if t == "PREN" and free(g, h)})
        post: dict[int, int] = {}
        for g, h, t in found:
            if t == "POST" and free(g, h):
                post[g] = min(h, post.get(g, h))
        by_start, by_end = np.sort(starts), np.sort(ends)
        for a, z in terms:
            ts, te = int(np.searchsorted(by_start, a)), int(np.searchsorted(by_end, z))
            if te >= len(ends):
                continue
            place = int(starts[ts]) if ts < len(starts) else a, int(ends[te])
            k = bisect_right(pre, (te, len(ends)))
            if k and te - pre[k - 1][0] < token_range:
                h, g = pre[k - 1]
                yield *place, int(starts[g]), int(ends[h]), 0, -h, -g
            elif near := min(((post[g], g) for g in range(te, min(te + token_range, len(ends))) if g in post), default=None):
                h, g = near
                yield *place, int(starts[g]), int(ends[h]), 1, h, g

    one = _each_term(_scan(sents, [r.words for r in given], cleaned_trigger), terms, decide, "doc_id long, sent_id int, start int, end int, trigger_start int, trigger_end int, tier int, near int, g int")
    best = F.min(F.struct("tier", "near", "g", "trigger_start", "trigger_end")).alias("b")  # terms of the same tokens are one
    return one.groupBy("doc_id", "sent_id", "start", "end").agg(best).select("doc_id", "sent_id", "start", "end", "b.trigger_start", "b.trigger_end")


def cue_table() -> list[tuple[str, str, list[str]]]:
    """MOD3: (side, kind, words) of the context cues, made from a compact list; left cues also with a capital (A.4)."""
    left = {
        "historical": ["history", "historical", "histories", "status post", "S/P", "S - P", "S.P.", "SP", "s/p", "s - p", "s.p.", "sp"],
        "negated": ["no", "not", "never", "without", "absent", "negative", "unremarkable", "un-remarkable", "un - remarkable", "resolved", *(f"den{x}" for x in ("y", "ies", "ied", "ying")), "evaluate for", "fails to reveal", "free of", "rather than", "to exclude", "test for", "with no"]
        + [f"{a}{s}o" for a in "wr" for s in ("/", " / ", " - ")]
        + ["ro"]
        + [" ".join(x.split()) for r in ("rule", "rules", "ruled") for who in ("", "him", "her", "the patient") for x in (f"{r} {who} out" + (" for" if r == "ruled" else ""),)],
        "uncertain": ["possible", "possibly", "probable", "probably", "might", "likely", "am not sure", "not sure", "differential", "uncertain", "chance"],
    }
    right = {"historical": ["history"], "negated": ["none", "negative", "absent", "ruled out"], "uncertain": ["likely", "probable", "unlikely", "possible", "uncertain"]}
    out = {("left", k, tuple(v.split())) for k, vs in left.items() for p in vs for v in (p, p[0].upper() + p[1:])} | {("right", k, tuple(p.split())) for k, vs in right.items() for p in vs}
    return [(s, k, list(w)) for s, k, w in sorted(out)]


def modifications(sents: DataFrame, terms: DataFrame, cues: DataFrame, cue_scan: str = "reference", tags: bool = False) -> DataFrame:
    """MOD1, MOD2: doc_id, sent_id, start, end, kind, cue_start, cue_end: the nearest cue of each term, left before right.

    From a term outwards: at each distance the scan ends at a delimiter (a word of
    ``SCOPE_WORDS``, or with ``tags`` a token whose ``tag`` is in ``SCOPE_TAGS``),
    else takes the shortest cue that begins there. ``cue_scan="reference"`` asks for
    more words than the distance, so one-word cues must be adjacent (Q3);
    ``"full"`` doesn't. ``cues``: side, kind, words.
    """
    given = _entries(cues, "side", "kind")
    side, kind, most = [r.side for r in given], [r.kind for r in given], max((len(r.words) for r in given), default=1)
    strict = cue_scan == "reference"

    def decide(starts: np.ndarray, ends: np.ndarray, hits: np.ndarray, stops: np.ndarray, terms: list) -> Iterator[tuple]:
        # Of cues with their near end at one token the shortest is taken, then the first kind; all lengths matter to the strict scan.
        left: dict[int, dict[int, str]] = {}
        right: dict[int, dict[int, str]] = {}
        for p, n, k in hits.tolist():
            at, by = (p + n - 1, left) if side[k] == "left" else (p, right)
            here = by.setdefault(at, {})
            here[n] = min(kind[k], here.get(n, kind[k]))
        lefts, rights, halts = sorted(left), sorted(right), sorted(stops.tolist())
        ordered = bool(np.all(starts[:-1] <= starts[1:]) and np.all(ends[:-1] <= ends[1:]))
        for a, z in terms:
            # Tokens before the term and after it; in order of place they are the first ones and the last ones.
            if not ordered:
                raise ValueError("tokens of a sentence must be in order of place")
            before, after = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, z))
            k = bisect_left(halts, before)
            halt = halts[k - 1] if k else -1
            best = None
            k = bisect_left(lefts, before) - 1
            while k >= 0 and lefts[k] > halt and (not strict or before - 1 - lefts[k] < most):
                off = before - 1 - lefts[k]
                if n := min((n for n in left[lefts[k]] if not strict or n > off), default=0):
                    best = left[lefts[k]][n], lefts[k] - n + 1, lefts[k]
                    break
                k -= 1
            if best is None:
                k = bisect_left(halts, after)
                halt = halts[k] if k < len(halts) else len(starts)
                k = bisect_left(rights, after)
                while k < len(rights) and rights[k] < halt and (not strict or rights[k] - after < most):
                    off = rights[k] - after
                    if n := min((n for n in right[rights[k]] if not strict or n > off), default=0):
                        best = right[rights[k]][n], rights[k], rights[k] + n - 1
                        break
                    k += 1
            if best:
                yield a, z, best[0], int(starts[best[1]]), int(ends[best[2]])

    scan = _scan(sents, [r.words for r in given], None, SCOPE_WORDS, SCOPE_TAGS if tags else ())
    return _each_term(scan, terms, decide, "doc_id long, sent_id int, start int, end int, kind string, cue_start int, cue_end int").distinct()


def selected_sentences(sents: DataFrame, terms: DataFrame, trig: DataFrame) -> DataFrame:
    """DEP3, DEP4: sentences that hold both a term and a trigger, the only ones that need a parse."""
    within = lambda x: (sents.doc_id == x.doc_id) & (x.start >= sents.start) & (x.end <= sents.end)
    return sents.join(terms, within(terms), "left_semi").join(trig, within(trig), "left_semi")


def parse_dependencies(sents: DataFrame, parser: Callable[[list[str]], list[tuple[int, str, str]]]) -> DataFrame:
    """DEP3: doc_id, sent_id, dep_id, start, end, text, head_id, deprel, upos by any parser of a sentence's words.

    ``parser`` returns (head, relation, universal tag) a word, heads from 1, 0 for the root.
    """

    kinds = pa.schema(list(zip("doc_id sent_id dep_id start end text head_id deprel upos".split(), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string()))))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for doc, sent, toks in texts_of(b):
                for k, (t, (head, rel, upos)) in enumerate(zip(toks, parser([t["text"] for t in toks]))):
                    yield doc, sent, k, t["start"], t["end"], t["text"], head - 1 if head else None, rel, upos

    return sents.select("doc_id", "sent_id", "tokens").mapInArrow(lambda batches: gathered(rows(batches), kinds), "doc_id long, sent_id int, dep_id long, start int, end int, text string, head_id long, deprel string, upos string")


class _Tree:
    """Questions to the dependency tree of one sentence (DEP2)."""

    def __init__(self, deps: list[dict]):
        self.deps = sorted(deps, key=lambda d: (d["start"], d["end"]))
        self.by_id = {d["dep_id"]: d for d in deps}
        self.below: dict[int | None, list[dict]] = {}
        for d in self.deps:
            self.below.setdefault(d["head_id"], []).append(d)
        self.starts = [d["start"] for d in self.deps]
        self.known: dict[int, tuple[list[dict], list[dict]]] = {}

    def head(self, d: dict) -> dict | None:
        return self.by_id.get(d["head_id"])

    def children(self, d: dict) -> list[dict]:
        return self.below.get(d["dep_id"], [])

    def marked(self, d: dict, word: str) -> bool:
        return any(c["deprel"] == "cc" and c["text"].lower() == word for c in self.children(d))

    def verb_and(self, d: dict) -> bool:
        return d["deprel"] == "conj" and d["upos"] == "VERB" and self.marked(d, "and")

    def listed(self, d: dict) -> list[dict]:
        """The members from here on of an or-list that ends at most four members on."""
        above = self.head(d)
        if d["deprel"] != "conj" or above is None:
            return []
        members = [c for c in self.children(above) if c["deprel"] == "conj"]
        here = next(k for k, c in enumerate(members) if c is d)
        return members[here:] if self.marked(members[-1], "or") and here >= len(members) - 4 else []

    def follows(self, c: dict) -> bool:
        """Nominal modifiers, and clauses of suggesting, are looked into."""
        return c["deprel"] == "nmod" or c["deprel"] == "acl" and c["text"].lower() in ("suggest", "indicate")

    def looked_at(self, top: dict) -> tuple[list[dict], list[dict]]:
        """The words that are looked at from here, and those from which the search goes on; no term changes them."""
        words, on = [top, *self.listed(top)], []
        for c in self.children(top):
            words.append(c)
            if self.follows(c):
                on.append(c)
            if self.verb_and(c):
                continue
            for g in self.children(c):
                if self.verb_and(g):
                    continue
                # The modifier test is on the child again, as in the first level (Q38).
                words.append(g)
                if g["deprel"] == "acl" and self.follows(g):
                    on.append(g)
        return words, on

    def reached(self, top: dict) -> Iterator[dict]:
        """All words looked at from here; a word from which the search goes on is entered once."""
        entered, left = {top["dep_id"]}, [top]
        while left:
            here = left.pop()
            if here["dep_id"] not in self.known:
                self.known[here["dep_id"]] = self.looked_at(here)
            words, on = self.known[here["dep_id"]]
            yield from words
            for x in on:
                if x["dep_id"] not in entered:
                    entered.add(x["dep_id"])
                    left.append(x)

    def governor(self, start: int, end: int) -> dict | None:
        lo = bisect_left(self.starts, start)
        own = [d for d in self.deps[lo : bisect_right(self.starts, end)] if d["end"] <= end]
        ids = {d["dep_id"] for d in own}
        top = next((d for d in own if d["head_id"] not in ids), None)
        while top is not None and (above := self.head(top)) is not None and top["upos"] not in ("VERB", "NOUN") and top["deprel"] != "conj":
            top = above
        return top


def within(d: dict, span: tuple[int, int]) -> bool:
    return span[0] <= d["start"] and d["end"] <= span[1]


def affirmed(terms: list[dict], trig: list[dict], deps: list[dict]) -> Iterator[tuple[dict, dict]]:
    """DEP1 for one sentence: each term with the first trigger that its tree affirms.

    Triggers are taken in order, each with the words its governor reaches and the
    terms that lie there, so no trigger meets a term that it doesn't reach.
    """
    tree = _Tree(deps)
    terms = sorted(terms, key=lambda x: (x["start"], x["end"]))
    of: dict[int, list[int]] = {}
    for i, t in enumerate(terms):
        lo = bisect_left(tree.starts, t["start"])
        for d in tree.deps[lo : bisect_right(tree.starts, t["end"])]:
            if within(d, (t["start"], t["end"])):
                of.setdefault(d["dep_id"], []).append(i)
    first: dict[int, dict] = {}
    for g in sorted(trig, key=lambda x: (x["start"], x["end"])):
        if len(first) == len(terms):
            break
        top = tree.governor(g["start"], g["end"])
        if top is None:
            continue
        for i in {i for d in tree.reached(top) for i in of.get(d["dep_id"], ())}:
            t = terms[i]
            crossing = g["start"] <= t["start"] < g["end"] or g["start"] < t["end"] <= g["end"] or t["start"] <= g["start"] and g["end"] <= t["end"]
            wrong_side = g["start"] < t["start"] and g["tag"] != "PREN" or g["start"] > t["end"] and g["tag"] != "POST"
            if not crossing and not wrong_side:
                first.setdefault(i, g)
    for i in sorted(first):
        yield terms[i], first[i]


def deepen(terms: DataFrame, trig: DataFrame, deps: DataFrame) -> DataFrame:
    """DEP1: affirmed negations (doc_id, sent_id, start, end, trigger_start, trigger_end).

    ``terms`` and ``trig`` (with tag) carry sent_id; sentences are gathered by key,
    each as large as a sentence, after a semi-join has dropped those without both.
    """
    key = ["doc_id", "sent_id"]
    gather = lambda df, name, *cols: df.groupBy(*key).agg(F.collect_list(F.struct(*cols)).alias(name))
    both = gather(terms, "terms", "start", "end").join(gather(trig, "trig", "start", "end", "tag"), key)
    wanted = deps.join(both.select(*key), key, "left_semi")
    rows = both.join(gather(wanted, "deps", "dep_id", "start", "end", "text", "head_id", "deprel", "upos"), key)

    kinds = pa.schema(list(zip("doc_id sent_id start end trigger_start trigger_end".split(), (pa.int64(), *[pa.int32()] * 5))))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for d, s, ts, gs, ds in texts_of(b):
                yield from ((d, s, t["start"], t["end"], g["start"], g["end"]) for t, g in affirmed(ts, gs, ds))

    return rows.select(*key, "terms", "trig", "deps").mapInArrow(lambda batches: gathered(found(batches), kinds), "doc_id long, sent_id int, start int, end int, trigger_start int, trigger_end int")


class Trie:
    """NEG5: a map from word sequences to values, and its streaming matcher."""

    def __init__(self) -> None:
        self.next: dict[str, Trie] = {}
        self.value: object = None
        self.full = False

    def _node(self, words: list[str], make: bool = False) -> Trie | None:
        node: Trie | None = self
        for w in words:
            node = node.next.setdefault(w, Trie()) if make else node.next.get(w)
            if node is None:
                return None
        return node

    def __setitem__(self, words: list[str], value: object) -> None:
        node = self._node(words, True)
        node.value, node.full = value, True

    def __getitem__(self, words: list[str]) -> object:
        node = self._node(words)
        if node is None or not node.full:
            raise KeyError(words)
        return node.value

    def __delitem__(self, words: list[str]) -> None:
        self[words]
        node = self._node(words)
        node.value, node.full = None, False

    def __iter__(self) -> Iterator[list[str]]:
        if self.full:
            yield []
        for w, node in self.next.items():
            yield from ([w, *rest] for rest in node)

    def __len__(self) -> int:
        return self.full + sum(map(len, self.next.values()))

    def matches(self, words: list[str]) -> Iterator[tuple[int, int, object]]:
        """(end, length, value) of every entry that ends at each word."""
        live: list[tuple[Trie, int]] = []
        for i, w in enumerate(words):
            live = [(node.next[w], n + 1) for node, n in itertools.chain([(self, 0)], live) if w in node.next]
            yield from ((i, n, node.value) for node, n in live if node.full)
