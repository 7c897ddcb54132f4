"""Tokens and sentences: generators from documents (doc_id, text) to spans.

Offsets are code points, from 0, half-open. Each generator makes one narrow pass
over the texts and shuffles nothing; whole sentences come out with their tokens in
an array, so that what works on a sentence needs no regrouping.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "start:int,end:int,text:string"
_TOKENS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
Spans = Iterator[tuple[int, int]]

_WORD = re.compile(r"[^ \t\n\r\f]+")
_LINE = re.compile(r"[^\n]*")
_DEID = re.compile(r"\[[*]{2}.*?[*]{2}\]|(?:['.]|[^\W_])+")
_SEGMENT_END = re.compile(r"\n\n+|^[^\S\n]*(?:_{3,}|-{3,}|={3,})[^\S\n]*$", re.M)
_EDGE = re.compile(r"""[!"'),.:;]?(?:[^\S\x1c-\x1f\x85\xa0]+["'(]?|\Z)""", re.A)


def plain_words(text: str) -> Spans:
    """Runs of anything but space, tab, newline, return and form feed."""
    return (m.span() for m in _WORD.finditer(text))


def unicode_words(text: str) -> Spans:
    """TOK5, TOK7: runs of non-space in Unicode's sense."""
    return (m.span() for m in re.finditer(r"\S+", text))


def model_words(text: str) -> Spans:
    """TOK6: words, and de-identification tags as one token."""
    return (m.span() for m in _DEID.finditer(text))


def edge_words(text: str) -> Spans:
    """TOK4: between white space, without one mark at either edge."""
    at = 0
    for m in _EDGE.finditer(text):
        if at < m.start():
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


#: A short list of measures; pass others as ``units``.
UNITS = frozenset("a c d f g h k l m s u v w x y db lb cc qd yd kg mg ng pg ug ph mi wk dl fl ml ul cm gm km mm nm pm um mo yo gr hr yr ms ft iu hz oz cm2 mm2 cm3 mm3 sec mcg psi mol lpm ppm min meq lbs wks gms mos hrs yrs khz mhz msec mmhg kcal mmol cmh2o units".split())

_BREAK = regex.compile(r"[\s\p{Z}\p{Cf}--[\v\f\x1c-\x1f\x85]]+", regex.V1)
_MARK = regex.compile(r"[[\p{P}\p{Sk}\p{Sm}]--[#$'’,\-.]]|(?<=\P{Z})-|-(?=\p{L})|(?<=\P{N}),(?=.)|(?<=\p{N}),(?=\P{N})", regex.V1 | regex.S)
_CLITIC = regex.compile(r"(?:'(?:[dmsDMS]|(?:re|ve|ll)|(?:RE|VE|LL))?|n't|N'T|[,’])\Z")
_MEASURE = regex.compile(r"-?[Xx.0-9]*[.0-9]++([A-Za-z]++)\.?")
_DIMENSION = regex.compile(r".*?[0-9]++(?:[Xx][.0-9]++)+")


def ptb_words(units: frozenset[str] = UNITS) -> Callable[[str], Spans]:
    """TOK1: treebank-like tokens: marks inside words, leading quotes, clitics, measures after numbers, dimensions."""

    def dimensions(w: str, a: int) -> Spans:
        if _DIMENSION.fullmatch(w):
            for part in re.finditer(r"[xX]|[^xX]+", w):
                yield a + part.start(), a + part.end()
        else:
            yield a, a + len(w)

    def piece(w: str, a: int) -> Spans:
        head = len(w) - len(w.lstrip("',’"))
        for k in range(head):
            yield a + k, a + k + 1
        w, a = w[head:], a + head
        tail: list[tuple[int, int]] = []
        while w and (m := _CLITIC.search(w)):
            tail.append((a + m.start(), a + m.end()))
            w = w[: m.start()]
        if w:
            m = _MEASURE.fullmatch(w)
            if m and m.group(1).lower() in units:
                if m.start(1):
                    yield from dimensions(w[: m.start(1)], a)
                yield a + m.start(1), a + len(w)
            else:
                yield from dimensions(w, a)
        yield from reversed(tail)

    def words(text: str) -> Spans:
        at = 0
        for gap in [*_BREAK.finditer(text), None]:
            end = gap.start() if gap else len(text)
            w, cut = text[at:end], 0
            for m in _MARK.finditer(w):
                if cut < m.start():
                    yield from piece(w[cut : m.start()], at + cut)
                yield at + m.start(), at + m.end()
                cut = m.end()
            if cut < len(w):
                yield from piece(w[cut:], at + cut)
            at = gap.end() if gap else at

    return words


def whole_text(text: str) -> Spans:
    """A text as one sentence, so that its tokens come in one row."""
    if text:
        yield 0, len(text)


def line_sentences(text: str) -> Spans:
    """SEN2: every line that holds something, without white space at its edges."""
    for m in _LINE.finditer(text):
        s = m.group()
        if s.strip():
            a = m.start() + len(s) - len(s.lstrip())
            yield a, a + len(s.strip())


def segments(text: str) -> Spans:
    """SEN3: parts between empty lines and ruled lines."""
    at = 0
    for m in _SEGMENT_END.finditer(text):
        if text[at : m.start()].strip():
            yield at, m.start()
        at = m.end()
    if text[at:].strip():
        yield at, len(text)


# Plain words, Unicode words and lines are cut in whole Arrow batches, byte by byte of their UTF-8 form.

_ASCII_GAP = np.zeros(256, bool)
_ASCII_GAP[[9, 10, 12, 13, 32]] = True
_JVM_SPACE = np.zeros(256, bool)
_JVM_SPACE[9:14] = _JVM_SPACE[32] = True
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_BATCH = 1 << 20
#: Rows that a loop over texts gathers before it gives them on: what a worker holds doesn't grow with a batch of texts.
_ROWS = 1 << 15


def texts_of(b: pa.RecordBatch, step: int = 64) -> Iterator[tuple]:
    """The rows of a batch as tuples; few of them are Python objects at a time."""
    for lo in range(0, b.num_rows, step):
        yield from zip(*(c.slice(lo, step).to_pylist() for c in b.columns))


def gathered(rows: Iterator[tuple], schema: pa.Schema, most: int = _ROWS) -> Iterator[pa.RecordBatch]:
    """``rows`` as batches of at most so many."""
    while part := list(itertools.islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows one after another, and where each begins and the last ends; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def _unicode_space(raw: np.ndarray) -> np.ndarray:
    """Bytes of white space in Unicode's sense."""
    out = _ASCII_SPACE[raw]
    if len(raw) and raw.max() > 0xC1:
        a, b = raw[:-1], raw[1:]
        at = np.flatnonzero((a == 0xC2) & ((b == 0x85) | (b == 0xA0)))
        out[at] = out[at + 1] = True
        a, b, c = raw[:-2], raw[1:-1], raw[2:]
        wide = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        wide |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        at = np.flatnonzero(wide)
        out[at] = out[at + 1] = out[at + 2] = True
    return out


def _runs(full: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of every run of ``full`` bytes; no run crosses an edge."""
    cut = np.zeros(len(full) + 1, bool)
    cut[edges] = True
    before, after = np.concatenate([[False], full[:-1]]), np.concatenate([full[1:], [False]])
    return np.flatnonzero(full & (~before | cut[:-1])), np.flatnonzero(full & (~after | cut[1:])) + 1


def _strings(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The byte ranges, in order and apart from one another, as strings."""
    step = np.zeros(len(raw) + 1, np.int8)
    step[first] += 1
    step[last] -= 1  # a range that begins where another ends
    offsets = np.zeros(len(first) + 1, np.int32)
    np.cumsum(last - first, out=offsets[1:])
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(raw[np.cumsum(step[:-1], dtype=np.int8).view(bool)] if len(raw) else raw))


def _points(raw: np.ndarray) -> np.ndarray:
    """Number of code points before each byte."""
    out = np.zeros(len(raw) + 1, np.int32)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


def _parts(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, bytes and row ends of parts of a batch of about ``_BATCH`` bytes."""
    column = b.column(1)
    ends = np.zeros(b.num_rows + 1, np.int64)
    np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), out=ends[1:])
    lo = 0
    while lo < b.num_rows:
        hi = min(max(int(np.searchsorted(ends, ends[lo] + _BATCH, "right")) - 1, lo + 1), b.num_rows)
        yield b.column(0).slice(lo, hi - lo), *_utf8(column.slice(lo, hi - lo))
        lo = hi


def _numbers(row: np.ndarray) -> np.ndarray:
    """Each element's number among those of its row, for rows in order."""
    return np.arange(len(row)) - np.searchsorted(row, row) if len(row) else row


def _word_batch(ids: pa.Array, raw: np.ndarray, ends: np.ndarray, unicode: bool) -> pa.RecordBatch:
    first, last = _runs(~(_unicode_space(raw) if unicode else _ASCII_GAP[raw]), ends)
    row, point = np.searchsorted(ends, first, "right") - 1, _points(raw)
    base = point[ends[row]]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(_numbers(row).astype(np.int32)), pa.array(point[first] - base), pa.array(point[last] - base), _strings(raw, first, last)], names=["doc_id", "tok_id", "start", "end", "text"])


def _space_batch(ids: pa.Array, raw: np.ndarray, ends: np.ndarray, unicode: bool) -> pa.RecordBatch:
    first, last = _runs(~(_unicode_space(raw) if unicode else _ASCII_GAP[raw]), ends)
    row = np.searchsorted(ends, first, "right") - 1
    after = (last == ends[row + 1]) | _JVM_SPACE[raw[np.minimum(last, len(raw) - 1)]] if len(row) else np.zeros(0, bool)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(_numbers(row).astype(np.int32)), pa.array(after)], names=["doc_id", "tok_id", "space"])


def _line_batch(ids: pa.Array, raw: np.ndarray, ends: np.ndarray, unicode: bool) -> pa.RecordBatch:
    space = _unicode_space(raw)
    # A line runs to its break, or to the text's end; it is kept without white space at its edges.
    begins, stops = _runs(~space, ends)
    line = np.concatenate([[0], np.cumsum(raw == 10)])[begins] if len(raw) else begins
    row = np.searchsorted(ends, begins, "right") - 1
    head = np.ones(len(begins), bool)
    head[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    tail = np.concatenate([head[1:], [True]]) if len(head) else head
    first, last, row = begins[head], stops[tail], row[head]
    point = _points(raw)
    base = point[ends[row]]
    if unicode:
        a, z = begins, stops
    else:
        inside = np.zeros(len(raw) + 1, np.int8)
        np.add.at(inside, first, 1)
        np.add.at(inside, last, -1)
        a, z = _runs(~_ASCII_GAP[raw] & (np.cumsum(inside[:-1]) > 0), np.unique(np.concatenate([ends, first, last])))
    of = np.searchsorted(first, a, "right") - 1
    shift = base[of]
    struct = pa.StructArray.from_arrays([pa.array(point[a] - shift), pa.array(point[z] - shift), _strings(raw, a, z)], ["start", "end", "text"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(first) + 1)).astype(np.int32)), struct)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(_numbers(row).astype(np.int32)), pa.array(point[first] - base), pa.array(point[last] - base), _strings(raw, first, last), lists], names=["doc_id", "sent_id", "start", "end", "text", "tokens"])


def _vectorised(docs: DataFrame, each: Callable, unicode: bool, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, raw, ends in _parts(b):
                yield each(ids, raw, ends, unicode)
        pa.default_memory_pool().release_unused()  # workers stay alive between stages

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def tokens(docs: DataFrame, words: Callable[[str], Spans] = plain_words) -> DataFrame:
    """doc_id, tok_id, start, end, text of every token."""
    schema = "doc_id long, tok_id int, start int, end int, text string"
    if words in (plain_words, unicode_words):
        return _vectorised(docs, _word_batch, words is unicode_words, schema)

    kinds = pa.schema([("doc_id", pa.int64()), ("tok_id", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered(((i, n, a, z, t[a:z]) for b in batches for i, t in texts_of(b) for n, (a, z) in enumerate(words(t or ""))), kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def sentences(docs: DataFrame, split: Callable[[str], Spans] = line_sentences, words: Callable[[str], Spans] = plain_words) -> DataFrame:
    """doc_id, sent_id, start, end, text and tokens (array of start, end, text) of every sentence."""
    schema = f"doc_id long, sent_id int, start int, end int, text string, tokens array<struct<{TOKEN}>>"
    if split is line_sentences and words in (plain_words, unicode_words):
        return _vectorised(docs, _line_batch, words is unicode_words, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, flat, off = ([], [], [], [], []), ([], [], []), [0]

        def done() -> pa.RecordBatch:
            struct = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, _TOKENS.value_type)], fields=list(_TOKENS.value_type))
            rows = [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()))]
            rows.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), struct))
            for c in (*out, *flat, off):
                c.clear()
            off.append(0)
            return pa.RecordBatch.from_arrays(rows, names=["doc_id", "sent_id", "start", "end", "text", "tokens"])

        for b in batches:
            for i, t in texts_of(b):
                for n, (a, z) in enumerate(split(t or "")):
                    s = t[a:z]
                    for c, v in zip(out, (i, n, a, z, s)):
                        c.append(v)
                    for x, y in words(s):
                        flat[0].append(a + x)
                        flat[1].append(a + y)
                        flat[2].append(s[x:y])
                    off.append(len(flat[0]))
                    if len(flat[0]) + len(off) > _ROWS:
                        yield done()
        if len(off) > 1:
            yield done()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def spaces(docs: DataFrame, words: Callable[[str], Spans] = plain_words) -> DataFrame:
    """TOK3: doc_id, tok_id and whether white space or nothing follows the token, told where the text is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered(((i, n, t[z : z + 1] in " \t\n\v\f\r") for b in batches for i, t in texts_of(b) for n, (_, z) in enumerate(words(t or ""))), pa.schema([("doc_id", pa.int64()), ("tok_id", pa.int32()), ("space", pa.bool_())]))

    schema = "doc_id long, tok_id int, space boolean"
    if words in (plain_words, unicode_words):
        return _vectorised(docs, _space_batch, words is unicode_words, schema)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def run_counts(docs: DataFrame, n: int, clean: Callable[[str], str]) -> DataFrame:
    """Gram, n: how often each run of ``n`` cleaned words stands in the lines of the texts.

    Words are cleaned once for all places of a part of a batch, and runs are counted
    there before they are shuffled.
    """

    def count(ids: pa.Array, raw: np.ndarray, ends: np.ndarray, unicode: bool) -> pa.RecordBatch:
        lists = _line_batch(ids, raw, ends, unicode).column(5)
        words = lists.flatten().field(2).dictionary_encode()
        known = pa.array([clean(w) for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
        code = known.indices.to_numpy()[words.indices.to_numpy()].astype(np.int64) if len(words) else np.zeros(0, np.int64)
        left = np.repeat(lists.offsets.to_numpy()[1:], np.diff(lists.offsets.to_numpy())) - np.arange(len(code))
        at = np.flatnonzero(left >= n)
        runs, first = np.zeros(len(at), np.int64), np.arange(len(at))
        for k in range(n):  # numbered anew after each word, so that numbers stay small
            _, first, runs = np.unique(runs * max(len(known.dictionary), 1) + code[at + k], return_index=True, return_inverse=True)
        grams = [known.dictionary.take(pa.array(code[at[first] + k])) for k in range(n)]
        return pa.RecordBatch.from_arrays([pc.binary_join_element_wise(*grams, " "), pa.array(np.bincount(runs, minlength=len(first)).astype(np.int64))], names=["gram", "n"])

    return _vectorised(docs, count, False, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def sentence_tokens(sents: DataFrame) -> DataFrame:
    """The tokens of sentences as rows: doc_id, sent_id, tok_id (in the sentence), start, end, text."""
    return sents.select("doc_id", "sent_id", F.posexplode("tokens").alias("tok_id", "t")).select("doc_id", "sent_id", "tok_id", "t.start", "t.end", "t.text")


def ngrams(sents: DataFrame, most: int, form: Callable[[Column], Column] = lambda c: c, first: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, sent_id, tok_id, n, start, end, gram: every run of up to ``most`` tokens, its words joined by a space.

    ``form`` maps words; runs whose first word fails ``first`` aren't made. A
    sentence's array is cut in place, so there is no join of tokens with tokens.
    """
    size = F.size("tokens")
    at = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    one = sents.select("doc_id", "sent_id", "tokens", F.transform("tokens", lambda t: form(t["text"])).alias("w"))
    if first is not None:
        at = F.filter(at, lambda i: first(F.get("w", i)))

    def run(i: Column, n: Column) -> Column:
        words = F.array_join(F.slice(F.col("w"), i + 1, n), " ")
        return F.struct(i.alias("tok_id"), n.alias("n"), F.get("tokens", i)["start"].alias("start"), F.get("tokens", i + n - 1)["end"].alias("end"), words.alias("gram"))

    # Runs are cut inside the row, so that exploded rows hold a run and not its whole sentence.
    runs = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), size - i)), lambda n: run(i, n))))
    return one.select("doc_id", "sent_id", F.explode(runs).alias("r")).select("doc_id", "sent_id", "r.*")


def training_windows(seqs: DataFrame, column: str, length: int) -> DataFrame:
    """SEN1e: windows of ``length`` elements at every step of one; a shorter sequence once."""
    n = F.size(column)
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), n - length + 1))
    return seqs.select("*", F.posexplode(at).alias("window_id", "_at")).withColumn("window", F.slice(column, F.col("_at"), F.lit(length))).drop("_at")


def network_word(text: Column) -> Column:
    """SEN1a: a word as the network's vocabulary has it."""
    return F.when(text.startswith("[**"), "IDENTIFIER").otherwise(F.regexp_replace(F.regexp_replace(F.lower(text), r"[.']", ""), r"\p{Nd}", "#"))


def sentence_features(toks: DataFrame, text: Callable[[], Column] | None = None, word_length: int = 32) -> DataFrame:
    """SEN1a: for ``tokens(docs, model_words)`` joined with text: the word as the network's vocabulary has it."""
    chars = F.slice(F.filter(F.split("text", ""), lambda c: c != ""), 1, word_length)
    return toks.withColumn("word", network_word(F.col("text"))).withColumn("chars", chars)


def model_sentences(docs: DataFrame, score: Callable[[list[str]], list[float]], chunk: int = 256) -> DataFrame:
    """SEN1: sentences by a model that scores each token of a segment as a beginning (logits); doc_id, sent_id, start, end.

    A sentence runs to the token before the next beginning and takes one closing
    mark that follows it, except at a segment's end (Q34). ``score`` is any
    function of a segment's words, such as a network's forward pass.
    """

    def rows(i: int, t: str) -> Iterator[tuple]:
        n = 0
        for a, z in segments(t):
            toks = [(a + x, a + y) for x, y in model_words(t[a:z])]
            begins: list[bool] = []
            for k in range(0, len(toks), chunk):
                begins += [p > 0 for p in score([t[x:y] for x, y in toks[k : k + chunk]])]
            heads = [k for k, x in enumerate(begins) if x or k == 0]
            for h, nxt in zip(heads, [*heads[1:], len(toks)]):
                end = toks[nxt - 1][1]
                if nxt < len(toks) and end < len(t) and t[end] in ".:!?,;\"'])":
                    end += 1
                yield i, n, toks[h][0], end
                n += 1

    kinds = pa.schema([("doc_id", pa.int64()), ("sent_id", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered((r for b in batches for i, t in texts_of(b) for r in rows(i, t or "")), kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sent_id int, start int, end int")
