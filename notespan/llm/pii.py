"""Personal data, and terms that give it away by what the corpus says of them.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers,
found by pattern in whole texts. The values found are the protected entities. A
term reveals an entity as far as seeing it tells of the entity: the pointwise
mutual information log2(co * N / (df * n)) over the entity's own information
log2(N / n), where n is the number of texts with the entity, co of those that hold
the term anywhere outside base spans, df of all texts with the term and N of all. A
term with at least ``SUPPORT`` texts and a share of ``GENERALISE`` is replaced by its
shape, with a share of ``REMOVE`` removed. All four count different texts, so copies of
a document change nothing. Terms are runs of letters and digits, of ``LEAST_BYTES`` bytes at least (1: of any length).

Scale. Terms are kept only of texts with entities. Candidate terms are counted in
all texts behind a Bloom filter of bounded size, a count a term and batch; then only
the occurrences of disclosing terms are shuffled, never texts.

Defined cases: a null text is empty and has no spans; repeated rows are rows;
spans are half-open ranges of code points; a term that touches a base span is left
out. Rows with a null doc_id are found like others. ``sanitise`` keeps all other
columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, chunks_by_bytes, small_batches, stored, text_bytes, tidy
from .shingles import BYTE, CHUNK, LOWER, mix, powers

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT, GENERALISE, REMOVE = 3, 0.8, 0.95
LEAST_BYTES = 1

_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_RUN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From one @ to the next, so that long runs of letters cost no more than their length."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and ord(text[start - 1]) < 128 and ord(text[start - 1]) in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        else:
            floor = max(floor, at + 1)
        at = text.find("@", floor)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, in order."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(len(p) < 4 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m.group().split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _RUN.finditer(text):
            if m.end() - m.start() >= 12:
                d = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash (A-Z lower-cased), byte range and row of each run of letters and digits of LEAST_BYTES or more."""
    full = _TERM[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends] = True
    before = np.concatenate([[False], full[:-1]]) if len(raw) else full
    first = np.flatnonzero(full & (~before | edge[:-1]))
    after = np.concatenate([full[1:], [False]]) if len(raw) else full
    last = np.flatnonzero(full & (~after | edge[1:])) + 1
    if not len(first):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    lens = last - first
    inside = np.flatnonzero(full)
    heads = np.zeros(len(first), np.int64)
    np.cumsum(lens[:-1], out=heads[1:])
    place = np.arange(len(inside)) - np.repeat(heads, lens)
    h = mix(np.add.reduceat(BYTE[LOWER[raw[inside]]] * powers(int(lens.max()))[place], heads)).view(np.int64)
    long = lens >= LEAST_BYTES
    return h[long], first[long], last[long], np.searchsorted(ends, first[long], "right") - 1


def term_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    h = terms(raw, np.array([0, len(raw)]))[0]
    return int(h[0]) if len(h) else 0


_FOUND = "doc_id long, h long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, entities array<long>, terms array<long>"


def _entities(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """The different values of the spans, and the different terms of the text outside them."""
    if not spans:
        return [], []
    values, rest, at = set(), [], 0
    for a, k, b in spans:
        value = re.sub(r"[ ().-]", "", text[a:b]) if k > 1 else text[a:b].lower()
        values.add(int.from_bytes(hashlib.blake2b(f"{KINDS[k]}:{value}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True))
        rest.append(text[at:a])
        at = max(at, b)
    raw = np.frombuffer("\n".join([*rest, text[at:]]).encode("utf-8", "surrogatepass"), np.uint8)
    return sorted(values), np.unique(terms(raw, np.array([0, len(raw)]))[0]).tolist()


_EVERY = "array<struct<start:int,kind:int,end:int,share:double>>"


def found(docs: DataFrame) -> DataFrame:
    """Base spans of every row, the entities in them and the terms beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for text in b.column(2).to_pylist():
                text = text or ""
                spans = base_spans(text)
                kinds = [k for _, k, _ in spans]
                for i in range(4):
                    cols[i].append(kinds.count(i))
                cols[4].append(hashlib.sha256(joined(spans).encode()).hexdigest())
                cols[5].append([{"start": a, "kind": k, "end": e} for a, k, e in spans])
                for c, v in zip(cols[6:], _entities(text, spans)):
                    c.append(v)
            span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
            arrays = [b.column(0), b.column(1), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string()), pa.array(cols[5], span), *[pa.array(c, pa.list_(pa.int64())) for c in cols[6:]]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "h", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "entities", "terms"])

    return _keyed(docs).select("doc_id", "h", "text").mapInArrow(tidy(run), _FOUND)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")


def occurrences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, h, term, start, end) of every occurrence of the wanted terms."""
    bloom = docs.sparkSession.sparkContext.broadcast(Bloom.of(wanted, "term"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, ends = text_bytes(b.column(2))
            for lo, hi in chunks_by_bytes(ends, CHUNK):
                part, cut = raw[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
                t, first, last, row = terms(part, cut)
                hit = bloom.value.has(t)
                if not hit.any():
                    continue
                point = np.zeros(len(part) + 1, np.int64)
                np.cumsum((part & 0xC0) != 0x80, out=point[1:])
                row = row[hit]
                base = point[cut[row]]
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(t[hit]), pa.array((point[first[hit]] - base).astype(np.int32)), pa.array((point[last[hit]] - base).astype(np.int32))], names=["doc_id", "h", "term", "start", "end"])

    return _keyed(docs).mapInArrow(tidy(run), "doc_id long, h long, term long, start int, end int").join(wanted.select("term").distinct(), "term", "left_semi")


def frequencies(docs: DataFrame, base: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, df) of the wanted terms: different texts that hold each.

    Of the rows of a text with copies the one of least mark (hash of doc_id and text) counts. Two Bloom filters tell it:
    no row that ``firsts`` refuses is one, and all that it passes are, but for the rows found in ``unclear``. Only those,
    false positives and repeated rows, are counted by text; all others are added up where they are read.
    """
    spark = docs.sparkSession
    again = Bloom.of(stored(base.groupBy("h").count().filter("count > 1").select("h"), "copies"), "h")
    marked = base.select("h", F.xxhash64("doc_id", "h").alias("mark")).filter(again.test(spark)(F.col("h")))
    texts = stored(marked.groupBy("h").agg(F.min("mark").alias("mark")), "texts")
    firsts = Bloom.of(texts, "mark")
    maybe = marked.filter(firsts.test(spark)(F.col("mark"))).groupBy("h", "mark").agg(F.count("*").alias("n"))
    unclear = maybe.join(texts.withColumnRenamed("mark", "first"), "h").filter("mark != first or n > 1")
    unclear = Bloom.of(stored(unclear.select("mark"), "unclear"), "mark")
    shared = spark.sparkContext.broadcast((Bloom.of(wanted, "term"), again, firsts, unclear))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, again, firsts, unclear = shared.value
        for b in batches:
            raw, ends = text_bytes(b.column(2))
            h, mark = b.column(0).to_numpy(), b.column(1).to_numpy()
            copied, first = again.has(h), firsts.has(mark)
            ask = copied & first & unclear.has(mark)
            for lo, hi in chunks_by_bytes(ends, CHUNK):
                t, _, _, row = terms(raw[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo])
                row = row + lo
                hit = (first | ~copied)[row]
                t, row = t[hit], row[hit]
                hit = bloom.has(t)
                t, row = t[hit], row[hit]
                order = np.lexsort((t, row))
                t, row = t[order], row[order]
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (row[1:] != row[:-1])
                t, row = t[new], row[new]
                own = ask[row]
                one, n = np.unique(t[~own], return_counts=True)
                none = pa.nulls(len(one), pa.int64())
                keys = [pa.concat_arrays([none, pa.array(x[row[own]])]) for x in (h, mark)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([one, t[own]])), *keys, pa.array(np.concatenate([n, np.ones(int(own.sum()), np.int64)]))], names=["term", "h", "mark", "n"])

    rows = _keyed(docs).select("h", F.xxhash64("doc_id", "h").alias("mark"), "text")
    seen = stored(rows.mapInArrow(tidy(run), "term long, h long, mark long, n long").groupBy("term", "h", "mark").agg(F.sum("n").alias("n")), "seen")
    asked = seen.filter("h is not null").join(texts, ["h", "mark"], "left_semi").select("term", F.lit(1).cast("long").alias("n"))
    df = seen.filter("h is null").select("term", "n").unionByName(asked).groupBy("term").agg(F.sum("n").alias("df"))
    return df.join(wanted.select("term").distinct(), "term", "left_semi")


def disclosing(docs: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(term, share) of disclosing terms and their occurrences; None if there are none."""
    total = base.select("h").distinct().count()
    texts = base.filter(F.size("entities") > 0).select("h", "entities", "terms").dropDuplicates(["h"])
    held = texts.select("h", "terms", F.explode("entities").alias("e"))
    size = stored(held.groupBy("e").agg(F.count("*").alias("n")).filter(F.col("n") >= SUPPORT), "entities")
    often = Bloom.of(size, "e").test(docs.sparkSession)
    # Counts are added up before entities meet their sizes, so an entity of many texts is no hot key.
    co = held.filter(often(F.col("e"))).select("e", F.explode("terms").alias("term")).groupBy("e", "term").agg(F.count("*").alias("co")).filter(F.col("co") >= SUPPORT)
    co = stored(co.join(size, "e"), "candidates")
    if co.isEmpty():
        return None
    df = frequencies(docs, base, stored(co.select("term").distinct(), "wanted"))
    own = F.log2(F.lit(float(total)) / F.col("n"))
    share = F.when(own > 0, F.log2(F.col("co") * float(total) / (F.col("df") * F.col("n"))) / own).otherwise(0.0)
    shares = stored(co.join(df, "term").groupBy("term").agg(F.max(share).alias("share")).filter(F.col("share") >= GENERALISE), "disclosing")
    return None if shares.isEmpty() else (shares, stored(occurrences(docs, shares), "occurrences"))


def _added(base: DataFrame, shares: DataFrame, seen: DataFrame, how: str) -> DataFrame:
    """Rows of ``base`` joined with ``free``, the occurrences of disclosing terms that touch no base span."""
    added = seen.join(shares, "term").groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end", "share")).alias("added"))
    both = base.join(added.withColumnRenamed("doc_id", "d2").withColumnRenamed("h", "h2"), F.col("h").eqNullSafe(F.col("h2")) & F.col("doc_id").eqNullSafe(F.col("d2")), how)
    free = F.filter(F.coalesce("added", F.array().cast(_EVERY)), lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return both.withColumn("free", free.cast(_EVERY))


def spans(docs: DataFrame) -> DataFrame:
    """Every row's counts, base digest and all spans (start, kind, end, share), in order."""
    base = stored(found(small_batches(docs)), "found")
    more = disclosing(docs, base)
    own = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(1.0).alias("share"))).cast(_EVERY)
    if more is None:
        return base.select("doc_id", "h", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", own.alias("all"))
    both = _added(base, *more, "left")
    return both.select("doc_id", "h", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_sort(F.concat(own, "free")).alias("all"))


def personal_data(docs: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform("all", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    return spans(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"))


def shape(word: str) -> str:
    """What a generalised term still tells."""
    return "[NUMBER]" if word.isdigit() else "[CODE]" if any(c.isdigit() for c in word) else "[NAME]" if word[:1].isupper() else "[TERM]"


def _base(text: str) -> list[tuple[int, int, int, float]]:
    return [(a, k, b, 1.0) for a, k, b in base_spans(text)]


def cleaned(text: str, all_spans: list[tuple[int, int, int, float]]) -> str:
    """Base spans become their kind; terms are removed or generalised by their share. Of spans that overlap the first counts."""
    out, at = [], 0
    for a, k, b, share in sorted(all_spans):
        if a < at:
            at = max(at, b)  # what overlaps is covered by the first one's mark
            continue
        out += [text[at:a], f"[{KINDS[k].upper()}]" if k < 4 else "" if share >= REMOVE else shape(text[a:b])]
        at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with sanitised texts; rows without spans, and all other columns, stay as they are.

    Base spans are found again where a text is read, so that text is not shuffled. Only rows that a Bloom filter of
    those with disclosing terms lets through are, at any size.
    """
    base = stored(found(small_batches(docs)), "found")
    more = disclosing(docs, base)
    spark, bloom = docs.sparkSession, None
    if more is not None:
        touched = _added(base, *more, "inner").filter(F.size("free") > 0).groupBy("doc_id", "h").agg(F.first("free").alias("free"))
        touched = stored(touched.select(F.col("doc_id").alias("d"), F.col("h").alias("h2"), F.col("free").alias("marks"), F.xxhash64("doc_id", "h").alias("mark")), "touched")
        bloom = Bloom.of(touched, "mark")
    shared = spark.sparkContext.broadcast(bloom)

    @F.arrow_udf("struct<later:boolean,text:string>")
    def plain(text: pa.Array, own: pa.Array) -> pa.Array:
        late = np.zeros(len(text), bool) if shared.value is None else shared.value.has(own.to_numpy(zero_copy_only=False))
        done = [None if w else t and cleaned(t, _base(t)) for t, w in zip(text.to_pylist(), late)]
        return pa.StructArray.from_arrays([pa.array(late), pa.array(done, pa.string())], ["later", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.struct(*docs.columns).alias("whole"))
    rows = rows.withColumn("own", F.xxhash64("k", "h"))
    # Else the optimizer runs it twice, once for the filter.
    once = rows.select("whole", plain.asNondeterministic()("whole.text", "own").alias("p")).filter("not p.later")
    once = once.select(F.col("whole").withField("text", F.col("p.text")).alias("whole")).select("whole.*")
    if bloom is None:
        return once
    some = rows.filter(bloom.test(spark)(F.col("own"))).join(touched.drop("mark"), (F.col("h") == F.col("h2")) & F.col("k").eqNullSafe(F.col("d")), "left")

    @F.arrow_udf("string")
    def clean(text: pa.Array, marks: pa.Array) -> pa.Array:
        pairs = zip(text.to_pylist(), marks.to_pylist())
        return pa.array([t and cleaned(t, [*_base(t), *((s["start"], s["kind"], s["end"], s["share"]) for s in m or [])]) for t, m in pairs], pa.string())

    done = some.select(F.col("whole").withField("text", clean("whole.text", "marks")).alias("whole"))
    return once.unionByName(done.select("whole.*"))
