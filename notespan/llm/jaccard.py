"""Exact Jaccard self-join of word 5-gram sets with adaptive multi-match prefixes.

Tokens (shingle hashes) get one order for the whole corpus: rare ones first, by
hash among equals. If two sets overlap enough, then for every m their m-prefixes
(the first n - t + m tokens, t being the least overlap that any partner needs)
share at least m tokens. Each document takes the m whose estimated cost is least:
posting entries read, plus verifications expected, which more matches make rarer.
A pair is verified when it shares as many prefix tokens as the smaller of its m.

For a given pair of sizes the overlap it needs is known, so only the starts of the
prefixes that this overlap leaves are compared (``i < n - overlap + m``). A posting
carries the parities of its set in 128 ranges of hashes: sets differ by at least as
many tokens as parities, so most pairs that share a passage, or a token by chance,
are dropped where they are found.

Scale. Equal sets are one class from the start, so a group of copies is one row.
A token in over ``HOT`` prefixes is split by bands of set sizes and chunks of its
postings, so no key gathers all of a frequent token's documents. Rarity is counted over all documents' hash-order prefixes (where a token has no
part in a prefix its rarity is of no account) and kept in a table of fixed size,
at most ``MAX_SLOTS`` bytes; clashes in it only change the order, alike for all.
Whole sets are hashed again for candidate documents only, found by a Bloom filter
of bounded size and an exact join behind it.

Defined cases: null text is empty; a document without words has an empty set,
links with nothing and is its own component; fewer than 5 words make one shingle.
Repeated rows of a doc_id are rows: each counts in n_similar of the others. Rows
with a null doc_id link like others; a component of such rows alone is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bloom, small_batches, stored, tidy
from .shingles import mix, shingle_sets

PERCENT = 90
MATCHES = 4
#: A verification sends two whole sets, some hundred times the bytes of a posting entry.
VERIFY_COST = 200.0
MAX_SLOTS = 1 << 24
#: Heads that hold a token from which on it counts as frequent; rarer tokens are alike.
FREQUENT = 8
#: Further documents expected to hold a token that isn't among the frequent ones.
UNLISTED = 0.1
SETS = 128
#: Postings of a token, by power of two, from which they are split into chunks of about so many.
HOT = 2048
#: Columns of a posting's parities.
ODD = ("odd0", "odd1")
#: Bits of the parities that candidates are held against before their sets are sent.
WIDE = 1024
#: Sets of linked sizes are in one band or in neighbouring ones.
BAND = float(np.log(100 / PERCENT)) * 1.0001


def least_overlap(n: int) -> int:
    """The overlap that the smallest possible partner of a set of n tokens needs."""
    small = -(-PERCENT * n // 100)
    return -(-PERCENT * (n + small) // (100 + PERCENT))


def needed(n1: Column, n2: Column) -> Column:
    """The least o with (100 + PERCENT) * o >= PERCENT * (n1 + n2), in whole numbers."""
    return F.floor(((n1 + n2) * PERCENT + 99 + PERCENT) / (100 + PERCENT))


def _slots(tokens: np.ndarray, mask: int) -> np.ndarray:
    return ((tokens.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & mask


def parities(tokens: np.ndarray, bits: int = 64 * len(ODD)) -> bytes:
    """For each of so many ranges of hashes whether the set holds an odd number of tokens there."""
    return np.packbits(np.bincount((tokens.view(np.uint64) >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits) & 1).tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, h (the text's hash), set size n, 128-bit set hash, parities, and the start of the set in hash order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, key, odd, wide, head = [], [], [], [], []
            for s in shingle_sets(b.column(1)):
                n = len(s)
                size.append(n)
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                odd.append(parities(s))
                wide.append(parities(s, WIDE))
                p = n - least_overlap(n) + MATCHES
                head.append(s[: p + 8 + p // 4].copy().view(np.int64))
            offsets = np.zeros(len(head) + 1, np.int32)
            np.cumsum([len(x) for x in head], out=offsets[1:])
            flat = np.concatenate(head) if head else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(odd, pa.binary()), pa.array(wide, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "h", "n", "key", "odd", "wide", "head"])

    own = F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", own).mapInArrow(tidy(run), "doc_id long, h long, n long, key binary, odd binary, wide binary, head array<long>")


def _rehashed(docs: DataFrame, wanted: DataFrame, each, schema: str) -> DataFrame:
    """``each(sets)`` for the texts of ``wanted`` (doc_id, key): its other columns, then those of ``schema``.

    Texts are found by a Bloom filter and hashed anew; an exact join behind it drops
    what else it let through. A row that repeats doc_id and set comes as often.
    """
    bloom = docs.sparkSession.sparkContext.broadcast(Bloom.of(wanted, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            hit = bloom.value.has(ids.fill_null(0).to_numpy(zero_copy_only=False))
            b = b.filter(pa.array(hit | ids.is_null().to_numpy(zero_copy_only=False)))
            if not b.num_rows:
                continue
            sets = list(shingle_sets(b.column(1)))
            key = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key, pa.binary()), *each(sets)], names=["doc_id", "key", *(x.split()[0] for x in schema.split(", "))])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), f"doc_id long, key binary, {schema}")
    names = [x.split()[0] for x in schema.split(", ")]
    more = [c for c in wanted.columns if c not in ("doc_id", "key")]
    w = wanted.select(F.col("key").alias("k"), F.col("doc_id").alias("d"), *more)
    return found.join(w, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).select(*more, *names)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)))


def slot_levels(counts: DataFrame, least: int = 0) -> tuple[np.ndarray, int]:
    """Log2 of the counts of tokens (token, level) by slot, from ``least`` on; the table's size is bounded."""
    by_level = {r.level: r.n for r in counts.filter(F.col("level") >= least).groupBy("level").agg(F.count("*").alias("n")).collect()}
    least, held = 41, 0
    for level in sorted(by_level, reverse=True):
        if held + by_level[level] > MAX_SLOTS // 4 and held:
            break
        least, held = level, held + by_level[level]
    size = 1 << 12
    while size < min(4 * held, MAX_SLOTS):
        size *= 2

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_slots(b.column(0).to_numpy(zero_copy_only=False), size - 1)), b.column(1)], names=["slot", "level"])

    out = np.zeros(size, np.uint8)
    if held:
        best = counts.filter(F.col("level") >= least).mapInArrow(tidy(slots), "slot long, level int").groupBy("slot").agg(F.max("level").alias("level"))
        got = best.toArrow()  # at most one row per slot
        out[got.column("slot").to_numpy()] = got.column("level").to_numpy()
    return out, size - 1


def repeated_tokens(tokens: DataFrame, name: str, least: int) -> DataFrame:
    """(token, level) of the tokens that occur ``least`` times or more; stored."""
    counts = tokens.groupBy("token").count().filter(F.col("count") >= least)
    return stored(counts.select("token", F.least(F.lit(40), F.floor(F.log2("count"))).cast("int").alias("level")), name)


def _prefix(tokens: np.ndarray, n: int, levels: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Tokens in the corpus' order as far as they are known, their levels, and whether that is far enough."""
    level = levels[_slots(tokens, mask)]
    order = np.lexsort((tokens.view(np.uint64), level))
    need = min(n, n - least_overlap(n) + MATCHES)
    sure = len(tokens) == n or int((level == 0).sum()) >= need
    return tokens[order[:need]], level[order[:need]], sure


def _matches(level: np.ndarray, n: int) -> int:
    """The number of matches m to ask for: what costs least by the tokens' posting lengths.

    One match brings every entry read as a candidate. Documents that share more than
    one token mostly share a passage, all tokens of it at once, so m matches are
    expected of as many documents as the m-th longest posting holds.
    """
    base = n - least_overlap(n)
    length = np.where(level > 0, np.exp2(np.minimum(level, 40).astype(np.float64)), UNLISTED)
    best, cost = 1, np.inf
    for m in range(1, min(MATCHES, len(level) - base) + 1):
        own = length[: base + m]
        found = own.sum() if m == 1 else np.partition(own, len(own) - m)[len(own) - m]
        if (c := own.sum() + VERIFY_COST * found) < cost:
            best, cost = m, c
    return best


def _posted(tokens: np.ndarray, n: int, levels: np.ndarray, mask: int) -> tuple[np.ndarray, int, bool]:
    """A class's prefix, the matches it asks for, and whether the known tokens suffice for both."""
    t, level, sure = _prefix(tokens, n, levels, mask)
    m = _matches(level, n)
    return t[: n - least_overlap(n) + m], m, sure


def prefixes(classes: DataFrame, sources: tuple[DataFrame, DataFrame, Bloom], docs: DataFrame) -> tuple[DataFrame, tuple[np.ndarray, int]]:
    """(cid, n, m, parities, prefix in order) of every class, and the levels of tokens in ``HOT`` prefixes or more."""
    frequent = repeated_tokens(classes.select(F.explode("head").alias("token")), "frequent", FREQUENT)
    levels, mask = slot_levels(frequent)
    context = docs.sparkSession.sparkContext
    rows, many, repeated = sources
    shared, repeated = context.broadcast(levels), context.broadcast(repeated)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(4)
            b = b.filter(pa.array(k.is_null().to_numpy(zero_copy_only=False) | ~repeated.value.has(k.fill_null(0).to_numpy())))
            heads = b.column(3)
            flat, off = heads.values.to_numpy(zero_copy_only=False), heads.offsets.to_numpy()
            done = [_posted(flat[off[r] : off[r + 1]], n, shared.value, mask) for r, n in enumerate(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m for _, m, _ in done], pa.int32()), b.column(2), pa.array([sure for *_, sure in done]), _lists([t if sure else t[:0] for t, _, sure in done])], names=["cid", "n", "m", "odd", "sure", "prefix"])

    def whole(sets: list[np.ndarray]) -> list[pa.Array]:
        done = [_posted(x.view(np.int64), len(x), shared.value, mask) if len(x) else (x, 1, True) for x in sets]
        return [pa.array([len(x) for x in sets], pa.int32()), pa.array([m for _, m, _ in done], pa.int32()), pa.array(map(parities, sets), pa.binary()), _lists([t for t, *_ in done])]

    # One Python worker a task does both: which rows are classes of their own, and their prefixes.
    cols = [F.col("n").cast("int").alias("n"), "odd", "head"]
    both = rows.select(F.col("row").alias("cid"), *cols, F.xxhash64("key").alias("k")).unionByName(many.select("cid", *cols, F.lit(None).cast("long").alias("k")))
    own = stored(both.mapInArrow(tidy(known), "cid long, n int, m int, odd binary, sure boolean, prefix array<long>"), "prefixes")
    out, hot = own.filter("sure").drop("sure"), frequent
    unsure = stored(classes.select("cid", "doc_id", "key").join(own.filter("NOT sure").select("cid"), "cid", "left_semi"), "unsure")
    if not unsure.isEmpty():  # frequent tokens fill their heads: order their whole sets
        again = stored(_rehashed(docs, unsure, whole, "n int, m int, odd binary, prefix array<long>").dropDuplicates(["cid"]), "reordered")
        out = out.unionByName(again)
        # Tokens outside the heads may be frequent there.
        hot = hot.unionByName(repeated_tokens(again.select(F.explode("prefix").alias("token")), "hot", HOT))
    return out, slot_levels(hot, HOT.bit_length() - 1)


def _of_tokens(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and token of every token of a batch of prefixes."""
    lists = b.column(4)
    off = lists.offsets.to_numpy()
    flat, size = lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], np.diff(off)
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(flat)) - np.repeat(off[:-1] - off[0], size), flat


def similar_classes(classes: DataFrame, sources: tuple[DataFrame, DataFrame, Bloom], docs: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of ids of linked classes."""
    prefix, (hot, mask) = prefixes(classes, sources, docs)
    hot = docs.sparkSession.sparkContext.broadcast(hot)

    schema = "key long, cid long, about long, " + ", ".join(f"{c} long" for c in ODD)

    def post(larger: bool | None):
        """(key, cid, n with place and m, parities) of prefix tokens: of those that aren't hot (None), or of hot ones.

        Of a hot token, the smaller set of a pair is in one band and chunk, and the
        larger one asks all that may hold it.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                row, place, token = _of_tokens(b)
                level = hot.value[_slots(token, mask)].astype(np.int64)
                keep = (level > 0) == (larger is not None)
                row, place, token, level = row[keep], place[keep], token[keep], level[keep]
                odd = np.frombuffer(b"".join(b.column(3).to_pylist()), np.int64).reshape(-1, len(ODD))
                cid, n, m = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                if larger is not None:
                    band = np.floor(np.log(np.maximum(n, 1)) / BAND).astype(np.int64)[row] + 1
                    chunks = np.int64(1) << np.maximum(0, level - HOT.bit_length() + 2)
                    if larger:  # for the set's own band and the one below, in every chunk
                        again = np.repeat(np.arange(len(row)), 2 * chunks)
                        turn = np.arange(len(again)) - np.repeat(2 * (np.cumsum(chunks) - chunks), 2 * chunks)
                        row, place, token, band, chunk = row[again], place[again], token[again], band[again] - turn % 2, turn // 2
                    else:
                        chunk = (mix(cid.view(np.uint64)) >> np.uint64(8)).astype(np.int64)[row] % chunks
                    token = mix(token.view(np.uint64) + mix((band << 32 | chunk).astype(np.uint64))).view(np.int64)
                about = (n << 32 | m)[row] | place << 3
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(cid[row]), pa.array(about), *[pa.array(odd[row, k]) for k in range(len(ODD))]], names=["key", "cid", "about", *ODD])

        return prefix.mapInArrow(tidy(run), schema)

    part = lambda c: (F.shiftright(c, 32), F.shiftright(c, 3).bitwiseAND((1 << 29) - 1), F.col(c).bitwiseAND(7))
    (n1, i1, m1), (n2, i2, m2) = part("about1"), part("about2")
    near = n2 * 100 >= n1 * PERCENT
    later = (n1 > n2) | ((n1 == n2) & (F.col("cid1") < F.col("cid2")))
    m = F.least(m1, m2)
    overlap = needed(n1, n2)
    starts = (i1 < n1 - overlap + m) & (i2 < n2 - overlap + m)
    differ = sum((F.bit_count(F.col(c + "1").bitwiseXOR(F.col(c + "2"))) for c in ODD), F.lit(0))
    like = differ <= n1 + n2 - 2 * overlap

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        x, y = (p.select("key", *[F.col(c).alias(c + s) for c in ("cid", "about", *ODD)]) for p, s in ((x, "1"), (y, "2")))
        return x.join(y, "key").filter(near & later & starts & like).select("cid1", "cid2", m.alias("m"))

    # A hot key stands for token, band and chunk; should two of them share one, the check of whole sets drops what it brings.
    cold = post(None)
    found = met(cold, cold)
    if hot.value.any():
        found = found.unionByName(met(post(True), post(False)))
    pairs = found.groupBy("cid1", "cid2").agg(F.count("*").alias("c"), F.min("m").alias("m")).filter("c >= m").select("cid1", "cid2")
    pairs = stored(pairs, "candidates"); 
    return verified(stored(alike(pairs, classes), "alike"), classes, docs)


def alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose wide parities don't rule a link out."""
    ids = stored(pairs.select(F.col("cid1").alias("cid")).union(pairs.select("cid2")).distinct(), "ids")
    hit = Bloom.of(ids, "cid").test(pairs.sparkSession)
    wide = classes.select("cid", "n", "wide").filter(hit(F.col("cid")))
    one, two = (wide.select(*[F.col(c).alias(c + s) for c in wide.columns]) for s in ("1", "2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(b.num_rows, -1) for k in (3, 4))
            keep = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= b.column(2).to_numpy()
            yield b.select([0, 1]).filter(pa.array(keep))

    n1, n2 = F.col("n1"), F.col("n2")
    both = pairs.join(one, "cid1").join(two, "cid2").select("cid1", "cid2", (n1 + n2 - 2 * needed(n1, n2)).cast("long").alias("most"), "wide1", "wide2")
    return both.mapInArrow(tidy(run), "cid1 long, cid2 long")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (cid1, cid2) whose sets overlap enough, as (a, b).

    Components of candidates are cut into blocks of about ``SETS`` sets, and pairs are
    verified by pairs of blocks, so a set in many pairs is sent once a block, not once
    a pair; a unit of work holds two blocks at most, whatever the component's size.
    """
    nodes = stored(components(pairs.toDF("a", "b")), "nodes")
    sizes = nodes.groupBy("root").agg(F.count("*").alias("c"))
    cell = F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / SETS))
    nodes = stored(nodes.join(sizes, "root").select("node", "root", cell.alias("cell")), "cells")
    one, two = (nodes.select(F.col("node").alias("cid" + s), F.col("root").alias("root" + s), F.col("cell").alias("cell" + s)) for s in ("1", "2"))
    unit = F.struct(F.col("root1").alias("root"), F.least("cell1", "cell2").alias("x"), F.greatest("cell1", "cell2").alias("y"))
    work = stored(pairs.join(one, "cid1").join(two, "cid2").select(F.xxhash64(unit).alias("unit"), "cid1", "cid2"), "work")
    units = work.select("unit", F.col("cid1").alias("cid")).union(work.select("unit", "cid2")).groupBy("cid").agg(F.collect_set("unit").alias("units"))
    wanted = stored(classes.select("cid", "doc_id", "key").join(units, "cid"), "wanted")
    none = F.lit(None)
    sets = _rehashed(docs, wanted, lambda sets: [_lists(sets)], "tokens array<long>")
    rows = sets.select(F.explode("units").alias("unit"), F.lit(0).alias("kind"), F.col("cid").alias("cid1"), none.cast("long").alias("cid2"), "tokens")
    rows = rows.unionByName(work.select("unit", F.lit(1).alias("kind"), "cid1", "cid2", none.cast("array<long>").alias("tokens")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            a, b = [], []
            tokens = batch.column(4)
            flat, off = tokens.values.to_numpy(zero_copy_only=False), tokens.offsets.to_numpy()
            for i, (unit, kind, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                if unit != now:
                    now, held = unit, {}
                if kind == 0:
                    held[x] = flat[off[i] : off[i + 1]].view(np.uint64)
                    continue
                s, t = held[x], held[y]
                both = np.concatenate([s, t])
                both.sort()
                o = int((both[1:] == both[:-1]).sum())
                if 100 * o >= PERCENT * (len(s) + len(t) - o):
                    a.append(min(x, y))
                    b.append(max(x, y))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition("unit").sortWithinPartitions("unit", "kind").mapInArrow(tidy(run), "a long, b long")


def components(edges: DataFrame, local: int = 200_000) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node reachable.

    Alternates links to the least neighbour among larger and among all neighbours
    until nothing changes; every round is written to shared storage. Once the edges
    left are few by count (``local``), one task ends it with a disjoint-set forest.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while True:
        if edges.count() <= local:
            return _forest(edges)
        nodes = edges.union(edges.select("b", "a"))
        least = nodes.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("r"))
        large = nodes.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("r").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("r"))
        small = large.join(least, "a").filter("b <> r").select(F.col("b").alias("a"), F.col("r").alias("b")).union(least.select("a", F.col("r").alias("b"))).filter("a <> b").distinct()
        after = stored(small, "edges")
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).union(after.select("b", "b").distinct())
        edges = after


def _forest(edges: DataFrame) -> DataFrame:
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ra, rb = root(a), root(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
        if parent:
            nodes = list(parent)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, batch.schema.field(0).type), pa.array([root(x) for x in nodes], batch.schema.field(0).type)], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(tidy(run), f"node {kind}, root {kind}")


def classes_of(rows: DataFrame) -> tuple[DataFrame, tuple[DataFrame, DataFrame, Bloom]]:
    """A row per different set: cid, key, n, odd, head, doc_id (the least) and copies; only rows of repeated sets are shuffled whole.

    Also what they come from: all rows, the classes of those that the filter of repeated sets holds, and that filter.
    """
    some = rows.filter("n > 0")
    again = stored(some.groupBy("key").count().filter("count > 1").select(F.xxhash64("key").alias("k")), "repeated")
    repeated = Bloom.of(again, "k")
    hit = repeated.test(rows.sparkSession)(F.xxhash64("key"))
    cols = ["key", "n", "odd", "wide", "head"]
    many = some.filter(hit).groupBy("key").agg(F.min("row").alias("cid"), *[F.first(c).alias(c) for c in cols[1:]], F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    many = stored(many, "copied")
    classes = some.filter(~hit).select("key", F.col("row").alias("cid"), *cols[1:], "doc_id", F.lit(1).cast("long").alias("copies")).unionByName(many)
    return classes, (some, many, repeated)


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n, key) of every row, h its text's hash, and (key, n_similar, component_id, comp) of every set with links or copies."""
    rows = stored(signatures(small_batches(docs)).withColumn("row", F.monotonically_increasing_id()), "signatures")
    classes, sources = classes_of(rows)
    links = stored(similar_classes(classes, sources, docs), "links")
    ends = links.union(links.select("b", "a")).toDF("cid", "other")
    weight = classes.select(F.col("cid").alias("other"), "copies")
    others = ends.join(weight, "other").groupBy("cid").agg(F.sum("copies").alias("others"))
    named = components(links).join(classes.select(F.col("cid").alias("node"), "doc_id"), "node")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component"))
    named = named.select(F.col("node").alias("cid"), "root").join(least, "root").select("cid", "root", "component")
    about = classes.select("cid", "key", "copies", "doc_id").join(others, "cid", "left").join(named, "cid", "left")
    about = about.select("key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_similar"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("root", "cid").alias("comp"))
    return rows.select("doc_id", "h", "n", "key"), stored(about.filter("n_similar > 0"), "linked")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_shingles, n_similar, component_id."""
    rows, special = linked(docs)
    rows = rows.withColumnRenamed("n", "n_shingles")
    none = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.lit(0).cast("long").alias("n_similar"), F.col("doc_id").alias("component_id"))
    some = rows.filter("n_shingles > 0").join(special, "key", "left")
    return some.select("doc_id", "n_shingles", F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("component_id", "doc_id").alias("component_id")).unionByName(none)


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The row of the least doc_id of every component; all columns stay.

    Rows are told apart by doc_id and text: of a doc_id with several texts only those
    go that are near copies. A null doc_id comes after all others; ties go by the
    text's hash; of rows that repeat both doc_id and text one is kept if they are
    linked with anything, which they are with one another unless they have no words.
    Only rows that a Bloom filter can't settle are shuffled, at any size.
    """
    spark = docs.sparkSession
    rows, special = linked(docs)
    found = stored(rows.join(special, "key").groupBy("doc_id", "h", "comp").count(), "similar")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("o")
    kept = found.groupBy("comp").agg(first).select(F.col("o.doc_id").alias("d"), F.col("o.h").alias("g"))
    same = (F.col("h") == F.col("g")) & F.col("doc_id").eqNullSafe(F.col("d"))
    mark = F.xxhash64("doc_id", "h").alias("mark")
    gone = stored(found.join(kept, same, "left_anti").select("doc_id", "h", mark), "gone")
    again = stored(found.filter("count > 1").join(kept, same, "left_semi").select("doc_id", "h", mark), "again")
    touched = Bloom.of(stored(gone.union(again), "touched"), "mark").test(spark)
    other = gone.select(F.col("doc_id").alias("d"), F.col("h").alias("g"))
    # Rows that the first filter lets through although they stay; what is in neither is gone for certain.
    spared = rows.select("doc_id", "h", mark).filter(touched(F.col("mark"))).join(other, same, "left_anti")
    staying = Bloom.of(stored(spared, "spared"), "mark").test(spark)
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.struct(*docs.columns).alias("whole")).withColumn("mark", mark)
    sure = whole.filter(~touched(F.col("mark"))).select("whole.*")
    open_ = whole.filter(touched(F.col("mark"))).filter(staying(F.col("mark"))).join(other, same, "left_anti")
    twice = again.select(F.col("doc_id").alias("d"), F.col("h").alias("g"))
    one = open_.join(twice, same, "left_semi").dropDuplicates(["doc_id", "h"]).unionByName(open_.join(twice, same, "left_anti"))
    return sure.unionByName(one.select("whole.*"))
