"""Related-document packing into fixed windows along paths of a neighbour graph.

Each document is tokenised once; its ids go to shared storage with a small
signature (minimum hashes of its id pairs). Documents whose minima agree are
neighbours: they are sorted by each minimum in turn and linked to the next in that
order, so a group of any size yields fewer links than it has members. Every node
keeps its ``DEGREE`` likest neighbours. Connected components of these links stay together:
one task joins them from the likest link to the least, and only a link that would
make a group of more than ``GROUP`` nodes is cut. Whole groups go to bins by a hash,
about ``BIN`` nodes a bin, so the number of partitions changes nothing. Inside a bin, a
path starts at the unvisited node of lowest degree and goes on to the likest
unvisited neighbour until there is none. Windows of 2048 ids are filled along the
paths; what remains of a bin after its last full window is cut into sequences of
a power of two of ids each, which need no padding.

Only the places found (a few numbers a document) meet the stored ids again.

Defined cases: a null or empty text has one id, the end mark; repeated rows are
documents of their own; ties go by label, then doc_id (null first), then row. An
empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches, stored, tidy

LENGTH, END, BANDS, DEGREE = 2048, 1, 8, 4
GROUP, BIN = 16384, 4096
#: Bytes of texts that are encoded together.
TOGETHER = 8 << 20
_SEEDS = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, BANDS, dtype=np.uint64) | np.uint64(1)


#: A part with white space at an edge, or with characters that two libraries may class differently.
_ODD = "^[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}]|[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}]$|[^\\x{00}-\\x{23f}]|^$"


class Encoder:
    """The ids of a byte-level BPE file; of a batch, every different space-separated part is encoded once.

    The vocabulary's split never joins characters across a single space with text on
    both sides, so a text without other white space at the edges of its parts is the
    sequence of its parts' ids, and so is a text of all different parts, whose ids are
    told apart by the spaces that begin them. Where two libraries may class characters
    differently (from U+0240 on), and where a text holds a special string, the file's
    own tokenizer encodes it whole.
    """

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken

        self.file = public_tokenizers.path(f"{name}.json")
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(self.file) as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.ranks = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spaced = np.zeros(1 << 16, bool)
        self.spaced[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self.whole = None

    def encode(self, text: str) -> np.ndarray:
        """16-bit ids of one text."""
        if (text.isascii() or max(text) < "\u0240") and not any(t in text for t in self.special):
            return np.array(self.ranks.encode_ordinary(text), "<u2")
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.file)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2")

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text of a batch; null is empty."""
        texts = texts.fill_null("")
        split = pc.split_pattern(texts, " ")
        coded = split.values.dictionary_encode()
        odd = pc.match_substring_regex(coded.dictionary, _ODD)
        for t in self.special:
            odd = pc.or_(odd, pc.match_substring(coded.dictionary, t))
        odd = odd.to_numpy(zero_copy_only=False)
        good = np.flatnonzero(~odd)
        parts = coded.dictionary.take(pa.array(good))
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(parts)], parts), " ")[0].as_py()
        every = np.array(self.ranks.encode_ordinary(" " + joined), "<u2") if len(good) else np.zeros(0, "<u2")
        heads = np.flatnonzero(self.spaced[every])
        off, at = split.offsets.to_numpy(), coded.indices.to_numpy()
        whole = np.logical_or.reduceat(odd[at], off[:-1])
        # A text's first part has no space before it, and is encoded for itself.
        first = [self.encode(w) for w in split.values.take(pa.array(off[:-1])).to_pylist()]
        size = np.zeros(len(odd) + len(first), np.int64)
        start = np.zeros(len(size), np.int64)
        size[good], start[good] = np.diff(heads, append=len(every)), heads
        size[len(odd) :] = [len(x) for x in first]
        start[len(odd) :] = len(every) + np.cumsum(size[len(odd) :]) - size[len(odd) :]
        at = at.copy()
        at[off[:-1]] = len(odd) + np.arange(len(first))
        n = size[at]
        ends = np.cumsum(n)
        flat = np.concatenate([every, *first])[np.repeat(start[at] - (ends - n), n) + np.arange(ends[-1])]
        stops = np.concatenate([[0], ends])[off]
        return [self.encode(texts[k].as_py()) if whole[k] else flat[stops[k] : stops[k + 1]] for k in range(len(texts))]


_encoder: Encoder | None = None


def encoder() -> Encoder:
    global _encoder
    _encoder = _encoder or Encoder()
    return _encoder


def signatures(ids: list[np.ndarray]) -> list[bytes]:
    """Minimum hashes of each document's pairs of neighbouring ids (of the one id, if there is one)."""
    firsts = [x[:-1] if len(x) > 1 else np.zeros(1, "<u2") for x in ids]
    flat, sizes = np.concatenate(firsts).astype(np.uint64), [len(x) for x in firsts]
    pairs = flat << np.uint64(16) | np.concatenate([x[1:] if len(x) > 1 else x for x in ids]).astype(np.uint64)
    pairs = (pairs + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    pairs ^= pairs >> np.uint64(29)
    starts = np.cumsum([0, *sizes[:-1]])
    least = np.stack([np.minimum.reduceat(pairs * s, starts) for s in _SEEDS], axis=1)
    return [x.tobytes() for x in (least >> np.uint64(32)).astype(">u4")]


def tokenised(docs: DataFrame) -> DataFrame:
    """doc_id, row (unique), n, ids (binary), sig (binary); stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(), np.array([END], "<u2")

        def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts = enc.encode_all(pa.concat_arrays([b.column(1) for b in held]))
            doc_id = pa.concat_arrays([b.column(0) for b in held])
            for lo in range(0, len(texts), 1000):
                ids = [np.concatenate([x, end]) for x in texts[lo : lo + 1000]]
                yield pa.RecordBatch.from_arrays([doc_id.slice(lo, len(ids)), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(signatures(ids), pa.binary())], names=["doc_id", "n", "ids", "sig"])

        # Several batches have more parts in common than one has.
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.nbytes for x in held) >= TOGETHER:
                yield from done(held)
                held = []
        if held:
            yield from done(held)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n long, ids binary, sig binary")
    return stored(out.withColumn("row", F.monotonically_increasing_id()), "ids")


def neighbours(nodes: DataFrame, n: int) -> DataFrame:
    """(row, near): each linked node's likest neighbours, as structs of likeness and row."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, sig, row = np.zeros(0, np.int32), np.zeros((0, BANDS), np.uint32), np.zeros(0, np.int64)
        for b in batches:
            # The last row of the batch before stands first.
            band = np.concatenate([band[-1:], b.column(0).to_numpy()])
            sig = np.concatenate([sig[-1:], np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, BANDS)])
            row = np.concatenate([row[-1:], b.column(2).to_numpy()])
            equal = sig[1:] == sig[:-1]
            hit = np.flatnonzero((band[1:] == band[:-1]) & equal[np.arange(len(equal)), band[1:]])
            x, y, like = row[hit + 1], row[hit], equal[hit].sum(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x, y])), pa.array(np.concatenate([y, x])), pa.array(np.concatenate([like, like]))], names=["row", "other", "like"])

    band = F.explode(F.array(*[F.lit(i) for i in range(BANDS)])).alias("band")
    keys = nodes.select(band, "sig", "row").withColumn("part", F.substring("sig", F.col("band") * 4 + 1, F.lit(4)))
    # Equal minima stay in one range, else the links at its ends would be lost; rows are of some 50 bytes.
    links = keys.repartitionByRange(n, "band", "part").sortWithinPartitions("band", "part", "sig", "row").select("band", "sig", "row").mapInArrow(tidy(link), "row long, other long, like int")
    near = F.slice(F.sort_array(F.collect_set(F.struct("like", "other")), False), 1, DEGREE)
    return links.groupBy("row").agg(near.alias("near"))


def groups(near: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """(row, root): connected components of the links, the likest first; a link that would join more than ``GROUP`` nodes is cut.

    ``sizes`` has the rows of each block of 2^33 row numbers, so that a node takes eight bytes of the one task.
    """
    first, total = {}, 0
    for k in sorted(sizes):
        first[k] = total
        total += sizes[k]
    bases, starts = np.array(sorted(first), np.int64), np.array([first[k] for k in sorted(first)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent, size = array("i", range(total)), array("i", [1]) * total

        def dense(rows: np.ndarray) -> list[int]:
            return (starts[np.searchsorted(bases, rows >> 33)] + (rows & (1 << 33) - 1)).tolist()

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for b in batches:
            for x, y in zip(dense(b.column(0).to_numpy()), dense(b.column(1).to_numpy())):
                x, y = root(x), root(y)
                if x != y and size[x] + size[y] <= GROUP:
                    x, y = min(x, y), max(x, y)
                    parent[y] = x
                    size[x] += size[y]
        for lo in range(0, total, 10_000):
            x = np.arange(lo, min(lo + 10_000, total))
            yield pa.RecordBatch.from_arrays([pa.array(sparse(x)), pa.array(sparse(np.array([root(i) for i in x.tolist()], np.int64)))], names=["row", "root"])

    def sparse(x: np.ndarray) -> np.ndarray:
        k = np.searchsorted(starts, x, "right") - 1
        return (bases[k] << 33) + x - starts[k]

    links = near.select("row", F.explode("near").alias("x")).select(F.least("row", "x.other").alias("a"), F.greatest("row", "x.other").alias("b"), "x.like").distinct()
    return links.repartition(1).sortWithinPartitions(F.desc("like"), "a", "b").select("a", "b").mapInArrow(tidy(run), "row long, root long")


def walk(nodes: list[tuple[int, list[int]]]) -> Iterator[int]:
    """Rows in the order of greedy paths; ``nodes`` are (row, neighbours by likeness) in the order of ties."""
    near = dict(nodes)
    degree = {r: sum(x in near for x in xs) for r, xs in nodes}
    free = set(near)
    for r, _ in sorted(nodes, key=lambda x: degree[x[0]]):
        while r is not None and r in free:
            free.discard(r)
            yield r
            r = next((x for x in near[r] if x in free), None)


def cuts(total: int) -> np.ndarray:
    """Starts of the sequences of a stream of ``total`` ids, and its end."""
    full = total // LENGTH
    rest, out = total - full * LENGTH, [*range(0, (full + 1) * LENGTH, LENGTH)][: full + 1]
    for k in range(LENGTH.bit_length() - 1, -1, -1):
        if rest >> k & 1:
            out.append(out[-1] + (1 << k))
    return np.array(out, np.int64)


def places(rows: DataFrame) -> DataFrame:
    """(row, stream, at, total): where each document's ids begin in its bin's stream."""
    n = partitions(rows.sparkSession)
    nodes = rows.select("row", "doc_id", "n", "sig")
    near = stored(neighbours(nodes, n), "near")
    sizes = {r.k: r.n for r in nodes.groupBy(F.shiftright("row", 33).alias("k")).agg(F.count("*").alias("n")).collect()}  # a row a task
    root = groups(near, sizes).select(F.col("row").alias("g"), "root")
    bins = max(1, sum(sizes.values()) // BIN)
    near = near.select(F.col("row").alias("r"), F.col("near.other").alias("near"))
    joined = nodes.join(near, F.col("row") == F.col("r"), "left").join(root, F.col("row") == F.col("g")).select("row", "doc_id", "n", F.substring("sig", 1, 4).alias("label"), F.coalesce("near", F.array().cast("array<long>")).alias("near"), F.pmod(F.xxhash64("root"), F.lit(bins)).alias("bin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(stream: int, held: list[tuple]) -> pa.RecordBatch:
            size = {r: n for r, n, _, _ in held}
            order = list(walk([(r, near) for r, _, near, _ in held]))
            n = np.array([size[r] for r in order], np.int64)
            ends = np.cumsum(n)
            return pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(np.full(len(n), stream, np.int64)), pa.array(ends - n), pa.array(np.full(len(n), ends[-1]))], names=["row", "stream", "at", "total"])

        held: list[tuple] = []
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held and held[-1][3] != r[3]:
                    yield done(held[-1][3], held)
                    held = []
                held.append(r)
        if held:
            yield done(held[-1][3], held)

    # Sorted by what ties go by; a bin is whole in one partition, however many there are.
    ranged = joined.repartition(n, "bin").sortWithinPartitions("bin", "label", "doc_id", "row")
    return ranged.select("row", "n", "near", "bin").mapInArrow(tidy(run), "row long, stream long, at long, total long")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame) -> DataFrame:
    """A row per piece of a document in a sequence."""
    rows = tokenised(small_batches(docs))
    where = stored(places(rows), "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for doc, ids, stream, at, total in zip(*(b.column(i).to_pylist() for i in range(5))):
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                n, full = len(wide), total // LENGTH
                if at + n <= full * LENGTH:
                    edges = range(at - at % LENGTH, at + n, LENGTH)
                    first = at // LENGTH
                else:
                    every = cuts(total)
                    first = int(np.searchsorted(every, at, "right")) - 1
                    edges = every[first : int(np.searchsorted(every, at + n, "left"))].tolist()
                edges = list(edges) + [at + n]
                for k in range(len(edges) - 1):
                    a, z = max(edges[k], at), min(edges[k + 1], at + n)
                    piece = wide[a - at : z - at]
                    for c, v in zip(out, (doc, a - at, z - a, zlib.crc32(piece.tobytes()), n, (stream << 40) + first + k, a - edges[k])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[x.split()[0] for x in PIECES.split(", ")])

    return rows.select("row", "doc_id", "ids").join(where, "row").select("doc_id", "ids", "stream", "at", "total").mapInArrow(tidy(run), PIECES)
