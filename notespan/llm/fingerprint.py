"""Homomorphic multiset fingerprints of documents.

A text is a multiset of paragraphs (its non-empty lines). Every paragraph is
hashed to a wide vector, and a text's fingerprint is the sum of its paragraphs'
vectors, lane by lane, modulo a power of two. So the order of paragraphs doesn't
matter, and a paragraph is inserted or deleted by adding or subtracting its
vector, without reading the rest.

The vector has two parts. ``EXACT`` lanes modulo 2^32 come from an extendable
hash of the paragraph: equal fingerprints mean equal multisets. ``NEAR`` lanes
modulo 2^32 hold the paragraph's byte windows, each added to one lane with a
sign; that part is linear as well, and the cosine of two texts' lanes estimates
that of their window counts, so texts that share most of their paragraphs, or
most of a long one, have near fingerprints. A lane is read as a signed number, which
is its true sum as long as no lane gets 2^31 windows more of one sign than of the other.

Defined cases: a null text is the empty text, whose fingerprint is zero; a text
of white lines only has it too. Two zero fingerprints are alike (1), a zero and
another aren't (0). Rows with a null doc_id come last in descending order; rows
that share a doc_id follow one another by the hash of their text. A lone row is
its own next row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches

EXACT, NEAR, WINDOW = 32, 128, 8
ZERO = (np.zeros(EXACT, np.uint32), np.zeros(NEAR, np.uint32))
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _grams(raw: np.ndarray) -> np.ndarray:
    """Every window of WINDOW bytes as one integer; a shorter paragraph is one window."""
    if len(raw) < WINDOW:
        raw = np.concatenate([raw, np.zeros(WINDOW - len(raw), np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(raw, WINDOW).copy().view(np.uint64).ravel()


def add_paragraph(state: tuple[np.ndarray, np.ndarray], paragraph: bytes, sign: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The state with one paragraph more, or less with sign -1."""
    exact = np.frombuffer(hashlib.shake_128(paragraph).digest(4 * EXACT), "<u4")
    near = _near([paragraph])
    return (state[0] + exact, state[1] + near) if sign > 0 else (state[0] - exact, state[1] - near)


def _near(paragraphs: list[bytes]) -> np.ndarray:
    """Signed counts of all windows of the paragraphs; windows don't cross their edges."""
    short = [p for p in paragraphs if len(p) < WINDOW]
    long = [p for p in paragraphs if len(p) >= WINDOW]
    parts = []
    if long:
        g = _grams(np.frombuffer(b"".join(long), np.uint8))
        if len(long) > 1:
            keep = np.ones(len(g), bool)
            at = np.cumsum([len(p) for p in long])[:-1]
            for k in range(1, WINDOW):
                keep[at - k] = False
            g = g[keep]
        parts.append(g)
    parts += [_grams(np.frombuffer(p, np.uint8)) for p in short]
    g = np.concatenate(parts)
    h = g * _SPREAD
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    cell = (h >> np.uint64(56)).astype(np.int64)  # 7 bits of lane, 1 of sign
    count = np.bincount(cell, minlength=2 * NEAR)
    return (count[:NEAR] - count[NEAR:]).astype(np.int64).astype(np.uint32)


def paragraphs(text: str) -> list[bytes]:
    return [p for p in text.encode("utf-8", "surrogatepass").split(b"\n") if p.strip()]


def fingerprint(text: str) -> tuple[np.ndarray, np.ndarray]:
    ps = paragraphs(text)
    if not ps:
        return ZERO
    size = 4 * EXACT
    exact = np.frombuffer(b"".join([hashlib.shake_128(p).digest(size) for p in ps]), "<u4").reshape(len(ps), EXACT).sum(axis=0, dtype=np.uint32)
    return exact, _near(ps)


def to_hex(f: tuple[np.ndarray, np.ndarray]) -> str:
    return f[0].astype("<u4").tobytes().hex() + f[1].astype("<u4").tobytes().hex()


def from_hex(s: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(s)
    return np.frombuffer(raw[: 4 * EXACT], "<u4"), np.frombuffer(raw[4 * EXACT :], "<u4")


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """1 for equal fingerprints, else the cosine of the near lanes, 0 at least."""
    if np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]):
        return 1.0
    x, y = a[1].view(np.int32).astype(np.float64), b[1].view(np.int32).astype(np.float64)
    norm = float(np.sqrt((x @ x) * (y @ y)))
    return min(1.0, max(0.0, float(x @ y) / norm)) if norm else 0.0


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row per document, with the fingerprints of its text and of its edited text.

    The edit replaces the last third of a text by the start of the next document's
    in descending doc_id, so neighbours must meet: rows move once, to ranges of
    doc_id bounded by its quantiles; a doc_id of many rows, such as null, is cut by
    the hash of the text. The row at each part's start is sent to the part before as
    well; no part waits for another.
    """
    spark = small_batches(docs).sparkSession
    n = partitions(spark)
    low = -(1 << 63)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("k"))
    # Exact elements of the column: the largest key of each range, ascending.
    cuts = ids.agg(F.percentile_approx("k", [i / n for i in range(1, n)] + [1.0], F.lit(20 * n)).alias("q"), F.max("k").alias("top")).first()
    if cuts.top is None:
        return spark.createDataFrame([], SCHEMA)
    # A doc_id that is several quantiles at once is cut by the hash of its texts, at the least hash of each cut; what
    # lies below it is a range of its own.
    key, own = F.coalesce(F.col("doc_id").cast("long"), F.lit(low)), F.xxhash64(F.coalesce("text", F.lit("")))
    hot = {k: c for k, c in Counter(cuts.q).items() if c > 1}
    below, bounds = [], {}
    if hot:
        below = [x for x in ids.agg(*[F.max(F.when(F.col("k") < k, F.col("k"))) for k in hot]).first() if x is not None]
        times = F.create_map(*[F.lit(x).cast("long") for kv in hot.items() for x in kv])
        turn = F.floor((F.col("h").cast("double") + 2.0**63) / 2.0**64 * times[F.col("k")])
        cut = docs.select(key.alias("k"), own.alias("h")).filter(F.col("k").isin(list(hot))).groupBy("k", turn.alias("turn")).agg(F.min("h").alias("h"))
        for r in cut.collect():  # a row a quantile at most
            bounds.setdefault(r.k, []).append(r.h)
    tops = np.array(sorted({*cuts.q, cuts.top, *below}), np.int64)
    bounds = {k: np.array(sorted(v), np.int64) for k, v in bounds.items()}
    split = np.array([len(bounds.get(t, "x")) for t in tops.tolist()], np.int64)
    first = np.cumsum(split[::-1])[::-1] - split  # parts in the order of the rows, descending
    m = int(split.sum())

    @F.pandas_udf("array<int>")
    def ranges(k, h):  # the row's own part, and the one before it where the row may lead its part
        k, h = k.to_numpy(), h.to_numpy()
        at = np.searchsorted(tops, k, "left")
        part, lead = first[at], tops[at] == k
        for t, edges in bounds.items():
            some = np.flatnonzero(k == t)
            cell = np.searchsorted(edges, h[some], "right") - 1
            part[some] += cell
            lead[some] = edges[cell] == h[some]
        return pd.Series([[p, (p - 1) % m] if x else [p] for p, x in zip(part.tolist(), lead.tolist())])

    rows = (
        docs.select(key.alias("k"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), own.alias("h"))
        .withColumn("at", ranges("k", "h"))
        .select("k", "doc_id", "text", "h", F.posexplode("at").alias("ahead", "part"))
        .repartitionById(m, "part")
        .sortWithinPartitions("ahead", F.desc("k"), "h", "text")
        .select("doc_id", "text", "ahead")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Own rows in order, then those that lead the next range; a lone range is led by its own first row."""
        last, out, over = None, [], False

        def pair(a, following):
            i, text, f, nf = a[0], a[1], a[2], following[2]
            e = edited(text, following[1])
            ef = fingerprint(e)
            return (i, len(text), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), to_hex(f), to_hex(ef), likeness(f, ef), likeness(f, nf))

        for b in batches:
            for i, text, ahead in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if over:
                    continue
                now = (i, text, fingerprint(text))
                if last is not None:
                    out.append(pair(last, now))
                if ahead:
                    over = True  # of rows that share the leading doc_id the first one counts
                    last = None
                else:
                    last = now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=[x.split()[0] for x in SCHEMA.split(", ")])
                out = []

    return rows.mapInArrow(run, SCHEMA)
