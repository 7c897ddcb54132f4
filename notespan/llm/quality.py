"""Quality by the votes of nearest labelled documents in a latent semantic space.

A document is a bag of terms, its words hashed to ``TERMS`` places, and a bag of word
forms: for every word its letter case, last character, length and whether it repeats
the word before it. Both are weighted by (1 + log count) * idf, brought to one length
each, and projected on the leading singular vectors of the labelled rows' matrix. The
labelled vectors, at most ``LABELLED`` of them, are broadcast; every document gets
exact cosines with all of them, block by block, and its ``NEIGHBOURS`` nearest vote with
their similarity.

Only labelled rows outside the held-out fold are learned from: the ``LABELLED``
with the least hash of their doc_id, a documented bound. The vocabulary is fixed.

Defined cases: a null text is empty; a text without words has no direction and
gets the labelled rows' mean label. A doc_id labelled more than once has the mean
of its labels; null labels are left out. Without usable labels every score is 1,
so that nothing is rejected. Repeated rows are rows. Ties in similarity go to the
row that comes first by hash. ``keep_good`` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks_by_bytes, release, small_batches, text_bytes
from .shingles import CHUNK, words

LABELLED, RANK, NEIGHBOURS, THRESHOLD, FOLDS = 8192, 32, 15, 0.3, 5
TERMS, ROWS = 1 << 14, 128
#: Entries of a sparse matrix that are multiplied at once.
CELLS = 1 << 15

_LAST = np.full(256, 11, np.int64)
_LAST[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
for _i, _c in enumerate(b".,!%&$*#|"):
    _LAST[_c] = _i + 1
_LAST[48:58] = 10
_UP, _LOW = np.zeros(256, np.int64), np.zeros(256, np.int64)
_UP[65:91] = 1
_LOW[97:123] = 1
_EDGES = np.array([1, 2, 4, 7, 11, 16, 25])
FORMS = 3 * 5 * 12 * 8
FEATURES = FORMS + TERMS


def forms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk of rows: their number, and row, feature (form, or term after all forms) and count of every feature that occurs."""
    raw, ends = text_bytes(column)
    for a, b in chunks_by_bytes(ends, CHUNK):
        part, cut = raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
        h, first, last, rows = words(part, cut)
        if not len(h):
            yield b - a, *(np.zeros(0, np.int64),) * 3
            continue
        up, low = np.add.reduceat(_UP[part], first), np.add.reduceat(_LOW[part], first)
        title = (_UP[part[first]] == 1) & (up == 1)
        case = np.select([up + low == 0, up == 0, title, low == 0], [0, 1, 2, 3], 4)
        owner = np.repeat(np.arange(b - a), np.diff(rows))
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        again = np.zeros(len(h), np.int64)
        again[same] = 1
        again[1:][same[1:] & same[:-1]] = 2
        length = np.searchsorted(_EDGES, last - first, "left")
        form = ((again * 5 + case) * 12 + _LAST[part[last - 1]]) * 8 + length
        term = FORMS + (h >> np.uint64(64 - TERMS.bit_length() + 1)).astype(np.int64)
        key, count = np.unique(np.concatenate([owner * FEATURES + form, owner * FEATURES + term]), return_counts=True)
        yield b - a, key // FEATURES, key % FEATURES, count


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """doc_id, text, y of at most ``bound`` rows that may be learned from."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).dropna().filter(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.avg("y").alias("y"), F.xxhash64(F.first("doc_id")).alias("o")).orderBy("o", "doc_id").limit(bound)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(usable.select("doc_id", "y")), "doc_id")  # bounded by ``bound`` rows of 16 bytes


def fit(docs: DataFrame, labels: DataFrame) -> tuple | None:
    """(idf, projection, labelled vectors, labels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for n, row, form, count in forms(b.column(1)):
                ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (form, count)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), b.column(2).slice(at, n), *lists], names=["doc_id", "y", "form", "count"])
                at += n

    # A doc_id in several rows counts once for each, so LABELLED bounds ids, and the rows are cut again here.
    sample = labelled_sample(docs, labels, "quality", LABELLED).mapInArrow(run, "doc_id long, y double, form array<int>, count array<int>")
    got = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "form", "count").limit(LABELLED).toArrow()
    if not got.num_rows:
        return None
    y = got.column("y").to_numpy()
    lists = [got.column(c).combine_chunks() for c in ("form", "count")]
    size = np.array([len(f) for f in lists[0]])
    form, count = (x.flatten().to_numpy() for x in lists)
    del got, lists  # the driver holds a few numbers an entry of the matrix, in 32 bits
    row = np.repeat(np.arange(len(y), dtype=np.int32), size)
    idf = np.log((1 + len(y)) / (1 + np.bincount(form, minlength=FEATURES))) + 0.1
    value = weighted(row, form, count, idf, len(y))
    project = leading(row, form, value, len(y))
    z = projected(row, form, value, project, len(y))
    size = np.linalg.norm(z, axis=1, keepdims=True)
    return idf, project.astype(np.float32), np.where(size > 0, z / np.maximum(size, 1e-12), 0).astype(np.float32), y.astype(np.float32)


def weighted(row: np.ndarray, form: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """(1 + log count) * idf, the forms and the terms of each row of length 1."""
    value = ((1 + np.log(count)) * idf[form]).astype(np.float32)
    half = 2 * row + (form >= FORMS)
    value /= np.sqrt(np.bincount(half, value * value, 2 * n)).astype(np.float32)[half]
    return value


def projected(row: np.ndarray, form: np.ndarray, value: np.ndarray, project: np.ndarray, n: int) -> np.ndarray:
    """The rows' sparse vectors (sorted by row) times ``project``; each row's sum is made alike wherever it stands."""
    z = np.zeros((n, project.shape[1]))
    ends = np.searchsorted(row, np.arange(n + 1))
    for a, b in chunks_by_bytes(ends, CELLS):
        lo, hi = ends[a], ends[b]
        some = np.flatnonzero(np.diff(ends[a : b + 1]))
        if len(some):
            z[a + some] = np.add.reduceat(project[form[lo:hi]] * value[lo:hi, None], ends[a + some] - lo)
    return z


def leading(row: np.ndarray, form: np.ndarray, value: np.ndarray, n: int, rounds: int = 6, seed: int = 11) -> np.ndarray:
    """The leading ``RANK`` right singular vectors of the sparse matrix, by seeded subspace iteration."""
    order = np.argsort(form, kind="stable")
    t_row, t_form, t_value = row[order], form[order], value[order]
    q = np.random.Generator(np.random.PCG64(seed)).normal(size=(FEATURES, RANK + 8))
    for _ in range(rounds):
        y = projected(row, form, value, q, n)
        q, _ = np.linalg.qr(projected(t_form, t_row, t_value, y, FEATURES))
    _, _, v = np.linalg.svd(projected(row, form, value, q, n), full_matrices=False)
    return (q @ v.T)[:, :RANK]


def _votes(z: np.ndarray, known: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Votes of the nearest known rows; of equally near ones the first in order count. Blocks have one shape, so a row's products don't depend on its neighbours."""
    k, n = min(NEIGHBOURS, len(y)), len(z)
    if n < ROWS:
        z = np.concatenate([z, np.zeros((ROWS - n, z.shape[1]), z.dtype)])
    like = (z @ known.T)[:n]
    if k < len(y):
        least = -np.partition(-like, k - 1, axis=1)[:, k - 1 : k]
        sure, tied = like > least, like == least
        take = sure | tied & (np.cumsum(tied, axis=1) <= k - sure.sum(axis=1, keepdims=True))
        top = np.nonzero(take)[1].reshape(n, k)
    else:
        top = np.tile(np.arange(k), (n, 1))
    w = np.maximum(np.take_along_axis(like, top, 1), 1e-6) ** 8
    return (w * y[top]).sum(axis=1) / w.sum(axis=1)


def scorer(docs: DataFrame, labels: DataFrame):
    """A function from an Arrow column of texts to their scores."""
    model = docs.sparkSession.sparkContext.broadcast(fit(small_batches(docs), labels))

    def scores(column: pa.Array) -> np.ndarray:
        if model.value is None:
            return np.ones(len(column))
        idf, project, known, y = model.value
        out = []
        for n, row, form, count in forms(column):
            z = projected(row, form, weighted(row, form, count, idf, n), project, n).astype(np.float32)
            size = np.linalg.norm(z, axis=1)
            score = np.full(n, y.mean(), np.float64)
            some = np.flatnonzero(size > 0)
            for a in range(0, len(some), ROWS):
                part = some[a : a + ROWS]
                score[part] = _votes(z[part] / size[part, None], known, y)
            out.append(score)
        return np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)

    return scores


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scores = scorer(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores(b.column(2)))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose predicted label is 1."""
    scores = scorer(docs, labels)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        found = pa.array(scores(text), pa.float64())
        release()
        return found

    return docs.filter(score(F.col("text")) >= THRESHOLD)
