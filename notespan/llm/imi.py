"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised by its own codebook, so an entry
lies in the cell of a pair of centroids. A query's half products with the centroids
are sorted, and a heap visits pairs by their summed nearness until the visited
cells hold the share of entries that the index was tuned to. All entries there are
reranked by exact products.

Codebooks and share are fitted on at most ``SAMPLE`` vectors (those with the least
hash of their id): the share is the least that finds ``RECALL`` of the sample's own
nearest rows. All vectors are indexed. Cells lie together in blocks of ``BLOCK`` to
``LARGE`` entries, a larger cell in several, and queries are sent to the blocks of
the cells they visit with a bit for each of the block's cells, so no block outgrows a
task; a block's queries are streamed, and meet only the entries of their cells.

Defined cases: vectors that are null, zero, hold null or non-finite components, or
have another length than most take no part. Repeated rows of a vec_id are its one
vector if equal; a query never finds its own vec_id. Fewer than ``k`` candidates
are all returned; ties go to the smaller vec_id. No vectors, no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, stored

SAMPLE, RECALL, BLOCK, LARGE, LEAST_CENTROIDS, MOST_CENTROIDS, K = 16384, 0.94, 4096, 65536, 128, 1024, 20


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's centroids from k distinct rows."""
    rows = np.unique(x, axis=0)
    rng = np.random.Generator(np.random.PCG64(seed))
    c = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        a = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, a, x)
        n = np.bincount(a, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)


class Index:
    def __init__(self, one: np.ndarray, two: np.ndarray):
        self.one, self.two, self.half = one, two, one.shape[1]
        self.counts = np.zeros(len(one) * len(two), np.int64)
        self.share = 1.0

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.one) * len(self.two) + nearest(x[:, self.half :], self.two)

    def visit(self, q: np.ndarray, share: float) -> list[int]:
        """Cells by summed product, the best first, until they hold ``share`` of the entries."""
        s, t = self.one @ q[: self.half], self.two @ q[self.half :]
        i, j = np.argsort(-s, kind="stable"), np.argsort(-t, kind="stable")
        s, t = s[i].tolist(), t[j].tolist()
        i, j = i.tolist(), j.tolist()
        width, held, need = len(t), 0, share * float(self.counts.sum())
        heap, out, counts = [(-s[0] - t[0], 0, 0)], [], self.counts
        pop, push = heapq.heappop, heapq.heappush
        while heap and held < need:
            _, a, b = pop(heap)
            cell = i[a] * width + j[b]
            n = int(counts[cell])
            if n:
                out.append(cell)
                held += n
            # Row a advances by one; a row is opened by the first entry of the row before.
            if b + 1 < width:
                push(heap, (-s[a] - t[b + 1], a, b + 1))
            if b == 0 and a + 1 < len(s):
                push(heap, (-s[a + 1] - t[0], a + 1, 0))
        return out

    def tune(self, x: np.ndarray, k: int, recall: float, queries: int = 128) -> None:
        """The least share, in steps of a fiftieth, that finds ``recall`` of the sample's k nearest."""
        cell = self.cells(x)
        self.counts = np.bincount(cell, minlength=len(self.counts))
        qs = np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int)
        places, best = [], []
        for q in qs:
            score = x @ x[q]
            score[q] = -np.inf
            best.append(np.argsort(-score, kind="stable")[: min(k, len(x) - 1)])
            order = np.full(len(self.counts), len(self.counts))
            seen = self.visit(x[q], 1.0)
            order[seen] = (np.cumsum(self.counts[seen]) - self.counts[seen]) / len(x) * 1e6
            places.append(order[cell[best[-1]]])
        got = np.concatenate(places) / 1e6 if places else np.zeros(0)
        self.share = next((s for s in np.arange(1, 51) / 50 if not len(got) or (got < s).mean() >= recall), 1.0)


def usable(table: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that take part, and their length."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return (rows.filter(F.size("v") == top.n), top.n) if top else (rows, 0)


def build(rows: DataFrame, width: int, k: int = K, recall: float = RECALL) -> Index:
    n = rows.count()
    hashed = rows.select("v", F.xxhash64("vec_id").alias("o"), "vec_id")
    if n > 4 * SAMPLE:  # the least hashes lie below this bound; without it each part would send SAMPLE vectors to one task
        hashed = hashed.filter(F.col("o") < int(-(1 << 63) + (1 << 64) * 2 * SAMPLE / n))
    sample = hashed.orderBy("o", "vec_id", "v").limit(SAMPLE).select("v").toArrow()
    x = _matrix(sample.column("v").combine_chunks(), width)
    # Fine cells follow the vectors closely; more of them would cost the heap more than they save.
    size = min(MOST_CENTROIDS, max(LEAST_CENTROIDS, 2 ** round(np.log2(n**0.5 / 4))), max(2, len(x) // 8)) if n else 2
    half = max(1, width // 2)
    index = Index(codebook(x[:, :half], size), codebook(x[:, half:], size) if width > 1 else np.zeros((1, 0)))
    index.tune(x, k, recall)
    return index


FOUND = "query_id long, vec_id long, score double"


def _best(own: int, q: np.ndarray, at: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of the entries ``at`` of a block. Exact products are summed alike for all rows, so equal vectors tie."""
    s = x[at] @ q
    s[ids[at] == own] = -np.inf
    m = min(k, len(s))
    floor = -np.partition(-s, m - 1)[m - 1]
    keep = at[(s >= floor - 1e-9 * max(1.0, abs(floor))) & (s > -np.inf) if np.isfinite(floor) else s > -np.inf]
    exact = (x[keep] * q).sum(axis=1)
    order = np.lexsort((ids[keep], -exact))[:k]
    return ids[keep][order], exact[order]


def search(table: DataFrame, every: int = 20, k: int = K, recall: float = RECALL) -> DataFrame:
    """The k nearest rows of every row whose vec_id is divisible by ``every``, found in the cells that ``recall`` takes."""
    spark = table.sparkSession
    rows, width = usable(table)
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.dropDuplicates(["vec_id", "v"])
    index = build(rows, width, k, recall)
    books = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(books.value.cells(_matrix(b.column(1), width)))], names=["vec_id", "v", "cell"])

    entries = stored(rows.mapInArrow(place, "vec_id long, v array<double>, cell long"), "entries")
    count = entries.groupBy("cell").count().toArrow()  # at most MOST_CENTROIDS squared rows
    index.counts[:] = 0
    index.counts[count.column("cell").to_numpy()] = count.column("count").to_numpy()
    # Cells in order fill blocks; a cell of more than a block has blocks of its own. Larger blocks, fewer copies of queries.
    room = int(min(LARGE, max(BLOCK, index.counts.sum() // (4 * partitions(spark)))))
    first, chunks, lows, held = np.zeros(len(index.counts), np.int64), np.ones(len(index.counts), np.int64), [0], 0
    for c, n in enumerate(index.counts.tolist()):
        if n > room or held + n > room and held:
            if held:
                lows.append(c)
            lows[-1], held = c, 0
        first[c], held = len(lows) - 1, held + n
        if n > room:
            chunks[c] = -(-n // room)
            lows += [c] * (int(chunks[c]) - 1) + [c + 1]
            held = 0
    lows = np.array([*lows, len(index.counts)], np.int64)  # each block's first cell
    full = spark.sparkContext.broadcast((index, first, chunks, lows))

    def own_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, chunks, lows = full.value
        for b in batches:
            cell = b.column(2).to_numpy(zero_copy_only=False)
            spread = (b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            block = first[cell] + spread % chunks[cell]
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array((cell - lows[block]).astype(np.int32)), b.column(0), b.column(1), pa.nulls(b.num_rows, pa.binary())], names=["block", "cell", "id", "v", "cells"])

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, first, chunks, lows = full.value
        for b in batches:
            x = _matrix(b.column(1), width)
            block, row, cells = [], [], []
            for i in range(len(x)):
                seen = np.array(index.visit(x[i], index.share))
                mark = np.zeros(len(index.counts), bool)
                mark[seen] = True
                own = np.unique(np.concatenate([first[seen]] + [np.arange(first[c], first[c] + chunks[c]) for c in seen[chunks[seen] > 1]]))
                block.append(own)
                row.append(np.full(len(own), i))
                cells += [np.packbits(mark[lows[k] : max(lows[k + 1], lows[k] + 1)]).tobytes() for k in own]
            take = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(block)), pa.nulls(len(take), pa.int32()), b.column(0).take(take), b.column(1).take(take), pa.array(cells, pa.binary())], names=["block", "cell", "id", "v", "cells"])

    shape = "block long, cell int, id long, v array<double>, cells binary"
    queries = entries.filter(F.col("vec_id") % every == 0).repartition(partitions(spark), "vec_id")
    both = entries.mapInArrow(own_block, shape).unionByName(queries.select("vec_id", "v").mapInArrow(visited, shape))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        cell, ids, x = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width))
        for b in batches:
            blocks, asks = b.column(0).to_numpy(zero_copy_only=False), b.column(4).is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(blocks * 2 + asks, prepend=-1, append=-1))
            out: tuple[list, list, list] = ([], [], [])
            for lo, hi in zip(edges[:-1], edges[1:]):
                if blocks[lo] != now:
                    now, held = blocks[lo], []
                    cell, ids, x = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width))
                some = b.slice(lo, hi - lo)
                sid, v = some.column(2).to_numpy(zero_copy_only=False), _matrix(some.column(3), width)
                if not asks[lo]:
                    held.append((some.column(1).to_numpy(zero_copy_only=False).astype(np.int64), sid, v))
                    continue
                if held:
                    cell, ids, x = (np.concatenate([old, *new]) for old, new in zip((cell, ids, x), zip(*held)))
                    held = []
                for own, q, cells in zip(sid.tolist(), v, some.column(4).to_pylist()):
                    at = np.flatnonzero(np.unpackbits(np.frombuffer(cells, np.uint8))[cell]) if len(ids) else cell
                    if len(at):
                        found, score = _best(own, q, at, ids, x, k)
                        out[0].append(np.full(len(found), own))
                        out[1].append(found)
                        out[2].append(score)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    near = both.repartition(partitions(spark), "block").sortWithinPartitions("block", F.col("cells").isNotNull()).mapInArrow(rerank, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
