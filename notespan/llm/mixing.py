"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to). A pattern has as many words as its documents; taking them once costs nothing,
once more costs 1 a word, and so on (convex). Flow goes from patterns to the
sources they name, whose quotas it fills at least cost: all that single copies can
give, before any second one. Each pattern's documents are then taken in a seeded
order, up to its flow; only the last one in part.

Only the table of patterns reaches the driver. The seeded order is cut into 4096
buckets of the hash, so running sums are made inside (pattern, bucket) and no
pattern, however large, is sorted by one task.

Defined cases: null text has no words; a null source is a source of its own, last
in order; repeated rows are rows; ties in the seeded order go by doc_id, null
first, then by size. An empty table gives an empty result. Sources without words
have target 0. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, stored

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # of all words, as a fraction
MOST = 2  # times that a document, and a source, may be taken
MAX_PATTERNS = 1_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column, seed: str) -> Column:
    """60 bits of a seeded hash, as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> dict[str | None, tuple[float, int]]:
    """(target, whole quota) by source: shares by weight, the excess over ``most`` times a source's size reshared."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, open_, capped = sum(sizes.values()) * share[0], set(names), {}
    while True:
        left = total - share[1] * sum(capped.values())  # share[1] times the words to give
        rest = share[1] * sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] > most * sizes[s] * rest}
        if not over:
            break
        capped |= {s: most * sizes[s] for s in over}
        open_ -= over
    out = {s: (float(c), c) for s, c in capped.items()}
    return out | {s: (round(left * weight[s] / rest, 6), left * weight[s] // rest) for s in open_}


def route(supply: dict[tuple, int], quota: dict[str | None, int], most: int = MOST) -> dict[tuple, dict[str | None, int]]:
    """Min-cost flow of words from patterns to their sources: ``flow[pattern][source]``.

    The k-th copy of a pattern costs k - 1 a word, and only these arcs cost, so the
    cheapest augmenting paths of each cost are a maximum flow with one copy more.
    """
    flow: dict[tuple, dict] = {p: defaultdict(int) for p in supply}
    need = dict(quota)
    queue_open = object()  # None is a source
    takers: dict = defaultdict(set)
    for p in supply:
        for s in p:
            takers[s].add(p)
    for _ in range(most):
        spare = dict(supply)
        for p in sorted(spare, key=repr):
            while spare[p] > 0:  # breadth first from the pattern to an unfilled source
                came: dict = {p: None}
                queue, end = deque([p]), queue_open
                while queue and end is queue_open:
                    q = queue.popleft()
                    for s in q:
                        if ("s", s) in came:
                            continue
                        came["s", s] = q
                        if need.get(s, 0) > 0:
                            end = s
                            break
                        for r in takers[s]:
                            if r not in came and flow[r][s] > 0:
                                came[r] = s
                                queue.append(r)
                if end is queue_open:
                    break
                path, s = [], end
                while True:
                    q = came["s", s]
                    path.append((q, s))
                    if q == p:
                        break
                    s = came[q]
                    path.append((q, s, "back"))
                by = min([spare[p], need[end], *[flow[x[0]][x[1]] for x in path if len(x) == 3]])
                for x in path:
                    flow[x[0]][x[1]] += -by if len(x) == 3 else by
                spare[p] -= by
                need[end] -= by
    return {p: {s: n for s, n in f.items() if n} for p, f in flow.items()}


def mix(docs: DataFrame, sources: Column, seed: str = "mix", keep: tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """A row per document: doc_id, ``keep``, sources, size, source_size, target (of its first source), taken.

    ``sources`` is an array of the sources that a document belongs to.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.array_sort(F.array_distinct(sources)).alias("sources"), word_count(F.col("text")).alias("size"), order_key(F.col("doc_id"), seed).alias("h"))
    rows = stored(rows.withColumn("bucket", F.shiftright("h", 48).cast("int")), "sized")
    cells = rows.groupBy("sources", "bucket").agg(F.sum("size").alias("words"))
    patterns = cells.groupBy("sources").agg(F.sum("words").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    supply = {tuple(r.sources): r.words for r in patterns}
    sizes: dict = defaultdict(int)
    for p, n in supply.items():
        for s in p:
            sizes[s] += n
    goal = targets(sizes, weights, share, most) if sizes else {}
    flow = route(supply, {s: q for s, (_, q) in goal.items()}, most)
    plan = [(list(p), n, sum(flow[p].values()), sizes[p[0]] if p else 0, goal[p[0]][0] if p else 0.0) for p, n in supply.items()]
    plan = spark.createDataFrame(plan, "sources array<string>, pattern_words long, flow long, source_size long, target double")
    # The plan meets one row a bucket, never the documents, so a hot pattern is no hot key.
    before = Window.partitionBy("sources").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = cells.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).join(plan, "sources").drop("words")
    inner = Window.partitionBy("sources", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("c", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(start, ["sources", "bucket"]).withColumn("c", F.col("c") + F.col("base"))
    copies = [F.greatest(F.lit(0), F.least(F.col("size"), F.col("flow") - (F.col("c") + F.col("pattern_words") * k))) for k in range(most)]
    return placed.select("doc_id", *keep, "sources", "size", "source_size", "target", sum(copies[1:], copies[0]).cast("long").alias("taken"))



def repeated(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """``docs`` with each row as often as the mix takes it, the last part of a copy rounded; rows without words stay once.

    Rows that repeat doc_id and text share their copies evenly, rounded up.
    """
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    taken = mix(docs.select("doc_id", "source", "text", own.alias("mark")), F.array(F.col("source").cast("string")), seed, ("mark",))
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5))
    plan = taken.groupBy("doc_id", "mark").agg(F.ceil(F.sum(times) / F.count("*")).cast("int").alias("times")).filter("times > 0")
    plan = plan.select(F.col("doc_id").alias("id2"), F.col("mark").alias("mark2"), "times")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), own.alias("mark"), F.struct(*docs.columns).alias("whole"))
    rows = rows.join(plan, F.col("id").eqNullSafe(F.col("id2")) & (F.col("mark") == F.col("mark2")))
    return rows.select("whole", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).select("whole.*")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, 2 * source_size AS cap, row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS r FROM s
), q AS (
  SELECT *, 3 * (SELECT sum(source_size) FROM s)::BIGINT - 2 * (coalesce(sum(cap) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS lef,
         2 * sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest
  FROM o
), k AS (SELECT lef, rest, r FROM q WHERE lef * w <= cap * rest ORDER BY r LIMIT 1),
t AS (
  SELECT o.source, o.source_size,
         CASE WHEN k.r IS NULL OR o.r < k.r THEN o.cap::DOUBLE ELSE round((k.lef * o.w)::DOUBLE / k.rest, 6) END AS target,
         CASE WHEN k.r IS NULL OR o.r < k.r THEN o.cap ELSE (k.lef * o.w) // k.rest END::BIGINT AS quota
  FROM o LEFT JOIN k ON true
), c AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c FROM d
)
SELECT c.doc_id, c.size, t.source_size, t.target,
       (greatest(0, least(c.size, t.quota - c.c)) + greatest(0, least(c.size, t.quota - c.c - t.source_size)))::BIGINT AS taken
FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
"""
