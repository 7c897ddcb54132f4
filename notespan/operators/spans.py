"""Span algebra (S1 to S10) between label tables keyed by doc_id.

Each is an equi-join on doc_id with the range as a residual condition. With
``width`` set, both sides are keyed by a bucket of positions too, so a document of
any length spreads over tasks and only labels of the same stretch meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    return left, r


def _joined(left: DataFrame, right: DataFrame, on: Column, width: int | None, how: str = "inner") -> DataFrame:
    """``right``'s columns come out prefixed r_."""
    a, b = _sides(left, right)
    if width is None or how != "inner":
        return a.join(b, (F.col("doc_id") == F.col("r_doc_id")) & on, how)
    # Overlapping labels share a bucket; a pair is kept in the first bucket that both touch.
    stretch = lambda s, e: F.explode(F.sequence(F.floor(s / width), F.floor(F.greatest(s, e - 1) / width)))
    a = a.withColumn("_b", stretch(F.col("start"), F.col("end")))
    b = b.withColumn("_rb", stretch(F.col("r_start"), F.col("r_end")))
    first = F.greatest(F.floor(F.col("start") / width), F.floor(F.col("r_start") / width))
    return a.join(b, (F.col("doc_id") == F.col("r_doc_id")) & (F.col("_b") == F.col("_rb")) & (F.col("_b") == first) & on).drop("_b", "_rb")


def inside(outer: DataFrame, inner: DataFrame, width: int | None = None) -> DataFrame:
    """Pairs where the right label lies in the left one."""
    return _joined(outer, inner, (F.col("r_start") >= F.col("start")) & (F.col("r_end") <= F.col("end")), width)


def covering(inner: DataFrame, outer: DataFrame, width: int | None = None) -> DataFrame:
    """Pairs where the right label covers the left one."""
    return _joined(inner, outer, (F.col("r_start") <= F.col("start")) & (F.col("r_end") >= F.col("end")), width)


def covers(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """S3."""
    return (s1 <= s2) & (e1 >= e2)


def at(labels: DataFrame, others: DataFrame, anti: bool = False) -> DataFrame:
    """Labels that have a label of the same span among ``others``, or with ``anti`` that have none."""
    return labels.join(others.select("doc_id", "start", "end"), ["doc_id", "start", "end"], "left_anti" if anti else "left_semi")


def first_at(labels: DataFrame, others: DataFrame, *order: str) -> DataFrame:
    """Each label with the first of ``others`` at its span, or null; its columns prefixed r_."""
    rest = [c for c in others.columns if c not in ("doc_id", "start", "end")]
    one = others.groupBy("doc_id", "start", "end").agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_f"))
    return labels.join(one, ["doc_id", "start", "end"], "left").select(*labels.columns, *[F.col(f"_f.{c}").alias(f"r_{c}") for c in rest])


def backward(labels: DataFrame, others: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs with labels that end before, ranked from the nearest (rank 0)."""
    n, i = F.col("_n"), F.col("_i")
    return _near(labels, others, ["r_end", "r_start"], F.col("start"), 0, most, lambda m: (F.greatest(n - m, F.lit(0)), n - 1) if m else (F.lit(0), n - 1), n - 1 - i)


def forward(labels: DataFrame, others: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs with labels that start after, ranked from the nearest (rank 0)."""
    n, i, top = F.col("_n"), F.col("_i"), F.col("_all")
    return _near(labels, others, ["r_start", "r_end"], F.col("end"), 1, most, lambda m: (n, F.least(n + m, top) - 1) if m else (n, top - 1), i - n)


def _near(labels: DataFrame, others: DataFrame, order: list[str], edge: Column, first: int, most: int | None, span, rank: Column) -> DataFrame:
    """Others are numbered in their document's order; a label counts those on its near side and meets only the numbers it asks for.

    One ordered window over both tables, then an equi-join, so no pairs are made that
    aren't returned. ``first`` puts labels before (0: counts others up to the edge) or
    behind others at the same place.
    """
    r = others.select(*[F.col(c).alias(f"r_{c}") for c in others.columns])
    number = Window.partitionBy("r_doc_id").orderBy(*order)
    r = r.withColumn("_i", F.row_number().over(number) - 1)
    marks = labels.select("doc_id", edge.alias("_at"), F.lit(1 - first).alias("_k"), F.lit(0).alias("_o"), F.struct(*labels.columns).alias("_l"))
    both = marks.unionByName(r.select(F.col("r_doc_id").alias("doc_id"), F.col(order[0]).alias("_at"), F.lit(first).alias("_k"), F.lit(1).alias("_o"), F.lit(None).cast(marks.schema["_l"].dataType).alias("_l")))
    doc = Window.partitionBy("doc_id")
    before = F.sum("_o").over(doc.orderBy("_at", "_k").rangeBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    lab = both.withColumn("_n", before).withColumn("_all", F.sum("_o").over(doc).cast("int")).filter("_o = 0").select("_l.*", "_n", "_all")
    lo, hi = span(most)
    asked = lab.filter(lo <= hi).withColumn("_j", F.explode(F.sequence(lo, hi)))
    out = asked.join(r, (F.col("doc_id") == F.col("r_doc_id")) & (F.col("_j") == F.col("_i")))
    return out.withColumn("rank", rank.cast("int")).drop("_n", "_all", "_j", "_i")


def first(labels: DataFrame, *group: str) -> DataFrame:
    """The earliest label of each group (of each document without one)."""
    keys = group or ("doc_id",)
    one = labels.groupBy(*keys).agg(F.min(F.struct("start", "end", *[c for c in labels.columns if c not in (*keys, "start", "end")])).alias("_f"))
    return one.select(*keys, "_f.*").select(*labels.columns)


def counts(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Each outer label with the number of inner labels in it."""
    n = inside(outer, inner).groupBy("doc_id", "start", "end").agg(F.count("*").alias("n"))
    return outer.join(n, ["doc_id", "start", "end"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> tuple[Column, Column]:
    """Whether the first span straddles the second's left edge, and its right edge."""
    return (s1 <= s2) & (s2 < e1), (s1 < e2) & (e2 <= e1)
