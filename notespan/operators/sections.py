"""Section headers (SEC1), sampling (SMP) and metrics (MET)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spans import at


def header_pattern(lines: Iterable[str]) -> str:
    """SRC23: one pattern of all lines, with ^ and $ at every line end."""
    return "(?md)" + "|".join(x for x in lines if x)


def section_headers(sents: DataFrame, pattern: str, formats: DataFrame | None = None) -> DataFrame:
    """SEC1: doc_id, start, end of sentences that the pattern finds, or that are bold or underlined as a whole (``formats``: kind)."""
    found = sents.filter(F.col("text").rlike(pattern)).select("doc_id", "start", "end")
    if formats is not None:
        found = found.unionByName(at(sents.select("doc_id", "start", "end"), formats.filter(F.col("kind").isin("bold", "underlined"))))
    return found.distinct()


def sample_key(doc_id: Column, seed: int) -> Column:
    """A seeded order of documents that any engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string")))


def batches(docs: DataFrame, size: int = 100, seed: int = 0) -> DataFrame:
    """SMP1: documents with a batch number from 1, ``size`` a batch, in seeded order.

    Positions come from counts of 4096 hash ranges and an order inside each, so no
    task sorts all documents.
    """
    rows = docs.withColumn("_k", sample_key(F.col("doc_id"), seed)).withColumn("_r", F.substring("_k", 1, 3))
    n = rows.groupBy("_r").count()
    base = n.withColumn("_base", F.coalesce(F.sum("count").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")  # at most 4096 rows
    inner = F.row_number().over(Window.partitionBy("_r").orderBy("_k", "doc_id"))
    return rows.withColumn("_i", inner).join(F.broadcast(base), "_r").withColumn("batch", (F.floor((F.col("_base") + F.col("_i") - 1) / size) + 1).cast("long")).drop("_k", "_r", "_i", "_base")


def sample_n(docs: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """SMP2: ``n`` documents without replacement."""
    return docs.orderBy(sample_key(F.col("doc_id"), seed), "doc_id").limit(n)


def split(docs: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """SMP3: documents with part ``eval`` for about ``ratio`` of them, else ``train``; a document's part never changes."""
    share = F.conv(F.substring(sample_key(F.col("doc_id"), seed), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return docs.withColumn("part", F.when(share < ratio, "eval").otherwise("train"))


def split_blocks(blocks: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """SMP4: blocks (block_id) with part ``train`` for floor(ratio * n) of them in seeded order, else ``eval``."""
    top = int(ratio * blocks.count())
    chosen = batches(blocks.select(F.col("block_id").alias("doc_id")), 1, seed).filter(F.col("batch") <= top).select(F.col("doc_id").alias("block_id"), F.lit("train").alias("part"))
    return blocks.join(chosen, "block_id", "left").withColumn("part", F.coalesce("part", F.lit("eval")))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """MET4: precision, recall, F1; 0 where nothing is to divide by."""
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, ratio(2 * p * r, p + r)


def confusion(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """MET2: one row of tp, fp, fn, precision, recall, f1 of labels that agree in ``keys``; first-token scores take (doc_id, start)."""
    g, p = gold.select(*keys).distinct().withColumn("g", F.lit(1)), pred.select(*keys).distinct().withColumn("p", F.lit(1))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    both = g.join(p, keys, "full").agg(count(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), count(F.col("g").isNull()).alias("fp"), count(F.col("p").isNull()).alias("fn"))
    a, b, c = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return both.select("tp", "fp", "fn", a.alias("precision"), b.alias("recall"), c.alias("f1"))


def accuracy(gold: DataFrame, pred: DataFrame, place: list[str], field: str, mode: str = "equal") -> DataFrame:
    """MET1: share of gold labels met: by the one label there (``equal``), by ``any`` there, or by a label at that place (``location``)."""
    p = pred.select(*place, F.col(field).alias("_p"))
    p = p.groupBy(*place).agg(F.collect_set("_p").alias("_all"), F.first("_p").alias("_one"))
    hit = {"equal": F.col("_one") == F.col(field), "any": F.array_contains("_all", F.col(field)), "location": F.col("_all").isNotNull()}[mode]
    return gold.join(p, place, "left").agg(F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("accuracy"))


def attachment(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """MET3: uas and las by the spans of heads (rows: doc_id, start, end, head_start, head_end, deprel)."""
    k = ["doc_id", "start", "end"]
    p = pred.select(*k, F.col("head_start").alias("ps"), F.col("head_end").alias("pe"), F.col("deprel").alias("pr"))
    head = F.col("head_start").eqNullSafe(F.col("ps")) & F.col("head_end").eqNullSafe(F.col("pe")) & F.col("pr").isNotNull()
    return gold.join(p, k, "left").agg(F.avg(head.cast("double")).alias("uas"), F.avg((head & (F.col("deprel") == F.col("pr"))).cast("double")).alias("las"))


def attachment_in(sents: DataFrame, gold: Column, pred: Column) -> DataFrame:
    """MET3 for sentences whose row holds both annotations, arrays of (start, end, head_start, head_end, deprel): ``attachment`` without a shuffle.

    The words of a sentence have different places.
    """
    place = lambda g, p: (g["start"] == p["start"]) & (g["end"] == p["end"])
    head = lambda g, p: g["head_start"].eqNullSafe(p["head_start"]) & g["head_end"].eqNullSafe(p["head_end"]) & p["deprel"].isNotNull()
    rows = sents.select(gold.alias("_gold"), pred.alias("_pred"))
    rows = rows.withColumn("_same", (F.size("_gold") == F.size("_pred")) & F.forall(F.zip_with("_gold", "_pred", place), lambda x: F.coalesce(x, F.lit(False))))
    # Lists of the same places in the same order go word by word, others by lookup.
    other = F.transform("_gold", lambda g: F.struct(g.alias("g"), F.get(F.filter("_pred", lambda p: place(g, p)), F.lit(0)).alias("p")))
    pairs = F.when(F.col("_same"), F.zip_with("_gold", "_pred", lambda g, p: F.struct(g.alias("g"), p.alias("p")))).otherwise(other)
    met = rows.select(F.transform(pairs, lambda x: F.struct(head(x["g"], x["p"]).alias("h"), (x["g"]["deprel"] == x["p"]["deprel"]).alias("r"))).alias("m"))
    n = lambda f: F.coalesce(F.sum(F.size(F.filter("m", f))), F.lit(0))
    total = F.nullif(F.coalesce(F.sum(F.size("m")), F.lit(0)), F.lit(0))
    # A gold label that is null is neither right nor wrong where the head is right, as in an average.
    las = n(lambda x: x["h"] & F.coalesce(x["r"], F.lit(False)))
    known = F.nullif(n(lambda x: ~x["h"] | x["r"].isNotNull()), F.lit(0))
    return met.agg((n(lambda x: x["h"]) / total).alias("uas"), (las / known).alias("las"))
