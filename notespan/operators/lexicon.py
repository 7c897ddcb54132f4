"""Dictionary lookups of word runs: equi-joins of n-grams with lexicon tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tokens import ngrams

#: Lexicons of at most so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def sized(lexicon: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``lexicon`` marked for broadcast if it is small by count."""
    return F.broadcast(lexicon) if lexicon.limit(rows + 1).count() <= rows else lexicon


def longest(rules: DataFrame, words: str = "words") -> int:
    """Number of words of the longest entry."""
    return rules.agg(F.max(F.size(words))).first()[0] or 0


def ngram_match(sents: DataFrame, rules: DataFrame, form: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """NEG1: all places where a rule's words follow one another: ``ngrams`` columns and the rule's other columns.

    ``rules`` has ``words ARRAY<STRING>``. Hits may overlap.
    """
    most = longest(rules)
    if not most:
        most = 1
    keyed = rules.withColumn("gram", F.array_join("words", " ")).drop("words")
    heads = rules.select(F.get("words", F.lit(0)).alias("w")).distinct()
    grams = ngrams(sents, most, form)
    few = heads.limit(1001).collect()
    if len(few) <= 1000:  # a bounded list of first words is tested before runs are built
        firsts = [r.w for r in few]
        grams = ngrams(sents, most, form, lambda w: w.isin(firsts))
    return grams.join(sized(keyed), "gram")


def cascade(items: DataFrame, tiers: list[tuple[Column, DataFrame]], value: str) -> DataFrame:
    """Each item with ``value`` from the first tier (key expression, table of key and value) that knows its key, and the tier.

    One join a tier; a table's keys must be unique.
    """
    out = items
    for i, (key, table) in enumerate(tiers):
        t = table.select(F.col("key").alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
        out = out.withColumn(f"_q{i}", key).join(sized(t), F.col(f"_q{i}") == F.col(f"_k{i}"), "left")
    n = range(len(tiers))
    tier = F.coalesce(*[F.when(F.col(f"_v{i}").isNotNull(), i) for i in n])
    return out.withColumn(value, F.coalesce(*[F.col(f"_v{i}") for i in n])).withColumn("tier", tier).drop(*[f"_{c}{i}" for i in n for c in "kvq"])


def dense_ids(rows: DataFrame, column: str, name: str, first: int = 0) -> DataFrame:
    """``rows`` with consecutive ids in the order of a unique column, without one task sorting all of it.

    Counts by the column's first two characters, one row each, give where the ids of
    each such range begin.
    """
    keyed = rows.withColumn("_p", F.substring(column, 1, 2))
    n = keyed.groupBy("_p").count()
    base = n.select("_p", (F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + first).alias("_base"))
    at = F.row_number().over(Window.partitionBy("_p").orderBy(column)) - 1
    return keyed.withColumn("_i", at).join(sized(base), "_p").withColumn(name, (F.col("_base") + F.col("_i")).cast("int")).drop("_p", "_i", "_base")
