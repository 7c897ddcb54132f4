"""Normalised word forms (NRM)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexicon import sized

#: (category, agreement pattern, tag, tag of the fallback row)
AGREEMENT = (
    ("noun", r"^(un)?count\(thr_plur\)$", "NNS", "NN"),
    ("noun", r"^(un)?count\(thr_sing\)$", "NN", "NNS"),
    ("verb", r"^infinitive$", "VB", None),
    ("verb", r"^pres\(thr_sing\)$", "VBZ", None),
    ("verb", r"^past$", "VBD", None),
    ("verb", r"^past_part$", "VBN", None),
    ("verb", r"^pres_part$", "VBG", None),
    ("adj", r"^positive$", "JJ", None),
    ("adj", r"^comparative$", "JJR", None),
    ("adj", r"^superlative$", "JJS", None),
    ("adv", r"^positive$", "RB", None),
    ("adv", r"^comparative$", "RBR", None),
    ("adv", r"^superlative$", "RBS", None),
)


def normalize(tokens: DataFrame, norms: DataFrame) -> DataFrame:
    """NRM1: tokens (text, tag) with norm: by word and tag, else the word in lower case."""
    table = norms.select(F.col("term").alias("_term"), F.col("tag").alias("_tag"), F.col("norm").alias("_norm"))
    return tokens.join(sized(table), (F.col("text") == F.col("_term")) & (F.col("tag") == F.col("_tag")), "left").withColumn("norm", F.coalesce("_norm", F.lower("text"))).drop("_term", "_tag", "_norm")


def build_norms(lragr: DataFrame) -> DataFrame:
    """NRM2: term, tag, norm from inflection rows (line, variant, category, agreement, base); the last row of a key wins.

    Variants with marks or digits, of over 100 characters, or that end in their base (Q32), are left out.
    """
    rows = lragr.filter(~F.col("variant").rlike(r"[|$#,@;:<>?\[\]{}\d.]") & (F.length("variant") <= 100) & ~F.endswith(F.col("variant"), F.col("base")))
    both = F.array()
    tag = fallback = F.lit(None).cast("string")
    for category, pattern, t, f in reversed(AGREEMENT):
        hit = (F.col("category") == category) & F.col("agreement").rlike(pattern)
        tag = F.when(hit, t).otherwise(tag)
        fallback = F.when(hit, f).otherwise(fallback)
    both = F.explode(F.array(F.struct(F.lit(0).alias("o"), tag.alias("tag")), F.struct(F.lit(1).alias("o"), fallback.alias("tag"))))
    keyed = rows.select("line", "variant", "base", both.alias("k")).select("line", "variant", "base", "k.o", "k.tag").filter("tag IS NOT NULL")
    return keyed.groupBy(F.col("variant").alias("term"), "tag").agg(F.max_by("base", F.struct("line", "o")).alias("norm"))
