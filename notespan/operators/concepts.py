"""Concept recognition: dictionary tiers over token windows (CON) and the dictionary's build (BLD)."""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import STOPWORDS, is_punct_text, is_stopword, is_trivial
from .lexicon import sized
from .spans import inside

WINDOW = 6
SCORES = {"phrase": 1.0, "lower": 0.6, "norm": 0.3}
CONCEPT = ("sui", "cui", "tui", "source", "code")


def tagged_sentences(tokens: DataFrame) -> DataFrame:
    """doc_id, sent_id, tokens (array in order) from rows of tagged tokens: sent_id, tok_id, start, end, text, tag, norm, and maybe expansion.

    A sentence's tokens are gathered by key; sentences are short.
    """
    expansion = F.col("expansion") if "expansion" in tokens.columns else F.lit(None).cast("string")
    t = F.struct("tok_id", "start", "end", "text", "tag", "norm", expansion.alias("expansion"))
    return tokens.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(t)).alias("tokens"))


def _fit(t: Column) -> Column:
    """CON1: whether a token may begin or end a concept."""
    return ~(is_stopword(t["norm"]) | is_punct_text(t["text"]) | is_trivial(t["tag"]))


#: Beginnings of dictionary keys are tested before windows are made if there are at most so many.
FEW = 20_000


def _may_begin(tables: dict[str, DataFrame]):
    """Whether a key of the dictionary can begin with a token, as a function of it; None if the keys are too many to tell beforehand.

    A phrase begins with its first token's text or expansion, whatever the gap behind
    it; a bag holds the norm of its first token, as that is no stopword. What can't be
    told from the token alone passes.
    """
    phrases = tables["phrase"].select(F.lower("key").alias("k")).union(tables["lower"].select(F.lower("key").alias("k"))).filter("k IS NOT NULL").distinct()
    bags = tables["norm"].select(F.explode(F.split("key", " ")).alias("k")).distinct()
    some, norms = [r.k for r in phrases.limit(FEW + 1).collect()], [r.k for r in bags.limit(FEW + 1).collect()]
    heads = {x[:n] for x in some for n in range(len(x) + 1)} if len(some) <= FEW else set()
    if max(len(some), len(norms), len(heads)) > FEW or any(c in x for x in some for c in "σς"):  # small sigma changes with what follows
        return None
    within = lambda c: F.lower(c).isin(*sorted(heads))
    bag = lambda n: n.isin(*sorted(set(norms))) | n.contains(" ") | (F.ltrim(n, F.lit(string.punctuation)) == "")
    none = F.lit(False)
    return lambda t: F.coalesce(within(t["text"]), none) | F.coalesce(within(t["expansion"]), none) | F.coalesce(bag(t["norm"]), none)


def _ends(size: int, first: Callable[[Column], Column] | None = None) -> tuple[Column, Column]:
    """Places (from 1) where windows begin, and a function's column of those where one that begins at i ends."""
    n = F.size("tokens")
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    begin = F.filter(at, lambda i: F.element_at("fit", i) if first is None else F.element_at("heads", i))
    return begin, lambda i: F.filter(F.sequence(i, F.least(i + size - 1, n)), lambda j: F.element_at("fit", j))


def windows(sents: DataFrame, size: int = WINDOW) -> DataFrame:
    """CON1: doc_id, sent_id, start, end, words (structs) of runs of 1 to ``size`` tokens whose first and last may begin and end a concept."""
    begin, last = _ends(size)
    runs = F.flatten(F.transform(begin, lambda i: F.transform(last(i), lambda j: F.slice(F.col("tokens"), i, j - i + 1))))
    run = sents.withColumn("fit", F.transform("tokens", _fit)).select("doc_id", "sent_id", F.explode(runs).alias("words"))
    return run.select("doc_id", "sent_id", F.get("words", F.lit(0))["start"].alias("start"), F.element_at("words", -1)["end"].alias("end"), "words")


def bag_key(norms: Column) -> Column:
    """CON5: norms in order, without stopwords and marks."""
    return F.array_join(F.array_sort(F.filter(norms, lambda x: ~x.isin(*STOPWORDS) & ~is_punct_text(x))), " ")


def window_keys(sents: DataFrame, size: int = WINDOW, first: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, sent_id, start, end, n, tier, kind, key: all that is looked up for a window, made in one pass.

    Tier 0 is the words with the gaps between them (a blank for any gap), tier 1 the
    same with acronyms expanded, each as it is and in lower case; tier 2 the norm bag.
    Words are joined to their gaps once a sentence, and windows are slices of strings.
    Windows whose first token fails ``first`` aren't made, nor anything for sentences
    in which all do.
    """
    heads = F.array().cast("array<boolean>")
    if first is not None:
        heads = F.col("heads")
        sents = sents.withColumn("heads", F.transform("tokens", lambda t: first(t) & _fit(t))).filter(F.array_contains("heads", True))
    gap = lambda t, i: F.when(i == 0, "").otherwise(F.repeat(F.lit(" "), F.least(F.lit(1), F.greatest(F.lit(0), t["start"] - F.get("tokens", i - 1)["end"]))))
    full = lambda t: F.coalesce(t["expansion"], t["text"])
    one = sents.select(
        "doc_id",
        "sent_id",
        "tokens",
        heads.alias("heads"),
        F.transform("tokens", _fit).alias("fit"),
        F.transform("tokens", lambda t, i: F.concat(gap(t, i), t["text"])).alias("words"),
        F.when(F.exists("tokens", lambda t: t["expansion"].isNotNull()), F.transform("tokens", lambda t, i: F.concat(gap(t, i), full(t)))).alias("longer"),
        F.transform("tokens", lambda t: F.when(~t["norm"].isin(*STOPWORDS) & ~is_punct_text(t["norm"]), t["norm"])).alias("norms"),
    )
    begin, last = _ends(size, first)
    word = lambda i: F.element_at("tokens", i)

    def run(i: Column, j: Column) -> Column:
        n = j - i + 1
        rest = lambda c: F.array_join(F.slice(F.col(c), i + 1, n - 1), "")
        expanded = F.exists(F.slice("tokens", i, n), lambda t: t["expansion"].isNotNull())
        bag = F.array_join(F.array_sort(F.array_compact(F.slice("norms", i, n))), " ")
        return F.struct(
            word(i)["start"].alias("start"),
            word(j)["end"].alias("end"),
            n.alias("n"),
            F.concat(word(i)["text"], rest("words")).alias("text"),
            F.when(F.col("longer").isNotNull() & expanded, F.concat(full(word(i)), rest("longer"))).alias("longer"),
            F.when((n >= 2) & (word(j)["tag"] != "CD"), bag).alias("bag"),
        )

    runs = F.flatten(F.transform(begin, lambda i: F.transform(last(i), lambda j: run(i, j))))
    w = one.select("doc_id", "sent_id", F.explode(runs).alias("w")).select("doc_id", "sent_id", "w.*")
    keys = [(0, "phrase", F.col("text")), (0, "lower", F.lower("text")), (1, "phrase", F.col("longer")), (1, "lower", F.lower("longer")), (2, "norm", F.col("bag"))]
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(k).alias("kind"), c.alias("key")) for t, k, c in keys])).alias("k")
    return w.select("doc_id", "sent_id", "start", "end", "n", each).select("doc_id", "sent_id", "start", "end", "n", "k.*").filter("key IS NOT NULL")


def detect_concepts(sents: DataFrame, dictionary: dict[str, DataFrame], sources: DataFrame | None = None, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """CON1 to CON8: (concepts, terms) of ``tagged_sentences``.

    ``dictionary``: tables phrase, lower and norm of key and ``CONCEPT`` columns.
    Per span, exact and lower-case hits, else hits with acronyms expanded, else hits
    of the norm bag. A lone token with a lower-case hit only is a term without
    concept, and keeps later tiers out (Q4). All kinds are looked up by one join.
    """
    tables = [dictionary[k].select(F.lit(k).alias("kind"), "key", *CONCEPT, F.lit(s).alias("score")) for k, s in SCORES.items()]
    hits = window_keys(sents, size, _may_begin(dictionary)).join(sized(reduce(DataFrame.unionByName, tables)), ["kind", "key"])
    hits = hits.select("doc_id", "sent_id", "start", "end", "n", "tier", *CONCEPT, "score", ((F.col("kind") != "lower") | (F.col("n") > 1)).alias("shown"))
    w = Window.partitionBy("doc_id", "start", "end")
    hits = hits.withColumn("best", F.min("tier").over(w)).filter("tier = best")
    concepts = hits.filter("shown").select("doc_id", "start", "end", *CONCEPT, "score")
    if sources is not None:
        named = sources.select(F.col("source").alias("_s"), F.col("name").alias("_n"))
        concepts = concepts.join(sized(named), F.col("source") == F.col("_s"), "left").withColumn("source", F.coalesce("_n", F.lit("unknown"))).drop("_s", "_n")
    return concepts, hits.select("doc_id", "start", "end").distinct()


def with_cui(dictionary: DataFrame, cui: str) -> DataFrame:
    """CON9."""
    return dictionary.filter(F.col("cui") == cui)


def with_word(dictionary: DataFrame, part: str) -> DataFrame:
    """CON9: phrases that hold ``part``, in lower case."""
    return dictionary.filter(F.contains(F.lower("key"), F.lit(part.lower())))


def type_groups(concepts: DataFrame, groups: DataFrame) -> DataFrame:
    """CON10: concepts with the group of their semantic type (``groups``: grp, tui)."""
    return concepts.join(sized(groups.select("tui", "grp")), "tui", "left")


def medication_sentences(sents: DataFrame, concepts: DataFrame, tui: str = "T121") -> DataFrame:
    """CON11: sentences with a concept of the type, and the list of such concepts."""
    pair = inside(sents.select("doc_id", "start", "end"), concepts.filter(F.col("tui") == tui), 1024)
    c = F.array_sort(F.collect_list(F.struct(F.col("r_start").alias("start"), F.col("r_end").alias("end"), F.col("r_cui").alias("cui"))))
    return pair.groupBy("doc_id", "start", "end").agg(c.alias("concepts"))


# Build


def concept_types(mrsty: DataFrame, keep_tuis: DataFrame) -> DataFrame:
    """BLD1, BLD2: distinct cui, tui of wanted types."""
    return mrsty.select("cui", "tui").distinct().join(sized(keep_tuis.select("tui")), "tui", "left_semi")


def banned(mrconso: DataFrame, ban_ttys: DataFrame) -> DataFrame:
    """BLD3: strings' ids that are suppressed or of a banned term type (of English phrases of 3 characters or more)."""
    rows = mrconso.filter((F.col("lat") == "ENG") & (F.length("str") >= 3))
    bad = rows.join(sized(ban_ttys.select("tty")), "tty", "left_semi").select("sui").union(rows.filter("suppress <> 'N'").select("sui"))
    return bad.distinct()


def build_concepts(mrconso: DataFrame, mrsty: DataFrame, mrxns: DataFrame, keep_tuis: DataFrame, ban_ttys: DataFrame, drops: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """BLD3 to BLD7: the tables phrase, lower, norm (key and ``CONCEPT`` columns, source as an id) and sources (source, name).

    ``mrconso`` has ``line``, the row's number. ``drops`` may hold tables sui, cui,
    sui_cui and tui of what to leave out. Norm rows are distinct (Q11).
    """
    types = concept_types(mrsty, keep_tuis)
    ban = banned(mrconso, ban_ttys)
    rows = mrconso.filter((F.col("lat") == "ENG") & (F.length("str") >= 3) & (F.col("suppress") == "N")).join(sized(ban_ttys.select("tty")), "tty", "left_anti").join(types, "cui")
    for name, keys in {"sui": ["sui"], "cui": ["cui"], "sui_cui": ["sui", "cui"], "tui": ["tui"]}.items():
        if drops and name in drops:
            rows = rows.join(sized(drops[name].select(*keys)), keys, "left_anti")
    # Few vocabularies exist: ids by a rank over one row each.
    sources = rows.groupBy(F.col("sab").alias("name")).agg(F.min("line").alias("l")).withColumn("source", F.dense_rank().over(Window.orderBy("l")) - 1).select("source", "name")
    rows = rows.join(sized(sources.withColumnRenamed("name", "sab")), "sab").withColumn("code", F.substring("code", 1, 12))
    phrase = rows.select(F.col("str").alias("key"), *CONCEPT)
    norms = mrxns.filter(F.col("lat") == "ENG").filter(F.size(F.split("norm", " ")) >= 2).join(ban, "sui", "left_anti")
    norm = norms.select(F.array_join(F.array_sort(F.split("norm", " ")), " ").alias("key"), "cui", "sui").join(rows.select(*CONCEPT), ["cui", "sui"]).select("key", *CONCEPT).distinct()
    return {"phrase": phrase, "lower": phrase.withColumn("key", F.lower("key")), "norm": norm, "sources": sources}
