"""Part-of-speech tagging by a trigram hidden Markov model: training (TRN) and decoding (POS)."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import suffixes
from ..sources.storage import stored
from .tokens import gathered, texts_of

SUFFIX, RARE, BEAM, LEAST_TO_PRUNE = 5, 20, 2.0, 10
#: The tables of a trained model.
TABLES = ("uni", "bi", "tri", "lambdas", "known", "suffix")


def _capital(text) -> F.Column:
    return F.substring(text, 1, 1).rlike(r"^\p{Lu}$")


def states(tagged: DataFrame) -> DataFrame:
    """doc_id, sent_id, tok_id, s (tag with a mark of capitals) and the two states before it; sentences begin with BBS, BOS."""
    s = F.concat("tag", F.when(_capital(F.col("text")), "+").otherwise("-"))
    w = Window.partitionBy("doc_id", "sent_id").orderBy("tok_id")
    one = tagged.withColumn("s", s)
    # The sentence's own marks stand before its first token.
    first = F.coalesce(F.lag("s", 1).over(w), F.lit("BOS-"))
    second = F.coalesce(F.lag("s", 2).over(w), F.when(F.row_number().over(w) == 1, "BBS-").otherwise("BOS-"))
    return one.select("doc_id", "sent_id", "tok_id", second.alias("s1"), first.alias("s2"), F.col("s").alias("s3"))


def gram_counts(tagged: DataFrame) -> dict[str, DataFrame]:
    """TRN1: counts of states, pairs and triples; ends of sentences aren't counted (Q2)."""
    tri = stored(states(tagged).groupBy("s1", "s2", "s3").agg(F.count("*").alias("c3")), "triples")
    starts = tri.filter("s1 = 'BBS-'").agg(F.coalesce(F.sum("c3"), F.lit(0)).alias("n"))  # one such triple a sentence
    bi = tri.groupBy("s2", "s3").agg(F.sum("c3").alias("c2")).unionByName(starts.select(F.lit("BBS-").alias("s2"), F.lit("BOS-").alias("s3"), F.col("n").alias("c2")))
    mark = starts.select(F.explode(F.array(F.lit("BBS-"), F.lit("BOS-"))).alias("s3"), F.col("n").alias("c1"))
    uni = tri.groupBy("s3").agg(F.sum("c3").alias("c1")).unionByName(mark)
    return {"uni": uni, "bi": bi, "tri": tri}


def mle(counts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """TRN2: relative frequencies; 0 where the denominator is 0."""
    uni, bi, tri = counts["uni"], counts["bi"], counts["tri"]
    n = uni.agg(F.sum("c1").alias("n"))
    p1 = uni.crossJoin(F.broadcast(n)).select("s3", "c1", (F.col("c1") / F.col("n")).alias("p1"))  # one row
    p2 = bi.join(uni.select(F.col("s3").alias("s2"), F.col("c1").alias("d")), "s2", "left").select("s2", "s3", "c2", F.coalesce(F.col("c2") / F.nullif("d", F.lit(0)), F.lit(0.0)).alias("p2"))
    p3 = tri.join(bi.select(F.col("s2").alias("s1"), F.col("s3").alias("s2"), F.col("c2").alias("d")), ["s1", "s2"], "left").select("s1", "s2", "s3", "c3", F.coalesce(F.col("c3") / F.nullif("d", F.lit(0)), F.lit(0.0)).alias("p3"))
    return {"uni": p1, "bi": p2, "tri": p3}


def interpolation(counts: dict[str, DataFrame]) -> DataFrame:
    """TRN3: one row of l1, l2, l3 by deleted interpolation; ties favour triples, then pairs."""
    uni, bi, tri = counts["uni"], counts["bi"], counts["tri"]
    n = uni.agg(F.sum("c1").alias("n"))
    j = tri.join(bi.select(F.col("s2").alias("s1"), F.col("s3").alias("s2"), F.col("c2").alias("d3")), ["s1", "s2"], "left").join(bi.select("s2", "s3", "c2"), ["s2", "s3"], "left")
    j = j.join(uni.select(F.col("s3").alias("s2"), F.col("c1").alias("d2")), "s2", "left").join(uni, "s3", "left").crossJoin(F.broadcast(n))  # one row
    left_out = lambda c, d: F.coalesce((F.col(c) - 1) / F.nullif(F.col(d) - 1, F.lit(0)), F.lit(0.0))
    j = j.select("c3", left_out("c3", "d3").alias("r3"), left_out("c2", "d2").alias("r2"), left_out("c1", "n").alias("r1"))
    own = F.when((F.col("r3") >= F.col("r2")) & (F.col("r3") >= F.col("r1")), 3).when(F.col("r2") >= F.col("r1"), 2).otherwise(1)
    total = F.sum("c3")
    return j.withColumn("o", own).agg(*[(F.coalesce(F.sum(F.when(F.col("o") == k, F.col("c3"))), F.lit(0)) / total).alias(f"l{k}") for k in (1, 2, 3)])


def word_counts(tagged: DataFrame, most: int | None = None) -> DataFrame:
    """TRN4: cap, word (lower case), tag, c; with ``most`` only words of at most so many occurrences."""
    c = tagged.groupBy(_capital(F.col("text")).alias("cap"), F.lower("text").alias("word"), "tag").agg(F.count("*").alias("c"))
    return c if most is None else rare_words(c, most)


def rare_words(c: DataFrame, most: int) -> DataFrame:
    return c.withColumn("n", F.sum("c").over(Window.partitionBy("cap", "word"))).filter(F.col("n") <= most).drop("n")


def known_words(tagged: DataFrame) -> DataFrame:
    """POS3: cap, word, tag, logp = log10(c(word, tag) / c(tag)) within the words of that case."""
    return _known(stored(word_counts(tagged), "words"))


def _known(c: DataFrame) -> DataFrame:
    t = c.groupBy("cap", "tag").agg(F.sum("c").alias("n"))
    return c.join(t, ["cap", "tag"]).select("cap", "word", "tag", F.log10(F.col("c") / F.col("n")).alias("logp"))


def suffix_model(tagged: DataFrame, most: int = RARE, length: int = SUFFIX) -> DataFrame:
    """TRN5: cap, suffix, tag, logp from rare words: tag shares smoothed from the empty suffix to the longest, then inverted.

    A step's weight is the standard deviation of tag shares among suffixes of its
    own length (Q9), and the result doesn't depend on the order of words.
    """
    return _suffixes(word_counts(tagged, most), length)


def _suffixes(rare: DataFrame, length: int) -> DataFrame:
    """One row a suffix with its counts by tag in an array, folded level by level from the parent suffix."""
    s = rare.select("cap", "tag", "c", F.explode(suffixes(F.col("word"), length)).alias("suffix")).groupBy("cap", "suffix", "tag").agg(F.sum("c").alias("c"))
    s = stored(s, "suffixes")
    tags = sorted(r.tag for r in s.filter("suffix = ''").select("tag").distinct().collect())  # a tag set
    count = F.array(*[F.coalesce(F.sum(F.when(F.col("tag") == t, F.col("c"))), F.lit(0)).cast("double") for t in tags]).alias("count")
    one = stored(s.groupBy("cap", "suffix").agg(count, F.sum("c").alias("n")), "suffix counts")
    by_length = {(r.cap, r.k): r["sum"] for r in one.groupBy("cap", F.length("suffix").alias("k")).agg(F.array(*[F.sum(F.get("count", F.lit(i))) for i in range(len(tags))]).alias("sum")).collect()}  # a row a length

    def weight(cap: bool, k: int) -> float:
        """TRN5: standard deviation of the tags' shares among suffixes of one length."""
        sums = [x for x in by_length.get((cap, k), ()) if x]
        shares = [x / sum(sums) for x in sums]
        mean = sum(shares) / len(shares) if shares else 0.0
        return math.sqrt(sum((x - mean) ** 2 for x in shares) / (len(shares) - 1)) if len(shares) > 1 else 0.0

    share = F.transform("count", lambda x: x / F.col("n"))
    level = one.filter("suffix = ''").select("cap", "suffix", F.col("n").alias("t"), share.alias("p0"), share.alias("p"), "n")
    levels = []
    for k in range(1, length + 1):
        w = F.when(F.col("cap"), weight(True, k)).otherwise(weight(False, k))
        parent = level.select(F.col("cap").alias("_cap"), F.col("suffix").alias("_suffix"), "t", "p0", F.col("p").alias("_p"))
        own = one.filter(F.length("suffix") == k)
        folded = F.transform(F.arrays_zip("count", "_p"), lambda x: (x["count"] / F.col("n") + w * x["_p"]) / (1 + w))
        level = own.join(parent, (F.col("cap") == F.col("_cap")) & (F.substring("suffix", 2, length) == F.col("_suffix"))).select("cap", "suffix", "t", "p0", folded.alias("p"), "n")
        level = stored(level, f"level {k}")
        levels.append(level)
    out = reduce(DataFrame.unionByName, levels)
    each = F.posexplode(F.arrays_zip("p", "p0")).alias("i", "x")
    name = F.array(*map(F.lit, tags)) if tags else F.array().cast("array<string>")
    out = out.select("cap", "suffix", "n", "t", each).filter("x.p > 0 AND x.p0 > 0")
    return out.select("cap", "suffix", F.get(name, F.col("i")).alias("tag"), F.log10(F.col("x.p") * F.col("n") / F.col("t") / F.col("x.p0")).alias("logp"))


def train(tagged: DataFrame, most: int = RARE, length: int = SUFFIX) -> dict[str, DataFrame]:
    """TRN6: all tables of the model: uni, bi, tri, lambdas, known, suffix."""
    counts, words = gram_counts(tagged), stored(word_counts(tagged), "words")
    return mle(counts) | {"lambdas": interpolation(counts), "known": _known(words), "suffix": _suffixes(rare_words(words, most), length)}


@dataclass
class Model:
    """POS2 to POS5 as plain tables for the decoder; the model's size is that of a tag set and a word list."""

    uni: dict[str, float] = field(default_factory=dict)
    bi: dict[tuple[str, str], float] = field(default_factory=dict)
    tri: dict[tuple[str, str, str], float] = field(default_factory=dict)
    lambdas: tuple[float, float, float] = (1.0, 0.0, 0.0)
    known: dict[tuple[bool, str], dict[str, float]] = field(default_factory=dict)
    suffix: dict[tuple[bool, str], dict[str, float]] = field(default_factory=dict)
    length: int = SUFFIX
    steps: dict[tuple[str, str, str], float] = field(default_factory=dict)  # transitions that came up
    seen: dict[str, dict[str, float]] = field(default_factory=dict)  # words that came up

    @classmethod
    def load(cls, tables: dict[str, DataFrame], most_rows: int = 5_000_000) -> "Model":
        """From the trained tables, whose rows are counted before they come to the driver."""
        tables = {name: stored(t, name) for name, t in tables.items()}  # any of TABLES; those left out stay empty
        for name, t in tables.items():
            if t.count() > most_rows:
                raise ValueError(f"table {name} has more than {most_rows} rows")

        def rows(name: str, *columns: str) -> Iterator[tuple]:
            got = tables[name].select(*columns).toArrow()
            return zip(*(got.column(c).to_pylist() for c in columns))

        m = cls()
        m.uni = dict(rows("uni", "s3", "p1"))
        m.bi = {(b, c): p for b, c, p in rows("bi", "s2", "s3", "p2")}
        m.tri = {(a, b, c): p for a, b, c, p in rows("tri", "s1", "s2", "s3", "p3")}
        m.lambdas = tuple(tables["lambdas"].select("l1", "l2", "l3").first())
        for cap, word, tag, logp in rows("known", "cap", "word", "tag", "logp") if "known" in tables else ():
            m.known.setdefault((cap, word), {})[tag] = logp
        for cap, suffix, tag, logp in rows("suffix", "cap", "suffix", "tag", "logp") if "suffix" in tables else ():
            m.suffix.setdefault((cap, suffix), {})[tag] = logp
        return m

    def transition(self, a: str, b: str, c: str) -> float:
        """POS5: log10 of the interpolated probability."""
        l1, l2, l3 = self.lambdas
        p = l1 * self.uni.get(c, 0.0) + l2 * self.bi.get((b, c), 0.0) + l3 * self.tri.get((a, b, c), 0.0)
        return math.log10(p) if p > 0 else -math.inf

    def emissions(self, word: str) -> dict[str, float]:
        """POS2, POS4, POS9: the first word list that knows the word, lower case first (Q8); else its longest known suffix."""
        low, cap = word.lower(), word[:1].isupper()
        for c in (False, True):
            if found := self.known.get((c, low)):
                return found
        for k in range(min(self.length, len(low)), -1, -1):
            if found := self.suffix.get((cap, low[len(low) - k :])):
                return found
        return {}

    def decode(self, words: list[str], beam: float = BEAM) -> list[str | None]:
        """POS6 to POS8: second-order Viterbi with a beam; a word that no path can take is skipped, without a tag.

        Paths are states of the last two tags; the end of the sentence has no weight (Q2).
        """
        paths: dict[tuple[str, str], tuple[float, tuple]] = {("BBS-", "BOS-"): (0.0, ())}
        for word in words:
            mark = "+" if word[:1].isupper() else "-"
            grown: dict[tuple[str, str], tuple[float, tuple]] = {}
            found = self.seen.get(word)
            if found is None:
                if len(self.seen) >= 200_000:
                    self.seen.clear()
                found = self.seen[word] = self.emissions(word)
            for tag, e in found.items():
                s = tag + mark
                for (a, b), (p, back) in paths.items():
                    step = self.steps.get((a, b, s))
                    if step is None:
                        step = self.steps[a, b, s] = self.transition(a, b, s)
                    q = p + e + step
                    if q > -math.inf and ((b, s) not in grown or q >= grown[b, s][0]):
                        grown[b, s] = (q, (tag, back))
            if not grown:
                paths = {k: (p, (None, back)) for k, (p, back) in paths.items()}
                continue
            if len(grown) >= LEAST_TO_PRUNE:
                floor = max(p for p, _ in grown.values()) - beam
                grown = {k: v for k, v in grown.items() if v[0] >= floor}
            paths = grown
        back = max(paths.items(), key=lambda x: (x[1][0], x[0]))[1][1]
        out = []
        while back:
            out.append(back[0])
            back = back[1]
        return out[::-1]


def _frequent(tables: dict[str, DataFrame], most: int) -> Model:
    """The tables of states, whose size is that of a tag set, and the tags of about ``most`` frequent words in both of their lists."""
    known = tables["known"]
    top = known.groupBy("word").agg(F.max("logp").alias("m")).orderBy(F.desc("m"), "word").limit(most).select("word")
    return Model.load({name: tables[name] for name in ("uni", "bi", "tri", "lambdas")} | {"known": known.join(F.broadcast(top), "word", "left_semi")}, 2**63 - 1)


def emission_lists(words: DataFrame, tables: dict[str, DataFrame], length: int = SUFFIX) -> DataFrame:
    """POS2, POS4, POS9 as joins: word (distinct) with its tags and their logp as arrays; a word that nothing knows has none.

    The first word list that knows the word, lower case first (Q8), else its longest
    known suffix. No table has to fit into a worker.
    """
    both = lambda keys, t: t.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("tag", "logp"))).alias("e"))
    cap = F.coalesce(_capital(F.col("word")), F.lit(False))
    known = both(["word"], tables["known"].select("word", F.struct("cap", "tag").alias("tag"), "logp"))
    # Of both lists the one in lower case comes first.
    of = lambda c: F.transform(F.filter("e", lambda x: x["tag"]["cap"] == c), lambda x: F.struct(x["tag"]["tag"].alias("tag"), x["logp"].alias("logp")))
    known = known.select(F.col("word").alias("_w"), F.when(F.exists("e", lambda x: ~x["tag"]["cap"]), of(F.lit(False))).otherwise(of(F.lit(True))).alias("e"))
    one = words.select("word", F.lower("word").alias("_low"), cap.alias("_cap"))
    found = one.join(known, F.col("_low") == F.col("_w"), "left").drop("_w")
    lost = found.filter("e IS NULL").select("word", "_cap", F.explode(suffixes(F.col("_low"), length)).alias("_s"))
    table = both(["cap", "suffix"], tables["suffix"]).withColumnRenamed("e", "_e")
    by_suffix = lost.join(table, (F.col("_cap") == F.col("cap")) & (F.col("_s") == F.col("suffix"))).groupBy("word").agg(F.max_by("_e", F.length("_s")).alias("e"))
    return found.filter("e IS NOT NULL").select("word", "e").unionByName(by_suffix)


def tag_by_tables(sents: DataFrame, tables: dict[str, DataFrame], beam: float = BEAM, drop_single_char_final: bool = False, length: int = SUFFIX, share: int = 1 << 20, frequent: int = 200_000) -> DataFrame:
    """POS1 as ``tag``, for a model whose word lists needn't fit into a worker.

    Stretches of sentences of about ``share`` characters meet their other words' tags,
    which a join brings to them once a stretch; every worker knows the ``frequent``
    words, so these go through no shuffle.
    """
    tables = {name: stored(t, name) for name, t in tables.items()}
    model = sents.sparkSession.sparkContext.broadcast(_frequent(tables, frequent))
    kinds = pa.schema([("part", pa.string()), ("doc_id", pa.int64()), ("sent_id", pa.int32()), ("size", pa.int32()), ("start", pa.list_(pa.int32())), ("end", pa.list_(pa.int32())), ("text", pa.list_(pa.string())), ("other", pa.list_(pa.string()))])
    schema = "part string, doc_id long, sent_id int, size int, start array<int>, end array<int>, text array<string>, other array<string>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        name, held, known, asked = uuid.uuid4().hex, 0, model.value.known, set()
        for b in batches:
            for doc, sent, start, end, text in texts_of(b):
                a, z, w = list(start), list(end), list(text)
                _last_token(a, z, w, drop_single_char_final)
                held += sum(map(len, w)) + len(w)
                other = [x for x in dict.fromkeys(w) if x not in asked and (False, low := x.lower()) not in known and (True, low) not in known]
                asked.update(other)
                yield name, doc, sent, len(w), a, z, w, other
                if held >= share:
                    name, held, asked = uuid.uuid4().hex, 0, set()

    t = F.col("tokens")
    parts = sents.select("doc_id", "sent_id", t["start"].alias("a"), t["end"].alias("z"), t["text"].alias("w")).mapInArrow(lambda b: gathered(cut(b), kinds, 1024), schema)
    parts = stored(parts, "stretches")  # read twice, with the same names of stretches
    words = parts.select("part", F.explode("other").alias("word"))  # once a stretch each
    lists = emission_lists(words.select("word").distinct(), tables, length)
    words = words.join(lists, "word").groupBy("part").agg(F.collect_list(F.struct("word", F.col("e.tag").alias("tag"), F.col("e.logp").alias("logp"))).alias("words"))
    rows = parts.groupBy("part").agg(F.collect_list(F.struct("doc_id", "sent_id", "start", "end", "text")).alias("sents")).join(words, "part", "left").select("sents", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        m = model.value
        for b in batches:
            for sentences, known in texts_of(b, 1):
                given = {x["word"]: dict(zip(x["tag"], x["logp"])) for x in known or ()}
                for s in sentences:
                    w = s["text"]
                    m.seen = {x: given[x] if x in given else m.emissions(x) for x in w}
                    for k, (a, z, x, t) in enumerate(zip(s["start"], s["end"], w, m.decode(w, beam))):
                        yield s["doc_id"], s["sent_id"], k, a, z, x, t

    out = pa.schema(list(zip("doc_id sent_id tok_id start end text tag".split(), (pa.int64(), *[pa.int32()] * 4, pa.string(), pa.string()))))
    return rows.mapInArrow(lambda b: gathered(run(b), out), "doc_id long, sent_id int, tok_id int, start int, end int, text string, tag string")


def _last_token(a: list[int], z: list[int], w: list[str], drop_single_char_final: bool) -> None:
    """POS1a, Q1: parts a final mark from the last token, or drops a last token of one character."""
    if w:
        t = w[-1]
        if len(t) > 1 and t[-1] in ".!?":
            w[-1:] = [t[:-1], t[-1]]
            a.append(z[-1] - 1)
            z[-1:] = [z[-1] - 1, z[-1]]
        elif len(t) == 1 and drop_single_char_final:
            a.pop()
            z.pop()
            w.pop()


def tag(sents: DataFrame, model: Model, beam: float = BEAM, drop_single_char_final: bool = False) -> DataFrame:
    """POS1: doc_id, sent_id, tok_id, start, end, text, tag of the tokens of sentences.

    A final . ! or ? is parted from the last token (POS1a). With
    ``drop_single_char_final`` a last token of one character is dropped (Q1).
    """
    shared = sents.sparkSession.sparkContext.broadcast(model)  # bounded by Model.load

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in (b.slice(lo, 1024) for b in batches for lo in range(0, b.num_rows, 1024)):
            # Columns of tokens, not a dictionary for each of them.
            lists = b.column(2)
            flat, off = lists.flatten(), lists.offsets.to_numpy()
            off = off - off[0]
            first, last, words = flat.field(0).to_pylist(), flat.field(1).to_pylist(), flat.field(2).to_pylist()
            size, start, end, text, tags = [], [], [], [], []
            for lo, hi in zip(off[:-1].tolist(), off[1:].tolist()):
                a, z, w = first[lo:hi], last[lo:hi], words[lo:hi]
                _last_token(a, z, w, drop_single_char_final)
                size.append(len(w))
                start += a
                end += z
                text += w
                tags += model.decode(w, beam)
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            at = pa.array(row)
            cols = [b.column(0).take(at), b.column(1).take(at), pa.array(place.astype(np.int32)), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(text, pa.string()), pa.array(tags, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names="doc_id sent_id tok_id start end text tag".split())

    return sents.select("doc_id", "sent_id", "tokens").mapInArrow(run, "doc_id long, sent_id int, tok_id int, start int, end int, text string, tag string")
