"""Toxicity by a weighted finite-state pattern grammar over clauses.

Transducers in a cascade read the words of a text. The lexical one maps words to
symbols: insults (words or beginnings of words, weighted by how much oftener
toxic labelled documents hold them), threats, targets, negations, reporting words
and clause ends. A negation transducer and a reported-speech transducer, composed
into one table, mark insults in the scope of either. A clause automaton accepts
clauses with an insult, with a threat at a target, or with both, and their path
weights (plain, negated, reported, aimed at a target, threats) are summed over the
text. A logistic layer fitted to the labelled rows turns the sums into a score; it
is pulled towards the grammar's own weights where the labels say nothing.

The insult lexicon and the layer are learned from at most ``LABELLED`` labelled
rows outside the held-out fold; language, source and doc_id are never looked at.

Defined cases: a null text is empty; a text with no accepted clause gets the score
of no evidence. A doc_id labelled more than once counts with its mean label.
Without labels the lexicon is empty and every score is 0. Repeated rows are rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored
from .quality import held_out, labelled_sample

LABELLED, LEAST_DOCS, LEAST_G2, THRESHOLD = 20_000, 5, 30.0, 0.5
SHORTEST, LONGEST = 3, 9

_LEX = {
    "T": "kill hurt destroy beat stab shoot burn töten schlagen vernichten verletzen tuer frapper détruire blesser matar golpear destruir herir",
    "Y": "you your yours him his her them their dich dir euch ihn sie toi vous lui leur tu ti te vosotros él ella",
    "N": "not no never isn't aren't wasn't don't doesn't nicht kein keine nie ne jamais aucun nunca jamás ningún",
    "R": "said says say quoted called reported allegedly sagte sagt zitierte dit disait cité dijo dice citó",
}
WORDS = {w: s for s, ws in _LEX.items() for w in ws.split()}
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n]|[\"“”«»]")
SCOPE = 3  # words that a negation reaches

#: Grammar's own weights: bias, hits, weight of plain insults, density, negated, reported, aimed, threats.
PRIOR = np.array([-3.0, 0.5, 1.0, 0.2, -0.5, -0.5, 0.5, 1.5])

Table = dict[tuple[object, str], tuple[object, str]]


def negation() -> Table:
    """Insults within SCOPE words of a negation in the same clause come out as i."""
    t: Table = {}
    for s in range(SCOPE + 1):
        t |= {(s, a): (max(0, s - 1), a) for a in "OTYRQ"}
        t |= {(s, "N"): (SCOPE, "O"), (s, "I"): (max(0, s - 1), "i" if s else "I"), (s, "B"): (0, "B")}
    return t


def reporting() -> Table:
    """Insults after a reporting word in the clause, or inside quotation marks, come out as r."""
    t: Table = {}
    for s in ((q, r) for q in (0, 1) for r in (0, 1)):
        heard = s != (0, 0)
        t |= {(s, a): (s, a) for a in "OTYi"}
        t |= {(s, "I"): (s, "r" if heard else "I"), (s, "R"): ((s[0], 1), "O"), (s, "Q"): ((1 - s[0], s[1]), "O"), (s, "B"): ((s[0], 0), "B")}
    return t


def compose(a: Table, b: Table) -> Table:
    """The transducer that passes a's output to b."""
    return {((s, u), x): ((s2, b[u, y][0]), b[u, y][1]) for (s, x), (s2, y) in a.items() for u in {k[0] for k in b} if (u, y) in b}


CASCADE, START = compose(negation(), reporting()), (0, (0, 0))


class Grammar:
    def __init__(self, insults: dict[str, float]):
        """``insults`` maps beginnings of words, or whole words ended by $, to weights."""
        self.insults = insults
        self.cache: dict[str, tuple[str, float]] = {}
        self.finder = ahocorasick.Automaton()
        for p in insults:
            self.finder.add_word(p.rstrip("$"), 1)
        for w, s in WORDS.items():
            if s == "T":
                self.finder.add_word(w, 1)
        self.finder.make_automaton()

    def symbol(self, token: str) -> tuple[str, float]:
        found = self.cache.get(token)
        if found is None:
            if token in ".!?;:\n":
                found = ("B", 0.0)
            elif token in "\"“”«»":
                found = ("Q", 0.0)
            else:
                w = max([self.insults.get(token + "$", 0.0)] + [self.insults.get(token[:k], 0.0) for k in range(SHORTEST, LONGEST + 1)])
                found = ("I", w) if w else (WORDS.get(token, "O"), 0.0)
            if len(self.cache) >= 300_000:
                self.cache.clear()
            self.cache[token] = found
        return found

    def clauses(self, text: str) -> Iterator[dict]:
        """Accepted clauses with their path weights."""
        state, sums, begun = START, dict.fromkeys("Iir", 0.0), 0
        threat = target = hits = 0
        for m in [*_TOKEN.finditer(text), None]:
            x, w = self.symbol(m.group()) if m else ("B", 0.0)
            state, y = CASCADE[state, x]
            if y == "B":
                if hits or threat and target:
                    yield {"start": begun, "end": m.start() if m else len(text), "hits": hits, "plain": sums["I"], "negated": sums["i"], "reported": sums["r"], "aimed": sums["I"] if target else 0.0, "threat": float(bool(threat and target))}
                sums, begun = dict.fromkeys("Iir", 0.0), m.end() if m else 0
                threat = target = hits = 0
            elif y in sums:
                sums[y] += w
                hits += 1
            else:
                threat += y == "T"
                target += y == "Y"

    def features(self, text: str) -> list[float]:
        low = text.lower()
        if not low or next(self.finder.iter(low), None) is None:
            return [1.0] + [0.0] * 7
        found = list(self.clauses(low))
        total = {k: sum(c[k] for c in found) for k in ("hits", "plain", "negated", "reported", "aimed", "threat")}
        size = 20 + low.count(" ")
        return [1.0, *np.log1p([total["hits"], total["plain"], 100 * total["plain"] / size, total["negated"], total["reported"], total["aimed"], total["threat"]])]


def lexicon(sample: DataFrame) -> dict[str, float]:
    """Beginnings of words, and whole words, that toxic rows hold oftener; by documents, not by occurrences."""
    low = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))
    beginnings = F.concat(F.array(F.concat("w", F.lit("$"))), F.when(F.length("w") >= SHORTEST, F.transform(F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length("w"))), lambda k: F.substring(F.col("w"), F.lit(1), k))).otherwise(F.array().cast("array<string>")))
    words = sample.select("y", F.explode(low).alias("w")).groupBy("w").agg(F.sum("y").alias("k1"), F.sum(1 - F.col("y")).alias("k0"))
    parts = words.select("k1", "k0", F.explode(beginnings).alias("p")).groupBy("p").agg(F.sum("k1").alias("k1"), F.sum("k0").alias("k0")).filter(F.col("k1") >= LEAST_DOCS)
    total = words.agg(F.sum("k1"), F.sum("k0")).first()
    if not total or not total[0] or not total[1]:
        return {}
    n1, n0 = float(total[0]), float(total[1])
    k1, k0 = F.col("k1"), F.col("k0")
    e = (k1 + k0) / (n1 + n0)
    g2 = 2 * (k1 * F.log(k1 / (n1 * e)) + F.when(k0 > 0, k0 * F.log(k0 / (n0 * e))).otherwise(0.0))
    weight = F.log((k1 + 0.5) / n1) - F.log((k0 + 0.5) / n0)
    best = parts.select("p", weight.alias("weight"), g2.alias("g2")).filter((F.col("weight") > 1) & (F.col("g2") >= LEAST_G2)).orderBy(F.desc("g2"), F.desc(F.length("p")), "p").limit(5000).collect()
    out: dict[str, float] = {}
    for r in best:
        p = r.p.rstrip("$")
        if not any(p.startswith(q.rstrip("$")) or q.startswith(p) for q in out):
            out[r.p] = r.weight
    return out


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, ridge: float = 0.5) -> np.ndarray:
    """Newton steps with a pull towards ``prior``."""
    b = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (p - y) + ridge * (b - prior)
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], np.ndarray] | None:


    sample = stored(labelled_sample(docs, labels, "toxic", LABELLED), "labelled")
    insults = lexicon(sample)
    if not insults:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(insults)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([grammar.features(t or "") for t in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    got = sample.select("text", "y").mapInArrow(run, "x array<double>, y double").orderBy("x", "y").limit(LABELLED).toArrow()
    return insults, logistic(np.array(got.column("x").to_pylist()), got.column("y").to_numpy())



def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(small_batches(docs), labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.value[0]) if model.value else None
        for b in batches:
            if grammar is None:
                score = np.zeros(b.num_rows)
            else:
                x = np.array([grammar.features(t or "") for t in b.column(2).to_pylist()])
                score = 1 / (1 + np.exp(-np.clip(x @ model.value[1], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
