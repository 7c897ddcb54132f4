"""Pipelines of stages over label tables, their configuration, and a command line (API)."""

from __future__ import annotations

import argparse
import json
import os
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import acronyms, concepts, negation, norms, rtf, sections, spans, tagging, tokens
from ..sources import readers, writers
from ..sources.storage import stored

Labels = dict[str, DataFrame]
Stage = Callable[[Labels, dict], Labels]


@dataclass
class Lexicons:
    """Models and word lists as tables; a stage whose tables are missing is left out."""

    units: frozenset[str] = tokens.UNITS
    tagger: tagging.Model | None = None
    norms: DataFrame | None = None
    expansions: DataFrame | None = None
    vocab: DataFrame | None = None
    vectors: DataFrame | None = None
    concepts: dict[str, DataFrame] = field(default_factory=dict)
    sources: DataFrame | None = None
    rules: DataFrame | None = None
    cues: DataFrame | None = None
    headers: str | None = None
    longforms: DataFrame | None = None
    letters: tuple[DataFrame, DataFrame] | None = None
    parser: Callable[[list[str]], list[tuple[int, str, str]]] | None = None

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Lexicons":
        """What of ``TABLES`` lies in the folder, as ``build_models`` or ``writers.write_model`` put it there."""
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(root):
            raise FileNotFoundError(path)
        t = {n: spark.read.parquet(f"{path}/{n}") for n in TABLES if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}"))}
        out = cls(**{n: t.get(n) for n in ("norms", "expansions", "vocab", "vectors", "sources", "rules", "cues", "longforms")})
        if all(n in t for n in tagging.TABLES):
            out.tagger = tagging.Model.load({n: t[n] for n in tagging.TABLES})
        if all(n in t for n in concepts.SCORES):
            out.concepts = {n: t[n] for n in concepts.SCORES}
        if "abbreviation_letters" in t and "longform_letters" in t:
            out.letters = (t["abbreviation_letters"], t["longform_letters"])
        if "units" in t:
            out.units = frozenset(r.unit for r in t["units"].collect())
        if "headers" in t:
            out.headers = t["headers"].first().pattern
        return out


#: Tables of a models folder.
TABLES = ("norms", "expansions", "vocab", "vectors", "sources", "rules", "cues", "longforms", *tagging.TABLES, *concepts.SCORES, "abbreviation_letters", "longform_letters", "units", "headers")


def build_models(spark: SparkSession, path: str, **files: str) -> list[str]:
    """Builds a models folder from source files by name; what was written.

    rules, headers, expansions: files of those lexicons; lragr: inflections; treebank:
    a folder of bracketed trees; mrconso, mrsty, mrxns with tuis and ttys: a terminology.
    """
    tables: dict[str, DataFrame] = {}
    if "rules" in files:
        tables["rules"] = readers.read_rules(spark, files["rules"])
    if "headers" in files:
        tables["headers"] = spark.createDataFrame([(readers.read_patterns(spark, files["headers"]),)], "pattern string")
    if "expansions" in files:
        tables["expansions"] = readers.read_expansions(spark, files["expansions"])
        tables["longforms"] = tables["expansions"].select(F.col("sense").alias("longform")).distinct()
        tables["abbreviation_letters"] = acronyms.train_trigrams(tables["expansions"].select(F.col("acronym").alias("word")))
        tables["longform_letters"] = acronyms.train_trigrams(tables["longforms"].select(F.explode(F.split("longform", r"\s+")).alias("word")).filter("word <> ''"))
    if "lragr" in files:
        tables["norms"] = norms.build_norms(readers.read_lragr(spark, files["lragr"]))
    if "treebank" in files:
        texts = readers.read_texts(spark, files["treebank"], "*").withColumn("doc_id", F.xxhash64("event_id"))
        tables |= tagging.train(readers.parse_ptb(texts))
    if "mrconso" in files:
        tuis, ttys = readers.read_list(spark, files["tuis"], "tui"), readers.read_list(spark, files["ttys"], "tty")
        tables |= concepts.build_concepts(readers.read_mrconso(spark, files["mrconso"]), readers.read_mrsty(spark, files["mrsty"]), readers.read_mrxns(spark, files["mrxns"]), tuis, ttys)
    writers.write_model(tables, path)
    return sorted(tables)


def sentences(x: Labels, o: dict) -> Labels:
    split = {"lines": tokens.line_sentences, "segments": tokens.segments}[o.get("split", "lines")]
    return {"sentences": tokens.sentences(x["documents"], split, tokens.ptb_words(o["lexicons"].units))}


def pos_tags(x: Labels, o: dict) -> Labels:
    m = o["lexicons"].tagger
    return {"pos_tags": tagging.tag(x["sentences"], m, o.get("beam", tagging.BEAM))} if m else {}


def acronym_labels(x: Labels, o: dict) -> Labels:
    lex = o["lexicons"]
    if "pos_tags" not in x or lex.expansions is None:
        return {}
    words = tokens.tokens(x["documents"], tokens.edge_words)
    cands = acronyms.acronym_tokens(acronyms.candidates(words, x["pos_tags"], WIDTH), lex.expansions, lex.letters, lex.longforms)
    spark = words.sparkSession
    vocab = lex.vocab if lex.vocab is not None else spark.createDataFrame([], "word string, word_id int")
    vectors = lex.vectors if lex.vectors is not None else spark.createDataFrame([], "sense string, word_id int, weight double")
    scored = acronyms.score_senses(words, cands, lex.expansions, vocab, vectors, o.get("cutoff", acronyms.CUTOFF), longforms=lex.longforms if o.get("use_alignment", False) else None)
    out = {"acronyms": acronyms.best_senses(scored)}
    return out | {"all_acronym_senses": scored} if o.get("label_other_senses", True) else out


def concept_labels(x: Labels, o: dict) -> Labels:
    lex = o["lexicons"]
    if "pos_tags" not in x or not lex.concepts:
        return {}
    tagged = x["pos_tags"]
    tagged = norms.normalize(tagged, lex.norms) if lex.norms is not None else tagged.withColumn("norm", F.lower("text"))
    if "acronyms" in x:
        tagged = tagged.join(x["acronyms"].select("doc_id", "start", "end", "expansion"), ["doc_id", "start", "end"], "left")
    found, terms = concepts.detect_concepts(concepts.tagged_sentences(tagged), lex.concepts, lex.sources, o.get("window", concepts.WINDOW))
    return {"norm_forms": tagged.select("doc_id", "start", "end", "norm"), "umls_concepts": found, "umls_terms": terms}


def negex_labels(x: Labels, o: dict) -> Labels:
    lex, terms = o["lexicons"], x.get(o.get("terms_index", "umls_terms"))
    if terms is None or lex.rules is None:
        return {}
    s = tokens.sentences(x["documents"], tokens.line_sentences, tokens.unicode_words)
    return {"negated": negation.negex(s, terms, lex.rules, o.get("token_range", negation.RANGE)), "negation_triggers": negation.triggers(s, lex.rules)}


def tagged_tokens(x: Labels) -> DataFrame:
    """Sentences whose tokens carry their tags, where there are tags."""
    if "pos_tags" not in x:
        return x["sentences"]
    t = F.array_sort(F.collect_list(F.struct("tok_id", "start", "end", "text", "tag")))
    one = x["pos_tags"].groupBy("doc_id", "sent_id").agg(t.alias("tokens"))
    return x["sentences"].drop("tokens").join(one, ["doc_id", "sent_id"])


def dependency_labels(x: Labels, o: dict) -> Labels:
    """DEP3, DEP4: parses of the sentences that hold a term and a trigger, by the parser that is plugged in."""
    lex, terms = o["lexicons"], x.get(o.get("terms_index", "umls_terms"))
    if lex.parser is None or terms is None or "negation_triggers" not in x:
        return {}
    chosen = negation.selected_sentences(x["sentences"], terms, x["negation_triggers"].select("doc_id", "start", "end"))
    return {"dependencies": negation.parse_dependencies(chosen, lex.parser)}


def deepen_labels(x: Labels, o: dict) -> Labels:
    """DEP1: terms whose negation the parse affirms; the others in ``negated`` are ``affirmed`` by none."""
    terms = x.get(o.get("terms_index", "umls_terms"))
    if "dependencies" not in x or terms is None:
        return {}
    place = x["sentences"].select("doc_id", "sent_id", "start", "end")
    within = spans.covering(terms.select("doc_id", "start", "end").distinct(), place, WIDTH).select("doc_id", F.col("r_sent_id").alias("sent_id"), "start", "end")
    trig = x["negation_triggers"].select("doc_id", "start", "end", "tag")
    trig = spans.covering(trig, place, WIDTH).select("doc_id", F.col("r_sent_id").alias("sent_id"), "start", "end", "tag")
    return {"dependency_negated": negation.deepen(within, trig, x["dependencies"])}


def modification_labels(x: Labels, o: dict) -> Labels:
    lex, terms = o["lexicons"], x.get(o.get("terms_index", "umls_terms"))
    if terms is None:
        return {}
    cues = lex.cues if lex.cues is not None else x["documents"].sparkSession.createDataFrame(negation.cue_table(), "side string, kind string, words array<string>")
    return {"modifications": negation.modifications(tagged_tokens(x), terms, cues, o.get("cue_scan", "reference"), tags="pos_tags" in x)}


def section_labels(x: Labels, o: dict) -> Labels:
    pattern = o["lexicons"].headers
    return {"section_headers": sections.section_headers(x["sentences"], pattern, x.get("formats"))} if pattern else {}


STAGES: dict[str, Stage] = {
    "sentences": sentences,
    "pos_tags": pos_tags,
    "acronyms": acronym_labels,
    "concepts": concept_labels,
    "negex": negex_labels,
    "dependencies": dependency_labels,
    "deepen": deepen_labels,
    "modification": modification_labels,
    "sections": section_labels,
}
DEFAULT = ("sentences", "pos_tags", "acronyms", "concepts", "negex", "sections")
FULL = tuple(STAGES)
#: Width of the buckets of positions by which spans of long documents are joined.
WIDTH = 1024

#: API12: what each stage reads, writes and takes.
ABOUT: dict[str, dict[str, list[str]]] = {
    "sentences": {"inputs": ["documents"], "outputs": ["sentences"], "parameters": ["split"]},
    "pos_tags": {"inputs": ["sentences"], "outputs": ["pos_tags"], "parameters": ["beam"]},
    "acronyms": {"inputs": ["documents", "pos_tags"], "outputs": ["acronyms", "all_acronym_senses"], "parameters": ["cutoff", "label_other_senses", "use_alignment"]},
    "concepts": {"inputs": ["pos_tags", "acronyms"], "outputs": ["norm_forms", "umls_concepts", "umls_terms"], "parameters": ["window"]},
    "negex": {"inputs": ["documents", "umls_terms"], "outputs": ["negated", "negation_triggers"], "parameters": ["terms_index", "token_range"]},
    "dependencies": {"inputs": ["sentences", "umls_terms", "negation_triggers"], "outputs": ["dependencies"], "parameters": ["terms_index"]},
    "deepen": {"inputs": ["sentences", "umls_terms", "negation_triggers", "dependencies"], "outputs": ["dependency_negated"], "parameters": ["terms_index"]},
    "modification": {"inputs": ["sentences", "pos_tags", "umls_terms"], "outputs": ["modifications"], "parameters": ["terms_index", "cue_scan"]},
    "sections": {"inputs": ["sentences", "formats"], "outputs": ["section_headers"], "parameters": []},
}


def document_stage(name: str, each: Callable[[str], list[tuple]], schema: str, on_error: str = "fail") -> Stage:
    """API6: a stage of a function from a document's text to rows of ``schema`` (after doc_id).

    With ``on_error`` skip, a document on which it raises has no rows; with record, it
    has a row in the labels ``<name>_errors`` (doc_id, error), and the others go on.
    """
    if on_error not in ("fail", "skip", "record"):
        raise ValueError(f"on_error is fail, skip or record, not {on_error}")

    def stage(x: Labels, o: dict) -> Labels:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for i, text in zip(b["doc_id"], b["text"]):
                    try:
                        out += [(i, None, *r) for r in each(text or "")]
                    except Exception as e:  # noqa: BLE001  (the policy is the caller's)
                        if on_error == "fail":
                            raise
                        out.append((i, f"{type(e).__name__}: {e}", *[None] * width))
                yield pd.DataFrame(out, columns=names)

        names = ["doc_id", "_error", *[c.split()[0] for c in schema.split(", ")]]
        width = len(names) - 2
        rows = x["documents"].select(F.col("doc_id").cast("long"), "text").mapInPandas(run, f"doc_id long, _error string, {schema}")
        if on_error == "record":
            rows = stored(rows, name)
        found = {name: rows.filter("_error IS NULL").drop("_error")}
        return found | ({f"{name}_errors": rows.filter("_error IS NOT NULL").select("doc_id", F.col("_error").alias("error"))} if on_error == "record" else {})

    return stage


@dataclass
class Pipeline:
    """API1, API9: stages run in order on ``documents`` (doc_id, text); each sees the labels of those before it.

    ``options`` holds the stages' parameters by name. User stages (API6) are any
    function from labels and options to labels.
    """

    stages: list[tuple[str, Stage]]
    lexicons: Lexicons = field(default_factory=Lexicons)
    options: dict[str, dict] = field(default_factory=dict)

    def transform(self, docs: DataFrame, formats: DataFrame | None = None) -> Labels:
        labels: Labels = {"documents": docs} | ({"formats": formats} if formats is not None else {})
        for name, stage in self.stages:
            labels |= stage(labels, {"lexicons": self.lexicons} | self.options.get(name, {}))
        return labels

    def timed(self, docs: DataFrame, formats: DataFrame | None = None) -> tuple[Labels, list[dict]]:
        """SNK7: the labels, each stage written to shared storage as it ends, and rows of stage, seconds and labels made."""
        labels: Labels = {"documents": docs} | ({"formats": formats} if formats is not None else {})
        times = []
        for name, stage in self.stages:
            began = time.monotonic()
            made = {n: stored(df, n) for n, df in stage(labels, {"lexicons": self.lexicons} | self.options.get(name, {})).items()}
            times.append({"stage": name, "seconds": time.monotonic() - began, "labels": sum(df.count() for df in made.values())})
            labels |= made
        return labels, times


def create(lexicons: Lexicons | None = None, names: tuple[str, ...] = DEFAULT, extra: dict[str, Stage] | None = None, **options: dict) -> Pipeline:
    known = STAGES | (extra or {})
    return Pipeline([(n, known[n]) for n in names], lexicons or Lexicons(), options)


_VARIABLE = re.compile(r"\$\{?(\w+)\}?")


def flat(config: dict, prefix: str = "") -> dict[str, object]:
    """API10, D24: nested settings as dotted keys, with environment variables filled in."""
    out: dict[str, object] = {}
    for k, v in config.items():
        key = f"{prefix}{k}"
        if isinstance(v, dict):
            out |= flat(v, f"{key}.")
        else:
            out[key] = _VARIABLE.sub(lambda m: os.environ.get(m[1], m[0]), v) if isinstance(v, str) else v
    return out


def load_config(*paths: str, **given: object) -> dict[str, object]:
    """Settings of files in order, later ones over earlier, then ``given``."""
    import yaml

    out: dict[str, object] = {}
    for p in paths:
        with open(p) as f:
            out |= flat(yaml.safe_load(f) or {})
    return out | given


def from_yaml(path: str, lexicons: Lexicons | None = None, extra: dict[str, Stage] | None = None) -> Pipeline:
    """API2: ``components`` lists stages by name, each with its ``params``.

    Keys of how processes are run (``mp_config``, addresses) mean nothing to a plan and
    are passed over; ``error_handlers`` are the business of ``document_stage``.
    """
    import yaml

    with open(path) as f:
        parts = yaml.safe_load(f)["components"]
    unknown = [p["name"] for p in parts if p["name"] not in STAGES | (extra or {})]
    if unknown:
        raise ValueError(f"unknown components: {', '.join(unknown)}")
    return create(lexicons, tuple(p["name"] for p in parts), extra, **{p["name"]: p.get("params") or {} for p in parts})


def catalog() -> list[dict]:
    """API12: the stages there are, with their inputs, outputs and parameters."""
    return [{"name": n, "function": s.__name__} | ABOUT[n] for n, s in STAGES.items()]


SOURCES = ("rules", "headers", "expansions", "lragr", "treebank", "mrconso", "mrsty", "mrxns", "tuis", "ttys")


def main(args: list[str] | None = None) -> None:
    """API3: ``run`` and ``run-rtf-to-text`` over a folder, ``build-models``, ``write-config``, ``metadata``."""
    p = argparse.ArgumentParser(prog="notespan")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "run-rtf-to-text"):
        c = sub.add_parser(name)
        c.add_argument("input")
        c.add_argument("output")
        c.add_argument("--rtf", action="store_true")
        c.add_argument("--glob")
        c.add_argument("--config")
        c.add_argument("--models", help="a folder of tables, see build-models")
        c.add_argument("--include-label-text", action="store_true")
        c.add_argument("--format", choices=("lines", *writers.FORMATS), default="json", help="a file an event, or JSON lines in part files")
        c.add_argument("--times", action="store_true", help="print each stage's seconds")
    b = sub.add_parser("build-models")
    b.add_argument("output")
    for name in SOURCES:
        b.add_argument(f"--{name}")
    sub.add_parser("write-config").add_argument("output")
    sub.add_parser("metadata").add_argument("output")
    o = p.parse_args(args)
    if o.command in ("write-config", "metadata"):
        with open(o.output, "w") as f:
            f.write(json.dumps({"components": [{"name": n, "params": {}} for n in DEFAULT]} if o.command == "write-config" else catalog(), indent=1))
        return
    spark = SparkSession.builder.getOrCreate()
    if o.command == "build-models":
        print("\n".join(build_models(spark, o.output, **{n: getattr(o, n) for n in SOURCES if getattr(o, n)})))
        return
    if o.command == "run-rtf-to-text" or o.rtf:
        events = rtf.rtf_to_text(readers.read_binary(spark, o.input, o.glob or "*.rtf"))
    else:
        events = readers.read_texts(spark, o.input, o.glob or "*.txt")
    if o.command == "run-rtf-to-text":
        writers.write_files(events, o.output)
        return
    docs = stored(events.withColumn("doc_id", F.xxhash64("event_id")), "events")
    lexicons = Lexicons.load(spark, o.models) if o.models else Lexicons()
    pipeline = from_yaml(o.config, lexicons) if o.config else create(lexicons)
    formats = docs.select("doc_id", F.explode("formats").alias("f")).select("doc_id", "f.*") if o.rtf else None
    texts = docs.select("doc_id", "text")
    if o.times:
        labels, times = pipeline.timed(texts, formats)
        for t in times:
            print(f"{t['stage']}: {t['seconds']:.1f} s, {t['labels']} labels")
    else:
        labels = pipeline.transform(texts, formats)
    labels.pop("documents")
    flat_labels = {n: df.drop("tokens", "text") for n, df in labels.items()}
    out = writers.serialise(texts, flat_labels, include_label_text=o.include_label_text)
    out = out.join(docs.select("doc_id", "event_id"), "doc_id")
    if o.format == "lines":
        writers.write_json(out, o.output)
    else:
        writers.write_files(out, o.output, o.format, "json")


if __name__ == "__main__":
    main()
