"""Sources (SRC): texts, binaries, terminologies, corpora and vectors as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Files and tables


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it comes in fewer parts than half of them, such as one small file; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df


def event_id(base: str) -> Column:
    """A file's path below ``base``."""
    plain = re.sub(r"^[a-z0-9]+:/*", "/", base).rstrip("/")
    return F.regexp_replace(F.regexp_replace("_metadata.file_path", r"^[a-z0-9]+:/*", "/"), "^" + re.escape(plain) + "/", "")


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """SRC1, SRC20: event_id, text of every file below ``path``."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return files.select(event_id(path).alias("event_id"), F.col("value").alias("text"))


def read_binary(spark: SparkSession, path: str, glob: str = "*.rtf") -> DataFrame:
    """SRC2: event_id, content; one row an event_id."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(event_id(path).alias("event_id"), "content").dropDuplicates(["event_id"])


def read_table(spark: SparkSession, url: str, query: str = "SELECT NAME, TEXT FROM DOCUMENTS", part: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """SRC6, SRC7: rows of a database query over JDBC; BLOB columns come as binary.

    ``part`` (column, lowest, highest, number) reads so many ranges of a numeric column at once.
    """
    if part is None:
        return spark.read.format("jdbc").options(url=url, query=query, **options).load()
    column, low, high, number = part
    split = {"partitionColumn": column, "lowerBound": low, "upperBound": high, "numPartitions": number}
    return spark.read.format("jdbc").options(url=url, dbtable=f"({query}) part", **split, **options).load()


def from_text(spark: SparkSession, text: str, name: str = "stdin") -> DataFrame:
    """SRC8."""
    return spark.createDataFrame([(name, text)], "event_id string, text string")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """SRC19: row_id and text of quoted notes with line breaks in them."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.select(F.col(rows.columns[0]).try_cast("long").alias("row_id"), F.col(rows.columns[10]).alias("text"))


# Terminologies: columns parted by |, without quoting


def _bars(spark: SparkSession, path: str, columns: dict[str, int]) -> DataFrame:
    rows = spark.read.text(path).filter("value <> ''")
    parts = F.split("value", r"\|")
    return rows.select(F.monotonically_increasing_id().alias("line"), *[F.get(parts, F.lit(i)).alias(c) for c, i in columns.items()])


def read_mrconso(spark: SparkSession, path: str) -> DataFrame:
    """SRC9."""
    return _bars(spark, path, {"cui": 0, "lat": 1, "sui": 5, "sab": 11, "tty": 12, "code": 13, "str": 14, "suppress": 16})


def read_mrsty(spark: SparkSession, path: str) -> DataFrame:
    """SRC10."""
    return _bars(spark, path, {"cui": 0, "tui": 1}).drop("line")


def read_mrxns(spark: SparkSession, path: str) -> DataFrame:
    """SRC11."""
    return _bars(spark, path, {"lat": 0, "norm": 1, "cui": 2, "lui": 3, "sui": 4}).drop("line")


def read_lragr(spark: SparkSession, path: str) -> DataFrame:
    """SRC12."""
    return _bars(spark, path, {"variant": 1, "category": 2, "agreement": 3, "base": 4})


def read_types(spark: SparkSession, srdef: str, groups: str) -> DataFrame:
    """SRC13: tui, tn, grp."""
    a = _bars(spark, srdef, {"tui": 1, "tn": 3}).drop("line")
    return a.join(_bars(spark, groups, {"grp": 0, "tui": 2}).drop("line"), "tui", "left")


def read_list(spark: SparkSession, path: str, column: str, at: int = 1, least: int = 3) -> DataFrame:
    """BLD1: a column of a bar-separated list whose rows have ``least`` columns."""
    parts = F.split("value", r"\|")
    return spark.read.text(path).filter(F.size(parts) >= least).select(F.get(parts, F.lit(at)).alias(column))


# Lexicons


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one file with their number from 0. A file of a lexicon is read whole and cut in place."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))


def read_expansions(spark: SparkSession, path: str) -> DataFrame:
    """SRC22: acronym, sense from pairs of lines: an acronym, then its senses parted by |."""
    rows = _numbered(spark, path).groupBy(F.floor(F.col("line") / 2).alias("n")).agg(F.max(F.when(F.col("line") % 2 == 0, F.col("value"))).alias("acronym"), F.max(F.when(F.col("line") % 2 == 1, F.col("value"))).alias("s"))
    return rows.filter("s IS NOT NULL AND acronym <> ''").select("acronym", F.explode(F.split("s", r"\|")).alias("sense")).filter("sense <> ''")


def read_patterns(spark: SparkSession, path: str) -> str:
    """SRC23: the file's patterns as one."""
    from ..operators.sections import header_pattern

    return header_pattern(r.value for r in _numbered(spark, path).orderBy("line").collect())


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """SRC26: words, tag from lines of words, a tab or two, and [TAG]."""
    p = F.split("value", "\t")
    return spark.read.text(path).filter(F.size(p) >= 3).select(F.split(F.trim(F.get(p, F.lit(0))), " +").alias("words"), F.substring(F.get(p, F.lit(2)), 2, 4).alias("tag"))


def read_vocabulary(spark: SparkSession, path: str, fixed: int = 10) -> DataFrame:
    """SRC25: char, id: a character a line, ids after the ``fixed`` ones."""
    return _numbered(spark, path).filter("value <> ''").select(F.col("value").alias("char"), (F.col("line") + fixed).cast("int").alias("id"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """SRC21: word, word_id from 1, vec; the header's count and width aren't rows."""
    p = F.split(F.rtrim("value"), " ")
    rows = spark.read.text(path).filter(F.size(p) > 2).select(F.get(p, F.lit(0)).alias("word"), F.slice(p, F.lit(2), F.size(p) - 1).cast("array<float>").alias("vec"))
    from ..operators.lexicon import dense_ids

    return dense_ids(rows, "word", "word_id", 1)


def read_events(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    """SRC24: serialised events, json by line or file, or a folder of yml or pickle files (of pickles only what was written here)."""
    if kind == "json":
        return spark.read.schema(schema).json(path, recursiveFileLookup=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json
        import pickle

        import yaml

        for b in batches:
            values = [pickle.loads(x) if kind == "pickle" else yaml.safe_load(x) for x in b.column(0).to_pylist()]
            yield pa.record_batch({"json": pa.array([json.dumps(v) for v in values], pa.string())})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{kind}").load(path)
    return files.select("content").mapInArrow(run, "json string").select(F.from_json("json", schema).alias("e")).select("e.*")


# Corpora, from documents (doc_id, text)


def _generate(docs: DataFrame, rows, schema: str) -> DataFrame:
    """``rows(text)`` yields tuples; doc_id comes first."""

    from ..operators.tokens import gathered, texts_of

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered(((i, *r) for b in batches for i, t in texts_of(b) for r in rows(t or "")), fields)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


_BRACKETS = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "-LCB-": "{", "-RCB-": "}"}


def trees(text: str) -> Iterator[list]:
    """SRC14: nested lists [label, child, ...] of bracketed trees, words as strings; lines that begin with * are skipped."""
    body = "\n".join(x for x in text.split("\n") if not x.startswith("*"))
    stack: list[list] = []
    for m in re.finditer(r"\(|\)|[^\s()]+", body):
        t = m.group()
        if t == "(":
            stack.append([])
        elif t == ")":
            if not stack:
                raise ValueError("a bracket closes that wasn't opened")
            done = stack.pop()
            if stack:
                stack[-1].append(done)
            else:
                yield done
        elif stack:
            stack[-1].append(t)
    if stack:
        raise ValueError("a bracket isn't closed")


def _leaves(tree: list) -> Iterator[tuple[str, str]]:
    if len(tree) == 2 and isinstance(tree[0], str) and isinstance(tree[1], str):
        if tree[0] != "-NONE-":
            yield tree[0], _BRACKETS.get(tree[1], tree[1])
        return
    for x in tree:
        if isinstance(x, list):
            yield from _leaves(x)


def parse_ptb(docs: DataFrame) -> DataFrame:
    """SRC14: doc_id, sent_id, tok_id, text, tag, start, end; words joined by a space, sentences by a line."""

    def rows(text: str):
        at = 0
        for n, tree in enumerate(trees(text)):
            for k, (tag, word) in enumerate(_leaves(tree)):
                yield n, k, word, tag, at, at + len(word)
                at += len(word) + 1

    return _generate(docs, rows, "doc_id long, sent_id int, tok_id int, text string, tag string, start int, end int")


def parse_conllu(docs: DataFrame, per_doc: int = 15) -> DataFrame:
    """SRC15: doc_id, part (of ``per_doc`` sentences), sent_id, dep_id, start, end, text, upos, tag, head_id, deprel (Q36: heads by id)."""

    def rows(text: str):
        sent, at, k = 0, 0, 0
        for line in text.split("\n"):
            c = [None if x == "_" else x for x in line.rstrip("\r").split("\t")]
            if not line.strip():
                sent, k = sent + (k > 0), 0
            elif not line.startswith("#") and len(c) >= 8 and c[0] and c[0].isdigit():
                if k == 0 and sent % per_doc == 0:
                    at = 0
                word = c[1] or "_"
                head = int(c[6]) if c[6] else None
                yield sent // per_doc, sent, int(c[0]), at, at + len(word), word, c[3], c[4], head or None, c[7]
                at, k = at + len(word) + 1, k + 1

    return _generate(docs, rows, "doc_id long, part int, sent_id int, dep_id long, start int, end int, text string, upos string, tag string, head_id long, deprel string")


_AST = re.compile(r'c="(.*?)"\s+([0-9]+):([0-9]+)\s+([0-9]+):([0-9]+)[|]{2}t="([^"]*)"[|]{2}a="([^"]*)"')


def read_i2b2(texts: DataFrame, annotations: DataFrame) -> DataFrame:
    """SRC16: doc_id, start, end, concept, concept_type, assertion; lines from 1 and tokens from 0 become offsets."""

    def rows(text: str):
        # What the annotations name is looked up where both texts of a document meet, so words are no rows.
        n, _, text = text.partition("|")
        text, marks = text[: int(n)], text[int(n) :]
        lines, at = text.split("\n"), 0
        begins, words = [], {}
        for line in lines:
            begins.append(at)
            at += len(line) + 1

        def place(line: int, tok: int) -> tuple[int, int] | None:
            if not 0 < line <= len(lines):
                return None
            if line not in words:
                words[line] = [m.span() for m in re.finditer(r"\S+", lines[line - 1])]
            if tok >= len(words[line]):
                return None
            a, z = words[line][tok]
            return begins[line - 1] + a, begins[line - 1] + z

        for m in _AST.finditer(marks):
            first, last = place(int(m[2]), int(m[3])), place(int(m[4]), int(m[5]))
            if first and last:
                yield first[0], last[1], m[1], m[6], m[7]

    whole = lambda c: F.coalesce(c, F.lit(""))
    both = texts.select("doc_id", F.col("text").alias("_t")).join(annotations.select("doc_id", F.col("text").alias("_a")), "doc_id")
    both = both.select("doc_id", F.concat(F.length(whole("_t")).cast("string"), F.lit("|"), whole("_t"), whole("_a")).alias("text"))
    return _generate(both, rows, "doc_id long, start int, end int, concept string, concept_type string, assertion string")


def parse_genia(docs: DataFrame) -> DataFrame:
    """SRC17: doc_id, sent_id, tok_id, text, tag, start, end of XML words; a * word is joined to the next (Q39: once)."""
    import xml.etree.ElementTree as xml

    def rows(text: str):
        at = n = 0
        for s in xml.fromstring(text).iter("sentence") if text.strip() else ():
            k, part = 0, ""
            for w in s.iter("w"):
                word, tag = part + "".join(w.itertext()), (w.get("c") or "").split("|")[0]
                part = word if tag == "*" else ""
                if tag != "*":
                    yield n, k, word, tag, at, at + len(word)
                    at, k = at + len(word) + 1, k + 1
            n += 1

    return _generate(docs, rows, "doc_id long, sent_id int, tok_id int, text string, tag string, start int, end int")


def read_gold_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC18: event_id, start, end, cui."""
    rows = spark.read.csv(path)
    c = rows.columns
    return rows.select(F.col(c[6]).alias("event_id"), F.col(c[1]).try_cast("int").alias("start"), F.col(c[0]).try_cast("int").alias("end"), F.col(c[5]).alias("cui")).filter("start IS NOT NULL")
