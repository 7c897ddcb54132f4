"""All queries over the standard tables by name, with the same results as SQL for DuckDB.

The tables hold invented prose, so lexicons here are short lists of words that occur
in it; both sides are made from the same lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import acronyms, concepts, lexicon, negation, norms, rtf, sections, spans, tagging, tokens
from ..sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.spread(read(spark, sf_dir, "documents").select("doc_id", "text"))


def values(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


# Common parts of the SQL

_TOK = r"""tok AS (
  SELECT doc_id, pos::INTEGER AS tok_id, (e - len(t))::INTEGER AS "start", e::INTEGER AS "end", t AS text FROM (
    SELECT doc_id, pos, t, sum(len(b)) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM (
      SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS t, unnest(y) AS b FROM (
        SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f]+') AS x, regexp_extract_all(text, '[ \t\n\r\f]*[^ \t\n\r\f]+') AS y FROM documents))))"""
_SENT = r"""lines AS (
  SELECT doc_id, no, line, (sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY no) - len(line) - 1) AS line_at FROM (
    SELECT doc_id, unnest(range(len(p))) AS no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))
), sent AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1)::INTEGER AS sent_id,
         (line_at + len(line) - len(ltrim(line)))::INTEGER AS "start", (line_at + len(rtrim(line)))::INTEGER AS "end", trim(line) AS text
  FROM lines WHERE trim(line) <> '')"""
_STOK = (
    _TOK
    + ", "
    + _SENT
    + """, stok AS (
  SELECT t.doc_id, s.sent_id, (row_number() OVER (PARTITION BY t.doc_id, s.sent_id ORDER BY t.tok_id) - 1)::INTEGER AS tok_id, t."start", t."end", t.text
  FROM tok t JOIN sent s ON t.doc_id = s.doc_id AND t."start" >= s."start" AND t."end" <= s."end")"""
)
_TAGS = ("NN", "VB", "DT", "JJ", "IN", "NNS", "CD")
_TAG_SQL = "CASE len(text) % 7 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TAGS)) + " END"
_TAGGED = _STOK + f", tagged AS (SELECT *, {_TAG_SQL} AS tag FROM stok)"
_CLEAN = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_/\-]+', '', 'g')"


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence tokens with a tag by their length: input for what needs tags."""
    tag = F.element_at(F.array(*map(F.lit, _TAGS)), (F.length("text") % 7 + 1).cast("int"))
    return tokens.sentence_tokens(tokens.sentences(docs(spark, sf_dir))).withColumn("tag", tag)


# Text and spans

LEX = [("the", "article"), ("of", "link"), ("and", "link"), ("der", "article"), ("von", "link"), ("la", "article"), ("que", "relative"), ("is", "verb"), ("was", "verb")]


@query(f"""WITH {_TOK}, lex(word, kind) AS (VALUES {values(LEX)}),
hit AS (SELECT t.doc_id, l.kind, l.word, count(*) AS n, min(t."start") AS first_start FROM tok t JOIN lex l ON {_CLEAN.format("t.text")} = l.word GROUP BY ALL)
SELECT doc_id, kind, word, n, first_start, row_number() OVER (PARTITION BY doc_id, kind ORDER BY n DESC, word)::INTEGER AS rank FROM hit""")
def dictionary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon words of each document, ranked by kind."""
    lex = spark.createDataFrame(LEX, "word string, kind string")
    t = tokens.tokens(docs(spark, sf_dir)).withColumn("word", T.trigger_word(F.col("text")))
    hit = t.join(lexicon.sized(lex), "word").groupBy("doc_id", "kind", "word").agg(F.count("*").alias("n"), F.min("start").alias("first_start"))
    return hit.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy(F.desc("n"), "word")))


FLAGSHIP = dictionary_terms


@query(f'WITH {_TOK} SELECT doc_id, tok_id, "start", "end", text FROM tok')
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOK5 with an explicit class of white space."""
    return tokens.tokens(docs(spark, sf_dir))


@query(f'WITH {_SENT} SELECT doc_id, sent_id, "start", "end", text FROM sent')
def line_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEN2."""
    return tokens.sentences(docs(spark, sf_dir)).drop("tokens")


@query()
def ptb_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOK1: its look-behinds have no form in RE2; golden cases are in the tests."""
    return tokens.tokens(docs(spark, sf_dir), tokens.ptb_words())


@query(f"""WITH {_TOK}, l AS (SELECT doc_id, tok_id, "start" + k AS a, substr(text, k + 1) AS t FROM (SELECT *, CASE WHEN "start" > 0 AND text[1] IN (chr(34), chr(39), '(') THEN 1 ELSE 0 END AS k FROM tok)),
e AS (SELECT doc_id, tok_id, a, CASE WHEN right(t, 1) IN ('!', chr(34), chr(39), ')', ',', '.', ':', ';') THEN left(t, -1) ELSE t END AS t FROM l WHERE t <> '')
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY tok_id) - 1)::INTEGER AS tok_id, a::INTEGER AS "start", (a + len(t))::INTEGER AS "end", t AS text FROM e WHERE t <> ''""")
def edge_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOK4."""
    return tokens.tokens(docs(spark, sf_dir), tokens.edge_words)


@query(f"""WITH {_TOK}, one AS (SELECT doc_id, {_CLEAN.format("text")} AS word FROM tok) SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM one WHERE word <> '' GROUP BY word""")
def cleaned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOK7."""
    t = tokens.tokens(docs(spark, sf_dir)).select("doc_id", T.trigger_word(F.col("text")).alias("word")).filter("word <> ''")
    per = t.groupBy("word", "doc_id").agg(F.count("*").alias("c"))  # partial counts first: a frequent word is no hot key
    return per.groupBy("word").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


@query(r"SELECT doc_id, md5(c) AS cleaned, len(c)::INTEGER AS n FROM (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'), '\p{Nd}', '#', 'g') AS c FROM documents)")
def clean_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRE2."""
    return docs(spark, sf_dir).withColumn("c", T.clean_articles(F.col("text"))).select("doc_id", F.md5("c").alias("cleaned"), F.length("c").alias("n"))


@query(r"SELECT doc_id, md5(c) AS cleaned FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower('[**Name ' || doc_id || '**] ' || text), '\[[*]{2}.*name.*[*]{2}\]', 'NAME', 'g'), '\[[*]{2}.*telephone.*[*]{2}\]', '###-###-###', 'g'), '\[[*]{2}.*[*]{2}\]', 'IDENTIFIER', 'g'), '[^#\p{L}\p{N}_]+', ' ', 'g'), '\p{Nd}', '#', 'g') AS c FROM documents)")
def clean_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRE1, on texts with a de-identified name before them."""
    note = F.concat(F.lit("[**Name "), F.col("doc_id").cast("string"), F.lit("**] "), F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.md5(T.clean_notes(note)).alias("cleaned"))


@query(f"""WITH {_TOK}, f AS (SELECT CASE WHEN regexp_full_match(text, '[0-9]') THEN 'single_digit' WHEN regexp_full_match(text, '[0-9]*\\.[0-9]+') THEN 'decimal_number' WHEN regexp_full_match(text, '[0-9][0-9,]+') THEN 'big_number' ELSE 'word' END AS form, translate(text, '&+', '//') AS standard FROM tok)
SELECT form, count(*) AS n, count(DISTINCT standard) AS forms FROM f GROUP BY form""")
def number_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ACR3, ACR4."""
    t = tokens.tokens(docs(spark, sf_dir)).withColumn("f", T.context_form(F.col("text")))
    form = F.when(F.col("f").isin("single_digit", "decimal_number", "big_number"), F.col("f")).otherwise("word")
    per = t.groupBy(form.alias("form"), T.standard_acronym(F.col("text")).alias("s")).agg(F.count("*").alias("c"))
    return per.groupBy("form").agg(F.sum("c").alias("n"), F.count("*").alias("forms"))


@query(f"""WITH {_STOK} SELECT doc_id, sent_id, count(*)::INTEGER AS words, min(tok_id)::INTEGER AS first_tok, sum(len(text))::BIGINT AS chars FROM stok GROUP BY ALL""")
def sentence_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6 without a join: tokens come inside their sentence."""
    s = tokens.sentences(docs(spark, sf_dir)).filter("size(tokens) > 0")
    chars = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: a + F.length(t["text"]))
    return s.select("doc_id", "sent_id", F.size("tokens").alias("words"), F.lit(0).alias("first_tok"), chars.alias("chars"))


def _capitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokens(docs(spark, sf_dir)).filter(F.col("text").rlike(r"^[A-Z][a-z]+\.$")).select("doc_id", "start", "end")


_CAPS = r"""caps AS (SELECT doc_id, "start", "end" FROM tok WHERE regexp_full_match(text, '[A-Z][a-z]+\.'))"""


@query(f"""WITH {_TOK}, {_SENT}, {_CAPS} SELECT s.doc_id, s."start", s."end", count(*) AS n FROM sent s JOIN caps c ON s.doc_id = c.doc_id AND c."start" >= s."start" AND c."end" <= s."end" GROUP BY ALL""")
def span_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lone capitalised words that end a sentence, by the line they are in."""
    s = tokens.sentences(docs(spark, sf_dir)).select("doc_id", "start", "end")
    return spans.inside(s, _capitals(spark, sf_dir), width=1024).groupBy("doc_id", "start", "end").agg(F.count("*").alias("n"))


@query(f"""WITH {_TOK}, {_SENT}, {_CAPS} SELECT c.doc_id, c."start", c."end", s."start" AS s_start, s."end" AS s_end FROM caps c JOIN sent s ON s.doc_id = c.doc_id AND c."start" >= s."start" AND c."end" <= s."end" """)
def span_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2."""
    s = tokens.sentences(docs(spark, sf_dir)).select("doc_id", "start", "end")
    return spans.covering(_capitals(spark, sf_dir), s).select("doc_id", "start", "end", F.col("r_start").alias("s_start"), F.col("r_end").alias("s_end"))


@query(f"""WITH {_TOK}, {_SENT}, {_CAPS} SELECT s.doc_id, s."start", s."end" FROM sent s SEMI JOIN caps c ON s.doc_id = c.doc_id AND c."start" = s."start" AND c."end" = s."end" """)
def span_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are one such word."""
    return spans.at(tokens.sentences(docs(spark, sf_dir)).select("doc_id", "start", "end"), _capitals(spark, sf_dir))


@query(f"""WITH {_TOK}, {_SENT}, {_CAPS}, f AS (SELECT doc_id, min("start") AS "start" FROM sent GROUP BY doc_id),
p AS (SELECT c.doc_id, c."start", c."end", b."start" AS b_start, row_number() OVER (PARTITION BY c.doc_id, c."start", c."end" ORDER BY b."end" DESC, b."start" DESC) AS r FROM caps c JOIN caps b ON b.doc_id = c.doc_id AND b."end" <= c."start")
SELECT doc_id, "start", "end", b_start FROM p WHERE r = 1""")
def span_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest such word before each."""
    c = _capitals(spark, sf_dir)
    return spans.backward(c, c, 1).select("doc_id", "start", "end", F.col("r_start").alias("b_start"))


@query(f"""WITH {_TOK}, {_CAPS}, p AS (SELECT c.doc_id, c."start", c."end", b."start" AS f_start, row_number() OVER (PARTITION BY c.doc_id, c."start", c."end" ORDER BY b."start", b."end") - 1 AS r FROM caps c JOIN caps b ON b.doc_id = c.doc_id AND b."start" >= c."end")
SELECT doc_id, "start", "end", f_start, r::INTEGER AS rank FROM p WHERE r < 2""")
def span_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest after each."""
    c = _capitals(spark, sf_dir)
    return spans.forward(c, c, 2).select("doc_id", "start", "end", F.col("r_start").alias("f_start"), "rank")


@query(f"""WITH {_TOK}, {_CAPS} SELECT doc_id, min("start") AS "start", arg_min("end", "start") AS "end" FROM caps GROUP BY doc_id""")
def span_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8."""
    return spans.first(_capitals(spark, sf_dir))


HEADER = r"^[A-Z][a-z]+\.$|^[^a-z]{3,}$"


@query(f"""WITH {_TOK}, {_SENT}, {_CAPS} SELECT DISTINCT doc_id, "start", "end" FROM sent s WHERE regexp_matches(text, '^[A-Z][a-z]+\\.$|^[^a-z]{{3,}}$')""")
def section_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEC1: by pattern or by an exact bold span."""
    bold = _capitals(spark, sf_dir).withColumn("kind", F.lit("bold"))
    return sections.section_headers(tokens.sentences(docs(spark, sf_dir)), HEADER, bold)


# Runs of words and dictionaries


@query(f"""WITH {_STOK}, g AS (SELECT {_CLEAN.format("text")} AS a, lead({_CLEAN.format("text")}) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id) AS b FROM stok)
SELECT a || ' ' || b AS gram, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY ALL""")
def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of two words."""
    return tokens.run_counts(docs(spark, sf_dir), 2, T.cleaned_trigger)


RULES = [("the and", "PREN"), ("and the", "PREN"), ("in", "POST"), ("is", "POST"), ("that", "PREN"), ("of the", "PSEU"), ("to the", "CONJ"), ("der die", "PREN"), ("la", "PREN"), ("que", "POST")]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w.split(), t) for w, t in RULES], "words array<string>, tag string")


_TRIG = f"""c AS (SELECT doc_id, sent_id, (row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id) - 1)::INTEGER AS tok_id, "start", "end", w FROM (SELECT *, {_CLEAN.format("text")} AS w FROM stok) WHERE w <> ''),
runs AS (SELECT doc_id, sent_id, tok_id, 1 AS n, "start", "end", w AS gram FROM c UNION ALL
  SELECT a.doc_id, a.sent_id, a.tok_id, 2, a."start", b."end", a.w || ' ' || b.w FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND b.tok_id = a.tok_id + 1),
rules(gram, tag) AS (VALUES {values(RULES)}), trig AS (SELECT r.*, tag FROM runs r JOIN rules USING (gram))"""


@query(f'WITH {_STOK}, {_TRIG} SELECT doc_id, sent_id, tok_id, n::INTEGER AS n, "start", "end", tag FROM trig')
def trigger_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NEG1, NEG2."""
    return negation.triggers(tokens.sentences(docs(spark, sf_dir)), rules(spark))


def demo_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms: words that begin with a consonant pair and end in -ing."""
    return tokens.tokens(docs(spark, sf_dir)).filter(F.col("text").rlike(r"^[a-z]+ing$")).select("doc_id", "start", "end")


_TERMS = """terms AS (SELECT doc_id, "start", "end" FROM tok WHERE regexp_full_match(text, '[a-z]+ing'))"""


@query(f"""WITH {_STOK}, {_TRIG}, {_TERMS},
t AS (SELECT c.doc_id, c.sent_id, c."start", c."end", c.tok_id AS te FROM terms t JOIN c ON c.doc_id = t.doc_id AND c."start" <= t."start" AND c."end" >= t."end"),
p AS (SELECT t.*, g."start" AS gs, g."end" AS ge, CASE WHEN tag = 'PREN' THEN 0 ELSE 1 END AS tier, g.tok_id AS g, g.tok_id + g.n - 1 AS h FROM t JOIN trig g USING (doc_id, sent_id)
  WHERE (tag = 'PREN' AND te - (g.tok_id + g.n - 1) BETWEEN 0 AND 39) OR (tag = 'POST' AND g.tok_id - te BETWEEN 0 AND 39)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id, "start", "end" ORDER BY tier, CASE WHEN tier = 0 THEN -h ELSE h END, CASE WHEN tier = 0 THEN -g ELSE g END) AS k FROM p)
SELECT doc_id, sent_id, "start", "end", gs AS trigger_start, ge AS trigger_end FROM r WHERE k = 1""")
def negex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NEG3, NEG4."""
    return negation.negex(tokens.sentences(docs(spark, sf_dir)), demo_terms(spark, sf_dir), rules(spark))


CUES = [("left", "negated", "the"), ("left", "uncertain", "of the"), ("left", "historical", "in the"), ("left", "historical", "de la"), ("right", "uncertain", "and"), ("right", "negated", "that the"), ("right", "historical", "to")]


def cues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, k, w.split()) for s, k, w in CUES], "side string, kind string, words array<string>")


def _cue_sql(least: str) -> str:
    # Offsets count from the term outwards; a cue that begins at offset o with L words lies at o to o+L-1.
    return f"""WITH {_STOK}, {_TERMS}, cues(side, kind, gram) AS (VALUES {values(CUES)}),
t AS (SELECT s.doc_id, s.sent_id, s."start", s."end", s.tok_id FROM terms x JOIN stok s ON s.doc_id = x.doc_id AND s."start" = x."start" AND s."end" = x."end"),
near AS (SELECT t.doc_id, t.sent_id, t."start", t."end", t.tok_id AS me, s.tok_id, s.text, s."start" AS a, s."end" AS z, CASE WHEN s.tok_id < t.tok_id THEN 0 ELSE 1 END AS tier, abs(s.tok_id - t.tok_id) - 1 AS off
  FROM t JOIN stok s ON s.doc_id = t.doc_id AND s.sent_id = t.sent_id AND s.tok_id <> t.tok_id),
stop AS (SELECT doc_id, sent_id, "start", tier, min(off) AS stop FROM near WHERE lower(text) IN ({", ".join("'" + w + "'" for w in negation.SCOPE_WORDS)}) GROUP BY ALL),
runs AS (SELECT n.*, 1 AS len, text AS gram, a AS cs, z AS ce FROM near n UNION ALL
  SELECT n.*, 2, CASE WHEN n.tier = 0 THEN m.text || ' ' || n.text ELSE n.text || ' ' || m.text END, least(n.a, m.a), greatest(n.z, m.z) FROM near n JOIN near m ON m.doc_id = n.doc_id AND m.sent_id = n.sent_id AND m."start" = n."start" AND m.tier = n.tier AND m.off = n.off + 1),
hit AS (SELECT r.*, c.kind, row_number() OVER (PARTITION BY r.doc_id, r.sent_id, r."start", r."end" ORDER BY r.tier, r.off, r.len, c.kind) AS k FROM runs r JOIN cues c ON c.gram = r.gram AND c.side = CASE WHEN r.tier = 0 THEN 'left' ELSE 'right' END
  LEFT JOIN stop s ON s.doc_id = r.doc_id AND s.sent_id = r.sent_id AND s."start" = r."start" AND s.tier = r.tier WHERE r.off < coalesce(s.stop, 1000000) AND r.len >= {least})
SELECT doc_id, sent_id, "start", "end", kind, cs AS cue_start, ce AS cue_end FROM hit WHERE k = 1"""


@query(_cue_sql("r.off + 1"))
def modifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD1, MOD2 as the reference scans."""
    return negation.modifications(tokens.sentences(docs(spark, sf_dir)), demo_terms(spark, sf_dir), cues(spark))


@query(_cue_sql("1"))
def modifications_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD2 with cues at any distance."""
    return negation.modifications(tokens.sentences(docs(spark, sf_dir)), demo_terms(spark, sf_dir), cues(spark), "full")


@query(f"""WITH {_STOK}, {_TRIG}, {_TERMS} SELECT DISTINCT s.doc_id, s.sent_id FROM sent s SEMI JOIN terms t ON t.doc_id = s.doc_id AND t."start" >= s."start" AND t."end" <= s."end" WHERE EXISTS (SELECT 1 FROM trig g WHERE g.doc_id = s.doc_id AND g.sent_id = s.sent_id)""")
def selected_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEP3, DEP4."""
    s = tokens.sentences(docs(spark, sf_dir))
    return negation.selected_sentences(s.select("doc_id", "sent_id", "start", "end"), demo_terms(spark, sf_dir), negation.triggers(s, rules(spark))).select("doc_id", "sent_id")


def _chain(words: list[str]) -> list[tuple[int, str, str]]:
    """A parse that hangs each word on the one before it."""
    return [(k, "root" if k == 0 else "conj" if len(w) % 3 == 0 else "nmod" if len(w) % 3 == 1 else "obj", "VERB" if len(w) % 4 == 0 else "NOUN" if len(w) % 4 == 1 else "ADJ") for k, w in enumerate(words)]


@query()
def deepen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEP1 to DEP3 with a toy parser; golden trees are in the tests."""
    s = tokens.sentences(docs(spark, sf_dir))
    place = s.select("doc_id", "sent_id", F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    terms = negation.located(place, demo_terms(spark, sf_dir)).withColumnsRenamed({"t_start": "start", "t_end": "end"})
    trig = negation.triggers(s, rules(spark)).select("doc_id", "sent_id", "start", "end", "tag")
    # Only sentences with both need a parse.
    both = s.join(terms, ["doc_id", "sent_id"], "left_semi").join(trig, ["doc_id", "sent_id"], "left_semi")
    return negation.deepen(terms, trig, negation.parse_dependencies(both, _chain))


PHRASES = [("the ing", "S1", "C1", "T121", 0, "c1"), ("thing", "S2", "C2", "T047", 1, "c2"), ("ing", "S3", "C3", "T121", 0, "c3"), ("tion of the", "S4", "C4", "T121", 2, "c4"), ("er", "S5", "C5", "T033", 1, "c5"), ("en ing", "S6", "C6", "T121", 0, "c6"), ("Ing", "S7", "C7", "T121", 7, "c7"), ("re", "S8", "C8", "T047", 2, "c8"), ("on", "S9", "C9", "T047", 0, "c9"), ("ou ing", "S10", "C10", "T121", 1, "c10")]
NORM_KEYS = [("er ing", "S5", "C11", "T047", 1, "c11"), ("ing re", "S8", "C12", "T121", 0, "c12"), ("ea on", "S9", "C13", "T033", 2, "c13")]
SOURCES = [(0, "ALPHA"), (1, "BETA"), (2, "GAMMA")]
_CCOLS = "key, sui, cui, tui, source, code"


def dictionary(spark: SparkSession) -> dict[str, DataFrame]:
    schema = "key string, sui string, cui string, tui string, source int, code string"
    phrase = spark.createDataFrame(PHRASES, schema)
    return {"phrase": phrase, "lower": phrase.withColumn("key", F.lower("key")), "norm": spark.createDataFrame(NORM_KEYS, schema)}


def _concepts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = tokens.sentences(docs(spark, sf_dir))
    # The mark at a word's end is cut once, and what is left is used from there.
    word = F.transform("tokens", lambda x: F.struct(x["start"].alias("start"), F.rtrim(x["text"], F.lit(".,")).alias("text"), (F.length(x["text"]) % 7 + 1).cast("int").alias("n")))
    cut = F.transform(F.filter(word, lambda x: x["text"] != ""), lambda x: F.struct(F.lit(0).alias("tok_id"), x["start"].alias("start"), (x["start"] + F.length(x["text"])).alias("end"), x["text"].alias("text"), F.element_at(F.array(*map(F.lit, _TAGS)), x["n"]).alias("tag"), F.lower(x["text"]).alias("norm"), F.lit(None).cast("string").alias("expansion")))
    s = t.select("doc_id", "sent_id", cut.alias("tokens"))
    return concepts.detect_concepts(s, dictionary(spark), spark.createDataFrame(SOURCES, "source int, name string"), 3)


_STOPSQL = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_TRIVSQL = ", ".join("'" + w.replace("'", "''") + "'" for w in T.TRIVIAL_TAGS)
_HITS = f"""{_STOK}, w AS (SELECT doc_id, sent_id, (row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id))::INTEGER AS i, "start", ("start" + len(w))::INTEGER AS "end", w, tag FROM (SELECT *, regexp_replace(text, '[.,]+$', '') AS w, {_TAG_SQL} AS tag FROM stok) WHERE w <> ''),
f AS (SELECT *, NOT (lower(w) IN ({_STOPSQL}) OR regexp_full_match(w, '[[:punct:]]+') OR tag IN ({_TRIVSQL})) AS fit FROM w),
r AS (SELECT a.doc_id, a.sent_id, a."start", a."end", 1 AS n, a.w AS key, a.tag AS last_tag, [lower(a.w)] AS bag FROM f a WHERE a.fit UNION ALL
  SELECT a.doc_id, a.sent_id, a."start", b."end", 2, a.w || repeat(' ', least(1, greatest(0, b."start" - a."end"))::BIGINT) || b.w, b.tag, [lower(a.w), lower(b.w)] FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND b.i = a.i + 1 WHERE a.fit AND b.fit UNION ALL
  SELECT a.doc_id, a.sent_id, a."start", c."end", 3, a.w || repeat(' ', least(1, greatest(0, b."start" - a."end"))::BIGINT) || b.w || repeat(' ', least(1, greatest(0, c."start" - b."end"))::BIGINT) || c.w, c.tag, [lower(a.w), lower(b.w), lower(c.w)] FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND b.i = a.i + 1 JOIN f c ON a.doc_id = c.doc_id AND a.sent_id = c.sent_id AND c.i = a.i + 2 WHERE a.fit AND c.fit),
phrase({_CCOLS}) AS (VALUES {values(PHRASES)}), bags({_CCOLS}) AS (VALUES {values(NORM_KEYS)}), names(source, name) AS (VALUES {values(SOURCES)}),
h AS (SELECT r.*, 0 AS tier, sui, cui, tui, source, code, 1.0::DOUBLE AS score, true AS shown FROM r JOIN phrase p ON p.key = r.key UNION ALL
  SELECT r.*, 0, sui, cui, tui, source, code, 0.6::DOUBLE, r.n > 1 FROM r JOIN phrase p ON lower(p.key) = lower(r.key) UNION ALL
  SELECT r.*, 2, sui, cui, tui, source, code, 0.3::DOUBLE, true FROM r JOIN bags p ON p.key = array_to_string(list_sort(list_filter(r.bag, lambda x: x NOT IN ({_STOPSQL}) AND NOT regexp_full_match(x, '[[:punct:]]+'))), ' ') WHERE r.n >= 2 AND r.last_tag <> 'CD'),
best AS (SELECT *, min(tier) OVER (PARTITION BY doc_id, "start", "end") AS b FROM h)"""


@query(f"""WITH {_HITS} SELECT doc_id, "start", "end", sui, cui, tui, coalesce(name, 'unknown') AS source, code, score FROM best LEFT JOIN names USING (source) WHERE tier = b AND shown""")
def concept_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CON1 to CON7."""
    return _concepts(spark, sf_dir)[0]


@query(f"""WITH {_HITS} SELECT DISTINCT doc_id, "start", "end" FROM best WHERE tier = b""")
def concept_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CON6."""
    return _concepts(spark, sf_dir)[1]


@query(f"""WITH {_HITS}, c AS (SELECT doc_id, "start", "end", cui FROM best WHERE tier = b AND shown AND tui = 'T121')
SELECT s.doc_id, s."start", s."end", string_agg(c.cui, ',' ORDER BY c."start", c."end", c.cui) AS cuis FROM sent s JOIN c ON c.doc_id = s.doc_id AND c."start" >= s."start" AND c."end" <= s."end" GROUP BY ALL""")
def medication_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CON11."""
    m = concepts.medication_sentences(tokens.sentences(docs(spark, sf_dir)), _concepts(spark, sf_dir)[0])
    return m.select("doc_id", "start", "end", F.array_join(F.transform("concepts", lambda c: c["cui"]), ",").alias("cuis"))


@query(f"WITH phrase({_CCOLS}) AS (VALUES {values(PHRASES)}) SELECT {_CCOLS} FROM phrase WHERE cui = 'C4' OR contains(lower(key), 'ing')")
def reverse_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CON9."""
    d = dictionary(spark)["phrase"]
    return concepts.with_cui(d, "C4").union(concepts.with_word(d, "ING")).distinct()


TYPES = [("T1", "A1"), ("T2", "A1.1"), ("T3", "A1.10"), ("T4", "A1.1.2"), ("T5", "B1.1"), ("T6", "A"), ("T7", "A1.10.3")]


@query(f"""WITH t(tui, tn) AS (VALUES {values(TYPES)}), p AS (SELECT tui, substr(tn, 1, 1) AS c, list_filter(string_split(substr(tn, 2), '.'), lambda x: x <> '') AS path FROM t)
SELECT a.tui AS child, b.tui AS parent FROM p a JOIN p b ON a.c = b.c AND len(b.path) <= len(a.path) AND a.path[1:len(b.path)] = b.path""")
def type_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CON10: all pairs of a type and one above it; whole numbers a level (Q35)."""
    t = spark.createDataFrame(TYPES, "tui string, tn string")
    a, b = t.select(F.col("tui").alias("child"), F.col("tn").alias("n"), F.substring("tn", 1, 1).alias("c")), t.select(F.col("tui").alias("parent"), F.col("tn").alias("m"), F.substring("tn", 1, 1).alias("c"))
    return a.join(b, "c").filter(T.is_a(F.col("n"), F.col("m"))).select("child", "parent")


# Terminology builds, on part as a terminology

_CONSO = "SELECT p_partkey AS line, 'C' || lpad(CAST(p_partkey % 500 AS VARCHAR), 7, '0') AS cui, CASE WHEN p_size % 7 = 0 THEN 'FRE' ELSE 'ENG' END AS lat, 'S' || lpad(CAST(p_partkey % 900 AS VARCHAR), 7, '0') AS sui, p_brand AS sab, CASE WHEN p_size % 11 = 0 THEN 'OB' ELSE 'PT' END AS tty, p_type AS code, p_name AS str, CASE WHEN p_size % 13 = 0 THEN 'O' ELSE 'N' END AS suppress FROM part"
_STY = "SELECT DISTINCT 'C' || lpad(CAST(p_partkey % 500 AS VARCHAR), 7, '0') AS cui, 'T' || lpad(CAST(p_partkey % 5 AS VARCHAR), 3, '0') AS tui FROM part"
_XNS = "SELECT 'ENG' AS lat, lower(p_name) AS norm, 'C' || lpad(CAST(p_partkey % 500 AS VARCHAR), 7, '0') AS cui, 'S' || lpad(CAST(p_partkey % 900 AS VARCHAR), 7, '0') AS sui FROM part"


def terminology(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    part = read(spark, sf_dir, "part")
    conso, sty, xns = (spark.sql(sql.replace("FROM part", "FROM {part}").replace("VARCHAR", "STRING"), part=part) for sql in (_CONSO, _STY, _XNS))
    keep = spark.createDataFrame([("T000",), ("T001",), ("T002",)], "tui string")
    return concepts.build_concepts(conso, sty, xns, keep, spark.createDataFrame([("OB",)], "tty string"))


_BUILD = f"""conso AS ({_CONSO}), sty AS ({_STY}), xns AS ({_XNS}), types AS (SELECT DISTINCT cui, tui FROM sty WHERE tui IN ('T000', 'T001', 'T002')),
base AS (SELECT * FROM conso WHERE lat = 'ENG' AND len(str) >= 3), ban AS (SELECT DISTINCT sui FROM base WHERE tty = 'OB' OR suppress <> 'N'),
kept AS (SELECT * FROM base JOIN types USING (cui) WHERE suppress = 'N' AND tty <> 'OB'),
src AS (SELECT sab, (row_number() OVER (ORDER BY min(line)) - 1)::INTEGER AS source FROM kept GROUP BY sab),
rws AS (SELECT k.str AS key, k.sui, k.cui, k.tui, s.source, substr(k.code, 1, 12) AS code FROM kept k JOIN src s USING (sab))"""


@query(f"WITH {_BUILD} SELECT * FROM rws")
def build_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLD1 to BLD5, BLD7."""
    return terminology(spark, sf_dir)["phrase"]


@query(rf"WITH {_BUILD}, n AS (SELECT array_to_string(list_sort(string_split(norm, ' ')), ' ') AS key, cui, sui FROM xns WHERE lat = 'ENG' AND len(string_split(norm, ' ')) >= 2 AND sui NOT IN (SELECT sui FROM ban)) SELECT DISTINCT n.key, n.sui, n.cui, r.tui, r.source, r.code FROM n JOIN rws r ON r.cui = n.cui AND r.sui = n.sui")
def build_norm_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLD6."""
    return terminology(spark, sf_dir)["norm"]


@query(f"WITH {_BUILD} SELECT source, sab AS name FROM src")
def source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLD4, SNK6."""
    return terminology(spark, sf_dir)["sources"]


_INFL = """SELECT doc_id * 100000 + tok_id AS line, text AS variant, CASE len(text) % 3 WHEN 0 THEN 'noun' WHEN 1 THEN 'verb' ELSE 'adj' END AS category, CASE len(text) % 6 WHEN 0 THEN 'count(thr_plur)' WHEN 3 THEN 'uncount(thr_sing)' WHEN 1 THEN 'past' WHEN 4 THEN 'pres(thr_sing)' WHEN 2 THEN 'comparative' ELSE 'positive' END AS agreement, substr(text, 1, len(text) // 2 + 1) AS base FROM tok WHERE len(text) > 2"""


def inflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens.tokens(docs(spark, sf_dir)).filter("length(text) > 2")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.length("text") % n + 1).cast("int"))
    return t.select((F.col("doc_id") * 100000 + F.col("tok_id")).alias("line"), F.col("text").alias("variant"), pick(["noun", "verb", "adj"], 3).alias("category"), pick(["count(thr_plur)", "past", "comparative", "uncount(thr_sing)", "pres(thr_sing)", "positive"], 6).alias("agreement"), F.expr("substring(text, 1, cast(floor(length(text) / 2) as int) + 1)").alias("base"))


@query(rf"""WITH {_TOK}, i AS ({_INFL}), k AS (SELECT * FROM i WHERE NOT regexp_matches(variant, '[|$#,@;:<>?\[\]{{}}\d.]') AND len(variant) <= 100 AND NOT suffix(variant, base)),
m(category, agreement, o, tag) AS (VALUES ('noun', 'count(thr_plur)', 0, 'NNS'), ('noun', 'count(thr_plur)', 1, 'NN'), ('noun', 'uncount(thr_sing)', 0, 'NN'), ('noun', 'uncount(thr_sing)', 1, 'NNS'), ('verb', 'past', 0, 'VBD'), ('verb', 'pres(thr_sing)', 0, 'VBZ'), ('adj', 'comparative', 0, 'JJR'), ('adj', 'positive', 0, 'JJ'))
SELECT variant AS term, tag, arg_max(base, line * 2 + o) AS norm FROM k JOIN m USING (category, agreement) GROUP BY ALL""")
def build_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM2, on all words as an inflection list."""
    return norms.build_norms(inflections(spark, sf_dir))


NORMS = [("the", "JJ", "THE"), ("of", "DT", "OF"), ("thing", "NNS", "thng"), ("and", "JJ", "&"), ("reing", "NNS", "re"), ("was", "JJ", "be")]


@query(f"""WITH {_TAGGED}, n(term, tag, norm) AS (VALUES {values(NORMS)}), j AS (SELECT coalesce(n.norm, lower(t.text)) AS norm, n.norm IS NOT NULL AS known FROM tagged t LEFT JOIN n ON n.term = t.text AND n.tag = t.tag) SELECT norm, known, count(*) AS n FROM j GROUP BY ALL""")
def normalized_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM1."""
    n = norms.normalize(tagged(spark, sf_dir), spark.createDataFrame(NORMS, "term string, tag string, norm string"))
    return n.groupBy("norm", ((F.col("norm") != F.lower("text"))).alias("known")).agg(F.count("*").alias("n"))


# Acronyms

SENSES = [("the", "article one"), ("the", "article two"), ("OF", "linking word"), ("inthe", "never"), ("and", "conjunction"), ("and", "addition"), ("is", "being"), ("la", "article"), ("la", "note")]
VOCAB = [("the", 0), ("of", 1), ("and", 2), ("to", 3), ("in", 4), ("that", 5), ("de", 6), ("la", 7)]
VECTORS = [(s, w, round(0.05 * ((len(s) * 7 + w * 3) % 11), 2)) for s in sorted({s for _, s in SENSES}) for w in range(8)]


def _acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens.tokens(docs(spark, sf_dir))
    cands = t.filter(F.col("text").isin("the", "of", "and", "is", "la"))
    make = spark.createDataFrame
    return acronyms.score_senses(t, cands, make(SENSES, "acronym string, sense string"), make(VOCAB, "word string, word_id int"), make(VECTORS, "sense string, word_id int, weight double"))


_CTX = f"""vocab(word, word_id) AS (VALUES {values(VOCAB)}),
ctx AS (SELECT doc_id, tok_id AS p, word_id FROM tok JOIN vocab v ON v.word = lower(text) WHERE regexp_full_match(text, '[a-zA-Z0-9.&_]*')),
target AS (SELECT doc_id, tok_id, "start", "end", text FROM tok WHERE text IN ('the', 'of', 'and', 'is', 'la'))"""
_SENSES = f"""senses(acronym, sense) AS (VALUES {values(SENSES)}),
s0 AS (SELECT DISTINCT acronym, sense FROM senses),
cand AS (SELECT t.*, CASE WHEN t.text IN (SELECT acronym FROM s0) THEN t.text WHEN upper(t.text) IN (SELECT acronym FROM s0) THEN upper(t.text) END AS key FROM target t),
full_ AS (SELECT c.doc_id, c.tok_id, c."start", c."end", s.sense, count(*) OVER (PARTITION BY c.doc_id, c.tok_id) AS k FROM cand c JOIN s0 s ON s.acronym = c.key)"""


@query(f"""WITH {_TOK}, {_CTX}, w AS (SELECT t.doc_id, t.tok_id, c.word_id, 1 / (1 + exp(0.3 * (CASE WHEN c.p < t.tok_id THEN t.tok_id - c.p ELSE c.p - t.tok_id - 1 END - 9))) AS w FROM target t JOIN ctx c ON c.doc_id = t.doc_id AND c.p BETWEEN t.tok_id - 12 AND t.tok_id + 12 AND c.p <> t.tok_id WHERE t.text = 'is')
SELECT doc_id, tok_id, word_id, round(sum(w), 6) AS weight FROM w GROUP BY ALL""")
def context_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ACR7: the band around each target, joined by buckets of positions."""
    t = tokens.tokens(docs(spark, sf_dir))
    v = acronyms.context_vectors(t, t.filter("text = 'is'"), spark.createDataFrame(VOCAB, "word string, word_id int"))
    return v.withColumn("weight", F.round("weight", 6))


@query(f"""WITH {_TOK}, {_CTX}, {_SENSES}, vec(sense, word_id, v) AS (VALUES {values(VECTORS)}),
w AS (SELECT t.doc_id, t.tok_id, c.word_id, sum(1 / (1 + exp(0.3 * (CASE WHEN c.p < t.tok_id THEN t.tok_id - c.p ELSE c.p - t.tok_id - 1 END - 9)))) AS w FROM target t JOIN ctx c ON c.doc_id = t.doc_id AND c.p BETWEEN t.tok_id - 12 AND t.tok_id + 12 AND c.p <> t.tok_id GROUP BY ALL),
d AS (SELECT f.doc_id, f.tok_id, f."start", f."end", f.sense, sum(w.w * vec.v) AS score FROM full_ f JOIN w USING (doc_id, tok_id) JOIN vec ON vec.sense = f.sense AND vec.word_id = w.word_id WHERE f.k > 1 GROUP BY ALL UNION ALL SELECT doc_id, tok_id, "start", "end", sense, 1.0 FROM full_ WHERE k = 1)
SELECT sense AS expansion, count(*) AS n, round(sum(score), 3) AS score FROM d WHERE score >= 0.001 GROUP BY sense""")
def acronym_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ACR5 to ACR8, by sense."""
    return _acronyms(spark, sf_dir).groupBy("expansion").agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("score"))


@query(f"""WITH {_TAGGED}, c AS (SELECT doc_id, "start", "end" FROM tagged WHERE tag NOT IN ({", ".join("'" + t + "'" for t in T.NO_ACRONYM_TAGS)})) SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id""")
def acronym_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ACR1, R24."""
    t = tagged(spark, sf_dir)
    return acronyms.candidates(t.select("doc_id", "start", "end", "text"), t.select("doc_id", "start", "end", "tag")).groupBy("doc_id").agg(F.count("*").alias("n"))


_LONG = [("the",), ("hth",), ("aia",), ("io",)]


@query(f"""WITH {_TOK}, w AS (SELECT DISTINCT regexp_replace(text, '[^a-zA-Z]', '', 'g') AS word FROM tok), k(word) AS (VALUES {values(_LONG)})
SELECT word, CASE WHEN lower(word) IN (SELECT word FROM k) THEN false WHEN len(word) < 2 THEN false WHEN regexp_full_match(lower(word), '[^a-z]*') THEN false WHEN regexp_full_match(lower(word), '[^bcdfghjklmnpqrstvwxz]*') THEN true WHEN regexp_full_match(lower(word), '[^aeiouy]*') THEN true ELSE false END AS looks FROM w WHERE word <> ''""")
def abbreviated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ACR10."""
    w = tokens.tokens(docs(spark, sf_dir)).select(F.regexp_replace("text", "[^a-zA-Z]", "").alias("word")).distinct().filter("word <> ''")
    known = F.lower("word").isin(*[x for x, in _LONG])
    return w.select("word", acronyms.looks_abbreviated(F.col("word"), known).alias("looks"))


_GRAMS = """words AS (SELECT text AS word FROM tok),
m AS (SELECT regexp_replace(regexp_replace(lower(word), '\\p{Nd}', '0', 'g'), '[^a-zA-Z0.\\-]', '?', 'g') AS w FROM words),
g AS (SELECT unnest(list_concat(list_transform(range(1, greatest(len(w), 1) + 1), lambda i: substr('^^' || w, i, 3)), [right(w, 1) || right(w, 1) || '$', right(w, 1) || '$$'])) AS g FROM m),
tri AS (SELECT substr(g, 1, 1) AS a, substr(g, 2, 1) AS b, substr(g, 3, 1) AS c, count(*) AS n3 FROM g GROUP BY ALL),
bi AS (SELECT b, c, sum(n3) AS n2 FROM tri GROUP BY ALL), uni AS (SELECT c, sum(n3) AS n1 FROM tri GROUP BY ALL), tot AS (SELECT sum(n1) AS n0, count(*) AS kinds FROM uni),
p1 AS (SELECT c, greatest((n1 - 0.9) / n0 + 0.9 * kinds / n0 / kinds, 1 / n0) AS p1 FROM uni, tot),
p2 AS (SELECT bi.b, bi.c, (n2 - 0.9) / t2 + 0.9 * k2 / t2 * p1 AS p2 FROM bi JOIN (SELECT b, sum(n2) AS t2, count(*) AS k2 FROM bi GROUP BY b) x ON x.b = bi.b JOIN p1 ON p1.c = bi.c),
p3 AS (SELECT tri.a, tri.b, tri.c, (n3 - 0.9) / t3 + 0.9 * k3 / t3 * p2 AS p FROM tri JOIN (SELECT a, b, sum(n3) AS t3, count(*) AS k3 FROM tri GROUP BY a, b) y ON y.a = tri.a AND y.b = tri.b JOIN p2 ON p2.b = tri.b AND p2.c = tri.c)"""


@query(f"WITH {_TOK}, {_GRAMS} SELECT a, b, c, round(ln(p), 6) AS logp FROM p3 UNION ALL SELECT NULL, b, c, round(ln(p2), 6) FROM p2 UNION ALL SELECT NULL, NULL, c, round(ln(p1), 6) FROM p1")
def letter_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ACR11, ACR12."""
    w = tokens.tokens(docs(spark, sf_dir)).select(F.col("text").alias("word"))
    return acronyms.train_trigrams(w).withColumn("logp", F.round("logp", 6))


@query()
def aligned_longforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ACR13, ACR14: capital letters and pairs of them against all cleaned words; a dynamic program without SQL form."""
    t = tokens.tokens(docs(spark, sf_dir))
    w = t.select(F.regexp_replace("text", r"[^\p{L}]", "").alias("w")).distinct()
    return acronyms.align_longforms(w.filter(F.col("w").rlike("^[A-Z][a-z]$")).select(F.col("w").alias("abbr")), w.filter("w <> ''").select(F.col("w").alias("longform")))


@query(f"""WITH {_TOK}, w AS (SELECT DISTINCT doc_id, CASE WHEN regexp_full_match(text, '[0-9]') THEN 'single_digit' WHEN regexp_full_match(text, '[0-9]*\\.[0-9]+') THEN 'decimal_number' ELSE lower(text) END AS word FROM tok WHERE regexp_full_match(text, '[a-zA-Z0-9.&_]*') AND NOT regexp_full_match(text, '[0-9][0-9,]+')
  UNION SELECT DISTINCT doc_id, 'big_number' FROM tok WHERE regexp_full_match(text, '[0-9][0-9]+')),
d AS (SELECT count(DISTINCT doc_id) AS n FROM tok) SELECT word, count(*) AS df, (row_number() OVER (ORDER BY word) - 1)::INTEGER AS word_id, round(ln((1 + n) / count(*)), 6) AS idf FROM w, d GROUP BY word, n""")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ACR15, ACR16, R21."""
    return acronyms.document_vocabulary(docs(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


# Tagging

_STATES = f"""{_TAGGED}, st AS (SELECT doc_id, sent_id, tok_id, tag || CASE WHEN regexp_matches(text, '^\\p{{Lu}}') THEN '+' ELSE '-' END AS s FROM tagged),
g AS (SELECT coalesce(lag(s, 2) OVER w, CASE WHEN tok_id = 0 THEN 'BBS-' ELSE 'BOS-' END) AS s1, coalesce(lag(s, 1) OVER w, 'BOS-') AS s2, s AS s3 FROM st WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY tok_id)),
tri AS (SELECT s1, s2, s3, count(*) AS c3 FROM g GROUP BY ALL), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, sent_id FROM st)),
bi AS (SELECT s2, s3, sum(c3)::BIGINT AS c2 FROM tri GROUP BY ALL UNION ALL SELECT 'BBS-', 'BOS-', n FROM n),
uni AS (SELECT s3, sum(c3)::BIGINT AS c1 FROM tri GROUP BY ALL UNION ALL SELECT unnest(['BBS-', 'BOS-']), n FROM n), tot AS (SELECT sum(c1) AS n FROM uni)"""


@query(f"WITH {_STATES} SELECT s1, s2, s3, c3 AS c FROM tri UNION ALL SELECT NULL, s2, s3, c2 FROM bi UNION ALL SELECT NULL, NULL, s3, c1 FROM uni")
def tag_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRN1, R15."""
    c, none = tagging.gram_counts(tagged(spark, sf_dir)), F.lit(None).cast("string")
    return c["tri"].withColumnRenamed("c3", "c").unionByName(c["bi"].select(none.alias("s1"), "s2", "s3", F.col("c2").alias("c"))).unionByName(c["uni"].select(none.alias("s1"), none.alias("s2"), "s3", F.col("c1").alias("c")))


@query(f"WITH {_STATES} SELECT t.s1, t.s2, t.s3, round(coalesce(t.c3 / b.c2, 0), 6) AS p3, round(b2.c2 / u.c1, 6) AS p2, round(u3.c1 / tot.n, 6) AS p1 FROM tri t LEFT JOIN bi b ON b.s2 = t.s1 AND b.s3 = t.s2 JOIN bi b2 ON b2.s2 = t.s2 AND b2.s3 = t.s3 JOIN uni u ON u.s3 = t.s2 JOIN uni u3 ON u3.s3 = t.s3, tot")
def tag_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRN2, POS5, R16."""
    m = tagging.mle(tagging.gram_counts(tagged(spark, sf_dir)))
    return m["tri"].join(m["bi"], ["s2", "s3"]).join(m["uni"], "s3").select("s1", "s2", "s3", F.round("p3", 6).alias("p3"), F.round("p2", 6).alias("p2"), F.round("p1", 6).alias("p1"))


@query(f"""WITH {_STATES}, r AS (SELECT t.c3, coalesce((t.c3 - 1) / nullif(b.c2 - 1, 0), 0) AS r3, coalesce((b2.c2 - 1) / nullif(u2.c1 - 1, 0), 0) AS r2, coalesce((u3.c1 - 1) / nullif(tot.n - 1, 0), 0) AS r1 FROM tri t LEFT JOIN bi b ON b.s2 = t.s1 AND b.s3 = t.s2 LEFT JOIN bi b2 ON b2.s2 = t.s2 AND b2.s3 = t.s3 LEFT JOIN uni u2 ON u2.s3 = t.s2 LEFT JOIN uni u3 ON u3.s3 = t.s3, tot),
o AS (SELECT c3, CASE WHEN r3 >= r2 AND r3 >= r1 THEN 3 WHEN r2 >= r1 THEN 2 ELSE 1 END AS o FROM r)
SELECT round(coalesce(sum(c3) FILTER (o = 1), 0) / sum(c3), 6) AS l1, round(coalesce(sum(c3) FILTER (o = 2), 0) / sum(c3), 6) AS l2, round(coalesce(sum(c3) FILTER (o = 3), 0) / sum(c3), 6) AS l3 FROM o""")
def tag_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRN3, R17."""
    one = tagging.interpolation(tagging.gram_counts(tagged(spark, sf_dir)))
    return one.select(*[F.round(c, 6).alias(c) for c in one.columns])


_WORDS = f"""{_TAGGED}, wc AS (SELECT regexp_matches(text, '^\\p{{Lu}}') AS cap, lower(text) AS word, tag, count(*) AS c FROM tagged GROUP BY ALL)"""


@query(f"WITH {_WORDS}, t AS (SELECT cap, tag, sum(c) AS n FROM wc GROUP BY ALL) SELECT wc.cap, word, wc.tag, round(log10(c / n), 6) AS logp FROM wc JOIN t ON t.cap = wc.cap AND t.tag = wc.tag")
def known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRN4, POS3."""
    return tagging.known_words(tagged(spark, sf_dir)).withColumn("logp", F.round("logp", 6))


_SUFFIXES = f"""WITH {_WORDS}, rare AS (SELECT * FROM (SELECT *, sum(c) OVER (PARTITION BY cap, word) AS n FROM wc) WHERE n <= 20),
s AS (SELECT cap, suffix, tag, sum(c) AS c FROM (SELECT cap, tag, c, unnest(list_transform(range(0, least(5, len(word)) + 1), lambda k: substr(word, len(word) - k + 1))) AS suffix FROM rare) GROUP BY ALL)"""


@query(f"{_SUFFIXES} SELECT cap, suffix, tag, c::BIGINT AS c FROM s")
def word_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRN4, R18: all suffixes of rare words."""
    rare = tagging.word_counts(tagged(spark, sf_dir), tagging.RARE)
    return rare.select("cap", "tag", "c", F.explode(T.suffixes(F.col("word"), 5)).alias("suffix")).groupBy("cap", "suffix", "tag").agg(F.sum("c").alias("c"))


_FOLD = ", ".join(
    f"l{k} AS (SELECT n.cap, n.suffix, l.tag, l.p0, (coalesce(s.c / n.n, 0) + w.w * l.p) / (1 + w.w) AS p FROM n JOIN l{k - 1} l ON l.cap = n.cap AND l.suffix = substr(n.suffix, 2) JOIN w ON w.cap = n.cap AND w.k = {k} LEFT JOIN s ON s.cap = n.cap AND s.suffix = n.suffix AND s.tag = l.tag WHERE len(n.suffix) = {k})"
    for k in range(1, 6)
)


@query(f"""{_SUFFIXES}, n AS (SELECT cap, suffix, sum(c) AS n FROM s GROUP BY ALL), t AS (SELECT cap, n AS t FROM n WHERE suffix = ''),
g AS (SELECT cap, len(suffix) AS k, tag, sum(c) AS c FROM s GROUP BY ALL), w AS (SELECT cap, k, coalesce(stddev_samp(p), 0) AS w FROM (SELECT cap, k, c / sum(c) OVER (PARTITION BY cap, k) AS p FROM g) GROUP BY ALL),
l0 AS (SELECT cap, '' AS suffix, tag, c / t AS p0, c / t AS p FROM s JOIN t USING (cap) WHERE suffix = ''), {_FOLD},
l AS ({" UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(1, 6))})
SELECT cap, suffix, tag, round(log10(p * n / t / p0), 6) AS logp FROM l JOIN n USING (cap, suffix) JOIN t USING (cap) WHERE p > 0""")
def suffix_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRN5, R19: an ordered fold over shorter suffixes, which SQL does level by level."""
    return tagging.suffix_model(tagged(spark, sf_dir)).withColumn("logp", F.round("logp", 6))


@query()
def tagged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """POS1 to POS9, TRN6: a model trained on tags by length, decoded again; Viterbi has no SQL form."""
    return tagging.tag_by_tables(tokens.sentences(docs(spark, sf_dir)), tagging.train(tagged(spark, sf_dir)))


# Formats, sampling, metrics


@query("SELECT CAST(doc_id AS VARCHAR) AS event_id, md5(text) AS text, CASE WHEN len(text) > 0 THEN 0 END::INTEGER AS bold_start, CASE WHEN len(text) > 0 THEN least(5, len(text)) END::INTEGER AS bold_end FROM documents")
def rtf_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RTF1 to RTF15: all texts written as RTF with the first five characters bold, and read back."""
    written = rtf.text_to_rtf(docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("event_id"), "text"), 5)
    bold = F.try_element_at("formats", F.lit(1))
    return rtf.rtf_to_text(written).select("event_id", F.md5("text").alias("text"), bold["start"].alias("bold_start"), bold["end"].alias("bold_end"))


@query("SELECT doc_id, ((row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1) // 100 + 1)::BIGINT AS batch FROM documents")
def sample_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP1."""
    return sections.batches(docs(spark, sf_dir).select("doc_id"), 100, 7)


@query("SELECT doc_id FROM documents ORDER BY md5('3:' || doc_id), doc_id LIMIT 50")
def sample_fifty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP2; the limit is the sample's size."""
    return sections.sample_n(docs(spark, sf_dir).select("doc_id"), 50, 3)


@query("SELECT doc_id, CASE WHEN CAST('0x' || substr(md5('5:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.2 THEN 'eval' ELSE 'train' END AS part FROM documents")
def train_eval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP3, R28."""
    return sections.split(docs(spark, sf_dir).select("doc_id"), 0.2, 5)


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND text NOT LIKE '%!!%') AS tp, count(*) FILTER (quality <> 1 AND text NOT LIKE '%!!%') AS fp, count(*) FILTER (quality = 1 AND text LIKE '%!!%') AS fn FROM labels JOIN documents USING (doc_id))
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET2, MET4, R31: a rule against the labels."""
    l = read(spark, sf_dir, "labels").join(docs(spark, sf_dir), "doc_id")
    m = sections.confusion(l.filter("quality = 1"), l.filter(~F.col("text").contains("!!")), ["doc_id"])
    return m.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT round(avg((CASE WHEN text LIKE '%!!%' THEN 0 ELSE 1 END = quality)::DOUBLE), 6) AS accuracy FROM labels JOIN documents USING (doc_id)")
def label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET1."""
    pred = docs(spark, sf_dir).select("doc_id", F.when(F.col("text").contains("!!"), 0).otherwise(1).alias("quality"))
    gold = read(spark, sf_dir, "labels").join(docs(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")
    return sections.accuracy(gold, pred, ["doc_id"], "quality").withColumn("accuracy", F.round("accuracy", 6))


@query(f"""WITH {_TOK}, {_SENT}, {_CAPS}, l AS (SELECT doc_id, '[' || string_agg('{{"start":' || "start" || ',"end":' || "end" || '}}', ',' ORDER BY "start", "end") || ']' AS j FROM caps GROUP BY doc_id)
SELECT d.doc_id, '{{"doc_id":' || d.doc_id || ',"text":' || CAST(to_json(d.text) AS VARCHAR) || ',"label_indices":{{"caps":' || coalesce(l.j, '[]') || '}}}}' AS json FROM documents d LEFT JOIN l USING (doc_id)""")
def serialised_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1, R23."""
    return writers.serialise(docs(spark, sf_dir), {"caps": _capitals(spark, sf_dir)})


from . import more_queries, source_queries  # noqa: E402, F401  (they register theirs)
