"""Column functions on text: cleaning, word forms, tag classes. All stay in the JVM."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCT_TAGS = (".", ",", ":", "(", ")", "``", "''", "`", "'", '"', "HYPH", "#", "$")
OPEN_TAGS = tuple("JJ JJR JJS NN NNP NNPS RB RBR RBS VB VBD VBG VBN VBP VBZ".split())
SENTINEL_TAGS = ("XX", "BBS", "BOS", "EOS")
TRIVIAL_TAGS = (*"DT WDT TO CC PRP PRP$ MD EX IN XX".split(), *PUNCT_TAGS)
NO_ACRONYM_TAGS = tuple(sorted("TO IN DT PDT WDT WP WP$ PRP CC MD POS RP UH".split()))
STOPWORDS = tuple(sorted("was on to with of a and by for nos the in".split()))
UNIVERSAL_OPEN = ("ADJ", "ADV", "INTJ", "NOUN", "PROPN", "VERB")
UNIVERSAL_CLOSED = ("ADP", "AUX", "CCONJ", "DET", "NUM", "PART", "PRON", "SCONJ")

#: Other spellings of tags, to the ones used here.
TAG_ALIASES = {"NP": "NNP", "NPS": "NNPS", "PP": "PRP", "PP$": "PRP$", "-LRB-": "(", "-RRB-": ")", "-LCB-": "(", "-RCB-": ")", "-LSB-": "(", "-RSB-": ")", "--": ":", ";": ":", "?": ".", "!": ".", "-": "HYPH"}


def clean_notes(text: Column) -> Column:
    """PRE1: a clinical note for embedding training; de-identified names, phones and others become marks (Q29, Q30 kept)."""
    t = F.lower(text)
    for pattern, mark in (
        (r"\[[*]{2}\s*\d{1,4}[-/]\d{1,2}(?:[-/]\d{1,4})?\s*[*]{2}\]", "\u0001"),
        (r"\[[*]{2}.*name.*[*]{2}\]", "NAME"),
        (r"\[[*]{2}.*telephone.*[*]{2}\]", "###-###-###"),
        (r"\[[*]{2}.*[*]{2}\]", "IDENTIFIER"),
    ):
        t = F.regexp_replace(t, pattern, mark)
    return clean_marks(t)


def clean_marks(text: Column) -> Column:
    """What isn't a word or # becomes a space, digits become #."""
    return F.regexp_replace(F.regexp_replace(text, r"[^#\p{L}\p{N}_]+", " "), r"\p{Nd}", "#")


def clean_articles(text: Column) -> Column:
    """PRE2."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "), r"\p{Nd}", "#")


def trigger_word(token: Column) -> Column:
    """NEG cleaning: lower case without marks except / and -."""
    return F.regexp_replace(F.lower(token), r"[^\p{L}\p{N}_/\-]+", "")


_NO_TRIGGER = regex.compile(r"[^\p{L}\p{N}_/\-]+")


def cleaned_trigger(word: str) -> str:
    """``trigger_word`` of a string, for loops over distinct words."""
    return _NO_TRIGGER.sub("", word.lower())


def standard_acronym(token: Column) -> Column:
    """ACR3: & and + are written /."""
    return F.translate(token, "&+", "//")


def context_form(token: Column) -> Column:
    """ACR4: numbers by kind, all else in lower case."""
    number = F.when(token.rlike(r"^[0-9]$"), "single_digit").when(token.rlike(r"^[0-9]*\.[0-9]+$"), "decimal_number")
    return number.when(token.rlike(r"^[0-9][0-9,]+$"), "big_number").otherwise(F.lower(token))


def known_tag(tag: Column) -> Column:
    """POS10: aliases by table; other tags as they are."""
    pairs = F.create_map(*[F.lit(x) for kv in TAG_ALIASES.items() for x in kv])
    return F.coalesce(F.element_at(pairs, tag), tag)


def is_punctuation(tag: Column) -> Column:
    return tag.isin(*PUNCT_TAGS)


def is_open(tag: Column) -> Column:
    """POS11; NNS isn't in the class (Q31 kept)."""
    return tag.isin(*OPEN_TAGS)


def is_real(tag: Column) -> Column:
    return ~tag.isin(*SENTINEL_TAGS)


def is_trivial(tag: Column) -> Column:
    """CON1a."""
    return tag.isin(*TRIVIAL_TAGS)


def is_stopword(norm: Column) -> Column:
    """CON1b."""
    return norm.isin(*STOPWORDS)


def is_punct_text(text: Column) -> Column:
    """CON1c."""
    return text.rlike(r"^\p{Punct}+$")


def suffixes(word: Column, most: int) -> Column:
    """The word's suffixes of at most ``most`` characters, the longest first, the empty one last."""
    n = F.length(word)
    return F.transform(F.sequence(F.least(F.lit(most), n), F.lit(0), F.lit(-1)), lambda k: F.substring(word, n - k + 1, k))


def space_after(text: Column, end: Column) -> Column:
    """TOK3: whether white space or nothing follows."""
    return F.substring(text, end + 1, F.lit(1)).rlike(r"^\s?$")


def type_number(tn: Column) -> Column:
    """CON10, D12: a tree number as letter and whole numbers (Q35: more than one digit a level)."""
    return F.struct(F.substring(tn, 1, 1).alias("category"), F.transform(F.filter(F.split(F.substring(tn, F.lit(2), F.length(tn)), r"\."), lambda x: x != ""), lambda x: x.cast("int")).alias("path"))


def is_a(child: Column, parent: Column) -> Column:
    """Whether a tree number lies at or below another."""
    c, p = type_number(child), type_number(parent)
    return (c["category"] == p["category"]) & (F.size(p["path"]) <= F.size(c["path"])) & (F.slice(c["path"], F.lit(1), F.size(p["path"])) == p["path"])


def valid_cui(cui: Column) -> Column:
    return cui.rlike(r"^C\d{7}$")


def valid_sui(sui: Column) -> Column:
    return sui.rlike(r"^S\d{7,8}$")


def valid_tui(tui: Column) -> Column:
    return tui.rlike(r"^T\d{3}$")
