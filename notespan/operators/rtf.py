"""RTF to text (RTF): a tokenizer and group stack, in Arrow batches.

Text of the document proper survives; other destinations, hidden text and unknown
starred groups don't. Format spans end with their group and at the end of the file
(Q19), and groups inherit the character set (Q20).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CONTROL = re.compile(rb"\\(?:'([0-9a-fA-F]{2})|([a-zA-Z]{1,32})(-?[0-9]{1,10})? ?|(.))|([{}])|([\r\n\0])|([^\\{}\r\n\0]+)", re.S)
_CHARSET = {"ansi": "cp1252", "mac": "mac_roman", "pc": "cp437", "pca": "cp850"}
_OUT = dict.fromkeys("par line row cell nestrow nestcell lbr".split(), "\n") | dict.fromkeys("sect page column".split(), "\n\n")
_OUT |= {"tab": "\t", "emdash": "—", "endash": "–", "emspace": " ", "enspace": " ", "qmspace": " ", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "zwbo": "​", "zwnbo": "﻿", "zwj": "‍", "zwnj": "‌"}
_SYMBOL = {"~": " ", "-": "­", "_": "‑", "\\": "\\", "{": "{", "}": "}", "\n": "\n", "\r": "\r"}
_KEPT = {"rtf", "ud"}
#: Families of words that divert text, by stem.
_AWAY = re.compile(
    r"(?:font|color|file|rev|list|listoverride)tbl|stylesheet|info|(?:header|footer)[lrf]?|(?:ft|aft)n(?:sep|sepc|cn)|footnote|annotation|atn(?:author|date|icn|id|parent|ref|time)|atrf(?:end|start)"
    r"|bkmk(?:start|end)|pict|field|fldinst|fldrslt|upr|private1?|nonesttables|object|objdata|shp\w*|rxe|txe|xe|tc|title|subject|author|operator|keywords|comment|doccomm|company|manager|category|version"
    r"|buptim|creatim|printim|revtim|generator|themedata|datastore|latentstyles"
)
_SPANS = {"b": "bold", "i": "italic", "ul": "underlined"}
_RESET = {"plain": ("b", "i", "ul", "v")}


def parse(data: bytes, strict_reference: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """Text, and (kind, start, end) of formats. What isn't RTF is taken byte by byte as Latin-1 (RTF1)."""
    if data[:6] != b"{\\rtf1":
        return data.decode("latin-1"), []
    out: list[str] = []
    size, skip = 0, 0
    spans: list[tuple[str, int, int]] = []
    opened: dict[str, int] = {}
    state = {"kept": False, "charset": "cp1252", "uc": 1, "b": 0, "i": 0, "ul": 0, "v": 0}
    stack: list[dict] = []
    starred = False

    def put(s: str) -> None:
        nonlocal size
        if state["kept"] and state["v"] < 1:
            out.append(s)
            size += len(s)

    def turn(word: str, value: int) -> None:
        state[word] = value
        kind = _SPANS.get(word)
        if kind and value >= 1 and kind not in opened:
            opened[kind] = size
        elif kind and value < 1 and kind in opened:
            start = opened.pop(kind)
            if start < size:
                spans.append((kind, start, size))

    def close() -> None:
        nonlocal state
        before, state = state, stack.pop()
        if not strict_reference:
            after = {w: state[w] for w in _SPANS}
            kept = state
            state = before | {"kept": kept["kept"]}
            for w, v in after.items():
                if v != before[w]:
                    turn(w, v)
            state = kept

    at = 0
    while at < len(data):
        m = _CONTROL.match(data, at)
        if not m:
            break
        at = m.end()
        code, word, number, symbol, brace, blank, text = m.groups()
        if brace == b"{":
            stack.append(dict(state))
            skip, starred = 0, False
        elif brace == b"}":
            skip, starred = 0, False
            if stack:
                close()
        elif blank:
            continue
        elif text is not None:
            if skip:
                n = min(skip, len(text))
                text, skip = text[n:], skip - n
            if text:
                put(text.decode(state["charset"], "replace"))
            starred = False
        elif code is not None:
            if skip:
                skip -= 1
            else:
                put(bytes([int(code, 16)]).decode(state["charset"], "replace"))
        elif symbol is not None:
            s = symbol.decode("latin-1")
            if s == "*":
                starred = True
            elif s in _SYMBOL:
                if skip:
                    skip -= 1
                else:
                    put(_SYMBOL[s])
        else:
            w = word.decode("ascii")
            n = int(number) if number else None
            if w == "bin":
                at = min(len(data), at + max(0, n or 0))
            elif w == "u":
                if n is not None:
                    put(chr(n % 65536))
                    skip = state["uc"]
            elif w == "uc":
                state["uc"] = max(0, n if n is not None else 1)
            elif w in _CHARSET:
                state["charset"] = _CHARSET[w]
            elif w in _OUT:
                put(_OUT[w])
            elif w in _KEPT:
                state["kept"] = True
            elif _AWAY.fullmatch(w):
                state["kept"] = False
            elif w in _RESET:
                for x in _RESET[w]:
                    turn(x, 0)
            elif w in ("b", "i", "ul", "v"):
                turn(w, 1 if n is None else n)
            elif w == "ulnone":
                turn("ul", 0)
            elif starred:
                state["kept"] = False
            starred = False
    if not strict_reference:
        for w in _SPANS:
            turn(w, 0)
    joined = "".join(out)
    if any("\ud800" <= c <= "\udfff" for c in joined):  # pairs of \u halves make one character
        raw = joined.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
        position, k = [], 0
        for c in raw:
            position += [k] if ord(c) < 65536 else [k, k]
            k += 1
        position.append(k)
        spans = [(kind, position[a], position[b]) for kind, a, b in spans]
        joined = raw
    return joined, sorted(spans, key=lambda s: (s[1], s[2], s[0]))


def rtf_to_text(binaries: DataFrame, column: str = "content", strict_reference: bool = False) -> DataFrame:
    """RTF15: ``event_id`` with text and formats (array of kind, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            parsed = [parse(x or b"", strict_reference) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in parsed], pa.string()), pa.array([[{"kind": k, "start": a, "end": e} for k, a, e in f] for _, f in parsed], kind)], names=["event_id", "text", "formats"])

    return binaries.select(F.col("event_id").cast("string").alias("event_id"), F.col(column).cast("binary").alias("content")).mapInArrow(run, "event_id string, text string, formats array<struct<kind:string,start:int,end:int>>")


def format_spans(texts: DataFrame) -> DataFrame:
    """RTF14: event_id, kind, start, end."""
    return texts.select("event_id", F.explode("formats").alias("f")).select("event_id", "f.*")


_PLAIN = re.compile(r"[^ -\[\]-z|~]")
_WRITTEN = {"\n": "\\par ", "\t": "\\tab ", "\\": "\\\\", "{": "\\{", "}": "\\}"}


def _escaped(m: re.Match) -> str:
    c = m.group()
    if c in _WRITTEN:
        return _WRITTEN[c]
    units = c.encode("utf-16-le", "surrogatepass")
    return "".join(f"\\u{int.from_bytes(units[k : k + 2], 'little', signed=True)}?" for k in range(0, len(units), 2))


def text_to_rtf(texts: DataFrame, bold: int = 0) -> DataFrame:
    """RTF files (event_id, content) of texts, their first ``bold`` characters bold; what ``rtf_to_text`` reads back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            esc = [(_PLAIN.sub(_escaped, (t or "")[:bold]), _PLAIN.sub(_escaped, (t or "")[bold:])) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([("{\\rtf1\\ansi {\\fonttbl{\\f0 Arial;}}{\\b " + x + "}" + y + "}").encode("ascii") for x, y in esc], pa.binary())], names=["event_id", "content"])

    return texts.select(F.col("event_id").cast("string").alias("event_id"), "text").mapInArrow(run, "event_id string, content binary")
