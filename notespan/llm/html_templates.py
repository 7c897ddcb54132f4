"""Main text of pages by equivalence classes of template tokens.

Pages of one host are compared in blocks. A page is a sequence of tokens: tags
with their attributes' names and class, and words. Tokens that occur equally often
on every page of the block, page by page, share an occurrence vector and form an
equivalence class; a class of several tokens, in the same order on all pages and
nested without overlap in the classes found so far, belongs to the template; a
class that repeats, whatever its vector, does so in that order every time. What
lies between two template tokens is a slot. Slots inside parts that never hold
main text (by tag or class: menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, comments) are dropped, and so is what lies outside the
template's article or main element if there is such an element; of the others,
every slot whose text isn't the template's own is kept. Inside an article that
takes ``LEAST_PAGES`` different pages, since what two or three share may be content.

Scale. Hosts are counted first; a host of over one and a half blocks is split by a hash
of its pages into blocks of about ``BLOCK``, so a large host is many blocks in many
partitions, and the number of partitions changes nothing.

Defined cases: a null or empty page has an empty text; a page that is alone in its
block has no template, so the structural rule alone decides; null urls are a host
of their own. Unclosed elements end where their parent does. White space inside a
block becomes one space; blocks are joined by an empty line. Repeated rows are
rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches, stored

BLOCK, LEAST_CLASS, LEAST_PAGES = 64, 3, 4

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_OUT_TAGS = frozenset("head nav header footer aside form button menu dialog title".split())
# A class or id as a whole names what never holds main text: "comments-list" does, "comment-analysis" doesn't.
_PLACE = r"(?:(?:site|page|main|top|bottom|left|right|global|primary|secondary|sub|post|entry|article|content|user|reader|blog|mobile|desktop|sticky|side|footer|header|google|web|js)[-_])*"
_PART = r"(?:[-_](?:list|section|area|box|bar|wrap(?:per)?|container|inner|outer|block|links?|buttons?|icons?|form|menu|nav|panel|unit|slot|top|bottom|left|right|main|primary|secondary|posts?|articles?|stories|items?|content|widgets?|title|heading|count|thread|notice|banner|overlay|\d+))*"
_OUT_NAMES = re.compile(_PLACE + r"(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav(?:bar|igation)?|menu\w*|masthead|footer|side-?bar|aside|related|shar(?:e|ing)|social|comments?|replies|disqus\w*|respond|notices?|cookies?\w*|consent|gdpr|popup|modal|newsletter|subscri(?:be|ption)|login|search|breadcrumbs?|pagination|pager|widgets?|skip)" + _PART, re.I)
_HEADER = re.compile(r"(?:(?:site|page|main|top|global|primary|blog)[-_])*header" + _PART, re.I)
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
_BLOCKS = frozenset("p div article main section h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th thead tbody tfoot caption pre blockquote figure figcaption hr body html address details summary nav header footer aside form fieldset".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS = {"p": _BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
_HOLD = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
_SPACE = re.compile(r"\s+")


class Page:
    """Tokens of a page, with the element each one is in."""

    def __init__(self, source: str):
        self.tokens: list[str] = []
        self.block: list[int] = []  # number of the text block, -1 for tags
        self.raw: dict[int, list[str]] = defaultdict(list)
        self.out: dict[int, bool] = {}
        self.inner: dict[int, bool] = {}
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, bool, bool]] = [("", False, False)]  # name, left out, in article
        now, at = 0, 0
        for m in [*_TAG.finditer(source), None]:
            chunk = source[at : m.start() if m else len(source)]
            if chunk:
                text = html.unescape(chunk)
                if text.strip():
                    self.out.setdefault(now, stack[-1][1])
                    self.inner.setdefault(now, stack[-1][2])
                    words = text.split()
                    self.tokens += words
                    self.block += [now] * len(words)
                if now in self.out:
                    self.raw[now].append(text)
            if not m:
                break
            at = m.end()
            name = (m.group(3) or "").lower()
            if not name:
                continue
            close = bool(m.group(2))
            if name in _BLOCKS:
                now += 1
            elif name == "br" and now in self.out:
                self.raw[now].append("\n")
            if close:
                self.tokens.append(f"</{name}>")
                self.block.append(-1)
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        if stack[k][1] != stack[k - 1][1]:
                            now += 1
                        del stack[k:]
                        break
                continue
            given = {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(m.group(4) or "")}
            while stack[-1][0] in _ENDS and name in _ENDS[stack[-1][0]]:
                stack.pop()
            for k in range(len(stack) - 1, 0, -1):  # an item ends the open item of its own list
                if stack[k][0] in _HOLD.get(name, ()):
                    break
                if name in _ENDS.get(stack[k][0], ()) and stack[k][0] in _HOLD:
                    del stack[k:]
                    break
            known = f"{given.get('class', '')} {given.get('id', '')}".split()
            out = name in _OUT_TAGS or given.get("role", "").lower() in _OUT_ROLES or "hidden" in given or given.get("aria-hidden") == "true" or any(map(_OUT_NAMES.fullmatch, known))
            # A header inside the article belongs to the article.
            if name == "header" and stack[-1][2] and not any(map(_OUT_NAMES.fullmatch, known)):
                out = False
            out = out or not stack[-1][2] and any(map(_HEADER.fullmatch, known))
            if name in ("html", "body", "article", "main"):
                out = False
            self.tokens.append(f"<{name} {' '.join(sorted(given))} {given.get('class', '')}>")
            self.block.append(-1)
            if name in _VOID or (m.group(4) or "").rstrip().endswith("/"):
                continue
            if out and not stack[-1][1]:
                now += 1
            stack.append((name, stack[-1][1] or out, stack[-1][2] or name in ("article", "main") or given.get("role") == "main"))

    def text(self, number: int) -> str:
        return _SPACE.sub(" ", "".join(self.raw[number])).strip()


def template(pages: list[Page]) -> list[tuple[str, int]]:
    """The template's tokens, each with the number of its occurrence on a page: valid classes, nested into one another."""
    if len(pages) < 2:
        return []
    counts = [Counter(p.tokens) for p in pages]
    common = set.intersection(*(set(c) for c in counts))
    classes: dict[tuple[int, ...], list[str]] = defaultdict(list)
    for t in common:
        classes[tuple(c[t] for c in counts)].append(t)
    where = [defaultdict(list) for _ in pages]
    for w, p in zip(where, pages):
        for i, t in enumerate(p.tokens):
            if t in common:
                w[t].append(i)
    # One occurrence a page: order must agree on all pages. Larger classes first; a token that breaks the order of
    # those taken would make overlapping classes and is left out.
    taken: list[str] = []
    for vector, tokens in sorted(classes.items(), key=lambda x: (-len(x[1]), x[0])):
        if len(tokens) < LEAST_CLASS or set(vector) != {1}:
            continue
        taken += sorted(tokens, key=lambda t: where[0][t][0])
    taken.sort(key=lambda t: where[0][t][0])
    for w in where[1:]:
        taken = _ordered(taken, [w[t][0] for t in taken])
    # Tokens that occur oftener, equally on all pages, have a role for each gap of the template that they are found in.
    edges = [[w[t][0] for t in taken] for w in where]
    out = [(t, 0) for t in taken]
    for vector, tokens in classes.items():
        if len(set(vector)) == 1 and vector[0] > 1 and taken:
            for t in tokens:
                for j in range(vector[0]):
                    if len({bisect_left(e, w[t][j]) for e, w in zip(edges, where)}) == 1:
                        out.append((t, j))
        elif len(set(vector)) > 1 and len(tokens) >= LEAST_CLASS and _repeats(tokens, where, edges):
            out += [(t, j) for t in tokens for j in range(max(vector))]
    return out


def _repeats(tokens: list[str], where: list[dict[str, list[int]]], edges: list[list[int]]) -> bool:
    """Whether the tokens come in the same order in every repetition on every page, each repetition inside one gap of the template."""
    order = sorted(tokens, key=lambda t: where[0][t][0])
    for w, e in zip(where, edges):
        at = [i for turn in zip(*(w[t] for t in order)) for i in turn]
        if at != sorted(at) or any(bisect_left(e, at[i]) != bisect_left(e, at[i + len(order) - 1]) for i in range(0, len(at), len(order))):
            return False
    return True


def _ordered(tokens: list[str], at: list[int]) -> list[str]:
    """The longest part of ``tokens`` whose places increase."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, x in enumerate(at):
        k = bisect_left(tops, x)
        tops[k : k + 1] = [x]
        ends[k : k + 1] = [i]
        back.append(ends[k - 1] if k else -1)
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(tokens[i])
        i = back[i]
    return out[::-1]


def extract(pages: list[Page]) -> list[str]:
    """Main texts of a block's pages."""
    return [text for text, _ in extracted(pages)]


def extracted(pages: list[Page]) -> list[tuple[str, bool]]:
    """Main texts of a block's pages, and whether the template's slots decided what is in them."""
    # Copies of a page tell nothing of its template.
    different = list({tuple(zip(p.tokens, p.block)): p for p in pages}.values())
    own = set(template(different))
    framed = any(t.startswith(("<article ", "<main ")) for t, _ in own)
    out = []
    for p in pages:
        kept = [n for n in sorted(p.raw) if not p.out[n]]
        inside = framed or any(p.inner[n] for n in kept)
        if inside:
            kept = [n for n in kept if p.inner[n]]
        free: Counter = Counter()
        seen: Counter = Counter()
        for t, n in zip(p.tokens, p.block):
            if n >= 0 and (t, seen[t]) not in own:
                free[n] += 1
            seen[t] += 1
        by_slots = bool(own) and (not inside or len(different) >= LEAST_PAGES)
        if by_slots:
            kept = [n for n in kept if free[n]]
        out.append(("\n\n".join(t for t in (p.text(n) for n in kept) if t), by_slots))
    return out


SCHEMA = "page_id long, url string, text string, n_chars long, by_template boolean"
#: Hosts of over a block's pages that are broadcast with their number of blocks; more of them are joined by a shuffle.
LARGE_HOSTS = 1_000_000


def main_texts(pages: DataFrame, block: int = BLOCK) -> DataFrame:
    """page_id, url, text and n_chars of every page, and whether a template decided."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))
    many = pages.groupBy(host.alias("large")).count().filter(2 * F.col("count") > 3 * block)
    many = stored(many.select("large", F.round(F.col("count") / block).cast("int").alias("blocks")), "large hosts")
    few = many.count() <= LARGE_HOSTS
    rows = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    rows = rows.join(F.broadcast(many) if few else many, F.col("host") == F.col("large"), "left")
    # Copies of a page lie in one block, where they tell nothing of the template; other pages are spread evenly.
    rows = rows.withColumn("h", F.xxhash64("page_id", "url")).withColumn("part", F.pmod("h", F.coalesce("blocks", F.lit(1)))).drop("large", "blocks")
    grouped = rows.repartition(partitions(pages.sparkSession), "host", "part").sortWithinPartitions("host", "part", "h", "page_id", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows):
            texts = extracted([Page(r[2]) for r in rows])
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([t for t, _ in texts], pa.string()), pa.array([len(t) for t, _ in texts], pa.int64()), pa.array([x for _, x in texts])], names=[x.split()[0] for x in SCHEMA.split(", ")])

        held: list[tuple] = []
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(5))):
                # Of one page repeated without end a block's worth is compared at a time.
                if held and (held[-1][3:] != r[3:] or len(held) == 4 * block):
                    yield done(held)
                    held = []
                held.append(r)
        if held:
            yield done(held)

    return grouped.select("page_id", "url", "html", "host", "part").mapInArrow(run, SCHEMA)
