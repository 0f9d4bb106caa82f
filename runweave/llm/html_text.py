"""Main text of web pages by two passes of block rules.

A page becomes blocks: text between tags that are not inline. What a block stands in (menus, forms, notices and
the like; words of class, id and role, but for those of html and body) can only rule it out. Pass 1 decides the
rest by link density, length and stop-word density. Pass 2 gives blocks that it left open, short ones mostly, the
label of the nearest decided neighbours; in an article these are found among its own blocks and its ends.

A hint that would delete the page's text is no hint: a form counts as a wrapper where it holds an article or half of
the running text; one without its end tag (but for those of comments and adverts) rules out only what comes before an article or running text inside
it; and where all running text is ruled out, the elements that hold most of it are taken for wrappers, those of layout
words first, those of comments and adverts last, until some is free.

Null or empty html, and pages without good blocks, have an empty text. Repeated rows are extracted each; columns
other than the ids and the html are left out. Time is linear in the page's length, however deep its elements.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Function words of four languages. Fixed values.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you "
    "aber als am auch auf aus bei bin das dass dem den der des die du ein eine einem einen einer er es für hat ich im in ist ja mit nach nicht noch nur oder sich sie sind so über um und uns vom von vor war was wie wir zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur un une vous y "
    "al como con cuando del el ella ellos entre era es esta este está fue ha hay las lo los más me muy no nos o para pero por que se si sin sobre su sus también todo una uno ya".split()
)

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements without content, and those whose content is never text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NOT_TEXT = frozenset("head noscript template svg math object canvas audio video select datalist map".split())
#: Elements, and words in class, id or role, of what stands around an article.
AROUND = frozenset("nav footer aside form menu dialog button fieldset".split())
AROUND_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|gdpr|popup|modal|overlay|nav\w*|menu\w*|breadcrumbs?|sidebar|side-?bar|aside|foot|footer|masthead|site-?header|page-?header|"
    r"comments?|comment-?list|replies|disqus|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|signup|login|search|pagination|pager|toolbar|widget|copyright|complementary|contentinfo|navigation|skip-?link)(?:$|[\s_-])",
    re.I,
)

#: Those of them whose articles are not the page's own.
OTHERS_WORDS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|comment-?list|replies|disqus|respond|related|recommend\w*)(?:$|[\s_-])", re.I)

#: Thresholds of pass 1: share of linked characters, characters, share of stop words; and the share in a page's words below which its language is none of ours.
MOST_LINKED, SHORT, LONG, STOP_LOW, FOREIGN = 0.33, 70, 140, 0.20, 0.05

_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?>[^\"'>]|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|$)|<[a-zA-Z][^>]*(?:>|$)", re.S)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HREF = re.compile(r"(?:^|[\s/\"])href(?=[\s=/]|$)", re.I)
_ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Veto:
    """An element that rules its content out. outer: the veto around it, or -1; first: its first block; article: the first block of the first article inside it, if any; closed: whether it has an end tag."""

    kind: str
    sign: str
    outer: int
    first: int
    article: int | None = None
    closed: bool = False


@dataclass
class Block:
    """A block's text. linked: its linked characters; vetoes: the innermost elements that may rule it out, or -1; around: whether one does; article: number of its article, or -1."""

    text: str
    linked: int
    heading: bool
    article: int
    vetoes: tuple[int, int] = (-1, -1)
    around: bool = False


#: Elements that end others of their kind without an end tag, up to the nearest of the elements named after them. Fixed values.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "td", "th")),
    "dt": (("dt", "dd"), ("dl", "td", "th")),
    "dd": (("dt", "dd"), ("dl", "td", "th")),
    "td": (("td", "th"), ("table",)),
    "th": (("td", "th"), ("table",)),
    "tr": (("tr",), ("table",)),
}
_LEADING = ("p",), ("table", "td", "th", "button")


class Open:
    """The open elements, with their places by name and by what they make of their content: each step is O(1), however deep.

    Vetoes form two chains: those that hold everywhere, and layout words and headers, which an article inside them ends.
    """

    def __init__(self):
        self.elements: list[tuple[str, str, tuple[int, int]]] = []
        self.names: dict[str, list[int]] = {}
        self.articles: list[int] = []
        self.n_articles = 0
        self.vetoes: list[Veto] = []
        self.inner = (-1, -1)

    def push(self, name: str, kind: str, attributes: str, block: int) -> None:
        self.names.setdefault(name, []).append(len(self.elements))
        self.elements.append((name, kind, self.inner))
        strong, weak = self.inner
        if kind == "article":
            self.articles.append(self.n_articles)
            self.n_articles += 1
            if strong >= 0 and self.vetoes[strong].article is None:
                self.vetoes[strong].article = block
            self.inner = (strong, -1)
        elif kind and not (kind == "header" and self.articles):
            hard = kind in ("none", "around", "form", "others")
            self.vetoes.append(Veto(kind, f"{name} {attributes}", strong if hard else weak, block))
            self.inner = (len(self.vetoes) - 1, weak) if hard else (strong, len(self.vetoes) - 1)

    def last(self, names: tuple[str, ...]) -> int:
        return max((self.names[n][-1] for n in names if self.names.get(n)), default=-1)

    def cut(self, place: int, ended: bool = False) -> None:
        """Ends the element at this place, by its end tag if `ended`, and all inside it. Some elements need no end tag."""
        while len(self.elements) > place:
            name, kind, before = self.elements.pop()
            self.names[name].pop()
            if kind == "article":
                self.articles.pop()
            elif self.inner != before and (name in ENDS or name == "p" or (ended and len(self.elements) == place)):
                self.vetoes[max(set(self.inner) - set(before))].closed = True
            self.inner = before

    def end_implied(self, name: str) -> None:
        for names, bounds in (_LEADING, *([ENDS[name]] if name in ENDS else [])):
            place = self.last(names)
            if place > self.last(bounds):
                self.cut(place)


def _kind(name: str, attributes: str) -> str:
    """What an element makes of its content."""
    named = [v.strip("\"'") for v in _NAMED.findall(attributes)] if attributes and name not in ("html", "body") else []
    if name in NOT_TEXT:
        return "none"
    if name in AROUND:
        return "form" if name in ("form", "fieldset") else "around"
    if any(OTHERS_WORDS.search(v) for v in named):
        return "others"
    if name in ("article", "main"):
        return "article"
    if any(AROUND_WORDS.search(v) for v in named):
        return "layout"
    return "header" if name == "header" else ""


def blocks(page: str) -> tuple[list[Block], list[Veto]]:
    """The page's blocks in order, and the vetoes that they name."""
    out: list[Block] = []
    opened = Open()
    parts: list[str] = []
    state = {"linked": 0, "a": 0, "closed": False, "heading": False}

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append(Block(text, state["linked"], state["heading"], opened.articles[-1] if opened.articles else -1, opened.inner))
        parts.clear()
        state["linked"] = 0

    def say(text: str) -> None:
        if text:
            parts.append(text)
            if state["a"]:
                state["linked"] += len(" ".join(text.split()))

    at, n = 0, len(page)
    while at < n:
        tag = _TAG.search(page, at)
        say(page[at : tag.start() if tag else n])
        if tag is None:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name in RAW and not tag[1]:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if name == "a":
            state["a"] = 0 if tag[1] else int(bool(_HREF.search(_QUOTED.sub('""', tag[3]))))
            following = _ANCHOR.search(page, at) if state["a"] else None
            state["closed"] = following is not None and bool(following[1])
        if name == "br":
            parts.append(" ")
        if name not in INLINE:
            flush()
            if not state["closed"]:  # a link that is never closed ends with its block
                state["a"] = 0
            state["heading"] = not tag[1] and bool(re.fullmatch("h[1-6]", name))
        if name in VOID:
            continue
        if tag[1]:
            place = opened.last((name,))
            if place >= 0 and (name not in INLINE or place == len(opened.elements) - 1):
                opened.cut(place, ended=True)
        elif name not in INLINE or tag[3]:
            if name not in INLINE:
                opened.end_implied(name)
            kind = _kind(name, tag[3])
            if kind or name not in INLINE:
                opened.push(name, kind, tag[3], len(out))
    flush()
    return out, opened.vetoes


#: The order in which vetoes give way where they hold all running text.
_WEAKEST = ("layout", "header", "form", "around", "others")


def rule_out(found: list[Block], vetoes: list[Veto], counts: list[tuple[int, int]]) -> None:
    """Sets `around` of the blocks, by the vetoes that are no wrappers of the page's text."""
    n = len(found)

    def apply(ends: list[int]) -> None:
        limits: list[int] = []  # the block from which on neither a veto nor one around it holds
        for v, end in zip(vetoes, ends, strict=True):
            limits.append(max(end, limits[v.outer] if v.outer >= 0 else 0))
        for i, b in enumerate(found):
            b.around = any(k >= 0 and i < limits[k] for k in b.vetoes)

    apply([n * (v.kind == "none" and v.closed) for v in vetoes])
    hidden = [b.around for b in found]
    ends = [n] * len(vetoes)
    apply(ends)
    good = [i for i, label in enumerate(first_pass(found, counts, ruled=False)) if label == "good" and not hidden[i]]
    if not good:
        return
    mass = [0] * len(vetoes)
    for i in good:
        for k in {*found[i].vetoes} - {-1}:
            mass[k] += len(found[i].text)
    for k in reversed(range(len(vetoes))):
        outer = vetoes[k].outer
        if outer >= 0:
            mass[outer] += mass[k]
            vetoes[outer].article = min((x for x in (vetoes[k].article, vetoes[outer].article) if x is not None), default=None)
    total = sum(len(found[i].text) for i in good)
    for k, v in enumerate(vetoes):
        if not v.closed and v.kind != "others":
            running = bisect_left(good, v.first)
            ends[k] = min(v.article if v.article is not None else n, good[running] if running < len(good) else n)
        elif v.kind == "form" and (2 * mass[k] >= total or (v.article is not None and mass[k])):
            ends[k] = 0
    apply(ends)
    order = sorted((k for k, v in enumerate(vetoes) if mass[k] and v.kind in _WEAKEST), key=lambda k: (_WEAKEST.index(vetoes[k].kind), -mass[k]))
    for k in order:
        if any(not found[i].around for i in good) or any(b.article >= 0 and not b.around for b in found):
            break
        for j, v in enumerate(vetoes):
            if v.sign == vetoes[k].sign:
                ends[j] = 0
        apply(ends)


def counted(found: list[Block]) -> list[tuple[int, int]]:
    """Words and stop words of each block."""
    words = (_WORD.findall(b.text.lower()) for b in found)
    return [(len(own), sum(w in STOP_WORDS for w in own)) for own in words]


def first_pass(found: list[Block], counts: list[tuple[int, int]] | None = None, ruled: bool = True) -> list[str]:
    """Of each block good, bad, short (ambiguous) or, if ruled, veto (bad by what it stands in).

    Long blocks with few links and many stop words are good. Outside articles linked blocks and long ones
    without stop words are bad; inside they're ambiguous like short ones, as all that isn't ruled out is the
    article's text. Where a page's text has hardly any stop words of ours (another language), length and links decide alone.
    """
    counts = counts or counted(found)
    free = [c for b, c in zip(found, counts, strict=True) if not b.around]
    if not (ruled or any(n for n, _ in free)):
        free = counts
    foreign = sum(known for _, known in free) < FOREIGN * sum(n for n, _ in free)
    out = []
    for b, (n_words, n_known) in zip(found, counts, strict=True):
        size, density = len(b.text), n_known / max(1, n_words)
        if ruled and b.around:
            out.append("veto")
        elif b.linked > MOST_LINKED * size:
            out.append("short" if b.article >= 0 else "bad")
        elif size < SHORT:
            out.append("short" if b.article >= 0 or not b.linked else "bad")
        elif density >= STOP_LOW or foreign:
            out.append("good" if size >= LONG else "short")
        else:
            out.append("short" if b.article >= 0 or size < LONG else "bad")
    return out


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Whether each block stays: ambiguous ones inherit from the nearest decided blocks of their region.

    An article is a region whose ends are good neighbours and whose vetoed blocks stand beside its text. Outside,
    vetoed blocks are bad neighbours and the page's ends are none: equal sides (or the only one) decide, else the
    nearer one, a tie is bad. Headings follow what comes after them. Where an article has a good block, nothing outside articles stays.
    """
    n = len(found)
    inside = any(label == "good" and b.article >= 0 for b, label in zip(found, labels, strict=True))
    region = [b.article >= 0 for b in found]
    near: list[list[tuple[str, int]]] = [[("", n)] * n, [("", n)] * n]
    for side, order in ((0, range(n)), (1, reversed(range(n)))):
        seen = {True: ("good", -1), False: ("", -1)}
        for step, i in enumerate(order):
            label, place = seen[region[i]]
            near[side][i] = (label, step - place)
            if labels[i] in ("good", "bad") or labels[i] == "veto" and not region[i]:
                seen[region[i]] = ("good" if labels[i] == "good" else "bad", step)
    kept = []
    for i, label in enumerate(labels):
        if label == "short":
            (before, far_before), (after, far_after) = near[0][i], near[1][i]
            if found[i].heading and after:
                label = after
            elif not before or not after or before == after:
                label = before or after
            else:
                label = before if far_before < far_after else after if far_after < far_before else "bad"
        kept.append(label == "good" and (region[i] or not inside))
    return kept


def main_text(page: str | None) -> str:
    found, vetoes = blocks(page or "")
    counts = counted(found)
    rule_out(found, vetoes, counts)
    kept = second_pass(found, first_pass(found, counts))
    return "\n\n".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def extract_text(pages: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """(ids, text) of each page, from its whole html; no shuffle."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in common.slices(batch.column(len(id_cols))):
                own = batch.slice(a, b - a)
                text = pa.array([main_text(x.as_py()) for x in own.column(len(id_cols))], pa.string())
                yield pa.RecordBatch.from_arrays([*own.columns[: len(id_cols)], text], [*id_cols, "text"])

    kinds = dict(pages.dtypes)
    return pages.select(*id_cols, common.text_of(html_col).alias("html")).mapInArrow(extract, ", ".join(f"{c} {kinds[c]}" for c in id_cols) + ", text string")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(common.documents(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
