"""Main text of web pages by two passes of block rules.

The page is cut into blocks at block-level tags. The first pass looks at each block alone. Regions that are no article
text by their element (navigation, page headers and footers, sidebars, forms) or role go, as does all outside of an
``article`` or ``main`` where a page has one. Of what is left, blocks of mostly linked characters are boilerplate, but
in an article only long ones that are no heading; long blocks are text if they are dense in stop words, or, in a script
that does not part words, if they are sentences; long blocks without either are boilerplate outside of an article,
where a dense block tells that the lists of stop words know the page's language; short ones, code, and all others stay
open.

The second pass gives each open block the label of its nearest decided neighbours: of both if they agree, else of the
nearer one. At the same distance the one before counts, in an article the text; the ends of an article count as text.
With none decided an open block is text. Blocks that a region or name has decided say nothing about their neighbours.

Class and id names are evidence beside that. A name made of nothing but words for parts without article text
("comments", "ad-box", "site-footer") makes a block boilerplate. A name that has other words too ("related-work",
"legal-history") only asks for more: outside of an article such a block must be dense text, inside it is judged like any
other. Where a page without an article has no other text, names of layout ("sidebar") say nothing, nor do forms that
hold all dense text of a page or article.

Reading a page takes time in proportion to its length, whatever its markup: stray and unclosed tags are looked up by
name and never searched for.

Defined cases: null and empty pages give an empty text; unclosed, stray and truncated markup is read as far as it
goes: what has no end tag ends where its parent does, a hidden element (a button) also where the next block begins, and
only scripts, styles and others of raw text reach to the page's end; an attribute's value is never read as a name;
repeated rows stay; further columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import read

#: Elements whose content is never shown as text.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video head select textarea button datalist map title".split())
#: Those whose content is no markup.
RAW = frozenset("script style textarea title iframe".split())
#: Headings.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 caption legend summary".split())
#: Regions that hold no article text.
OUTSIDE = frozenset("nav footer aside form menu dialog".split())
#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new one of the same kind (or a block, for p) closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class and id names for layout without article text, and for what is shown beside an article.
LAYOUT = frozenset("nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar header masthead banner footer sidebar aside widgets rail modal overlay paywall".split())
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot sponsor sponsored promo promotion promoted widget "
    "cookie cookies consent gdpr notice notices alert popup newsletter subscribe subscription signup login "
    "comment comments commentlist respond disqus replies reply share sharing social related recommended recommendations "
    "pagination pager copyright legal disclaimer tags toc skip".split()
)
#: Words of names that say nothing, and those with which "header" is an article's own.
NEUTRAL = frozenset(
    "area bar block body bottom box btn button card col column container content cta form global group holder inner item items layer left line link links list main message mobile "
    "module outer page panel part policy post posts primary reader right row secondary section site slot sticky tab text thread title top unit user users view wrap wrapper".split()
)
OWN = frozenset("post entry article story content main page".split())
#: Words that also mark an article element as no article text.
ASIDES = frozenset("comment comments reply replies respond related recommended teaser promo promoted sponsored ad advert".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that it for on with as was be by are this at from or an not have has but which you they his her she he we "
    "der die das und in zu den von ist mit sich des auf für nicht ein eine dem es an als auch er so dass werden aus bei nach "
    "le la les de des et un une du en que est pour qui dans sur par plus au avec ne se pas il elle ce son ou "
    "el los las y del se por con no una su para es al lo como más pero sus este ha si porque cuando".split()
)

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(?:.*?\]\]>|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?>\"[^\"]*+\"|'[^']*+')|[^>])*+)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>\"']+)))?")
UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
HEAD_END = re.compile(r"</head\s*>|<body\b", re.I)
COPYRIGHT = re.compile(r"©|^\W*copyright\b", re.I)
WORD = re.compile(r"[^\W\d_]+")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Scripts that do not part words: Thai to Khmer, kana, CJK.
UNPARTED = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]")
#: Letters of the scripts that the stop words are written in.
LISTED = re.compile(r"[A-Za-zÀ-ɏ]")
SENTENCE = re.compile(r"[.!?…。！？؟।][\"'”’»)\]]*$")

#: What names say: nothing, that a block must be dense text, that it is layout, or that it stands beside the article.
PLAIN, DOUBTED, LAID_OUT, APART = range(4)


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    inside: bool  # within article or main
    outside: bool  # within an element or role without article text
    form: bool  # within a form
    heading: bool
    name: int  # the most that names around it say
    code: bool  # within pre


@dataclass(frozen=True)
class Rules:
    """Thresholds of the first pass: characters, shares of stop words and of linked characters, words of a sentence."""

    long: int = 80
    stops: float = 0.15
    stops_low: float = 0.05
    links: float = 0.5
    sentence: int = 8


def _said(value: str, tag: str, in_article: bool) -> int:
    """What the names of a class or id attribute say about an element."""
    most = PLAIN
    for name in value.split():
        words = {w.lower() for w in NAME_WORD.findall(name)}
        if not words or name.lower().startswith(("has-", "with-", "no-", "is-", "has_", "no_")):
            continue
        if tag == "article":
            most = APART if words & ASIDES else most
            continue
        if "header" in words and (in_article or words & OWN):
            words.discard("header")
        found = words & (LAYOUT | BESIDE)
        if found:
            rest = words - found - NEUTRAL
            most = max(most, DOUBTED if any(len(w) > 1 for w in rest) else APART if found & BESIDE else LAID_OUT)
    return most


def _marks(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, int]:
    """Whether an element is hidden, whether it opens a region without article text, and what its names say."""
    outside, name = tag in OUTSIDE or (tag == "header" and not in_article), PLAIN
    if attributes and tag not in ("html", "body", "main"):
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), next((v for v in values if v), "")
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                return True, False, PLAIN
            if key == "style" and UNSHOWN.search(value.lower()):
                return True, False, PLAIN
            if key in ("class", "id"):
                name = max(name, _said(value, tag, in_article))
            elif key == "role":
                outside = outside or value.lower() in ROLES
    return False, outside, name


class _Stack:
    """Open elements, by place and by name, with counts of what they say; every step takes constant time."""

    def __init__(self) -> None:
        self.open: list[list] = []  # [tag or None once it has ended, marks], marks are keys of ``count``
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of block elements
        self.count = {"link": 0, "article": 0, "code": 0, "hidden": 0, "heading": 0, "outside": 0, "form": 0, DOUBTED: 0, LAID_OUT: 0, APART: 0}
        self.ends = True  # whether the last hidden element has an end tag
        self.void = 0  # forms and layout names of elements before this place say nothing

    def push(self, tag: str, marks: tuple) -> None:
        for m in marks:
            self.count[m] += 1
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append([tag, marks])

    def top(self) -> str | None:
        return self.open[-1][0] if self.open else None

    def pop(self) -> None:
        tag, marks = self.open.pop()
        at = len(self.open)
        if tag is None:
            return
        self.places[tag].pop()
        if tag in BLOCKS:
            self.blocks.pop()
        self._uncount(marks, at)
        self.void = min(self.void, at)

    def _uncount(self, marks: tuple, at: int) -> None:
        for m in marks:
            if not (m in ("form", LAID_OUT) and at < self.void):
                self.count[m] -= 1

    def end(self, tag: str) -> None:
        """An end tag: closes what stands above, but an inline element only ends and leaves the blocks above it open."""
        places = self.places.get(tag)
        if not places:
            return
        at = places[-1]
        if tag not in BLOCKS and self.blocks and self.blocks[-1] > at:
            self._uncount(self.open[at][1], at)
            self.open[at] = [None, ()]
            places.pop()
            return
        while len(self.open) > at:
            self.pop()

    def article(self) -> None:
        """An article begins: forms and layout around the whole of it say nothing about it."""
        if not self.count["article"] and not self.count["outside"]:
            self.count["form"] = self.count[LAID_OUT] = 0
            self.void = len(self.open)


def blocks(page: str) -> list[Block]:
    """The blocks of a page with text, in page order."""
    out: list[Block] = []
    parts: list[str] = []
    stack = _Stack()
    count = stack.count
    linked, headless, closed = 0, False, {}

    def end() -> None:
        nonlocal linked
        if not parts:
            return
        text = " ".join("".join(parts).split())
        if text:
            name = next((n for n in (APART, LAID_OUT, DOUBTED) if count[n] > 0), PLAIN)
            out.append(Block(text, linked, count["article"] > 0, count["outside"] > 0, count["form"] > 0, count["heading"] > 0, name, count["code"] > 0))
        parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not count["hidden"] > 0:
            text = html.unescape(text)
            parts.append(text)
            if count["link"] > 0:
                linked += len(text.strip())

    at = 0
    while at < len(page):
        found = TOKEN.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        closing, tag, attributes = found[1], (found[2] or "").lower(), found[3] or ""
        if not tag:
            continue
        if closing:
            if tag in BLOCKS:
                end()
            stack.end(tag)
            continue
        single = attributes.rstrip().endswith("/")
        if tag == "head":
            close = None if headless else HEAD_END.search(page, at)
            headless = close is None
            if close:
                at = close.start() if close[0][1] != "/" else close.end()
            continue
        if tag in RAW:
            at = at if single and tag == "iframe" else _after_raw(page, at, tag)
            continue
        hidden, outside, name = _marks(tag, attributes, count["article"] > 0)
        if tag in BLOCKS:
            end()
            if stack.top() in HIDDEN and not stack.ends:
                stack.pop()
            if stack.top() in CLOSES.get(tag, ()) or stack.top() == "p":
                stack.pop()
        elif tag == "br":
            parts.append(" ")
        if tag in VOID or single:
            continue
        marks = []
        if hidden or tag in HIDDEN:
            marks.append("hidden")
        if tag in HEADINGS:
            marks.append("heading")
        if tag in ("article", "main") and name == PLAIN and not count["hidden"] > 0:
            stack.article()
            marks.append("article")
        if tag == "a":
            marks.append("link")
        if tag == "pre":
            marks.append("code")
        if outside:
            marks.append("form" if tag == "form" else "outside")
        if name != PLAIN:
            marks.append(name)
        stack.push(tag, tuple(marks))
        if tag in HIDDEN:
            if tag not in closed:
                closed[tag] = _closed(page, at, tag)
            stack.ends = at in closed[tag]
    end()
    return out


def _after_raw(page: str, at: int, tag: str) -> int:
    """The place after the end tag of an element of raw text, or the page's end."""
    found = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
    return found.end() if found else len(page)


def _closed(page: str, at: int, tag: str) -> set[int]:
    """The places from ``at`` on after those start tags of an element that have an end tag."""
    begun, out = [at], set()
    for found in re.compile(rf"<(/?){re.escape(tag)}\b[^>]*>", re.I).finditer(page, at):
        if not found[1]:
            begun.append(found.end())
        elif begun:
            out.add(begun.pop())
    return out


def dense(b: Block, rules: Rules) -> bool | None:
    """Whether the words of a block are those of running text; None if they tell too little."""
    if UNPARTED.search(b.text) and 2 * len(UNPARTED.findall(b.text)) > sum(map(len, WORD.findall(b.text))):
        sentences = 4 * len(b.text) >= rules.long and bool(SENTENCE.search(b.text))
        return True if len(b.text) >= rules.long or sentences else None
    if len(b.text) < rules.long or b.code:
        return None
    words = WORD.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= rules.stops:
        return True
    if len(words) >= rules.sentence and SENTENCE.search(b.text):
        return None  # a sentence, maybe of a language without a list here
    if stops >= rules.stops_low or 2 * len(LISTED.findall(b.text)) < sum(map(len, words)):
        return None
    return False


def first_pass(found: list[Block], rules: Rules = Rules()) -> list[tuple[bool | None, str]]:
    """(label, by what) for each block: True for text, False for boilerplate, None if it is open."""
    inside = any(b.inside and not b.outside and b.name < LAID_OUT for b in found)
    words = [None if b.outside or (inside and not b.inside) else dense(b, rules) for b in found]
    runs = [d and b.name < LAID_OUT for b, d in zip(found, words, strict=True)]
    formless = any(runs) and all(b.form for b, r in zip(found, runs, strict=True) if r)  # then forms say nothing
    away = [b.outside or (b.form and not formless) for b in found]
    within = any(b.inside and not a and b.name < LAID_OUT for b, a in zip(found, away, strict=True))
    if inside and not within:  # all that the article holds is in forms
        words = [None if b.outside else dense(b, rules) for b in found]
    away = [a or (within and not b.inside) for b, a in zip(found, away, strict=True)]
    known = any(d for d, a in zip(words, away, strict=True) if not a)
    other = within or any(d and b.name < LAID_OUT for b, d, a in zip(found, words, away, strict=True) if not a)
    out: list[tuple[bool | None, str]] = []
    for b, running, gone in zip(found, words, away, strict=True):
        if gone:
            out.append((False, "region"))
        elif b.name == APART or (b.name == LAID_OUT and other):
            out.append((False, "name"))
        elif b.linked > rules.links * len(b.text) and not (within and (b.heading or len(b.text) < rules.long)):
            out.append((False, "links"))
        elif running:
            out.append((True, "density"))
        elif within:
            out.append((None, "open"))
        elif b.name == DOUBTED:
            out.append((False, "name"))
        elif COPYRIGHT.search(b.text) and len(b.text) < rules.long:
            out.append((False, "copyright"))
        elif running is False and known:
            out.append((False, "density"))
        else:
            out.append((None, "open"))
    return out


def judged(found: list[Block], rules: Rules = Rules()) -> list[tuple[bool, str]]:
    """(text or not, by what) for each block after both passes; "neighbours" for those that inherit their label."""
    first = first_pass(found, rules)
    within = [i for i, b in enumerate(found) if b.inside]
    decided: list[bool | None] = [None if why in ("region", "name") else label for label, why in first]
    if within:  # the article's ends are text
        inner = _inherit([True, *(decided[i] for i in within), True], True)[1:-1]
        got = dict(zip(within, inner, strict=True))
    else:
        got = dict(enumerate(_inherit(decided)))
    return [(bool(got.get(i)), "neighbours") if label is None else (label, why) for i, (label, why) in enumerate(first)]


def _inherit(first: list[bool | None], tie: bool | None = None) -> list[bool]:
    """The second pass: open labels from the nearest decided neighbours; with none at all, text.

    Where two of the same distance differ, ``tie`` counts, or that of the one before if it is None.
    """
    before: list[tuple[int, bool] | None] = []
    last = None
    for i, x in enumerate(first):
        last = (i, x) if x is not None else last
        before.append(last)
    out: list[bool] = []
    last = None
    for i in range(len(first) - 1, -1, -1):
        last = (i, first[i]) if first[i] is not None else last
        a, b = before[i], last
        if a is None or b is None:
            near = a or b
            out.append(near[1] if near else True)
        elif i - a[0] == b[0] - i and a[1] != b[1]:
            out.append(a[1] if tie is None else tie)
        else:
            out.append(a[1] if i - a[0] <= b[0] - i else b[1])
    return out[::-1]


def extract(page: str | None, rules: Rules = Rules()) -> str:
    """The main text: its blocks, joined by line feeds."""
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, (keep, _) in zip(found, judged(found, rules), strict=True) if keep)


def with_main_text(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(page_id, url, text) for every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, rules) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the main text of every page."""
    return with_main_text(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
