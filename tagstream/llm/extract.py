"""Main text of HTML pages by text-to-tag ratio.

The standard library's streaming parser gives events; block tags cut the page
into lines, each with its text, its tags and the element it stands in.  A line's
ratio is its text outside links divided by its tags (1 at least); lines of menus,
page headers, footers, sidebars, notices, adverts, forms and reader comments have
ratio 0.  The ratios are smoothed with a Gaussian over neighbouring lines, and the
lines at or above a threshold (``SPREAD`` standard deviations, but no more than half
the mean of the lines that have text) form clusters, which select the content:

- ``main``, or else the ``article`` elements, with a line in a cluster, whole.  An
  article that a word of its class calls a teaser, or most of whose text is links, is
  left out beside one of twice its weight;
- if clusters outside all of these hold over ``OUTWEIGH`` times their text, or if there
  are none, the smallest element that holds the clusters, without lines of links at its
  ends; of the page as a whole, the lines from the first to the last of a cluster, the
  headings before them and the sentences next to them.

Boilerplate is told by tag, role or hidden state, or by class and id.  A class or the
id counts only if all its words are layout words and one of them names boilerplate, so
``related-posts`` does and ``related-work`` does not.  Words that name content as well
(``_EITHER``, and every word where it is an id inside an article) need a second sign: most
of the block's text is links or its lines are short; for discussions, a form or an
author, avatar or reply mark in it.

In a line, white space (that of Unicode) becomes one space, ends are trimmed, and
character references are decoded; lines are joined by an empty line.  ``br`` is
white space.

Defined results: null, empty and text-free pages give the empty string; a page
where nothing passes the threshold gives its largest marked element, or else its line of
highest ratio.  Broken markup is read as far as the parser reads it, in linear time
however deep it is; a tag that the page's end cuts off is left out.  Repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .frames import append_columns

SIGMA = 1.0
RADIUS = 2
SPREAD = 0.5
OUTWEIGH = 2.0
SENTENCE = 8  # words of a line that goes on with the text of a page without blocks
OUTPUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

_KERNEL = [math.exp(-((k / SIGMA) ** 2) / 2) for k in range(-RADIUS, RADIUS + 1)]
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_MATH = frozenset("math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mspace mpadded mphantom menclose semantics annotation".split())
_INLINE |= _MATH
_DROPPED = frozenset("script style noscript template iframe object svg canvas select button textarea nav footer aside form head title dialog menu audio video option datalist fieldset annotation-xml annotation".split())
_HOLDERS = frozenset("html body div section main article center table tbody tr td".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_SAME = {k: frozenset(v.split()) for k, v in _SAME.items()}
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id that name boilerplate.
_NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promos banner cookie cookies consent gdpr notice notices alert alerts popup modal newsletter subscribe signup login"
    " comment comments disqus sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar share sharing paywall skip hidden".split()
)
#: Words that name sections of articles as well.
_TALK = frozenset("reply replies discussion discussions respond response responses".split())
_EITHER = _TALK | frozenset("advertisements aside form notification notifications overlay promotion promotions recommended recommendations related search social subscription".split())
_PAGE = frozenset("header heading top".split())  # boilerplate outside articles only
#: Words that say how a block is laid out, not what it is about.
_LAYOUT = frozenset(
    "and area article articles bar block body bottom box btn button buttons card cards column container content desktop fixed floating global group holder icon icons inner item items js large left link links list main"
    " mobile outer page pages panel placeholder post posts primary right rail row secondary section site slot small sticky story stories the thread top unit us view wrap wrapper zone".split()
)
_TEASERS = frozenset("teaser teasers card cards promo promos related recommended preview summary excerpt".split())
_TALKERS = frozenset("comment comments reply replies author avatar commenter username".split())
_CONTENT = frozenset("article content main post entry story".split())
_OPENS = re.compile(r"<[a-zA-Z/!?]")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def words_of(value: str) -> list[list[str]]:
    """The words of each of a class attribute's names, in lower case, numbers left out."""
    return [[w.lower() for w in _WORD.findall(name) if not w.isdigit()] for name in value.split()]


def names(parts: list[list[str]], vocabulary: frozenset[str]) -> bool:
    """Whether a name holds a word of the vocabulary and else only words of layout or boilerplate."""
    return any(any(w in vocabulary for w in p) and all(w in vocabulary or w in _LAYOUT or w in _NAMED or w in _EITHER or w in _PAGE for w in p) for p in parts)


class Element:
    """What is kept of an element that is open or may be chosen: tag, number, parent, first and last line, whether dropped, kind of doubt."""

    __slots__ = ("tag", "number", "first", "last", "dropped", "region", "doubt", "talkers", "teaser", "inline")

    def __init__(self, tag: str, number: int, first: int, dropped: bool, region: bool) -> None:
        self.tag, self.number, self.first, self.last = tag, number, first, first
        self.dropped, self.region, self.doubt, self.talkers, self.teaser = dropped, region, "", False, False
        self.inline: dict[str, list[int]] = {}  # depths of the open inline elements right inside a block


class Lines(HTMLParser):
    """Parser events gathered into lines: [text, characters outside links, tags, number of the element, dropped, heading]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.root = Element("", 0, 0, False, False)
        self.stack: list[Element] = [self.root]
        self.blocks: list[Element] = [self.root]
        self.parents = [0]
        self.elements: list[Element] = [self.root]  # blocks by number
        self.doubtful: list[Element] = []
        self.open: dict[str, int] = {}
        self.links = 0
        self.pieces: list[str] = []
        self.plain = self.tags = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    def cut(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                block = self.blocks[-1]
                self.lines.append([text, self.plain, self.tags, block.number, block.dropped, block.tag in _HEADINGS])
            self.pieces = []
        self.plain = self.tags = 0

    def judged(self, e: Element, attrs: list[tuple[str, str | None]]) -> bool:
        """Whether an element is boilerplate for certain; notes on it what speaks for it less than that."""
        tag, inside = e.tag, e.region
        if tag in _DROPPED:
            return True
        sure = tag == "header" and not inside
        if tag in ("article", "main"):
            e.region = True
        if not attrs or tag in ("html", "body"):
            return sure
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true" and tag not in _MATH):
                return True
            if not value:
                continue
            if name == "role":
                if value.lower() in _ROLES:
                    return True
                e.region |= value.lower() in ("main", "article")
            elif name == "itemprop":
                e.region |= value == "articleBody"
            elif name == "style":
                if "display:none" in value.replace(" ", "").lower():
                    return True
            elif name in ("class", "id"):
                parts = words_of(value)
                if any(w in _TALKERS for p in parts for w in p):
                    for block in reversed(self.blocks):
                        if block.talkers:
                            break
                        block.talkers = True
                if tag in ("article", "main"):
                    e.teaser |= any(w in _TEASERS for p in parts for w in p)
                    sure |= names(parts, frozenset(("comment", "comments")))
                elif tag in _HEADINGS or tag in _INLINE and name == "id":
                    continue
                elif name == "class" or not inside:
                    sure |= names(parts, _NAMED) or (not inside and names(parts, _PAGE))
                    if names(parts, _EITHER):
                        e.doubt = "talk" if names(parts, _TALK) else "block"
                elif names(parts, frozenset(("comment", "comments", "disqus"))):
                    sure = True
                elif names(parts, _NAMED | _EITHER):
                    e.doubt = "talk" if names(parts, _TALK) else "block"
                if any(p and p[0] in _CONTENT and all(w in _CONTENT or w in _LAYOUT for w in p) for p in parts):
                    e.region = True
        return sure

    def close(self) -> None:
        super().close()
        self.cut()
        self.pop_to(1)
        self.root.last = len(self.lines)

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            e = self.stack.pop()
            e.last = len(self.lines)
            self.open[e.tag] -= 1
            if e.tag == "a":
                self.links -= 1
            if e is self.blocks[-1]:
                self.blocks.pop()
            else:
                self.blocks[-1].inline[e.tag].pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.pieces.append(" ")
            self.tags += 1
            return
        inline = tag in _INLINE
        if not inline:
            self.cut()
            closes = self.blocks[-1].tag == "p" if tag in _CLOSES_P else self.blocks[-1].tag in _SAME.get(tag, ())
            if closes:
                self.pop_block()
        self.tags += 1
        if tag in _VOID:
            return
        above = self.stack[-1]
        e = Element(tag, self.blocks[-1].number, len(self.lines), above.dropped, above.region)
        if not above.dropped:
            e.dropped = self.judged(e, attrs)
            if e.doubt and not e.dropped:
                self.doubtful.append(e)
        elif attrs and self.doubtful:
            self.judged(e, attrs)
        if inline:
            self.blocks[-1].inline.setdefault(tag, []).append(len(self.stack))
        else:
            e.number = len(self.elements)
            self.parents.append(self.blocks[-1].number)
            self.elements.append(e)
            self.blocks.append(e)
        if tag == "form":
            for block in reversed(self.blocks):
                if block.talkers:
                    break
                block.talkers = True
        self.stack.append(e)
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag == "a":
            self.links += 1

    def pop_block(self) -> None:
        """Close the innermost block and what is open in it."""
        block = self.blocks[-1]
        depth = len(self.stack) - 1
        while self.stack[depth] is not block:
            depth -= 1
        self.pop_to(depth)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in _INLINE:
            depths = self.blocks[-1].inline.get(tag)
            if depths:  # a stray inline end does not close blocks
                self.pop_to(depths[-1])
            return
        self.cut()
        if self.open.get(tag):
            while self.blocks[-1].tag != tag:
                self.pop_block()
            self.pop_block()

    def handle_data(self, data: str) -> None:
        if self.stack[-1].dropped and (self.stack[-1].tag in ("script", "style") or not self.blocks[-1].dropped):
            return  # no text, or a hidden part of a line
        self.pieces.append(data)
        if not self.links:
            self.plain += len(data)


def smoothed(values: list[float]) -> list[float]:
    """Gaussian smoothing; at the ends the kernel is renormalised."""
    n, out = len(values), []
    for i in range(n):
        a, b = max(0, i - RADIUS), min(n, i + RADIUS + 1)
        k = _KERNEL[a - i + RADIUS : b - i + RADIUS]
        out.append(sum(x * y for x, y in zip(k, values[a:b])) / sum(k))
    return out


def running(values: list[float]) -> list[float]:
    out = [0]
    for v in values:
        out.append(out[-1] + v)
    return out


def linked(e: Element, chars: list[float], plain: list[float]) -> float:
    """The share of an element's text that stands in links."""
    return 1 - min(1.0, (plain[e.last] - plain[e.first]) / max(1, chars[e.last] - chars[e.first]))


def settle(page: Lines, chars: list[float], plain: list[float]) -> None:
    """Drop the doubtful blocks that a second sign speaks against."""
    done = 0
    for e in page.doubtful:
        n = e.last - e.first
        short = chars[e.last] - chars[e.first] < 40 * n
        talk = e.doubt == "talk" and e.talkers
        if e.last > done and n and (talk or linked(e, chars, plain) > 0.3 or (short and e.doubt == "block")):
            for line in page.lines[e.first : e.last]:
                line[4] = True
            done = e.last


def outermost(elements: list[Element], tags: tuple[str, ...]) -> list[Element]:
    out: list[Element] = []
    for e in elements:
        if e.tag in tags and not e.dropped and (not out or e.first >= out[-1].last) and e.last > e.first:
            out.append(e)
    return out


def container(page: Lines, weight: list[float], ahead: list[float]) -> Element:
    """The smallest element that holds (almost) all the weight, and the headings before it."""
    children: dict[int, list[Element]] = {}
    for e in page.elements[1:]:
        children.setdefault(page.parents[e.number], []).append(e)
    at = page.root
    while True:
        total = weight[at.last] - weight[at.first]
        for e in children.get(at.number, ()):
            if e.tag in _HOLDERS and e.last - e.first > 1 and weight[e.last] - weight[e.first] >= 0.95 * total and ahead[e.first] == ahead[at.first]:
                at = e
                break
        else:
            return at


def finished(html: str) -> str:
    """A page without the tag that its end cuts off, and without all but a few comments that nothing ends: the parser looks for their ends again and again."""
    last = html.rfind(">") + 1
    if m := _OPENS.search(html, last):
        html = html[: m.start()]
    closed = html.rfind("-->") + 1
    if html.count("<!--", closed) > 16:
        html = html[:closed] + html[closed:].replace("<!--", "")
    return html


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(finished(html))
    page.close()
    lines = page.lines
    chars, plain = running([len(line[0]) for line in lines]), running([min(line[1], len(line[0])) for line in lines])
    settle(page, chars, plain)
    ratios = [0.0 if dropped else outside / max(1, tags) for _, outside, tags, _, dropped, _ in lines]
    live = [r for r in ratios if r > 0]
    if not live:
        return ""
    smooth = smoothed(ratios)
    mean = sum(smooth) / len(smooth)
    spread = math.sqrt(sum((s - mean) ** 2 for s in smooth) / len(smooth))
    threshold = min(SPREAD * spread, sum(live) / len(live) / 2)
    picked = [s >= threshold and r > 0 for s, r in zip(smooth, ratios)]
    weight = running([len(line[0]) if take else 0 for line, take in zip(lines, picked)])
    shown = running([0 if line[4] else len(line[0]) for line in lines])
    of = lambda e, sums: sums[e.last] - sums[e.first]
    mains, articles, marked = (outermost(page.elements, tags) for tags in (("main",), ("article",), ("main", "article")))
    for sums in (weight, shown):
        best = max((of(e, sums) for e in marked), default=0)
        regions = [e for e in mains if of(e, sums) * OUTWEIGH >= best > 0] or [e for e in articles if of(e, sums) > 0 and (2 * of(e, sums) >= best or not (e.teaser or linked(e, chars, plain) > 0.5))]
        if regions:
            break
    outside = weight[-1] - sum(of(e, weight) for e in marked)
    if regions and outside <= OUTWEIGH * sum(of(e, shown) for e in regions):
        return "\n\n".join(line[0] for e in regions for line in lines[e.first : e.last] if not line[4])
    for e in marked:  # these are none of it
        for i in range(e.first, e.last):
            lines[i][4], picked[i] = True, False
    if not any(picked):
        return lines[max(range(len(lines)), key=lambda i: (ratios[i], -i))][0]
    weight = running([len(line[0]) if take else 0 for line, take in zip(lines, picked)])
    e = container(page, weight, running([1 if line[5] and not line[4] else 0 for line in lines]))
    inside = [i for i in range(e.first, e.last) if not lines[i][4]]
    first, last = (next(k for k in order if picked[inside[k]]) for order in (range(len(inside)), range(len(inside) - 1, -1, -1)))
    own = e.tag not in ("", "html", "body")  # a block of its own loses only lines of links at its ends
    text = lambda k: ratios[inside[k]] > 0 and (own or len(lines[inside[k]][0].split()) >= SENTENCE)
    while last + 1 < len(inside) and text(last + 1):
        last += 1
    while first and (lines[inside[first - 1]][5] or text(first - 1)):
        first -= 1
    return "\n\n".join(lines[i][0] for i in inside[first : last + 1])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` (main text) and ``n_chars`` (its code points)."""

    def make():
        def kernel(html: pa.Array) -> list[pa.Array]:
            texts = [main_text(h.as_py()) for h in html]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return kernel

    return append_columns(pages, [html_col], OUTPUT, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
