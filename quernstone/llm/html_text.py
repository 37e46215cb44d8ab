"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import arrow_map, guarded, read_table

# Element names and the words in class, id and role that mark what is not an article.
RAW = {"script", "style", "title", "textarea", "iframe", "noscript", "noembed", "noframes", "xmp"}
SILENT = {"template", "svg", "select", "button", "object", "audio", "video", "canvas", "math"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr link meta base col area embed source track param hr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "main", "body", "div", "blockquote", "aside", "nav", "footer", "header", "form"}
ASIDE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog"}
ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription sidebar menu nav navbar navigation"
    " breadcrumb breadcrumbs footer header masthead comment comments commentlist commentform respond disqus replies related recommended share sharing sharedaddy social teaser teasers widget pagination pager login signin signup search toolbar skip alert complementary contentinfo".split()
)
#: Names that mean an aside only if they stand alone.
ASIDE_NAMES = {"secondary", "tertiary", "colophon"}
#: Words of readers' comments, which may be long and stand in the article.
COMMENT_WORDS = {"comment", "comments", "commentlist", "commentform", "respond", "disqus", "replies"}
#: Words that go with those of an aside and say nothing themselves.
FILLERS = set("area articles bar count feed google icon icons inline media reader readers thread tools user users block box bottom button buttons container content element form group holder inner item items left links list module outer panel posts right row section site slot stories top unit wrap wrapper x y z".split())
MAIN_TAGS = {"article", "main"}
#: Inside the main element these words mean the article's own heading.
OWN_HEADER = {"header", "masthead", "banner"}
#: Classes that say what a layout has or lacks, or a state, not what an element is.
LAYOUT = re.compile(r"\b(?:no|has|with|without)[-_][a-z_-]+|[a-z_-]+[-_](?:open|opened|closed|enabled|disabled|allowed|less|free|layout|image|theme|template)\b[a-z_-]*")
#: An element that only some word of its names marks is none if it has at least so many times the text without links that the rest has; readers' comments may well be longer than what they are about.
HEAVY, HEAVY_COMMENTS = 1, 4
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
#: What follows a tag's name: quotes count only where a value starts; a value that isn't closed ends with the tag.
REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""")
HINT = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?。，…¿¡]")


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    depth: int
    said: str
    hidden: bool = False


@dataclass(slots=True)
class Block:
    element: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    tags: int = 1

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class Reader:
    """Elements in page order, the first being the root, and text blocks; wrongly nested markup is read as browsers do, roughly."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.elements = [Element("", -1, 0, "")]
        self.blocks: list[Block] = []
        self.stack = [0]
        self.places: dict[str, list[int]] = defaultdict(list)  # tag to its places in the stack
        self.scopes = [-1]  # for each place in the stack, that of the innermost scope
        self.fresh, self.links = True, False
        self.missing: set[str] = set()  # end tags that occur no more
        self.pairs: dict[str, dict[int, int]] = {}  # silent tag to the starts of its elements and their ends
        at = 0
        while (found := page.find("<", at)) >= 0:
            self._text(page[at:found])
            at = self._markup(found)
        self._text(page[at:])

    def _text(self, raw: str) -> None:
        if not raw:
            return
        if self.fresh:
            if not raw.strip():
                return
            self.blocks.append(Block(self.stack[-1]))
            self.fresh = False
        decoded = html.unescape(raw)
        self.blocks[-1].parts.append(decoded)
        if self.links:
            self.blocks[-1].linked += len(decoded)

    def _find(self, what: str, at: int, pattern: re.Pattern | None = None) -> re.Match | int | None:
        """Where what occurs from at on, None if no more; it isn't looked for again then."""
        if what in self.missing:
            return None
        found = pattern.search(self.page, at) if pattern else self.page.find(what, at)
        if found is None or found == -1:
            self.missing.add(what)
            return None
        return found

    def _markup(self, at: int) -> int:
        """Reads what starts with < at a place and returns where it ends."""
        page = self.page
        if at > self.last:
            self._text("<")
            return at + 1
        if page.startswith("<!--", at):
            end = self._find("-->", at + 4)
            return len(page) if end is None else end + 3
        if page[at + 1:at + 2] in ("!", "?"):
            return page.find(">", at) + 1
        m = NAME.match(page, at)
        if not m:
            self._text("<")
            return at + 1
        rest = REST.match(page, m.end())
        end = rest.end() if rest else page.find(">", m.end()) + 1
        attributes = page[m.end():end - 1]
        tag = m[2].lower()
        if m[1]:
            self._close(tag)
        elif tag in RAW:
            return self._raw(tag, end)
        elif tag in SILENT:
            return end if attributes.endswith("/") else self._skip(tag, at, end)
        else:
            self._open(tag, attributes)
        return end

    def _raw(self, tag: str, at: int) -> int:
        """Past an element that holds no markup; without an end tag a script or style takes the rest, others are empty."""
        end = self._find(f"</{tag}", at, re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I))
        return end.end() if end else len(self.page) if tag in ("script", "style") else at

    def _skip(self, tag: str, start: int, at: int) -> int:
        """Past an element that shows no text of the article, with what is nested in it; without an end tag of its own it is empty."""
        if tag not in self.pairs:
            self.pairs[tag], opened = {}, []
            for m in re.finditer(rf"<(/?){tag}(?=[\s/>])[^>]*>?", self.page, re.I):
                if not m[1]:
                    opened.append(m.start())
                elif opened:
                    self.pairs[tag][opened.pop()] = m.end()
        return self.pairs[tag].get(start, at)

    def _pop(self, place: int) -> None:
        """Closes everything from a place of the stack on."""
        while len(self.stack) > place:
            self.places[self.elements[self.stack.pop()].tag].pop()
            self.scopes.pop()

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "head":  # shows nothing itself; its end tag may be left out, and its elements are silent or empty
            return
        if tag in INLINE:
            if tag == "a":
                self.links = True
            elif tag == "br":
                self._text(" ")
            if not self.fresh:
                self.blocks[-1].tags += 1
            return
        self.fresh, self.links = True, False
        if self.elements[self.stack[-1]].tag == "p":
            self._pop(len(self.stack) - 1)
        if tag in CLOSES:
            place = max((self.places[t][-1] for t in CLOSES[tag] if self.places[t]), default=-1)
            if place > self.scopes[-1]:
                while (outer := max((self.places[t][-1] for t in CLOSES[tag] if self.places[t] and self.places[t][-1] < place), default=-1)) > self.scopes[-1]:
                    place = outer  # a cell, and the row around it
                self._pop(place)
        said = " ".join(m[1] or m[2] or m[3] or "" for m in HINT.finditer(attributes)).lower() if attributes else ""
        self.elements.append(Element(tag, self.stack[-1], len(self.stack), said, bool(attributes and HIDDEN.search(attributes))))
        self.places[tag].append(len(self.stack))
        self.scopes.append(len(self.stack) if tag in SCOPES else self.scopes[-1])
        self.stack.append(len(self.elements) - 1)

    def _close(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self.links = False
            return
        if tag == "head":
            return
        self.fresh, self.links = True, False
        if self.places[tag]:
            self._pop(self.places[tag][-1])


def _words(said: str) -> set[str]:
    return set(re.split(r"[^a-z]+", LAYOUT.sub("", said))) - {""}


def _wholly(said: str, marks: set[str]) -> bool:
    """Whether some class, id or role consists of marks and fillers, with a mark among them."""
    for name in LAYOUT.sub("", said).split():
        words = {w for w in re.split(r"[^a-z]+", name) if w}
        if words & marks and words <= marks | FILLERS or name in ASIDE_NAMES:
            return True
    return False


@dataclass
class Marks:
    """For each element: whether it is in an aside, and the outermost article or main element it is in, or -1."""

    aside: list[bool]
    main: list[int]


def _unlinked(reader: Reader, gone: list[bool]) -> list[int]:
    """Characters without links of each element with all that it holds, but for elements that are gone."""
    held = [0] * len(reader.elements)
    for b in reader.blocks:
        if not gone[b.element]:
            held[b.element] += max(0, len("".join(b.parts).strip()) - b.linked)
    for i in range(len(held) - 1, 0, -1):
        if not gone[i]:
            held[reader.elements[i].parent] += held[i]
    return held


def mark(reader: Reader, strict: bool, freed: set[int]) -> Marks:
    """Asides by tag, by being hidden, by names that say nothing else, and, unless strict, outside an article by any word of a name.

    A name that only holds such a word is weak evidence: it counts for an element with less text than the rest of the page. Words of readers' comments
    count inside an article too. Elements in freed are no asides by their names, nor as a header or form.
    """
    elements = reader.elements
    off, main, weak = [False] * len(elements), [-1] * len(elements), [0] * len(elements)
    for i, e in enumerate(elements):
        if not i:
            continue
        around = main[e.parent]
        out = e.tag in ASIDE_TAGS or e.tag == "header" and around < 0
        if i in freed:
            out = out and e.tag not in ("form", "header")
        elif e.tag not in ("html", "body"):
            out = out or e.hidden
            if not out and e.said:
                marks = ASIDE_WORDS - OWN_HEADER if around >= 0 else ASIDE_WORDS
                words = _words(e.said)
                out = _wholly(e.said, marks)
                if not out and not strict and not words.isdisjoint(marks) and e.tag not in MAIN_TAGS:
                    weak[i] = HEAVY_COMMENTS if not words.isdisjoint(COMMENT_WORDS) else HEAVY if around < 0 else 0
        off[i] = out or off[e.parent]
        main[i] = around if around >= 0 else i if e.tag in MAIN_TAGS and not off[i] else -1
    for times in (HEAVY_COMMENTS, HEAVY):
        if times not in weak:
            continue
        held = _unlinked(reader, off)
        for i, e in enumerate(elements):
            off[i] = off[i] or i > 0 and off[e.parent] or weak[i] == times and held[i] < times * (held[0] - held[i])
    return Marks(off, [-1 if gone else m for gone, m in zip(off, main)])


#: Paths are smoothed over so many paths that first appear before and after them, as far as they part at most SPREAD levels up.
REACH, SPREAD = 40, 6


class Paths:
    """Root-to-leaf tag paths of blocks, as a tree; asides have paths of their own."""

    def __init__(self, elements: list[Element], aside: list[bool]) -> None:
        self.parent, self.depth = [-1], [0]
        known: dict[tuple[int, str, bool], int] = {}
        self.of = [0] * len(elements)
        for i, e in enumerate(elements):
            if i:
                key = self.of[e.parent], e.tag, aside[i]
                if key not in known:
                    known[key] = len(self.parent)
                    self.parent.append(key[0])
                    self.depth.append(e.depth)
                self.of[i] = known[key]

    def apart(self, p: int, q: int) -> int:
        """Levels from the deeper path up to where both part; SPREAD + 1 if it is more."""
        levels = 0
        while p != q:
            levels += 1
            if levels > SPREAD:
                break
            a, b = self.depth[p], self.depth[q]
            if a >= b:
                p = self.parent[p]
            if b >= a:
                q = self.parent[q]
        return levels


def path_scores(blocks: list[Block], paths: Paths, marks: Marks) -> dict[int, float]:
    """Path to its ratio of unlinked text and punctuation to tags, smoothed over near paths; 0 in asides."""
    sums: dict[int, list] = {}
    for b in blocks:
        own = "".join(b.parts)
        n = sums.setdefault(paths.of[b.element], [0, 0, 0, marks.aside[b.element]])
        n[0] += max(0, len(own.strip()) - b.linked)
        n[1] += len(PUNCTUATION.findall(own))
        n[2] += b.tags
    fused = {p: n[0] / n[2] * (1 + n[1] / n[2]) for p, n in sums.items()}
    order, out = [(p, paths.depth[p], n) for p, n in sums.items() if not n[3]], {p: 0.0 for p, n in sums.items() if n[3]}
    kernel = [math.exp(-(d**2) / 2) for d in range(SPREAD + 1)]
    for at, (p, deep, _) in enumerate(order):
        top = below = 0.0
        for q, level, m in order[max(0, at - REACH):at + REACH + 1]:
            if abs(level - deep) <= SPREAD and (d := paths.apart(p, q)) <= SPREAD:
                w = kernel[d] * m[2]
                top, below = top + w * fused[q], below + w
        out[p] = top / below
    return out


#: A path is content from this share of the page's best score on; text outside the article or main elements counts a tenth.
THRESHOLD, OUTSIDE = 0.2, 0.1


def _root(elements: list[Element], a: int, b: int) -> int:
    """The innermost element around two; for the first and last of several in page order, around all of them."""
    while a != b:
        if elements[a].depth >= elements[b].depth:
            a = elements[a].parent
        else:
            b = elements[b].parent
    return a


def _chosen(reader: Reader, marks: Marks, threshold: float) -> list[Block]:
    """Blocks of content, in page order: content paths choose the elements that hold the article, and whatever is no aside in those stays."""
    elements, blocks = reader.elements, [b for b in reader.blocks if not marks.aside[b.element]]
    scores = path_scores(reader.blocks, paths := Paths(elements, marks.aside), marks)
    best: dict[int, float] = {}
    outside = []
    for b in blocks:
        root, score = marks.main[b.element], scores[paths.of[b.element]]
        if root < 0:
            outside.append((b, score))
        else:
            best[root] = max(best.get(root, 0.0), score)
    share = OUTSIDE if best else 1.0
    least = threshold * max([*best.values(), *(share * s for _, s in outside)], default=0.0)
    roots = {r for r, s in best.items() if s >= least}
    passing = [b.element for b, s in outside if share * s >= least and s > 0]
    if not passing:
        return [b for b in blocks if marks.main[b.element] in roots]
    # without an article element: everything in the element around all content paths, but groups of links that hold none
    root = _root(elements, min(passing), max(passing))
    text, linked, holds = [0] * len(elements), [0] * len(elements), [False] * len(elements)
    for b in blocks:
        text[b.element] += sum(map(len, b.parts))
        linked[b.element] += b.linked
    within, inside, keep = set(), [False] * len(elements), [False] * len(elements)
    for e in passing:
        holds[e] = True
        around = elements[e].parent if elements[e].tag == "p" or elements[e].tag[:1] == "h" and elements[e].tag[1:].isdigit() else e
        if elements[around].tag not in ("", "html", "body"):
            within.add(around)  # what stands next to a paragraph belongs to it
    for i in range(len(elements) - 1, 0, -1):
        up = elements[i].parent
        text[up], linked[up], holds[up] = text[up] + text[i], linked[up] + linked[i], holds[up] or holds[i]
    for i, e in enumerate(elements):
        inside[i] = i in within or i > 0 and inside[e.parent]
        keep[i] = i == root or i > 0 and keep[e.parent] and (inside[i] or holds[i] or 2 * linked[i] <= text[i])
    return [b for b in blocks if (marks.main[b.element] in roots if marks.main[b.element] >= 0 else keep[b.element])]


def main_text(page: str, threshold: float = THRESHOLD) -> str:
    """The blocks of content, in page order, one to a line; white space within a block is one space. No markup or no page: what text there is, or an empty string.

    If the words of classes would leave no article, or no text at all, only those that say nothing else count; if
    that leaves none either, words don't count on articles and what is around them.
    """
    reader = Reader(page)
    elements = reader.elements
    filled = {b.element for b in reader.blocks}
    articles: set[int] = set()  # article and main elements with text, that are no reader's comments
    around: set[int] = set()
    for e in filled:
        while e > 0 and e not in around:
            around.add(e)
            e = elements[e].parent
    for i in around:
        if elements[i].tag in MAIN_TAGS and not _wholly(elements[i].said, {"comment", "comments"}):
            articles.add(i)
    kept: list[Block] = []
    for strict in (False, True):
        marks = mark(reader, strict, set())
        if not articles or any(marks.main[e] >= 0 for e in filled):
            if kept := _chosen(reader, marks, threshold):
                break
    if not kept and articles:
        freed = set()
        for e in articles:
            while e > 0 and e not in freed:
                freed.add(e)
                e = elements[e].parent
        kept = _chosen(reader, mark(reader, True, freed), threshold)
    return "\n".join(x for b in kept if (x := b.text()))


def _extract(batch: pa.RecordBatch) -> dict:
    texts = [main_text(x) if x else "" for x in batch.column("html").to_pylist()]
    return {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())}


@guarded
def extract_text(pages: DataFrame) -> DataFrame:
    """pages without html, with text and n_chars (code points). A null or empty html gives an empty text. Repeated rows give the same each. Columns of pages named text or n_chars are replaced. Time grows in proportion to the page, however deep it nests."""
    return arrow_map(pages, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], _extract, drop=("html",))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages").select("page_id", "url", F.col("html")))
