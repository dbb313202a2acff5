"""Main text of HTML pages by scoring the element tree.

A page is read into a tree.  Elements that are never article text are left out, by tag
(scripts, navigation, buttons, ...) or by a word in their class, id or role (advert, cookie,
comment, ...).  A form or a block marked by such a word is kept if it holds most of the page's text outside links:
then the mark, or the form around the page, says nothing about the article.  Every text block gives points, one plus its commas plus one per hundred
characters (three at most), to its parent, half to the grandparent, and ever less to three more
ancestors.  A candidate's points are discounted by its link density.  The best candidate,
or the article or main element around it, is kept together with those siblings that
score at least a fifth of it.  Beside a container that is neither, paragraphs and headings (which
give their points away) count by themselves: a paragraph by its length and link density,
a heading with what follows it.

Attributes are read as HTML reads them: a quote opens a value only after an equals sign.

One pass in tasks over Arrow batches, page by page; there is no shuffle.  Time and memory
are linear in a page's length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template".split())
DROP = RAW | frozenset("head nav footer aside form button select option svg math object canvas dialog menu "
                       "audio video fieldset label datalist".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section "
                  "summary table tbody td tfoot th thead tr ul caption".split())
# a start tag of the key closes an open element of the values (up to the nearest of its scope)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"),
          "tfoot": ("tr", "td", "th", "thead", "tbody")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}
OUTER = frozenset("article main".split())
# words of a class, id or role that mark what is no article text
UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertisements adsense adbox banner banners promo promos promoted promotion "
    "sponsor sponsors sponsored cookie cookies consent gdpr notice notices alert alerts popup popups modal modals overlay "
    "sidebar sidebars side rail menu menus menubar nav navbar navigation breadcrumb breadcrumbs header masthead topbar "
    "toolbar footer foot comment comments disqus respond replies reply share sharing social follow newsletter newsletters "
    "subscribe subscription signup login search searchbox related recommended recommendations widget widgets pagination "
    "pager copyright hidden contentinfo complementary".split())
# those that mark a part beside the article even where that part is longer than the article
STRONG = frozenset("ad ads advert adverts advertisement advertisements adsense cookie cookies consent gdpr comment comments "
                   "disqus respond replies reply footer sidebar sidebars".split())
# a token that begins or ends so tells of the page's state or of the absence of a part
ABOUT_FIRST = frozenset("no not non has with without overflow".split())
ABOUT_LAST = frozenset("open closed enabled disabled fixed".split())
# a marked block is kept if it holds more than this part of the page's text outside links
MOST, NEARLY_ALL = 0.5, 0.9
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+"
                  r"(?:\s*+=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*+|(?=>)))?+)*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*+))?+)?+")
_MAY_MARK = re.compile("class|id|role|hidden", re.I)
COMMAS = re.compile("[,،、，]")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
LONG, LINKED = 80, 0.25  # a paragraph of more characters may have links, up to this part of it
_SENTENCE = re.compile(r"[.!?…](?=[\s\"'”’»)]|$)|[。！？]")


def _is_prose(text: str, linked: int) -> bool:
    """Whether a paragraph beside the main container belongs to it: long with few links, or a sentence without any."""
    return linked < LINKED * len(text) if len(text) > LONG else not linked and bool(_SENTENCE.search(text))


KEPT, DOUBTED, REFUSED, LEFT_OUT = range(4)


def _marked(value: str) -> int:
    """What the tokens of a class, id or role say."""
    said = KEPT
    for token in value.lower().split():
        parts = re.split("[-_]", token)
        if parts[0] in ABOUT_FIRST or parts[-1] in ABOUT_LAST:
            continue
        for part in parts:
            if part in UNWANTED:
                said = max(said, REFUSED if part in STRONG else DOUBTED)
    return said


def _judged(tag: str, attrs: str, in_article: bool) -> int:
    """Whether an element is kept, kept only if it holds most of the page's text, or left out."""
    if tag == "form":
        return DOUBTED
    if tag in DROP or (tag == "header" and not in_article):
        return LEFT_OUT
    if not attrs or tag in ("body", "html") or not _MAY_MARK.search(attrs):
        return KEPT
    said = KEPT
    for name, a, b, c in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return LEFT_OUT
        if name in ("class", "id", "role") and (tag not in OUTER or "comment" in value.lower()):
            said = max(said, _marked(value))
    return said if tag in BLOCK else LEFT_OUT if said else KEPT


class Page:
    """Elements in page order (element i holds elements i to end[i] - 1) and text blocks."""

    def __init__(self, html: str):
        self.tag, self.parent, self.end, self.left_out = ["#"], [-1], [0], [False]
        self.doubted: list[tuple[int, int]] = []  # element, what its marks say
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._read(html)
        self._leave_out_marked()

    def _read(self, html: str) -> None:
        stack, opened = [0], {"a": 0}
        parts: list[str] = []
        link_parts = 0

        def close_block() -> None:
            nonlocal link_parts
            if parts:
                text = " ".join(unescape("".join(parts)).split())
                if text:
                    at = stack[-1]
                    while self.tag[at] not in BLOCK and self.parent[at] >= 0:
                        at = self.parent[at]
                    self.blocks.append((at, text, min(link_parts, len(text))))
                parts.clear()
            link_parts = 0

        def add_text(text: str) -> None:
            nonlocal link_parts
            if not self.left_out[stack[-1]]:
                parts.append(text)
                if opened.get("a"):
                    link_parts += len(text.strip())

        def pop() -> None:
            i = stack.pop()
            if self.tag[i] in BLOCK:
                stack.append(i)
                close_block()
                stack.pop()
            self.end[i] = len(self.tag)
            opened[self.tag[i]] -= 1

        def pop_to(names, stop=()) -> None:
            """Close the innermost open element of ``names``, unless one of ``stop`` is inside it."""
            if not any(opened.get(n) for n in names):
                return
            for k in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[k]]
                if tag in names:
                    while len(stack) > k:
                        pop()
                    return
                if tag in stop:
                    return

        at, size, pattern = 0, len(html), _TAG
        while at < size:
            lt = html.find("<", at)
            if lt < 0:
                add_text(html[at:])
                break
            if lt > at:
                add_text(html[at:lt])
            nxt = html[lt + 1:lt + 2]
            if nxt == "!" or nxt == "?":
                if html.startswith("<!--", lt):
                    stop = html.find("-->", lt + 4)
                    at = size if stop < 0 else stop + 3
                else:
                    stop = html.find(">", lt)
                    at = size if stop < 0 else stop + 1
                continue
            if not (nxt.isascii() and nxt.isalpha() or nxt == "/" and html[lt + 2:lt + 3].isalpha()):
                if nxt == "/":
                    stop = html.find(">", lt)
                    at = size if stop < 0 else stop + 1
                else:
                    add_text("<")
                    at = lt + 1
                continue
            m = pattern.match(html, lt)
            if m is None and pattern is _TAG:
                # a quote that never ends hides the rest: from here on a tag ends at the next '>'
                pattern = _PLAIN_TAG
                m = pattern.match(html, lt)
            if m is None:
                break  # the page ends inside a tag
            at = m.end()
            closing, tag, attrs = m[1], m[2].lower(), m[3]
            if closing:
                if tag in BLOCK:
                    pop_to((tag,), ("td", "th") if tag not in ("table", "tr", "tbody", "thead", "td", "th") else ())
                else:
                    pop_to((tag,), BLOCK)
                continue
            if tag in BLOCK:
                pop_to(("p",), ("table", "td", "th", "button"))
                if tag in CLOSES:
                    pop_to(CLOSES[tag], SCOPE.get(tag, ("table",)))
                close_block()
            if tag in RAW:
                add_text(" ")
                stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                if stop is None:
                    break
                shut = html.find(">", stop.end())
                at = size if shut < 0 else shut + 1
                continue
            if tag in VOID:
                add_text(" ")
                continue
            here = stack[-1]
            self.tag.append(tag)
            self.parent.append(here)
            self.end.append(0)
            in_article = bool(opened.get("article") or opened.get("main"))
            said = LEFT_OUT if self.left_out[here] else _judged(tag, attrs, in_article)
            self.left_out.append(said == LEFT_OUT)
            if said in (DOUBTED, REFUSED):
                self.doubted.append((len(self.tag) - 1, said))
            opened[tag] = opened.get(tag, 0) + 1
            if attrs.endswith("/") and tag not in BLOCK:  # an empty element of an embedded vocabulary
                opened[tag] -= 1
                self.end[-1] = len(self.tag)
                continue
            stack.append(len(self.tag) - 1)
        close_block()
        while len(stack) > 1:
            pop()
        self.end[0] = len(self.tag)

    def _leave_out_marked(self) -> None:
        """Leave out marked elements and their blocks, but for those that hold most of the text outside links."""
        if not self.doubted:
            return
        own = [0] * (len(self.tag) + 1)
        for at, text, linked in self.blocks:
            own[at + 1] += len(text) - linked
        for i in range(len(self.tag)):
            own[i + 1] += own[i]
        behind = 0
        for i, said in self.doubted:
            if i >= behind and own[self.end[i]] - own[i] <= (NEARLY_ALL if said == REFUSED else MOST) * own[-1]:
                behind = self.end[i]
                self.left_out[i:behind] = [True] * (behind - i)
        self.blocks = [b for b in self.blocks if not self.left_out[b[0]]]

    def main_text(self) -> str:
        """The kept blocks, joined by a space."""
        if not self.blocks:
            return ""
        points: dict[int, float] = {}
        n = len(self.tag)
        chars, links = [0] * (n + 1), [0] * (n + 1)
        for at, text, linked in self.blocks:
            chars[at + 1] += len(text)
            links[at + 1] += linked
            gives = 1 + len(COMMAS.findall(text)) + min(len(text) / 100, 3)
            # a container with text of its own stands for its paragraph's parent
            up = at if self.tag[at] in ("div", "section", "body", "#", "td") or self.tag[at] in OUTER \
                else self.parent[at]
            for level in range(5):
                if up < 0:
                    break
                points[up] = points.get(up, 0.0) + gives / (1 if level == 0 else 2 if level == 1 else 3 * level)
                up = self.parent[up]
        for i in range(n):
            chars[i + 1] += chars[i]
            links[i + 1] += links[i]

        def score(i: int) -> float:
            total = chars[self.end[i]] - chars[i]
            density = (links[self.end[i]] - links[i]) / total if total else 0.0
            bonus = 25 if self.tag[i] in OUTER else 0
            return (points.get(i, 0.0) + bonus) * (1 - density) if i in points else 0.0

        best = max(points, key=lambda i: (score(i), -i))
        top = score(best)
        up = best
        while up >= 0:
            if self.tag[up] in OUTER:
                best = up
            up = self.parent[up]
        around = self.parent[best]
        kept = [(best, self.end[best])]
        if around >= 0:
            kept += [(i, self.end[i]) for i in points if self.parent[i] == around and i != best
                     and not self.left_out[i] and score(i) >= max(10, 0.2 * top)]
        kept.sort()
        loose: set[int] = set()
        if around >= 0 and self.tag[best] not in OUTER:
            loose = self._prose_beside(around, kept)
        return " ".join(text for k, (at, text, _) in enumerate(self.blocks) if k in loose or _inside(kept, at))

    def _prose_beside(self, around: int, kept: list[tuple[int, int]]) -> set[int]:
        """Blocks of ``around`` outside ``kept`` that are prose: paragraphs and own text by themselves, headings
        with what follows them (the title in any case)."""
        found: set[int] = set()
        follows = False
        for k in range(len(self.blocks) - 1, -1, -1):
            at, text, linked = self.blocks[k]
            if not around <= at < self.end[around]:
                continue
            if _inside(kept, at):
                follows = True
            elif at != around and self.parent[at] != around:
                follows = False
            elif self.tag[at] in HEADINGS:
                if linked < LINKED * len(text) and (follows or self.tag[at] == "h1"):
                    found.add(k)
            elif at == around or self.tag[at] in ("p", "pre", "blockquote"):
                follows = _is_prose(text, linked)
                if follows:
                    found.add(k)
            else:
                follows = False
        return found


def _inside(spans: list[tuple[int, int]], at: int) -> bool:
    """Whether an element lies in one of the disjoint, sorted spans."""
    k = bisect_right(spans, (at, 1 << 60)) - 1
    return k >= 0 and at < spans[k][1]


def extract_one(html: str | None) -> str:
    """Main text of one page; empty for null, empty or text-free pages."""
    return Page(html).main_text() if html else ""


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the column ``html`` by ``text`` and ``n_chars`` (code points) in every row of ``pages``.

    Other columns pass through; columns already named ``text`` or ``n_chars`` are replaced.
    Null and empty pages give an empty text; an empty table gives an empty table; repeated
    rows give repeated results.
    """
    others = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    source = pages.select(*[f"`{c}`" for c in others], pages[f"`{html}`"].alias("_html"))
    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    schema = ", ".join([f"`{c}` {types[c]}" for c in others] + ["text string", "n_chars bigint"])

    def run(batches):
        for batch in batches:
            texts = [extract_one(x) for x in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(others)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[*others, "text", "n_chars"])

    return source.mapInArrow(run, schema)
