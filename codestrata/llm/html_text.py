"""Main text of web pages by a minimum cut.

A page is read into blocks of text. A classifier gives each block a score from where it stands (inside
an article, a menu, a footer, …), its length, its sentences and its links: what is above 0 is the
capacity from the content terminal, what is below that to the boilerplate terminal. Edges between
neighbouring blocks and between blocks of one parent element hold those together that look alike.
The minimum cut, found by maximum flow, is the labelling of least cost; blocks that can still be
reached from the content terminal are content. Weights are fixed, as no pages are labelled.

What an element is called counts by how plainly it says so: a class made of words for boilerplate and
for boxes speaks as strongly as a tag, one that holds other words too (`related-work`, `social-history`)
little, and of an article or a main element nothing but words for comments and teasers does. A form
is boilerplate only where its controls outweigh its text (a whole page may stand in a form). Articles
beside a main element are no content. Behind a heading that announces comments the rest of its section
is boilerplate.

Character references are decoded, white space in a block becomes one space, blocks are joined by an
empty line. Comments, scripts, styles, form controls and the head have no text. Null and empty pages
have an empty text, as have pages of boilerplate alone. Unclosed and misplaced tags are read as
browsers do in the common cases. Repeated rows are read alike. Columns of the page stay; added
columns replace columns of the same name."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

#: Where a comment, a declaration or a tag begins.
_BEGIN = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
#: What stands in a tag up to its end or its next value. A quote is one only where a value begins.
_PLAIN, _UNQUOTED = re.compile(r"[^>=]*+"), re.compile(r"[^\s>]*+")
_BLANKS = re.compile(r"\s*+")
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SENTENCE = re.compile(r"[.!?。！？…][\"')\]]*(?:\s|$)")

#: Elements of plain characters, up to their own end tag: nothing in them is a tag or a comment.
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])", re.I)
            for x in "script style textarea title iframe noscript".split()}

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is no text of the page.
SILENT = frozenset("script style noscript template svg math iframe object canvas textarea select button "
                   "title head audio video datalist option".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr img input".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag closes an open element of these kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
#: Where such closing ends.
SCOPE = frozenset("ul ol dl table div section article main body aside nav footer header form blockquote".split())

CONTENT_TAGS = frozenset(("article", "main"))
BOILERPLATE_TAGS = frozenset("nav aside footer menu dialog label fieldset legend".split())
CONTROLS = frozenset("input select textarea button label".split())
CONTENT_ROLES = frozenset(("main", "article"))
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
CONTENT_NAMES = frozenset("article content main post entry story".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead comment comments disqus reply replies respond cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations widget pagination pager toolbar copyright legal disclaimer skip "
    "aside search form teaser teasers trending".split())
#: Words that say how a box looks or where it is, not what is in it.
BOX_NAMES = frozenset(
    "box block list item items wrap wrapper container inner outer section area bar links link posts articles content top bottom "
    "left right site page global primary secondary main col column row grid group panel unit text title head heading header body "
    "area region zone slot thread count icon icons button buttons btn js is the and of on in post article entry story "
    "background sticky fixed mobile desktop small large dark light".split())
#: What a content element may be called without ceasing to be content.
OF_CONTENT = frozenset(
    "legal social notice notices alert search form skip banner copyright signup login share sharing subscription subscribe "
    "consent gdpr cookie cookies recommended recommendations widget menu".split())
COMMENTS = re.compile(
    r"(?:\d+\s+|no\s+|all\s+|leave\s+an?\s+|post\s+an?\s+|add\s+an?\s+|write\s+an?\s+|reader\s+|user\s+|your\s+|join\s+the\s+)*"
    r"(?:comments?|repl(?:y|ies)|responses?|discussion|conversation)(?:\s*[(:]?\s*\d*\s*[):]?)(?:\s+(?:on|to)\s+.*)?", re.I | re.S)
NOT_OWN = frozenset("has with no without show hide".split())
PAGE_HEADER_NAMES = frozenset(("header", "topbar", "masthead"))

#: Scores of the classifier, in hundredths.
INSIDE, OUTSIDE, NAMED, BOILERPLATE, HINT = 400, -600, 400, -1500, -200
PARAGRAPH, HEADING, SENTENCE, LETTERS, MOST_LETTERS, LINKED, FRAGMENT = 150, 100, 150, 2, 300, -500, -300
#: Capacities between blocks: neighbours, neighbours across a border, blocks of one parent.
NEAR, ACROSS, SIBLINGS = 250, 20, 250
#: Letters of text that outweigh a control of a form.
LETTERS_A_CONTROL = 150


class _Tokens:
    """Comments, declarations and tags of a page, each character looked at a bounded number of times."""

    def __init__(self, html: str):
        self.html = html
        self.last = {c: html.rfind(c) for c in "\"'>"}
        self.open: set[int] = set()  # places of '=' from which no tag ends

    def _tag_end(self, at: int) -> int:
        """Where the tag ends that is read up to here. Values have any length; a quote that is never
        closed is a character like others, and a tag that never ends so ends at the first '>'."""
        html, passed, place = self.html, [], at
        while place <= self.last[">"]:
            place = _PLAIN.match(html, place).end()
            if place >= len(html) or place in self.open:
                break
            if html[place] == ">":
                return place
            passed.append(place)
            place = _BLANKS.match(html, place + 1).end()
            quote = html[place:place + 1]
            if quote in ("\"", "'"):
                if self.last[quote] > place:
                    place = html.index(quote, place + 1) + 1
            else:
                place = _UNQUOTED.match(html, place).end()
        self.open.update(passed)
        return html.index(">", at)

    def next(self, look: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the next one; the name is empty but for tags."""
        html = self.html
        if look > self.last[">"]:  # no tag ends any more
            start = html.find("<!--", look)
            return (start, len(html), "", "", "") if start >= 0 else None
        m = _BEGIN.search(html, look)
        if not m:
            return None
        if m[1]:
            end = html.find("-->", m.end())
            return m.start(), end + 3 if end >= 0 else len(html), "", "", ""
        if m.end() > self.last[">"]:
            return self.next(m.end())
        if not m[3]:
            return m.start(), html.index(">", m.end()) + 1, "", "", ""
        end = self._tag_end(m.end())
        return m.start(), end + 1, m[2], m[3].lower(), html[m.end():end]


class Block:
    __slots__ = ("text", "tag", "inside", "in_main", "named", "boilerplate", "hinted", "parent", "linked", "form", "within")

    def __init__(self, text, tag, top, parent, linked):
        self.text, self.tag, self.parent, self.linked = text, tag, parent, linked
        self.inside, self.in_main, self.named = top.inside, top.in_main, top.named
        self.boilerplate, self.hinted, self.form, self.within = top.boilerplate, top.hinted, top.form, top


class _Open:
    """An open element, with what its ancestors say."""
    __slots__ = ("tag", "inside", "in_main", "named", "boilerplate", "hinted", "number", "link", "form", "above")

    def __init__(self, tag="", number=0, above=None):
        self.tag, self.number, self.above = tag, number, above
        self.inside = self.in_main = self.named = self.boilerplate = self.hinted = self.link = False
        self.form = 0
        if above:
            self.inside, self.in_main, self.named, self.hinted = above.inside, above.in_main, above.named, above.hinted
            self.boilerplate, self.form, self.link = above.boilerplate, above.form, above.link or tag == "a"


def _says(words: list[str], tag: str, inside: bool) -> str:
    """What a class or id of these words says of its element: `content`, `hint`, `boilerplate` or nothing."""
    if not NOT_OWN.isdisjoint(words):
        return ""
    page_header = not inside and not PAGE_HEADER_NAMES.isdisjoint(words)
    against = BOILERPLATE_NAMES.intersection(words)
    if not against and not page_header:
        return "" if CONTENT_NAMES.isdisjoint(words) else "content"
    if tag in CONTENT_TAGS:
        own = against - OF_CONTENT
        return "boilerplate" if own and words[0] in own and set(words) <= own | BOX_NAMES else ""
    return "boilerplate" if page_header or set(words) <= BOILERPLATE_NAMES | BOX_NAMES else "hint"


def _entered(above: _Open, tag: str, raw: str, number: int) -> _Open:
    own = _Open(tag, number, above)
    own.inside = own.inside or tag in CONTENT_TAGS
    own.in_main = own.in_main or tag == "main"
    own.boilerplate = own.boilerplate or tag in BOILERPLATE_TAGS or (tag == "header" and not above.inside)
    if tag == "form":
        own.form = number
    if raw and tag not in ("html", "body") and not own.boilerplate:
        for name, *values in _ATTRIBUTE.findall(raw):
            value = "".join(values)
            name = name.lower()
            if name in ("class", "id"):
                for one in value.split():
                    said = _says([w.lower() for w in _WORD.findall(one)], tag, above.inside)
                    own.boilerplate = own.boilerplate or said == "boilerplate"
                    own.hinted = own.hinted or said == "hint"
                    own.named = own.named or said == "content"
            elif name == "role":
                own.inside = own.inside or value.lower() in CONTENT_ROLES
                own.in_main = own.in_main or value.lower() == "main"
                own.boilerplate = own.boilerplate or value.lower() in BOILERPLATE_ROLES
            elif (name == "aria-hidden" and value.lower() == "true") or (
                    name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                own.boilerplate = True
    # the word within a value, but for classes, says nothing
    if "hidden" in raw and re.search(r"(?:^|\s)hidden(?:\s|$)", _ATTRIBUTE.sub(lambda m: m[0] if m[1].lower() == "class" else " ", raw)):
        own.boilerplate = True
    return own


def _settle(page: list[Block], controls: dict[int, int]) -> list[Block]:
    """What only the whole page tells: forms of controls, articles beside a main element, comment threads."""
    letters: dict[int, int] = {}
    for b in page:
        if b.form and not b.boilerplate and not b.linked > 0.5:
            letters[b.form] = letters.get(b.form, 0) + len(b.text)
    has_main = any(b.in_main and not b.boilerplate for b in page)
    thread: tuple[int, str] | None = None  # the element that holds the heading of comments, and its level
    for b in page:
        if b.form and letters.get(b.form, 0) < LETTERS_A_CONTROL * max(1, controls.get(b.form, 0)):
            b.boilerplate = True
        if has_main:
            b.inside = b.in_main
        if thread:
            element = b.within
            while element and element.number != thread[0]:
                element = element.above
            if element is None or (b.tag in HEADINGS and b.tag <= thread[1]):
                thread = None
        if b.tag in HEADINGS and not b.boilerplate and COMMENTS.fullmatch(b.text):
            holder = b.within.above if b.within.tag == b.tag else b.within
            while holder and holder.tag in HEADINGS | INLINE | {"header", "hgroup"}:
                holder = holder.above
            thread = (holder.number if holder else 0, b.tag)
        if thread:
            b.boilerplate = True
    return page


def blocks(html: str) -> list[Block]:
    """The page's blocks of text, in order."""
    out: list[Block] = []
    stack = [_Open()]
    controls: dict[int, int] = {}
    parts: list[str] = []
    linked = number = 0
    skip = ""  # inside a silent element
    at = look = 0  # where text begins, where the next token is looked for

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                top = next(e for e in reversed(stack) if e.tag not in INLINE)
                above = stack[stack.index(top) - 1].number if top.tag not in ("", "body", "div", "article", "main", "section") and len(stack) > 1 else top.number
                out.append(Block(text, top.tag, top, above, linked / len(text)))
        linked = 0

    def close_to(place: int) -> None:
        if any(e.tag not in INLINE for e in stack[place:]):
            close_block()
        del stack[place:]

    tokens = _Tokens(html)
    while token := tokens.next(look):
        start, after, end, tag, raw = token
        if start > at and not skip:
            text = html[at:start]
            if "&" in text:
                text = unescape(text)
            parts.append(text)
            if stack[-1].link:
                linked += len(text)
        at = look = after
        if not tag:
            continue
        if tag in _RAW_END and not end and not raw.rstrip().endswith("/"):
            close = _RAW_END[tag].search(html, at)
            look = close.start() if close else len(html)
        if skip:
            if end and tag == skip:
                skip = ""
            elif skip == "head" and tag == "body":
                skip = ""
            else:
                continue
            if end:
                continue
        if end:
            if tag in INLINE:  # closes its own element, inside the block at most
                for place in range(len(stack) - 1, 0, -1):
                    if stack[place].tag == tag:
                        del stack[place]
                        break
                    if stack[place].tag not in INLINE:
                        break
            else:
                for place in range(len(stack) - 1, 0, -1):
                    if stack[place].tag == tag:
                        close_to(place)
                        break
                else:
                    close_block()
            continue
        if tag in CONTROLS and stack[-1].form:
            controls[stack[-1].form] = controls.get(stack[-1].form, 0) + ("hidden" not in raw)
        if tag in SILENT:
            if not raw.rstrip().endswith("/"):
                skip = tag
            if tag not in INLINE and tag not in ("svg", "math", "button", "select"):
                close_block()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            if tag not in VOID:
                number += 1
                stack.append(_entered(stack[-1], tag, raw, number))
            continue
        close_block()
        for place in range(len(stack) - 1, 0, -1):  # an open paragraph ends here
            if stack[place].tag == "p":
                del stack[place:]
                break
            if stack[place].tag not in INLINE:
                break
        if tag in CLOSES:
            for place in range(len(stack) - 1, 0, -1):
                if stack[place].tag in CLOSES[tag]:
                    del stack[place:]
                    break
                if stack[place].tag in SCOPE:
                    break
        if tag not in VOID:
            while len(stack) > 1 and stack[-1].tag in INLINE and stack[-1].tag != "a":
                stack.pop()
            number += 1
            stack.append(_entered(stack[-1], tag, raw, number))
    if not skip:
        parts.append(unescape(html[at:]))
    close_block()
    return _settle(out, controls)


def scores(page: list[Block]) -> list[int]:
    """What speaks for (above 0) or against each block being content."""
    marked = any(b.inside and not b.boilerplate for b in page)
    named = any(b.named and not b.boilerplate for b in page)
    out = []
    for b in page:
        s = BOILERPLATE if b.boilerplate else HINT if b.hinted else 0
        if marked:
            s += INSIDE if b.inside else OUTSIDE
        elif named:
            s += NAMED if b.named else -NAMED
        if b.tag in HEADINGS:
            s += HEADING
        elif b.tag in ("p", "blockquote", "pre"):
            s += PARAGRAPH
        s += min(MOST_LETTERS, LETTERS * len(b.text))
        if _SENTENCE.search(b.text):
            s += SENTENCE
        elif b.tag not in HEADINGS:
            s += FRAGMENT
        if b.linked > 0.5:
            s += LINKED
        out.append(s)
    return out


def minimum_cut(terminal: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut (the side reachable in the residue).

    terminal: capacity from the source (above 0) or to the sink (below 0); edges go both ways."""
    n = len(terminal)
    to: list[int] = []
    room: list[int] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: int, back: int) -> None:
        at[a].append(len(to))
        at[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, t in enumerate(terminal):
        if t > 0:
            join(n, i, t, 0)
        elif t < 0:
            join(i, n + 1, -t, 0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[n] = 0
        queue = deque([n])
        while queue:
            a = queue.popleft()
            for e in at[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[n + 1] < 0:
            return [x >= 0 for x in level[:n]]
        next_ = [0] * (n + 2)
        path: list[int] = []
        a = n
        while True:  # blocking flow: walk forward along levels, back out of dead ends
            if a == n + 1:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut_at = next(i for i, e in enumerate(path) if not room[e])
                a = to[path[cut_at] ^ 1]
                del path[cut_at:]
                continue
            while next_[a] < len(at[a]):
                e = at[a][next_[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                next_[a] += 1
            if next_[a] < len(at[a]):
                path.append(at[a][next_[a]])
                a = to[path[-1]]
            elif a == n:
                break
            else:
                a = to[path.pop() ^ 1]
                next_[a] += 1


def smoothness(page: list[Block]) -> list[tuple[int, int, int]]:
    """(block, block, capacity) of those that stand side by side or in one parent."""
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(page):
        if i:
            same = (b.boilerplate, b.inside) == (page[i - 1].boilerplate, page[i - 1].inside)
            edges.append((i - 1, i, NEAR if same else ACROSS))
        if b.parent in last:
            edges.append((last[b.parent], i, SIBLINGS if b.boilerplate == page[last[b.parent]].boilerplate else ACROSS))
        last[b.parent] = i
    return edges


def labels(page: list[Block]) -> list[bool]:
    """Which blocks are content."""
    return minimum_cut(scores(page), smoothness(page))


def main_text(html: str) -> str:
    page = blocks(html)
    return "\n\n".join([b.text for b, content in zip(page, labels(page), strict=True) if content])


def extract(html: Column | str) -> Column:
    """The main text of a column of pages."""
    @arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([main_text(h) if h else "" for h in pages.to_pylist()], pa.string())

    return text(html)


def extract_pages(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """The pages with their main text."""
    return pages.withColumn(into, extract(F.col(html)))
