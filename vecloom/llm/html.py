"""Main text of web pages by tree scoring.

A tolerant tokenizer (tags, comments, raw-text elements, attributes by state) builds the page's tree, with the usual
implied ends (a block ends an open paragraph, an item ends the item before). Every paragraph passes points for its
length and commas to its ancestors, halved at each step, discounted by the share of link text; <article> and <main>
start ahead. Elements that by name, role, class or id look like menus, headers of the site, footers, sidebars, notices,
adverts, forms or reader comments pass on a fraction of their points. The best container is kept, and of its siblings
those that are paragraphs of prose or score near it, and the prose that a <main> has around its article.

Inside of what is kept, elements that look unwanted go, unless nearly all prose would go with them: a wrapper named
`has-sidebar` or `widget` around the article is no sidebar. Scripts, styles and controls never show text.

Every step is a pass over the page or its tree: a page costs time in proportion to its length, however it is nested.

Text: character references decoded, white space inside a block one space, blocks trimmed and joined by a blank line.

Defined results. Null or empty html, and pages without text: the empty string. Markup cut short or unclosed: what was
read is kept; a quote that is never closed ends with its tag. No container scores (text outside of any block): the
body's text. Ties: the container that comes first. Nothing is capped. Repeated rows are read alike; extra columns are
ignored.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame

from vecloom.llm.base import map_text

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*(?:([^\s/>][^\s/>=]*)(?:\s*=\s*(?:([\"'])|([^\s>]*)))?)?")
SPACES = re.compile(r"\s+")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements whose content is no text of the page.
SILENT = {"head", "script", "style", "noscript", "template", "iframe", "noembed", "noframes", "object", "embed", "svg", "canvas", "button", "select", "input", "textarea", "title", "audio", "video"}
IN_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = {"p", "pre", "td", "blockquote", "li", "dd", *HEADINGS}
#: Elements and roles that stand beside the main text.
BESIDE = {"nav", "footer", "aside", "form", "fieldset", "menu", "dialog"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form", "toolbar"}
UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertis\w*|adsense|adslot|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|masthead|site-?header|topbar|toolbar|cookies?|consent|gdpr|notices?|popup|modal|"
    r"overlay|newsletter|subscribe|subscription|signup|login|comments?|comment-?list|disqus|respond|replies|reply|share|sharing|social|related|recommend\w*|widget|pager|pagination|skip|search|legal|copyright|disclaimer)(?:$|[\s_-])",
    re.I,
)
#: Class names that say so in a word of their own.
PLAIN = re.compile(r"(?:^|\s)(?:ads?|adverts?|advertisement|sidebar|footer|nav|navbar|navigation|menu|breadcrumbs?|comments?|comment-?list|comments?-(?:area|section)|disqus\w*|cookie-?\w*|newsletter|social|share)(?:$|\s)", re.I)
#: What a start tag ends, and where the search for that stops.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, **dict.fromkeys(("thead", "tbody", "tfoot"), {"thead", "tbody", "tfoot", "tr", "td", "th"})}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, **dict.fromkeys(("tr", "thead", "tbody", "tfoot"), {"table"})}
CELLS = ("td", "th", "caption")
#: Parts of a table or list, which are no containers of their own.
PARTS = {"tr", "thead", "tbody", "tfoot", "table", "ul", "ol", "dl"}
#: The points that what looks unwanted by class, and by name, role or plainly so, passes on.
DOUBTFUL, BAD = 0.2, 0.05
#: Unwanted elements stay if what is left without them is under this share of their prose.
LEFT = 0.1
#: With so much prose, and nothing beside it, a plainly unwanted element is the page's text after all.
PROSE = 200

_ends: dict[str, re.Pattern] = {}


class Node:
    __slots__ = ("block", "chars", "children", "kind", "linked", "marked", "name", "parent", "points", "silent", "weight")

    def __init__(self, name: str, parent: Node | None, silent: bool) -> None:
        self.name, self.parent, self.silent = name, parent, silent
        self.kind, self.weight, self.block = name, 1.0, name in BLOCKS
        self.children: list[Node | str] = []
        self.points, self.chars, self.linked, self.marked = 0.0, 0, 0, False

    @property
    def prose(self) -> int:
        return self.chars - self.linked


class Reader:
    """Cuts markup into tags; each search for a mark that does not come again is made once."""

    def __init__(self, html: str) -> None:
        self.html, self.lost = html, set()

    def find(self, mark: str, at: int) -> int:
        if mark in self.lost:
            return -1
        found = self.html.find(mark, at)
        if found < 0:
            self.lost.add(mark)
        return found

    def end_of(self, mark: str, at: int) -> int:
        found = self.find(mark, at)
        return len(self.html) if found < 0 else found + len(mark)

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], int, bool]:
        """Names and values of a tag from `at` on, where the tag ends, and whether it closes itself."""
        html, out = self.html, []
        while True:
            m = ATTRIBUTE.match(html, at)
            slash = "/" in html[at : m.start(1) if m[1] is not None else m.end()]
            at = m.end()
            if m[1] is None:
                return out, min(at + 1, len(html)), slash
            value = m[3] or ""
            if m[2]:
                stop = self.find(m[2], at)
                if stop < 0:  # a quote that is never closed
                    stop = self.find(">", at)
                    return out, len(html) if stop < 0 else stop + 1, False
                value, at = html[at:stop], stop + 1
            out.append((m[1].lower(), value))


def doubt(node: Node, attributes: list[tuple[str, str]], inside: bool) -> None:
    """Set the weight of a node by its name and attributes; `inside` an article."""
    if node.name in BESIDE or (node.name == "header" and not inside):
        node.weight = BAD
    for key, value in attributes:
        if key == "role":
            role = value.strip().lower()
            if role in ROLES:
                node.weight = BAD
            elif role in ("main", "article"):
                node.kind = role
        elif key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            node.weight = BAD
        elif key in ("class", "id") and node.name not in ("html", "body", "article", "main"):
            words = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value)
            if UNWANTED.search(words):
                node.weight = min(node.weight, BAD if PLAIN.search(words) else DOUBTFUL)


def parse(html: str) -> list[Node]:
    """The nodes of the page's tree in page order, the root first; silent ones stand in no parent's children."""
    root = Node("#root", None, False)
    nodes, stack = [root], [root]
    where: dict[str, list[int]] = {}  # places in the stack by name
    blocks = [0]  # places in the stack of blocks
    reader, at, begin = Reader(html), 0, 0

    def last(names) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=-1)

    def cut(to: int) -> None:
        while len(stack) > to:
            where[stack.pop().name].pop()
        while blocks[-1] >= to:
            blocks.pop()

    def say(text: str) -> None:
        if not text:
            return
        if stack[-1].name == "head" and text.strip():
            cut(len(stack) - 1)
        if not stack[-1].silent:
            stack[-1].children.append(text)

    while True:
        mark = reader.find("<", at)
        if mark < 0:
            say(html[begin:])
            return nodes
        ending = html.startswith("/", mark + 1)
        m = NAME.match(html, mark + 1 + ending)
        if m is None:
            if not ending and html[mark + 1 : mark + 2] not in ("!", "?"):
                at = mark + 1  # a bare sign is text
                continue
            say(html[begin:mark])
            if html.startswith("<!--", mark):
                at = begin = mark + 5 if html.startswith(">", mark + 4) else mark + 6 if html.startswith("->", mark + 4) else reader.end_of("-->", mark + 4)
            else:
                at = begin = reader.end_of(">", mark)
            continue
        say(html[begin:mark])
        name = m[0].lower()
        attributes, at, slash = ([], m.end() + 1, False) if html.startswith(">", m.end()) else reader.attributes(m.end())
        begin = at
        if ending:
            place = where[name][-1] if where.get(name) else -1
            # an inline end does not leave its block, nor any but a table's end its cell
            if place > 0 and (blocks[-1] <= place if name not in BLOCKS else last(CELLS) <= place or name in FENCES or name == "table"):
                cut(place)
            continue
        if where.get("head") and name not in IN_HEAD and name != "head":
            cut(where["head"][-1])
        if name in ("html", "body") and where.get(name):
            continue
        if name in BLOCKS:
            top = stack[blocks[-1]].name
            if top == "p" or (top in HEADINGS and name in HEADINGS):
                cut(blocks[-1])
        elif name == "a" and last(("a",)) > blocks[-1]:
            cut(last(("a",)))
        if name in CLOSES:
            fence = last(FENCES[name])
            found = [where[n][-1] for n in CLOSES[name] if where.get(n) and where[n][-1] > fence]
            if found:
                cut(min(found))
        parent = stack[-1]
        node = Node(name, parent, parent.silent or name in SILENT)
        if not node.silent:
            doubt(node, attributes, bool(where.get("article") or where.get("main")))
            parent.children.append(node)
            nodes.append(node)
        if name in VOID or (slash and name not in BLOCKS):
            continue
        if name in RAW:
            if name not in _ends:
                _ends[name] = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I)
            end = _ends[name].search(html, at)
            if not node.silent:
                node.children.append(html[at : end.start() if end else len(html)])
            at = begin = end.end() if end else len(html)
            continue
        where.setdefault(name, []).append(len(stack))
        if node.block:
            blocks.append(len(stack))
        stack.append(node)


def clean(text: str) -> str:
    return SPACES.sub(" ", unescape(text)).strip()


def blocks(top: Node) -> list[tuple[Node, str, int]]:
    """(block, text, characters of links) in page order; runs of inline content belong to the block around them."""
    out: list[tuple[Node, str, int]] = []
    owner, parts, linked = top, [], 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = SPACES.sub(" ", "".join(parts)).strip()
            if text:
                out.append((owner, text, min(linked, len(text))))
        parts, linked = [], 0

    work: list[tuple[Node | str | None, Node, bool]] = [(top, top, False)]
    while work:
        item, block, link = work.pop()
        if item is None:
            flush()
            owner = block
        elif isinstance(item, str):
            parts.append(unescape(item))
            if link:
                linked += len(clean(item))
        elif item.name == "br":
            parts.append(" ")
        elif item.block or item.weight < 1 or item is top:  # doubtful inline elements are judged on their own
            flush()
            owner = item
            work.append((None, block, link))
            work += [(x, item, link or item.name == "a") for x in reversed(item.children)]
        else:
            work += [(x, block, link or item.name == "a") for x in reversed(item.children)]
    flush()
    return out


def score(nodes: list[Node], found: list[tuple[Node, str, int]]) -> list[Node]:
    """Set points, characters and link characters of the nodes; those that got points, in page order."""
    got: set[int] = set()
    for block, text, linked in found:
        points = (1 + text.count(",") + text.count("，") + min(len(text) / 100, 30)) * (1 - linked / len(text))
        to = block.parent if block.name in PARAGRAPHS else block
        to.points += points * (0.2 if block.name in HEADINGS else 1.0) * (block.weight if to is not block else 1.0)
        got.add(id(to))
        block.chars += len(text)
        block.linked += linked
    for n in reversed(nodes):  # children come after their parents
        if id(n) in got:
            n.points += 25.0 if n.kind in ("article", "main") else 0.0
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.linked += n.linked
            if id(n) in got:
                n.parent.points += n.points * n.weight / 2
                got.add(id(n.parent))
    return [n for n in nodes if id(n) in got and n.parent is not None]


def beneath(top: Node) -> tuple[int, list[Node]]:
    """The prose of a node without the outermost doubtful elements below it, and those."""
    left, doubtful, work = top.prose, [], [top]
    while work:
        for x in work.pop().children:
            if isinstance(x, Node):
                if x.weight < 1:
                    doubtful.append(x)
                    left -= x.prose
                elif x.chars:
                    work.append(x)
    return left, doubtful


def plain_text(top: Node) -> bool:
    """Whether an element holds what only a page's text has."""
    work = [top]
    while work:
        for x in work.pop().children:
            if isinstance(x, Node) and x.chars:
                if x.kind in ("article", "main", "h1"):
                    return True
                work.append(x)
    return False


def forgiven(top: Node) -> set[int]:
    """Doubtful elements below top that stay, since almost no prose is left without them."""
    out: set[int] = set()
    while True:
        left, doubtful = beneath(top)
        most = max(doubtful, key=lambda n: n.prose, default=None)
        if most is None or not most.prose or left >= LEFT * most.prose:
            return out
        if most.weight == BAD and not (left == 0 and most.prose >= PROSE) and not plain_text(most):
            return out
        out.add(id(most))
        top = most


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    nodes = parse(html)
    found = blocks(nodes[0])
    order = score(nodes, found)
    if not order:
        order = [nodes[0]]
    # what stands in a doubtful element counts less, however deep
    trust: dict[int, float] = {id(nodes[0]): 1.0}
    for n in nodes[1:]:
        trust[id(n)] = min(trust[id(n.parent)], n.weight)

    def worth(n: Node) -> float:
        return n.points * (1 - n.linked / n.chars if n.chars else 0) * trust[id(n)]

    best = max(order, key=worth)
    if trust[id(best)] == BAD:  # nothing but what stands beside a text
        outer = node = best
        while node is not None:
            outer, node = node if node.weight == BAD else outer, node.parent
        if outer.prose < PROSE and not plain_text(outer):
            return ""
    marked = max((n for n in order if n.kind == "article"), key=worth, default=None) or max((n for n in order if n.kind == "main"), key=worth, default=None)
    pool = marked is not None and worth(marked) >= 0.3 * worth(best)
    if pool:
        best = marked
    while not pool and best.parent is not None and best.parent.name not in ("#root", "html"):
        up = best.parent  # a container whose parent holds as much prose in other parts is one part of the article
        if up.prose > 1.5 * best.prose and worth(up) >= 0.5 * worth(best):
            best = up
        else:
            break
    while best.name in PARTS and best.parent is not None:
        best = best.parent
    kept = [best]
    if best.parent is not None and best.name != "body":
        bar = max(10.0, 0.2 * worth(best))
        for x in best.parent.children:
            if isinstance(x, Node) and x is not best and x.chars and x.weight == 1:
                prose = x.name in ("p", "pre", "blockquote", *HEADINGS) and x.linked <= 0.25 * x.chars and not pool
                if prose or (worth(x) >= bar and (not pool or x.kind == best.kind)):
                    kept.append(x)
    stays = {id(n) for n in kept}
    around = best
    while pool and around is not None and around.kind != "main":
        around = around.parent
    loose = around if around is not best else None
    for n in kept:
        stays |= forgiven(n)
    # from the top down: what is kept, without what is doubtful; blocks of a <main> outside of any article are loose
    free: set[int] = {id(loose)} if loose is not None else set()
    for n in nodes[1:]:
        up = n.parent
        n.marked = id(n) in stays or (up.marked and n.weight == 1)
        if not n.marked and id(up) in free and n.weight == 1 and n.kind != "article":
            free.add(id(n))
    if best is nodes[0]:
        nodes[0].marked = True
        for n in nodes[1:]:
            n.marked = id(n) in stays or (n.parent.marked and n.weight == 1)
    chosen = [b.marked for b, _, _ in found]
    if free:
        for i, (b, text, linked) in enumerate(found):
            chosen[i] = chosen[i] or (id(b) in free and b.name not in HEADINGS and len(text) >= 25 and linked <= 0.25 * len(text))
        for i in range(len(found) - 2, -1, -1):  # a heading goes with what it heads
            b = found[i][0]
            chosen[i] = chosen[i] or (id(b) in free and b.name in HEADINGS and chosen[i + 1])
    return "\n\n".join(text for (_, text, _), ok in zip(found, chosen, strict=True) if ok)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""

    def step(rows: list) -> dict:
        found = [extract(h) for h in rows]
        return {"text": found, "n_chars": [len(t) for t in found]}

    rows = pages.selectExpr("cast(page_id as long) page_id", "url", "html")
    return map_text(rows, lambda: step, "page_id long, url string", "text string, n_chars long", "html")
