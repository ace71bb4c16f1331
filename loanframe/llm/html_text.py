"""Main text of HTML pages by tree scoring.

Paragraphs pass points for their length and commas to their parent and, by
half, to their grandparent; a container's points are discounted by the share of
its text that stands in links.  If the container with the most points lies in an
article or main element, that whole element is kept; elsewhere the container and
those siblings that hold up against it, by their points or by their own text.
Navigation, forms, notices, adverts and reader comments are cut out before, but
no element that holds the page's only article or most of its paragraph text.

Defined results: a null or empty page has an empty text; a page without
paragraphs gives what is left of its body; truncated or badly nested markup is
read as far as it goes; a head ends where its content can't go on, and of other
skipped elements (buttons, canvas) that are not closed the blocks inside are
read; other columns are carried along.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element groups, by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style noscript template iframe object svg canvas select textarea button head title".split())
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
FOREIGN = ("foreignobject",)
CUT = frozenset("nav footer aside form dialog menu".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html li dd dt tbody td tfoot th thead tr summary".split())
P_SCOPE = frozenset("td th li article section div".split()) | SKIP
SAME = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
        "option": ("select",)}
SAME = {k: SKIP.union(v) for k, v in SAME.items()}
UNLIKELY = re.compile(
    r"(^|[-_ ])(ads?|adverts?|advertisements?|adsense|banners?|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|footer|"
    r"gdpr|login|masthead|menus?|modal|nav|navbar|navigation|newsletter|notices?|paywall|popup|promos?|related|replies|"
    r"respond|share|sharing|sidebars?|signup|skip|social|sponsors?|sponsored|subscribe|toolbar|widgets?|responses|alert)([-_ ]|$)", re.I)
COMMENTS = re.compile(r"comment|disqus|repl(y|ies)|respon[ds]", re.I)
# A class that says what a page has or lacks, as has-sidebar or comments-open, does not name the element itself.
STATE = re.compile(r"(has|no|not|with|without)[-_].*|.*[-_](open|enabled|disabled|on|off|active)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
PARAGRAPHS = frozenset("p pre td blockquote".split())
CONTENT = PARAGRAPHS | frozenset("h1 h2 h3 h4 h5 h6 dl figure ol table ul".split())
MIN_SIBLING, SIBLING_SHARE, SIBLING_LINKS, MENU_LINKS = 3.0, 0.2, 0.25, 0.5


class Node:
    __slots__ = ("tag", "parent", "parts", "points", "cut", "size", "linked", "commas", "holds", "prose", "articles")

    def __init__(self, tag: str, parent: Node | None, cut: str = ""):
        self.tag, self.parent, self.cut = tag, parent, cut  # cut: "", "part", "comments", "skip" or "open" (skipped, not closed)
        self.parts: list[Node | str] = []
        self.points = 0.0
        self.size = self.linked = self.commas = 0  # characters of text, those in links, commas
        self.prose = self.articles = 0  # characters of paragraphs outside links, articles with such; comments count in themselves only
        self.holds = False  # whether it is or holds a paragraph, heading, list, table or figure with text


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None)
        self.skip: Node | None = None  # the outermost skipped element that is open
        self.skips: list[Node] = []  # skipped elements; those whose end tag came have cut "skip"

    def _inside(self, tags: tuple[str, ...] | frozenset[str], until: tuple[str, ...] | frozenset[str] = ()) -> Node | None:
        node = self.at
        while node is not self.root and node.tag not in until:
            if node.tag in tags:
                return node
            node = node.parent
        return None

    def _leave(self, node: Node) -> None:
        """Ends a node and what is open in it."""
        if self.skip:
            at = self.at
            while at is not node and at is not self.skip:
                at = at.parent
            if at is self.skip:
                self.skip = None
        self.at = node.parent

    def handle_starttag(self, tag, attrs):
        if self.skip:
            if self.at.tag == "head" and tag not in HEAD or tag == "body":
                if head := self._inside(("head",)):
                    self._leave(head)
            elif self.skip.tag == "svg" and tag in BLOCK and not self._inside(FOREIGN):
                self._leave(self.skip)
        if tag in CLOSES_P and (p := self._inside(("p",), P_SCOPE)):
            self._leave(p)
        elif tag in SAME and (x := self._inside(("dd", "dt") if tag in ("dd", "dt") else (tag,), SAME[tag])):
            self._leave(x)
        if tag in VOID:
            self.at.parts.append(" " if tag in ("br", "hr") else "")
            return
        cut = self._cut(tag, attrs) if tag not in SKIP else "skip" if tag == "head" else "open"
        node = Node(tag, self.at, cut)
        self.at.parts.append(node)
        self.at = node
        if tag in SKIP:
            self.skip = self.skip or node
            self.skips.append(node)

    def _cut(self, tag, attrs) -> str:
        given = {k: v or "" for k, v in attrs}
        named = f"{given.get('class', '')} {given.get('id', '')}"
        hidden = "hidden" in given or "display:none" in given.get("style", "").replace(" ", "").lower()
        cut = tag in CUT or hidden or given.get("role", "").lower() in ROLES or given.get("aria-hidden") == "true"
        named = " ".join(x for x in named.split() if not STATE.fullmatch(x))
        cut = cut or tag not in ("html", "body", "article", "main") and bool(UNLIKELY.search(named)) and not self._inside(("pre", "code"))
        cut = cut or tag == "article" and bool(re.search(r"comment|sidebar|\bad\b|promo|related", named, re.I))
        cut = cut or tag == "header" and not self._inside(("article", "main"))
        return "" if not cut else "comments" if COMMENTS.search(named) else "part"

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif tag not in SKIP:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        # Only the end of a block or of the head ends a skipped element that is open in it.
        ends = tag in BLOCK and not (tag == "p" and self.skip and self.skip.tag == "button") or tag == "head"
        if x := self._inside((tag,), () if ends else SKIP - {tag}):
            if tag in SKIP:
                x.cut = "skip"
            self._leave(x)

    def handle_data(self, data):
        if self.at.tag == "head" and data.strip():
            self._leave(self.at)
        self.at.parts.append(data)

    def finish(self) -> None:
        """Blocks in skipped elements that were never closed go up to the elements these stand in."""
        loose = [x for x in self.skips if x.cut == "open"]
        for parent in {id(x.parent): x.parent for x in loose}.values():
            parts: list[Node | str] = []
            for x in parent.parts:
                if isinstance(x, str) or x.cut != "open":
                    parts.append(x)
                    continue
                todo = [x]
                while todo:
                    y = todo.pop()
                    if y.tag in BLOCK:
                        y.parent = parent
                        parts.append(y)
                    elif y.cut != "skip":
                        todo.extend(z for z in reversed(y.parts) if isinstance(z, Node))
            parent.parts = parts


def _spare(root: Node) -> None:
    """Takes back the cut of elements without which the page would lose its article or most of its paragraphs."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.cut != "skip":
            order.append(node)
            todo.extend(x for x in node.parts if isinstance(x, Node))
    if not any(x.cut for x in order):
        return
    seen: dict[int, int] = {}  # prose outside all that is cut
    for node in reversed(order):
        kids = [x for x in node.parts if isinstance(x, Node) and x.cut != "skip"]
        _size(node, kids)
        if _paragraph(node):
            node.prose = seen[id(node)] = node.size - node.linked
        else:
            node.prose = sum(x.prose for x in kids if x.cut != "comments")
            seen[id(node)] = sum(seen[id(x)] for x in kids if not x.cut)
        node.articles = sum(x.articles for x in kids if x.cut != "comments") + (
            node.tag in ("article", "main") and not node.cut and node.prose > 0)
    # Elements on the way from the root: whether an article or main element with text that stays is among them.
    shown, todo = 0, [root]
    while todo:
        node = todo.pop()
        if not node.cut:
            shown += node.tag in ("article", "main") and seen[id(node)] > 0
            todo.extend(x for x in node.parts if isinstance(x, Node))
    todo = [(root, 0)]
    while todo:
        node, above = todo.pop()
        if node.cut == "skip":
            continue
        if node.cut == "part" and (node.articles and not shown or shown == above and node.prose * 2 > root.prose > 0):
            node.cut = ""
        elif node.cut == "comments" and node.prose and (not root.prose or _holds_main(node)):
            node.cut = ""
        if not node.cut:
            above += node.tag in ("article", "main") and seen[id(node)] > 0
            todo.extend((x, above) for x in node.parts if isinstance(x, Node))


def _holds_main(node: Node) -> bool:
    todo = [node]
    while todo:
        x = todo.pop()
        if x.tag == "main" and x.prose:
            return True
        todo.extend(y for y in x.parts if isinstance(y, Node) and y.cut != "skip")
    return False


def _size(node: Node, kids: list[Node] | None = None) -> None:
    own = [" ".join(x.split()) for x in node.parts if isinstance(x, str)]
    if kids is None:
        kids = [x for x in node.parts if isinstance(x, Node) and not x.cut]
    node.size = sum(map(len, own)) + sum(k.size for k in kids)
    node.commas = sum(x.count(",") for x in own) + sum(k.commas for k in kids)
    node.linked = node.size if node.tag == "a" else sum(k.linked for k in kids)
    node.holds = bool(node.size) and (node.tag in CONTENT or any(k.holds for k in kids))


def _measure(root: Node) -> list[Node]:
    """Sizes of all nodes; returns those in page order that are not cut out."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.cut:
            continue
        order.append(node)
        todo.extend(x for x in reversed(node.parts) if isinstance(x, Node))
    for node in reversed(order):
        _size(node)
    return order


def _paragraph(node: Node) -> bool:
    """A paragraph, or a container that holds text and no block."""
    if node.tag in PARAGRAPHS:
        return True
    return node.tag in ("div", "section", "article", "main", "body") and not any(
        isinstance(x, Node) and x.tag in BLOCK for x in node.parts)


def _link_share(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def _text_points(node: Node) -> float:
    """Points for the length and the commas of the node's own text."""
    return (1 + node.commas + min(node.size / 100, 3)) * (1 - _link_share(node))


def _blocks(parent: Node, best: Node) -> list[Node]:
    """The parts of a node that are not cut; a run of bare text and inline elements counts as one block."""
    out: list[Node] = []
    for x in parent.parts:
        if isinstance(x, Node) and (x is best or x.cut or x.tag in BLOCK or x.holds):
            out.append(x)
            continue
        if not out or out[-1].tag != "#run":
            out.append(Node("#run", parent))
        out[-1].parts.append(x)
    for x in out:
        if x.tag == "#run":
            _size(x)
    return [x for x in out if not x.cut]


def _kept(best: Node) -> list[Node]:
    """The nodes that make up the main text, given the container with the most points."""
    above, node = [], best
    while node:
        above.append(node)
        node = node.parent
    whole = [x for x in above if x.tag == "article"][-1:] or [x for x in above if x.tag == "main"][:1]
    if whole or best.tag == "body" or not best.parent:
        return whole or [best]
    inner = best
    while best.parent.parent and best.parent.tag not in ("body", "html") and best.parent.size == best.size:
        best = best.parent  # a wrapper of nothing else: its siblings are the ones to judge
    floor = max(MIN_SIBLING, SIBLING_SHARE * inner.points)
    return [x for x in _blocks(best.parent, best) if x is best or x.points * (1 - _link_share(x)) >= floor or (
        _link_share(x) < SIBLING_LINKS and (x.holds or _text_points(x) >= MIN_SIBLING))]


def _write(node: Node, out: list[str]) -> None:
    """The node's text; a mark stands at each end of a block."""
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.cut and not (x.tag in ("ul", "ol") and x is not node and _link_share(x) > MENU_LINKS):
            mark = [" "] if x.tag in BLOCK else []
            todo += mark + x.parts[::-1] + mark


def main_text(html: str | None) -> str:
    """The main text of one page, in blocks joined by one space."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    tree.finish()
    _spare(tree.root)
    order = _measure(tree.root)
    for node in order:
        if _paragraph(node) and node.size:
            points = _text_points(node)
            parent = node.parent if node.tag in PARAGRAPHS and node.parent else node
            parent.points += points
            if parent.parent:
                parent.parent.points += points / 2
    best = max(order, key=lambda n: n.points * (1 - _link_share(n)), default=tree.root)
    if not best.points:
        best = tree.root
    out: list[str] = []
    for x in _kept(best):
        _write(x, out)
    return " ".join("".join(out).split())


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Each row as struct ``r`` with its main text."""
    @F.pandas_udf("string")
    def of(html: pd.Series) -> pd.Series:
        return html.map(main_text)

    return pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("r"),
                        of(F.coalesce(F.col(html_col).cast("string"), F.lit(""))).alias("text"))
