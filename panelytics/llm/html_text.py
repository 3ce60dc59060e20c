"""Main text of web pages by composite text density.

A page becomes a tree of its elements. Each element's density is its characters per tag, adjusted for the share that
stands in links; the sum of its children's densities tells how much text it gathers. The subtree with the largest sum
is the main text, and the least density on the way from it up to the body is the threshold for further parts.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelytics.llm.batches import in_batches

# Names of the page language, by what they mean for the tree.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup, up to their close tag or the end of the page.
RAW = ("script", "style", "textarea", "title", "xmp")
#: Elements whose content isn't text of the page. Without a close tag of its own, one ends before the next block.
SKIPPED = ("noscript", "template", "iframe", "svg", "select", "object")
#: Elements that run inside a line of text; all others begin and end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr".split()
)
#: Elements of the page's frame.
OUTSIDE = frozenset("head nav header footer aside form button input menu dialog noscript fieldset".split())
#: Of these, some are also put around whole pages.
WRAPPERS = frozenset("header form fieldset".split())
#: Roles and class or id tokens that mark the frame. A token counts as a whole: all its parts between hyphens are words
#: of the frame or say which one (site-header), so has-sidebar or no-comments isn't one.
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb"
    " breadcrumbs sidebar aside footer header masthead cookie cookies consent notice notices gdpr popup modal newsletter"
    " subscribe signup login search comment comments disqus replies respond related recommended share sharing social widget"
    " toolbar pagination pager skip legal copyright".split()
)
QUALIFIERS = frozenset(
    "site page main global top bottom left right primary secondary side box bar container block area section list links link"
    " button buttons form unit slot inner outer thread wrap wrapper".split()
)
#: Tokens that mark what readers wrote; further parts of such a token are of the frame, a number or of COMMENT_PARTS.
COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
COMMENT_PARTS = frozenset("author body content count entry item meta reader readers reply text thread user users".split())
#: What a head holds; any other element ends it.
IN_HEAD = frozenset("meta link base basefont bgsound noscript template object".split())
#: Elements that an opening tag of the key closes, if one is open above it in the same container.
CLOSED_BY = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
CONTAINERS = frozenset("ul ol dl table tbody thead tfoot body html article main section div".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)

_COMMENT = r"<!---?>|<!--.*?(?:--!?>|\Z)"
_RAW = r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?P<rawattrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>.*?(?:</(?P=raw)\s*>|\Z)"
_TOKEN = re.compile(
    rf"{_COMMENT}{_RAW}"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_SKIPPED = re.compile(
    rf"{_COMMENT}{_RAW}"
    r"|<(?P<close>/?)(?P<name>" + "|".join(SKIPPED) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?(?:>|\Z)",
    re.S | re.I,
)
_NEXT_BLOCK = re.compile(
    r"</?(?:" + "|".join(sorted(CLOSES_P | CONTAINERS | {"aside", "head", "td", "th", "tr", "li", "dt", "dd"})) + r")(?=[\s/>])", re.I
)
_MARKS = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Linked(str):
    """Text that stands in a link."""

    __slots__ = ()


class Node:
    """An element that begins a block: its parts are texts and other nodes, in page order."""

    __slots__ = ("name", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density", "gathered", "frame", "closed")

    def __init__(self, name: str, parent: Node | None, frame: str = ""):
        self.name, self.parent = name, parent
        self.frame, self.closed = frame, False  # "" or how the element is marked as frame; whether its own tag closed it
        self.parts: list[str | Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.gathered = 0.0


def _size(text: str) -> int:
    return len(text) - sum(map(text.count, " \n\t\r"))


def _is_frame_token(token: str) -> bool:
    parts = re.split("[-_]+", token)
    return not OUTSIDE_WORDS.isdisjoint(parts) and all(part in OUTSIDE_WORDS or part in QUALIFIERS for part in parts)


def _is_comment_token(token: str) -> bool:
    first, *rest = re.split("[-_]+", token)
    return first in COMMENT_WORDS and all(
        part in COMMENT_WORDS or part in COMMENT_PARTS or part in QUALIFIERS or part.isdigit() for part in rest
    )


def _frame_mark(name: str, attrs: str) -> str:
    """Whether the element is marked as the page's frame: "surely", "likely" (a wrapper may be, too), "comments" of
    readers (also if each is an article of its own), or not ("")."""
    if attrs and name not in ("body", "html", "main"):
        marks = [(mark.lower(), "".join(values).lower()) for mark, *values in _MARKS.findall(attrs)]
        if any(mark in ("class", "id") and any(map(_is_comment_token, value.split())) for mark, value in marks):
            return "comments"
    if name in OUTSIDE:
        return "likely" if name in WRAPPERS else "surely"
    if name in ("body", "html", "article", "main") or not attrs:
        return ""
    found = ""
    for mark, value in marks:
        if mark == "role" and value in OUTSIDE_ROLES or mark == "hidden" or mark == "aria-hidden" and value == "true":
            return "surely"
        if mark in ("class", "id") and any(map(_is_frame_token, value.split())):
            found = "likely"
    return found


def _without_frame(root: Node) -> None:
    """Cuts the elements marked as frame, but for those that hold the page's main part.

    An element with a <main> stays; one with articles stays if they are most of the page's text, or if it isn't surely
    frame and they are most of all articles, or if only a missing close tag put them into it. Where no article or main
    is elsewhere, an element that isn't surely frame also stays with most of the page's text. Density decides on these.
    What readers wrote never counts, however long it is, and stays out unless it holds a <main>, or an article that only
    a missing close tag put into it.
    """
    nodes = _in_order(root)
    by_readers: set[int] = set()
    for node in nodes:  # parents first; an article that isn't itself marked counts below an unclosed mark
        if node.frame == "comments" or node.parent and id(node.parent) in by_readers:
            if node.frame == "comments" or node.name not in ("article", "main"):
                by_readers.add(id(node))
    chars = {id(n): 0 if n.name == "head" or id(n) in by_readers else n.chars for n in nodes}
    articles, mains = dict.fromkeys(chars, 0), dict.fromkeys(chars, False)
    for node in reversed(nodes):
        own = id(node)
        if node.name in ("article", "main") and own not in by_readers:
            articles[own] = chars[own]
            mains[own] |= node.name == "main"
        if node.parent:
            above = id(node.parent)
            chars[above] += chars[own]
            articles[above] += articles[own]
            mains[above] |= mains[own]
    page, in_articles, page_has_main = chars[id(root)], articles[id(root)], mains[id(root)]

    def stays(node: Node) -> bool:
        own = id(node)
        if node.frame == "comments":
            return mains[own] or bool(articles[own]) and not node.closed
        if mains[own] or articles[own] and (not node.closed or 2 * articles[own] > page):
            return True
        if node.frame == "surely":
            return False
        if articles[own]:
            return not page_has_main and 2 * articles[own] > in_articles
        return not page_has_main and not in_articles and 2 * chars[own] > page

    for node in nodes:  # parents first
        parts: list[str | Node] = []
        for part in node.parts:
            if isinstance(part, str) or not part.frame:
                parts.append(part)
            elif stays(part):
                part.frame = ""
                parts.append(part)
        node.parts = parts


def _ends_of_skipped(page: str) -> dict[int, int]:
    """Where each SKIPPED element that has a close tag starts and ends. Elements of one name may nest."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {name: [] for name in SKIPPED}
    for tag in _SKIPPED.finditer(page):
        if not (name := (tag["name"] or "").lower()):
            continue
        if not tag["close"]:
            if not tag[0].endswith("/>"):
                opened[name].append(tag.start())
        elif opened[name]:
            ends[opened[name].pop()] = tag.end()
    return ends


def tree_of(page: str) -> Node:
    """The page's blocks, without its frame. Inline elements only count as tags, links also as such.

    Of SKIPPED elements a self-closed one is empty, and one without a close tag ends before the next block.
    """
    root = node = Node("html", None)
    ends = _ends_of_skipped(page)
    in_link, at = False, 0
    inline_frames: dict[int, int] = {}  # inline elements marked as frame: how many of their name are open in them

    def add(text: str) -> None:
        if not text:
            return
        text = html.unescape(text)
        node.parts.append(Linked(text) if in_link else text)
        size = _size(text)
        node.chars += size
        if in_link:
            node.link_chars += size

    def enclosing(name: str) -> Node | None:
        above = node
        while above and above.name != name:
            above = above.parent
        return above

    def out_of_frames() -> Node:
        above, out = node, node
        while above:
            if above.frame:
                out = above.parent
            above = above.parent
        return out

    while token := _TOKEN.search(page, at):
        add(page[at : token.start()])
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            continue
        if name in SKIPPED:
            if token.start() in ends:
                at = max(at, ends[token.start()])
            elif not token["close"] and not token[0].endswith("/>"):
                following = _NEXT_BLOCK.search(page, at)
                at = following.start() if following else len(page)
            continue
        if token["close"]:
            if name == "a":
                in_link = False
            if name in INLINE:
                above = enclosing(name) if inline_frames else None
                if above:
                    inline_frames[id(above)] -= 1
                    if not inline_frames[id(above)]:
                        above.closed = True
                        node = above.parent
                continue
            above = enclosing(name)
            if above and above.parent:
                above.closed = True
                node, in_link = above.parent, False
            elif name in ("body", "html"):
                node = out_of_frames()
            continue
        if node.name == "head" and name not in IN_HEAD:
            node = node.parent
        if name == "body":
            node = out_of_frames()
        frame = _frame_mark(name, token["attrs"])
        if name in INLINE:
            if inline_frames and (above := enclosing(name)) and name not in VOID:
                inline_frames[id(above)] += 1
            elif frame and name not in VOID:
                child = Node(name, node, frame)
                node.parts.append(child)
                node = child
                inline_frames[id(child)] = 1
                continue
            node.tags += 1
            if name == "a":
                in_link = True
                node.link_tags += 1
            elif name == "br":
                add(" ")
            continue
        if frame and name in VOID:
            continue
        if name in ("html", "body") and root is not node and name == "html":
            continue
        in_link = False
        if name in CLOSES_P and node.name == "p":
            node = node.parent
        for closed in CLOSED_BY.get(name, ()):
            above = node
            while above and above.name != closed and above.name not in CONTAINERS and not above.frame:
                above = above.parent
            if above and above.name == closed:
                node = above.parent
        child = Node(name, node, frame)
        node.parts.append(child)
        if name not in VOID:
            node = child
    add(page[at:])
    _without_frame(root)
    return root


def _in_order(root: Node) -> list[Node]:
    """All nodes, parents before children."""
    nodes = [root]
    for node in nodes:
        nodes.extend(p for p in node.parts if isinstance(p, Node))
    return nodes


def _density(chars: int, tags: int, linked: int, links: int, link_share: float) -> float:
    if not chars:
        return 0.0
    tags, links = max(tags, 1), max(links, 1)
    base = math.log(chars / max(chars - linked, 1) * linked + link_share * chars + math.e)
    adjusted = chars / max(linked, 1) * tags / links
    return chars / tags * max(math.log(max(adjusted, 1)) / math.log(max(base, 1.001)), 0.0)


def _link_share(nodes: list[Node]) -> float:
    """Of the weighed body's characters."""
    body = next((n for n in nodes if n.name == "body"), nodes[0])
    return body.link_chars / max(body.chars, 1)


def weigh(root: Node) -> list[Node]:
    """Sets densities and their sums; the nodes, parents before children."""
    nodes = _in_order(root)
    for node in reversed(nodes):
        if node.parent:
            node.parent.chars += node.chars
            node.parent.tags += node.tags + 1
            node.parent.link_chars += node.link_chars
            node.parent.link_tags += node.link_tags
    link_share = _link_share(nodes)
    for node in reversed(nodes):
        node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, link_share)
        if node.parent:
            node.parent.gathered += node.density
    return nodes


def _bare_runs(parts: list[str | Node]) -> Iterator[Node | list[str]]:
    """The nodes among the parts, and the runs of bare text between them."""
    run: list[str] = []
    for part in parts:
        if isinstance(part, str):
            run.append(part)
            continue
        if run:
            yield run
            run = []
        yield part
    if run:
        yield run


def _run_density(run: list[str], link_share: float) -> float:
    links = [part for part in run if isinstance(part, Linked)]
    return _density(sum(map(_size, run)), len(links), sum(map(_size, links)), len(links), link_share)


def _blocks(node: Node, out: list[str]) -> None:
    """Texts of the node's blocks, with white space as one blank, in page order."""
    open_text: list[str] = []

    def end() -> None:
        if block := " ".join("".join(open_text).split()):
            out.append(block)
        open_text.clear()

    stack: list[Iterator] = [iter(node.parts)]
    while stack:
        part = next(stack[-1], None)
        if isinstance(part, str):
            open_text.append(part)
            continue
        end()
        if part is None:
            stack.pop()
        else:
            stack.append(iter(part.parts))


def main_text(page: str | None) -> str:
    """The article's blocks, joined by two line breaks; empty if the page has no text outside its frame."""
    if not page:
        return ""
    nodes = weigh(tree_of(page))
    best = max(nodes, key=lambda n: n.gathered)
    if not best.gathered:
        best = max(nodes, key=lambda n: n.density)
    if not best.chars:
        return ""
    # an article is whole: no part of it is chosen, and of nested ones (or a <main> around it) the outermost
    above, marked = best, None
    while above:
        if above.name in ("article", "main"):
            marked = above
        above = above.parent
    best = marked or best
    threshold, above = best.density, best.parent
    while above and above.name != "html":
        if above.density:
            threshold = min(threshold, above.density)
        above = above.parent
    on_path, above = set(), best.parent
    while above:
        on_path.add(id(above))
        above = above.parent
    # what stands beside the path is held to the threshold, bare text too
    link_share = _link_share(nodes)
    out: list[str] = []
    waiting: list[Node | list[str]] = [nodes[0]]
    while waiting:
        part = waiting.pop()
        if isinstance(part, list):
            if block := " ".join("".join(part).split()):
                out.append(block)
            continue
        if id(part) not in on_path:
            _blocks(part, out)
            continue
        for child in reversed([*_bare_runs(part.parts)]):
            if isinstance(child, list):
                kept = _run_density(child, link_share) >= threshold
            else:
                further = child.name in ("article", "main") if marked else re.fullmatch("h[1-6]", child.name)
                kept = child is best or id(child) in on_path or further or child.density >= threshold
            if kept:
                waiting.append(child)
    return "\n\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of each row of ``pages``; null html is empty and has no text.

    Each page is worked out on its own where it is read: no shuffle, and equal pages get equal texts. Nothing but the
    page's frame is dropped, however long it is.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["page_id", "url", "text", "n_chars"])

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], *fields])
    return in_batches(pages.select("page_id", "url", "html"), step, schema)
