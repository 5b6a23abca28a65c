"""Main text of web pages by composite text density.

A page becomes a small tree of elements. Every node gets the characters and tags below it, and those inside links; its
composite density is characters per tag, lowered where links hold much of the text. The sum of its children's densities
is a node's density sum: the subtree with the largest one is the article. The threshold for what belongs to it is the
lowest density on the path from the body to that subtree, so the article is found whatever its length.

Pages are handled one by one inside tasks; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import sliced, texts_of

# Fixed values of the HTML standard: elements without content, elements with raw text, and elements that lay out as blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea noembed noframes xmp plaintext".split())
# Elements of other vocabularies, those inside them that hold HTML again, and start tags that end them when left open.
FOREIGN = frozenset("svg math".split())
INTEGRATION = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKOUT = frozenset((
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre "
    "ruby s small span strong strike sub sup table tt u ul var").split())
DRAWN = frozenset("svg canvas".split())  # parsed, but their text is never part of the page
BLOCKS = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul br title head").split())
# Elements that a start tag of the given kind ends when they are still open.
CLOSES_P = BLOCKS - frozenset("br body html head title caption tbody td tfoot th thead tr option optgroup li dd dt legend summary".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
        "thead": {"tbody", "tr", "td", "th"}}
SCOPES = frozenset("ul ol dl table select body html article section div main aside nav header footer form menu td th".split())
# Parts of a page that are never article text, by element, by role and by words of class and id.
NOISE_TAGS = frozenset("nav header footer aside form menu dialog button select input label fieldset title head search".split())
NOISE_ROLES = frozenset((
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status tablist "
    "note").split())
NOISE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|advertorial|adsense|adbox|adslot|adunit|banner|sponsor(?:ed|s)?|promo(?:tion|ted|s)?|"
    r"nav|navbar|navigation|menu|menus|submenu|topbar|breadcrumbs?|crumbs?|pager|pagination|toc|"
    r"header|masthead|footer|colophon|copyright|"
    r"sidebar|sidenav|aside|widgets?|rail|"
    r"cookies?|consent|gdpr|notices?|notifications?|alert|popup|modal|overlay|paywall|newsletter|subscribe|subscription|signup|login|"
    r"comments?|commentlist|disqus|replies|reply|respond|"
    r"share|sharing|social|tagcloud|skip|searchbox|form|toolbar|tooltip|hidden)(?:$|[\s_-])")
# A form or a class word marks a part of a page, unless more than this share of the text outside such parts is in it: then
# it is a wrapper. A class that is such a word by itself may name a part that outgrows the article, as comments do.
WRAPPER_SHARE, PART_SHARE = 0.5, 0.75
# Words that also name sections of articles (related work, search results, legal notes): such an element is noise only if links
# hold at least this share of its text.
MIXED_WORDS = re.compile(
    r"(?:^|[\s_-])(?:related|recommend(?:ed|ations?)?|trending|popular|more|legal|search|reviews?|discussion|follow|tags|side|foot)(?:$|[\s_-])")
LINK_SHARE = 0.3
# Elements nest at most so deep, as in browsers; deeper ones are read as their parent's siblings, so walks upward are short.
DEEPEST = 512
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parts", "parent", "depth", "noise", "share", "mixed", "foreign", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, share: float) -> None:
        self.tag, self.parent, self.share, self.mixed = tag, parent, share, False
        self.depth = 0 if parent is None else parent.depth + 1
        self.noise = share > 0
        self.foreign = tag in FOREIGN or parent is not None and parent.foreign
        self.parts: list = []  # strings and nodes in page order


def _noise_share(tag: str, attributes: str) -> float:
    """Share of the text up to which an element is noise: 0 for never, 1 for always."""
    share = WRAPPER_SHARE if tag == "form" else 1.0 if tag in NOISE_TAGS else 0.0
    if share == 1 or not attributes or tag in ("html", "body", "article", "main"):
        return share
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return 1.0
        if name == "role" and (roles := NOISE_ROLES.intersection(value.lower().split())):
            if roles != {"form"}:
                return 1.0
            share = max(share, WRAPPER_SHARE)
        if name in ("class", "id"):
            value = CAMEL.sub("-", value).lower()
            if NOISE_WORDS.search(value):
                share = max(share, PART_SHARE if any(NOISE_WORDS.fullmatch(word) for word in value.split()) else WRAPPER_SHARE)
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            return 1.0
    return share


def _mixed(tag: str, attributes: str) -> bool:
    """Whether a class or an id has a word that names parts of pages and sections of articles alike."""
    return bool(attributes) and tag not in ("html", "body", "article", "main") and any(
        name.lower() in ("class", "id") and MIXED_WORDS.search(CAMEL.sub("-", html.unescape(value.strip("\"'"))).lower())
        for name, value in ATTRIBUTE.findall(attributes))


def parse(source: str) -> Node:
    """Tree of a page. Unclosed and stray tags are read as browsers read them in the cases that occur in articles."""
    root = Node("html", None, 0)
    body = node = Node("body", root, 0)
    root.parts.append(body)
    at, end = 0, len(source)
    opened: Counter[str] = Counter()  # open elements by tag: what isn't open is not looked for
    flat: Counter[str] = Counter()  # of those that nest too deep, the ones whose end tags are still to come

    def leave(to: Node) -> None:
        nonlocal node
        while node is not to:
            opened[node.tag] -= 1
            node = node.parent

    def close(tags: set[str] | frozenset[str], within: frozenset[str] = SCOPES) -> None:
        if not any(opened[t] for t in tags):
            return
        seen = node
        while seen is not body and seen is not root:
            if seen.tag in tags:
                leave(seen.parent)
                return
            if seen.tag in within or seen.foreign and seen.tag in INTEGRATION:
                return
            seen = seen.parent

    def inside_html() -> bool:
        seen = node
        while seen.foreign and seen.tag not in FOREIGN:
            if seen.tag in INTEGRATION:
                return True
            seen = seen.parent
        return False

    while at < end:
        found = TOKEN.search(source, at)
        if not found:
            node.parts.append(source[at:])
            break
        if found.start() > at:
            node.parts.append(source[at:found.start()])
        at, tag = found.end(), found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if tag in ("body", "html"):
                continue
            if flat[tag]:
                flat[tag] -= 1
                continue
            seen = node if opened[tag] else body
            while seen is not body and seen is not root and seen.tag != tag:
                if seen.tag in SCOPES and tag not in SCOPES and tag not in FOREIGN:
                    break
                seen = seen.parent
            if seen.tag == tag and seen is not body:
                leave(seen.parent)
            elif tag == "p":
                node.parts.append(Node("p", node, 0))
            continue
        if tag in ("html", "body"):
            continue
        if node.foreign and tag in BREAKOUT and not inside_html():
            above = node
            while above.foreign:
                above = above.parent
            leave(above)
        if tag in RAW and not (node.foreign and found[3].endswith("/")):
            last = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|</{tag}\Z", re.I).search(source, at)
            at = last.end() if last else end
            continue
        if tag in CLOSES_P:
            close({"p"})
        if tag in ENDS:
            close(ENDS[tag], SCOPES - ENDS[tag])
        if tag[0] == "h" and tag[1:].isdigit():
            close({"h1", "h2", "h3", "h4", "h5", "h6"})
        child = Node(tag, node, _noise_share(tag, found[3]))
        child.mixed = not child.noise and _mixed(tag, found[3])
        if tag not in DRAWN:
            node.parts.append(child)
        # A slash on a common tag of HTML means nothing.
        if tag not in VOID and (not found[3].endswith("/") or tag in ("p", "div", "article", "section", "span", "a", "main", "b", "i", "em", "strong")):
            if node.depth < DEEPEST:
                opened[tag] += 1
                node = child
            else:
                flat[tag] += 1
    return root


def keep_wrappers(root: Node) -> None:
    """Takes the noise mark from elements that hold most of the page's text outside links.

    Largest first; what lies in a wrapper is judged again, against the text that is outside noise by then.
    """
    order, stack, marked = [], [root], False
    while stack:
        node = stack.pop()
        order.append(node)
        marked = marked or 0 < node.share < 1
        stack.extend(p for p in node.parts if type(p) is Node and p.share < 1)
    if not marked:
        return
    for node in reversed(order):  # all text below, and the part of it that is not in further noise
        node.chars = node.total = 0
        if node.tag != "a":
            for part in node.parts:
                if type(part) is str:
                    size = len(part) - part.count(" ") - part.count("\n")
                    node.chars, node.total = node.chars + size, node.total + size
                elif part.share < 1:
                    node.chars += part.chars
                    node.total += 0 if part.noise else part.total

    def outermost(top: Node) -> None:
        within = [top]
        while within:
            for part in within.pop().parts:
                if type(part) is Node and part.share < 1:
                    if part.noise:
                        heappush(waiting, (-part.chars, len(waiting), id(part), part))
                    else:
                        within.append(part)

    waiting: list[tuple[int, int, int, Node]] = []
    free = root.total
    outermost(root)
    while waiting:
        node = heappop(waiting)[-1]
        if node.chars > node.share * (node.chars + free):
            node.noise = False
            free += node.total
            outermost(node)


def measure(root: Node) -> list[Node]:
    """Densities of all nodes, children first. Noise counts as nothing, so it can't lift what surrounds it."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(p for p in node.parts if type(p) is Node and not p.noise)
    order.reverse()
    for node in order:
        chars = tags = link_chars = link_tags = 0
        for part in node.parts:
            if type(part) is str:
                chars += len(part) - part.count(" ") - part.count("\n")
            elif not part.noise:
                chars += part.chars
                tags += part.tags + 1
                link_chars += part.link_chars
                link_tags += part.link_tags
        if node.tag == "a":
            link_chars, link_tags = chars, tags + 1
        node.chars, node.tags, node.link_chars, node.link_tags = chars, tags, link_chars, link_tags
    whole = max(root.chars, 1)
    ratio = root.link_chars / whole
    for node in order:
        chars, tags, links, anchors = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        if not chars:
            node.density = 0.0
        else:
            base = log(chars / max(chars - links, 1) * links + ratio * chars + e)
            node.density = chars / tags * log(max(chars / max(links, 1) * tags / max(anchors, 1), 1.0) + e) / max(log(base + e), 1.0)
        node.total = sum(p.density for p in node.parts if type(p) is Node and not p.noise)
        if any(type(p) is str and not p.isspace() for p in node.parts):
            node.total += node.density
    return order


def article_node(root: Node) -> Node | None:
    """The subtree with the largest density sum, widened to the article that holds it.

    The threshold is the lowest density on the path up to the body: an ancestor joins if it adds children that are as
    dense as that. Wrappers on the way that add none are passed over, as the article may go on in what holds them.
    """
    keep_wrappers(root)
    order = measure(root)
    linked = [n for n in order if n.mixed and n.link_chars >= LINK_SHARE * max(n.chars, 1)]
    if linked:
        for node in linked:
            node.noise = True
        order = measure(root)
    order = [n for n in order if n.chars]
    if not order:
        return None
    best = max(order, key=lambda n: (n.total, n.chars))
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    for node in path[1:]:
        if node.tag in ("article", "main"):
            return node
    for below, node in zip(path, path[1:], strict=False):
        if node.tag != "html" and any(type(p) is Node and not p.noise and p is not below and p.chars and p.density >= threshold for p in node.parts):
            best = node
    return best


def block_texts(top: Node) -> list[str]:
    """Texts of the blocks in page order: character references decoded, white space folded, empty blocks left out."""
    blocks: list[str] = []
    pieces: list[str] = []

    def flush() -> None:
        if pieces:
            text = SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                blocks.append(text)

    stack: list = [top]
    while stack:
        part = stack.pop()
        if part is None:
            flush()
        elif type(part) is str:
            pieces.append(part)
        elif not (part.noise and part is not top):
            if part.tag in BLOCKS:
                flush()
                stack.append(None)
            stack.extend(reversed(part.parts))
    flush()
    return blocks


def main_text(source: str | None) -> str:
    """The article's text of one page; empty if it has none."""
    top = article_node(parse(source or ""))
    return "\n".join(block_texts(top)) if top is not None else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, from its whole html.

    A null or empty html, or one without text outside menus and the like, gives the empty text. An element whose class merely
    sounds like a menu, or a form, counts as part of the page if it holds most of its text. Null ids and urls are
    kept, repeated rows are repeated, other columns are ignored. An empty table gives no rows.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [main_text(source) for source in texts_of(batch, "html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()),
                 pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
