"""HTML extraction by composite text density.

Each page is parsed into a tree (tolerant of unclosed and stray tags).  What can't be article text is cut
first: scripts, styles, forms, navigation, page headers and footers, asides, comments and hidden elements.  Then
every node's composite density is computed: its characters per tag, adjusted by the share of link characters and
link tags against those of the body.  A node's density sum is the sum of its block children's densities (inline
markup belongs to its block); the subtree of largest sum is the core of the article.

The core is widened to the ``article`` (else ``main``) around it, with all its headings, ledes and shorter sections.
Where there is none, each ancestor adds those of its children that are text: headings, paragraphs, and blocks with
a title or a paragraph, unless they are link lists.  Any other node whose density reaches the least density on the path from the
body (included) to the core is a part of a split article and is kept.

A class or id that names an ad, a sidebar, comments and so on is a hint only: it cuts a node of little or link-heavy
text, and lowers the densities inside a longer one.  It says nothing about a node that holds most of the page's text,
about headers within an article, or about inline markup of a paragraph.  Blocks of links are not kept, but lists and tables
of an ``article`` or ``main`` are.

Character references are decoded, white space within a block becomes one space, and blocks are joined
in page order by one space.  Null and empty pages, and pages without text, give an empty text.  Repeated
pages give equal texts; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import arrow_schema, chunks

#: Characters up to which a hinted node is cut, and the factor of the densities in a longer one.
LITTLE, HINTED = 200, 0.2
#: Characters of a paragraph that make a block beside the core text.
PARAGRAPH = 80

# Elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg select annotation annotation-xml".split())
#: Of these, elements whose end a page may lack: without it, only the tag itself goes.
OPEN_ENDED = frozenset("noscript template svg select annotation annotation-xml".split())
DROPPED = frozenset("nav footer aside form dialog menu button".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr object math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder "
    "munderover mmultiscripts mprescripts mfenced menclose mpadded mphantom mstyle merror mtable mtr mtd".split()
)
TEXT = frozenset("h1 h2 h3 h4 h5 h6 hgroup p pre blockquote figure ol ul dl table".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section summary table ul".split()
)
SAME = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
SCOPE = frozenset("html body article section main div table ul ol dl td th tr blockquote header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|side-?bar\w*|footer|header|masthead|cookies?|consent|gdpr|notices?|"
    r"newsletter|subscribe|popup|modal|overlay|comments?|disqus|repl(?:y|ies)|respond|share|sharing|social|related|recommend\w*|"
    r"breadcrumbs?|login|signup|search|widget|toolbar|skip)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Headers of an article, not of the site; and names that leave nothing but an ad.
ARTICLE_HEADER = re.compile(r"\b(?:entry|post|article|story|content|section|blog|news)[_-]+header\b", re.IGNORECASE)
AD = re.compile(r"\s*(?:ads?|advert\w*)\s*", re.IGNORECASE)
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "parent", "first", "last", "chars", "tags", "link_chars", "link_tags", "own", "density", "total", "hint", "cut")

    def __init__(self, tag: str, parent: int, first: int) -> None:
        self.tag, self.parent, self.first, self.last = tag, parent, first, first
        self.chars = self.tags = self.link_chars = self.link_tags = self.own = 0
        self.density = self.total = 0.0
        #: 1 where class or id hint at other than article text, 2 where they name an ad and nothing else.
        self.hint = 0
        self.cut = False


def _hidden(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not inside_article:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return True
    return False


def _hint(tag: str, attributes: str, within: bool, in_paragraph: bool) -> int:
    """What class and id say of an element, which may be within an article or a paragraph."""
    if not attributes or tag in ("html", "body", "article", "main") or tag in INLINE and in_paragraph:
        return 0
    if tag == "header" and within:
        return 0
    out = 0
    for m in ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() not in ("class", "id"):
            continue
        value = ARTICLE_HEADER.sub("", value)
        found = [x[0].strip(" \t\r\n_-").lower() for x in HINT.finditer(value)]
        if any(x != "header" or not within for x in found):
            out = max(out, 2 if AD.fullmatch(value) else 1)
    return out


def parse(page: str) -> tuple[list[Node], list[str]]:
    """The kept nodes in page order (the first is the root), and pieces of text with block ends between."""
    nodes, pieces = [Node("#root", -1, 0)], []
    stack = [0]
    cut_at: int | None = None
    at, size = 0, len(page)

    def close(depth: int) -> None:
        nonlocal cut_at
        while len(stack) > depth:
            k = stack.pop()
            if k >= 0:
                nodes[k].last = len(pieces)
        if cut_at is not None and len(stack) <= cut_at:
            cut_at = None

    # The open elements, where each name is open, and which of them are blocks.
    names, places, blocks = ["#root"], {"#root": [0]}, [0]
    endless: set[str] = set()

    def pop_to(depth: int) -> None:
        while len(names) > depth:
            places[names.pop()].pop()
        while blocks and blocks[-1] >= depth:
            blocks.pop()
        close(depth)

    while at < size:
        match = TAG.search(page, at)
        stop = match.start() if match else size
        if stop > at and cut_at is None:
            text = page[at:stop]
            pieces.append(html.unescape(text) if "&" in text else text)
            node = nodes[stack[-1]]
            node.own += len("".join(pieces[-1].split()))
        if not match:
            break
        at = match.end()
        name = (match[2] or match[5] or "").lower()
        if not name:
            continue
        attributes = match[3] or match[6] or ""
        if match[1] or match[4]:
            if places.get(name):
                depth = places[name][-1]
                if depth and not (name in INLINE and blocks[-1] > depth):
                    pop_to(depth)
            if name not in INLINE:
                pieces.append("\n")
            continue
        if name in RAW:
            if attributes.endswith("/") and name == "svg" or name in endless:
                continue
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(page, at)
            if end or name not in OPEN_ENDED:
                at = end.end() if end else size
            else:
                endless.add(name)
            continue
        if name not in INLINE:
            pieces.append("\n")
        if name in VOID or attributes.endswith("/") and name in INLINE:
            if cut_at is None:
                nodes[stack[-1]].tags += 1
            continue
        closing = "p" if name in CLOSES_P else SAME.get(name, "")
        if closing:
            wanted = closing.split()
            for depth in reversed(blocks[1:]):
                if names[depth] in wanted:
                    pop_to(depth)
                    break
                if names[depth] in SCOPE and names[depth] not in ("tr", "td", "th") or names[depth] in ("table", "ul", "ol", "dl"):
                    break
        within = bool(places.get("article") or places.get("main"))
        if cut_at is not None:
            stack.append(-1)
        elif _hidden(name, attributes, within):
            cut_at = len(stack)
            stack.append(-1)
        else:
            nodes.append(Node(name, stack[-1], len(pieces)))
            nodes[-1].hint = _hint(name, attributes, within, bool(places.get("p")))
            stack.append(len(nodes) - 1)
        places.setdefault(name, []).append(len(names))
        if name not in INLINE:
            blocks.append(len(names))
        names.append(name)
    close(0)
    return nodes, pieces


def _apply_hints(nodes: list[Node], body: int) -> None:
    """Cut hinted nodes of little or link-heavy text; a hint on most of the page's text is taken back."""
    if not any(n.hint for n in nodes):
        return
    chars, links = [n.own for n in nodes], [0] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        if nodes[k].tag == "a":
            links[k] = chars[k]
        chars[nodes[k].parent] += chars[k]
        links[nodes[k].parent] += links[k]
    for k, node in enumerate(nodes):
        if node.parent >= 0 and nodes[node.parent].cut:
            node.cut = True
        elif node.hint:
            if 2 * chars[k] > chars[body] and not (node.hint == 2 and chars[k] <= LITTLE):
                node.hint = 0
            else:
                node.cut = chars[k] <= LITTLE or 2 * links[k] > chars[k]


def densities(nodes: list[Node]) -> int:
    """Fill in counts and densities from the leaves up; returns the body's index."""
    body = next((k for k, n in enumerate(nodes) if n.tag == "body"), 0)
    if body and sum(n.own for n in nodes[:body]) > sum(n.own for n in nodes[body:]):
        body = 0
    _apply_hints(nodes, body)
    for node in reversed(nodes):
        if node.cut:
            continue
        node.chars += node.own
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if node.parent >= 0:
            up = nodes[node.parent]
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    whole = nodes[body]
    ratio = whole.link_chars / max(whole.chars, 1)
    weights = [1.0] * len(nodes)
    for k, node in enumerate(nodes):
        weights[k] = (weights[node.parent] if node.parent >= 0 else 1.0) * (HINTED if node.hint else 1.0)
    for node, weight in zip(reversed(nodes), reversed(weights), strict=True):
        if node.chars:
            tags, links, link_tags = max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
            plain = max(node.chars - node.link_chars, 1)
            base = math.log(node.chars / plain * node.link_chars + ratio * node.chars + math.e)
            node.density = max(node.chars / tags * math.log(max(node.chars / links * tags / link_tags, 1.0)) / math.log(max(base, 1.0) + math.e - 1), 0.0) * weight
        if node.parent >= 0 and node.tag not in INLINE:
            nodes[node.parent].total += node.density
    return body


def _with_paragraphs(nodes: list[Node]) -> list[bool]:
    """Whether each node is or holds a title or a longer paragraph."""
    out = [False] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        plain = nodes[k].chars - nodes[k].link_chars
        out[k] = out[k] or not nodes[k].cut and (nodes[k].tag in ("p", "pre", "blockquote") and plain >= PARAGRAPH or nodes[k].tag == "h1" and plain > 0)
        out[nodes[k].parent] |= out[k]
    return out


def _text_of(nodes: list[Node], pieces: list[str], up: int, inner: int, children: list[int], paragraphs: list[bool]) -> list[tuple[int, int]]:
    """Where an ancestor of the core has text of its own: loose text, headings, paragraphs, blocks with a title or paragraph.

    ``inner`` is the child around the core, whose text is chosen already.
    """
    out, at, links, loose = [], nodes[up].first, 0, []
    for k in children:
        node = nodes[k]
        if node.tag in INLINE and k != inner:
            links += node.link_chars
            continue
        loose.append((at, node.first))
        at = max(at, node.last)
        if k == inner or not node.chars or node.hint or node.cut:
            continue
        if 2 * node.link_chars <= node.chars and (node.tag in TEXT or paragraphs[k]):
            out.append((node.first, node.last))
    loose.append((at, nodes[up].last))
    # Signs between links are no text.
    if nodes[up].own > links:
        out += [(a, b) for a, b in loose if any(x.strip() for x in pieces[a:b])]
    return out


def extract(page: str | None) -> str:
    """The article text of one page."""
    if not page:
        return ""
    nodes, pieces = parse(page)
    body = densities(nodes)
    inside = [k for k in range(body, len(nodes)) if nodes[k].first >= nodes[body].first and nodes[k].last <= nodes[body].last]
    inside = [k for k in inside if nodes[k].chars]
    if not inside:
        return ""
    best = max(inside, key=lambda k: (nodes[k].total, nodes[k].chars, -k))
    path = [best]
    while path[-1] > 0 and path[-1] != body:
        path.append(nodes[path[-1]].parent)
    least = min(nodes[k].density for k in path)
    around = [k for k in path if nodes[k].tag == "article"] or [k for k in path if nodes[k].tag == "main"]
    core = around[-1] if around else best
    chosen = [(nodes[core].first, nodes[core].last)]
    # Ancestors add their text; around an article only those within the main part do.
    above = path[path.index(core) + 1 :]
    if around:
        last = max((i for i, k in enumerate(above) if nodes[k].tag == "main"), default=-1)
        above = above[: last + 1]
    if above:
        children: list[list[int]] = [[] for _ in nodes]
        for k in range(1, len(nodes)):
            children[nodes[k].parent].append(k)
        paragraphs = _with_paragraphs(nodes)
        for inner, up in zip([core, *above], above, strict=False):
            chosen += _text_of(nodes, pieces, up, inner, children[up], paragraphs)
    covered = bytearray(len(pieces) + 1)
    for a, b in chosen:
        covered[a:b] = b"\1" * (b - a)
    for k in sorted(inside, key=lambda k: -nodes[k].total):
        node = nodes[k]
        if node.density >= least and node.tag not in INLINE and 2 * node.link_chars <= node.chars and covered.find(1, node.first, node.last) < 0:
            chosen.append((node.first, node.last))
            covered[node.first : node.last] = b"\1" * (node.last - node.first)
    # Lists and tables of an article are its text, whatever they link to.
    within = [False] * len(nodes)
    for k, n in enumerate(nodes):
        within[k] = n.tag in ("article", "main") or n.parent >= 0 and within[n.parent]
    skipped = [
        (n.first, n.last)
        for n, kept in zip(nodes, within, strict=True)
        if n.tag in ("div", "section") + ("ul", "ol", "table") * (not kept) and n.link_tags >= 3 and n.link_chars > 0.6 * n.chars
    ]
    gone = {(n.first, n.last) for n in nodes if n.cut}
    skipped = sorted({*skipped, *gone}, key=lambda x: (x[0], -x[1]))
    out = []
    for first, last in sorted(chosen):
        at = first
        for a, b in skipped[bisect.bisect_left(skipped, (first, -1)) : bisect.bisect_left(skipped, (last, -1))]:
            if at <= a and b <= last and ((a, b) != (first, last) or (a, b) in gone):
                out += [*pieces[at:a], "\n"]
                at = b
        out += [*pieces[at:last], "\n"]
    return " ".join("".join(out).split())


_SCHEMA, _ARROW = arrow_schema("page_id long, url string, text string, n_chars long")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            texts = [extract(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                schema=_ARROW,
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, _SCHEMA)
