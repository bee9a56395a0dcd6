"""HTML extraction by composite text density.

Pages are parsed to a tree that keeps what browsers would keep of broken markup. Subtrees that
are never article text (menus, adverts, forms, scripts and the like, by tag, role or the names in
class and id) are left out, by class and id only if they hold no article and little of the page.
For each node left, its characters per tag are adjusted for links; the node with the largest sum
of its children's densities is the core of the article, and the path from it to the body gives
the threshold that other subtrees have to reach to be kept.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added, slices, table, texts, tidy

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag ends an open element of these tags, searched up to the tags behind.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("article aside body div dl footer header main nav ol section table td th ul blockquote form".split())
#: Never article text: tags, roles, and what names of class and id end in.
TAGS_OUT = frozenset("head script style nav footer aside form noscript iframe template button select textarea input svg canvas object video audio dialog menu title".split())
ROLES_OUT = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
WORDS_OUT = frozenset("ad ads adv advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification paywall popup promo recommended related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: A name of several words goes by its last word that is none of ENDS, and a name with one of NAMES_OF_OTHERS says nothing of the node itself.
ENDS = frozenset("area author bar block body box button buttons container content entry form group holder icon icons inner item items left link links list meta module outer panel posts right row section slot text thread top bottom unit wrap wrapper".split())
NAMES_OF_OTHERS = frozenset("has no not with without".split())
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KEPT = frozenset("html body article main h1 h2 h3 h4 h5 h6 p".split())
#: The words that take a paragraph out of an article by its class or id; by others it goes only if it is mostly links.
ADVERTS = frozenset("ad ads adv advert adverts advertisement adsense promo sponsor sponsored".split())
#: Share of the least density on the path to the body that other subtrees have to reach. A density grows with
#: the length of paragraphs and slowly with their number; half admits blocks whose paragraphs are half as long.
SHARE = 0.5


class Node:
    __slots__ = ("tag", "parent", "beside", "parts", "chars", "links", "heads", "tags", "link_tags", "block", "body_share", "density", "total")

    def __init__(self, tag: str, parent: Node | None, beside: str = "") -> None:
        self.tag, self.parent, self.beside, self.parts = tag, parent, beside, []


def left_out(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in TAGS_OUT or tag == "header" and not inside_article:
        return True
    if not attributes or tag in KEPT and tag not in {"p"}:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        name = name.lower()
        if name == "hidden" or name == "role" and value in ROLES_OUT or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def beside(attributes: str, inside_article: bool) -> str:
    """The word by which a name in class or id says that the node is beside the article, or an empty one."""
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for token in next((v for v in values if v), "").split():
                words = [w.lower() for w in WORD.findall(token)]
                if not NAMES_OF_OTHERS.isdisjoint(words):
                    continue
                while len(words) > 1 and words[-1] in ENDS:
                    words.pop()
                if words and (words[-1] in WORDS_OUT or words[-1] == "header" and not inside_article):
                    return words[-1]
    return ""


def parse(page: str) -> Node:
    """The tree without the subtrees that are left out by tag and role; parts of a node are nodes and texts."""
    root = Node("html", None)
    stack: list[tuple[str, Node | None]] = [("html", root)]  # None: inside a subtree that is left out
    articles, at = 0, 0

    def close(place: int) -> None:
        nonlocal articles
        for tag, _ in stack[place:]:
            articles -= tag in ("article", "main")
        del stack[place:]

    def say(text: str) -> None:
        if text and stack[-1][1] is not None:
            stack[-1][1].parts.append(html.unescape(text) if "&" in text else text)

    while (m := TOKEN.search(page, at)) is not None:
        say(page[at : m.start()])
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if place:
                close(place)
            continue
        if tag in ("html", "body") and (tag == "html" or any(t == "body" for t, _ in stack)):
            continue
        if tag == "body" and len(stack) > 1:  # a head that was not closed
            close(1)
        if tag in BLOCKS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in SCOPES:
                    break
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in CLOSES[tag]:
                    close(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        above = stack[-1][1]
        node = None
        if above is not None and not left_out(tag, attributes, articles > 0):
            word = beside(attributes, articles > 0) if attributes else ""
            node = Node(tag, above, "links" if word and tag == "p" and articles > 0 and word not in ADVERTS else word)
            above.parts.append(node)
        if tag in RAW:
            found = re.compile(f"</{tag}", re.I).search(page, at)
            at = found.start() if found else len(page)
            if found and (gt := page.find(">", at)) >= 0:
                at = gt + 1
            else:
                at = len(page)
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.append((tag, node))
            articles += tag in ("article", "main")
        elif tag not in VOID and tag in BLOCKS:
            stack.append((tag, node))
            articles += tag in ("article", "main")
    say(page[at:])
    return root


def measure(root: Node, body_share: float | None = None) -> list[Node]:
    """All nodes, children before parents, with characters, links, headings, tags and density; the root comes last."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.parts if isinstance(x, Node)]
    order.reverse()
    for node in order:
        below = [x for x in node.parts if isinstance(x, Node)]
        node.chars = sum(x.chars if isinstance(x, Node) else len("".join(x.split())) for x in node.parts)
        node.tags = sum(x.tags + 1 for x in below)
        node.link_tags = sum(x.link_tags + (x.tag == "a") for x in below)
        node.links = node.chars if node.tag == "a" else sum(x.links for x in below)
        node.heads = node.chars if node.tag in HEADINGS else sum(x.heads for x in below)
        node.block = node.tag in BLOCKS or any(x.block for x in below)
    if body_share is None:
        body_share = root.links / root.chars if root.chars else 0.0
    for node in order:
        node.body_share = body_share
        c, lc, t, lt = node.chars, node.links, max(1, node.tags), max(1, node.link_tags)
        if not c:
            node.density = 0.0
        else:
            base = math.log(c / max(1, c - lc) * lc + body_share * c + math.e)
            node.density = c / t * math.log(max(1.0, c / max(1, lc) * t / lt) + 1e-9) / base if base > 1e-9 else 0.0
        node.total = sum(x.density for x in node.parts if isinstance(x, Node))
    return order


def cut(order: list[Node]) -> bool:
    """Takes out the measured nodes that are beside the article by class or id; if there were any.

    One stays if it holds an <article> or <main> that has text and is not itself beside. On pages
    without these it stays if it holds most of the page's characters outside links.
    """
    root, holds, out = order[-1], set(), set()
    for node in order:  # children before parents
        if (node.tag in ("article", "main") and node.chars and not node.beside or node in holds) and node.parent is not None:
            holds |= {node, node.parent}
    for node in order:
        if node.beside and (node.beside != "links" or mostly_links(node)) and node.tag not in KEPT - {"p"} and node not in holds and (holds or 2 * (node.chars - node.links) <= root.chars - root.links):
            out.add(node)
    for parent in {n.parent for n in out}:
        parent.parts = [x for x in parent.parts if x not in out]
    return bool(out)


def mostly_links(node: Node) -> bool:
    return 2 * node.links > node.chars


def units(node: Node) -> list[Node]:
    """A node's blocks, and what is loose between them as nodes of their own, measured."""
    out: list[Node] = []
    for block, parts in groupby(node.parts, lambda x: isinstance(x, Node) and x.block):
        if block:
            out += parts
        else:
            out.append(Node("span", node))
            out[-1].parts += parts
            measure(out[-1], node.body_share)
    return [x for x in out if x.chars]


def article(root: Node) -> list[Node]:
    """The parts of the article, in order.

    The node with the largest density sum is kept, in the whole of its outermost <article>, or else
    its <main>. SHARE of the least density on its path to the body is the threshold; every other subtree
    that reaches it is kept too, and articles beside the kept one if they are not mostly links. What lies
    between kept parts of one node, or between them and the heading before, is kept unless mostly links.
    """
    order = measure(root)
    if cut(order):
        order = measure(root)
    best = max(reversed(order), key=lambda n: n.total)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    body = next((i for i, n in enumerate(path) if n.tag == "body"), len(path) - 1)
    threshold = SHARE * min(n.density for n in path[: body + 1])
    named = [n for n in path if n.tag == "article"][-1:] or [n for n in path if n.tag == "main"][:1]
    best = (named or [n for n in path if n.block])[0]
    above = set(map(id, path[path.index(best) + 1 :]))

    # from the body down: nodes that are opened, with their units and what is kept of each
    found: dict[int, list[Node]] = {}
    stack: list[tuple[Node, list[Node] | None]] = [(path[-1], None)]
    while stack:
        node, below = stack.pop()
        if node is best or id(node) not in above and (node.density >= threshold or node.tag == best.tag == "article" and node.parent is best.parent and not mostly_links(node)):
            found[id(node)] = [node]
        elif below is None:
            below = units(node) if node.block else []
            stack.append((node, below))
            stack += [(x, None) for x in below]
        else:
            got = [found[id(x)] for x in below]
            kept = [i for i, g in enumerate(got) if g]
            if kept:
                first = next((i for i in range(kept[0] - 1, -1, -1) if below[i].heads == below[i].chars), kept[0])
                while first and below[first - 1].heads == below[first - 1].chars:
                    first -= 1
                for i in range(first, kept[-1]):
                    got[i] = got[i] or ([] if mostly_links(below[i]) else [below[i]])
            whole = node.tag == "article" and kept
            found[id(node)] = [node] if whole else [x for g in got for x in g]
    return found[id(path[-1])]


def blocks(node: Node) -> list[str]:
    """The texts of a node's blocks, white space as single spaces, empty ones left out."""
    out: list[list[str]] = [[]]
    stack: list[object] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out[-1].append(x)
        elif x is None:
            out.append([])
        elif x.tag == "br":
            out[-1].append(" ")
        else:
            if x.tag in BLOCKS:
                out.append([])
                stack.append(None)
            stack += reversed(x.parts)
    return [t for t in (" ".join("".join(b).split()) for b in out) if t]


def extract_text(page: str) -> str:
    return "\n\n".join(b for n in article(parse(page)) for b in blocks(n)) if page else ""


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with text and n_chars in place of the html. Null, empty and textless pages have an
    empty text; columns of pages with those names are replaced; repeated rows are read each."""
    kept = [f for f in pages.schema if f.name not in {column, "text", "n_chars"}]
    pages = pages.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{column}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [extract_text(p) for p in texts(part)]
                yield added(part, text=pa.array(found, pa.string()), n_chars=pa.array([len(t) for t in found], pa.int64()))

    return pages.mapInArrow(tidy(run), ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["text string", "n_chars long"]))


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
